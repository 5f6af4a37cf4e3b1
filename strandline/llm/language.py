"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary, learnt by expectation maximisation on a bounded sample
of labelled documents: of the `languages` values of lang with most labelled documents (equal ones by name), per_language
documents each, of any length, the least by a hash of doc_id. Words are counted and each language is fitted on the
executors; one array of piece counts for each language reaches the driver. A word's likelihood under a language is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words, and its score the
posterior of the best language under equal priors.

The forward pass runs once for each distinct word of a block, all languages and all words of a length together; texts are
then counted against it. Words are runs of letters, lower-cased, and are scored whole, however long; only what is learnt
is learnt from runs cut after every WORD letters.

Defined results: null texts and texts without a letter are `und` with score 0; rows with a null doc_id or lang teach
nothing, and rows that repeat a doc_id and a lang teach once, by the text with the least hash; of languages that score
alike the first by name is named; with no labelled row at all every text is `und`; repeated rows give repeated rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import crc_part, sampled, slices

WORD, UNKNOWN, MARK = 48, 1e-8, "▁"
LETTERS = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes of the pieces, their numbers, the longest piece's length): lower-case letters, with or without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    pieces = sorted(p for p in pieces if p and (p == MARK or p.lstrip(MARK).isalpha()) and MARK not in p[1:])
    hashes = np.array([_hash(p) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order, max(map(len, pieces))


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_MUL) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def lookups(path: str, words: np.ndarray):
    """words: (count, length) code points. Yields (piece length, (count, starts) piece numbers or -1)."""
    hashes, numbers, longest = vocabulary(path)
    n = words.shape[1]
    h = np.zeros(words.shape, np.uint64)
    for size in range(1, min(n, longest) + 1):
        h = h[:, : n - size + 1] * _MUL + words[:, size - 1 :] + np.uint64(1)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        yield size, np.where(hashes[at] == h, numbers[at], -1)


def matrix(words: list[str]) -> np.ndarray:
    """Words of one length as code points, each behind the word mark."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
    return np.concatenate([np.full((len(words), 1), ord(MARK), np.uint64), flat], 1)


def _edges(path, words, table):
    """For each start and size the probability rows (count, starts, languages); an absent single character is UNKNOWN."""
    for size, numbers in lookups(path, words):
        p = table[numbers]
        if size == 1:
            p = np.where((numbers < 0)[:, :, None], UNKNOWN, p)
        yield size, numbers, p


def forward(path: str, words: np.ndarray, table: np.ndarray, step: int = 4096) -> np.ndarray:
    """(count, languages) log likelihood of each word, all segmentations summed. table's last row is zeros.

    Long words are read `step` letters at a time; the sums of as many letters as the longest piece has are carried on, and
    scaled so that they do not vanish.
    """
    n, longest = words.shape[1], vocabulary(path)[2]
    alpha = np.zeros((longest, len(words), table.shape[1]))
    alpha[-1] = 1
    log = np.zeros(alpha.shape[1:])
    for s in range(0, n, step):
        low, m = max(0, s - longest + 1), min(step, n - s)
        edges = [(size, p) for size, _, p in _edges(path, words[:, low : s + m], table)]
        alpha = np.concatenate([alpha[-longest:], np.zeros((m, *alpha.shape[1:]))])
        for k in range(1, m + 1):
            j = longest - 1 + k
            for size, p in edges[: s + k]:
                alpha[j] += alpha[j - size] * p[:, s + k - size - low]
            if k % longest == 0 or k == m:
                scale = np.maximum(alpha[j - longest + 1 : j + 1].max(0), 1e-300)
                alpha[j - longest + 1 : j + 1] /= scale
                log += np.log(scale)
    return log + np.log(np.maximum(alpha[-1], 1e-300))


def expected(path: str, words: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in words seen counts times, for one language."""
    n = words.shape[1]
    edges = [(size, numbers, p[:, :, 0]) for size, numbers, p in _edges(path, words, table)]
    alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    alpha[0] = beta[n] = 1
    for j in range(1, n + 1):
        for size, _, p in edges[:j]:
            alpha[j] += alpha[j - size] * p[:, j - size]
    for i in range(n - 1, -1, -1):
        for size, _, p in edges[: n - i]:
            beta[i] += beta[i + size] * p[:, i]
    out, scale = np.zeros(len(table)), counts / np.maximum(alpha[n], 1e-300)
    for size, numbers, p in edges:
        for i in range(n - size + 1):
            known = numbers[:, i] >= 0
            np.add.at(out, numbers[known, i], (alpha[i] * p[:, i] * beta[i + size] * scale)[known])
    return out


def by_length(words: list[str], limit: int = 20_000):
    """(indices of the words, their matrix) for each length, at most limit / length * 8 words at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, limit * 8 // (n + 1))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            yield part, matrix([words[i] for i in part.tolist()])


def runs(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def parts(text: str) -> list[str]:
    return [x[i : i + WORD] for x in runs(text) for i in range(0, len(x), WORD)]


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n: how often each word stands in the texts of a language. The empty word stands for the language itself."""

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts = {"": 1}
                for w in parts(text or ""):
                    counts[w] = counts.get(w, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()))], names=["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, path: str, rounds: int) -> DataFrame:
    """lang, used (float64 array as bytes): expected uses of every piece after the rounds, each language fitted by a task."""

    def run(key, rows):
        size = len(vocabulary(path)[0])
        at = [i for i, w in enumerate(rows.column("word").to_pylist()) if w]
        words, times = rows.column("word").take(pa.array(at, pa.int64())).to_pylist(), np.asarray(rows.column("n"), float)[at]
        used = np.zeros(size + 1)
        for _ in range(rounds):
            table = np.append((used[:size] + 200 / size) / (used.sum() + 200), 0)[:, None]
            used = np.zeros(size + 1)
            for i, m in by_length(words):
                used += expected(path, m, times[i], table)
        return pa.table({"lang": pa.array([key[0].as_py()]), "used": pa.array([used.tobytes()], pa.binary())})

    return counts.groupBy("lang").applyInArrow(run, "lang string, used binary")


def fit(labelled: DataFrame, path: str, per_language: int = 400, rounds: int = 3, languages: int = 256) -> tuple[list[str], np.ndarray]:
    """(languages, table of piece probabilities). labelled has doc_id, text and lang; at most per_language documents each teach."""
    known = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    chosen = sampled(known.select("doc_id", "lang").distinct(), per_language, 7, "lang", languages).withColumnsRenamed({"doc_id": "_id", "lang": "_lang"})
    # The few chosen ids are broadcast, so their texts are picked out without a shuffle of all texts.
    rows = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = len(vocabulary(path)[0])
    fitted = sorted(piece_counts(word_counts(rows), path, rounds).collect(), key=lambda r: r["lang"])
    if not fitted:
        return [], np.zeros((size + 1, 1))
    used = np.stack([np.frombuffer(r["used"]) for r in fitted], 1)
    total = used.sum(1, keepdims=True)
    shared = (total + 0.1) / (total.sum() + 0.1 * size)
    table = (used + 200 * shared) / (used.sum(0, keepdims=True) + 200)
    table[size] = 0
    return [r["lang"] for r in fitted], table


class Judge:
    """Scores blocks of texts; word likelihoods are remembered for up to `most` distinct words, or `letters` letters of them."""

    def __init__(self, languages, table, path: str, most: int = 400_000, letters: int = 1 << 23):
        self.languages, self.table, self.path, self.most, self.letters = languages, table, path, most, letters
        self.numbers, self.scores, self.held = {}, np.zeros((0, max(1, len(languages)))), 0

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if len(self.numbers) > self.most or self.held > self.letters:
            self.numbers, self.scores, self.held = {}, self.scores[:0], 0
        numbers, rows = self.numbers, []
        for text in texts:
            words = runs(text) if text else []
            rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        new = list(numbers)[len(self.scores) :]
        if new:
            scores = np.zeros((len(new), self.table.shape[1]))
            for at, m in by_length(new):
                scores[at] = forward(self.path, m, self.table)
            self.scores, self.held = np.concatenate([self.scores, scores]), self.held + sum(map(len, new))
        best, score = [], np.zeros(len(texts))
        for i, at in enumerate(rows):
            if not len(at) or not self.languages:
                best.append("und")
                continue
            total = self.scores[at].sum(0)
            k = int(total.argmax())
            best.append(self.languages[k])
            score[i] = 1 / np.exp(total - total[k]).sum()
        return best, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(*sent.value, path)
        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                best, score = judge(texts.slice(s, e - s).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, path: str, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows with a lang that are not held out."""
    held = crc_part("doc_id", 4) == 2
    model = fit(docs.where(~held), path, **sample)
    return identify(docs, model, path).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, least: float = 0.5, **sample) -> DataFrame:
    """The rows of docs whose language is recognised (not `und`, score at least `least`), with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(crc_part("doc_id", 4) != 2), path, **sample))

    def run(batches):
        judge = Judge(*model.value, path)
        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                best, score = judge(texts.slice(s, e - s).to_pylist())
                yield batch.slice(s, e - s).filter(pa.array([b != "und" for b in best]) if least <= 0 else pa.array([b != "und" and x >= least for b, x in zip(best, score.tolist())]))

    return docs.mapInArrow(run, docs.schema)
