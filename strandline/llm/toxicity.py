"""Toxicity by noisy-channel deobfuscation: Viterbi over character lattices, then a linear score of the restored text.

A character trigram model is counted over every document of the table. A token that may be disguised (letters mixed with
digits or symbols, symbols that imitate letters, a letter three or more times running) becomes a lattice: each symbol may
stand for the letters it imitates or for nothing, each repeated letter for one or two. A run of single characters becomes a
lattice in which every gap may be the end of a word or nothing. The Viterbi path under the trigram model and the channel's
costs is the restored text; other words stand for themselves. Symbols at a token's rim are read both as marks and as
letters. Where two neighbouring words make up a word of the classifier, they are joined if the channel finds that likelier.

The classifier is a logistic regression over restored words and the first PREFIX letters of longer ones, learnt from at most
`sample` labelled rows (the least by a hash of doc_id) and at most `features` words, those whose counts differ most between
the labels.

Defined results: null and empty texts score as a text without known words; digits with less than two imitating symbols and
no letter are a number, not a disguise; labels that are null or whose document is missing teach nothing, a document labelled
twice teaches twice, and of rows that repeat a doc_id the text with the least hash teaches; without labels every score is 0;
repeated rows give repeated rows; a null doc_id is scored and is in the held-out part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import crc_part, sampled, slices, stored

#: Letters that a digit or symbol is commonly written for.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x"}
EDGE, OTHER, SIZE = 26, 27, 28
SPACED = re.compile(r"(?<![^\s])(?:[^\s][ \t]){2,}[^\s](?![^\s])")
JOINED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*~]){2,}[^\W_](?![^\W_])")
GAPS = re.compile(r"[ \t.\-_*~]+")
#: A mark three times or more at a rim adorns a word and stands for no letter.
ADORNED = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
PLAIN = re.compile(r"[^\W\d_]+")
THRICE = re.compile(r"(.)\1\1")
EDGES = ".,;:!?\"'()[]{}<>*#%&$~-_=/\\|@+"
#: Marks that may stand before or behind a word; an imitating symbol there is read as a letter too.
BEHIND = "".join(c for c in EDGES if c not in IMITATES or c in "!*#%")
BEFORE = "".join(c for c in BEHIND if c not in IMITATES)
LETTER, SYMBOL = re.compile(r"[^\W\d_]"), re.compile("[" + re.escape("".join(c for c in IMITATES if not c.isdigit())) + "]")
RIM = re.compile(f"^{SYMBOL.pattern}|[{re.escape(''.join(c for c in IMITATES if not c.isdigit() and c not in BEHIND))}]$")
SUBSTITUTED, DELETED, COLLAPSED, UNDOUBLED, CLOSED, UNSPACED = -1.0, -8.0, -0.5, -6.0, -0.5, -3.0
PREFIX = 5


def _codes(data: np.ndarray) -> np.ndarray:
    lut = np.full(256, EDGE, np.uint8)
    lut[97:123] = np.arange(26)
    lut[65:91] = np.arange(26)
    lut[128:] = OTHER
    return lut[data]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """(28, 28, 28) counts over all texts of docs: 26 letters, the edge of a word, any other letter. Partial sums by task."""

    def run(batches):
        from strandline.llm.words import raw

        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for s, e in slices(batch.column("text")):
                data, offsets = raw(batch.column("text").slice(s, e - s))
                codes = np.concatenate((_codes(data), [EDGE, EDGE, EDGE])).astype(np.int32)
                total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others, interpolated with shorter contexts."""
    uni = (counts.sum((0, 1)) + 1) / (counts.sum() + SIZE)
    two = counts.sum(0)
    bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * bi[None]) / (counts.sum(2, keepdims=True) + 5))


def lattice(token: str, gaps: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of the token the strings it may stand for, and the channel's log costs.

    With gaps, white space and joining marks may be nothing or the space between two words.
    """
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if gaps and GAPS.fullmatch(c):
            out.append([(" ", 0.0), ("", CLOSED)])
        elif c.isalpha():
            out.append([(c * n, 0.0)] if n == 1 else [(c, COLLAPSED if n > 2 else UNDOUBLED), (c * 2, COLLAPSED * (n > 2))])
        else:
            may = [(x * k, SUBSTITUTED - math.log(len(IMITATES[c])) - (k > 1)) for x in IMITATES.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
            out.append([*may, ("", DELETED if may else -0.5)])
    return out


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else EDGE if c == " " else OTHER


class Channel:
    """Restores words under a trigram model; remembers up to `most` tokens of up to 64 characters."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    def restore(self, token: str, gaps: bool = False) -> str:
        """The best path through the token's lattice: state is the last two characters."""
        score, best = self.model, {(EDGE, EDGE): (0.0, None)}
        for options in lattice(token, gaps):
            after: dict = {}
            for (a, b), (v, path) in best.items():
                for text, cost in options:
                    x, y, total = a, b, v + cost
                    for ch in text:
                        z = _code(ch)
                        total += score[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < total:
                        after[x, y] = (total, (path, text) if text else path)
            best = after
        _, path = max(((v + score[a][b][EDGE], path) for (a, b), (v, path) in best.items()), key=lambda t: t[0])
        found = []
        while path:
            path, text = path
            found.append(text)
        return "".join(reversed(found))

    def likelihood(self, text: str) -> float:
        codes, total = [EDGE, EDGE, *map(_code, text), EDGE], 0.0
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += self.model[a][b][c]
        return total

    def readings(self, token: str) -> tuple[str, ...]:
        """The restored forms of a lower-cased token: with the symbols at its rim as marks and, if they imitate, as letters."""
        core = token.strip(EDGES)
        if core.isalpha() and not THRICE.search(core) and (core == token or not RIM.search(token)):
            return (core,)
        token = ADORNED.sub("", token)
        out = []
        for form in dict.fromkeys((token.strip(EDGES), token.rstrip(BEHIND).lstrip(BEFORE))):
            if PLAIN.fullmatch(form) and not THRICE.search(form):
                out.append(form)
            elif LETTER.search(form) or len(SYMBOL.findall(form)) > 1:
                out.append(self.restore(form))
        return tuple(x for x in dict.fromkeys(out) if x)

    def word(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            got = self.readings(token)
            if len(token) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = got
        return got

    def words(self, text: str | None, lexicon: Lexicon | None = None) -> set[str]:
        """The distinct restored words of a text, and the first letters of the longer ones with a mark behind."""
        text = (text or "").lower()
        tokens = text.split()
        out = {x for token in set(tokens) for x in self.word(token)}
        for form in (SPACED, JOINED):
            for m in form.finditer(text):
                out.update(self.restore(m[0], True).split())
        if lexicon:
            out.update(self.joined(tokens, lexicon))
        return out | {x[:PREFIX] + "~" for x in out if len(x) > PREFIX}

    def joined(self, tokens: list[str], lexicon: Lexicon):
        """Words of the lexicon that two neighbouring tokens make up, where that is likelier than the two."""
        for i in [i for i, t in enumerate(tokens[:-1]) if t in lexicon.heads]:
            left, right = tokens[i], tokens[i + 1].rstrip(EDGES)
            if left + right in lexicon.words and self.likelihood(left + right) + UNSPACED > self.likelihood(f"{left} {right}"):
                yield left + right


class Lexicon:
    """Words, and all that they may begin with."""

    def __init__(self, words):
        self.words = {w for w in words if w.isalpha()}
        self.heads = {w[:i] for w in self.words for i in range(1, len(w))}


def word_table(docs: DataFrame, model, extra: tuple[str, ...] = ()) -> DataFrame:
    """The extra columns and words (array): the distinct restored words of each text."""

    def run(batches):
        channel = Channel(model.value)
        for batch in batches:
            for s, e in slices(batch.column("text")):
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array([sorted(channel.words(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))], names=[*extra, "words"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return docs.select(*extra, "text").mapInArrow(run, f"{fields}words array<string>")


def fit(docs: DataFrame, labels: DataFrame, model, sample: int = 20_000, features: int = 1000, rounds: int = 300) -> tuple[dict[str, float], float]:
    """(weight of each word, bias)."""
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y is not null and doc_id is not null")
    y = sampled(y, sample, 11).withColumnRenamed("doc_id", "_id")
    # At most `sample` ids are broadcast, so the texts are not shuffled to pick a few of them.
    rows = docs.select("doc_id", "text").join(F.broadcast(y.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    # One text for each id, so that no id, however often it is repeated, makes the sample larger.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(y), F.col("doc_id") == F.col("_id")).select("y", "text")
    # Stored, because row numbers must not be given twice and every text is restored once.
    table = stored(word_table(rows, model, ("y",)).select(F.monotonically_increasing_id().alias("row"), "y", "words"))
    total = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(n for k, n in total.items() if k >= 1), sum(n for k, n in total.items() if k < 1)
    if not n1 or not n0:
        return {}, -40.0 if not n1 else 40.0
    seen = table.select(F.explode("words").alias("w"), "y").groupBy("w").agg(F.sum(F.expr("if(y >= 1, 1, 0)")).alias("a"), F.sum(F.expr("if(y >= 1, 0, 1)")).alias("b")).where("a + b >= 5")
    share = n1 / (n1 + n0)
    z = F.expr(f"(a - (a + b) * {share}D) / sqrt((a + b) * {share * (1 - share)}D)")
    chosen = [r["w"] for r in seen.orderBy(F.abs(z).desc(), "w").limit(features).select("w").collect()]
    number = {w: i for i, w in enumerate(chosen)}
    listed = F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")
    data = table.select("row", "y", F.array_intersect("words", listed).alias("w")).orderBy("row").collect()
    at = np.array([(i, number[w]) for i, r in enumerate(data) for w in r["w"]], np.int64).reshape(-1, 2)
    goal = np.array([r["y"] >= 1 for r in data], float)
    weight, bias, n = np.zeros(len(chosen)), math.log(n1 / n0), len(data)
    moment, power = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, rounds + 1):  # Adam on the mean log loss with an L2 term
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(at[:, 0], weight[at[:, 1]], n), -40, 40)))
        g = np.append(np.bincount(at[:, 1], (p - goal)[at[:, 0]], len(chosen)) / n + 2e-4 * weight, (p - goal).mean())
        moment, power = 0.9 * moment + 0.1 * g, 0.999 * power + 0.001 * g * g
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return {w: float(weight[i]) for w, i in number.items()}, float(bias)


def score(docs: DataFrame, model, weights: tuple[dict[str, float], float]) -> DataFrame:
    """doc_id and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        channel, (weight, bias) = Channel(model.value), sent.value
        lexicon = Lexicon(w for w, x in weight.items() if x > 0)
        for batch in batches:
            for s, e in slices(batch.column("text")):
                part = batch.slice(s, e - s)
                z = np.array([bias + sum(weight[w] for w in channel.words(t, lexicon) & weight.keys()) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels are learnt only from rows that are not held out."""
    held = crc_part("doc_id", 5) == 0
    model = docs.sparkSession.sparkContext.broadcast(log_model(trigram_counts(docs)))
    weights = fit(docs, labels.where(~held), model, **options)
    return score(docs, model, weights).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
