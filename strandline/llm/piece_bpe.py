"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the leading mark and its spaces become marks; it is cut before each run of marks, and what repeats among the
pieces of a task's documents is encoded once. The distinct pieces of a block become one flat array of symbols, cut further
wherever two neighbouring characters are neighbours in no piece of the vocabulary, as no merge can cross there. In each round
every word's least pair rank is found by a segmented minimum, all its pairs of that rank are merged at once from the left,
and the array is compacted; words without a pair leave. A merge that makes a pair of a lower or the same rank comes first,
and what is right of it in its word waits, as in the library's queue. In words of over LONG characters, the minimum is taken
over the WINDOW symbols on either side instead of the whole word: two pieces' lengths, beyond which no merge of a lower rank
can reach before this one. So a text without spaces takes few rounds too.

Runs of the mark are pieces of equal, least rank in such vocabularies. They are merged last and grow from the left, so a run
is cut into its longest pieces in closed form.

Blocks are independent and bounded, no row is shuffled, and nothing is kept between blocks but a bounded dictionary.

Defined results: a null text counts as empty, which has the begin and end ids alone; strings of control pieces are ordinary
text; characters without a piece become byte pieces; repeated rows give repeated rows; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored. A model that is not BPE with byte fallback, an unchanged text, a leading
mark and marks only at pieces' starts raises ValueError.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import slices

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NEVER = np.int64(1 << 40)
#: Characters beyond which a word is merged by windows, and the bytes of text whose distinct words are encoded at once.
LONG, MEMORY = 256, 12 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(b: bytes):
    """(number, value) of a protocol buffer's fields: integers, or bytes."""
    i = 0

    def number():
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i, v, shift = i + 1, v | (c & 127) << shift, shift + 7
            if c < 128:
                return v

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, b[i : i + n]
            i += n


def _runs(sizes: dict[int, int]) -> list[list[int]]:
    """The pieces of a run of n marks, for n below twice the longest piece: the leftmost pair that makes a piece is merged first."""
    longest, out = max(sizes), []
    for n in range(2 * longest):
        run, i = [1] * n, 0
        while i < len(run) - 1:
            if run[i] + run[i + 1] in sizes:
                run[i : i + 2] = [run[i] + run[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        out.append([sizes[x] for x in run])
    if any(out[n] != out[longest] + out[n - longest] for n in range(longest, 2 * longest)):
        raise ValueError("runs of the mark do not repeat by their longest piece")
    return out


class Keys:
    """Places of 64-bit keys in a fixed set, by a hash table; -1 for any other key."""

    BITS = 20

    def __init__(self, keys):
        keys = np.array(keys, np.int64)
        h = self._hash(keys)
        self.place = np.argsort(h, kind="stable")
        self.keys = np.append(keys[self.place], [-1] * len(keys[:64]))
        h, n = np.unique(h, return_counts=True)
        self.first = np.full(1 << self.BITS, -1, np.int32)
        self.first[h] = np.cumsum(n) - n
        self.most = int(n.max(initial=0))

    def _hash(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        at = self.first[self._hash(keys)]
        maybe = np.flatnonzero(at >= 0)
        at, sought = at[maybe], keys[maybe]
        for i in range(self.most):
            same = np.flatnonzero(self.keys[np.minimum(at + i, len(self.keys) - 1)] == sought)
            out[maybe[same]] = self.place[at[same] + i]
        return out


class Model:
    """Pieces of a model file and the table of all pairs of symbols that make a piece.

    Symbols are the pieces' ids; characters that occur in pieces without being one have numbers from the number of pieces on.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        listed = [dict(_fields(v)) for k, v in parts if k == 1]
        self.pieces = [d[1].decode("utf-8") for d in listed]
        kinds = [d.get(3, NORMAL) for d in listed]
        scores = [struct.unpack("<f", d[2])[0] if 2 in d else 0.0 for d in listed]
        trainer, normalizer = (dict(_fields(next((v for k, v in parts if k == i), b""))) for i in (2, 3))
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        runs = {p: i for p, i in normal.items() if not p.strip(MARK)}
        worst = min(scores[i] for p, i in normal.items() if p not in runs)
        plain = trainer.get(3) == 2 and trainer.get(35) == 1 and not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        starts = all(MARK not in p[1:] for p in normal if p not in runs) and MARK in normal
        even = len({scores[i] for i in runs.values()}) == 1 and all(scores[i] < worst for i in runs.values())
        if not (plain and starts and even and set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} and kinds.count(BYTE) == 256):
            raise ValueError(f"{path}: not a BPE model of the kind that is read here")
        self.unknown = trainer.get(44, " ⁇ ".encode())
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.mark, self.longest, self.run = normal[MARK], max(map(len, runs)), _runs({len(p): i for p, i in runs.items()})
        self.byte = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.surface = [b"" if k == CONTROL else self.unknown if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds)]
        self.leads = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(self.pieces, kinds)])
        self.silent = np.array([k == CONTROL for k in kinds])

        words = [p for p in normal if p not in runs or p == MARK]
        symbols = dict(normal)
        for c in sorted({c for p in words for c in p} - symbols.keys()):
            symbols[c] = len(self.pieces) + len(symbols) - len(normal)
        self.characters = {i: c for c, i in symbols.items() if i >= len(self.pieces)}
        self.of_point = -1 - np.arange(0x110000)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.beside = Keys(sorted({(ord(a) << 32) | ord(b) for p in words for a, b in zip(p, p[1:])}))
        place = {s: n for n, s in enumerate(sorted({-scores[normal[p]] for p in words}))}
        pairs = sorted((symbols[p[:i]] << 32 | symbols[p[i:]], place[-scores[normal[p]]], normal[p]) for p in words for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols)
        keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        self.keys = Keys(keys)
        self.starts = np.cumsum([0, *map(len, self.surface)])
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)
        self.window = 2 * max(map(len, words))

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece made) of each pair of symbols; a negative symbol, like a pair that makes no piece, has rank NEVER."""
        at = self.keys.find(np.where((a >= 0) & (b >= 0), (a << 32) | b, -2))
        return np.where(at >= 0, self.ranks[at], NEVER), self.made[at]


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def _beside(x: np.ndarray, w: int, left: bool) -> np.ndarray:
    """The least of the w values before (left) or after each value."""
    pad = np.full(w, NEVER)
    y, size = np.concatenate((pad, x[:-1]) if left else (x[1:], pad)), 1
    while size < w:
        step = min(size, w - size)
        y, size = np.minimum(y[step:], y[:-step]), size + step
    return y


def _round(m: Model, rank, made, token, starts, counts):
    """Places to merge in this round, all words together; starts, counts: of the words."""
    low = np.minimum.reduceat(rank, starts)
    least = np.repeat(low, counts)
    long = np.flatnonzero(counts > LONG)
    for w in long.tolist():
        s, e = starts[w], starts[w] + counts[w]
        own = rank[s:e]
        least[s:e] = np.minimum(own, np.minimum(_beside(own, m.window, True), _beside(own, m.window, False)))
    hit = (rank == least) & (rank < NEVER)
    at = np.flatnonzero(hit)
    chained = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (rank[at[1:]] == rank[at[:-1]])))
    heads = np.flatnonzero(~chained)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    passed = at[place % 2 == 1]  # of a chain of overlapping pairs every second is left over
    at = at[place % 2 == 0]
    word = np.repeat(np.arange(len(starts)), counts)
    new, r = made[at], rank[at]
    left, right = at - 1, at + 2
    has_left = (left >= 0) & (word[left] == word[at])
    right_in = np.minimum(right, len(token) - 1)
    has_right = (right < len(token)) & (word[right_in] == word[at])
    left_token = np.where(has_left, token[left], -1)
    joined = np.concatenate(([False], at[1:] == at[:-1] + 2)) & has_left
    left_token[joined] = new[np.flatnonzero(joined) - 1]
    sooner = (m.pair(left_token, new)[0] <= r) | (m.pair(new, np.where(has_right, token[right_in], -1))[0] <= r)
    first = np.full(len(starts), len(token))
    soon = at[sooner]
    np.minimum.at(first, word[soon], soon)
    stay = at <= first[word[at]]
    if len(long):
        # Here a place waits for what has its rank in the window before it and is no hit, and for a hit within a window
        # before it that waits or makes a lower pair.
        held = rank.copy()
        held[at] = NEVER
        held[passed] = NEVER
        bounds = np.searchsorted(at, np.stack((starts[long], starts[long] + counts[long])))
        for w, a, b in zip(long.tolist(), *bounds.tolist()):
            s, own = starts[w], at[a:b]
            blocked = _beside(held[s : s + counts[w]], m.window, True)[own - s] <= rank[own]
            far = np.concatenate(([True], own[1:] - own[:-1] > m.window))[: b - a]
            blocked[1:] |= sooner[a : b - 1] & ~far[1:]
            before = np.cumsum(blocked) - blocked
            stay[a:b] = np.cumsum(blocked) == np.repeat(before[far], np.diff(np.append(np.flatnonzero(far), b - a)))
    return at[stay]


def merged(m: Model, token: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols after all merges, the place in `token` of each one's first character); starts: of the words, none empty."""
    place = np.arange(len(token))
    counts = np.diff(np.append(starts, len(token)))
    done_token, done_place = [], []
    inside = np.ones(len(token), bool)
    inside[np.append(starts[1:], len(token)) - 1] = False
    after = np.append(token[1:], -1)
    rank, made = m.pair(token, np.where(inside, after, -1))
    while len(token):
        open_ = np.minimum.reduceat(rank, starts) < NEVER
        if not open_.all():
            keep = np.repeat(open_, counts)
            done_token.append(token[~keep])
            done_place.append(place[~keep])
            token, place, rank, made, counts = token[keep], place[keep], rank[keep], made[keep], counts[open_]
            starts = np.cumsum(counts) - counts
            if not len(token):
                break
        at = _round(m, rank, made, token, starts, counts)
        word = np.repeat(np.arange(len(starts)), counts)
        token[at] = made[at]
        touched, keep = np.zeros(len(token), bool), np.ones(len(token), bool)
        touched[at] = True
        before = at[(at > 0)] - 1
        touched[before] = True
        keep[at + 1] = False
        # A second symbol that goes is no place; its own head, two before, is one already.
        counts = counts - np.bincount(word[at], minlength=len(counts))
        token, place, rank, made, touched, word = token[keep], place[keep], rank[keep], made[keep], touched[keep], word[keep]
        starts = np.cumsum(counts) - counts
        i = np.flatnonzero(touched)
        j = np.minimum(i + 1, len(token) - 1)
        rank[i], made[i] = m.pair(token[i], np.where((j > i) & (word[j] == word[i]), token[j], -1))
    token, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_token, done_place))
    order = np.argsort(place, kind="stable")
    return token[order], place[order]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts of a task; words already met are remembered up to `memory` bytes of them."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.m, self.memory = model(path), memory
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.offsets, self.known, self.held = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0, 0

    def _learn(self, words: list[str]) -> None:
        """Append the ids of words, each a run of marks and what follows it."""
        m = self.m
        bare = [w.lstrip(MARK) for w in words]
        marks = np.array([len(w) - len(b) for w, b in zip(words, bare)])
        texts = [MARK + b if k and b else b for k, b in zip(marks.tolist(), bare)]
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        token = m.of_point[points]
        begins = np.zeros(len(points), bool)
        begins[1:] = m.beside.find((points[:-1] << 32) | points[1:]) < 0
        firsts = np.cumsum(lengths) - lengths
        begins[firsts[lengths > 0]] = True
        token, place = merged(m, token, np.flatnonzero(begins)) if len(token) else (token, points)
        owner = np.repeat(np.arange(len(words)), lengths)[place] if len(token) else np.zeros(0, np.int64)
        # What is no piece becomes bytes.
        plain = (token >= 0) & (token < len(m.pieces))
        sizes = np.ones(len(token), np.int64)
        spelt = {}
        for i in np.flatnonzero(~plain).tolist():
            t = int(token[i])
            spelt[i] = [m.byte[b] for b in (chr(-1 - t) if t < 0 else m.characters[t]).encode("utf-8")]
            sizes[i] = len(spelt[i])
        # A mark that found no partner belongs to the run before it.
        lone = np.zeros(len(words), bool)
        head = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        lone[owner[head & (token == m.mark)]] = True
        sizes[head & (token == m.mark)] = 0
        run = np.where(lengths > 0, np.maximum(marks - 1, 0) + lone, marks)
        whole, part = np.divmod(run, m.longest)
        run_sizes = whole + np.array(list(map(len, m.run)))[part]
        body = np.bincount(owner, sizes, len(words)).astype(np.int64)
        counts = run_sizes + body
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for w in np.flatnonzero(run).tolist():
            s, e = int(ends[w] - counts[w]), int(ends[w] - body[w])
            ids[s : s + whole[w]] = m.run[m.longest]
            ids[s + whole[w] : e] = m.run[part[w]]
        to = np.repeat(ends - body, np.bincount(owner, minlength=len(words)))
        inner = np.cumsum(sizes) - sizes
        if len(owner):
            to += inner - np.repeat(inner[head], np.diff(np.append(np.flatnonzero(head), len(owner))))
        one = plain & (sizes > 0)
        ids[to[one]] = token[one]
        for i, spelling in spelt.items():
            ids[to[i] : to[i] + len(spelling)] = spelling
        self.flat = np.concatenate((self.flat, ids))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + ends))

    def numbered(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words; their ids are known afterwards, until the next call of trimmed()."""
        numbers, get, split = self.numbers, self.numbers.__getitem__, WORDS.findall
        out = [np.array(list(map(get, split(MARK + t.replace(" ", MARK)))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(numbers) > self.known:
            new = list(numbers)[self.known :]
            self._learn(new)
            self.held += sum(map(len, new))
            self.known = len(numbers)
        return out

    def trimmed(self) -> None:
        if self.held > self.memory:
            self.forget()

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a text by its words' numbers, with the begin and end ids, as 32-bit unsigned integers."""
        starts, counts = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        total = int(counts.sum())
        out = np.empty(total + 2, "<u4")
        out[0], out[-1] = self.m.begin, self.m.end
        out[1:-1] = self.flat[np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)]
        return out


def decode_ids(ids, path: str) -> str:
    """The text of ids: control pieces are silent, the first other piece loses its leading mark, a byte that is part of no character is U+FFFD."""
    m = model(path)
    ids = np.asarray(ids, np.int64)
    starts, sizes = m.starts[ids], m.starts[ids + 1] - m.starts[ids]
    text = m.letters[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)].tobytes()
    spoken = ids[~m.silent[ids]]
    return (text[1:] if len(spoken) and m.leads[spoken[0]] else text).decode("utf-8", "each_byte")


def _blocks(batches, encoder: Encoder):
    for batch in batches:
        for s, e in slices(batch.column("text")):
            part = batch.slice(s, e - s)
            yield part, [encoder.ids(x) for x in encoder.numbered(part.column("text").to_pylist())]
            encoder.trimmed()


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, n_tokens (long) and ids (array of int), begin and end ids included."""

    def run(batches):
        for part, ids in _blocks(batches, Encoder(path)):
            for s in range(0, len(ids), 256):
                some = ids[s : s + 256]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in some]))), pa.int32())
                kept = part.slice(s, len(some))
                arrays = [kept.column(c) for c in columns] + [pa.array([len(x) for x in some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(some).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_tokens", "ids"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{fields}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of the column ids; null ids decode to no text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode_ids(x or [], path) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, its ids decoded, and both hashed."""

    def run(batches):
        for part, ids in _blocks(batches, Encoder(path)):
            hashed = lambda x: hashlib.sha256(x).hexdigest()
            written = [hashed(x.tobytes()) for x in ids], [hashed(decode_ids(x, path).encode("utf-8")) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(w, pa.string()) for w in written)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
