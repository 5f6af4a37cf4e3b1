"""Byte-level BPE encoding and decoding by merge replay over a block's vocabulary.

The regex of the vocabulary splits each text; the distinct pieces of a block of documents (a partition, or as much of it
as memory_bytes allows) become one array of tokens. An inverted index maps each mergeable pair's rank to the positions
where the pair stands. Ranks leave a heap in order; a merge rewrites its positions at once and looks up only the two
pairs it touched, so the cost follows the merges that happen, whatever the number of documents. Documents are then
assembled from their pieces. Blocks are independent and nothing is kept between them but a bounded dictionary, so a lost
executor costs its own partitions and memory does not grow with the corpus.

A pair's rank is that of its joined bytes, and a merge can create a pair of lower rank; such a pair enters the heap and
is replayed first, and later occurrences of the current pair in that piece wait. This is the order of the tiktoken library.

Defined results: a null text counts as empty and has no ids; special-token strings are ordinary text; repeated rows give
repeated rows; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import slices

NEVER = np.int32(1 << 30)
MEMORY = 12 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The ranks of a vocabulary file, and the table of all token pairs whose joined bytes are a token."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(a << 32 | b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        found.sort()
        self.pair_keys, self.pair_ranks = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece)."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        n, last = len(token), np.cumsum(lengths) - 1
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = last[lengths > 0]
        following[ends] = -1
        before[np.concatenate(([0], ends[:-1] + 1)) if n else ends] = -1
        done = np.array(whole, np.int64) >= 0
        rank = np.full(n, NEVER)
        at = np.flatnonzero((following >= 0) & ~done[piece])
        rank[at] = self.pair_rank(token[at], token[at + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        at = at[rank[at] < NEVER]
        if len(at):
            enter(at)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.sort(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[rank[at] == r]
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                overlaps = np.concatenate(([False], following[at[:-1]] == at[1:]))
                if overlaps.any():  # of a chain such as aaaa every second pair is merged, from the left
                    heads = np.flatnonzero(~overlaps)
                    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                    at = at[place % 2 == 0]
            if not len(at):
                continue
            second = following[at]
            third = following[second]
            left = before[at]
            left_token = np.where(left >= 0, token[left], 0)
            if len(at) > 1:
                left_token[1:][left[1:] == second[:-1]] = r
            sooner = (left >= 0) & (self.pair_rank(left_token, np.full(len(at), r)) < r) | (third >= 0) & (self.pair_rank(np.full(len(at), r), token[third]) < r)
            if sooner.any():  # a pair of lower rank arises: what follows it in its piece waits
                of = piece[at]
                first = np.full(len(pieces), n, np.int64)
                np.minimum.at(first, of[sooner], at[sooner])
                wait = at > first[of]
                if wait.any():
                    index[r] = [at[wait]]
                    heapq.heappush(heap, r)
                    at, second, third, left = at[~wait], second[~wait], third[~wait], left[~wait]
            token[at] = r
            following[at] = third
            before[third[third >= 0]] = at[third >= 0]
            alive[second] = False
            rank[second] = NEVER
            touched = np.concatenate((at, left[left >= 0]))
            touched = touched[alive[touched]]
            touched = np.unique(touched)
            after = following[touched]
            rank[touched] = np.where(after >= 0, self.pair_rank(token[touched], token[after]), NEVER)
            touched = touched[rank[touched] < NEVER]
            if len(touched):
                enter(touched)
        firsts = np.concatenate(([0], last + 1))[:-1]
        if done.any():
            alive[done[piece]] = False
            put = firsts[done & (lengths > 0)]
            alive[put], token[put] = True, np.array(whole, np.int32)[done & (lengths > 0)]
        return token[alive], np.bincount(piece[alive], minlength=len(pieces))


@functools.cache
def merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


class _Numbers(dict):
    def __missing__(self, piece):
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes blocks of texts; pieces already replayed are remembered up to `memory` bytes of distinct pieces."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        self.m, self.memory = merges(path, pattern), memory
        self.forget()

    def forget(self) -> None:
        self.numbers, self.known, self.held = _Numbers(), 0, 0
        self.flat, self.offsets, self.written = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def numbered(self, texts: list[str | None]) -> list[np.ndarray]:
        get, split = self.numbers.__getitem__, self.m.split
        out = [np.fromiter(map(get, split(t)), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        if len(self.numbers) > self.known:
            new = [p.encode("utf-8") for p in list(self.numbers)[self.known :]]
            ids, counts = self.m.replay(new)
            self.held += sum(map(len, new))
            self.known = len(self.numbers)
            ends = np.cumsum(counts)
            self.flat = np.concatenate((self.flat, ids))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + ends))
            listed = list(map(str, ids.tolist()))
            self.written += [" ".join(listed[s:e]) for s, e in zip((ends - counts).tolist(), ends.tolist())]
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        starts, counts = self.offsets[numbers], self.offsets[numbers + np.uint32(1)] - self.offsets[numbers]
        total = int(counts.sum())
        return self.flat[np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)]

    def text_of(self, numbers: np.ndarray) -> str:
        return " ".join(map(self.written.__getitem__, numbers.tolist()))

    def blocks(self, batches):
        """(record batch, its texts' piece numbers), a block of batches at a time."""
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                part = batch.slice(s, e - s)
                held.append(part)
                size += part.column("text").nbytes
                if size > 2 * self.memory:
                    yield from self._block(held)
                    held, size = [], 0
        if held:
            yield from self._block(held)

    def _block(self, held):
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in whole:
            yield batch, self.numbered(batch.column("text").to_pylist())
        if self.held > self.memory:
            self.forget()


def decode_ids(ids, path: str, pattern: str = "") -> bytes:
    return b"".join(map(merges(path, pattern).tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, n_tokens (long) and ids (array of int)."""

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch, numbers in encoder.blocks(batches):
            for s in range(0, len(numbers), 256):
                ids = [encoder.ids(x) for x in numbers[s : s + 256]]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                part = batch.slice(s, len(ids))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=[*columns, "n_tokens", "ids"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{fields}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of the column ids; null ids decode to no bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode_ids(x or [], path, "(?s).+") for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, its ids decoded, and both hashed."""

    def run(batches):
        encoder = Encoder(path, pattern)
        token = encoder.m.tokens.__getitem__
        for batch, numbers in encoder.blocks(batches):
            rows = []
            for x in numbers:
                ids = encoder.ids(x).tolist()
                rows.append((len(ids), hashlib.sha256(encoder.text_of(x).encode()).hexdigest(), hashlib.sha256(b"".join(map(token, ids))).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
