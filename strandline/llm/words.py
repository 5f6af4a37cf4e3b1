"""Vectorised word and shingle hashes over an Arrow string array; nothing here loops over words in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, DROP = 0, 1
_rng = np.random.default_rng(20240611)
_CHAR = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 12, dtype=np.uint64)
_POWERS[1:] = np.multiply.accumulate(np.full((1 << 12) - 1, _BASE))


def byte_map(drop_punctuation: bool) -> np.ndarray:
    """Byte to byte: A-Z folded, white space to SPACE, control and (if asked) ASCII punctuation to DROP."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[:32] = DROP
    lut[[9, 10, 11, 12, 13, 32]] = SPACE
    if drop_punctuation:
        lut[[c for c in range(33, 127) if not chr(c).isalnum()]] = DROP
    return lut


FOLDED, PLAIN = byte_map(False), byte_map(True)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hashes: of every word; row: the text a word is in; start, end: its byte offsets in that text's own bytes."""

    def __init__(self, texts: pa.Array, lut: np.ndarray = FOLDED):
        data, offsets = raw(texts)
        chars = lut[data]
        kept = chars != DROP
        at = np.flatnonzero(kept & (chars != SPACE))
        chars = chars[at]
        text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[at]
        if len(at) == 0:
            self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            self.start = self.end = np.zeros(0, np.int64)
            return
        # A word ends where white space lies between two kept bytes, or a text ends; dropped bytes do not split.
        spaces = np.cumsum(lut[data] == SPACE)
        first = np.empty(len(at), bool)
        first[0] = True
        first[1:] = (spaces[at[1:]] != spaces[at[:-1]]) | (text_of[1:] != text_of[:-1])
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(at)))
        place = np.arange(len(at)) - np.repeat(starts, lengths)
        values = _CHAR[chars] * _POWERS[place & 4095] * (np.uint64(1) + (place >> 12).astype(np.uint64))
        self.hashes = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
        self.row = text_of[starts]
        self.start = at[starts] - offsets[self.row]
        self.end = at[np.append(starts[1:], len(at)) - 1] + 1 - offsets[self.row]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of each run's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h += self.hashes[i : i + n] * _STEP[i % 64] + np.uint64(i // 64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return mix(h[at]), at
