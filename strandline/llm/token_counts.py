"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Its tokens' character spans are joined to the spans of its sections (here its lines,
each with the line feed that ends it) by a sorted interval join, and every token goes to exactly one section: the one that
holds most of its characters, the earlier one on a tie. So a document's section counts always add up to its token count.
A token that holds part of a character's bytes spans that whole character.

Defined results: null and empty texts have one empty section with no token; repeated rows give repeated rows; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import Encoder


def line_starts(text: str) -> np.ndarray:
    """Character offsets at which the lines begin; a final line feed begins no further line."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.concatenate(([0], np.flatnonzero(points == 10) + 1))
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(points) else starts


def token_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character (start, end) of tokens of the given byte sizes laid over UTF-8 data."""
    index = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return index[ends - sizes], index[ends - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, length: int) -> np.ndarray:
    """Number of tokens of each section; sections are their sorted starts and cover the text to its length."""
    first, last = np.searchsorted(sections, start, "right") - 1, np.searchsorted(sections, end - 1, "right") - 1
    owner, bounds = first.copy(), np.append(sections, length)
    for i in np.flatnonzero(first != last).tolist():
        held = np.minimum(bounds[first[i] + 1 : last[i] + 2], end[i]) - np.maximum(bounds[first[i] : last[i] + 1], start[i])
        owner[i] = first[i] + int(held.argmax())
    return np.bincount(owner, minlength=len(sections))


def section_token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, section, start, end (code points), n_tokens, doc_tokens: a row for each line of each document."""

    def run(batches):
        encoder = Encoder(path, pattern)
        sizes = np.array([len(t) for t in encoder.m.tokens], np.int64)
        for batch, numbers in encoder.blocks(batches):
            texts = batch.column("text").to_pylist()
            for s in range(0, len(texts), 1024):
                rows, at = [], []
                for i, (text, number) in enumerate(zip(texts[s : s + 1024], numbers[s : s + 1024])):
                    text, ids = text or "", encoder.ids(number)
                    sections = line_starts(text)
                    counts = attribute(*token_spans(text.encode("utf-8"), sizes[ids]), sections, len(text)) if len(ids) else np.zeros(len(sections), np.int64)
                    rows.append((np.arange(len(sections)), sections, np.append(sections[1:], len(text)), counts, np.full(len(sections), len(ids))))
                    at.append(np.full(len(sections), s + i))
                columns = [np.concatenate(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(at))), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, doc_tokens long")
