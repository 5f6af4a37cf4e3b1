"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of distinct five-word shingles, in powers of two. An item's MinHash sketch is
the s least hashes of its shingles; s is set by its partition's upper size u so that an item contained by CONTAINMENT in a
document must share a sketch entry with it: at most u - ceil(c u) shingles can be missing, so s is one more than that. A
document is a candidate for the items whose sketch it hits; for those the share of the item's shingles that the document
holds is counted exactly. Nothing is missed below that, however long the document.

Documents are scanned once for each block of items and never shuffled. A block holds about block_shingles shingles (an item
is never cut), so what is sent to the executors does not grow with the benchmark.

Words are cut at white space after folding A-Z and deleting ASCII punctuation; a shingle is k words; an item of fewer
words is one shingle of all its words and is looked for at that length. Defined results: null and empty texts, items
without words and rows whose item_id is null match nothing; of rows repeating an item_id, each is an item; a null doc_id
is kept in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import slices, stored

K, CONTAINMENT, BLOCK_SHINGLES = 5, 0.8, 1 << 20
PAIRS = "doc_id long, item_id long, n_shared int, n_shingles int, containment double"


def missing_at_most(n, containment: float):
    return n - np.ceil(np.asarray(n) * containment - 1e-9).astype(np.int64)


def item_shingles(items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, item, width, shingles): distinct shingle hashes of every item, in ascending order; item numbers the row."""

    def run(batches):
        from strandline.llm.words import PLAIN, Words

        for batch in batches:
            ids, texts = batch.column("item_id").to_pylist(), batch.column("text")
            rows = []
            for i, item in enumerate(ids):
                words = Words(texts.slice(i, 1), PLAIN)
                width = min(k, len(words.hashes))
                if item is not None and width:
                    rows.append((item, width, np.unique(words.shingles(width)[0]).view(np.int64).tolist()))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.list_(pa.int64()))], names=["item_id", "width", "shingles"])

    out = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, width int, shingles array<long>")
    return out.withColumn("item", F.monotonically_increasing_id())


class Index:
    """Sketch entries and shingle sets of a block of items of one width."""

    def __init__(self, rows, containment: float):
        self.sizes = np.array([len(r["shingles"]) for r in rows])
        self.ids = np.array([r["item_id"] for r in rows])
        upper = 1 << np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        sketch = np.minimum(missing_at_most(upper, containment) + 1, self.sizes)
        all_of = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        probes = np.concatenate([np.sort(x)[:s] for x, s in zip(all_of, sketch)])
        probe_items = np.repeat(np.arange(len(rows)), sketch)
        order = np.argsort(probes, kind="stable")
        self.probes, self.probe_items = probes[order], probe_items[order]
        self.sets = all_of
        self.distinct = np.unique(self.probes)

    def find(self, shingles: np.ndarray, rows: np.ndarray, containment: float):
        """(row, item number in the block, shared) of the verified pairs."""
        at = np.minimum(np.searchsorted(self.distinct, shingles), len(self.distinct) - 1)
        hit = np.flatnonzero(self.distinct[at] == shingles)
        lo, hi = np.searchsorted(self.probes, shingles[hit], "left"), np.searchsorted(self.probes, shingles[hit], "right")
        n = hi - lo
        items = self.probe_items[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        pairs = np.unique(np.stack((np.repeat(rows[hit], n), items), 1), axis=0) if len(items) else np.zeros((0, 2), np.int64)
        bounds = np.searchsorted(rows, pairs[:, 0], "left"), np.searchsorted(rows, pairs[:, 0], "right")
        for (row, item), s, e in zip(pairs.tolist(), *(b.tolist() for b in bounds)):
            shared = int(np.isin(self.sets[item], shingles[s:e]).sum())
            if shared >= np.ceil(containment * self.sizes[item] - 1e-9):
                yield row, item, shared


def _blocks(items: DataFrame, containment: float, block_shingles: int):
    """Yields broadcast indexes, by width, of blocks of items with about block_shingles shingles each."""
    table = stored(item_shingles(items).withColumn("n", F.size("shingles")))
    total = table.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_shingles)
    for b in range(blocks):
        rows = (table if blocks == 1 else table.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)).select("item_id", "width", "shingles").collect()
        if rows:
            by_width = {w: Index([r for r in rows if r["width"] == w], containment) for w in sorted({r["width"] for r in rows})}
            yield items.sparkSession.sparkContext.broadcast(by_width)


def _found(texts: pa.Array, indexes: dict, containment: float) -> list[tuple[int, int, int, int]]:
    """(row, item_id, shared, size) of every item that a text of the array holds."""
    from strandline.llm.words import PLAIN, Words

    words, found = Words(texts, PLAIN), []
    for width, index in indexes.items():
        shingles, at = words.shingles(width)
        found += [(r, int(index.ids[i]), n, int(index.sizes[i])) for r, i, n in index.find(shingles, words.row[at], containment)]
    return found


def _scan(docs: DataFrame, sent, containment: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for s, e in slices(texts):
                if found := _found(texts.slice(s, e - s), sent.value, containment):
                    r, i, n, m = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids.slice(s).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(np.array(n) / np.array(m))], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PAIRS)


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: every pair in which the document holds the item."""
    out = None
    for sent in _blocks(items, containment, block_shingles):
        part = _scan(docs, sent, containment)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever these and their doc_id are.

    Rows are left out where they are read, one filter for each block of items in a single scan: nothing is joined.
    """

    def clean(sent):
        def run(batches):
            for batch in batches:
                texts = batch.column("text")
                for s, e in slices(texts):
                    kept = np.ones(e - s, bool)
                    kept[[r for r, *_ in _found(texts.slice(s, e - s), sent.value, containment)]] = False
                    yield batch.slice(s, e - s).filter(pa.array(kept))

        return run

    for sent in _blocks(items, containment, block_shingles):
        docs = docs.mapInArrow(clean(sent), docs.schema)
    return docs
