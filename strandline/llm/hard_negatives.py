"""Hard negatives: for each anchor and positive the best rows of other labels whose score lies in a window below the positive's.

Rows are indexed by product quantisation: pairs of components, 256 integer entries for each pair, fitted on a bounded sample
of SAMPLE rows (any entries would do: they decide only how tight the bounds are), and with each row's codes the norm of what
the codes leave over. A score is then the sum of the anchor's table entries for the row's codes, plus or minus the anchor's
norm times that rest, by Cauchy and Schwarz. Rows whose interval cannot reach a window, or cannot pass its tenth best row so
far, are left out; all others are scored again exactly in integers, and only these scores decide. So the result is that of
brute force.

Anchors (vec_id divisible by EVERY) go out in blocks of about BLOCK; the index is scanned twice for each, once for positives
and once for the windows, and never shuffled. A task keeps the few best rows of each anchor or window, so its memory follows
the block and not the table; what tasks found is ranked by one window function. Blocks' results are written one by one.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. A vector
shorter than another counts as ending in zeros. Rows that repeat a vec_id are rows for themselves: each can be the positive or
negative of any other, and of an anchor that is repeated each row is an anchor. A positive with a negative score has an empty
window. An empty table gives an empty result. Components of 2^20 and more raise ValueError: scores would not fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import appended, stored
from strandline.llm.vectors import finite, integers, longest

SCALE, LIMIT, EVERY, POSITIVES, NEGATIVES = 256, 1 << 28, 100, 5, 10
LOW, HIGH = 30, 90
#: Components of a part, entries of a part, rows that the entries are fitted on, rounds of fitting.
STEP, ENTRIES, SAMPLE, ROUNDS = 2, 256, 2048, 6
#: Anchors that go out at once, and of them those whose tables a task holds at once.
BLOCK, AT_ONCE = 4096, 128
NEVER = np.iinfo(np.int64).min
PAIRS = 1 << 16


def cleaned(df: DataFrame, column: str) -> DataFrame:
    """vec_id, label (moved where vec_id is divisible by 7) and vector x of the rows that take part."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(column).alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("x")).withColumn("label", label)


def fitted(x: np.ndarray) -> np.ndarray:
    """(parts, entries, STEP) integer entries from sample rows x."""
    books = []
    for p in range(0, x.shape[1], STEP):
        own = x[:, p : p + STEP].astype(np.float64)
        book = np.unique(own, axis=0)
        book = book[np.linspace(0, len(book) - 1, ENTRIES).astype(int)] if len(book) > ENTRIES else book
        for _ in range(ROUNDS if len(book) == ENTRIES else 0):
            code = ((book * book).sum(1) - 2 * own @ book.T).argmin(1)
            n = np.bincount(code, minlength=ENTRIES)
            sums = np.stack([np.bincount(code, own[:, i], ENTRIES) for i in range(STEP)], 1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(np.resize(np.rint(book), (ENTRIES, STEP)))
    return np.stack(books).astype(np.int64)


def indexed(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(stored table of vec_id, label, v: the integers as 32-bit little-endian, codes, rest: norm of v less its codes; entries)."""
    n = rows.count()
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.where(h < int(min(1.0, 4 * SAMPLE / max(1, n)) * (1 << 30))).orderBy(h, "vec_id", "x").limit(SAMPLE).select("x").toArrow().combine_chunks()
    books = fitted(integers(sample.column("x").combine_chunks(), SCALE, width, LIMIT))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                x = integers(part.column("x"), SCALE, width, LIMIT)
                codes, left = np.zeros((len(x), len(books)), np.uint8), x.copy()
                for p, book in enumerate(books.astype(np.float32)):
                    own = x[:, p * STEP : (p + 1) * STEP]
                    codes[:, p] = ((book * book).sum(1) - 2 * own.astype(np.float32) @ book.T).argmin(1)
                    left[:, p * STEP : (p + 1) * STEP] -= books[p][codes[:, p]]
                rest = np.sqrt((left.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
                v = x.astype("<i4")
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], names=["vec_id", "label", "v", "codes", "rest"])

    return stored(rows.mapInArrow(run, "vec_id long, label long, v binary, codes binary, rest double")), books


class Anchors:
    """A block of anchors: ids, labels, integer vectors a and their norms; bounds() by table lookup, scores() exactly."""

    def __init__(self, ids, labels, a: np.ndarray, books: np.ndarray):
        self.ids, self.labels, self.a, self.books = ids, labels, a, books
        self.norm = np.sqrt((a.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        most = int(np.abs(a).max(initial=0)) * max(1, int(np.abs(books).max(initial=0))) * max(1, a.shape[1])
        self.kind = np.int32 if most < 1 << 30 else np.int64

    def bounds(self, codes: np.ndarray, rest: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) that the scores of rows (codes, rest) with the anchors `which` can be."""
        score = np.zeros((len(codes), len(which)), self.kind)
        held = np.empty_like(score)
        for p, book in enumerate(self.books):
            table = (book @ self.a[which, p * STEP : (p + 1) * STEP].T).astype(self.kind)
            score += np.take(table, codes[:, p], axis=0, out=held, mode="clip")
        slack = np.ceil(np.outer(rest, self.norm[which]) * (1 + 1e-9)) + 1
        return score - slack, score + slack

    def scores(self, v: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for s in range(0, len(row), PAIRS):
            out[s : s + PAIRS] = np.einsum("ij,ij->i", v[row[s : s + PAIRS]], self.a[anchor[s : s + PAIRS]])
        return out


class Best:
    """The `most` best (score, id) of each of n groups, and the least score a further row needs to enter."""

    def __init__(self, n: int, most: int):
        self.most, self.need = most, np.full(n, NEVER)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(group):
            return
        group, score, id_ = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, group))
        group, score, id_ = group[order], score[order], id_[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        last = place == self.most - 1
        self.need[group[last]] = score[last]
        stay = place < self.most
        self.group, self.score, self.id = group[stay], score[stay], id_[stay]


def _rows(batches, width: int):
    """(vec_id, label, v, codes, rest) in runs that grow from 256 rows, so that early rows make later bounds tight."""
    size = 256
    for batch in batches:
        s = 0
        while s < batch.num_rows:
            part = batch.slice(s, size)
            s, size = s + size, min(2 * size, 4096)
            cells = lambda c, kind, part=part: np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1)
            yield np.asarray(part.column("vec_id")), np.asarray(part.column("label")), cells("v", "<i4").astype(np.int64), cells("codes", np.uint8), np.asarray(part.column("rest"))


def positives(index: DataFrame, anchors, width: int) -> DataFrame:
    """(anchor: place in the block, score, id): of each anchor the POSITIVES + 1 best rows of its label in each task, itself one of them."""
    most = POSITIVES + 1

    def run(batches):
        block: Anchors = anchors.value
        best = Best(len(block.ids), most)
        for ids, labels, v, codes, rest in _rows(batches, width):
            found = []
            for label in np.unique(labels[np.isin(labels, block.labels)]):
                rows, own = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
                for s in range(0, len(own), AT_ONCE):
                    which = own[s : s + AT_ONCE]
                    low, high = block.bounds(codes[rows], rest[rows], which)
                    need = best.need[which].astype(np.float64)
                    if len(rows) >= most:
                        need = np.maximum(need, np.partition(low, len(rows) - most, axis=0)[len(rows) - most])
                    r, a = np.nonzero(high >= need)
                    found.append((which[a], block.scores(v, rows[r], which[a]), ids[rows[r]]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found)))
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(best.group, pa.int32()), "score": best.score, "id": best.id})

    found = index.mapInArrow(run, "anchor int, score long, id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def negatives(index: DataFrame, anchors, chosen, width: int) -> DataFrame:
    """chosen: (anchors, POSITIVES) arrays of positive ids and scores, and how many each anchor has. Returns the result's columns."""

    def run(batches):
        block: Anchors = anchors.value
        pid, score, n = chosen.value
        there = np.arange(POSITIVES) < n[:, None]
        low = np.where(there, -(-LOW * score // 100), np.iinfo(np.int64).max)
        high = np.where(there, HIGH * score // 100, NEVER)
        best = Best(score.size, NEGATIVES)
        asked = np.flatnonzero((low <= high).any(1))
        for ids, labels, v, codes, rest in _rows(batches, width):
            found = []
            need = np.maximum(low, best.need.reshape(score.shape))
            need[low > high] = np.iinfo(np.int64).max
            least, top = need.min(1), np.where(low <= high, high, NEVER).max(1)
            for s in range(0, len(asked), AT_ONCE):
                which = asked[s : s + AT_ONCE]
                down, up = block.bounds(codes, rest, which)
                r, a = np.nonzero((up >= least[which]) & (down <= top[which]) & (labels[:, None] != block.labels[which]))
                down, up, a = down[r, a], up[r, a], which[a]
                fits = ((up[:, None] >= need[a]) & (down[:, None] <= high[a])).any(1)
                r, a = r[fits], a[fits]
                exact = block.scores(v, r, a)
                pair, w = np.nonzero((exact[:, None] >= need[a]) & (exact[:, None] <= high[a]))
                found.append((a[pair] * POSITIVES + w, exact[pair], ids[r[pair]]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found)))
        a, w = np.divmod(best.group, POSITIVES)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(a, pa.int32()), "place": pa.array(w, pa.int32()), "anchor_id": block.ids[a], "positive_id": pid[a, w], "negative_id": best.id, "positive_score": score[a, w], "negative_score": best.score})

    found = index.mapInArrow(run, "anchor int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _chosen(block: Anchors, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the best rows of each anchor's label (at most POSITIVES + 1 rows an anchor) those that are not the anchor itself."""
    n = len(block.ids)
    pid, score, count, itself = np.zeros((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    own = (block.a * block.a).sum(1)
    for r in sorted(found, key=lambda r: (r["anchor"], r["place"])):
        a = r["anchor"]
        if not itself[a] and r["id"] == block.ids[a] and r["score"] == own[a]:
            itself[a] = True
        elif count[a] < POSITIVES:
            pid[a, count[a]], score[a, count[a]] = r["id"], r["score"]
            count[a] += 1
    return pid, score, count


def hard_negatives(df: DataFrame, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    rows = cleaned(df, column)
    width = -(-longest(rows, "x") // STEP) * STEP
    if not width:  # no row takes part, or none has a component: then all scores are 0, as those of one zero are
        width = STEP
    index, books = indexed(rows, width)
    queries = stored(index.where(F.col("vec_id") % EVERY == 0).select("vec_id", "label", "v"))
    n = queries.count()
    blocks = 1 if n <= block else math.ceil(2 * n / block)

    def results():
        for b in range(blocks):
            t = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            a = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i4").reshape(t.num_rows, width).astype(np.int64)
            own = Anchors(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), a, books)
            sent = spark.sparkContext.broadcast(own)
            chosen = spark.sparkContext.broadcast(_chosen(own, positives(index, sent, width).collect()))
            yield negatives(index, sent, chosen, width)
            sent.unpersist()
            chosen.unpersist()

    return appended(spark, results())
