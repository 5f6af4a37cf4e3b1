"""Nucleotide lift: position maps as runs, and whole-genome alignment by minimizers and chains.

An alignment is its runs: (r, q, n) says that n bases from r of the reference face n bases from q of the query. A feature's
place on a query is a range join with the runs and a sum of overlaps; no row stands for a base.

Genomes are aligned by minimizers that both have. Anchors of a record and strand are chained by the dynamic programme over
all pairs within MOST_GAP, a record's best chain is its primary alignment, and the stretches between a chain's anchors are
bridged with the one gap that leaves most bases equal. Records without a chain under one preset go on to the next, coarser one.
The reference is one genome: what is broadcast of it is counted first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.intervals import overlap_join
from strandline.functions.lineage import settled

#: Name, bases of a word, words of a window: tried in this order.
PRESETS = (("asm5", 19, 19), ("asm10", 15, 10), ("asm20", 11, 5))
#: A chain's least score, the bases between two anchors of a chain, and the cost of a shift: one and one more for each so many bases.
LEAST, MOST_GAP, SHIFT = 60, 5000, 8
#: Parameters of the word hash.
FACTOR, ADD, PRIME = 1_103_515, 12_345, (1 << 31) - 1
MOST_MINIMIZERS, MOST_FEATURES = 1_000_000, 100_000
#: How far the count of equal bases less two for each other may fall below its best where an alignment's end is extended.
DROP = 20

RUNS = "array<struct<r:int,q:int,n:int>>"


def cigar_runs(alignments: DataFrame) -> DataFrame:
    """(record_id, r, q, n): the runs of aligned bases of each alignment (record_id, ref_start, cigar), from 1 on both sides.

    A window over an alignment's operations sums up how far each has come; nothing is unfolded further than to operations.
    """
    step = F.regexp_extract_all("cigar", F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    ops = alignments.select("record_id", "ref_start", F.posexplode(step).alias("i", "op"))
    n, kind = F.expr("cast(substring(op, 1, length(op) - 1) as int)"), F.right("op", F.lit(1))
    ops = ops.withColumns({"n": n, "kind": kind})
    run = F.col("kind").isin("M", "=", "X")
    before = Window.partitionBy("record_id", "ref_start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    far = lambda kinds: F.coalesce(F.sum(F.when(run | F.col("kind").isin(*kinds), F.col("n")).otherwise(0)).over(before), F.lit(0))
    rows = ops.withColumns({"r": (F.col("ref_start") + far(("D", "N"))).cast("int"), "q": (1 + far(("I", "S"))).cast("int")})
    return rows.where(run & (F.col("n") > 0)).select("record_id", "r", "q", "n")


def position_map(runs: DataFrame) -> DataFrame:
    """(record_id, ref_pos, query_pos): a row for each base of the runs; for looking at, the lift goes by the runs."""
    rows = runs.select("record_id", "r", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("record_id", (F.col("r") + F.col("i")).alias("ref_pos"), (F.col("q") + F.col("i")).alias("query_pos"))


def lifted_by_runs(features: DataFrame, runs: DataFrame) -> DataFrame:
    """record_id, name, start, end, query_start, query_end, coverage: features (name, start, end) where they meet a record's runs.

    The span is that of the bases that map, and coverage their share of the feature.
    """
    small = features.limit(MOST_FEATURES + 1).count() <= MOST_FEATURES
    rows = runs.withColumn("r_end", F.col("r") + F.col("n") - 1)
    met = overlap_join(rows, F.broadcast(features.select("name", "start", "end")) if small else features.select("name", "start", "end"), [], ("r", "r_end"), ("start", "end"))
    low, high = F.greatest("start", "r"), F.least("end", "r_end")
    shift = F.col("q") - F.col("r")
    one = met.groupBy("record_id", "name", "start", "end").agg(F.min(low + shift).alias("query_start"), F.max(high + shift).alias("query_end"), F.sum(high - low + 1).alias("n"))
    return one.withColumn("coverage", F.col("n") / (F.col("end") - F.col("start") + 1)).drop("n")


_BASE = np.full(256, 4, np.int64)
_BASE[[ord(x) for x in "ACGTUacgtu"]] = [0, 1, 2, 3, 3] * 2


def _minimizers(seq: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place from 0, whether the reverse complement is the lesser, hash) of each word that is the least, the first of equals, of some w."""
    b = _BASE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(b) - k + 1
    if n < w:
        return (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    ahead, back, plain = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        x = b[i : i + n]
        plain &= x < 4
        ahead = ahead * 4 + (x & 3)
        back += (3 - (x & 3)) << (2 * i)
    h = (np.minimum(ahead, back) * FACTOR + ADD) % PRIME
    h[~plain | (ahead == back)] = PRIME
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    at = at[h[at] < PRIME]
    return at, (back < ahead)[at], h[at]


def minimizers(records: DataFrame, k: int, w: int) -> DataFrame:
    """(record_id, size, pos, turned, hash) of records (record_id, seq): the word of k bases with the least hash of every w.

    A word and its reverse complement have one hash; turned says which of them stands there. Words with other letters than
    bases, or that are their own reverse complement, are none. pos counts from 0.
    """

    def run(batches):
        for batch in batches:
            for i, seq in enumerate(batch.column("seq").to_pylist()):
                at, turned, h = _minimizers(seq, k, w)
                yield pa.RecordBatch.from_arrays([batch.column("record_id").take(pa.array(np.full(len(at), i))), pa.array(np.full(len(at), len(seq)), pa.int32()), pa.array(at, pa.int32()), pa.array(turned), pa.array(h)], names=["record_id", "size", "pos", "turned", "hash"])

    return records.where("seq is not null").select("record_id", "seq").mapInArrow(run, "record_id string, size int, pos int, turned boolean, hash long")


def anchors(records: DataFrame, genome: DataFrame, k: int, w: int) -> DataFrame:
    """(record_id, strand, r, q): places where a record and the genome (one row: seq) share a minimizer, from 0; q is counted on the strand."""
    mine = settled(minimizers(genome.select(F.lit("").alias("record_id"), "seq"), k, w).select(F.col("pos").alias("r"), F.col("turned").alias("t"), "hash"))
    small = mine.limit(MOST_MINIMIZERS + 1).count() <= MOST_MINIMIZERS
    met = minimizers(records, k, w).join(F.broadcast(mine) if small else mine, "hash")
    same = F.col("turned") == F.col("t")
    return met.select("record_id", F.when(same, "+").otherwise("-").alias("strand"), "r", F.when(same, F.col("pos")).otherwise(F.col("size") - k - F.col("pos")).alias("q"))


def _chain(r: np.ndarray, q: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """(score, indices) of the best chain of anchors in ascending (r, q): k for the first, then what each adds less the cost of its shift.

    Of equal predecessors the first counts, of equal chains the one that ends first.
    """
    score, before = np.full(len(r), k), np.full(len(r), -1)
    first = np.searchsorted(r, r - MOST_GAP, "left")
    for i in range(1, len(r)):
        a = slice(first[i], i)
        dr, dq = r[i] - r[a], q[i] - q[a]
        shift = np.abs(dr - dq)
        gain = score[a] + np.minimum(np.minimum(dr, dq), k) - np.where(shift > 0, 1 + shift // SHIFT, 0)
        gain[(dr <= 0) | (dq <= 0) | (dq > MOST_GAP)] = -1
        if len(gain) and gain.max() > k:
            best = int(gain.argmax())
            score[i], before[i] = gain[best], first[i] + best
    at, out = int(score.argmax()), []
    top = int(score[at])
    while at >= 0:
        out.append(at)
        at = before[at]
    return top, np.array(out[::-1])


def chains(found: DataFrame, k: int) -> DataFrame:
    """(record_id, strand, score, r, q): the best chain of each record and strand, its anchors as arrays."""

    def run(batches):
        for batch in batches:
            found = []
            for rs, qs in zip(batch.column("r").to_pylist(), batch.column("q").to_pylist()):
                score, at = _chain(np.array(rs), np.array(qs), k)
                found.append((score, np.array(rs)[at].tolist(), np.array(qs)[at].tolist()))
            arrays = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("strand"), *arrays], names=["record_id", "strand", "score", "r", "q"])

    # The anchors of one record and strand, a few for each hundred of its bases, are one row.
    points = F.array_sort(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), F.col("q").cast("int").alias("q"))))
    rows = found.groupBy("record_id", "strand").agg(points.alias("x")).select("record_id", "strand", "x.r", "x.q")
    return rows.mapInArrow(run, "record_id string, strand string, score int, r array<int>, q array<int>")


def primary(chained: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each record the chain with the best score, at least `least`; + before -."""
    by = Window.partitionBy("record_id").orderBy(F.desc("score"), "strand")
    return chained.where(F.col("score") >= least).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _reach(same: np.ndarray) -> int:
    """How many places from the first on are best taken, one for an equal base and minus two for another."""
    total = np.cumsum(np.where(same, 1, -2))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > DROP)
    total = total[: stop[0]] if len(stop) else total
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def _bridged(ref: np.ndarray, seq: np.ndarray, r: list[int], q: list[int], k: int) -> list[tuple[int, int, int]]:
    """Runs (r, q, n) from 1 of a chain's anchors: ends extended, shifts between two anchors put where most bases are equal."""
    back = min(r[0], q[0])
    left = _reach((ref[r[0] - back : r[0]] == seq[q[0] - back : q[0]])[::-1])
    runs, begin = [], (r[0] - left, q[0] - left)
    for (r1, q1), (r2, q2) in zip(zip(r, q), zip(r[1:], q[1:])):
        if r2 - r1 == q2 - q1:
            continue
        m = min(r2 - r1, q2 - q1)
        before, after = ref[r1 : r1 + m] == seq[q1 : q1 + m], ref[r2 - m : r2] == seq[q2 - m : q2]
        t = int((np.concatenate(([0], np.cumsum(before))) + after.sum() - np.concatenate(([0], np.cumsum(after)))).argmax())
        runs.append((*begin, r1 + t - begin[0]))
        begin = (r2 - m + t, q2 - m + t)
    end_r, end_q = r[-1] + k, q[-1] + k
    ahead = min(len(ref) - end_r, len(seq) - end_q)
    right = _reach(ref[end_r : end_r + ahead] == seq[end_q : end_q + ahead])
    runs.append((*begin, end_r + right - begin[0]))
    return [(a + 1, b + 1, n) for a, b, n in runs if n > 0]


def aligned(records: DataFrame, genome: DataFrame) -> DataFrame:
    """(record_id, preset, strand, seq_len, r, q, n): runs of each record's primary alignment with the genome (one row: seq).

    q counts on the strand. Records without an alignment under any preset have no row; a record_id is one row of records.
    """
    left, out = records.where("seq is not null").select("record_id", "seq"), None
    text = genome.select("seq").first()
    for name, k, w in PRESETS:
        chosen = settled(primary(chains(anchors(left, genome, k, w), k)))

        def run(batches, k=k):
            ref = _BASE[np.frombuffer((text[0] if text else "").encode("ascii", "replace"), np.uint8)]
            for batch in batches:
                rows = batch.select(["strand", "seq", "r", "q"]).to_pylist()
                runs = []
                for x in rows:
                    b = _BASE[np.frombuffer(x["seq"].encode("ascii", "replace"), np.uint8)]
                    b = np.where(b < 4, 3 - b, 5)[::-1] if x["strand"] == "-" else np.where(b < 4, b, 5)
                    runs.append([dict(zip("rqn", t)) for t in _bridged(ref, b, x["r"], x["q"], k)])
                yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("strand"), pa.array([len(x["seq"]) for x in rows], pa.int32()), pa.array(runs, pa.list_(pa.struct([(c, pa.int32()) for c in "rqn"])))], names=["record_id", "strand", "seq_len", "runs"])

        part = chosen.join(left, "record_id").select("record_id", "strand", "seq", "r", "q").mapInArrow(run, f"record_id string, strand string, seq_len int, runs {RUNS}")
        part = part.select("record_id", F.lit(name).alias("preset"), "strand", "seq_len", F.explode("runs").alias("x")).select("record_id", "preset", "strand", "seq_len", "x.*")
        out = part if out is None else out.union(part)
        left = left.join(chosen.select("record_id"), "record_id", "left_anti")
    return out


def nucleotide_lift(records: DataFrame, genome: DataFrame, features: DataFrame) -> DataFrame:
    """record_id, preset, strand, name, start, end, query_start, query_end, coverage: features (name, start, end) of the genome on each record that aligns.

    Places are the record's own, whatever the strand.
    """
    runs = settled(aligned(records, genome))
    spans = lifted_by_runs(features, runs)
    keys = runs.select(F.col("record_id").alias("_id"), "preset", "strand", "seq_len").distinct()
    rows = spans.join(keys, F.col("record_id") == F.col("_id")).drop("_id")
    turned, size = F.col("strand") == "-", F.col("seq_len") + 1
    return rows.withColumns({"query_start": F.when(turned, size - F.col("query_end")).otherwise(F.col("query_start")), "query_end": F.when(turned, size - F.col("query_start")).otherwise(F.col("query_end"))}).drop("seq_len")
