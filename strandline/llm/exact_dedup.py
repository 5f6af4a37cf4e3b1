"""Exact dedup by deterministic block naming, in DataFrame functions only.

Texts without white space are cut into fixed-size blocks. The distinct blocks of the corpus are sorted and each gets an
integer name; adjacent names are then paired and the distinct pairs sorted and named in turn, until each document has one
name. Two documents share (blocks, name) exactly when their texts are equal: names stand for whole blocks, not for hashes.

A block's text moves once, after a map-side distinct, so copies of one block never meet in a task; what is then sorted is
its two 64-bit hashes. That these are one-to-one over the corpus's distinct blocks is checked each time, and where they are
not, blocks are sorted and looked up by themselves.

Defined results: a null text counts as empty, and empty texts are one group; a null doc_id loses every tie; of repeated
rows one stays; an empty table gives an empty result; other columns are ignored, and drop_copies keeps them as they are,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import cut, only_rows, stored, text_hashes

WHITE = "[\\x20\\x09-\\x0D]"
BLOCK = 4096


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def blocks(text="text", size: int = BLOCK):
    return F.regexp_extract_all(normalised(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _keys(block):
    return F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(1), block).alias("h2")


def _name_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(h1, h2, name, block), block only where its hashes are not its own."""
    found = docs.select(F.explode(blocks(size=size)).alias("block")).select(*_keys(F.col("block")), "block").distinct()
    slim = cut(found.select("h1", "h2"))
    if slim.count() == slim.distinct().count():
        return cut(slim.orderBy("h1", "h2").withColumn("name", F.monotonically_increasing_id())).withColumn("block", F.lit(None).cast("string"))
    return stored(found.orderBy("block").withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, doc_id, points, sha, blocks, name), one row for each row of docs; docs has row, doc_id and text."""
    names = _name_blocks(docs, size)
    by_text = not names.where("block is not null").isEmpty()
    rows = docs.select("row", "doc_id", "text", blocks(size=size).alias("list"))
    rows = rows.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), F.sha2(normalised(), 256).alias("sha"), F.size("list").alias("blocks"), F.posexplode_outer("list").alias("pos", "block"))
    rows = stored(rows.select("row", "doc_id", "points", "sha", "blocks", "pos", *_keys(F.col("block")), *(["block"] if by_text else [])))
    keep = ["row", "doc_id", "points", "sha", "blocks"]
    on = ["h1", "h2", "block"] if by_text else ["h1", "h2"]
    named = rows.where("blocks > 0").join(names.select(*on, "name"), on)
    done = rows.where("blocks = 0").select(*keep, F.lit(-1).cast("long").alias("name")).union(named.where("blocks = 1").select(*keep, "name"))
    longest = rows.agg(F.max("blocks")).first()[0] or 0
    if longest < 2:
        return done
    # Only texts of two blocks or more take part in the rounds, by row alone.
    left = cut(named.where("blocks > 1").select("row", F.col("pos").cast("long").alias("pos"), "name"))
    for _ in range(math.ceil(math.log2(longest))):
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = left.groupBy("row", F.expr("pos div 2").alias("at")).agg(half(0).alias("l"), F.coalesce(half(1), F.lit(-1)).alias("r"))
        ranks = cut(pairs.select("l", "r").distinct().orderBy("l", "r").withColumn("name", F.monotonically_increasing_id()))
        left = cut(pairs.join(ranks, ["l", "r"]).select("row", F.col("at").alias("pos"), "name"))
    return done.union(rows.where("blocks > 1 and pos = 0").select(*keep).join(left.select("row", "name"), "row").select(*keep, "name"))


def _best(rows: DataFrame) -> DataFrame:
    """b, m (blocks and name), group_size, keep_id, keep_row of every group of equal texts."""
    best = rows.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("points", F.expr("~doc_id").alias("i"), F.expr("~row").alias("r"))).alias("best"))
    return best.select(F.col("blocks").alias("b"), F.col("name").alias("m"), "group_size", F.expr("~best.i").alias("keep_id"), F.expr("~best.r").alias("keep_row"))


def exact_dedup(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points: of equal texts the longest, then least doc_id, stays."""
    rows = identities(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), size)
    # As a table of its own this side leaves the join two plain exchanges, so a group of any size is split over tasks.
    best = stored(_best(rows))
    out = rows.join(best, (F.col("blocks") == F.col("b")) & (F.col("name") == F.col("m")))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("points").cast("long").alias("n_points"))


def drop_copies(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat with the same doc_id and text one stays.

    Rows are told apart by doc_id and two hashes of the text; which of several with the same is told by only_rows().
    """
    t1, t2 = text_hashes()
    rows = identities(docs.select(F.struct(t1.alias("t1"), t2.alias("t2")).alias("row"), "doc_id", "text"), size)
    best = rows.groupBy("blocks", "name").agg(F.max(F.struct("points", F.expr("~doc_id").alias("i"), "row")).alias("best"))
    return only_rows(docs, best.select(F.expr("~best.i").alias("doc_id"), "best.row.t1", "best.row.t2"))
