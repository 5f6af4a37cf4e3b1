"""Where an unresolved feature stands: neighbours, enclosing feature, the reference genes that fit between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.intervals import overlap_join


def neighbours(coding: DataFrame) -> DataFrame:
    """coding (record_id, ord, start, end, canonical) with the named neighbours that begin strictly before and after."""
    by = Window.partitionBy("record_id").orderBy("start")
    # Of neighbours that begin together the one next in order counts, so the windows run over (start, ord) pairs by start.
    before = F.max(F.when(F.col("canonical").isNotNull(), F.struct("start", "ord", "canonical"))).over(by.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("canonical").isNotNull(), F.struct("start", "ord", "canonical"))).over(by.rangeBetween(1, Window.unboundedFollowing))
    return coding.withColumns({"neighbor_before": before["canonical"], "neighbor_after": after["canonical"]})


def enclosing(coding: DataFrame) -> DataFrame:
    """(record_id, ord, container): the first strictly longer feature by start that holds each feature."""
    inner = coding.select("record_id", F.col("ord").alias("ord"), F.col("start").alias("i0"), F.col("end").alias("i1"))
    outer = coding.select("record_id", F.col("ord").alias("o_ord"), F.col("start").alias("o0"), F.col("end").alias("o1"), F.col("canonical").alias("o_name"))
    met = overlap_join(inner, outer, ["record_id"], ("i0", "i1"), ("o0", "o1")).where("o0 <= i0 and o1 >= i1 and o1 - o0 > i1 - i0")
    first = met.groupBy("record_id", "ord").agg(F.min(F.struct("o0", "o_ord", F.coalesce("o_name", F.lit("an unnamed coding feature")).alias("name"))).alias("c"))
    return first.select("record_id", "ord", F.col("c.name").alias("container"))


def sub_features(features: DataFrame, most: float = 0.8) -> DataFrame:
    """features with is_sub: held by another of the record that it fills to less than `most`."""
    inner = features.select("record_id", "ord", F.col("start").alias("i0"), F.col("end").alias("i1"))
    outer = features.select("record_id", F.col("ord").alias("o_ord"), F.col("start").alias("o0"), F.col("end").alias("o1"))
    held = overlap_join(inner, outer, ["record_id"], ("i0", "i1"), ("o0", "o1")).where(f"ord <> o_ord and o0 <= i0 and o1 >= i1 and i1 - i0 + 1 < {most} * (o1 - o0 + 1)")
    return features.join(held.select("record_id", "ord", F.lit(True).alias("is_sub")).distinct(), ["record_id", "ord"], "left").withColumn("is_sub", F.coalesce("is_sub", F.lit(False)))


def slot_candidates(before, after, order: list[str]):
    """Column: the genes of `order` strictly between two neighbours; none where a neighbour isn't in it."""
    genes = F.array(*map(F.lit, order))
    i = F.when(before.isNull(), 0).otherwise(F.array_position(genes, before))
    j = F.when(after.isNull(), len(order) + 1).otherwise(F.array_position(genes, after))
    known = (before.isNull() | (i > 0)) & (after.isNull() | (j > 0)) & (j - i > 1)
    return F.when(known, F.slice(genes, (i + 1).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))


def unknown_names(features: DataFrame) -> DataFrame:
    """Names nothing resolves, by representative: (representative, n_records, first_candidates).

    features: record_id, ord, and candidates, an array of (value, target, sentinel) in order of priority. Which records bear
    a name is in unknown_name_records(), a row each: some names stand in most records.
    """
    names = F.array_join(F.transform("candidates", lambda c: c["value"]), "|")
    rows = _unresolved(features).withColumn("names", names)
    # First by record, then over records: a name's rows are summed before they meet.
    one = rows.groupBy("representative", "record_id").agg(F.min(F.struct("ord", "names")).alias("x"))
    return one.groupBy("representative").agg(F.count("*").alias("n_records"), F.min_by("x.names", "record_id").alias("first_candidates"))


def unknown_name_records(features: DataFrame) -> DataFrame:
    """(representative, record_id), each pair once."""
    return _unresolved(features).select("representative", "record_id").distinct()


def _unresolved(features: DataFrame) -> DataFrame:
    real = F.exists("candidates", lambda c: c["target"].isNotNull() & ~c["sentinel"])
    free = F.filter("candidates", lambda c: ~F.coalesce(c["sentinel"], F.lit(False)))
    return features.where(~real & (F.size(free) > 0)).withColumn("representative", F.element_at(free, 1)["value"])
