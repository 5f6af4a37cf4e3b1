"""Direct extraction from annotated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import cut


def reference_names(reference: DataFrame) -> DataFrame:
    """(name, ref_start, ref_end, ref_len): of features with one name the last counts."""
    last = reference.groupBy("name").agg(F.max_by(F.struct("start", "end"), "ord").alias("f"))
    return last.select("name", F.col("f.start").alias("ref_start"), F.col("f.end").alias("ref_end"), (F.col("f.end") - F.col("f.start") + 1).alias("ref_len"))


def collapse_duplicates(resolved: DataFrame, reference: DataFrame) -> DataFrame:
    """One feature for each (record_id, name): nearest the reference's length, longest, first by start, first in order.

    first_ord is the place of the name's first feature, which is the place of the one that stays.
    """
    rows = resolved.where("name is not null and name <> ''").join(reference_names(reference), "name", "left").withColumn("length", F.col("end") - F.col("start") + 1)
    by_name = Window.partitionBy("record_id", "name")
    best = by_name.orderBy(F.coalesce(F.abs(F.col("length") - F.col("ref_len")), F.lit(0)), F.col("length").desc(), "start", "ord")
    return rows.withColumns({"first_ord": F.min("ord").over(by_name), "_n": F.row_number().over(best)}).where("_n = 1").drop("_n")


def direct_features(resolved: DataFrame, reference: DataFrame) -> DataFrame:
    """Annotated features as results: excluded names are left out, the others get a status."""
    rows = collapse_duplicates(resolved, reference).where("name_source <> 'excluded'")
    named = F.col("name_source").isin("alias", "alias_conflict_resolved")
    return rows.select(
        "record_id", "first_ord", "name",
        F.when(named, F.coalesce("alias_source_value", "raw_name")).alias("source_name"),
        "ref_start", "ref_end", "strand", F.lit("direct").alias("method"), F.col("start").alias("query_start"), F.col("end").alias("query_end"), F.lit(1.0).alias("coverage"),
        F.when(F.col("name_source") == "raw", "unresolved_name").when(F.col("ref_start").isNull(), "not_in_reference").otherwise("ok").alias("status"),
    )


def with_sequence(rows: DataFrame, records: DataFrame, start: str = "query_start", end: str = "query_end") -> DataFrame:
    """rows with the bases they span; only here do sequences meet the features.

    The join asks for a merge: a broadcast, which Spark may choose by a table's estimated size, would hold all sequences in the driver.
    """
    return rows.join(records.select("record_id", "seq").hint("merge"), "record_id").withColumn("sequence", cut(F.col("seq"), F.col(start), F.col(end), F.col("strand"))).drop("seq")
