"""Which annotation level a record has, and whether it is read directly or lifted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("mat_peptide", "CDS")


def level_scores(resolved: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(record_id, type, score): 100 for each resolved feature, 1 for each raw one, -1 for each excluded one."""
    value = F.when(F.col("name_source").isin("alias", "alias_conflict_resolved"), 100).when(F.col("name_source") == "raw", 1).when(F.col("name_source") == "excluded", -1).otherwise(0)
    return resolved.where(F.col("type").isin(*levels)).groupBy("record_id", "type").agg(F.sum(value).alias("score"))


def level_of(resolved: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(record_id, type, score): the best level of each record, the earlier of equals; records at or below 0 are left out."""
    rank = F.when(F.col("type") == levels[0], 0).otherwise(F.array_position(F.array(*map(F.lit, levels)), F.col("type")))
    best = level_scores(resolved, levels).groupBy("record_id").agg(F.min(F.struct((-F.col("score")).alias("s"), rank.alias("r"), F.col("type").alias("t"))).alias("b"))
    return best.select("record_id", F.col("b.t").alias("type"), (-F.col("b.s")).alias("score")).where("score > 0")


def level_without_lookup(features: DataFrame) -> DataFrame:
    """(record_id, type) where no alias table is at hand: mature peptides if any, else CDS.

    A single CDS that is named a polyprotein, or isn't named, is a shell and gives no level.
    """
    shell = F.col("name").isNull() | F.lower("name").isin("", "unknown") | F.contains(F.lower("name"), F.lit("polyprotein"))
    one = features.groupBy("record_id").agg(F.count_if(F.col("type") == "mat_peptide").alias("m"), F.count_if(F.col("type") == "CDS").alias("c"), F.count_if((F.col("type") == "CDS") & shell).alias("s"))
    kind = F.when(F.col("m") > 0, "mat_peptide").when((F.col("c") > 0) & ~((F.col("c") == 1) & (F.col("s") == 1)), "CDS")
    return one.select("record_id", kind.alias("type")).where("type is not null")


def route(records: DataFrame, levels: DataFrame) -> DataFrame:
    """(record_id, type, strategy): direct where the record has a level, else tblastn."""
    return records.select("record_id").join(levels.select("record_id", "type"), "record_id", "left").withColumn("strategy", F.when(F.col("type").isNull(), "tblastn").otherwise("direct"))
