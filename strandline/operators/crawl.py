"""Crawl: accession lists, ledger, registry match, dedup status, split, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import settled
from strandline.functions.names import first_wins, slug

#: Registry rows that become one expression; larger registries are joined.
MOST_KEYWORDS = 10_000
GRAM = 4


def accessions(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row for each accession of the lines; commas and white space separate, lines that begin with # are comments."""
    kept = lines.where(~F.trim(F.col(column)).startswith("#"))
    return kept.select(F.explode(F.split(F.trim(F.regexp_replace(column, ",", " ")), r"\s+")).alias("accession")).where("accession <> ''")


def keyword_match(records: DataFrame, text: str, registry: DataFrame, most: int = MOST_KEYWORDS) -> DataFrame:
    """records with virus: the first registry entry, by (ord, kw_ord), one of whose keywords the text holds.

    A registry of up to `most` rows is read to the driver and becomes one expression, so records are not shuffled. The
    keywords of a larger one are found by their first GRAM letters among all such runs of the text, then compared whole;
    keywords of fewer letters are few and stay an expression. Both give the same rows.
    """
    listed = registry.where("keyword <> ''").select("ord", "kw_ord", "virus", F.lower("keyword").alias("keyword"))
    held = F.lower(F.col(text))

    def first(rows):
        hit = F.lit(None).cast("struct<ord:bigint,kw_ord:bigint,virus:string>")
        for r in sorted(rows, key=lambda r: (r["ord"], r["kw_ord"]), reverse=True):
            hit = F.when(F.contains(held, F.lit(r["keyword"])), F.struct(F.lit(r["ord"]).cast("bigint").alias("ord"), F.lit(r["kw_ord"]).cast("bigint").alias("kw_ord"), F.lit(r["virus"]).alias("virus"))).otherwise(hit)
        return hit

    rows = listed.limit(most + 1).collect()
    if len(rows) <= most:
        return records.withColumn("virus", first(rows)["virus"])
    short = listed.where(F.length("keyword") < GRAM).groupBy("keyword").agg(F.min(F.struct("ord", "kw_ord", "virus")).alias("x")).select("keyword", "x.*").collect()
    texts = records.select(held.alias("_held")).where("_held is not null").distinct()
    grams = texts.select("_held", F.explode(F.array_distinct(F.regexp_extract_all("_held", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("_gram"))
    long = listed.where(F.length("keyword") >= GRAM).withColumn("_gram", F.substring("keyword", 1, GRAM))
    best = grams.join(long, "_gram").where(F.contains("_held", "keyword")).groupBy("_held").agg(F.min(F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("kw_ord").cast("bigint").alias("kw_ord"), "virus")).alias("_long"))
    out = records.join(best, held == F.col("_held"), "left")
    return out.withColumn("virus", F.least("_long", first(short))["virus"]).drop("_held", "_long")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ord, their place from 1 in the order: places are counted in each partition, and only the partitions' sizes are read."""
    placed = settled(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    sizes, total, before = placed.groupBy("_part").count().orderBy("_part").collect(), 0, {}
    for r in sizes:
        before[r["_part"]], total = total, total + r["count"]
    offset = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))) if before else F.create_map().cast("map<int,int>")
    return placed.withColumn("ord", F.col("_id").bitwiseAND((1 << 33) - 1) + F.try_element_at(offset, F.col("_part")) + 1).drop("_part", "_id")


def dedup_status(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """records (accession, ord) with status: dup_in_ledger, else new for the first of an accession, else dup_in_batch.

    A minimum by accession is partly summed before its shuffle, so one accession with a third of the rows is no hot task.
    """
    known = ledger.select("accession").distinct().withColumn("_known", F.lit(True))
    first = records.groupBy("accession").agg(F.min("ord").alias("_first")).join(known, "accession", "left")
    out = records.join(first.withColumnRenamed("accession", "_a"), F.col("accession").eqNullSafe(F.col("_a")))
    return out.withColumn("status", F.when(F.col("_known"), "dup_in_ledger").when(F.col("ord") == F.col("_first"), "new").otherwise("dup_in_batch")).drop("_a", "_first", "_known")


def manifest(records: DataFrame, *also: str) -> DataFrame:
    """Manifest rows: every input row; duplicates have no output file. also: further columns of records."""
    virus = F.coalesce("virus", F.lit("_unmatched"))
    file = F.when(F.col("status") == "new", F.concat(F.when(F.col("virus").isNull(), F.lit("_unmatched")).otherwise(slug(F.col("virus"))), F.lit(".gb"))).otherwise("")
    return records.select("accession", "organism", F.col("length").cast("string").alias("length"), virus.alias("matched_virus"), file.alias("output_file"), "status", *also)


def split_counts(table: DataFrame) -> DataFrame:
    """Counts by species (of new rows), by status, and of all rows: (level, value, n)."""
    by = table.groupingSets([["matched_virus", "status"], ["status"], []], "matched_virus", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = by.where("g <> 0 or status = 'new'")
    return by.select(F.when(F.col("g") == 0, "species").when(F.col("g") == 2, "status").otherwise("all").alias("level"), F.when(F.col("g") == 0, F.col("matched_virus")).when(F.col("g") == 2, F.col("status")).alias("value"), "n")


def batches(rows: DataFrame, size: int = 200) -> DataFrame:
    """rows (accession, ord) with batch, the number of the request each goes into: ord counts from 1 without gaps."""
    return rows.withColumn("batch", F.floor((F.col("ord") - 1) / size))


def keywords(virus: str, text: str):
    """Column: the virus name and the comma- or line-separated keywords, distinct, in order."""
    return first_wins(F.concat(F.array(F.lit(virus)), F.transform(F.split(F.lit(text), "[,\\n]+"), lambda k: F.trim(k))))


def longest_keyword(registry: DataFrame) -> DataFrame:
    """(virus, keyword): each entry's longest keyword, the first of equals."""
    return registry.groupBy("virus").agg(F.max_by("keyword", F.struct(F.length("keyword"), -F.col("kw_ord"))).alias("keyword"))


def first_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
