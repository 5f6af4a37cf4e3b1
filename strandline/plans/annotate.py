"""The annotation run: reference preparation, routing, direct extraction, lifting, summary, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import settled
from strandline.operators.alias import alias_lookup, lookup_map, resolve
from strandline.operators.crawl import keyword_match
from strandline.operators.direct import direct_features, with_sequence
from strandline.operators.lift import LiftConfig, lift, reference_proteins
from strandline.operators.routing import LEVELS, level_of, level_without_lookup, route
from strandline.operators.search import search
from strandline.operators.summary import status_counts
from strandline.sources.genbank import features_of


#: Stands between a repeated record_id and its number; no record_id holds it.
REPEAT = "\u0001"


@dataclass
class Reference:
    """One reference record ready for use: its features with canonical names, its genome, its level, the alias map."""

    features: DataFrame
    genome: DataFrame
    level: str
    lookup: object | None


@dataclass
class Run:
    lifted: DataFrame
    summary: DataFrame
    errors: DataFrame
    routes: DataFrame


def prepare_reference(record: DataFrame, terms: DataFrame | None = None, excluded: DataFrame | None = None) -> Reference:
    """record: one row of schema.RECORD. The level is the one whose names resolve best, or by type where there is no alias table."""
    table = lookup_map(alias_lookup(terms, excluded)) if terms is not None else None
    rows = features_of(record, *LEVELS)
    rows = resolve(rows, table) if table is not None else rows.withColumns({"raw_name": F.col("name"), "alias_source_value": F.lit(None).cast("string"), "name_source": F.lit("raw")})
    best = (level_of(rows) if table is not None else level_without_lookup(rows)).first()
    if best is None:
        raise ValueError("the reference has no usable annotation")
    kept = rows.where(F.col("type") == best["type"]).withColumn("feature_idx", F.col("ord").cast("int"))
    return Reference(kept, record.select("record_id", "seq", "seq_len"), best["type"], table)


def detect_virus(records: DataFrame, registry: DataFrame) -> DataFrame:
    """records with virus, by keywords in organism, description, name and id."""
    from strandline.functions.names import search_text

    rows = records.withColumn("_t", search_text(F.col("organism"), F.col("description"), F.col("name"), F.col("record_id")))
    return keyword_match(rows, "_t", registry).drop("_t")


def told_apart(records: DataFrame) -> DataFrame:
    """records, each with a record_id of its own: all but the first of a record_id bear a number behind REPEAT."""
    if records.groupBy("record_id").count().where("count > 1").isEmpty():
        return records
    rows = settled(records.withColumn("_n", F.monotonically_increasing_id()))
    first = rows.groupBy(F.col("record_id").alias("_id")).agg(F.min("_n").alias("_first"))
    rows = rows.join(first, F.col("record_id").eqNullSafe(F.col("_id")))
    return rows.withColumn("record_id", F.when(F.col("_n") == F.col("_first"), F.col("record_id")).otherwise(F.concat("record_id", F.lit(REPEAT), F.col("_n").cast("string")))).drop("_n", "_first", "_id")


def annotate(records: DataFrame, reference: Reference, config: LiftConfig | None = None, hsps: DataFrame | None = None) -> Run:
    """records: schema.RECORD. hsps: alignments made elsewhere; without them the native search runs on the records to lift.

    Records without a sequence can be neither read nor lifted: they are errors, and the others go on. Records that repeat a
    record_id are annotated each for itself.
    """
    config = config or LiftConfig(codons=reference.level == "CDS")
    good, errors = told_apart(records.where("seq is not null and seq_len > 0")), records.where("seq is null or coalesce(seq_len, 0) = 0").select("record_id", F.lit("no sequence").alias("error"))
    rows = features_of(good, reference.level)
    if reference.lookup is not None:
        rows = resolve(rows, reference.lookup)
        levels = level_of(rows, (reference.level,))
    else:
        rows = rows.withColumns({"raw_name": F.col("name"), "alias_source_value": F.lit(None).cast("string"), "name_source": F.lit("named")})
        levels = level_without_lookup(rows)
    routes = route(good, levels)
    direct = with_sequence(direct_features(rows.join(routes.where("strategy = 'direct'").select("record_id"), "record_id", "left_semi"), reference.features), good)
    todo = good.join(routes.where("strategy = 'tblastn'").select("record_id"), "record_id", "left_semi").select("record_id", "seq", "seq_len")
    proteins = reference_proteins(reference.features.select("feature_idx", "name", "start", "end", "strand"), reference.genome)
    if hsps is None:
        hsps = search(todo, proteins.select("feature_idx", "protein"), config.evalue)
    lifted = lift(todo, proteins, hsps, config)
    both = lifted.unionByName(direct.withColumn("feature_idx", F.col("first_ord").cast("int")).drop("first_ord"), allowMissingColumns=True)
    both, errors, routes = (x.withColumn("record_id", F.substring_index("record_id", REPEAT, 1)) for x in (both, errors, routes))
    return Run(both, status_counts(both), errors, routes)
