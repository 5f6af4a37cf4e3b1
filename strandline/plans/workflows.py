"""Composite runs: crawl and split, alias suggestions from coordinates, alias review payloads, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.lineage import settled
from strandline.functions.names import QUALIFIERS, best_canonical, compound_parts, filled, first_matching, first_wins, norm
from strandline.operators import alias, context, crawl, routing, suggest, summary
from strandline.operators.lift import LiftConfig, lift, reference_proteins
from strandline.operators.search import search
from strandline.plans.annotate import Reference
from strandline.sources import tables
from strandline.sources.crawl_sink import CrawlSink, recovered
from strandline.sources.genbank import features_of, parse_record, raw_records


def split_crawl(spark: SparkSession, raw: str, registry: dict, ledger: str, output: str, known: bool = False) -> DataFrame:
    """Read raw flat files, mark duplicates against the ledger and the batch, write species files, manifest and ledger together.

    What a run before left unfinished is finished first, so that the ledger is whole when it is read. The raw texts are written as they came. known: only report, write nothing.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(r["record_id"], r["organism"], r["seq_len"], *row) for row in batch.itertuples(index=False) if (r := parse_record(row[0]))]
            yield pd.DataFrame(rows, columns=["accession", "organism", "length", "text", "file_path", "file_block_start"])

    if not known:
        recovered(output)
    rows = raw_records(spark, raw).mapInPandas(run, "accession string, organism string, length int, text string, file_path string, file_block_start long")
    # The order of the files decides which of equal accessions is new: file name, then place within it. A block of a file is
    # read by one task from its beginning, so within it the running number is that place.
    rows = rows.withColumn("ord", F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("n"))).drop("file_path", "file_block_start")
    rows = crawl.keyword_match(rows, "organism", tables.registry_table(spark, registry, with_name=True))
    marked = crawl.dedup_status(rows, tables.read_ledger(spark, ledger))
    if known:
        return crawl.manifest(marked)
    # Settled, because the running number is not made twice, and the ledger changes while the outputs are written.
    rows = crawl.manifest(settled(marked), "text").withColumn("length", F.col("length").cast("int"))
    spark.dataSource.register(CrawlSink)
    rows.write.format("crawl").option("ledger", ledger).mode("append").save(output)
    return tables.read_manifest(spark, f"{output}/manifest")


def candidates(records: DataFrame, level: str) -> DataFrame:
    """One row for each name a feature of the level bears: q_idx, query_name, q_start, q_end, q_strand, field, raw_value, k."""
    rows = features_of(records, level).withColumnsRenamed({"start": "q_start", "end": "q_end", "strand": "q_strand", "name": "query_name"})

    def of(q):
        return F.transform(compound_parts(F.col(q)), lambda v: F.struct(F.lit(q).alias("field"), v.alias("raw_value")))

    named = F.array(*map(of, QUALIFIERS))
    parts = F.filter(F.flatten(named), lambda x: norm(x["raw_value"]) != "")
    return rows.select("record_id", F.col("ord").alias("q_idx"), "query_name", "q_start", "q_end", "q_strand", F.posexplode(parts).alias("k", "x")).select("record_id", "q_idx", "query_name", "q_start", "q_end", "q_strand", "k", "x.*")


def coordinate_suggestions(records: DataFrame, reference: Reference, seeds: DataFrame | None = None, least_iou: float = 0.90, config: LiftConfig | None = None) -> DataFrame:
    """Suggested aliases: names that annotated records give to the places where the reference's features are found."""
    config = config or LiftConfig(codons=reference.level == "CDS")
    names = candidates(records, reference.level)
    todo = records.select("record_id", "seq", "seq_len").join(names.select("record_id").distinct(), "record_id", "left_semi")
    proteins = reference_proteins(reference.features.select("feature_idx", "name", "start", "end", "strand"), reference.genome)
    lifted = lift(todo, proteins, search(todo, proteins.select("feature_idx", "protein"), config.evalue), config)
    found = lifted.where("query_start is not null").select("record_id", F.col("feature_idx").alias("l_idx"), F.col("name").alias("coordinate_canonical_name"), F.col("query_start").alias("l_start"), F.col("query_end").alias("l_end"), F.col("strand").alias("l_strand"), "coverage", "identity", "status")
    places = names.select("record_id", "q_idx", "q_start", "q_end").distinct()
    met = suggest.best_overlap(places, found, least_iou).drop("q_start", "q_end")
    rows = names.join(met, ["record_id", "q_idx"]).withColumns({"canonical_name": F.col("coordinate_canonical_name"), "strand_match": F.col("q_strand") == F.col("l_strand")})
    if seeds is not None:
        rows = suggest.seed_override(rows, seeds)
    rows = suggest.classified(rows.withColumn("ord", F.struct("record_id", "q_idx", "k")))
    return suggest.demoted(suggest.deduplicated(rows)).withColumn("needs_review", suggest.needs_review()).withColumn("review_id", suggest.review_id(F.col("norm"), F.col("field"), F.col("canonical_name")))


def diagnostics(records: DataFrame, reference: Reference, suggestions: DataFrame) -> DataFrame:
    """(counter, n) of a suggestion run."""
    kinds = features_of(records, *routing.LEVELS).groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("features "), "type").alias("counter"), "n")
    return kinds.union(records.agg(F.lit("records"), F.count("*"))).union(suggestions.groupBy("suggested_action").agg(F.count("*").alias("n")).select(F.concat(F.lit("suggestions "), "suggested_action"), "n"))


def record_statuses(records: DataFrame, registry: DataFrame, reference: Reference) -> tuple[DataFrame, DataFrame]:
    """((record_id, virus, status), unresolved features): all_resolved, has_unresolved, new_virus or no_annotation."""
    from strandline.plans.annotate import detect_virus

    viruses = detect_virus(records, registry).select("record_id", "virus")
    rows = alias.resolve(features_of(records, *routing.LEVELS), reference.lookup)
    levels = routing.level_of(rows)
    mine = rows.join(levels.select("record_id", "type"), ["record_id", "type"], "left_semi")
    counts = mine.groupBy("record_id").agg(F.count_if(F.col("name_source") == "raw").alias("raw"))
    any_features = rows.select("record_id").distinct().withColumn("has", F.lit(True))
    out = viruses.join(counts, "record_id", "left").join(any_features, "record_id", "left")
    status = F.when(F.col("virus").isNull(), "new_virus").when(F.col("has").isNull(), "no_annotation").when(F.coalesce("raw", F.lit(1)) > 0, "has_unresolved").otherwise("all_resolved")
    return out.select("record_id", "virus", status.alias("status")), mine.where("name_source = 'raw'")


def unresolved_payload(unresolved: DataFrame, coding: DataFrame, gene_order: list[str], virus: str) -> DataFrame:
    """(review_id, payload): each unresolved name once, with where it stands in its first record, as JSON.

    coding: record_id, ord, start, end, canonical of the coding features.
    """
    placed = context.neighbours(coding).join(context.enclosing(coding), ["record_id", "ord"], "left").select("record_id", "ord", "neighbor_before", "neighbor_after", "container")
    rows = unresolved.join(placed, ["record_id", "ord"], "left").withColumn("norm", norm(F.col("name")))
    one = rows.groupBy("norm").agg(F.min_by(F.struct("name", "record_id", "type", "start", "end", "strand", "length", "neighbor_before", "neighbor_after", "container", *(filled(F.col(q)).alias(q) for q in QUALIFIERS)), F.struct("record_id", "ord")).alias("x"), F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))
    slots = context.slot_candidates(F.col("x.neighbor_before"), F.col("x.neighbor_after"), gene_order)
    names = F.array(*map(F.lit, gene_order)) if gene_order else F.array().cast("array<string>")
    values = first_wins(F.filter(F.array(F.col("x.name"), *(F.col(f"x.{q}") for q in QUALIFIERS)), lambda v: v.isNotNull()))
    match = F.coalesce(best_canonical(F.col("x.name"), names), first_matching(values, names))
    evidence = F.struct(values.alias("candidate_values"), F.size(values).alias("candidate_values_count"), (F.size(values) > 1).alias("has_multiple_candidate_values"), match.alias("matching_available_canonical"), F.col("records").alias("support_count"), (F.col("records") >= 3).alias("high_support_unresolved"))
    body = F.struct(F.lit(virus).alias("virus"), F.col("x.name").alias("raw_value"), F.col("n").alias("occurrences"), *(evidence[f].alias(f) for f in ("candidate_values", "candidate_values_count", "has_multiple_candidate_values", "matching_available_canonical", "support_count", "high_support_unresolved")), F.col("x").alias("feature"), slots.alias("slot_candidates"), F.when(F.size(slots) == 1, slots[0]).alias("slot"), names.alias("canonical_names"))
    return one.select(suggest.review_id(F.lit(virus), F.col("norm")).alias("review_id"), F.to_json(body).alias("payload"))


def unresolved_review(records: DataFrame, reference: Reference) -> DataFrame:
    """(review_id, payload) of the names of records that nothing resolves, against the reference's own canonicals."""
    rows = alias.resolve(features_of(records, reference.level), reference.lookup) if reference.lookup is not None else features_of(records, reference.level).withColumn("name_source", F.lit("raw"))
    named = F.col("name_source").isin("alias", "alias_conflict_resolved")
    coding = rows.select("record_id", "ord", "start", "end", F.when(named, F.col("name")).alias("canonical"))
    order = [r["name"] for r in alias.ordered_distinct(reference.features.select("name", "ord")).orderBy("ord").select("name").collect()]
    virus = reference.genome.first()["record_id"]
    return unresolved_payload(rows.where("name_source = 'raw'"), coding, order, virus)


def suggestion_payload(suggestions: DataFrame, canonicals: list[str], virus: str, most: int = 20) -> DataFrame:
    """(review_id, payload) of the first `most` suggestions that need review: what a reviewer is asked."""
    rows = suggest.in_order(suggestions.where("needs_review")).limit(max(1, most))
    kept = ["raw_value", "field", "canonical_name", "score", "suggested_action", "confidence", "reason", "support_count", "support_records", "cross_canonical_targets"]
    names = F.array(*map(F.lit, canonicals)) if canonicals else F.array().cast("array<string>")
    suggestion = F.struct(*kept, best_canonical(F.col("raw_value"), names).alias("matching_available_canonical"), F.size("cross_canonical_targets").alias("cross_canonical_target_count"))
    return rows.select("review_id", F.to_json(F.struct(F.lit(virus).alias("virus"), suggestion.alias("suggestion"), names.alias("canonical_names"))).alias("payload"))


def seed_config(virus: str, reference: DataFrame) -> dict:
    """A configuration for a virus not known so far: the reference's own names, in order."""
    names = alias.ordered_distinct(reference.where("name is not null").select("name", "ord")).orderBy("ord")
    return {"virus": virus, "notes": "", "excluded_names": [], "canonical_names": {r["name"]: [] for r in names.collect()}}


def evaluation(lifted: DataFrame, records: DataFrame, reference: Reference) -> tuple[DataFrame, DataFrame]:
    """(compared features, accuracy by record and in all) against the records' own annotation."""
    # What another feature holds is a part of a gene, not a gene to be compared with.
    whole = context.sub_features(features_of(records, reference.level)).where("not is_sub").drop("is_sub")
    truth = alias.resolve(whole, reference.lookup).where("name_source in ('alias', 'alias_conflict_resolved')")
    rows = summary.compared(lifted, truth.select("record_id", "name", "start", "end"))
    return rows, summary.accuracy(rows)
