"""Summaries of a run: status counts, health, overviews, exports, evaluation against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.intervals import rounded
from strandline.schema import PASSING, REVIEWED, status_dim


def status_counts(lifted: DataFrame) -> DataFrame:
    """(status, n) with a zero for each known status that doesn't occur; unknown statuses are counted too."""
    counts = lifted.groupBy("status").count()
    return counts.join(status_dim(lifted.sparkSession).select("status"), "status", "full").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def run_health(lifted: DataFrame) -> DataFrame:
    one = lifted.agg(F.count("*").alias("features"), F.count_if(F.col("status").isin(*PASSING)).alias("passing"), F.count_if(F.col("status").isin(*REVIEWED)).alias("needs_review"))
    rate = F.when(F.col("features") > 0, rounded(F.col("passing") * 100 / F.col("features"), 1)).otherwise(0.0)
    return one.select("features", "passing", "needs_review", rate.alias("pass_rate"))


def record_overview(records: DataFrame, lifted: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each record, those without features too."""
    by = lifted.groupBy("record_id").agg(
        F.count_if(F.col("status").isin(*PASSING)).alias("passed"), F.count("*").alias("total"), F.count_if(F.col("status").isin(*REVIEWED)).alias("needs_review"),
        F.max(F.col("method") == "direct").alias("d"), F.max(F.col("method") == "tblastn").alias("t"))
    out = records.select("record_id").join(by, "record_id", "left").join(errors.select("record_id", "error"), "record_id", "left")
    direct, lift = F.coalesce("d", F.lit(False)), F.coalesce("t", F.lit(False))
    total, review = F.coalesce("total", F.lit(0)), F.coalesce("needs_review", F.lit(0))
    return out.select(
        "record_id",
        F.when(F.col("error").isNotNull(), "failed").when(total == 0, "empty").when(review > 0, "needs review").otherwise("passed").alias("health"),
        F.coalesce("passed", F.lit(0)).alias("passed"), total.alias("total"), review.alias("needs_review"),
        F.when(direct & lift, "tblastn + direct").when(direct, "direct").when(lift, "tblastn").otherwise("none").alias("method"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def method_bucket() -> Column:
    """Of an overview row: direct, tblastn, mixed or other."""
    return F.when((F.col("error") != "") | (F.col("total") == 0), "other").when(F.col("method") == "tblastn + direct", "mixed").when(F.col("method") == "none", "other").otherwise(F.col("method"))


def annotation_classes(features: DataFrame) -> DataFrame:
    """(record_id, cds, mat_peptides, class); the last row, with a null record_id, has the totals."""
    by = features.rollup("record_id").agg(F.count_if(F.col("type") == "CDS").alias("cds"), F.count_if(F.col("type") == "mat_peptide").alias("mat_peptides"))
    kind = F.when(F.col("record_id").isNull(), "total").when(F.col("mat_peptides") > 0, "full").when(F.col("cds") > 0, "CDS only").otherwise("none")
    return by.withColumn("class", kind)


def boundary_check() -> Column:
    one = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label + ":"), F.when(F.col(c), "yes").otherwise("no")))
    return F.concat_ws(", ", one("start", "has_start_codon"), one("stop", "has_stop_codon"), one("frame", "in_frame"))


def rescue_text() -> Column:
    shift = F.format_string("%+d bp", F.col("rescue_offset"))
    return F.coalesce("rescue_action", F.when(F.col("rescue_offset").isNotNull(), F.concat(F.coalesce("rescue_target", F.lit("start")), F.lit(" "), shift)), F.lit(""))


def searched(overview: DataFrame, health: list[str] | None = None, text: str = "") -> DataFrame:
    """The rows of an overview with one of the healths (none: any) whose record_id holds the text, whatever its case."""
    rows = overview if not health else overview.where(F.col("health").isin(*health))
    return rows.where(F.contains(F.lower("record_id"), F.lit(text.strip().lower())))


def export_key() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat_ws("|", *(text(c) for c in ("record_id", "gene", "status", "query_start", "query_end", "strand")))


def display_rows(lifted: DataFrame, reference_names: DataFrame) -> DataFrame:
    """lifted with gene, the reference's own name for it (reference_names: name, shown)."""
    return lifted.join(reference_names.select("name", "shown"), "name", "left").withColumn("gene", F.coalesce("shown", "name")).drop("shown")


def fasta_rows(lifted: DataFrame, genes: list[str] | None, approved: DataFrame, least_coverage: float = 0.5, least_identity: float = 0.0, accepted: tuple[str, ...] = ("ok", "direct", "ok_rescued", "ok_extrapolated")) -> DataFrame:
    """(gene, record_id, query_start, query_end, fasta) of features that may be exported: approved, or accepted and good enough."""
    rows = lifted.where("sequence <> ''") if genes is None else lifted.where(F.col("gene").isin(genes) & (F.col("sequence") != ""))
    rows = rows.withColumn("key", export_key()).join(approved.select("key", F.lit(True).alias("_ok")).distinct().hint("merge"), "key", "left")
    good = F.col("status").isin(*accepted) & (F.coalesce("coverage", F.lit(1e9)) >= least_coverage) & (F.coalesce("identity", F.lit(1e9)) >= least_identity)
    header = F.concat(F.lit(">"), F.concat_ws("|", "record_id", "gene", F.col("query_start").cast("string"), F.col("query_end").cast("string"), "strand"))
    return rows.where(F.coalesce("_ok", F.lit(False)) | good).select("gene", "record_id", "query_start", "query_end", F.concat(header, F.lit("\n"), F.col("sequence")).alias("fasta"))


def raw_names(lifted: DataFrame) -> DataFrame:
    """lifted with the source's own name where there is one."""
    return lifted.withColumn("name", F.when(F.col("source_name") != "", F.col("source_name")).otherwise(F.col("name")))


def compared(lifted: DataFrame, truth: DataFrame) -> DataFrame:
    """Each lifted feature against the longest truth of its name: (…, match_note, start_diff, end_diff, len_diff)."""
    longest = truth.groupBy("record_id", "name").agg(F.max(F.struct((F.col("end") - F.col("start") + 1).alias("n"), (-F.col("start")).alias("s"), F.col("end").alias("e"))).alias("t"))
    rows = lifted.join(longest, ["record_id", "name"], "left").withColumns({"actual_start": -F.col("t.s"), "actual_end": F.col("t.e"), "actual_len": F.col("t.n"), "lifted_len": F.col("query_end") - F.col("query_start") + 1})
    ratio = F.col("lifted_len") / F.col("actual_len")
    note = F.when(F.col("query_start").isNull(), F.col("status")).when(F.col("t").isNull(), "not_in_actual").when(~ratio.between(0.5, 2.0), "size_mismatch").otherwise("matched")
    return rows.withColumns({"start_diff": F.col("query_start") - F.col("actual_start"), "end_diff": F.col("query_end") - F.col("actual_end"), "len_diff": F.col("lifted_len") - F.col("actual_len"), "match_note": note}).drop("t")


def accuracy(rows: DataFrame) -> DataFrame:
    """Counts for each record, and for all (record_id null); perfect_pct is of the matched."""
    hit = F.col("match_note") == "matched"
    out = rows.rollup("record_id").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.count_if(hit & (F.col("start_diff") == 0) & (F.col("end_diff") == 0)).alias("perfect"),
        F.count_if(F.col("status") == "ok_rescued").alias("rescued"), F.count_if(F.col("status") == "invalid_boundaries").alias("invalid"), F.count_if(F.col("status") == "no_hit").alias("no_hit"),
        F.count_if(F.col("status").startswith("low_coverage")).alias("low_coverage"), F.count_if(F.col("match_note") == "size_mismatch").alias("size_mismatch"), F.count_if(F.col("match_note") == "not_in_actual").alias("not_in_actual"))
    return out.withColumn("perfect_pct", F.when(F.col("matched") > 0, rounded(F.col("perfect") * 100 / F.col("matched"), 1)).otherwise(0.0))


def fasta_counts(lifted: DataFrame, genes: list[str], approved: DataFrame, **limits) -> DataFrame:
    """(candidates, skipped) among the features of the chosen genes."""
    mine = lifted.where(F.col("gene").isin(genes)).agg(F.count("*").alias("all"))
    kept = fasta_rows(lifted, genes, approved, **limits).agg(F.count("*").alias("candidates"))
    return mine.crossJoin(kept).select("candidates", (F.col("all") - F.col("candidates")).alias("skipped"))


def display_frame(lifted: DataFrame, reference_names: DataFrame) -> DataFrame:
    """What a reader of results sees: the reference's gene names, coverage to three places."""
    return display_rows(lifted, reference_names).select("record_id", "gene", "status", "method", "query_start", "query_end", "strand", rounded(F.col("coverage"), 3).alias("coverage"), "identity")


def percent(x: Column, places: int = 1) -> Column:
    """A share as text with a percent sign; a dash where it is null."""
    return F.coalesce(F.format_string(f"%.{places}f%%", x * 100), F.lit("-"))
