"""Alias suggestions from coordinate evidence, their dedup and demotion, and which of them need review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.intervals import iou, overlap_join, rounded
from strandline.functions.lineage import settled
from strandline.functions.names import DESCRIPTIVE_TERMS, GENERIC_NAMES, _norm, classify, norm, words

#: Names whose low score is final, and endings that leave a canonical what it is.
FINAL_NAMES = ("unknown", "unknown protein", "hypothetical protein", "putative protein", "protein", "viral protein", "gene", "orf", "open reading frame")
ENDINGS = ("protein", "polyprotein", "gene", "cds", "openreadingframe")


def best_overlap(queries: DataFrame, lifted: DataFrame, least: float = 0.90) -> DataFrame:
    """Each query feature with the lifted feature of highest IoU (the first of equals), where it reaches `least`.

    queries: record_id, q_idx, q_start, q_end, ...; lifted: record_id, l_idx, l_start, l_end, ....
    """
    met = overlap_join(queries, lifted, ["record_id"], ("q_start", "q_end"), ("l_start", "l_end"))
    met = met.withColumn("iou", iou(F.col("q_start"), F.col("q_end"), F.col("l_start"), F.col("l_end")))
    best = Window.partitionBy("record_id", "q_idx").orderBy(F.col("iou").desc(), "l_idx")
    return met.withColumn("_n", F.row_number().over(best)).where((F.col("_n") == 1) & (F.col("iou") >= least)).drop("_n").withColumn("iou", rounded(F.col("iou"), 4))


def classified(rows: DataFrame) -> DataFrame:
    """rows (raw_value, field, canonical_name, iou, strand_match) with score, suggested_action, confidence, default_save, reason."""
    c = rows.withColumn("_c", classify(F.col("raw_value"), F.col("field"), F.col("canonical_name"), F.col("iou"), F.col("strand_match")))
    return c.withColumns({"score": F.col("_c.score"), "suggested_action": F.col("_c.action"), "confidence": F.col("_c.confidence"), "default_save": F.col("_c.default_save"), "reason": F.col("_c.reason")}).drop("_c")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each (normal form, field, canonical): the best score, the first of equals by ord; with its support.

    ord is any column that has an order. Of the records of a name only ten are ever gathered; the others are counted.
    """
    key, value = ["norm", "field", "canonical_name"], [c for c in rows.columns if c not in ("field", "canonical_name")]
    keyed = rows.withColumns({"norm": norm(F.col("raw_value")), "field": F.coalesce("field", F.lit("")), "canonical_name": F.coalesce("canonical_name", F.lit(""))})
    best = F.min_by(F.struct(*value), F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")))
    # By record first, and settled: what is behind the rows is then computed once, and a common name's rows are summed early.
    each = settled(keyed.groupBy(*key, F.coalesce("record_id", F.lit("")).alias("_id")).agg(best.alias("r"), F.min("ord").alias("first_ord")))
    one = each.groupBy(*key).agg(F.min_by("r", F.struct((-F.col("r.score")).alias("s"), F.col("r.ord").alias("o"))).alias("r"), F.min("first_ord").alias("first_ord"), F.count_if(F.col("_id") != "").cast("int").alias("_all"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_id"))
    first = each.where("_id <> ''").select(*key, "_id").withColumn("_n", rank).where("_n <= 10").groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("_id")), ", ").alias("_first"))
    more = F.when(F.col("_all") > 10, F.format_string(", ... (+%d)", F.col("_all") - 10)).otherwise("")
    return one.join(first, key, "left").select(*key, *(F.col(f"r.{c}").alias(c) for c in value), "first_ord", F.col("_all").alias("support_count"), F.coalesce(F.concat("_first", more), F.lit("")).alias("support_records"))


def demoted(rows: DataFrame) -> DataFrame:
    """Names that land on several canonicals: on two they need review, on three or more they are ignored for good."""
    targets = rows.where("norm <> ''").groupBy("norm", "field").agg(F.sort_array(F.collect_set(F.nullif("canonical_name", F.lit("")))).alias("t"))
    r = rows.join(targets, ["norm", "field"], "left").withColumn("n", F.coalesce(F.size("t"), F.lit(0)))
    shared, out = F.col("n") > 1, F.col("n") >= 3
    text = F.concat(F.lit("appears with multiple canonical targets: "), F.array_join("t", ", "))
    return r.withColumns({
        "shared_across_canonicals": shared,
        "cross_canonical_targets": F.coalesce("t", F.array().cast("array<string>")),
        "cross_canonical_target_count": F.col("n"),
        "cross_canonical_auto_excluded": out,
        "reason": F.when(shared, F.concat_ws("; ", F.nullif("reason", F.lit("")), text)).otherwise(F.col("reason")),
        "default_save": ~shared & F.col("default_save"),
        "suggested_action": F.when(out, "ignore").when(shared, "manual_review").otherwise(F.col("suggested_action")),
        "confidence": F.when(out, "high").when(shared, "medium").otherwise(F.col("confidence")),
        "score": F.when(out, F.least("score", F.lit(0))).when(shared, F.least("score", F.lit(5))).otherwise(F.col("score")),
    }).drop("t", "n")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows to save first, then those to review; by score, canonical and name."""
    return rows.orderBy(F.col("suggested_action") != "save_alias", F.col("suggested_action") != "manual_review", F.col("score").desc(), "canonical_name", "raw_value", "first_ord")


def seed_override(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows whose name is a seed canonical (seeds: canonical) take it for their canonical."""
    known = seeds.select(norm(F.col("canonical")).alias("_n"), F.col("canonical").alias("canonical_override")).dropDuplicates(["_n"])
    return rows.join(known, norm(F.col("raw_value")) == F.col("_n"), "left").withColumn("canonical_name", F.coalesce("canonical_override", "canonical_name")).drop("_n")


def risky_shape(raw: Column, canonical: Column) -> Column:
    r, c = norm(raw), norm(canonical)
    root = lambda x: F.regexp_extract(x, r"(?i)\borf\s*([0-9]+)", 1)
    family = (root(r) != "") & (root(r) == root(c))
    described = F.arrays_overlap(words(raw), F.array(*map(F.lit, DESCRIPTIVE_TERMS)))
    return F.coalesce(raw, F.lit("")).rlike("[;/,]") | F.coalesce(raw, F.lit("")).rlike(r"(?i)\bor\b") | F.when(family, r != c).otherwise(described & (r != c))


def direct_signal(raw: Column, canonical: Column) -> Column:
    r, c = norm(raw), norm(canonical)
    out = r == c
    for ending in ENDINGS:
        out = out | (r == F.concat(c, F.lit(ending)))
    return (r != "") & (c != "") & out


def specific_looking(raw: Column) -> Column:
    r, x = norm(raw), F.coalesce(raw, F.lit(""))
    barred = (r == "") | r.isin([_norm(g) for g in GENERIC_NAMES])
    return ~barred & (x.rlike(r"(?i)\borf\s*[0-9]+[a-z]?\b") | F.trim(x).rlike("^[A-Za-z]{1,4}[0-9]+[A-Za-z]?$") | risky_shape(x, F.lit("")))


def needs_review(row: dict[str, Column] | None = None) -> Column:
    """Whether a suggestion goes to review; the first rule that applies decides."""
    c = {k: F.col(k) for k in ("raw_value", "canonical_name", "suggested_action", "confidence", "support_count", "iou", "cross_canonical_auto_excluded")} | (row or {})
    raw, action, confidence = c["raw_value"], c["suggested_action"], c["confidence"]
    supported = (F.coalesce(c["support_count"], F.lit(0)) >= 2) | (F.coalesce(c["iou"], F.lit(0.0)) >= 0.90)
    low = ~norm(raw).isin([_norm(n) for n in FINAL_NAMES]) & supported & F.arrays_overlap(words(raw), F.array(*map(F.lit, DESCRIPTIVE_TERMS)))
    return (
        F.when(F.coalesce(c["cross_canonical_auto_excluded"], F.lit(False)), False)
        .when((action == "manual_review") | (confidence == "medium"), True)
        .when((action == "ignore") & specific_looking(raw), True)
        .when(direct_signal(raw, c["canonical_name"]), False)
        .when((action == "ignore") & (confidence == "low"), low)
        .when((confidence == "high") & risky_shape(raw, c["canonical_name"]), True)
        .otherwise(False)
    )


def valid_reviews(reviews: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Reviews with known values; one that saves an alias must name a known canonical."""
    known = canonicals.select(F.col("canonical").alias("canonical_name")).distinct().withColumn("_k", F.lit(True))
    rows = reviews.where(F.col("recommendation").isin("save_alias", "ignore", "move_to_ambiguous", "skip") & F.col("confidence").isin("low", "medium", "high"))
    return rows.join(known, "canonical_name", "left").where("recommendation <> 'save_alias' or _k").drop("_k")


def merged_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """rows with what the review of their review_id says, null where there is none."""
    r = reviews.select("review_id", F.lit(True).alias("_r"), F.col("recommendation").alias("llm_action"), F.col("canonical_name").alias("llm_canonical_name"), F.col("confidence").alias("llm_confidence"), F.col("reason").alias("llm_reason"))
    return rows.join(r, "review_id", "left").withColumn("llm_reviewed", F.coalesce("_r", F.lit(False))).drop("_r")


def reviews_by_value(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """rows (key, candidate_values) with the review that one of their values names, compared by normal form.

    reviews: raw_value, recommendation, canonical_name, confidence, reason. The first of a row's values that has a review
    counts, and of several reviews of one value the first by their fields; rows without one have nulls.
    """
    r = F.struct("raw_value", "recommendation", "canonical_name", "confidence", "reason")
    named = reviews.select(norm(F.col("raw_value")).alias("_n"), r.alias("_r")).where("_n <> ''").groupBy("_n").agg(F.min("_r").alias("_r"))
    values = rows.select("key", F.posexplode("candidate_values").alias("_k", "_v")).select("key", "_k", norm(F.col("_v")).alias("_n"))
    found = values.join(named, "_n").groupBy("key").agg(F.min_by("_r", "_k").alias("_r"))
    out = rows.join(found, "key", "left")
    return out.select(*rows.columns, F.col("_r.recommendation").alias("llm_action"), F.col("_r.canonical_name").alias("llm_canonical_name"), F.col("_r.confidence").alias("llm_confidence"), F.col("_r.reason").alias("llm_reason"), F.col("_r").isNotNull().alias("llm_reviewed"))


def review_id(*values: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(v, F.lit("")) for v in values))), 1, 12)


def default_action() -> Column:
    """What a reviewed suggestion does unless someone decides otherwise. known_canonical: the review's canonical exists."""
    trusted = F.col("llm_reviewed") & F.col("llm_confidence").isin("medium", "high")
    return (
        F.when(F.col("llm_reviewed") & (F.col("llm_action") == "skip"), "skip")
        .when(trusted & (F.col("llm_action") == "save_alias") & F.col("known_canonical"), "save")
        .when(trusted & F.col("llm_action").isin("ignore", "move_to_ambiguous"), "ignore")
        .when(F.col("default_save") | (F.col("suggested_action") == "save_alias"), "save")
        .when(F.col("suggested_action") == "ignore", "ignore")
        .otherwise("skip")
    )


def mock_provider(payload: dict) -> list[dict]:
    """A provider that needs no network: everything is to be skipped with low confidence."""
    return [{"review_id": r["review_id"], "recommendation": "skip", "canonical_name": None, "confidence": "low", "reason": "mock"} for r in payload["rows"]]


def applied(terms: DataFrame, excluded: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, excluded) after decisions (raw_value, canonical_name, action, ord): saved names become aliases and leave the exclusions.

    Of names with one normal form the first by ord counts; exclusions (name, perhaps ord) come before what is ignored now.
    """
    saved = decisions.where("action = 'save'").select(F.col("canonical_name").alias("canonical"), F.col("raw_value").alias("alias"), (F.col("ord") + (1 << 20)).alias("ord"))
    known = terms.select("canonical", norm(F.col("alias")).alias("_n")).union(terms.select("canonical", norm(F.col("canonical"))))
    fresh = saved.withColumn("_n", norm(F.col("alias"))).join(known, ["canonical", "_n"], "left_anti")
    fresh = fresh.groupBy("canonical", "_n").agg(F.min(F.struct("ord", "alias")).alias("x")).select("canonical", "x.alias", "x.ord")
    place = F.col("ord") if "ord" in excluded.columns else F.lit(0).alias("ord")
    barred = excluded.select("name", F.lit(0).alias("late"), place).union(decisions.where("action = 'ignore'").select("raw_value", F.lit(1), "ord")).withColumn("_n", norm(F.col("name"))).where("_n <> ''")
    barred = barred.groupBy("_n").agg(F.min(F.struct("late", "ord", "name"))["name"].alias("name"))
    return terms.select("canonical", "alias", "ord").unionByName(fresh.select("canonical", "alias", "ord")), barred.join(saved.select(norm(F.col("alias")).alias("_n")), "_n", "left_anti").select("name")
