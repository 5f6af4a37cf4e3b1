"""Reviews by a language model with a cache that is a table: each payload is sent to a model once, over all runs.

A row's key is the SHA-256 of its payload, the canonicals it may choose from, and the model, so a change of any of them asks
anew. Rows in the cache are taken out by an anti-join before the number of rows that are sent is capped; no more than that
many reach the driver. Answers are appended to the cache as they came, and the merge reads the cache, so that what a run
cut off, or capped, is sent by the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.review import ACTIONS, CONFIDENCES, ReviewError

ANSWER = "cache_key string, recommendation string, canonical_name string, confidence string, reason string"


@dataclass(frozen=True)
class Told:
    """What became of a review: status is reviewed, nothing_to_review, disabled or error."""

    rows: int = 0
    cached: int = 0
    sent: int = 0
    answered: int = 0
    status: str = "reviewed"
    error: str | None = None


def cache_key(payload: Column, canonicals: list[str], model: str) -> Column:
    """payload: a struct column; its fields go in by name, nulls left out."""
    return F.sha2(F.concat_ws("\u0001", F.to_json(payload), F.lit(json.dumps(sorted(canonicals), ensure_ascii=False)), F.lit(model)), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached answers, one for each key: the one that comes first by its text; a cache that is not there yet is empty."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(ANSWER).json(path)
        rows.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWER)
    return rows.groupBy("cache_key").agg(F.min(F.struct("recommendation", "canonical_name", "confidence", "reason")).alias("a")).select("cache_key", "a.*")


def review(rows: DataFrame, payload: list[str], provider: Callable[[dict], list[dict]] | None, cache: str, canonicals: list[str], model: str, most: int = 20, order: str = "review_id") -> tuple[DataFrame, Told]:
    """(rows with llm_reviewed, llm_action, llm_canonical_name, llm_confidence and llm_reason; what was done).

    rows: review_id and the payload columns. provider(payload) answers a list of reviews by review_id; None is no provider.
    Answers outside the known actions and confidences, or that save an alias of no canonical, are kept in the cache, and are
    no review. Rows with one payload are sent once.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("cache_key", cache_key(F.struct(*sorted(payload)), canonicals, model))
    new = keyed.join(read_cache(spark, cache).select("cache_key"), "cache_key", "left_anti")
    first = new.groupBy("cache_key").agg(F.min(F.struct(*dict.fromkeys([order, "review_id", *sorted(payload)]))).alias("x")).select("cache_key", "x.*")
    total, asked = keyed.count(), first.orderBy(order, "cache_key").limit(max(1, most)).collect()
    known = total - new.count()
    told = Told(total, known, status="nothing_to_review") if not total else Told(total, known)
    if asked and provider is None:
        told = Told(total, known, status="disabled")
    elif asked:
        by_id = {r["review_id"]: r["cache_key"] for r in asked}
        try:
            answers = provider({"model": model, "canonical_names": sorted(canonicals), "rows": [{"review_id": r["review_id"], **{c: r[c] for c in sorted(payload)}} for r in asked]})
            lines = [(by_id[a["review_id"]], *(a.get(c) for c in ("recommendation", "canonical_name", "confidence", "reason"))) for a in answers if a.get("review_id") in by_id]
            if lines:
                spark.createDataFrame(lines, ANSWER).coalesce(1).write.mode("append").json(cache)
            told = Told(total, known, len(asked), len(lines))
        except ReviewError as e:
            told = Told(total, known, len(asked), 0, "error", str(e))
    usable = F.col("recommendation").isin(*ACTIONS) & F.col("confidence").isin(*CONFIDENCES) & ((F.col("recommendation") != "save_alias") | F.col("canonical_name").isin(*canonicals))
    answered = read_cache(spark, cache).where(usable)
    names = {"recommendation": "llm_action", "canonical_name": "llm_canonical_name", "confidence": "llm_confidence", "reason": "llm_reason"}
    out = keyed.join(answered.withColumnsRenamed(names), "cache_key", "left").withColumn("llm_reviewed", F.col("llm_action").isNotNull())
    return out.drop("cache_key"), told
