"""Counters of a run, taken by Spark while the rows pass on their way to a sink: no second scan, no further job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandline.schema import PASSING, REVIEWED, STATUSES


def observed(lifted: DataFrame) -> tuple[DataFrame, Observation]:
    """(lifted, to be written once; what counts it meanwhile). told() reads the counts when the write is done."""
    is_status = {s: F.count_if(F.col("status") == s) for s, *_ in STATUSES}
    known = F.coalesce(F.col("status").isin(*is_status), F.lit(False))
    counts = [F.count(F.lit(1)).alias("features"), F.count_if(~known).alias("other"), *(c.alias(f"status_{s}") for s, c in is_status.items())]
    counts += [F.count_if(F.col("method") == m).alias(f"method_{m}") for m in ("direct", "tblastn")]
    seen = Observation(f"run-{uuid.uuid4().hex}")
    return lifted.observe(seen, *counts), seen


def told(seen: Observation) -> dict:
    """features, passing, needs_review, pass_rate, statuses (all known ones, and other) and methods."""
    got = seen.get
    statuses = {s: got[f"status_{s}"] for s, *_ in STATUSES} | {"other": got["other"]}
    passing, review = (sum(statuses[s] for s in group) for group in (PASSING, REVIEWED))
    rate = int(passing * 1000 / got["features"] + 0.5) / 10 if got["features"] else 0.0
    return {"features": got["features"], "passing": passing, "needs_review": review, "pass_rate": rate, "statuses": statuses, "methods": {m: got[f"method_{m}"] for m in ("direct", "tblastn")}}
