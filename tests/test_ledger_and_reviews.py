"""The stateful ledger, the review cache, and counters of one pass."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.operators import review_cache
from strandline.plans.review import ReviewError
from strandline.streaming import ledger

SCHEMA = "accession string, ts timestamp, organism string"
START = datetime(2024, 1, 1)


def put(spark, folder, n, rows):
    """One more file of the stream, with times in hours."""
    lines = [json.dumps({"accession": a, "ts": (START + timedelta(hours=h)).isoformat(), "organism": o}) for a, h, o in rows]
    (folder / f"{n}.json").write_text("\n".join(lines))


def test_replay_equals_the_anti_join_and_the_state_is_bounded(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    run = lambda: ledger.run_once(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)), target, checkpoint, "ts", "1 hour", 10 * 3_600_000)
    got = lambda: sorted((r["accession"], r["organism"]) for r in spark.read.schema(SCHEMA).parquet(target).collect())
    put(spark, source, 0, [("A", 2, "late"), ("A", 1, "first"), ("B", 1, "b"), (None, 1, "none")])
    put(spark, source, 1, [("B", 2, "again"), ("C", 3, "c")])
    run()
    batch = spark.read.schema(SCHEMA).json(str(source)).where("accession is not null")
    assert [a for a, _ in got()] == sorted(r[0] for r in batch.select("accession").distinct().collect()) and ("A", "first") in got()
    run()
    assert len(got()) == 3
    # Restarted with more: what is in the state does not pass, as in the anti-join.
    put(spark, source, 2, [("C", 4, "again"), ("D", 5, "d"), ("A", 5, "again")])
    run()
    assert [a for a, _ in got()] == ["A", "B", "C", "D"]
    # Far later the old ones are forgotten; what comes then begins a life of its own.
    put(spark, source, 3, [("E", 100, "e")])
    put(spark, source, 4, [("F", 101, "f")])
    put(spark, source, 5, [("A", 102, "anew"), ("E", 102, "again")])
    run()
    assert [a for a, _ in got()] == ["A", "A", "B", "C", "D", "E", "F"]
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint).select("key.accession").collect()
    assert sorted(r["accession"] for r in state) == ["A", "E", "F"]


def suggestions(spark, n, same=0):
    rows = [(f"r{i:03d}", f"name {i if i >= same else 0}", "gene", ["S", "M"][i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "review_id string, raw_value string, field string, guess string")


class Provider:
    def __init__(self, answer=None):
        self.calls, self.answer = [], answer or (lambda r: {"recommendation": "save_alias", "canonical_name": "S", "confidence": "high", "reason": "x"})

    def __call__(self, payload):
        self.calls.append(payload)
        return [{"review_id": r["review_id"], **self.answer(r)} for r in payload["rows"]]


def test_a_second_run_sends_nothing(spark, tmp_path):
    cache, provider = str(tmp_path / "cache"), Provider()
    ask = lambda rows, model="m", canonicals=("S", "M"): review_cache.review(rows, ["raw_value", "field", "guess"], provider, cache, list(canonicals), model, 20)
    rows = suggestions(spark, 12)
    first, told = ask(rows)
    assert (told.rows, told.cached, told.sent, told.answered, told.status) == (12, 0, 12, 12, "reviewed") and first.where("llm_reviewed").count() == 12
    second, told = ask(rows)
    assert (told.cached, told.sent, len(provider.calls)) == (12, 0, 1)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, first.collect()))
    # The key is the payload, the canonicals and the model; the row's own id is none of it.
    assert ask(rows.withColumn("review_id", F.concat("review_id", F.lit("x"))))[1].sent == 0
    assert ask(rows.withColumn("guess", F.lit("N")))[1].sent == 12
    assert ask(rows, "other")[1].sent == 12 and ask(rows, "m", ("S", "M", "N"))[1].sent == 12


def test_the_cap_counts_what_is_not_cached(spark, tmp_path):
    cache, provider = str(tmp_path / "cache"), Provider()
    ask = lambda rows: review_cache.review(rows, ["raw_value", "field"], provider, cache, ["S"], "m", 20)
    sent = [ask(suggestions(spark, 50, 5))[1].sent for _ in range(4)]
    assert sent == [20, 20, 6, 0]
    out, told = ask(suggestions(spark, 50, 5))
    assert out.where("llm_reviewed").count() == 50 and told.cached == 50
    asked = [r["raw_value"] for c in provider.calls for r in c["rows"]]
    assert len(asked) == len(set(asked)) == 46


def test_unusable_answers_and_failures(spark, tmp_path):
    rows = suggestions(spark, 4)
    odd = Provider(lambda r: {"recommendation": "save_alias", "canonical_name": "unknown", "confidence": "high"} if r["review_id"] < "r002" else {"recommendation": "dance", "confidence": "low"})
    out, told = review_cache.review(rows, ["raw_value"], odd, str(tmp_path / "a"), ["S"], "m")
    assert told.answered == 4 and out.where("llm_reviewed").count() == 0 and out.count() == 4

    def broken(_):
        raise ReviewError("no answer")

    out, told = review_cache.review(rows, ["raw_value"], broken, str(tmp_path / "b"), ["S"], "m")
    assert (told.status, told.error, told.sent) == ("error", "no answer", 4) and out.where("llm_reviewed").count() == 0
    assert review_cache.review(rows, ["raw_value"], None, str(tmp_path / "b"), ["S"], "m")[1].status == "disabled"
    assert review_cache.review(rows.limit(0), ["raw_value"], Provider(), str(tmp_path / "b"), ["S"], "m")[1].status == "nothing_to_review"
    # Answers of other rows, and rows without an answer, are left out.
    stray = lambda payload: [{"review_id": "zzz", "recommendation": "skip", "confidence": "low"}]
    assert review_cache.review(rows, ["raw_value"], stray, str(tmp_path / "c"), ["S"], "m")[1].answered == 0
