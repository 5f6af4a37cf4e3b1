"""Review settings, answers and fallback; all queries have distinct names and SQL."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.plans import evidence_queries, names_queries, review


def test_settings():
    assert not review.ReviewConfig.from_env({}).usable
    env = {"STRANDLINE_REVIEW_ENABLED": "Yes", "STRANDLINE_REVIEW_URL": "http://x", "STRANDLINE_REVIEW_KEY": "k", "STRANDLINE_REVIEW_MODEL": "m", "STRANDLINE_REVIEW_FALLBACK": "f"}
    assert review.ReviewConfig.from_env(env).usable and not review.ReviewConfig.from_env(env | {"STRANDLINE_REVIEW_KEY": "CHANGEME"}).usable
    asked = []

    def post(url, key, body):
        asked.append(body["model"])
        if body["model"] == "m":
            raise OSError("down")
        rows = [{"review_id": "1", "recommendation": "save_alias", "canonical_name": "S", "confidence": "high"}, {"review_id": "2", "recommendation": "save_alias", "canonical_name": "Q", "confidence": "high"}, {"review_id": "3", "recommendation": "odd", "confidence": "low"}]
        return {"output": [{"content": [{"type": "output_text", "text": json.dumps({"reviews": rows})}]}]}

    got = review.provider(review.ReviewConfig.from_env(env), {"S"}, post)({"rows": []})
    assert [r["review_id"] for r in got] == ["1"] and asked == ["m", "f"]
    with pytest.raises(review.ReviewError):
        review.provider(review.ReviewConfig.from_env(env), {"S"}, lambda *a: {"output": []})({})
    assert review.provider(review.ReviewConfig(), set())({}) == []
    assert review.cache_key({"a": 1, "b": 2}) == review.cache_key({"b": 2, "a": 1})


def test_answer_column(spark):
    rows = spark.createDataFrame([('{"output_text": "a"}',), ('{"output": [{"content": [{"type": "text", "text": "b"}, {"type": "x", "text": "-"}]}, {}]}',), ("{}",), ("bad",), (None,)], "r string")
    assert [x[0] for x in rows.select(review.answer_text_column(F.col("r"))).collect()] == ["a", "b", None, None, None]


def test_queries_are_distinct():
    assert not set(names_queries.QUERIES) & set(evidence_queries.QUERIES)
    both = names_queries.QUERIES | evidence_queries.QUERIES
    assert set(both) - set(names_queries.SQL | evidence_queries.SQL) == {"native_hsp_search"}
