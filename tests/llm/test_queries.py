"""The registered queries: contract columns and types, on small and on empty tables."""

import pytest

pytest.importorskip("public_tokenizers")

CONTRACT = {
    "op1": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3": {"doc_id": "bigint", "text": "string"},
    "op4": {"doc_id": "bigint", "item_id": "bigint"},
    "op5": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6": {"doc_id": "bigint", "component_id": "bigint", "removed": "boolean"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op11": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}
DOCS = [(1, "the house and the thing"), (2, None), (3, ""), (None, "no id here"), (4, "the house and the thing"), (4, "the house and the thing"), (7, "call +1 (017) 555-7713 now")]


def write(spark, path, empty):
    keep = (lambda rows: rows[:0]) if empty else (lambda rows: rows)
    spark.createDataFrame(keep([(d, t, "en", "s", 1) for d, t in DOCS]), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(keep([(1, "http://a.org/x", "<p>"), (None, None, None)]), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(keep([(1, "the house and the thing"), (2, None)]), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(keep([(1, 1, 0), (3, None, 1), (7, 1, None)]), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(keep([(0, [0.5, 0.25], 1), (1, [0.5, 0.2], 1), (2, [0.2, 0.1], 2), (3, None, None)]), "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_names():
    from strandline.llm.queries import QUERIES, SQL

    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"] and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("empty", [False, True])
def test_contracts(spark, tmp_path, empty):
    from strandline.llm.queries import QUERIES

    write(spark, tmp_path, empty)
    for name, f in QUERIES.items():
        got = f(spark, str(tmp_path))
        kinds, want = dict(got.dtypes), CONTRACT.get(name.split("_")[0], {})
        assert {c: kinds.get(c) for c in want} == want, name
        n = got.count()
        if empty:
            assert n == 0, name
        elif name.split("_")[0] in ("op1", "op3", "op5", "op7", "op9", "op10", "op11"):
            assert n == len(DOCS), name
