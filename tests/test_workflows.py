"""Composite runs and the command line on small files."""

import json

import pytest
from pyspark.sql import functions as F
import random

from pyspark.sql import functions as F

from strandline.__main__ import main
from strandline.plans import workflows
from strandline.plans.annotate import annotate, prepare_reference
from strandline.schema import RECORD
from strandline.sources import genbank, tables

CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG" if a + b + c not in ("TAA", "TAG", "TGA")]
REGISTRY = {"viruses": [{"virus_name": "Test virus", "keywords": ["testv"], "alias_config": "t.json"}]}


def world():
    rng, spans, seq = random.Random(11), {}, "".join(random.Random(1).choice("ACGT") for _ in range(90))
    for name, n in (("S", 90), ("M", 70), ("N", 50)):
        g = "ATG" + "".join(rng.choice(CODONS) for _ in range(n - 2)) + "TAA"
        spans[name] = (len(seq) + 1, len(seq) + len(g))
        seq += g + "".join(rng.choice("ACGT") for _ in range(60))
    return seq, spans


def record(rid, seq, features, organism="Test virus x"):
    return (rid, rid.split(".")[0], "d", organism, seq, len(seq), [("CDS", *span, "+", {key: [value]}) for span, key, value in features])


def test_suggestions_and_payloads(spark):
    seq, at = world()
    ref = spark.createDataFrame([record("R.1", seq, [(at[n], "gene", n) for n in at])], RECORD)
    terms, excluded, _ = tables.config_tables(spark, {"canonical_names": {"S": ["spike"], "M": [], "N": []}, "excluded_names": ["unknown"]})
    prepared = prepare_reference(ref, terms, excluded)
    rows = [record(f"Q{i}.1", seq, [(at["S"], "product", "spike protein"), (at["M"], "gene", "HN1"), (at["N"], "gene", "HN1"), ((3, 50), "gene", "S")]) for i in range(3)]
    rows.append(record("Q9.1", seq, [], "other"))
    records = spark.createDataFrame(rows, RECORD)
    suggestions = workflows.coordinate_suggestions(records, prepared).persist()
    got = {(r["norm"], r["canonical_name"]): r for r in suggestions.collect()}
    assert set(got) == {("spikeprotein", "S"), ("hn1", "M"), ("hn1", "N")}
    assert got["spikeprotein", "S"]["support_count"] == 3 and got["hn1", "M"]["suggested_action"] == "manual_review" and got["hn1", "M"]["needs_review"]
    payload = workflows.suggestion_payload(suggestions, ["S", "M", "N"], "t", 1).collect()
    assert len(payload) == 1 and json.loads(payload[0]["payload"])["suggestion"]["raw_value"] == "HN1"
    statuses, unresolved = workflows.record_statuses(records, tables.registry_table(spark, REGISTRY, with_name=True), prepared)
    assert {r["record_id"]: r["status"] for r in statuses.collect()} == {"Q0.1": "has_unresolved", "Q1.1": "has_unresolved", "Q2.1": "has_unresolved", "Q9.1": "new_virus"}
    coding = unresolved.select("record_id", "ord", "start", "end", F.lit(None).cast("string").alias("canonical"))
    bodies = [json.loads(r["payload"]) for r in workflows.unresolved_payload(unresolved, coding, ["S", "M", "N"], "t").collect()]
    assert {b["raw_value"] for b in bodies} == {"spike protein", "HN1"}
    assert {r["counter"] for r in workflows.diagnostics(records, prepared, suggestions).collect()} >= {"records", "features CDS"}
    assert list(workflows.seed_config("t", genbank.features_of(ref, "CDS"))["canonical_names"]) == ["S", "M", "N"]


def test_evaluation(spark):
    seq, at = world()
    ref = spark.createDataFrame([record("R.1", seq, [(at[n], "gene", n) for n in at])], RECORD)
    terms, excluded, _ = tables.config_tables(spark, {"canonical_names": {"S": [], "M": [], "N": []}})
    prepared = prepare_reference(ref, terms, excluded)
    bare = spark.createDataFrame([record("Q.1", seq, [])], RECORD)
    truth = spark.createDataFrame([record("Q.1", seq, [(at["S"], "gene", "S"), ((at["M"][0] + 3, at["M"][1]), "gene", "M")])], RECORD)
    rows, accuracy = workflows.evaluation(annotate(bare, prepared).lifted, truth, prepared)
    total = accuracy.where("record_id is null").first()
    assert (total["total"], total["matched"], total["perfect"], total["not_in_actual"], total["perfect_pct"]) == (3, 2, 1, 1, 50.0)
    assert {r["name"]: r["start_diff"] for r in rows.collect()} == {"S": 0, "M": -3, "N": None}


def test_command_line(spark, tmp_path, capsys):
    seq, at = world()
    texts = {"ref.gb": [record("R.1", seq, [(at[n], "gene", n) for n in at])], "q.gb": [record("A.1", seq[5:], []), record("A.1", seq, []), record("B.1", seq, [], "odd")]}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(genbank.format_record(*r[:5], [dict(zip(("type", "start", "end", "strand", "qualifiers"), f)) for f in r[6]]) for r in rows))
    (tmp_path / "registry.json").write_text(json.dumps(REGISTRY))
    (tmp_path / "c.json").write_text(json.dumps({"canonical_names": {"S": [], "M": [], "N": []}}))
    main(["annotate", "--reference", str(tmp_path / "ref.gb"), "--query", str(tmp_path / "q.gb"), "--output", str(tmp_path / "out"), "--alias-config", str(tmp_path / "c.json")])
    lines = [x for p in (tmp_path / "out/tsv").glob("part-*") for x in p.read_text().splitlines()]
    # Both records that bear the id A.1 are annotated, and the third.
    assert sum("ok_rescued" in x for x in lines) == 9
    for _ in range(2):
        main(["crawl", "--raw", str(tmp_path / "q.gb"), "--registry", str(tmp_path / "registry.json"), "--ledger", str(tmp_path / "ledger"), "--output", str(tmp_path / f"split{_}")])
    first, second = (sorted((r["accession"], r["status"], r["output_file"]) for r in tables.read_manifest(spark, str(tmp_path / f"split{i}/manifest")).collect()) for i in range(2))
    assert [s for _, s, _ in first] == ["dup_in_batch", "new", "new"] and [s for _, s, _ in second] == ["dup_in_ledger"] * 3
    assert "test_virus" in " ".join(p.name for p in (tmp_path / "split0/species").iterdir())
    main(["summary", "--query", str(tmp_path / "ref.gb")])
    assert "total" in capsys.readouterr().out


def test_crawl_fetches_by_query_and_accessions(spark, tmp_path, capsys):
    from service import Service

    from strandline.__main__ import crawl, parser

    seq, at = world()
    text = genbank.format_record(*record("A.1", seq, [])[:5], [])
    service = Service(lambda name: text.replace("A.1", name), 1, "A.1")
    (tmp_path / "registry.json").write_text(json.dumps(REGISTRY))
    (tmp_path / "acc.txt").write_text("# wanted\nB.1\n")
    common = ["crawl", "--registry", str(tmp_path / "registry.json"), "--ledger", str(tmp_path / "ledger"), "--output", str(tmp_path / "out"), "--email", "a@b.c", "--base", service.base]
    crawl(spark, parser().parse_args([*common, "--query", "x", "--count"]))
    assert capsys.readouterr().out.strip().splitlines()[-1] == "1"
    crawl(spark, parser().parse_args([*common, "--query", "x", "--accessions", str(tmp_path / "acc.txt")]))
    got = sorted((r["accession"], r["status"]) for r in tables.read_manifest(spark, str(tmp_path / "out/manifest")).collect())
    assert got == [("A.1", "new"), ("B.1", "new")]
    with pytest.raises(SystemExit):
        crawl(spark, parser().parse_args(["crawl"]))
    service.stop()


def test_registry_chooses_the_alias_configuration(spark, tmp_path):
    seq, at = world()
    (tmp_path / "ref.gb").write_text(genbank.format_record(*record("R.1", seq, [(at[n], "gene", n) for n in at])[:5], [dict(zip(("type", "start", "end", "strand", "qualifiers"), f)) for f in record("R.1", seq, [(at[n], "gene", n) for n in at])[6]]))
    (tmp_path / "c.json").write_text(json.dumps({"canonical_names": {"Spike": ["S"], "M": [], "N": []}}))
    (tmp_path / "registry.json").write_text(json.dumps({"viruses": [{"virus_name": "Odd", "keywords": ["nothing like it"], "alias_config": "none.json"}, {"virus_name": "Mine", "keywords": ["r.1"], "alias_config": "elsewhere/c.json"}]}))
    main(["names", "--reference", str(tmp_path / "ref.gb"), "--query", str(tmp_path / "ref.gb"), "--output", str(tmp_path / "names"), "--registry", str(tmp_path / "registry.json")])
    main(["evaluate", "--reference", str(tmp_path / "ref.gb"), "--query", str(tmp_path / "ref.gb"), "--output", str(tmp_path / "eval"), "--registry", str(tmp_path / "registry.json")])
    lines = [x for f in (tmp_path / "eval/features").glob("part-*") for x in f.read_text().splitlines()]
    assert any("Spike" in x and "matched" in x for x in lines)


def test_flat_files_with_either_line_end(spark, tmp_path):
    seq, _ = world()
    text = "".join(genbank.format_record(*record(f"A.{i}", seq, [])[:5], []) for i in range(3))
    for name, end in (("unix.gb", "\n"), ("dos.gb", "\r\n")):
        (tmp_path / name).write_bytes(text.replace("\n", end).encode())
        got = genbank.read_genbank(spark, str(tmp_path / name)).collect()
        assert sorted((r["record_id"], r["seq"]) for r in got) == [(f"A.{i}", seq) for i in range(3)]
    (tmp_path / "registry.json").write_text(json.dumps(REGISTRY))
    rows = workflows.split_crawl(spark, str(tmp_path / "*.gb"), REGISTRY, str(tmp_path / "ledger"), str(tmp_path / "out")).collect()
    assert sorted((r["accession"], r["status"]) for r in rows) == sorted((f"A.{i}", s) for i in range(3) for s in ("new", "dup_in_batch"))


def test_registries_of_any_size(spark):
    from strandline.operators import crawl

    registry = spark.range(12_000).selectExpr("cast(id as int) as ord", "0 as kw_ord", "concat('Word', id) as keyword", "concat('v', id) as virus").union(spark.createDataFrame([(500, 1, "qz", "short"), (3, 5, "", "none")], "ord int, kw_ord int, keyword string, virus string"))
    texts = spark.createDataFrame([("a word11999 b",), ("word9 Word7",), ("xqzx WORD777",), ("xqzx word12",), ("nothing",), (None,), ("",)], "text string")
    wide = {r["text"]: r["virus"] for r in crawl.keyword_match(texts, "text", registry).collect()}
    assert wide == {"a word11999 b": "v1", "word9 Word7": "v7", "xqzx WORD777": "v7", "xqzx word12": "v1", "nothing": None, None: None, "": None}
    some = registry.where("ord < 600")
    assert {r["text"]: r["virus"] for r in crawl.keyword_match(texts, "text", some).collect()} == {r["text"]: r["virus"] for r in crawl.keyword_match(texts, "text", some, most=5).collect()}
    got = {r["rid"]: r["ord"] for r in crawl.numbered(spark.range(5000).selectExpr("id * 7 % 5000 as rid").repartition(7), "rid").collect()}
    assert got == {i: i + 1 for i in range(5000)}


def test_alias_tables_of_any_size(spark):
    from strandline.operators import alias

    lookup = spark.createDataFrame([("s", "S"), ("spike", "S"), ("m", "M"), ("unknown", alias.SENTINEL), ("both", alias.AMBIGUOUS), ("a;b", "AB")], "norm string, target string")
    rows = [(1, "Spike", None), (2, "unknown; m", "x"), (3, "x; unknown; both", "S"), (4, "", "nothing"), (5, "a;b", "unknown"), (6, "both", "unknown"), (7, "M;S", "m")]
    features = spark.createDataFrame(rows, "ord int, gene string, product string").withColumn("name", F.coalesce("gene", "product"))
    few, many = (sorted(tuple(r) for r in alias.resolve(features, lookup, most=n).select("ord", "name", F.coalesce("alias_source_value", F.lit("-")), "name_source").collect()) for n in (100, 2))
    assert few == many and few[0] == (1, "S", "Spike", "alias") and few[2][3] == "alias_conflict_resolved"
    chain = spark.range(1, 3000).selectExpr("concat('n', id) as name", "case when id % 1000 <> 1 then concat('n', id - 1) end as parent").limit(60)
    got = {(r["name"], r["ancestor"]): r["distance"] for r in alias.parent_closure(chain).collect()}
    assert got == {(f"n{i}", f"n{j}"): i - j for i in range(2, 61) for j in range(1, i)}
    loop = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("x", "p")], "name string, parent string")
    got = {(r["name"], r["ancestor"]): r["distance"] for r in alias.parent_closure(loop).collect()}
    assert got[("p", "p")] == 3 and got[("x", "r")] == 3 and len(got) == 12
