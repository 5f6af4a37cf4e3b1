"""Sources, sinks, suggestions and the ledger stream."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import crawl, nucleotide, review_cache, suggest
from strandline.schema import RECORD
from strandline.sources import genbank, ncbi, sinks, tables
from strandline.streaming import ledger

FEATURES = [("source", 1, 130, "+", {"organism": ["Test virus"]}), ("CDS", 5, 64, "-", {"gene": ["S"], "note": ['a "quoted" note']}), ("CDS", 70, 99, "+", {"product": ["matrix"]})]


@pytest.fixture
def flat(tmp_path):
    text = "".join(genbank.format_record(f"AB{i}.1", f"AB{i}", "some virus", "Test virus" if i else "", "ACGTTGCAAC" * 13, [dict(zip(("type", "start", "end", "strand", "qualifiers"), f)) for f in FEATURES]) for i in range(3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gb").write_text(text)
    return str(tmp_path / "in")


def test_genbank_both_ways(spark, flat):
    spark.dataSource.register(genbank.GenBankSource)
    one = sorted(spark.read.format("genbank").load(flat).collect())
    two = sorted(genbank.read_genbank(spark, flat).collect())
    assert one == two and len(one) == 3
    assert one[0]["record_id"] == "AB0.1" and one[0]["organism"] == "Test virus" and one[0]["seq"] == "ACGTTGCAAC" * 13
    assert [tuple(f) for f in one[1]["features"]] == FEATURES
    rows = genbank.features_of(genbank.read_genbank(spark, flat), "CDS").where("record_id = 'AB1.1'").orderBy("ord").collect()
    assert [(r["name"], r["ord"], r["length"], r["strand"]) for r in rows] == [("S", 1, 60, "-"), ("matrix", 2, 30, "+")]
    with pytest.raises(ValueError, match="several"):
        genbank.single_genbank(spark, flat)


@pytest.mark.parametrize(("text", "want"), [("join(5..10,20..30)", (5, 30, "+")), ("complement(<5..>10)", (5, 10, "-")), ("J00194.1:100..202", (100, 202, "+")), ("7", (7, 7, "+"))])
def test_locations(text, want):
    assert genbank.parse_location(text) == want


def test_results_have_a_header_without_rows(spark, tmp_path):
    from strandline.schema import LIFTED

    sinks.write_results(spark.createDataFrame([], LIFTED), str(tmp_path / "out"), single=True)
    lines = [line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert lines == ["\t".join(sinks.RESULT_COLUMNS)] and len(sinks.RESULT_COLUMNS) == 20


def test_config_round_trip(spark, tmp_path):
    config = {"virus": "v", "notes": "", "excluded_names": ["u"], "canonical_names": {"A": ["x", "y"], "B": {"aliases": ["z"], "parent": "A"}}}
    path = str(tmp_path / "c.json")
    assert sinks.save_config(config, path) is None
    kept = sinks.save_config(config, path)
    assert kept and json.loads(open(kept).read()) == config
    terms, excluded, links = tables.read_alias_config(spark, path)
    assert tables.tables_config("v", terms, excluded, links) == config
    with pytest.raises(ValueError, match="canonical_names"):
        tables.check_alias_config({"canonical_names": []})
    assert tables.free_path(path).endswith("c_2.json")


def test_registry(spark):
    registry = {"viruses": [{"virus_name": "V one", "keywords": ["v1"], "alias_config": "a.json"}]}
    more = tables.upsert_entry(tables.upsert_entry(registry, "V one", ["V1", "vee"], "a.json"), "W", ["w"], "w.json")
    assert [e["keywords"] for e in more["viruses"]] == [["v1", "vee"], ["w"]]
    assert [e["virus_name"] for e in tables.remove_entry(more, "v ONE")["viruses"]] == ["W"]
    rows = spark.createDataFrame([("x V ONE y",), ("the w thing",), ("none",), (None,)], "organism string")
    got = [r["virus"] for r in crawl.keyword_match(rows, "organism", tables.registry_table(spark, more, with_name=True)).collect()]
    assert got == ["V one", "W", None, None]


def test_accessions_ledger_and_dedup(spark, tmp_path):
    (tmp_path / "acc.txt").write_text("# note\nA1, A2 A3\n\n A4\n")
    assert [r[0] for r in tables.read_accessions(spark, str(tmp_path / "acc.txt")).collect()] == ["A1", "A2", "A3", "A4"]
    path = str(tmp_path / "ledger")
    assert tables.read_ledger(spark, path).count() == 0
    rows = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), ("C", 4)], "accession string, ord int")
    sinks.append_ledger(spark.createDataFrame([("C", "new")], "accession string, status string"), path)
    got = crawl.dedup_status(rows, tables.read_ledger(spark, path)).orderBy("ord").collect()
    assert [r["status"] for r in got] == ["new", "new", "dup_in_batch", "dup_in_ledger"]


def test_alignment_readers(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("r\t1\t90\t1\t1\t30\t-2\t30\t20\t44.5\nr\t1\t200\t260\t1\t20\t1\t20\t20\t50\n")
    got = tables.read_tabular_hits(spark, str(tmp_path / "h.tsv")).orderBy("hsp_idx").collect()
    assert [(r["s_lo"], r["s_hi"], r["strand"], r["bits"]) for r in got] == [(200, 260, "+", 50.0), (1, 90, "-", 44.5)]
    hsp = "<Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>20</Hsp_query-to><Hsp_hit-from>5</Hsp_hit-from><Hsp_hit-to>64</Hsp_hit-to><Hsp_hit-frame>-1</Hsp_hit-frame><Hsp_identity>18</Hsp_identity><Hsp_align-len>20</Hsp_align-len></Hsp>"
    (tmp_path / "b.xml").write_text(f"<R><Iteration><Iteration_query-def>3</Iteration_query-def><Iteration_hits><Hit><Hit_hsps>{hsp}</Hit_hsps></Hit></Iteration_hits></Iteration></R>")
    row = tables.read_blast_xml(spark, str(tmp_path / "b.xml"), "r").first()
    assert (row["feature_idx"], row["s_lo"], row["s_hi"], row["strand"], row["identities"]) == (3, 5, 64, "-", 18)
    (tmp_path / "a.sam").write_text("@HD\nq\t256\tref\t1\t60\t5M\nq\t0\tref\t10\t60\t3M1I2M1D2M\nq\t0\tref\t50\t60\t3M\n")
    runs = nucleotide.cigar_runs(tables.read_sam(spark, str(tmp_path / "a.sam")))
    positions = nucleotide.position_map(runs)
    assert [(r["ref_pos"], r["query_pos"]) for r in positions.orderBy("ref_pos").collect()] == [(10, 1), (11, 2), (12, 3), (13, 5), (14, 6), (16, 7), (17, 8)]
    spans = nucleotide.lifted_by_runs(spark.createDataFrame([("g", 12, 17)], "name string, start int, end int"), runs).first()
    assert (spans["query_start"], spans["query_end"], spans["coverage"]) == (3, 8, 5 / 6)


def test_entrez_pages(spark):
    def answer(url):
        return json.dumps({"esearchresult": {"count": "3", "querykey": "1", "webenv": "w"}}) if "esearch" in url else "LOCUS A\n//\nLOCUS B\n//\n"

    assert ncbi.Entrez("a@b.c", "key", answer).count("x") == 3
    assert len(list(ncbi.Entrez("a@b.c", "key", answer).pages("x", retmax=10, batch=2))) == 2
    with pytest.raises(ValueError, match="e-mail"):
        ncbi.Entrez("")


def test_suggestions(spark, tmp_path):
    schema = "ord int, record_id string, raw_value string, field string, canonical_name string, score int, suggested_action string, confidence string, default_save boolean, reason string, iou double"
    row = lambda n, rec, raw, canon, score: (n, rec, raw, "gene", canon, score, "save_alias", "high", True, "r", 0.96)
    rows = spark.createDataFrame([row(0, "a", "HN", "E", 9), row(1, "a", "HN", "M", 9), row(2, "a", "spike", "S", 9), row(3, "b", "Spike", "S", 12), row(4, "a", "spike", "S", 9), *(row(10 + i, "a", "tag", c, 9) for i, c in enumerate("ABC"))], schema)
    got = {(r["norm"], r["canonical_name"]): r for r in suggest.demoted(suggest.deduplicated(rows)).collect()}
    assert (got["spike", "S"]["support_count"], got["spike", "S"]["support_records"], got["spike", "S"]["raw_value"], got["spike", "S"]["score"]) == (2, "a, b", "Spike", 12)
    assert (got["hn", "E"]["suggested_action"], got["hn", "E"]["confidence"], got["hn", "E"]["score"], got["hn", "E"]["default_save"]) == ("manual_review", "medium", 5, False)
    assert (got["tag", "A"]["suggested_action"], got["tag", "A"]["confidence"], got["tag", "A"]["score"], got["tag", "A"]["cross_canonical_auto_excluded"]) == ("ignore", "high", 0, True)
    first = [r["raw_value"] for r in suggest.in_order(suggest.demoted(suggest.deduplicated(rows))).collect()]
    assert first[0] == "Spike"
    rows = spark.createDataFrame([(str(i), f"v{i}") for i in range(30)], "review_id string, raw_value string")
    answers, told = review_cache.review(rows, ["raw_value"], suggest.mock_provider, str(tmp_path / "cache"), ["S"], "mock")
    assert (told.sent, answers.where("llm_action = 'skip'").count()) == (20, 20)
    terms = spark.createDataFrame([("S", "spike", 0)], "canonical string, alias string, ord int")
    decided = spark.createDataFrame([("S gene", "S", "save", 0), ("junk", "", "ignore", 1)], "raw_value string, canonical_name string, action string, ord int")
    t, x = suggest.applied(terms, spark.createDataFrame([("s-gene",), ("old",)], "name string"), decided)
    assert sorted(r["alias"] for r in t.collect()) == ["S gene", "spike"] and sorted(r["name"] for r in x.collect()) == ["junk", "old"]


def test_ledger_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "accession string, n int").withColumn("ts", F.timestamp_seconds("n"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ledger.run_once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), "ts")
        rows.limit(2).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("accession").collect()) == ["A", "B"]


def test_fasta_folders(spark, tmp_path):
    rows = spark.createDataFrame([("S", "r", 1, 3, ">r|S\nACG"), ("M", "r", 4, 6, ">r|M\nTTT")], "gene string, record_id string, query_start int, query_end int, fasta string")
    sinks.write_fasta(rows, str(tmp_path / "f"))
    assert "".join(p.read_text() for p in (tmp_path / "f/gene=S").glob("part-*")) == ">r|S\nACG\n"
    assert spark.createDataFrame([], RECORD).transform(genbank.features_of).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_registry_edits_and_archive(tmp_path):
    registry = {"viruses": [{"virus_name": "Alpha", "keywords": ["a"], "alias_config": "a.json"}, {"virus_name": "Beta", "keywords": [], "alias_config": "b.json"}]}
    assert tables.set_keywords(registry, "alpha", [" x", "X", "", "y"])["viruses"][0]["keywords"] == ["x", "y"]
    assert [e["virus_name"] for e in tables.rename_entry(registry, "Alpha", "Gamma")["viruses"]] == ["Gamma", "Beta"]
    for old, new in (("Alpha", "beta"), ("Delta", "x"), ("Alpha", " ")):
        with pytest.raises(ValueError, match="cannot rename"):
            tables.rename_entry(registry, old, new)
    path = tmp_path / "a.json"
    path.write_text("{}")
    kept = sinks.archive_config(str(path))
    assert not path.exists() and "archive" in kept and sinks.archive_config(str(path)) is None
