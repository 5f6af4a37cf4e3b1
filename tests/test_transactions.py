"""The splittable source and the transactional sink."""

import pytest
from pyspark.sql import functions as F

from strandline.sources import crawl_sink, genbank


def flat(n, organism="Alpha", size=300):
    seq = ("acgt" * size)[: size + n % 7]
    lines = "".join(f"{i + 1:9d} {seq[i : i + 60]}\n" for i in range(0, len(seq), 60))
    return f"LOCUS       REC{n}  {len(seq)} bp\nDEFINITION  record {n}.\nVERSION     REC{n}.1\nSOURCE      x\n  ORGANISM  {organism} {n % 3}\nFEATURES             Location/Qualifiers\n     CDS             10..{60 + n}\n                     /gene=\"g{n}\"\nORIGIN\n{lines}//\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.gb").write_text("".join(flat(n) for n in range(50)))
    (tmp_path / "b.gb").write_text("".join(flat(n) for n in range(50, 60)).replace("\n", "\r\n"))
    (tmp_path / "c.gb").write_text(flat(60)[:-3])
    (tmp_path / "_hidden").write_text("x")
    return tmp_path


@pytest.mark.parametrize("split", [1, 7, 64, 65, 511, 1000, 1 << 20])
def test_each_record_is_in_one_range(folder, split):
    got = [genbank.parse_record(t)["record_id"] for p, size in genbank.listed(str(folder)) for s in range(0, size, split) for t in genbank.range_records(p, s, min(s + split, size))]
    assert got == [f"REC{n}.1" for n in range(61)]


def test_ranges_filters_and_fields(spark, folder, monkeypatch):
    genbank.register(spark)
    rows = spark.read.format("genbank").option("splitBytes", 2000).option("pushFilters", "true").load(str(folder))
    assert rows.rdd.getNumPartitions() > 10
    want = genbank.read_genbank(spark, str(folder)).orderBy("record_id").collect()
    assert rows.orderBy("record_id").collect() == want and len(want) == 61
    assert "REC7.1" not in rows.where("record_id = 'REC7.1'")._jdf.queryExecution().executedPlan().toString().split("\n")[0]
    one = rows.where("record_id = 'REC7.1'").collect()
    assert [r["features"][0]["qualifiers"]["gene"] for r in one] == [["g7"]]
    assert rows.where("organism in ('Alpha 1', 'none') and seq_len > 303").count() == sum(r["organism"] == "Alpha 1" and r["seq_len"] > 303 for r in want)
    names = spark.read.format("genbank").schema("name string, organism string").load(str(folder))
    assert sorted(map(tuple, names.collect())) == sorted((r["name"], r["organism"]) for r in want)
    with pytest.raises(Exception, match="no field"):
        spark.read.format("genbank").schema("nothing string").load(str(folder)).collect()


def test_names_alone_build_no_sequence_and_read_no_feature():
    text = flat(3)
    few = genbank.parse_record(text, frozenset(["name", "organism"]))
    assert (few["seq"], few["features"], few["name"], few["organism"]) == ("", [], "REC3", "Alpha 0")
    whole = genbank.parse_record(text)
    assert genbank.parse_record(text, frozenset(["seq_len"]))["seq_len"] == whole["seq_len"] > 0
    bare = text.replace("  ORGANISM  Alpha 0\n", "").replace("     CDS ", "     source          1..9\n                     /organism=\"Beta\"\n     CDS ")
    assert genbank.parse_record(bare, frozenset(["organism"]))["organism"] == "Beta"


CRAWL = "accession string, organism string, length int, matched_virus string, output_file string, status string, text string"


def crawled(spark, first, n):
    rows = [(f"A{i}", "o", i, "v" if i % 3 else None, "v.gb" if i % 3 else "_unmatched.gb", "dup_in_batch" if i % 5 == 0 else "new", f"LOCUS A{i}") for i in range(first, first + n)]
    return spark.createDataFrame(rows, CRAWL).repartition(4)


def state(spark, out, ledger):
    from pathlib import Path

    texts = lambda p, end: "".join(f.read_text() for f in sorted(Path(p).rglob(f"*{end}"))) if Path(p).exists() else ""
    listed = [line.split(",")[0] for line in texts(f"{out}/manifest", ".csv").splitlines() if not line.startswith("accession")]
    species = [line.split()[1] for line in texts(f"{out}/species", ".gb").splitlines() if line.startswith("LOCUS")]
    return sorted(listed), sorted(species), sorted(texts(ledger, ".txt").split()), [p.name for p in Path(out).iterdir() if p.name.startswith("_")]


def test_all_outputs_or_none(spark, tmp_path, monkeypatch):
    spark.dataSource.register(crawl_sink.CrawlSink)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    save = lambda df: df.write.format("crawl").option("ledger", ledger).mode("append").save(out)
    save(crawled(spark, 0, 20))
    new = sorted(f"A{i}" for i in range(20) if i % 5)
    assert state(spark, out, ledger) == (sorted(f"A{i}" for i in range(20)), new, new, [])
    # A task that fails leaves nothing behind, of any output.
    with pytest.raises(Exception, match="odd row"):
        save(crawled(spark, 20, 20).withColumn("text", F.when(F.col("accession") == "A33", F.raise_error(F.lit("odd row"))).otherwise(F.col("text"))))
    assert state(spark, out, ledger) == (sorted(f"A{i}" for i in range(20)), new, new, [])
    save(crawled(spark, 20, 0))
    assert state(spark, out, ledger)[2] == new


def test_a_crash_within_the_commit_is_finished_later(tmp_path, monkeypatch):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    writer = crawl_sink._Writer({"path": out, "ledger": ledger}, list(crawl_sink.FIELDS))
    row = {"accession": "A1", "organism": "o", "length": 1, "matched_virus": "v", "output_file": "v.gb", "status": "new", "text": "LOCUS A1"}
    messages = [writer.write(iter([row])), writer.write(iter([])), writer.write(iter([row | {"accession": "A2", "text": "LOCUS A2"}]))]
    writer.write(iter([row | {"accession": "A9"}]))  # a repeated attempt, whose message does not reach the driver
    real, calls = crawl_sink._moved, []

    def moved(a, b):
        calls.append(b)
        if len(calls) == 4:
            raise OSError("gone")
        real(a, b)

    monkeypatch.setattr(crawl_sink, "_moved", moved)
    with pytest.raises(OSError, match="gone"):
        writer.commit(messages)
    assert state(None, out, ledger)[2] == []
    monkeypatch.setattr(crawl_sink, "_moved", real)
    assert crawl_sink.recovered(out) == 1 and crawl_sink.recovered(out) == 0
    assert state(None, out, ledger)[:3] == (["A1", "A2"], ["A1", "A2"], ["A1", "A2"])
