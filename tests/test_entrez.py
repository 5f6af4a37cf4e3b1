"""The service's records as a source: batches, and a stream that goes on where it stopped; counters of one pass."""

import pytest
from pyspark.sql import functions as F
from service import Service

from strandline.operators import counters, summary
from strandline.schema import LIFTED, STATUSES
from strandline.sources import entrez, ncbi


@pytest.fixture
def service(monkeypatch):
    s = Service(lambda name: f"LOCUS       {name}\nORIGIN\n//\n", 23)
    yield s
    s.stop()


def test_batches(spark, service, tmp_path):
    spark.dataSource.register(entrez.EntrezSource)
    read = lambda **o: spark.read.format("entrez").options(email="a@b.c", base=service.base, batch="5", api_key="k", **o).load()
    got = read(query="x").collect()
    assert sorted(r["value"].split()[1] for r in got) == sorted(f"R{i}" for i in range(23)) and {r["page"] for r in got} == set(range(5))
    assert read(query="x", retmax="7").count() == 7
    (tmp_path / "a.txt").write_text("# those\nA1, A2 A3\nA1\nA4,A5,A6\n")
    got = read(accessions=str(tmp_path / "a.txt")).collect()
    assert sorted((r["page"], r["value"].split()[1]) for r in got) == [(0, f"A{i}") for i in range(1, 6)] + [(1, "A6")]
    for wrong in ({}, {"query": "x", "accessions": "y"}):
        with pytest.raises(Exception, match="either a query or a file"):
            read(**wrong).count()
    with pytest.raises(Exception, match="e-mail"):
        spark.read.format("entrez").options(query="x").load().count()


def test_a_stream_resumes_at_the_page_it_lost(spark, service, tmp_path, monkeypatch):
    spark.dataSource.register(entrez.EntrezSource)
    target, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = spark.readStream.format("entrez").options(email="a@b.c", base=service.base, batch="5", query="x", progress=str(tmp_path / "progress"), api_key="k").load()
        q = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    got = lambda: sorted(int(r["value"].split()[1][1:]) for r in spark.read.schema("page int, value string").parquet(target).collect())
    service.fails = {10}
    with pytest.raises(Exception, match="500|Internal|HTTP"):
        run()
    assert got() == list(range(10))
    service.fails = set()
    before = len(service.asked)
    run()
    assert got() == list(range(23))
    assert [x for x in service.asked[before:] if x != -1] == [10, 15, 20]
    run()
    assert got() == list(range(23))


def test_requests_are_made_again(service):
    answers = iter([OSError("x"), OSError("y"), "LOCUS A\n//\n"])

    def open_url(url):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert ncbi.split_records(next(ncbi.Entrez("a@b.c", "k", open_url).batches(["A"]))) == ["LOCUS A"]


def test_counters_are_taken_on_the_way(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("r"), (F.col("id") % 20).cast("string")).alias("record_id"), F.col("id").cast("int").alias("feature_idx"), F.element_at(F.array(*(F.lit(s) for s, *_ in STATUSES), F.lit("odd")), (F.col("id") % 14 + 1).cast("int")).alias("status"), F.when(F.col("id") % 3 == 0, "direct").otherwise("tblastn").alias("method"))
    whole = spark.createDataFrame([], LIFTED).unionByName(rows, allowMissingColumns=True)
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    observed, seen = counters.observed(whole.mapInArrow(passed, whole.schema))
    observed.write.parquet(str(tmp_path / "lifted"))
    told = counters.told(seen)
    assert reads.value == 200
    health = summary.run_health(whole).first()
    assert (told["features"], told["passing"], told["needs_review"], told["pass_rate"]) == (health["features"], health["passing"], health["needs_review"], health["pass_rate"])
    assert {s: n for s, n in told["statuses"].items() if s != "other"} == {r["status"]: r["n"] for r in summary.status_counts(whole).where("status <> 'odd'").collect()}
    assert told["statuses"]["other"] == 14 and told["methods"] == {"direct": 67, "tblastn": 133}
    nothing, seen = counters.observed(whole.limit(0))
    nothing.write.format("noop").mode("overwrite").save()
    assert counters.told(seen)["pass_rate"] == 0.0
