"""The annotation run on planted genomes, and its operators on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import alias, direct, hsp, lift, summary
from strandline.plans.annotate import annotate, prepare_reference
from strandline.schema import HSP, LIFTED, RECORD, STATUSES

CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG" if a + b + c not in ("TAA", "TAG", "TGA")]


def gene(rng, n):
    return "ATG" + "".join(rng.choice(CODONS) for _ in range(n - 2)) + "TAA"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    genes, at, seq = {}, {}, ""
    for name, n in (("S", 120), ("M", 80), ("N", 60)):
        seq += "".join(rng.choice("ACGT") for _ in range(97))
        genes[name] = gene(rng, n)
        at[name] = (len(seq) + 1, len(seq) + n * 3)
        seq += genes[name]
    seq += "".join(rng.choice("ACGT") for _ in range(151))
    feature = lambda name, span, strand="+", key="gene": ("CDS", *span, strand, {key: [name]})
    terms = spark.createDataFrame([("S", "spike", 0), ("M", "matrix", 1), ("N", "nucleo", 2)], "canonical string, alias string, ord int")
    excluded = spark.createDataFrame([("unknown", 0)], "name string, ord int")
    ref = spark.createDataFrame([("REF.1", "REF", "reference", "virus", seq, len(seq), [feature("spike", at["S"]), feature("M", at["M"]), feature("nucleo", at["N"])])], RECORD)
    return spark, seq, at, terms, excluded, ref, feature


def test_lifts_bare_and_reverse_genomes_and_reads_annotated_ones(world):
    spark, seq, at, terms, excluded, ref, feature = world
    records = [
        ("BARE.1", "b", "", "virus", seq[40:], len(seq) - 40, []),
        ("BACK.1", "r", "", "virus", rc(seq), len(seq), []),
        ("NAMED.1", "n", "", "virus", seq, len(seq), [feature("Spike", at["S"]), feature("mystery", at["M"]), feature("unknown", at["N"])]),
        ("NOSEQ.1", "x", "", "virus", None, 0, []),
    ]
    run = annotate(spark.createDataFrame(records, RECORD), prepare_reference(ref, terms, excluded))
    rows = {(r["record_id"], r["name"]): r for r in run.lifted.collect()}
    for name, (a, b) in at.items():
        bare, back = rows["BARE.1", name], rows["BACK.1", name]
        assert (bare["query_start"], bare["query_end"], bare["strand"]) == (a - 40, b - 40, "+"), bare
        assert (back["query_start"], back["query_end"], back["strand"]) == (len(seq) - b + 1, len(seq) - a + 1, "-"), back
        assert bare["status"] == back["status"] == "ok_rescued" and bare["sequence"] == seq[a - 1 : b] == back["sequence"]
        assert bare["method"] == "tblastn" and bare["coverage"] == 1.0 and bare["identity"] == 100.0
    assert rows["NAMED.1", "S"]["status"] == "ok" and rows["NAMED.1", "S"]["source_name"] == "Spike"
    assert rows["NAMED.1", "mystery"]["status"] == "unresolved_name" and ("NAMED.1", "unknown") not in rows
    assert [tuple(r) for r in run.errors.collect()] == [("NOSEQ.1", "no sequence")]
    counts = {r["status"]: r["n"] for r in run.summary.collect()}
    assert set(counts) == {s for s, _, _ in STATUSES} and counts["ok_rescued"] == 6 and counts["no_hit"] == 0


def test_strand_from_frame_then_coordinates(spark):
    rows = spark.createDataFrame([(453, 1775, -3), (453, 1775, 2), (1775, 453, -1), (1775, 453, None)], "a int, b int, f int")
    assert [r[0] for r in rows.select(hsp.hsp_strand(F.col("f"), F.col("a"), F.col("b"))).collect()] == ["-", "+", "-", "-"]


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.8, 0.8), (0.4, 0.8), (0.8, 0.2), (0.4, 0.2), (0.5, 0.3)], "c double, i double")
    assert [r[0] for r in rows.select(hsp.threshold_failure(F.col("c"), F.col("i"))).collect()] == [None, "low_coverage", "low_identity", "low_coverage_and_identity", None]


def test_merge_drops_far_hits_and_sheds_long_spans(spark):
    rows = [
        ("r", 1, 0, 100, 399, "+", 1, 100, 100, 90, 180.0, 100), ("r", 1, 1, 5000, 5059, "+", 40, 59, 20, 12, 30.0, 100), ("r", 1, 2, 100, 130, "-", 1, 10, 10, 10, 20.0, 100),
        ("r", 2, 0, 100, 300, "+", 1, 67, 67, 60, 90.0, 60), ("r", 2, 1, 250, 520, "+", 1, 90, 90, 60, 50.0, 60),
    ]
    got = {r["feature_idx"]: r for r in hsp.merged(spark.createDataFrame(rows, HSP + ", protein_len int")).collect()}
    assert (got[1]["start"], got[1]["end"], got[1]["coverage"], got[1]["identity"], got[1]["bits"]) == (100, 399, 1.0, 0.9, 180.0)
    assert (got[2]["start"], got[2]["end"]) == (100, 300)


def lifted(spark, rows):
    names = [f.split()[0] for f in LIFTED.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LIFTED)


def test_gap_filling(spark):
    base = {"record_id": "r", "strand": "+", "coverage": 0.0}
    rows = [
        base | {"feature_idx": 1, "ref_start": 1, "ref_end": 100, "query_start": 11, "query_end": 110, "status": "ok"},
        base | {"feature_idx": 2, "ref_start": 101, "ref_end": 150, "status": "no_hit"},
        base | {"feature_idx": 3, "ref_start": 151, "ref_end": 200, "query_start": 161, "query_end": 210, "status": "ok"},
        base | {"feature_idx": 4, "ref_start": 301, "ref_end": 350, "status": "no_hit"},
    ]
    got = {r["feature_idx"]: r for r in hsp.gap_filled(lifted(spark, rows)).collect()}
    assert (got[2]["query_start"], got[2]["query_end"], got[2]["status"], got[2]["coverage"]) == (111, 160, "ok_gap_filled", 1.0)
    assert got[4]["status"] == "no_hit"


def test_duplicates_collapse_to_the_longer(spark):
    rows = spark.createDataFrame([("r", 1, "CDS", 10, 210, "+", "S", "S", "alias", "S"), ("r", 2, "CDS", 10, 120, "+", "S", "S", "alias", "S"), ("r", 3, "CDS", 300, 400, "+", "X", "X", "raw", None)], "record_id string, ord int, type string, start int, end int, strand string, name string, raw_name string, name_source string, alias_source_value string")
    ref = spark.createDataFrame([(0, "M", 1, 9)], "ord int, name string, start int, end int")
    got = {r["name"]: r for r in direct.direct_features(rows, ref).collect()}
    assert (got["S"]["query_end"], got["S"]["status"]) == (210, "not_in_reference") and got["X"]["status"] == "unresolved_name"


def test_alias_edges(spark):
    terms = spark.createDataFrame([("A", "x", 0), ("B", "X ", 1), ("B", "", 2)], "canonical string, alias string, ord int")
    excluded = spark.createDataFrame([("a", 0), ("new", 1), ("NEW", 2)], "name string, ord int")
    got = {r["norm"]: r["target"] for r in alias.alias_lookup(terms, excluded).collect()}
    assert got == {"a": "A", "b": "B", "x": alias.AMBIGUOUS, "new": alias.SENTINEL}
    with pytest.raises(ValueError, match="several canonicals"):
        alias.validated(terms, excluded)
    links = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("s", "gone")], "name string, parent string")
    names = links.select("name")
    assert sorted(tuple(r) for r in alias.parent_faults(names, links).collect()) == [("p", "cycle"), ("q", "cycle"), ("r", "cycle"), ("s", "missing parent")]
    more = alias.add_alias(alias.add_alias(terms, "A", "y-1"), "A", "Y1")
    assert sorted(r["alias"] for r in more.where("canonical = 'A'").collect()) == ["x", "y-1"]
    t2, e2 = alias.excluded_to_alias(terms, excluded, "New", "A")
    assert t2.count() == 4 and [r["name"] for r in e2.collect()] == ["a"]


def test_empty_run_has_all_statuses(spark):
    counts = summary.status_counts(lifted(spark, [])).collect()
    assert len(counts) == len(STATUSES) and all(r["n"] == 0 for r in counts)
    assert summary.run_health(lifted(spark, [])).first()["pass_rate"] == 0.0


def test_low_coverage_keeps_coordinates_without_sequence(world, monkeypatch):
    spark, seq, at, terms, excluded, ref, _ = world
    prepared = prepare_reference(ref, terms, excluded)
    proteins = lift.reference_proteins(prepared.features.select("feature_idx", "name", "start", "end", "strand"), prepared.genome)
    records = spark.createDataFrame([("Q", seq, len(seq))], "record_id string, seq string, seq_len int")
    a, _b = at["S"]
    hits = spark.createDataFrame([("Q", 1, 0, a, a + 89, "+", 1, 30, 30, 30, 60.0)], HSP)
    got = {r["feature_idx"]: r for r in lift.lift(records, proteins, hits).collect()}
    assert got[1]["status"] == "low_coverage" and got[1]["query_start"] == a and got[1]["sequence"] is None
    assert got[2]["status"] == "no_hit" and got[2]["query_start"] is None and got[2]["coverage"] == 0.0
    monkeypatch.setattr(lift, "MOST_FEATURES", 2)
    assert {r["feature_idx"]: r for r in lift.lift(records, proteins, hits).collect()} == got
    plain = {r["feature_idx"]: r for r in lift.lift(records, proteins, hits, lift.LiftConfig(min_coverage=0.2, codons=False)).collect()}
    assert plain[1]["status"] == "ok" and plain[1]["query_end"] == a + 89


@pytest.mark.parametrize("several", [False, True])
def test_parents_against_a_walk(spark, several):
    """Trees, tails that lead into cycles, a loop of one name, and (several) names with two parents, by breadth-first search."""
    import random

    rng = random.Random(7)
    links = [(f"t{i}", f"t{i * 2 // 3}") for i in range(1, 90)] + [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("tail1", "c3"), ("tail2", "tail1"), ("self", "self"), ("top", None), ("lost", "nowhere")]
    links += [(f"t{i}", f"t{rng.randrange(90)}") for i in range(20, 60)] if several else []
    parents, want = {}, {}
    for name, parent in links:
        parents.setdefault(name, set()).update({parent} - {None})
    for name in parents:
        level, d = parents[name], 1
        while level:
            want.update({(name, x): d for x in level})
            level, d = {y for x in level for y in parents.get(x, ())} - {x for n, x in want if n == name}, d + 1
    table = spark.createDataFrame(links, "name string, parent string")
    got = alias.parent_closure(table).collect()
    assert {(r["name"], r["ancestor"]): r["distance"] for r in got} == want and len(got) == len(want)
    faults = {(n, "cycle") for n, x in want if n == x} | {("lost", "missing parent")} | {(n, "missing parent") for n, ps in parents.items() if ps - parents.keys()}
    got = alias.parent_faults(table.select("name").distinct(), table).collect()
    assert {tuple(r) for r in got} == faults and len(got) == len(faults)


def test_faults_make_no_paths(spark, monkeypatch):
    """Faults of names with one parent each come from a row for each name, not from all pairs of a name and an ancestor."""
    monkeypatch.setattr(alias, "parent_closure", None)
    links = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "q"), ("s", "gone")], "name string, parent string")
    assert sorted(map(tuple, alias.parent_faults(links.select("name"), links).collect())) == [("q", "cycle"), ("r", "cycle"), ("s", "missing parent")]


@pytest.mark.parametrize("name", ["direct_extract_status", "fasta_rows", "fasta_counts"])
def test_sequences_are_not_broadcast(spark, tmp_path, name):
    import __spark_entry__

    spark.range(50).selectExpr("id as p_partkey", "'a' as p_name", "'b' as p_type", "'c' as p_brand").write.parquet(str(tmp_path / "part.parquet"))
    columns = "id as l_orderkey, id % 50 as l_partkey, id % 9 as l_suppkey, cast(id % 7 as int) as l_linenumber, 40D as l_quantity, 1D as l_extendedprice, 0.1D as l_discount, 0D as l_tax, 'R' as l_returnflag, 'F' as l_linestatus, timestamp'2020-01-01' as l_shipdate"
    spark.range(300).selectExpr(*columns.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [record_id" in plan and "BroadcastHashJoin [record_id" not in plan and df.count() > 0
