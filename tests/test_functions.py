"""Names, sequences and intervals on small cases."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import names as N
from strandline.functions import sequence as S
from strandline.functions.intervals import iou, overlap_join


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(" ORF-1a ", "orf1a"), ("Spike_Protein", "spikeprotein"), ("\t E\n", "e"), (None, ""), ("a\tb", "a\tb")])
def test_norm(spark, raw, want):
    assert one(spark, N.norm(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("M; ORF6", ["M", "ORF6"]), ("nucleocapsid", ["nucleocapsid"]), ("a;;A; b", ["a", "b"]), ("x; ", ["x;"])])
def test_compound_parts(spark, raw, want):
    assert one(spark, N.compound_parts(F.col("v")), v=raw) == want


@pytest.mark.parametrize(
    ("raw", "canonical", "field", "action"),
    [
        ("ORF1a protein", "ORF1a", "product", "save_alias"),
        ("membrane protein", "E", "product", "manual_review"),
        ("polyprotein", "ORF1a", "product", "ignore"),
        ("HNZK1", "ORF3", "gene", "manual_review"),
        ("membrane protein", "M", "product", "save_alias"),
        ("polyprotein 1a", "ORF1a", "product", "save_alias"),
        ("hypothetical protein", "ORF3", "product", "ignore"),
        ("GP5", "ORF5", "gene", "save_alias"),
        ("S", "S", "gene", "save_alias"),
        ("ABC_12345", "M", "locus_tag", "ignore"),
    ],
)
def test_classify(spark, raw, canonical, field, action):
    c = N.classify(F.col("r"), F.col("f"), F.col("c"), F.lit(0.96), F.lit(True))
    got = one(spark, c, r=raw, f=field, c=canonical)
    assert got["action"] == action, got
    assert ("generic name" in got["reason"]) == (raw in ("polyprotein", "hypothetical protein"))
    assert got["default_save"] == (action == "save_alias")


@pytest.mark.parametrize(
    ("seq", "start", "end", "strand", "expected", "want"),
    [
        ("ATGAAACCCTAAAAATGA", 1, 9, "+", 18, (1, 18, "ATGAAACCCTAAAAATGA", 3)),
        ("ATGAAACCCTAAAAATGA", 1, 9, "+", None, (1, 12, "ATGAAACCCTAA", 1)),
        ("TTAGGGTTTCAT", 4, 12, "-", None, (1, 12, "ATGAAACCCTAA", 1)),
    ],
)
def test_stop_rescue(spark, seq, start, end, strand, expected, want):
    got = one(spark, S.stop_rescue(F.col("s"), F.lit(start), F.lit(end), F.lit(strand), F.lit(expected).cast("int"), 3), s=seq)
    assert tuple(got) == want


def test_start_rescue(spark):
    got = one(spark, S.start_rescue(F.col("s"), F.lit(1), F.lit(9), F.lit("-"), F.lit(3), F.lit(None).cast("int")), s="TTAGGGTTTCAT")
    assert tuple(got) == (1, 12, "ATGAAACCCTAA", 3)
    assert one(spark, S.start_rescue(F.col("s"), F.lit(4), F.lit(9), F.lit("+"), F.lit(2), F.lit(None).cast("int")), s="CCCCCCCCCCCC") is None


def test_translation(spark):
    assert one(spark, S.translated(F.col("s")), s="atgTTTggnTAAC") == "MFX*"
    assert one(spark, S.protein(F.col("s")), s="ATG" + "AAA" * 12 + "TAAGGG") == "M" + "K" * 12
    assert one(spark, S.protein(F.col("s")), s="ATGAAATAA") is None
    assert one(spark, S.translated(F.col("s")), s="AC") == ""
    flags = one(spark, S.cds_flags(F.col("s")), s="ATGAAATAGAAATAA")
    assert (flags["has_start_codon"], flags["has_stop_codon"], flags["in_frame"], flags["no_internal_stop"], flags["valid"]) == (True, True, True, False, False)


def test_overlap_join_finds_each_pair_once(spark):
    rows = [("r", i, s, s + n) for i, (s, n) in enumerate([(1, 100), (50, 10), (60_000, 40_000), (1, 200_000), (300_000, 5)])]
    a = spark.createDataFrame(rows, "k string, i int, s int, e int")
    b = spark.createDataFrame(rows, "k string, j int, t int, f int")
    got = sorted((r["i"], r["j"]) for r in overlap_join(a, b, ["k"], ("s", "e"), ("t", "f"), 1000).collect())
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[2] <= y[3] and y[2] <= x[3])
    assert got == want
    assert one(spark, iou(F.lit(1), F.lit(10), F.lit(6), F.lit(15)), s="") == pytest.approx(5 / 15)


@pytest.mark.parametrize("size", [30_000, 300_000])
def test_long_genomes_take_time_in_proportion(spark, size):
    """Translation against a plain loop; ten times the length may take about ten times as long, not a hundred."""
    import random
    import time

    rng = random.Random(size)
    code = {a + b + c: S.AMINO[i * 16 + j * 4 + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    seq = "".join(rng.choices("ACGT", k=size))
    row = spark.createDataFrame([(seq,)], "s string")
    row.select(S.translated(F.col("s")).alias("x")).first()
    began = time.perf_counter()
    got = row.select(S.translated(F.col("s")).alias("x")).first()["x"]
    assert time.perf_counter() - began < 2 + size / 30_000
    assert got == "".join(code[seq[i : i + 3]] for i in range(0, size - 2, 3))
    from strandline.operators.search import kmers

    rows = kmers(row, [], "s", 9)
    assert rows.count() == size - 8 and rows.where("pos = 12345").first()["kmer"] == seq[12344:12353]


def test_rescues_against_plain_loops(spark):
    import random

    rng = random.Random(5)
    rows = []
    for n in range(60):
        seq = "".join(rng.choices("ACGT", k=rng.randrange(60, 200)))
        a = rng.randrange(1, len(seq) - 20)
        rows.append((n, seq, a, min(len(seq), a + rng.randrange(8, 60)), rng.choice("+-"), rng.choice([None, 30, 60])))
    comp = str.maketrans("ACGT", "TGCA")
    cut = lambda s, a, b, d: s[a - 1 : b] if d == "+" else s[a - 1 : b].translate(comp)[::-1]

    def start(seq, a, b, d, want, window=25):
        offsets = list(range(-window, window + 1))
        if want is not None:
            offsets.append(b - want + 1 - a if d == "+" else a + want - 1 - b)
        found = []
        for o in offsets:
            x, y = (a + o, b) if d == "+" else (a, b + o)
            if 1 <= x <= y <= len(seq) and cut(seq, x, y, d).startswith("ATG"):
                n = y - x + 1
                found.append(((n % 3 != 0), abs(n - want) if want is not None else 0, abs(o), o >= 0, x, y))
        return min(found)[4:] if found else None

    def stop(seq, a, b, d, want):
        found = []
        for n in range(1, 31):
            x, y = (a, b + 3 * n) if d == "+" else (a - 3 * n, b)
            if x >= 1 and y <= len(seq) and cut(seq, x, y, d)[-3:] in S.STOPS:
                w = y - x + 1
                found.append((w % 3 != 0, abs(w - want) if want is not None else 0, n, x, y))
        return min(found)[3:] if found else None

    df = spark.createDataFrame(rows, "n int, s string, a int, b int, d string, e int")
    c = F.col
    got = df.select("n", S.start_rescue(c("s"), c("a"), c("b"), c("d"), F.lit(25), c("e")).alias("x"), S.stop_rescue(c("s"), c("a"), c("b"), c("d"), c("e")).alias("y")).collect()
    for r in got:
        _, seq, a, b, d, e = rows[r["n"]]
        assert (tuple(r["x"][:2]) if r["x"] else None) == start(seq, a, b, d, e) and (tuple(r["y"][:2]) if r["y"] else None) == stop(seq, a, b, d, e), rows[r["n"]]


@pytest.mark.parametrize(
    ("raw", "names", "want"),
    [
        ("ORF1a protein", ["ORF1a", "ORF1ab", "N"], "ORF1a"),
        ("ORF1ab", ["ORF1a", "ORF1ab", "N"], "ORF1ab"),
        ("replicase polyprotein 1b", ["ORF1a", "ORF1b", "ORF1ab"], "ORF1b"),
        ("polyprotein 1ab", ["ORF1a", "ORF1b", "ORF1ab"], "ORF1ab"),
        ("ORF1a/1b polyprotein", ["ORF1a", "ORF1b", "ORF1ab"], "ORF1ab"),
        ("contains ORF1a and ORF1b", ["ORF1a", "ORF1b", "ORF1ab"], "ORF1ab"),
        ("ORF1a/b", ["ORF1b", "orf-1ab", "ORF1ab"], "ORF1ab"),
        ("membrane-associated protein", ["S", "M"], None),
        ("", ["S", ""], None),
        (None, ["S"], None),
    ],
)
def test_best_canonical(spark, raw, names, want):
    assert one(spark, N.best_canonical(F.col("r").cast("string"), F.array(*map(F.lit, names))), r=raw) == want
    assert one(spark, N.first_matching(F.array(F.lit("odd"), F.col("r").cast("string")), F.array(*map(F.lit, names))), r=raw) == want
