"""Nucleotide lift: runs, minimizers, chains and planted genomes, against definitions."""

import random

import numpy as np
import pytest

from strandline.operators import nucleotide


def bases(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def back(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def walked(ref_start, cigar):
    """(reference, query) places by the definition of the operations, one base after the other."""
    import re

    r, q, out = ref_start, 1, []
    for n, kind in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if kind in "M=X":
                out.append((r, q))
            r += kind in "M=XDN"
            q += kind in "M=XIS"
    return out


def test_runs_against_a_walk(spark):
    rng = random.Random(1)
    rows = [(f"a{i}", rng.randrange(1, 50), "".join(f"{rng.randrange(0, 12)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [("none", 3, None)]
    runs = nucleotide.cigar_runs(spark.createDataFrame(rows, "record_id string, ref_start int, cigar string"))
    got = sorted(map(tuple, nucleotide.position_map(runs).collect()))
    want = sorted((i, *p) for i, s, c in rows for p in walked(s, c or ""))
    assert got == want and want
    features = [("x", 1, 10), ("y", 12, 60), ("far", 5000, 5001), ("one", 20, 20)]
    lifted = {(r["record_id"], r["name"]): (r["query_start"], r["query_end"], round(r["coverage"], 9)) for r in nucleotide.lifted_by_runs(spark.createDataFrame(features, "name string, start int, end int"), runs).collect()}
    by = {}
    for i, r, q in want:
        for name, a, b in features:
            if a <= r <= b:
                by.setdefault((i, name, b - a + 1), []).append(q)
    assert lifted == {(i, name): (min(qs), max(qs), round(len(qs) / size, 9)) for (i, name, size), qs in by.items()}


def test_a_long_genome_makes_no_row_for_a_base(spark):
    n = 20_000
    cigar = "10S" + "".join(f"{14 + i % 3}M1{'ID'[i % 2]}" for i in range(n))
    runs = nucleotide.cigar_runs(spark.createDataFrame([("g", 1, cigar)], "record_id string, ref_start int, cigar string"))
    assert runs.count() == n
    got = nucleotide.lifted_by_runs(spark.createDataFrame([("all", 1, 400_000), ("late", 290_000, 290_099)], "name string, start int, end int"), runs).collect()
    places = dict(walked(1, cigar))
    for r in got:
        inside = [q for p, q in places.items() if r["start"] <= p <= r["end"]]
        assert (r["query_start"], r["query_end"], r["coverage"]) == (min(inside), max(inside), len(inside) / (r["end"] - r["start"] + 1))


@pytest.mark.parametrize(("k", "w"), [(5, 3), (11, 5)])
def test_minimizers_of_a_strand_are_those_of_the_other(k, w):
    rng = random.Random(2)
    seq = bases(rng, 400) + "NNN" + bases(rng, 50)
    at, turned, h = nucleotide._minimizers(seq, k, w)
    there, back_turned, back_h = nucleotide._minimizers(back(seq), k, w)
    assert set(h.tolist()) == set(back_h.tolist())
    same = dict(zip(zip((len(seq) - k - there).tolist(), back_h.tolist()), back_turned.tolist()))
    shared = [(p, x) for p, x in zip(at.tolist(), h.tolist()) if (p, x) in same]
    assert len(shared) > 0.9 * len(at) and all(same[p, x] != t for (p, x), t in zip(zip(at.tolist(), h.tolist()), turned.tolist()) if (p, x) in same)
    assert not [p for p in at.tolist() if "N" in seq[p : p + k]]
    assert [len(x) for x in nucleotide._minimizers("ACG", k, w)] == [0, 0, 0]


def test_chain_is_the_best_of_all(spark):
    rng = random.Random(3)
    for _ in range(60):
        n, k = rng.randrange(1, 9), 5
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(n)})
        r, q = (np.array(x) for x in zip(*points))
        best = 0
        for mask in range(1, 1 << len(points)):
            some = [p for i, p in enumerate(points) if mask >> i & 1]
            score = k
            for (a, b), (c, d) in zip(some, some[1:]):
                if c <= a or d <= b:
                    break
                shift = abs((c - a) - (d - b))
                score += min(c - a, d - b, k) - (1 + shift // nucleotide.SHIFT if shift else 0)
            else:
                best = max(best, score)
        score, at = nucleotide._chain(r, q, k)
        assert score == best and (np.diff(r[at]) > 0).all() and (np.diff(q[at]) > 0).all()


def changed(rng, seq, share):
    return "".join(rng.choice("ACGT".replace(x, "")) if rng.random() < share else x for x in seq)


@pytest.mark.parametrize(("share", "near"), [(0.02, 0), (0.28, 40)])
def test_planted_genomes_are_lifted(spark, share, near):
    """Features on changed genomes with an insertion and a deletion, on both strands; the more changed need a later preset."""
    rng = random.Random(int(share * 100))
    ref = bases(rng, 6000)
    features = [("a", 301, 900), ("b", 1500, 1799), ("c", 2500, 3400), ("d", 4500, 5500)]
    rows, shift = [], {}
    for i in range(8):
        x = changed(rng, ref, share)
        cut, put = 1200 + rng.randrange(100), 4000 + rng.randrange(100)
        x = x[:cut] + x[cut + 30 : put] + bases(rng, 45) + x[put:]
        head = bases(rng, rng.randrange(10, 200))
        x = head + x + bases(rng, 100)
        rows.append((f"g{i}", back(x) if i % 2 else x))
        shift[f"g{i}"] = {n: len(head) + (0 if b < cut else -30 if b < put else 15) for n, _, b in features}
    rows += [("other", bases(rng, 3000)), ("none", None), ("short", "ACGT"), ("odd", "NNNN" * 50)]
    df = spark.createDataFrame(rows, "record_id string, seq string")
    genome = spark.createDataFrame([(ref,)], "seq string")
    got = nucleotide.nucleotide_lift(df, genome, spark.createDataFrame(features, "name string, start int, end int")).collect()
    sizes, right = {i: len(s) for i, s in rows if s}, 0
    assert {r["record_id"] for r in got} == set(shift)
    for r in got:
        at = shift[r["record_id"]][r["name"]]
        want = (r["start"] + at, r["end"] + at)
        if r["strand"] == "-":
            want = (sizes[r["record_id"]] + 1 - want[1], sizes[r["record_id"]] + 1 - want[0])
        right += abs(r["query_start"] - want[0]) <= near and abs(r["query_end"] - want[1]) <= near and (r["coverage"] == 1.0 or near > 0)
    assert right >= (0.8 if near else 0.95) * len(got) and len(got) >= 28
    assert ({r["preset"] for r in got} == {"asm5"}) == (near == 0)


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "record_id string, seq string")
    features = spark.createDataFrame([("a", 1, 9)], "name string, start int, end int")
    genome = spark.createDataFrame([("ACGT" * 300,)], "seq string")
    assert nucleotide.nucleotide_lift(none, genome, features).count() == 0
    some = spark.createDataFrame([("r", "ACGT" * 300)], "record_id string, seq string")
    assert nucleotide.nucleotide_lift(some, genome.limit(0), features).count() == 0
    assert nucleotide.nucleotide_lift(some, genome, features.limit(0)).count() == 0
