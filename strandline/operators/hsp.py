"""Local alignments (HSPs): strand vote, collinear clusters, merge, terminal extrapolation, thresholds.

hsps: record_id, feature_idx, hsp_idx, s_lo, s_hi, strand, q_lo, q_hi, align_length, identities, bits. All windows and sums
are by (record_id, feature_idx), a few alignments each. protein_len is a column of the HSP rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["record_id", "feature_idx"]


def hsp_strand(frame: Column, first: Column, last: Column) -> Column:
    """From the sign of the subject frame; from the order of the coordinates where there is no frame."""
    return F.when(frame.isNotNull(), F.when(frame < 0, "-").otherwise("+")).otherwise(F.when(first <= last, "+").otherwise("-"))


def strand_vote(hsps: DataFrame) -> DataFrame:
    """(key, voted): the strand on which more bases align, + on a tie."""
    span = F.col("s_hi") - F.col("s_lo") + 1
    votes = hsps.groupBy(*KEY).agg(F.sum(F.when(F.col("strand") == "+", span).otherwise(0)).alias("p"), F.sum(F.when(F.col("strand") == "-", span).otherwise(0)).alias("m"))
    return votes.select(*KEY, F.when(F.col("p") >= F.col("m"), "+").otherwise("-").alias("voted"))


def on_voted_strand(hsps: DataFrame) -> DataFrame:
    span, w = F.col("s_hi") - F.col("s_lo") + 1, Window.partitionBy(*KEY)
    lead = F.sum(F.when(F.col("strand") == "+", span).otherwise(-span)).over(w)
    return hsps.withColumn("voted", F.when(lead >= 0, "+").otherwise("-")).where("strand = voted")


def collinear_clusters(hsps: DataFrame) -> DataFrame:
    """The HSPs of the voted strand with origin and cluster: a new cluster begins where the gap to the previous origin is too wide."""
    offset = (F.col("q_lo") - 1) * 3
    origin = F.when(F.col("strand") == "+", F.col("s_lo") - offset).otherwise(F.col("s_hi") + offset)
    rows = on_voted_strand(hsps).withColumn("origin", origin)
    by = Window.partitionBy(*KEY).orderBy("origin", "hsp_idx")
    wide = F.greatest(F.lit(150), F.floor(F.col("protein_len") * 3 * 0.10).cast("int"))
    jump = F.coalesce((F.col("origin") - F.lag("origin").over(by) > wide).cast("int"), F.lit(0))
    return rows.withColumn("_j", jump).withColumn("cluster", F.sum("_j").over(by)).drop("_j")


def covered(lo: str = "q_lo", hi: str = "q_hi") -> Column:
    """Aggregate: number of distinct positions that the intervals cover."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"] + 1) + 1, F.lit(0))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end"))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(-(1 << 30)).alias("end")), step, lambda s: s["n"])


def best_cluster(clustered: DataFrame) -> DataFrame:
    """Only the HSPs of the cluster that explains most of the protein, then has most bits, then is the first."""
    ranks = clustered.groupBy(*KEY, "cluster").agg(covered().alias("c"), F.sum("bits").alias("b"))
    best = ranks.groupBy(*KEY).agg(F.max(F.struct("c", "b", (-F.col("cluster")).alias("k"))).alias("r")).select(*KEY, (-F.col("r.k")).alias("cluster"))
    return clustered.join(best, [*KEY, "cluster"], "left_semi")


def _shed(hsps: Column, limit: Column) -> Column:
    """HSPs (array) less edge ones of lowest bits, one at a time, while the span is over the limit."""
    low, high = (lambda a: F.array_min(F.transform(a, lambda h: h["s_lo"]))), (lambda a: F.array_max(F.transform(a, lambda h: h["s_hi"])))

    def step(kept, _):
        lo, hi = low(kept), high(kept)
        edge = F.filter(kept, lambda h: (h["s_lo"] == lo) | (h["s_hi"] == hi))
        worst = F.array_min(F.transform(edge, lambda h: F.struct(h["bits"].alias("bits"), h["hsp_idx"].alias("i"))))["i"]
        return F.when((F.size(kept) > 1) & (hi - lo + 1 > limit), F.filter(kept, lambda h: h["hsp_idx"] != worst)).otherwise(kept)

    return F.aggregate(F.sequence(F.lit(1), F.size(hsps)), hsps, step)


def merged(hsps: DataFrame) -> DataFrame:
    """(key, strand, start, end, coverage, identity, bits): strand vote, best collinear cluster, span limit, then one span."""
    best = best_cluster(collinear_clusters(hsps))
    h = F.array_sort(F.collect_list(F.struct("hsp_idx", "s_lo", "s_hi", "q_lo", "q_hi", "align_length", "identities", "bits")))
    rows = best.groupBy(*KEY, "strand", "protein_len").agg(h.alias("h"))
    rows = rows.withColumn("h", _shed(F.col("h"), F.greatest(F.lit(1), F.col("protein_len") * 6)))
    flat = rows.select(*KEY, "strand", "protein_len", F.explode("h").alias("x")).select(*KEY, "strand", "protein_len", "x.*")
    one = flat.groupBy(*KEY, "strand", "protein_len").agg(
        F.min("s_lo").alias("start"), F.max("s_hi").alias("end"), covered().alias("c"), F.sum("align_length").alias("n"), F.sum("identities").alias("i"), F.max("bits").alias("bits"))
    share = F.when(F.col("protein_len") > 0, F.least(F.lit(1.0), F.col("c") / F.col("protein_len"))).otherwise(0.0)
    return one.select(*KEY, "strand", "protein_len", "start", "end", share.alias("coverage"), F.when(F.col("n") > 0, F.col("i") / F.col("n")).otherwise(0.0).alias("identity"), "bits")


def terminal_extension(start: Column, end: Column, strand: Column, q_min: Column, q_max: Column, protein_len: Column, genome_len: Column, coverage: Column, least: float = 0.90, most: int = 10) -> Column:
    """struct(start, end, n_ext, c_ext): protein ends that no HSP reached, added back when few and the coverage is high."""
    n, c = F.greatest(q_min - 1, F.lit(0)), F.greatest(protein_len - q_max, F.lit(0))
    may = (coverage >= least) & (protein_len > 0) & (n <= most) & (c <= most)
    plus = strand == "+"
    left, right = F.when(plus, n).otherwise(c) * 3, F.when(plus, c).otherwise(n) * 3
    return F.struct(
        F.when(may, F.greatest(F.lit(1), start - left)).otherwise(start).alias("start"), F.when(may, F.least(genome_len, end + right)).otherwise(end).alias("end"),
        F.when(may, n * 3).otherwise(0).alias("n_ext"), F.when(may, c * 3).otherwise(0).alias("c_ext"))


def threshold_failure(coverage: Column, identity: Column, least_coverage: float = 0.5, least_identity: float = 0.3) -> Column:
    low_c, low_i = coverage < least_coverage, identity < least_identity
    return F.when(low_c & low_i, "low_coverage_and_identity").when(low_c, "low_coverage").when(low_i, "low_identity")


def gap_filled(lifted: DataFrame) -> DataFrame:
    """lifted rows with those that failed without coordinates placed between the neighbours the reference has next to them.

    Neighbours touch in the reference; only + strand features; the gap is 0.5 to 1.5 times the reference's length.
    """
    # A record's features are few: each row sees them all through one window, and the lift behind it is computed once.
    near = F.collect_list(F.struct("feature_idx", "ref_start", "ref_end", "query_start", "query_end")).over(Window.partitionBy("record_id"))
    last = lambda test, value: F.array_max(F.transform(F.filter("_near", test), lambda x: F.struct(x["feature_idx"], x[value].alias("v"))))["v"]
    rows = lifted.withColumn("_near", near).withColumns({
        "_open": F.col("status").isin("no_hit", "translation_fail") & F.col("query_start").isNull() & F.col("query_end").isNull() & (F.coalesce("strand", F.lit("+")) == "+"),
        "_l": last(lambda x: x["ref_end"] + 1 == F.col("ref_start"), "query_end"), "_r": last(lambda x: x["ref_start"] - 1 == F.col("ref_end"), "query_start"),
    }).drop("_near")
    gap, size = F.col("_r") - F.col("_l") - 1, F.col("ref_end") - F.col("ref_start") + 1
    fill = F.coalesce(F.col("_open") & (gap >= 1) & gap.between(0.5 * size, 1.5 * size), F.lit(False))
    return rows.withColumns({
        "query_start": F.when(fill, F.col("_l") + 1).otherwise(F.col("query_start")), "query_end": F.when(fill, F.col("_r") - 1).otherwise(F.col("query_end")),
        "coverage": F.when(fill, 1.0).otherwise(F.col("coverage")), "status": F.when(fill, "ok_gap_filled").otherwise(F.col("status")),
    }).drop("_open", "_l", "_r")
