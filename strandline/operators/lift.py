"""Lifting: what becomes of each reference feature on each query genome, given the alignments of its protein.

Everything is a chain of columns over one row for each (record, feature): merged alignment, stop rescue or terminal
extension, thresholds, trim to the first stop, start rescue, status. No Python runs on the executors.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.intervals import rounded
from strandline.functions.sequence import cds_flags, cut, first_stop_end, has_start, protein, start_rescue, stop_rescue
from strandline.operators import hsp

TRUSTED_MISSING = 3
MOST_FEATURES = 20_000


@dataclass(frozen=True)
class LiftConfig:
    min_coverage: float = 0.5
    min_identity: float = 0.3
    evalue: float = 1e-5
    rescue_window: int = 200
    codons: bool = True


def reference_proteins(reference: DataFrame, genome: DataFrame) -> DataFrame:
    """reference features (feature_idx, name, start, end, strand) with protein, protein_len and atg.

    genome is the one reference record (seq); a protein under ten residues is null.
    """
    rows = reference.crossJoin(F.broadcast(genome.select("seq").limit(1))).withColumn("bases", cut(F.col("seq"), F.col("start"), F.col("end"), F.col("strand")))
    return rows.withColumns({"protein": protein(F.col("bases")), "atg": has_start(F.col("bases"))}).withColumn("protein_len", F.length("protein")).drop("seq", "bases")


def _shift(n: Column) -> Column:
    return F.format_string("%+d bp", n)


def lift(records: DataFrame, reference: DataFrame, hsps: DataFrame, config: LiftConfig = LiftConfig()) -> DataFrame:
    """Rows of schema.LIFTED. reference: as reference_proteins() gives it; hsps: schema.HSP, of any strand."""
    ref = reference.select("feature_idx", "name", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), F.col("strand").alias("ref_strand"), "protein", "protein_len", "atg")
    aligned = hsps.join(ref.select("feature_idx", "protein_len"), "feature_idx")
    ends = hsp.on_voted_strand(aligned).groupBy(*hsp.KEY).agg(F.min("q_lo").alias("q_min"), F.max("q_hi").alias("q_max"))
    spans = hsp.merged(aligned).drop("protein_len").join(ends, hsp.KEY)
    # Every record meets every feature of the one reference genome; they are sent in blocks of about MOST_FEATURES.
    blocks = -(-ref.count() // MOST_FEATURES) or 1
    met = [records.select("record_id").crossJoin(F.broadcast(ref.where(F.pmod("feature_idx", F.lit(blocks)) == b))) for b in range(blocks)]
    rows = functools.reduce(DataFrame.union, met).join(spans, hsp.KEY, "left").join(records.select("record_id", "seq", "seq_len"), "record_id")
    rows = rows.withColumns({"raw_start": F.col("start"), "raw_end": F.col("end"), "missing": F.greatest(F.col("q_min") - 1, F.lit(0)), "expected": F.col("protein_len") * 3 + 3, "strand": F.coalesce("strand", "ref_strand")})
    c = F.col
    plus = c("strand") == "+"
    failed = hsp.threshold_failure(c("coverage"), c("identity"), config.min_coverage, config.min_identity)
    early = F.when(c("protein").isNull(), "translation_fail").when(c("start").isNull(), "no_hit").otherwise(failed)
    rows = rows.withColumn("early", early)

    if not config.codons:
        rows = rows.withColumn("x", F.when(c("start").isNotNull(), hsp.terminal_extension(c("start"), c("end"), c("strand"), c("q_min"), c("q_max"), c("protein_len"), c("seq_len"), c("coverage"))))
        rows = rows.withColumns({"start": c("x.start"), "end": c("x.end")})
        rows = rows.withColumns({"sequence": cut(c("seq"), c("start"), c("end"), c("strand")), "status": F.when(c("x.n_ext") + c("x.c_ext") > 0, "ok_extrapolated").otherwise("ok")})
        rows = rows.withColumns({k: F.lit(None) for k in ("flags", "offset", "target", "action")}).withColumn("flags", F.lit(None).cast("struct<has_start_codon:boolean,has_stop_codon:boolean,in_frame:boolean>"))
        return _finished(rows)

    # The end: rescued stop, else three bases more.
    rows = rows.withColumn("s1", F.when(c("start").isNotNull(), stop_rescue(c("seq"), c("start"), c("end"), c("strand"), c("expected"))))
    rows = rows.withColumns({
        "stop_bp": c("s1.codons") * 3,
        "a": F.coalesce(c("s1.start"), F.when(plus, c("start")).otherwise(F.greatest(F.lit(1), c("start") - 3))),
        "b": F.coalesce(c("s1.end"), F.when(plus, F.least(c("end") + 3, c("seq_len"))).otherwise(c("end"))),
    }).withColumn("t", cut(c("seq"), c("a"), c("b"), c("strand")))
    # A coding sequence ends at its first in-frame stop, once its start is known.
    trim = F.when(has_start(c("t")) | ~c("atg"), first_stop_end(c("t")))
    rows = rows.withColumn("trim", F.when(trim < F.length("t"), trim))
    rows = rows.withColumns({"a": F.when(c("trim").isNotNull() & ~plus, c("b") - c("trim") + 1).otherwise(c("a")), "b": F.when(c("trim").isNotNull() & plus, c("a") + c("trim") - 1).otherwise(c("b"))})
    rows = rows.withColumn("t", cut(c("seq"), c("a"), c("b"), c("strand"))).withColumn("v", cds_flags(c("t")))
    far = c("missing") > TRUSTED_MISSING
    usable = c("early").isNull() & c("atg")
    # A valid start may lie inside the protein: look upstream, and take what is valid and nearer the expected length.
    wide = F.greatest(F.lit(config.rescue_window), c("missing") * 3 + 30)
    rows = rows.withColumn("r", F.when(usable & c("v.valid") & far, start_rescue(c("seq"), c("a"), c("b"), c("strand"), wide, c("expected"))))
    better = cds_flags(c("r.sequence"))["valid"] & (F.abs(F.length("r.sequence") - c("expected")) < F.abs(F.length("t") - c("expected")))
    rows = rows.withColumn("r", F.when(better, c("r")))
    # No start codon: look around the lifted start, or around where the missing residues should begin.
    anchor_a = F.when(far, F.when(plus, F.greatest(F.lit(1), c("raw_start") - c("missing") * 3)).otherwise(c("raw_start"))).otherwise(c("a"))
    anchor_b = F.when(far, F.when(plus, c("raw_end")).otherwise(F.least(c("seq_len"), c("raw_end") + c("missing") * 3))).otherwise(c("b"))
    window = F.when(far, c("missing") * 3 + 30).otherwise(F.lit(config.rescue_window))
    rows = rows.withColumn("n", F.when(usable & ~c("v.valid") & ~c("v.has_start_codon"), start_rescue(c("seq"), anchor_a, anchor_b, c("strand"), window, c("expected"))))
    rows = rows.withColumn("s2", F.when(c("n").isNotNull() & ~cds_flags(c("n.sequence"))["has_stop_codon"], stop_rescue(c("seq"), c("n.start"), c("n.end"), c("strand"), c("expected"))))
    rows = rows.withColumns({"a2": F.coalesce("s2.start", "n.start"), "b2": F.coalesce("s2.end", "n.end"), "t2": F.coalesce("s2.sequence", "n.sequence")}).withColumn("v2", cds_flags(c("t2")))
    new, back, stop = c("n").isNotNull(), c("r").isNotNull(), c("stop_bp").isNotNull()
    rows = rows.withColumns({
        "status": F.when(~c("atg"), "ok_no_start_codon").when(new, F.when(c("v2.valid"), "ok_rescued").otherwise("invalid_boundaries")).when(c("v.valid"), F.when(stop | back, "ok_rescued").otherwise("ok")).otherwise("invalid_boundaries"),
        "start": F.when(new, c("a2")).when(back, c("r.start")).otherwise(c("a")),
        "end": F.when(new, c("b2")).when(back, c("r.end")).otherwise(c("b")),
        "sequence": F.when(new, c("t2")).when(back, c("r.sequence")).otherwise(c("t")),
        "flags": F.when(new, F.struct(F.lit(True).alias("has_start_codon"), c("v2.has_stop_codon").alias("has_stop_codon"), c("v2.in_frame").alias("in_frame"))).when(back, F.struct(F.lit(True).alias("has_start_codon"), F.lit(True).alias("has_stop_codon"), F.lit(True).alias("in_frame"))).otherwise(F.struct(c("v.has_start_codon"), c("v.has_stop_codon"), c("v.in_frame"))),
        "offset": F.when(new, c("n.offset")).when(c("v.valid") & c("atg"), F.coalesce("r.offset", "stop_bp")),
        "target": F.when(new, F.when(c("s2").isNotNull(), "start+stop").otherwise("start")).when(c("v.valid") & c("atg"), F.when(back & stop, "start+stop").when(back, "start").when(stop, "stop")),
        "action": F.when(new, F.concat_ws("; ", F.concat(F.lit("start "), _shift(c("n.offset"))), F.concat(F.lit("stop "), _shift(c("s2.codons") * 3)))).when(c("v.valid") & c("atg") & (back | stop), F.concat_ws("; ", F.concat(F.lit("start "), _shift(c("r.offset")), F.lit(" (N-term)")), F.concat(F.lit("stop "), _shift(c("stop_bp"))))),
    }).withColumns({"low_a": c("a"), "low_b": c("b")})
    return _finished(rows)


def _finished(rows: DataFrame) -> DataFrame:
    c = F.col
    ok, hit = c("early").isNull(), c("raw_start").isNotNull() & c("protein").isNotNull()
    only = lambda x: F.when(ok, x)
    start, end = (c("start"), c("end")) if "low_a" not in rows.columns else (F.when(ok, c("start")).otherwise(c("low_a")), F.when(ok, c("end")).otherwise(c("low_b")))
    out = rows.select(
        "record_id", "feature_idx", "name", F.lit(None).cast("string").alias("source_name"), "ref_start", "ref_end", "strand", F.when(hit, start).cast("int").alias("query_start"), F.when(hit, end).cast("int").alias("query_end"),
        only(c("sequence")).alias("sequence"), F.when(hit, rounded(c("coverage"), 4)).otherwise(0.0).alias("coverage"), F.coalesce("early", "status").alias("status"), F.lit("tblastn").alias("method"),
        only(c("flags.has_start_codon")).alias("has_start_codon"), only(c("flags.has_stop_codon")).alias("has_stop_codon"), only(c("flags.in_frame")).alias("in_frame"),
        only(c("offset")).cast("int").alias("rescue_offset"), only(c("target")).cast("string").alias("rescue_target"), only(c("action")).cast("string").alias("rescue_action"),
        F.when(hit, c("raw_start")).alias("raw_start"), F.when(hit, c("raw_end")).alias("raw_end"), F.when(hit, c("missing")).alias("n_term_missing_aa"), F.when(hit, rounded(c("identity") * 100, 1)).alias("identity"), F.when(hit, rounded(c("bits"), 1)).alias("score"),
    )
    return hsp.gap_filled(out).select(*out.columns)
