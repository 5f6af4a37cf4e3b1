"""Queries over sequences, alignments, suggestions and summaries, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import sequence as S
from strandline.functions.intervals import iou, overlap, rounded
from strandline.functions.names import DESCRIPTIVE_SYMBOLS, DESCRIPTIVE_TERMS, GENERIC_NAMES, _norm, norm
from strandline.operators import hsp, nucleotide, search, suggest, summary
from strandline.operators.suggest import ENDINGS, FINAL_NAMES
from strandline.plans.views import Tables, with_views
from strandline.schema import PASSING, REVIEWED, STATUSES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def listed(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def d_norm(x: str) -> str:
    return f"translate(lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')), '-_ ', '')"


def d_revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def d_translated(x: str) -> str:
    base = lambda k: f"(instr('TCAG', substring({x}, i * 3 + {k}, 1)) - 1)"
    return f"coalesce(array_to_string(list_transform(range(length({x}) // 3), lambda i: substring('{S.AMINO}', {base(1)} * 16 + {base(2)} * 4 + {base(3)} + 1, 1)), ''), '')"


def d_cut(a: str, b: str, strand: str = "strand") -> str:
    return f"case when {strand} = '-' then {d_revcomp(f'substring(seq, {a}, {b} - {a} + 1)')} else substring(seq, {a}, {b} - {a} + 1) end"


# A window of each genome that differs by record, on either strand.
PIECES = "pieces as (select record_id, seq, cast(rid % 40 + 1 as int) as a, cast(rid % 40 + 60 + (rid % 7) * 30 as int) as b, case when rid % 3 = 0 then '-' else '+' end as strand from records)"


def pieces(t):
    r = F.col("rid")
    return t.records.select("record_id", "seq", (r % 40 + 1).cast("int").alias("a"), (r % 40 + 60 + (r % 7) * 30).cast("int").alias("b"), F.when(r % 3 == 0, "-").otherwise("+").alias("strand"))


def piece(t):
    return pieces(t).withColumn("s", S.cut(F.col("seq"), F.col("a"), F.col("b"), F.col("strand")))


@query(f"select record_id, {d_revcomp('seq')} as rc from records", "records")
def reverse_complement(t):
    return t.records.select("record_id", S.revcomp(F.col("seq")).alias("rc"))


@query(f"with {PIECES}, s as (select record_id, {d_cut('a', 'b')} as s from pieces), p as (select record_id, split_part({d_translated('s')}, '*', 1) as p from s) select record_id, case when length(p) >= 10 then p end as protein from p", "records")
def translate_to_stop(t):
    return piece(t).select("record_id", S.protein(F.col("s")).alias("protein"))


@query(f"""with {PIECES}, s as (select record_id, {d_cut('a', 'b')} as s from pieces), f as (select record_id, s[1:3] = 'ATG' as has_start_codon, s[-3:] in ('TAA', 'TAG', 'TGA') as has_stop_codon, length(s) > 0 and length(s) % 3 = 0 as in_frame, not contains({d_translated('substring(s, 1, length(s) - 3)')}, '*') as no_internal_stop from s)
    select *, has_start_codon and has_stop_codon and in_frame and no_internal_stop as valid from f""", "records")
def cds_flags(t):
    return piece(t).select("record_id", S.cds_flags(F.col("s")).alias("f")).select("record_id", "f.*")


@query(f"with {PIECES}, s as (select record_id, {d_cut('a', 'b')} as s from pieces) select record_id, nullif(instr({d_translated('s')}, '*'), 0) * 3 as stop_end from s", "records")
def first_inframe_stop(t):
    return piece(t).select("record_id", S.first_stop_end(F.col("s")).alias("stop_end"))


@query(f"""with {PIECES}, o as (select *, 150 as expected, unnest(list_concat([case when strand = '+' then b - 150 + 1 - a else a + 150 - 1 - b end], range(-40, 41))) as o from pieces),
    c as (select record_id, expected, case when strand = '+' then a + o else a end as x, case when strand = '+' then b else b + o end as y, strand, seq, o from o),
    k as (select *, {d_cut('x', 'y')} as s from c where x >= 1 and y <= length(seq) and x <= y)
    select p.record_id, r.x as new_start, r.y as new_end, r.o as shift from pieces p left join (select *, row_number() over (partition by record_id order by case when length(s) % 3 <> 0 then 1 else 0 end, abs(length(s) - expected), abs(o), case when o < 0 then 0 else 1 end, x, y) as n from k where s[1:3] = 'ATG') r on p.record_id = r.record_id and r.n = 1""", "records")
def start_rescue(t):
    r = S.start_rescue(F.col("seq"), F.col("a"), F.col("b"), F.col("strand"), F.lit(40), F.lit(150))
    return pieces(t).select("record_id", r.alias("r")).select("record_id", F.col("r.start").alias("new_start"), F.col("r.end").alias("new_end"), F.col("r.offset").alias("shift"))


@query(f"""with {PIECES}, o as (select *, 150 as expected, unnest(range(1, 31)) as n from pieces), c as (select record_id, expected, seq, strand, n, case when strand = '+' then a else a - 3 * n end as x, case when strand = '+' then b + 3 * n else b end as y from o),
    k as (select *, {d_cut('x', 'y')} as s from c where x >= 1 and y <= length(seq))
    select p.record_id, r.x as new_start, r.y as new_end, r.n as codons from pieces p left join (select *, row_number() over (partition by record_id order by case when length(s) % 3 <> 0 then 1 else 0 end, abs(length(s) - expected), n) as k from k where s[-3:] in ('TAA', 'TAG', 'TGA')) r on p.record_id = r.record_id and r.k = 1""", "records")
def stop_rescue(t):
    r = S.stop_rescue(F.col("seq"), F.col("a"), F.col("b"), F.col("strand"), F.lit(150))
    return pieces(t).select("record_id", r.alias("r")).select("record_id", F.col("r.start").alias("new_start"), F.col("r.end").alias("new_end"), F.col("r.codons").alias("codons"))


@query(f"with f as (select record_id, seq as s, unnest([0, 1, 2]) as o, 1 as g from records union all select record_id, {d_revcomp('seq')}, unnest([0, 1, 2]), -1 from records), p as (select record_id, g * (o + 1) as frame, substring(s, o + 1) as x from f) select record_id, frame, {d_translated('x')} as protein from p", "records")
def six_frame_translate(t):
    return search.translated_frames(t.records)


#: The first frames of every fiftieth record are searched for in all records.
QUERY_GENES = "qp as (select record_id, frame, protein from fr where cast(substring(record_id, 2) as int) % 50 = 0 and frame = 1)"
K = 5


@query(f"""with f as (select record_id, seq as s, unnest([0, 1, 2]) as o, 1 as g from records union all select record_id, {d_revcomp('seq')}, unnest([0, 1, 2]), -1 from records), x as (select record_id, g * (o + 1) as frame, substring(s, o + 1) as x from f), fr as (select record_id, frame, {d_translated('x')} as protein from x), {QUERY_GENES},
    gk as (select record_id, frame, pos, substring(protein, pos, {K}) as kmer from (select *, unnest(range(1, length(protein) - {K} + 2)) as pos from fr)), qk as (select cast(substring(record_id, 2) as int) as feature_idx, pos, substring(protein, pos, {K}) as kmer from (select *, unnest(range(1, length(protein) - {K} + 2)) as pos from qp))
    select q.feature_idx, g.record_id, g.frame, g.pos - q.pos as diagonal, count(*) as seeds from gk g join qk q using (kmer) group by all having count(*) >= 2""", "records")
def kmer_seed_join(t):
    mine = search.translated_frames(t.records.where("rid % 50 = 0")).where("frame = 1").select(F.substring("record_id", 2, 9).cast("int").alias("feature_idx"), "protein")
    return search.seed_diagonals(t.records, mine, K)


#: Every fiftieth record's first frame is a protein; its stops are unknown residues.
def query_proteins(t):
    protein = F.replace(S.translated(F.col("seq")), F.lit("*"), F.lit("X"))
    return t.records.where("rid % 50 = 0").select(F.col("rid").cast("int").alias("feature_idx"), protein.alias("protein"))


PROTEINS = f"proteins as (select cast(rid as int) as feature_idx, replace({d_translated('seq')}, '*', 'X') as protein from records where rid % 50 = 0)"
FRAMES = f"""strands as (select record_id, seq as s, unnest([0, 1, 2]) as o, 1 as g from records union all select record_id, {d_revcomp('seq')}, unnest([0, 1, 2]), -1 from records),
    cutframes as (select record_id, g * (o + 1) as frame, substring(s, o + 1) as x from strands), frames as (select record_id, frame, {d_translated('x')} as residues from cutframes)"""
#: Three residues and a score of 13 are the usual parameters of such searches; SQL can still try every such word.
SIZE, LEAST, CLOSE, LONE = 3, 13, 30, 21
SCORED = ", ".join(f"('{a}', '{b}', {A.SCORES[i, j]})" for i, a in enumerate(A.ACIDS) for j, b in enumerate(A.ACIDS))
WORD_HITS = f"""{FRAMES}, {PROTEINS},
    pw as (select feature_idx, cast(q as int) as q, substring(protein, q + 1, {SIZE}) as w from (select *, unnest(range(length(protein) - {SIZE} + 1)) as q from proteins)),
    gw as (select record_id, frame, cast(s as int) as s, substring(residues, s + 1, {SIZE}) as w from (select *, unnest(range(length(residues) - {SIZE} + 1)) as s from frames)),
    pair as (select * from (values {SCORED}) v(a, b, n)),
    pd as (select distinct w as a from pw where not regexp_matches(w, '[X*]')),
    n1 as (select pd.a, b as b, n from pd join pair on pair.a = pd.a[1]), n2 as (select n1.a, n1.b || pair.b as b, n1.n + pair.n as n from n1 join pair on pair.a = n1.a[2]),
    scored as materialized (select n2.a, n2.b || pair.b as b, n2.n + pair.n as score from n2 join pair on pair.a = n2.a[3] where n2.n + pair.n >= {LEAST} or n2.a = n2.b || pair.b),
    hits as (select g.record_id, p.feature_idx, g.frame, p.q, g.s, cast(score as int) as score from scored x join pw p on p.w = x.a join gw g on g.w = x.b)"""


@query(f"""with {WORD_HITS}, far as (select *, s - q as diagonal, coalesce(cast(q - lag(q) over (partition by record_id, feature_idx, frame, s - q order by q) > {CLOSE} as int), 0) as f from hits),
    numbered as (select *, sum(f) over (partition by record_id, feature_idx, frame, diagonal order by q) as run from far),
    one as (select record_id, feature_idx, frame, diagonal, max(score) as top, min(q) as lo, max(q) as hi, count(*) as seeds, arg_max(q, (score, -q)) as best from numbered group by record_id, feature_idx, frame, diagonal, run)
    select record_id, feature_idx, frame, best as q, diagonal + best as s, seeds from one where hi - lo >= {SIZE} or top >= {LONE}""", "records")
def two_hit_runs(t):
    return search.hit_runs(t.records, query_proteins(t), SIZE, LEAST, CLOSE, LONE)


@query()
def native_hsp_search(t):
    return search.search(t.records, query_proteins(t))


# ---- nucleotide lift


OPS = """ops as (select record_id, ref_start, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) as op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) as i from alignments),
    o as (select record_id, ref_start, i, cast(op[:-2] as int) as n, op[-1:] as k from ops),
    w as (select *, ref_start + coalesce(sum(case when k in ('M', '=', 'X', 'D', 'N') then n else 0 end) over (partition by record_id order by i rows between unbounded preceding and 1 preceding), 0) as r,
        1 + coalesce(sum(case when k in ('M', '=', 'X', 'I', 'S') then n else 0 end) over (partition by record_id order by i rows between unbounded preceding and 1 preceding), 0) as q from o)"""


@query(f"with {OPS} select record_id, r::int as r, q::int as q, n from w where k in ('M', '=', 'X')", "alignments")
def alignment_runs(t):
    return nucleotide.cigar_runs(t.alignments)


# Base by base in SQL.
@query(f"""with {OPS}, base as (select record_id, r + d as rp, q + d as qp from (select *, unnest(range(n)) as d from w where k in ('M', '=', 'X')))
    select record_id, name || '/' || ord as name, "start", "end", min(qp)::int as query_start, max(qp)::int as query_end, count(*) / any_value("end" - "start" + 1) as coverage from base join reference on rp between "start" and "end" group by record_id, name, ord, "start", "end" """, "alignments", "reference")
def lift_by_alignment_runs(t):
    features = t.reference.withColumn("name", F.concat("name", F.lit("/"), F.col("ord").cast("string")))
    return nucleotide.lifted_by_runs(features, nucleotide.cigar_runs(t.alignments))


LETTERS, SPAN = 11, 5
CODE = lambda x: "(" + " + ".join(f"(instr('ACGT', {x}[{i + 1}]) - 1) * {4 ** (LETTERS - 1 - i)}" for i in range(LETTERS)) + ")"
MINIMIZERS = f"""km as (select record_id, p as pos, substring(seq, p + 1, {LETTERS}) as x from (select *, unnest(range(length(seq) - {LETTERS} + 1)) as p from records)),
    coded as (select record_id, pos, {CODE('x')} as a, {CODE(d_revcomp('x'))} as b from km),
    hashed as (select *, case when a = b then {nucleotide.PRIME} else (least(a, b) * {nucleotide.FACTOR} + {nucleotide.ADD}) % {nucleotide.PRIME} end as h from coded),
    wins as (select *, min(h) over (partition by record_id order by pos rows between current row and {SPAN - 1} following) as low, count(*) over (partition by record_id order by pos rows between current row and {SPAN - 1} following) as c from hashed),
    least_ as (select distinct w.record_id, min(g.pos) as pos from wins w join hashed g on g.record_id = w.record_id and g.pos between w.pos and w.pos + {SPAN - 1} and g.h = w.low where w.c = {SPAN} and w.low < {nucleotide.PRIME} group by w.record_id, w.pos)"""


@query(f"with {MINIMIZERS} select l.record_id, l.pos::int as pos, b < a as turned, h::bigint as hash from least_ l join hashed g on g.record_id = l.record_id and g.pos = l.pos", "records")
def genome_minimizers(t):
    return nucleotide.minimizers(t.records, LETTERS, SPAN).drop("size")


#: Anchors whose places a record's features give, with repeats and ties.
ANCHORS = """anchors as (select distinct record_id, strand, ord * 9 + "start" % 5 as r, ord * 8 + "end" % 13 + "start" % 3 as q from features)"""


@query(f"""with recursive {ANCHORS}, numbered as (select *, row_number() over (partition by record_id, strand order by r, q) as i from anchors),
    lists as (select record_id, strand, list(r order by i) as rs, list(q order by i) as qs, count(*) as n from numbered group by all),
    walk as (select record_id, strand, rs, qs, n, 1::bigint as i, [{LETTERS}::bigint] as f from lists union all
        select record_id, strand, rs, qs, n, i + 1, list_append(f, greatest({LETTERS}, list_max([
            case when rs[i + 1] > rs[j] and qs[i + 1] > qs[j] and rs[i + 1] - rs[j] <= {nucleotide.MOST_GAP} and qs[i + 1] - qs[j] <= {nucleotide.MOST_GAP}
                then f[j] + least(rs[i + 1] - rs[j], qs[i + 1] - qs[j], {LETTERS}) - case when rs[i + 1] - rs[j] = qs[i + 1] - qs[j] then 0 else 1 + abs(rs[i + 1] - rs[j] - qs[i + 1] + qs[j]) // {nucleotide.SHIFT} end else -1 end
            for j in range(1, i + 1)]))) from walk where i < n)
    select record_id, strand, list_max(f)::int as score from walk where i = n""", "features")
def anchor_chains(t):
    rows = t.features.select("record_id", "strand", (F.col("ord") * 9 + F.col("start") % 5).alias("r"), (F.col("ord") * 8 + F.col("end") % 13 + F.col("start") % 3).alias("q")).distinct()
    return nucleotide.chains(rows, LETTERS).select("record_id", "strand", "score")


# ---- intervals and alignments


@query("""with q as (select record_id, ord, "start" as a, "end" as b from features where type = 'mat_peptide'), l as (select record_id, ord, "start" as c, "end" as d from features where type = 'CDS'),
    m as (select q.record_id, q.ord as q_idx, l.ord as l_idx, greatest(least(b, d) - greatest(a, c) + 1, 0) / (greatest(b, d) - least(a, c) + 1) as iou from q join l on q.record_id = l.record_id and a <= d and c <= b)
    select record_id, q_idx, l_idx, floor(iou * 10000 + 0.5) / 10000 as iou from (select *, row_number() over (partition by record_id, q_idx order by iou desc, l_idx) as n from m) where n = 1 and iou >= 0.5""", "features")
def interval_iou_best(t):
    q = t.features.where("type = 'mat_peptide'").select("record_id", F.col("ord").alias("q_idx"), F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    x = t.features.where("type = 'CDS'").select("record_id", F.col("ord").alias("l_idx"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    return suggest.best_overlap(q, x, 0.5).select("record_id", "q_idx", "l_idx", "iou")


VOTE = """vote as (select record_id, feature_idx, case when sum(case when strand = '+' then s_hi - s_lo + 1 else 0 end) >= sum(case when strand = '-' then s_hi - s_lo + 1 else 0 end) then '+' else '-' end as voted from hsps group by all)"""
CLUSTERS = f"""{VOTE}, og as (select h.*, case when strand = '+' then s_lo - (q_lo - 1) * 3 else s_hi + (q_lo - 1) * 3 end as origin from hsps h join vote v on h.record_id = v.record_id and h.feature_idx = v.feature_idx and h.strand = v.voted),
    cj as (select *, case when origin - lag(origin) over w > greatest(150, floor(protein_len * 3 * 0.10)) then 1 else 0 end as j from og window w as (partition by record_id, feature_idx order by origin, hsp_idx)),
    cl as (select * exclude (j), (sum(j) over (partition by record_id, feature_idx order by origin, hsp_idx))::bigint as cluster from cj)"""
BEST = f"""{CLUSTERS}, cov as (select record_id, feature_idx, cluster, count(distinct x) as c from (select *, unnest(range(q_lo, q_hi + 1)) as x from cl) group by all), rk as (select record_id, feature_idx, cluster, c, sum(bits) as b from cl join cov using (record_id, feature_idx, cluster) group by all),
    bc as (select * from (select *, row_number() over (partition by record_id, feature_idx order by c desc, b desc, cluster) as n from rk) where n = 1)"""


@query(f"with {VOTE} select * from vote", "hsps")
def hsp_strand_vote(t):
    return hsp.strand_vote(t.hsps)


@query(f"with {CLUSTERS} select record_id, feature_idx, hsp_idx, origin, cluster from cl", "hsps")
def hsp_collinear_cluster(t):
    return hsp.collinear_clusters(t.hsps).select("record_id", "feature_idx", "hsp_idx", "origin", "cluster")


MERGED = f"""{BEST}, mg as (select cl.record_id, cl.feature_idx, cl.strand, cl.protein_len, min(s_lo) as "start", max(s_hi) as "end", least(1.0, bc.c / cl.protein_len) as coverage, case when sum(align_length) > 0 then sum(identities) / sum(align_length) else 0.0 end as identity, max(bits) as bits
    from cl join bc using (record_id, feature_idx, cluster) group by cl.record_id, cl.feature_idx, cl.strand, cl.protein_len, bc.c)"""


@query(f"with {MERGED} select * from mg", "hsps")
def hsp_merge(t):
    return hsp.merged(t.hsps)


@query("""with e as (select record_id, feature_idx, hsp_idx, s_lo, s_hi, q_lo, q_hi, strand, 60 as plen, 2200 as g, floor(align_length * 2.0) / 100 as cov from hsps), n as (select *, greatest(q_lo - 1, 0) as mn, greatest(plen - q_hi, 0) as mc from e), k as (select *, cov >= 0.9 and mn <= 10 and mc <= 10 as may from n)
    select record_id, feature_idx, hsp_idx, case when may then greatest(1, s_lo - 3 * case when strand = '+' then mn else mc end) else s_lo end as new_start, case when may then least(g, s_hi + 3 * case when strand = '+' then mc else mn end) else s_hi end as new_end, case when may then mn * 3 else 0 end as n_ext, case when may then mc * 3 else 0 end as c_ext from k""", "hsps")
def terminal_extrapolate(t):
    x = hsp.terminal_extension(F.col("s_lo"), F.col("s_hi"), F.col("strand"), F.col("q_lo"), F.col("q_hi"), F.lit(60), F.lit(2200), F.floor(F.col("align_length") * 2.0) / 100)
    return t.hsps.select("record_id", "feature_idx", "hsp_idx", x.alias("x")).select("record_id", "feature_idx", "hsp_idx", F.col("x.start").alias("new_start"), F.col("x.end").alias("new_end"), "x.n_ext", "x.c_ext")


@query("select record_id, feature_idx, case when coverage < 0.5 and identity / 100 < 0.3 then 'low_coverage_and_identity' when coverage < 0.5 then 'low_coverage' when identity / 100 < 0.3 then 'low_identity' end as failure from lifted", "lifted")
def threshold_gate(t):
    return t.lifted.select("record_id", "feature_idx", hsp.threshold_failure(F.col("coverage"), F.col("identity") / 100).alias("failure"))


GAPPY = """gp as (select record_id, feature_idx, name, (feature_idx - 1) * 60 + 1 as ref_start, feature_idx * 60 as ref_end, '+' as strand, case when query_start is null then null else (feature_idx - 1) * 60 + query_start % 20 end as query_start, case when query_start is null then null else feature_idx * 60 - query_start % 15 end as query_end, coverage, status from lifted)"""


@query(f"""with {GAPPY}, w as (select *, lag(query_end) over near as l, lead(query_start) over near as r from gp window near as (partition by record_id order by feature_idx)),
    k as (select *, coalesce(status = 'no_hit' and query_start is null and r - l - 1 between 30.0 and 90.0, false) as ok from w)
    select record_id, feature_idx, case when ok then l + 1 else query_start end as query_start, case when ok then r - 1 else query_end end as query_end, case when ok then 'ok_gap_filled' else status end as status, case when ok then 1.0 else coverage end as coverage from k""", "lifted")
def gap_fill_neighbours(t):
    i, q = F.col("feature_idx"), F.col("query_start")
    rows = t.lifted.select("record_id", "feature_idx", "name", ((i - 1) * 60 + 1).alias("ref_start"), (i * 60).alias("ref_end"), F.lit("+").alias("strand"), ((i - 1) * 60 + q % 20).alias("query_start"), (i * 60 - q % 15).alias("query_end"), "coverage", "status")
    return hsp.gap_filled(rows).select("record_id", "feature_idx", "query_start", "query_end", "status", "coverage")


# ---- suggestions

RAW = d_norm("raw_value")
CANON = d_norm("canonical_name")
LAST = "regexp_extract_all(lower(trim({0})), '[0-9]+[a-z]*')[-1]"
WORDS = "regexp_extract_all(lower(raw_value), '[a-z]+')"
DESCRIBED = f"len(list_filter({WORDS}, lambda w: w in {listed(DESCRIPTIVE_TERMS)})) > 0"
SYMBOLS = " or ".join(f"(r = '{_norm(n)}' and c = '{s.lower()}')" for n, s in DESCRIPTIVE_SYMBOLS.items())
CLASSIFIED = f"""z0 as (select *, {RAW} as r, {CANON} as c from suggestions),
    z1 as (select *, r = c as exact, c <> '' and case when length(c) > 1 then contains(r, c) else list_contains(list_transform(regexp_extract_all(raw_value, '[A-Za-z0-9]+'), lambda w: lower(w)), c) end as holds,
        coalesce(regexp_matches(raw_value, '[0-9]') and {LAST.format("canonical_name")} is not null and len(list_filter(list_concat(regexp_extract_all(lower(trim(raw_value)), '[a-z]+[0-9]+[a-z]*'), case when length(trim(raw_value)) <= 12 then [lower(trim(raw_value))] else [] end), lambda w: regexp_extract_all(w, '[0-9]+[a-z]*')[-1] = {LAST.format("canonical_name")})) > 0, false) as symbol,
        {SYMBOLS} as synonym, coalesce(regexp_extract(c, '^orf([0-9]+[a-z]*)$', 1) <> '' and regexp_extract(r, 'polyprotein(?:orf)?([0-9]+[a-z]*)$', 1) = regexp_extract(c, '^orf([0-9]+[a-z]*)$', 1), false) as orf,
        r in {listed(sorted({_norm(g) for g in GENERIC_NAMES}))} or (not regexp_matches(raw_value, '[0-9]') and array_to_string({WORDS}, ' ') in {listed(GENERIC_NAMES)}) as gen, {DESCRIBED} as des, regexp_full_match(trim(raw_value), '[A-Z]{{2,}}[_-]?[0-9]{{3,}}[A-Z0-9_.-]*') as tag from z0),
    z2 as (select *, exact or holds or symbol or synonym or orf as named, gen and not (synonym or orf) as plain from z1),
    z3 as (select *, case when iou >= 0.95 then 5 when iou >= 0.90 then 4 else 0 end + case when strand_match then 1 else 0 end + case when field in ('gene', 'label', 'standard_name') then 3 when field in ('product', 'note', 'locus_tag') then -1 else 0 end
        + case when exact then 5 when holds then 4 when symbol then 3 else 0 end + case when synonym then 5 else 0 end + case when orf then 5 else 0 end + case when plain then -8 when des and named then 1 else 0 end + case when tag then -6 else 0 end as total from z2),
    z4 as (select *, total >= 8 and not named as capped, case when total >= 8 and not named then 5 else total end as score from z3),
    cs as (select ord, record_id, raw_value, field, canonical_name, iou, r as norm, score, case when score >= 8 then 'save_alias' when score >= 3 then 'manual_review' else 'ignore' end as suggested_action, case when score >= 8 then 'high' when score >= 3 then 'medium' else 'low' end as confidence, score >= 8 as default_save,
        coalesce(nullif(concat_ws('; ', case when iou >= 0.90 then 'coordinate IoU ' || printf('%.2f', iou) end, case when strand_match then 'same strand' end, case when field in ('gene', 'label', 'standard_name') then 'strong field: ' || field when field in ('product', 'note', 'locus_tag') then 'weak/descriptive field: ' || field end,
        case when exact then 'exact canonical text' when holds then 'contains canonical name' when symbol then 'short gene symbol consistent with canonical' end, case when synonym then 'descriptive synonym matches canonical' end, case when orf then 'specific ORF polyprotein description matches canonical' end,
        case when plain then 'generic name' when des and named then 'descriptive term with specific gene name' when des then 'descriptive biological term' end, case when tag then 'locus tag-like value' end, case when capped then 'no name-specific alias evidence' end), ''), 'no strong alias evidence') as reason from z4)"""
DEDUPED = f"""{CLASSIFIED}, dd as (select norm, field, canonical_name, arg_max(raw_value, (score, -ord)) as raw_value, arg_max(iou, (score, -ord)) as iou, max(score) as score, arg_max(suggested_action, (score, -ord)) as suggested_action, arg_max(confidence, (score, -ord)) as confidence, arg_max(default_save, (score, -ord)) as default_save, arg_max(reason, (score, -ord)) as reason, list_sort(list(distinct record_id)) as s from cs group by norm, field, canonical_name),
    de as (select * exclude (s), len(s) as support_count, array_to_string(s[1:10], ', ') || case when len(s) > 10 then ', ... (+' || (len(s) - 10)::varchar || ')' else '' end as support_records from dd)"""
DEMOTED = f"""{DEDUPED}, tg as (select norm, field, list_sort(list(distinct canonical_name)) as t from de where norm <> '' group by norm, field),
    dm as (select de.norm, de.field, canonical_name, raw_value, iou, support_count, coalesce(len(t), 0) as n, case when len(t) >= 3 then least(score, 0) when len(t) > 1 then least(score, 5) else score end as score, case when len(t) >= 3 then 'ignore' when len(t) > 1 then 'manual_review' else suggested_action end as suggested_action,
        case when len(t) >= 3 then 'high' when len(t) > 1 then 'medium' else confidence end as confidence, case when len(t) > 1 then false else default_save end as default_save, case when len(t) > 1 then reason || '; appears with multiple canonical targets: ' || array_to_string(t, ', ') else reason end as reason, coalesce(len(t), 0) >= 3 as cross_canonical_auto_excluded from de left join tg on de.norm = tg.norm and de.field = tg.field)"""


@query(f"with {CLASSIFIED} select ord, score, suggested_action, confidence, default_save, reason from cs", "suggestions")
def suggestion_classify(t):
    return suggest.classified(t.suggestions).select("ord", "score", "suggested_action", "confidence", "default_save", "reason")


@query(f"with {DEDUPED} select norm, field, canonical_name, raw_value, score, reason, support_count, support_records from de", "suggestions")
def suggestion_dedup(t):
    return suggest.deduplicated(suggest.classified(t.suggestions)).select("norm", "field", "canonical_name", "raw_value", "score", "reason", "support_count", "support_records")


def _demoted(t):
    return suggest.demoted(suggest.deduplicated(suggest.classified(t.suggestions)))


@query(f"with {DEMOTED} select norm, field, canonical_name, score, suggested_action, confidence, default_save, reason, cross_canonical_auto_excluded, n as cross_canonical_target_count from dm", "suggestions")
def cross_canonical_demote(t):
    return _demoted(t).select("norm", "field", "canonical_name", "score", "suggested_action", "confidence", "default_save", "reason", "cross_canonical_auto_excluded", "cross_canonical_target_count")


RISKY = "regexp_matches(raw_value, '[;/,]') or regexp_matches(raw_value, '(?i)\\bor\\b') or case when regexp_extract(norm, '\\borf\\s*([0-9]+)', 1) <> '' and regexp_extract(norm, '\\borf\\s*([0-9]+)', 1) = regexp_extract({0}, '\\borf\\s*([0-9]+)', 1) then norm <> {0} else " + DESCRIBED + " and norm <> {0} end"
DIRECT = " or ".join(["norm = c", *(f"norm = c || '{e}'" for e in ENDINGS)])
REVIEW = f"""{DEMOTED}, rv as (select *, {CANON} as c from dm), rw as (select *, case when cross_canonical_auto_excluded then false when suggested_action = 'manual_review' or confidence = 'medium' then true
    when suggested_action = 'ignore' and norm <> '' and norm not in {listed(sorted({_norm(g) for g in GENERIC_NAMES}))} and (regexp_matches(raw_value, '(?i)\\borf\\s*[0-9]+[a-z]?\\b') or regexp_full_match(trim(raw_value), '[A-Za-z]{{1,4}}[0-9]+[A-Za-z]?') or ({RISKY.format("''")})) then true
    when norm <> '' and c <> '' and ({DIRECT}) then false when suggested_action = 'ignore' and confidence = 'low' then norm not in {listed(sorted({_norm(n) for n in FINAL_NAMES}))} and (support_count >= 2 or iou >= 0.90) and {DESCRIBED}
    when confidence = 'high' and ({RISKY.format("c")}) then true else false end as needs_review from rv)"""


@query(f"with {REVIEW} select norm, field, canonical_name, needs_review from rw", "suggestions")
def needs_review(t):
    return _demoted(t).select("norm", "field", "canonical_name", suggest.needs_review().alias("needs_review"))


REVIEWS = """rs as (select *, substring(sha1(norm || '|' || field || '|' || canonical_name), 1, 12) as review_id from rw), an as (select review_id, case length(norm) % 4 when 0 then 'skip' when 1 then 'save_alias' when 2 then 'ignore' else 'move_to_ambiguous' end as recommendation, case when length(norm) % 3 = 0 then 'S' else 'Q9' end as llm, case length(norm) % 3 when 0 then 'high' when 1 then 'low' else 'unsure' end as sure from rs where needs_review),
    ok as (select * from an where sure in ('low', 'medium', 'high') and (recommendation <> 'save_alias' or llm in (select canonical from aliases))), me as (select rs.*, recommendation as llm_action, ok.llm as llm_canonical_name, sure as llm_confidence, ok.review_id is not null as llm_reviewed from rs left join ok on rs.review_id = ok.review_id)"""


def _reviewed(t):
    rows = _demoted(t).withColumn("needs_review", suggest.needs_review()).withColumn("review_id", suggest.review_id(F.col("norm"), F.col("field"), F.col("canonical_name")))
    n = F.length("norm")
    answers = rows.where("needs_review").select("review_id", F.when(n % 4 == 0, "skip").when(n % 4 == 1, "save_alias").when(n % 4 == 2, "ignore").otherwise("move_to_ambiguous").alias("recommendation"), F.when(n % 3 == 0, "S").otherwise("Q9").alias("canonical_name"), F.when(n % 3 == 0, "high").when(n % 3 == 1, "low").otherwise("unsure").alias("confidence"), F.lit("r").alias("reason"))
    return suggest.merged_reviews(rows, suggest.valid_reviews(answers, t.aliases))


@query(f"with {REVIEW}, {REVIEWS} select review_id, llm_reviewed, llm_action, llm_canonical_name, llm_confidence from me", "suggestions", "aliases")
def review_merge(t):
    return _reviewed(t).select("review_id", "llm_reviewed", "llm_action", "llm_canonical_name", "llm_confidence")


@query(f"""with {REVIEW}, {REVIEWS} select review_id, case when llm_reviewed and llm_action = 'skip' then 'skip' when llm_reviewed and llm_confidence in ('medium', 'high') and llm_action = 'save_alias' and llm_canonical_name in (select canonical from aliases) then 'save'
    when llm_reviewed and llm_confidence in ('medium', 'high') and llm_action in ('ignore', 'move_to_ambiguous') then 'ignore' when default_save or suggested_action = 'save_alias' then 'save' when suggested_action = 'ignore' then 'ignore' else 'skip' end as action from me""", "suggestions", "aliases")
def default_action(t):
    known = t.aliases.select(F.col("canonical").alias("llm_canonical_name"), F.lit(True).alias("known_canonical")).distinct()
    return _reviewed(t).join(known, "llm_canonical_name", "left").withColumn("known_canonical", F.coalesce("known_canonical", F.lit(False))).select("review_id", suggest.default_action().alias("action"))


# ---- summaries


@query(f"with d as (select unnest({[s for s, _, _ in STATUSES]}) as status), n as (select status, count(*) as n from lifted group by status) select coalesce(d.status, n.status) as status, coalesce(n, 0) as n from d full join n on d.status = n.status", "lifted")
def status_summary_zero_filled(t):
    return summary.status_counts(t.lifted)


@query(f"select count(*) as features, count(*) filter (status in {listed(PASSING)}) as passing, count(*) filter (status in {listed(REVIEWED)}) as needs_review, floor(count(*) filter (status in {listed(PASSING)}) * 100 / count(*) * 10 + 0.5) / 10 as pass_rate from lifted", "lifted")
def run_health(t):
    return summary.run_health(t.lifted)


@query(f"""with b as (select record_id, count(*) filter (status in {listed(PASSING)}) as passed, count(*) as total, count(*) filter (status in {listed(REVIEWED)}) as needs_review, bool_or(method = 'direct') as d, bool_or(method = 'tblastn') as t from lifted group by record_id)
    select r.record_id, case when error is not null then 'failed' when total is null then 'empty' when b.needs_review > 0 then 'needs review' else 'passed' end as health, coalesce(passed, 0) as passed, coalesce(total, 0) as total, coalesce(b.needs_review, 0) as needs_review,
    case when d and t then 'tblastn + direct' when d then 'direct' when t then 'tblastn' else 'none' end as method, coalesce(error, '') as error from records r left join b on r.record_id = b.record_id left join errors e on r.record_id = e.record_id""", "lifted", "records", "errors")
def record_overview(t):
    return summary.record_overview(t.records, t.lifted, t.errors)


@query(f"""with b as (select record_id, count(*) filter (status in {listed(PASSING)}) as passed, count(*) as total, count(*) filter (status in {listed(REVIEWED)}) as needs_review from lifted group by record_id)
    select r.record_id, case when error is not null then 'failed' when b.needs_review > 0 then 'needs review' end as health, coalesce(b.needs_review, 0) as needs_review from records r left join b on r.record_id = b.record_id left join errors e on r.record_id = e.record_id
    where (error is not null or (total is not null and b.needs_review > 0)) and contains(lower(r.record_id), 'r1')""", "lifted", "records", "errors")
def record_search(t):
    return summary.searched(summary.record_overview(t.records, t.lifted, t.errors), ["failed", "needs review"], " R1").select("record_id", "health", "needs_review")


# Features whose gene, product or locus tag a review names, the first of the three that does.
@query(f"""with v as (select record_id || '/' || ord as key, gene, product, locus_tag from features), u as (select key, 0 as k, {d_norm("gene")} as n from v union all select key, 1, {d_norm("product")} from v union all select key, 2, {d_norm("locus_tag")} from v),
    rv as (select v as raw_value, {d_norm("v")} as n, case i % 3 when 0 then 'skip' when 1 then 'save_alias' else 'ignore' end as recommendation, 'S' || i::varchar as canonical_name from pool where i % 2 = 0), rn as (select n, arg_min(recommendation, (raw_value, recommendation, canonical_name)) as recommendation, arg_min(canonical_name, (raw_value, recommendation, canonical_name)) as canonical_name from rv group by n),
    f as (select key, arg_min(recommendation, k) as recommendation, arg_min(canonical_name, k) as canonical_name from u join rn using (n) where n <> '' group by key)
    select v.key, f.recommendation as llm_action, f.canonical_name as llm_canonical_name, f.key is not null as llm_reviewed from v left join f on v.key = f.key""", "features", "pool")
def review_by_value(t):
    i = F.col("i")
    reviews = t.pool.where("i % 2 = 0").select(F.col("v").alias("raw_value"), F.when(i % 3 == 0, "skip").when(i % 3 == 1, "save_alias").otherwise("ignore").alias("recommendation"), F.concat(F.lit("S"), i.cast("string")).alias("canonical_name"), F.lit("low").alias("confidence"), F.lit("r").alias("reason"))
    rows = t.features.select(F.concat_ws("/", "record_id", F.col("ord").cast("string")).alias("key"), F.array("gene", "product", "locus_tag").alias("candidate_values"))
    return suggest.reviews_by_value(rows, reviews).select("key", "llm_action", "llm_canonical_name", "llm_reviewed")


@query("""select record_id, count(*) filter (type = 'CDS') as cds, count(*) filter (type = 'mat_peptide') as mat_peptides, case when record_id is null then 'total' when count(*) filter (type = 'mat_peptide') > 0 then 'full' when count(*) filter (type = 'CDS') > 0 then 'CDS only' else 'none' end as class from features group by rollup (record_id)""", "features")
def annotation_class_rollup(t):
    return summary.annotation_classes(t.features)


COMPARED = """tr as (select record_id, gene as name, arg_max("start", ("end" - "start" + 1, -"start", "end")) as actual_start, arg_max("end", ("end" - "start" + 1, -"start", "end")) as actual_end from features where gene <> '' group by record_id, gene),
    cm as (select l.record_id, l.feature_idx, l.status, query_start - actual_start as start_diff, query_end - actual_end as end_diff, (query_end - query_start) - (actual_end - actual_start) as len_diff,
    case when query_start is null then status when actual_start is null then 'not_in_actual' when (query_end - query_start + 1) / (actual_end - actual_start + 1) not between 0.5 and 2.0 then 'size_mismatch' else 'matched' end as match_note from lifted l left join tr on l.record_id = tr.record_id and l.name = tr.name)"""


def _compared(t):
    return summary.compared(t.lifted, t.features.where("gene <> ''").select("record_id", F.col("gene").alias("name"), "start", "end"))


@query(f"with {COMPARED} select record_id, feature_idx, start_diff, end_diff, len_diff, match_note from cm", "lifted", "features")
def accuracy_compare(t):
    return _compared(t).select("record_id", "feature_idx", "start_diff", "end_diff", "len_diff", "match_note")


@query(f"""with {COMPARED}, c as (select record_id, count(*) as total, count(*) filter (match_note = 'matched') as matched, count(*) filter (match_note = 'matched' and start_diff = 0 and end_diff = 0) as perfect, count(*) filter (status = 'ok_rescued') as rescued, count(*) filter (status = 'invalid_boundaries') as invalid, count(*) filter (status = 'no_hit') as no_hit,
    count(*) filter (starts_with(status, 'low_coverage')) as low_coverage, count(*) filter (match_note = 'size_mismatch') as size_mismatch, count(*) filter (match_note = 'not_in_actual') as not_in_actual from cm group by rollup (record_id)) select *, case when matched > 0 then floor(perfect * 100 / matched * 10 + 0.5) / 10 else 0.0 end as perfect_pct from c""", "lifted", "features")
def accuracy_rollup(t):
    return summary.accuracy(_compared(t))


NAMES = "(values ('S', 'Spike'), ('ORF1a', 'Replicase A'), ('N', 'Nucleocapsid')) v(name, shown)"
KEY = "concat_ws('|', record_id, gene, status, coalesce(query_start::varchar, 'None'), coalesce(query_end::varchar, 'None'), strand)"


def _displayed(t):
    names = t.spark.createDataFrame([("S", "Spike"), ("ORF1a", "Replicase A"), ("N", "Nucleocapsid")], "name string, shown string")
    rows = t.lifted.join(t.records.select("record_id", "seq").hint("merge"), "record_id").withColumn("sequence", F.when(F.col("query_end") <= 384, S.cut(F.col("seq"), F.col("query_start"), F.col("query_end"), F.col("strand")))).drop("seq")
    return summary.display_rows(rows, names)


SHOWN = f"sh as (select l.*, coalesce(v.shown, l.name) as gene, case when query_end <= 384 then {d_cut('query_start', 'query_end')} end as sequence from lifted l join records r on l.record_id = r.record_id left join {NAMES} on l.name = v.name)"


@query(f"""with {SHOWN} select gene, record_id, query_start, query_end, '>' || concat_ws('|', record_id, gene, query_start::varchar, query_end::varchar, strand) || chr(10) || sequence as fasta from sh
    where gene in ('Spike', 'E', 'Nucleocapsid') and sequence <> '' and ((status = 'invalid_boundaries' and coverage > 0.8) or (status in ('ok', 'direct', 'ok_rescued', 'ok_extrapolated') and coverage >= 0.5 and identity >= 30))""", "lifted", "records")
def fasta_rows(t):
    rows = _displayed(t)
    approved = rows.where("status = 'invalid_boundaries' and coverage > 0.8").select(summary.export_key().alias("key"))
    return summary.fasta_rows(rows, ["Spike", "E", "Nucleocapsid"], approved, 0.5, 30.0)


@query(f"with {SHOWN} select record_id, feature_idx, {KEY} as key from sh", "lifted", "records")
def export_keys(t):
    return _displayed(t).select("record_id", "feature_idx", summary.export_key().alias("key"))


@query("select record_id, feature_idx, case when source_name <> '' then source_name else name end as name from lifted", "lifted")
def raw_name_tsv(t):
    return summary.raw_names(t.lifted).select("record_id", "feature_idx", "name")


@query("""select record_id, feature_idx, concat_ws(', ', 'start:' || case when has_start_codon then 'yes' else 'no' end, 'stop:' || case when has_stop_codon then 'yes' else 'no' end, 'frame:' || case when in_frame then 'yes' else 'no' end) as boundary,
    case when rescue_offset is null then '' else coalesce(rescue_target, 'start') || ' ' || printf('%+d', rescue_offset) || ' bp' end as rescue from (select * replace (case when has_stop_codon is null then null else has_stop_codon end as has_stop_codon) from lifted) where has_stop_codon is not null""", "lifted")
def boundary_text(t):
    return t.lifted.where("has_stop_codon is not null").withColumn("rescue_action", F.lit(None).cast("string")).select("record_id", "feature_idx", summary.boundary_check().alias("boundary"), summary.rescue_text().alias("rescue"))


@query(f"""with {SHOWN}, m as (select * from sh where gene in ('Spike', 'E', 'Nucleocapsid')) select count(*) filter (sequence <> '' and ((status = 'invalid_boundaries' and coverage > 0.8) or (status in ('ok', 'direct', 'ok_rescued', 'ok_extrapolated') and coverage >= 0.5))) as candidates,
    count(*) - count(*) filter (sequence <> '' and ((status = 'invalid_boundaries' and coverage > 0.8) or (status in ('ok', 'direct', 'ok_rescued', 'ok_extrapolated') and coverage >= 0.5))) as skipped from m""", "lifted", "records")
def fasta_counts(t):
    rows = _displayed(t)
    return summary.fasta_counts(rows, ["Spike", "E", "Nucleocapsid"], rows.where("status = 'invalid_boundaries' and coverage > 0.8").select(summary.export_key().alias("key")))


@query(f"select record_id, coalesce(v.shown, l.name) as gene, status, method, query_start, query_end, strand, floor(coverage * 1000 + 0.5) / 1000 as coverage, identity from lifted l left join {NAMES} on l.name = v.name", "lifted")
def display_frame(t):
    return summary.display_frame(t.lifted, t.spark.createDataFrame([("S", "Spike"), ("ORF1a", "Replicase A"), ("N", "Nucleocapsid")], "name string, shown string"))


@query("""with b as (select record_id, count(*) as n, bool_or(method = 'direct') as d, bool_or(method = 'tblastn') as t from lifted group by record_id) select r.record_id, case when error is not null or n is null then 'other' when d and t then 'mixed' when d then 'direct' when t then 'tblastn' else 'other' end as bucket from records r left join b on r.record_id = b.record_id left join errors e on r.record_id = e.record_id""", "lifted", "records", "errors")
def method_buckets(t):
    return summary.record_overview(t.records, t.lifted, t.errors).select("record_id", summary.method_bucket().alias("bucket"))


@query("select record_id, feature_idx, hsp_idx, case when f is not null then case when f < 0 then '-' else '+' end when a <= b then '+' else '-' end as side from (select *, case when hsp_idx % 2 = 0 then align_length % 7 - 3 end as f, case when align_length % 3 = 0 then s_hi else s_lo end as a, case when align_length % 3 = 0 then s_lo else s_hi end as b from hsps)", "hsps")
def hsp_strand_side(t):
    n, turned = F.col("align_length"), F.col("align_length") % 3 == 0
    side = hsp.hsp_strand(F.when(F.col("hsp_idx") % 2 == 0, n % 7 - 3), F.when(turned, F.col("s_hi")).otherwise(F.col("s_lo")), F.when(turned, F.col("s_lo")).otherwise(F.col("s_hi")))
    return t.hsps.select("record_id", "feature_idx", "hsp_idx", side.alias("side"))


@query("select record_id, feature_idx, printf('%.1f%%', coverage * 100) as coverage from lifted", "lifted")
def percent_text(t):
    return t.lifted.select("record_id", "feature_idx", summary.percent(F.col("coverage")).alias("coverage"))
