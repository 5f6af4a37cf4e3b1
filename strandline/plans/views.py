"""Record, feature and alias tables derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both read, so a query and its oracle begin from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENOME = 384
#: Canonical, alias: an invented virus with ten genes.
ALIASES = (
    ("ORF1a", "replicase 1a"), ("ORF1a", "pol 1a"), ("ORF1b", "replicase 1b"), ("ORF1b", "pol-1b"), ("S", "spike"), ("S", "Spike_protein"), ("S", "surface unit"),
    ("E", "small envelope"), ("E", "surface unit"), ("M", "matrix-like"), ("M", "membrane protein"), ("N", "nucleocapsid"), ("N", "Nucleo Capsid"), ("ORF3", "accessory 3"),
    ("ORF3", "orf-3"), ("ORF7", "accessory 7"), ("2A", "two a"), ("3C", "three c protease"),
)
EXCLUDED = ("hypothetical protein", "unknown", "polyprotein", "Spike", "unnamed product", "UNKNOWN ")
#: Names that features bear, by number.
POOL = (
    "S", "spike", "Spike Protein", "ORF1a", "replicase_1a", "hypothetical protein", "ORF3", "orf 3", "unknown", "N", "Nucleo-Capsid", "glycoprotein", "E; small envelope",
    "M", "polyprotein", "XY_12345", "pol 1b", "surface unit", "accessory 7; spike", "ORF9 protein", "three c protease", "unknown; M", "envelope protein", "polyprotein ORF1a",
)
#: Virus, keyword, in order.
REGISTRY = (("Alpha virus", "steel"), ("Alpha virus", "promo brushed"), ("Beta virus", "tin"), ("Beta virus", "economy"), ("Gamma virus", "LARGE polished"), ("Gamma virus", "brass"))
REFERENCE = (("ORF1a", 1, 90, "+"), ("ORF1b", 91, 180, "+"), ("S", 181, 240, "+"), ("E", 241, 270, "+"), ("M", 271, 300, "+"), ("N", 301, 330, "+"), ("ORF3", 205, 260, "-"), ("S", 181, 246, "+"), ("3C", 331, 360, "+"))
GENES = ("ORF1a", "ORF1b", "S", "ORF3", "E", "M", "N", "3C")


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    spelt = lambda v: "null" if v is None else text(v) if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(spelt, r)) + ')' for r in rows)}) v({columns})"


def genome(key: str) -> str:
    pieces = " || ".join(f"md5({key} || ':{i}')" for i in range(GENOME // 32))
    return f"translate({pieces}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


#: Spellings of a part's name; parts that share a name and a number share it whatever the spelling.
NAMES = "case p_partkey % 4 when 0 then p_name || ' ' || cast(p_partkey % 307 as string) when 1 then upper(p_name) || '_' || cast(p_partkey % 307 as string) when 2 then p_type || ' ' || cast(p_partkey as string) else p_name || '-' || cast(p_size as string) end"


VIEWS = {
    "aliases": values([(c, a, i) for i, (c, a) in enumerate(ALIASES)], "canonical, alias, ord"),
    "excluded": values([(x, i) for i, x in enumerate(EXCLUDED)], "name, ord"),
    "pool": values(list(enumerate(POOL)), "i, v"),
    "registry": values([(1 + sorted({r[0] for r in REGISTRY}).index(v), v, k, i) for i, (v, k) in enumerate(REGISTRY)], "ord, virus, keyword, kw_ord"),
    "reference": values([(i, *r) for i, r in enumerate(REFERENCE)], 'ord, name, "start", "end", strand'),
    # Configurations as large as the parts: names with several owners, names that are excluded too, compound and odd spellings.
    "part_terms": f"""select case when p_partkey % 2 = 0 then p_brand else 'Line ' || cast(p_partkey % 97 as string) end as canonical, {NAMES} as alias, cast(p_partkey as int) as ord from part""",
    "part_excluded": """select p_type || ' ' || cast(p_size as string) as name, cast(p_partkey as int) as ord from part where p_partkey % 5 = 0
        union all select upper(p_name) || ' ' || cast(p_partkey % 307 as string), cast(p_partkey as int) from part where p_partkey % 41 = 0 union all select ' - ', cast(p_partkey as int) from part where p_partkey % 100 = 3""",
    "part_pool": f"""select cast(p_partkey as int) as i, case p_partkey % 6 when 0 then {NAMES} when 1 then {NAMES} || '; ' || p_type || ' ' || cast(p_size as string) when 2 then p_type || ' ' || cast(p_size as string) || ';' || p_brand
        when 3 then lower(p_name) || cast(p_partkey % 307 as string) when 4 then p_brand else 'odd name ' || cast(p_partkey % 50 as string) || ';; ' || {NAMES} end as v from part""",
    "part_registry": """select cast(substring(p_brand, 7) as int) as ord, 'Virus ' || p_brand as virus, p_name || ' ' || cast(p_partkey as string) as keyword, cast(p_partkey as int) as kw_ord from part""",
    "records": f"""select p_partkey as rid, 'R' || cast(p_partkey as string) as record_id, p_name as name, p_type as description,
        case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then '' else p_type || ' ' || p_name end as organism, p_brand as host, {genome("cast(p_partkey as string)")} as seq from part""",
    "alignments": """select 'R' || cast(p_partkey as string) as record_id, cast(p_partkey % 40 + 1 as int) as ref_start,
        cast(p_partkey % 7 + 5 as string) || 'S' || cast(p_partkey % 31 + 30 as string) || 'M' || cast(p_partkey % 4 + 1 as string) || 'I' || cast(p_partkey % 43 + 20 as string) || '=' || cast(p_partkey % 9 + 1 as string) || 'D'
        || cast(p_partkey % 3 + 1 as string) || 'X' || cast(p_partkey % 53 + 20 as string) || 'M' || cast(p_partkey % 11 + 1 as string) || 'N' || cast(p_partkey % 29 + 40 as string) || 'M5H' as cigar from part""",
    "raw_features": """select l_partkey as rid, cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) as int) as ord,
        case when l_linestatus = 'F' then 'CDS' else 'mat_peptide' end as type, cast((l_orderkey * 7 + l_linenumber * 31) % 300 + 1 as int) as b, cast(l_quantity as int) * 3 as n,
        case when l_returnflag = 'R' then '-' else '+' end as strand, cast((l_orderkey * 3 + l_suppkey) % 24 as int) as gi, cast((l_suppkey * 5 + l_linenumber) % 24 as int) as pi, l_linenumber % 3 as x, l_orderkey % 4 as y from lineitem""",
    "features": """select f.rid, 'R' || cast(f.rid as string) as record_id, f.ord, f.type, f.b as "start", least(f.b + f.n - 1, 384) as "end", f.strand,
        case when f.x = 0 then null when f.x = 1 and f.y = 0 then '' else g.v end as gene, case when f.y = 1 then null else p.v end as product, case when f.x = 0 and f.y = 1 then 'LT_' || cast(1000 + f.ord as string) end as locus_tag
        from raw_features f join pool g on f.gi = g.i join pool p on f.pi = p.i""",
    "visits": "select event_id as ord, 'A' || cast(user_id as string) as accession, event_type as organism, cast(floor(value * 10) as int) as length, ts from events",
    "ledger": "select distinct 'A' || cast(user_id as string) as accession from events where user_id % 7 = 0",
    "hsps": """select 'R' || cast(l_partkey as string) as record_id, cast(l_linenumber as int) as feature_idx,
        cast(row_number() over (partition by l_partkey, l_linenumber order by l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) as int) as hsp_idx,
        cast(l_orderkey % 2000 + 1 as int) as s_lo, cast(l_orderkey % 2000 + l_quantity * 3 as int) as s_hi, case when l_returnflag = 'R' then '-' else '+' end as strand,
        cast(l_suppkey % 60 + 1 as int) as q_lo, cast(l_suppkey % 60 + l_quantity as int) as q_hi, cast(l_quantity as int) as align_length, cast(floor(l_quantity * (1 - l_discount)) as int) as identities, l_quantity * 2 as bits, 400 as protein_len from lineitem""",
    "lifted": """select 'R' || cast(l_partkey as string) as record_id, cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) as int) as feature_idx,
        case l_suppkey % 8 when 0 then 'ORF1a' when 1 then 'ORF1b' when 2 then 'S' when 3 then 'ORF3' when 4 then 'E' when 5 then 'M' when 6 then 'N' else '3C' end as name,
        case when l_linenumber = 2 then 'spike' when l_linenumber = 3 then '' end as source_name,
        case when l_orderkey % 11 = 0 then null else cast((l_orderkey * 7 + l_linenumber * 31) % 300 + 1 as int) end as query_start, case when l_orderkey % 11 = 0 then null else cast((l_orderkey * 7 + l_linenumber * 31) % 300 + l_quantity * 3 as int) end as query_end,
        case when l_returnflag = 'R' then '-' else '+' end as strand, case when l_linestatus = 'F' then 'direct' else 'tblastn' end as method,
        case when l_orderkey % 11 = 0 then 'no_hit' when l_orderkey % 13 = 0 then 'odd' else case l_orderkey % 7 when 0 then 'ok_rescued' when 1 then 'invalid_boundaries' when 2 then 'low_coverage' when 3 then 'not_in_reference' when 4 then 'unresolved_name' else 'ok' end end as status,
        floor(l_quantity * 2) / 100 as coverage, floor(l_discount * 1000) as identity, l_orderkey % 5 = 0 as has_start_codon, case when l_orderkey % 3 = 0 then null else l_orderkey % 2 = 0 end as has_stop_codon, l_linenumber = 1 as in_frame,
        case when l_linenumber = 4 then cast(l_orderkey % 60 - 30 as int) end as rescue_offset, case when l_linenumber = 4 and l_orderkey % 2 = 0 then 'stop' end as rescue_target from lineitem""",
    "errors": "select 'R' || cast(p_partkey as string) as record_id, 'failed: ' || p_brand as error from part where p_partkey % 97 = 0",
    "suggestions": """select f.ord + f.rid * 100 as ord, f.record_id, f.gene as raw_value, case f.ord % 4 when 0 then 'gene' when 1 then 'product' when 2 then 'note' else 'label' end as field,
        case when f.rid % 10 < 6 then case when f.gene in ('S', 'spike', 'Spike Protein') then 'S' when f.gene like '%rf%3' then 'ORF3' when f.gene like 'poly%' or f.gene like 'rep%' then 'ORF1a' else 'M' end
             else case f.rid % 3 when 0 then 'E' when 1 then 'N' else 'ORF1a' end end as canonical_name,
        (80 + f.rid % 21) / 100.0E0 as iou, f.rid % 2 = 0 as strand_match from features f where f.gene <> ''""",
}
NEEDS = {"features": ("raw_features", "pool"), "suggestions": ("features",)}


def closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in (*closure(NEEDS.get(n, ())), n):
            if m not in out:
                out.append(m)
    return out


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that may name the views; `sql` may begin with its own WITH list."""
    own = ", ".join(f"{n} as ({VIEWS[n]})" for n in closure(names))
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {own}, {body[15:]}"
    return f"with {own}, {body[5:]}" if body[:5].lower() == "with " else f"with {own} {body}"


class Tables:
    """The views over one folder of tables, as DataFrames: Tables(spark, dir).features, and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        args: dict[str, DataFrame] = {}
        sql = VIEWS.get(name)
        if sql is None:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        for n in ("part", "lineitem", "events"):
            if f"from {n}" in sql:
                args[n] = self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet")
        if name == "records":  # a small table whose rows grow to genomes: dealt out before they do
            args["part"] = args["part"].repartition(self.spark.sparkContext.defaultParallelism, "p_partkey")
        for n in NEEDS.get(name, ()):
            args[n] = getattr(self, n)
        for n in args:
            sql = sql.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n} ", f"join {{{n}}} ")
        return self.spark.sql(sql.replace('"start"', "`start`").replace('"end"', "`end`"), **args) if args else self.spark.sql(sql.replace('"start"', "`start`").replace('"end"', "`end`"))
