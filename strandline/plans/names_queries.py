"""Queries over names, aliases, routing and direct extraction, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names as N
from strandline.functions.lineage import scratch
from strandline.functions.sequence import cut
from strandline.operators import alias, context, crawl, direct, routing
from strandline.plans.review import answer_text_column
from strandline.plans.views import GENES, Tables, with_views
from strandline.sources import tables
from strandline.sources.genbank import organism_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def d_norm(x: str) -> str:
    return f"translate(lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')), '-_ ', '')"


LOOKUP = f"""terms as (select canonical, {d_norm("canonical")} as norm from aliases union all select canonical, {d_norm("alias")} from aliases),
    mapped as (select norm, case when min(canonical) = max(canonical) then min(canonical) else '__ambiguous__' end as target from terms where norm <> '' group by norm),
    lookup as (select * from mapped union all select distinct {d_norm("name")}, '__excluded__' from excluded where {d_norm("name")} <> '' and {d_norm("name")} not in (select norm from mapped))"""
NAMED = """named as (select *, coalesce(nullif(gene, ''), nullif(product, ''), nullif(locus_tag, ''), printf('%s_%03d', type, row_number() over (partition by record_id, type order by ord))) as shown from features)"""
TARGETS = f"""q as (select record_id, ord, 1 as pr, gene as value from features where gene <> '' union all select record_id, ord, 2, product from features where product <> '' union all select record_id, ord, 3, locus_tag from features where locus_tag <> ''),
    pieces as (select *, 0 as k, {d_norm("value")} as nv from q union all select record_id, ord, pr, value, k, {d_norm("part")} from (select *, unnest(string_split(value, ';')) as part, generate_subscripts(string_split(value, ';'), 1) as k from q)),
    found as (select p.*, l.target, l.target in ('__excluded__', '__ambiguous__') as barred from pieces p join lookup l on p.nv = l.norm),
    hits as (select * from (select *, row_number() over (partition by record_id, ord, pr order by case when k = 0 then 0 when not barred then 1 else 2 end, k) as n from found) where n = 1)"""
RESOLVED = f"""{LOOKUP}, {NAMED}, {TARGETS},
    won as (select record_id, ord, count(distinct target) as kinds, count(*) filter (not barred) as good, arg_min(target, pr) filter (not barred) as target, coalesce(arg_min(value, pr) filter (not barred), arg_min(value, pr)) as source from hits group by record_id, ord),
    resolved as (select f.record_id, f.ord, f.type, f."start", f."end", f.strand, f.shown as raw_name, case when w.good > 0 then w.target else f.shown end as name, w.source as alias_source_value,
        case when w.kinds is null then 'raw' when w.good = 0 then 'excluded' when w.kinds = 1 then 'alias' else 'alias_conflict_resolved' end as name_source
        from named f left join won w on f.record_id = w.record_id and f.ord = w.ord)"""
RAW = ("features", "aliases", "excluded")


def of_parts(sql: str) -> str:
    """sql over the configuration that is derived from the parts."""
    return re.sub(r"\b(from|join) (aliases|excluded|pool|registry)\b", r"\1 part_\2", sql).replace("part_aliases", "part_terms")


def parts_lookup(t) -> DataFrame:
    return alias.alias_lookup(t.part_terms, t.part_excluded)


def named_features(t: Tables) -> DataFrame:
    # Dealt by the record alone, which serves the windows by record and type, by record and name, and joins with records.
    by = Window.partitionBy("record_id", "type").orderBy("ord")
    return t.features.repartition("record_id").withColumn("name", N.display_name(F.col("type"), F.row_number().over(by), F.col("gene"), F.col("product"), F.col("locus_tag"))).drop("rid")


def lookup(t: Tables) -> DataFrame:
    return alias.alias_lookup(t.aliases, t.excluded)


def resolved(t: Tables) -> DataFrame:
    return alias.resolve(named_features(t), lookup(t))


RESOLVED_COLUMNS = ["record_id", "ord", "type", "start", "end", "strand", "raw_name", "name", "alias_source_value", "name_source"]


@query(f"""select p_partkey, {d_norm("p_type || ' ' || p_name")} as norm, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') as slug,
    array_to_string(regexp_extract_all(lower(p_type), '[a-z]+'), ' ') as words from part""")
def name_normalize(t):
    return t.part.select("p_partkey", N.norm(F.concat_ws(" ", "p_type", "p_name")).alias("norm"), N.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), F.array_join(N.words(F.col("p_type")), " ").alias("words"))


@query(of_parts(f"""with {LOOKUP}, pieces as (select i, v, 0 as k, {d_norm("v")} as nv from pool union all select i, v, k, {d_norm("part")} from (select *, unnest(string_split(v, ';')) as part, generate_subscripts(string_split(v, ';'), 1) as k from pool)),
    found as (select p.*, target, target in ('__excluded__', '__ambiguous__') as barred from pieces p join lookup l on p.nv = l.norm)
    select p.i, p.v, f.target from pool p left join (select *, row_number() over (partition by i order by case when k = 0 then 0 when not barred then 1 else 2 end, k) as n from found) f on p.i = f.i and f.n = 1"""), "part_pool", "part_terms", "part_excluded")
def compound_alias_lookup(t):
    return alias.joined_targets(t.part_pool, parts_lookup(t), ["v"]).select("i", "v", F.col("_v").alias("target"))


@query(of_parts(f"with {LOOKUP} select norm, target from lookup"), "part_terms", "part_excluded")
def alias_lookup_build(t):
    return parts_lookup(t)


@query(of_parts(f"""with c as (select distinct {d_norm("alias")} as norm, canonical from aliases), g as (select norm, string_agg(canonical, ', ' order by canonical) as canonicals, count(*) as n from c group by norm)
    select 'several canonicals' as kind, norm, canonicals from g where n > 1 union all select 'excluded alias', norm, canonicals from g where norm in (select {d_norm("name")} from excluded)"""), "part_terms", "part_excluded")
def alias_conflicts(t):
    return alias.alias_conflicts(t.part_terms, t.part_excluded)


@query(f"with {RESOLVED} select * from resolved", *RAW)
def alias_resolve_feature(t):
    return resolved(t).select(RESOLVED_COLUMNS)


@query(of_parts(f"select name, norm from (select *, {d_norm('name')} as norm, row_number() over (partition by {d_norm('name')} order by ord, name) as n from excluded) where n = 1 and norm <> ''"), "part_excluded")
def excluded_union(t):
    return alias.ordered_distinct(t.part_excluded).select("name", "norm")


@query(f"""with {RESOLVED} select record_id, type, sum(case name_source when 'raw' then 1 when 'excluded' then -1 else 100 end)::bigint as score from resolved group by record_id, type""", *RAW)
def feature_level_score(t):
    return routing.level_scores(resolved(t))


@query(f"""with {RESOLVED}, s as (select record_id, type, sum(case name_source when 'raw' then 1 when 'excluded' then -1 else 100 end) as score from resolved group by record_id, type),
    b as (select * from (select *, row_number() over (partition by record_id order by score desc, case type when 'mat_peptide' then 0 else 1 end) as n from s) where n = 1 and score > 0)
    select r.record_id, b.type, case when b.type is null then 'tblastn' else 'direct' end as strategy from records r left join b on r.record_id = b.record_id""", "records", *RAW)
def route_strategy(t):
    return routing.route(t.records, routing.level_of(resolved(t)))


REF = """ref as (select name, arg_max("start", ord) as ref_start, arg_max("end", ord) as ref_end from reference group by name)"""
COLLAPSED = f"""{RESOLVED}, {REF}, collapsed as (select * from (select r.*, ref_start, ref_end, min(r.ord) over (partition by record_id, r.name) as first_ord,
    row_number() over (partition by record_id, r.name order by coalesce(abs((r."end" - r."start" + 1) - (ref_end - ref_start + 1)), 0), r."end" - r."start" + 1 desc, r."start", r.ord) as n from resolved r left join ref on r.name = ref.name) where n = 1)"""


@query(f"""with {COLLAPSED} select record_id, name, ord, first_ord, "start", "end" from collapsed""", "reference", *RAW)
def duplicate_collapse(t):
    return direct.collapse_duplicates(resolved(t), t.reference).select("record_id", "name", "ord", "first_ord", "start", "end")


@query(f"""with {COLLAPSED} select c.record_id, c.name, case when name_source in ('alias', 'alias_conflict_resolved') then alias_source_value end as source_name, ref_start, ref_end, strand, 'direct' as method, "start" as query_start, "end" as query_end, 1.0::double as coverage, first_ord,
    case when name_source = 'raw' then 'unresolved_name' when ref_start is null then 'not_in_reference' else 'ok' end as status,
    case when strand = '-' then reverse(translate(substring(seq, "start", "end" - "start" + 1), 'ACGT', 'TGCA')) else substring(seq, "start", "end" - "start" + 1) end as sequence
    from collapsed c join records r on c.record_id = r.record_id where name_source <> 'excluded'""", "reference", "records", *RAW)
def direct_extract_status(t):
    return direct.with_sequence(direct.direct_features(resolved(t), t.reference), t.records)


@query(f"with {NAMED} select record_id, ord, shown as name from named", "features")
def display_name_coalesce(t):
    return named_features(t).select("record_id", "ord", "name")


HITS = "case " + " ".join(f"when contains(txt, lower('{k}')) then '{v}'" for v, k in (("Alpha virus", "steel"), ("Alpha virus", "promo brushed"), ("Beta virus", "tin"), ("Beta virus", "economy"), ("Gamma virus", "LARGE polished"), ("Gamma virus", "brass"))) + " end"


@query(f"""select record_id, {HITS} as virus from (select record_id, lower(concat_ws(' ', nullif(organism, ''), nullif(description, ''), nullif(name, ''), record_id)) as txt from records)""", "records")
def registry_keyword_match(t):
    rows = t.records.withColumn("txt", N.search_text(F.col("organism"), F.col("description"), F.col("name"), F.col("record_id")))
    return crawl.keyword_match(rows, "txt", t.registry).select("record_id", "virus")


STATUS = """st as (select v.*, case when l.accession is not null then 'dup_in_ledger' when row_number() over (partition by v.accession order by v.ord) = 1 then 'new' else 'dup_in_batch' end as status from visits v left join ledger l on v.accession = l.accession)"""


@query(f"with {STATUS} select ord, accession, status from st", "visits", "ledger")
def crawl_dedup_status(t):
    return crawl.dedup_status(t.visits, t.ledger).select("ord", "accession", "status")


MANIFEST = f"""{STATUS}, ma as (select accession, organism, length::varchar as length, case organism when 'click' then 'Click virus' when 'view' then 'View virus' else '_unmatched' end as matched_virus,
    case when status <> 'new' then '' else case organism when 'click' then 'click_virus.gb' when 'view' then 'view_virus.gb' else '_unmatched.gb' end end as output_file, status from st)"""


def _manifest(t):
    registry = t.spark.createDataFrame([(1, "Click virus", "click", 0), (2, "View virus", "view", 0)], "ord int, virus string, keyword string, kw_ord int")
    return crawl.manifest(crawl.keyword_match(crawl.dedup_status(t.visits, t.ledger), "organism", registry))


@query(f"with {MANIFEST} select * from ma", "visits", "ledger")
def crawl_manifest(t):
    return _manifest(t)


@query(f"""with {MANIFEST} select 'species' as level, matched_virus as value, count(*) as n from ma where status = 'new' group by matched_virus union all select 'status', status, count(*) from ma group by status union all select 'all', null, count(*) from ma""", "visits", "ledger")
def crawl_split_counts(t):
    return crawl.split_counts(_manifest(t))


@query("select ord, accession from visits where accession not in (select accession from ledger)", "visits", "ledger")
def ledger_anti_join(t):
    return t.visits.join(t.ledger, "accession", "left_anti").select("ord", "accession")


LINE = "case when p_partkey % 10 = 0 then '# ' else '' end || p_name || ', ' || p_brand || ' ,' || p_type"


@query(f"""select accession, count(*) as n from (select unnest(string_split_regex(trim(replace({LINE}, ',', ' ')), '\\s+')) as accession from part where p_partkey % 10 <> 0) where accession <> '' group by accession""")
def accession_parse(t):
    lines = t.part.select(F.concat(F.when(F.col("p_partkey") % 10 == 0, "# ").otherwise(""), F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" ,"), F.col("p_type")).alias("value"))
    return crawl.accessions(lines).groupBy("accession").agg(F.count("*").alias("n"))


@query("""select o_orderkey, concat_ws(' AND ', '"' || o_orderpriority || '"[Organism]', case when o_orderstatus = 'F' then 'complete genome[Title]' end, case when o_custkey % 2 = 0 then (o_custkey % 1000)::varchar || ':' || (o_custkey % 1000 + 500)::varchar || '[SLEN]' end,
    case when o_orderkey % 3 = 0 then '("' || strftime(o_orderdate, '%Y/%m/%d') || '"[PDAT] : "' || strftime(o_orderdate, '%Y/%m/%d') || '"[PDAT])' end, case when o_orderkey % 5 = 0 then '"Asia"[All Fields]' end, case when o_orderkey % 7 = 0 then '(NOT patent)' end) as query from orders""")
def ncbi_query_build(t):
    c, when = F.col, lambda test, x: F.when(F.expr(test), x)
    low = when("o_custkey % 2 = 0", c("o_custkey") % 1000)
    day = when("o_orderkey % 3 = 0", c("o_orderdate"))
    made = N.ncbi_query(c("o_orderpriority"), when("o_orderstatus = 'F'", F.lit("complete genome[Title]")), low, low + 500, day, day, when("o_orderkey % 5 = 0", F.lit("Asia")), when("o_orderkey % 7 = 0", F.lit("NOT patent")))
    return t.orders.select("o_orderkey", made.alias("query"))


@query("select record_id, (rank - 1) // 200 as batch from (select record_id, row_number() over (order by rid) as rank from records)", "records")
def accession_batches(t):
    return crawl.batches(crawl.numbered(t.records.select("record_id", "rid"), "rid")).select("record_id", "batch")


@query(f"""with {RESOLVED}, cand as (select h.record_id, h.ord, count(*) filter (not barred) as good from hits h group by h.record_id, h.ord),
    v as (select q.*, h.target, coalesce(h.barred, false) as barred from q left join hits h on q.record_id = h.record_id and q.ord = h.ord and q.pr = h.pr),
    open as (select v.* from v left join cand c on v.record_id = c.record_id and v.ord = c.ord where coalesce(c.good, 0) = 0),
    rep as (select record_id, ord, arg_min(value, pr) filter (not barred) as representative, string_agg(value, '|' order by pr) as names from open group by record_id, ord)
    select representative, count(distinct record_id) as n_records, arg_min(names, (record_id, ord)) as first_candidates from rep where representative is not null group by representative""", *RAW)
def unknown_name_scan(t):
    return context.unknown_names(_candidates(t))


@query(f"""with {RESOLVED}, cand as (select h.record_id, h.ord, count(*) filter (not barred) as good from hits h group by h.record_id, h.ord),
    v as (select q.*, h.target, coalesce(h.barred, false) as barred from q left join hits h on q.record_id = h.record_id and q.ord = h.ord and q.pr = h.pr),
    open as (select v.* from v left join cand c on v.record_id = c.record_id and v.ord = c.ord where coalesce(c.good, 0) = 0)
    select distinct representative, record_id from (select record_id, ord, arg_min(value, pr) filter (not barred) as representative from open group by record_id, ord) where representative is not null""", *RAW)
def unknown_name_records(t):
    return context.unknown_name_records(_candidates(t))


def _candidates(t):
    table = alias.lookup_map(lookup(t))
    one = lambda c: F.when(F.col(c) != "", F.struct(F.col(c).alias("value"), alias.target_of(F.col(c), table).alias("target"), F.coalesce(alias.is_sentinel(alias.target_of(F.col(c), table)), F.lit(False)).alias("sentinel")))
    return t.features.select("record_id", "ord", F.filter(F.array(one("gene"), one("product"), one("locus_tag")), lambda x: x.isNotNull()).alias("candidates"))


#: Names as reviewers see them, and the canonicals there are.
SHOWN_NAMES = "case i % 8 when 0 then v when 1 then v || ' protein' when 2 then v || '-CDS' when 3 then 'replicase polyprotein 1a' when 4 then 'ORF1a/1b ' || v when 5 then 'contains ORF1a and ORF1b' when 6 then upper(v) || ' gene' else 'polyprotein ORF' || i || 'b' end"
AVAILABLE = ("ORF1a", "ORF1ab", "ORF7b", "orf-7b", "S", "E", "M", "N", "Spike", "ORF3")


@query(f"""with s as (select p_partkey, {SHOWN_NAMES.replace("i %", "p_partkey %").replace("|| i ||", "|| (p_partkey % 9)::varchar ||").replace(" v ", " p.v ").replace("(v)", "(p.v)")} as raw_value from part join pool p on p_partkey % 24 = p.i),
    c as (select unnest({list(AVAILABLE)}) as canonical, unnest(range({len(AVAILABLE)})) as k), n as (select *, {d_norm("raw_value")} as r, {d_norm("canonical")} as z from s, c),
    m as (select *, case when r = z then 0 when r in (z || 'protein', z || 'polyprotein', z || 'gene', z || 'cds') then 1 when regexp_extract(z, '^orf([0-9]+[a-z]*)$', 1) <> '' and regexp_extract(r, 'polyprotein(?:orf)?([0-9]+[a-z]*)$', 1) = regexp_extract(z, '^orf([0-9]+[a-z]*)$', 1) then 2
        when z = 'orf1ab' and (regexp_matches(lower(raw_value), 'orf\\s*1a\\s*/\\s*(?:orf\\s*)?1?b') or regexp_matches(lower(raw_value), 'orf\\s*1a\\s+and\\s+orf\\s*1b')) then 3 end as tier from n)
    select p_partkey, max(raw_value) as raw_value, arg_min(canonical, (tier, length(canonical), k)) filter (tier is not null) as canonical from m group by p_partkey""", "pool")
def best_available_canonical(t):
    i, v = F.col("p_partkey") % 8, F.col("v")
    shown = F.when(i == 0, v).when(i == 1, F.concat(v, F.lit(" protein"))).when(i == 2, F.concat(v, F.lit("-CDS"))).when(i == 3, "replicase polyprotein 1a").when(i == 4, F.concat(F.lit("ORF1a/1b "), v)).when(i == 5, "contains ORF1a and ORF1b").when(i == 6, F.concat(F.upper(v), F.lit(" gene"))).otherwise(F.concat(F.lit("polyprotein ORF"), (F.col("p_partkey") % 9).cast("string"), F.lit("b")))
    rows = t.part.join(t.pool, F.col("p_partkey") % 24 == F.col("i")).select("p_partkey", shown.alias("raw_value"))
    return rows.withColumn("canonical", N.best_canonical(F.col("raw_value"), F.array(*map(F.lit, AVAILABLE))))


@query(of_parts(f"""with {LOOKUP}, dec as (select {d_norm("v")} as norm, 'NEW' || i::varchar as target from pool where i % 5 = 0), d as (select norm, min(target) as target from dec group by norm)
    select norm, target from d union all select norm, target from lookup where norm not in (select norm from d)"""), "part_pool", "part_terms", "part_excluded")
def effective_lookup_overlay(t):
    decisions = t.part_pool.where("i % 5 = 0").select(N.norm(F.col("v")).alias("norm"), F.concat(F.lit("NEW"), F.col("i").cast("string")).alias("target"))
    return alias.overlay(parts_lookup(t), decisions)


@query(of_parts("""select canonical, string_agg(alias, '; ' order by ord) as aliases from aliases group by canonical having contains(translate(lower(canonical || ' ' || string_agg(alias, ' ' order by ord)), '-_ ', ''), 'ring1')"""), "part_terms")
def canonical_search(t):
    return alias.search_canonicals(t.part_terms, "RING-1")


@query(of_parts("""with k as (select ord as o, virus, keyword, kw_ord from registry union all select distinct ord, virus, virus, -1 from registry)
    select dense_rank() over (order by o)::int - 1 as ord, virus, keyword, (row_number() over (partition by virus order by length(keyword) desc, kw_ord))::int - 1 as kw_ord, virus || '.json' as alias_config from k"""), "part_registry")
def registry_scan(t):
    keywords = F.transform(F.array_sort(F.collect_list(F.struct("kw_ord", "keyword"))), lambda x: x["keyword"])
    entries = t.part_registry.groupBy("ord", "virus").agg(keywords.alias("keywords"))
    entry = F.struct("ord", F.col("virus").alias("virus_name"), "keywords", F.concat("virus", F.lit(".json")).alias("alias_config"))
    file = entries.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("ord")).alias("viruses"))).alias("value"))
    return tables.scan_registry(t.spark, written(file), with_name=True)


def written(file: DataFrame) -> str:
    """The folder of a text file with the one row of file."""
    path = scratch(file.sparkSession)
    file.coalesce(1).write.text(path)
    return path


def _config(t) -> str:
    """An alias configuration file: every third canonical has the object shape with a parent, the exclusions are in three lists."""
    aliases = F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"])
    rows = t.part_terms.groupBy("canonical").agg(F.min("ord").alias("first"), aliases.alias("a"))
    plain, shaped = F.to_json("a"), F.to_json(F.struct(F.col("a").alias("aliases"), F.lit("Line 1").alias("parent")))
    entry = F.expr("concat(substring(k, 2, length(k) - 2), ':', v)")
    rows = rows.select("first", F.to_json(F.array("canonical")).alias("k"), F.when(F.col("first") % 3 == 0, shaped).otherwise(plain).alias("v")).select("first", entry.alias("e"))
    names = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "e"))), lambda x: x["e"]), ",").alias("names"))
    listed = lambda k: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") % 3 == k, F.struct("ord", "name")))), lambda x: x["name"]))
    barred = t.part_excluded.agg(*(listed(k).alias(f"x{k}") for k in range(3)))
    text = F.concat(F.lit('{"canonical_names":{'), "names", F.lit('},"excluded_names":'), "x0", F.lit(',"ignored_names":'), "x1", F.lit(',"ambiguous_names":'), "x2", F.lit("}"))
    return written(names.crossJoin(barred).select(text.alias("value")))


@query(of_parts("""with f as (select canonical, min(ord) as first from aliases group by canonical), r as (select canonical, canonical as alias, first, -1 as ord from f union all select a.canonical, alias, first, ord from aliases a join f on a.canonical = f.canonical)
    select canonical, alias, (dense_rank() over (order by first) - 1) * 1000000 + row_number() over (partition by canonical order by ord) - 1 as ord from r"""), "part_terms")
def alias_config_scan(t):
    return tables.scan_alias_config(t.spark, _config(t))[0]


@query(of_parts("""select name, (ord % 3) * 1000000 + row_number() over (partition by ord % 3 order by ord, name) - 1 as ord from excluded"""), "part_excluded")
def alias_exclusion_scan(t):
    return tables.scan_alias_config(t.spark, _config(t))[1]


@query(of_parts("""with f as (select canonical, min(ord) as first from aliases group by canonical) select canonical as name, case when first % 3 = 0 then 'Line 1' end as parent from f"""), "part_terms")
def alias_parent_scan(t):
    return tables.scan_alias_config(t.spark, _config(t))[2]


@query("""select record_id, case when organism <> '' then organism when rid % 3 = 0 then host else '' end as organism from records""", "records")
def organism_fallback(t):
    source = F.struct(F.when(F.col("rid") % 2 == 0, "source").when(F.col("rid") % 3 == 0, "source").otherwise("CDS").alias("type"), F.when(F.col("rid") % 3 == 0, F.create_map(F.lit("organism"), F.array("host"))).otherwise(F.create_map(F.lit("strain"), F.array("host"))).alias("qualifiers"))
    return organism_of(t.records.withColumn("features", F.array(source))).select("record_id", "organism")


@query("""select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_brand || p_type when 2 then p_type else null end as answer from part""")
def review_answer_text(t):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    k, items = F.col("p_partkey") % 4, F.array(F.struct(F.array(part("output_text", F.col("p_brand")), part("refusal", F.lit("no"))).alias("content")), F.struct(F.array(part("text", F.col("p_type"))).alias("content")))
    body = F.struct(F.when(k == 0, F.col("p_name")).when(k == 1, "").alias("output_text"), F.when(k == 1, items).when(k == 2, F.slice(items, 2, 1)).when(k == 3, F.array(F.struct(F.array(part("refusal", F.lit("no"))).alias("content")))).alias("output"))
    return t.part.select("p_partkey", answer_text_column(F.to_json(body)).alias("answer"))


def _links(t):
    return t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 50 != 0, F.concat(F.lit("P"), F.floor(F.col("p_partkey") * 2 / 3).cast("string"))).alias("parent"))


LINKS = "links as (select 'P' || p_partkey::varchar as name, case when p_partkey % 50 <> 0 then 'P' || floor(p_partkey * 2 / 3)::bigint::varchar end as parent from part)"


@query(f"""with recursive {LINKS}, up(name, ancestor, distance) as (select name, parent, 1 from links where parent is not null union all select u.name, l.parent, u.distance + 1 from up u join links l on u.ancestor = l.name where l.parent is not null)
    select name, ancestor, distance::int as distance from up""")
def parent_tree(t):
    return alias.parent_closure(_links(t))


@query(f"with {LINKS} select parent, string_agg(name, ', ' order by name) as children from links where parent is not null group by parent")
def children_map(t):
    return alias.children(_links(t))


@query(f"with {LINKS} select name, 'missing parent' as fault from links where parent is not null and parent not in (select name from links)")
def parent_faults(t):
    links = _links(t)
    return alias.parent_faults(links.select("name"), links)


CODING = f"""{RESOLVED}, co as (select record_id, ord, "start", "end", case when name_source in ('alias', 'alias_conflict_resolved') then name end as canonical from resolved where type = 'CDS')"""
AROUND = f"""{CODING}, nb as (select c.*, (select arg_max(b.canonical, (b."start", b.ord)) from co b where b.record_id = c.record_id and b."start" < c."start" and b.canonical is not null) as neighbor_before,
    (select arg_min(b.canonical, (b."start", b.ord)) from co b where b.record_id = c.record_id and b."start" > c."start" and b.canonical is not null) as neighbor_after from co c)"""


def _coding(t):
    named = F.col("name_source").isin("alias", "alias_conflict_resolved")
    return resolved(t).where("type = 'CDS'").select("record_id", "ord", "start", "end", F.when(named, F.col("name")).alias("canonical"))


@query(f"""with {AROUND} select record_id, ord, neighbor_before, neighbor_after from nb""", *RAW)
def position_neighbours(t):
    return context.neighbours(_coding(t)).select("record_id", "ord", "neighbor_before", "neighbor_after")


@query(f"""with {CODING} select c.record_id, c.ord, arg_min(coalesce(o.canonical, 'an unnamed coding feature'), (o."start", o.ord)) as container from co c join co o on c.record_id = o.record_id and o."start" <= c."start" and o."end" >= c."end" and o."end" - o."start" > c."end" - c."start" group by c.record_id, c.ord""", *RAW)
def enclosing_feature(t):
    return context.enclosing(_coding(t))


@query(f"""with {AROUND}, g as (select {list(GENES)} as genes), p as (select nb.*, genes, case when neighbor_before is null then 0 else list_position(genes, neighbor_before) end as i, case when neighbor_after is null then {len(GENES) + 1} else list_position(genes, neighbor_after) end as j from nb, g)
    select record_id, ord, case when (neighbor_before is null or i > 0) and (neighbor_after is null or j > 0) and j - i > 1 then array_to_string(genes[i + 1 : j - 1], ',') else '' end as candidates from p""", *RAW)
def slot_candidates(t):
    rows = context.neighbours(_coding(t))
    return rows.select("record_id", "ord", F.array_join(context.slot_candidates(F.col("neighbor_before"), F.col("neighbor_after"), list(GENES)), ",").alias("candidates"))


@query("""select f.record_id, f.ord, exists (select 1 from features o where o.record_id = f.record_id and o.ord <> f.ord and o."start" <= f."start" and o."end" >= f."end" and f."end" - f."start" + 1 < 0.8 * (o."end" - o."start" + 1)) as is_sub from features f""", "features")
def containment_split(t):
    return context.sub_features(t.features).select("record_id", "ord", "is_sub")


def spans(t):
    return t.features.join(t.records.select("record_id", "seq"), "record_id").select("record_id", "ord", cut(F.col("seq"), F.col("start"), F.col("end"), F.col("strand")).alias("sequence"))


@query(f"""with {NAMED}, g as (select record_id, count(*) filter (type = 'mat_peptide') as m, count(*) filter (type = 'CDS') as c, count(*) filter (type = 'CDS' and (lower(shown) in ('', 'unknown') or contains(lower(shown), 'polyprotein'))) as s from named group by record_id)
    select record_id, case when m > 0 then 'mat_peptide' else 'CDS' end as type from g where m > 0 or (c > 0 and not (c = 1 and s = 1))""", "features")
def level_by_type(t):
    return routing.level_without_lookup(named_features(t))


@query(f"""with x as (select p_partkey, v, k, {d_norm("v")} as n from (select p_partkey, trim(unnest(string_split_regex(p_name || ',' || p_brand || chr(10) || ' ' || upper(p_name) || ',,' || p_type, '[,\\n]+'))) as v, generate_subscripts(string_split_regex(p_name || ',' || p_brand || chr(10) || ' ' || upper(p_name) || ',,' || p_type, '[,\\n]+'), 1) as k from part))
    select p_partkey, string_agg(v, '|' order by k) as keywords from (select *, row_number() over (partition by p_partkey, n order by k) as r from x where n <> '') where r = 1 group by p_partkey""")
def keyword_split(t):
    text = F.concat(F.col("p_name"), F.lit(","), F.col("p_brand"), F.lit("\n "), F.upper("p_name"), F.lit(",,"), F.col("p_type"))
    return t.part.select("p_partkey", F.array_join(N.first_wins(F.transform(F.split(text, "[,\\n]+"), lambda k: F.trim(k))), "|").alias("keywords"))


DECISIONS = f"""d as (select v as raw_value, case i % 3 when 0 then 'Line 7' when 1 then 'Brand#1' else 'New name' end as canonical, case i % 4 when 0 then 'save' when 1 then 'ignore' else 'skip' end as action, i from pool),
    s as (select raw_value, canonical, i + 1048576 as ord, {d_norm("raw_value")} as n, row_number() over (partition by canonical, {d_norm("raw_value")} order by i) as k from d where action = 'save'),
    known as (select canonical, {d_norm("alias")} as n from aliases union select canonical, {d_norm("canonical")} from aliases)"""


def _decided(t):
    from strandline.operators.suggest import applied

    i = F.col("i")
    decisions = t.part_pool.select(F.col("v").alias("raw_value"), F.when(i % 3 == 0, "Line 7").when(i % 3 == 1, "Brand#1").otherwise("New name").alias("canonical_name"), F.when(i % 4 == 0, "save").when(i % 4 == 1, "ignore").otherwise("skip").alias("action"), i.alias("ord"))
    return applied(t.part_terms, t.part_excluded, decisions)


@query(of_parts(f"with {DECISIONS} select canonical, alias, ord from aliases union all select canonical, raw_value, ord from s where k = 1 and (canonical, n) not in (select canonical, n from known)"), "part_pool", "part_terms")
def decisions_applied(t):
    return _decided(t)[0]


@query(of_parts(f"""with {DECISIONS}, b as (select name, {d_norm("name")} as n, 0 as late, ord from excluded union all select raw_value, {d_norm("raw_value")}, 1, i from d where action = 'ignore')
    select name from (select *, row_number() over (partition by n order by late, ord, name) as k from b where n <> '') where k = 1 and n not in (select n from s)"""), "part_pool", "part_terms", "part_excluded")
def decisions_excluded(t):
    return _decided(t)[1]


@query(of_parts(f"""with c as (select distinct {d_norm("alias")} as norm, canonical from aliases), g as (select norm from c group by norm having count(*) > 1 union select norm from c where norm in (select {d_norm("name")} from excluded))
    select canonical, alias, ord from aliases where {d_norm("alias")} not in (select norm from g)"""), "part_terms", "part_excluded")
def alias_terms_without_conflicts(t):
    return alias.validated(alias.without_conflicts(t.part_terms, t.part_excluded), t.part_excluded)


@query(f"""select ord, n.canonical as canonical_override, coalesce(n.canonical, s.canonical_name) as canonical_name from suggestions s left join (select distinct canonical from aliases) n on {d_norm("s.raw_value")} = {d_norm("n.canonical")}""", "suggestions", "aliases")
def seed_override(t):
    from strandline.operators import suggest

    return suggest.seed_override(t.suggestions, t.aliases).select("ord", "canonical_override", "canonical_name")


@query(of_parts("select virus, arg_max(keyword, (length(keyword), -kw_ord)) as keyword from registry group by virus"), "part_registry")
def longest_keyword(t):
    return crawl.longest_keyword(t.part_registry)
