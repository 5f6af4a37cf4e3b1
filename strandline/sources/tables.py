"""Smaller sources: alias and registry JSON, accession lists, ledger, alignments, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.crawl import accessions
from strandline.operators.hsp import hsp_strand
from strandline.schema import HSP


#: Names in a list of a configuration, at most.
ORDS = 1_000_000


def check_alias_config(config: dict) -> dict:
    """config, or an error that says what is wrong with its shape."""
    if not isinstance(config, dict) or not isinstance(config.get("canonical_names"), dict):
        raise ValueError("an alias configuration needs an object canonical_names")
    for name, entry in config["canonical_names"].items():
        aliases = entry.get("aliases", []) if isinstance(entry, dict) else entry
        if not isinstance(aliases, list) or not all(isinstance(a, str) for a in aliases):
            raise ValueError(f"aliases of {name} must be a list of strings")
    for key in ("excluded_names", "ignored_names", "ambiguous_names"):
        if not isinstance(config.get(key, []), list):
            raise ValueError(f"{key} must be a list")
    return config


def config_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, excluded, links) of a configuration; both shapes of entry, and the older lists of exclusions, are read."""
    terms, links, n = [], [], 0
    for name, entry in check_alias_config(config)["canonical_names"].items():
        for a in [name, *(entry.get("aliases", []) if isinstance(entry, dict) else entry)]:
            terms.append((name, a, n))
            n += 1
        links.append((name, entry.get("parent") if isinstance(entry, dict) else None))
    barred = [x for key in ("excluded_names", "ignored_names", "ambiguous_names") for x in config.get(key, [])]
    return (
        spark.createDataFrame(terms, "canonical string, alias string, ord int"),
        spark.createDataFrame([(x, i) for i, x in enumerate(barred)], "name string, ord int"),
        spark.createDataFrame(links, "name string, parent string"),
    )


def read_alias_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return config_tables(spark, json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect())))


def tables_config(virus: str, terms: DataFrame, excluded: DataFrame, links: DataFrame | None = None, notes: str = "") -> dict:
    """The configuration that config_tables() reads back; entries with a parent have the object shape."""
    parents = {r["name"]: r["parent"] for r in links.where("parent is not null").collect()} if links is not None else {}
    names: dict = {}
    for r in terms.orderBy("ord").collect():
        names.setdefault(r["canonical"], [])
        if r["alias"] != r["canonical"]:
            names[r["canonical"]].append(r["alias"])
    shaped = {n: {"aliases": a, "parent": parents[n]} if n in parents else a for n, a in names.items()}
    return {"virus": virus, "notes": notes, "excluded_names": [r["name"] for r in excluded.collect()], "canonical_names": shaped}


def check_registry(registry: dict) -> list[dict]:
    entries = registry.get("viruses") if isinstance(registry, dict) else None
    if not isinstance(entries, list):
        raise ValueError("a registry needs a list viruses")
    for e in entries:
        if not isinstance(e, dict) or not e.get("virus_name") or not isinstance(e.get("keywords", []), list) or not e.get("alias_config"):
            raise ValueError(f"registry entry needs virus_name, keywords and alias_config: {e}")
    return entries


def registry_table(spark: SparkSession, registry: dict, with_name: bool = False) -> DataFrame:
    """(ord, virus, keyword, kw_ord, alias_config). with_name: the virus name is a keyword too and the longest come first."""
    rows = []
    for i, e in enumerate(check_registry(registry)):
        words = list(e.get("keywords", []))
        if with_name:
            words = sorted([e["virus_name"], *words], key=len, reverse=True)
        rows += [(i, e["virus_name"], w, k, e["alias_config"]) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "ord int, virus string, keyword string, kw_ord int, alias_config string")


def scan_registry(spark: SparkSession, path: str, with_name: bool = False) -> DataFrame:
    """registry_table() of a registry file, of any size, as columns."""
    schema = "viruses array<struct<virus_name:string,keywords:array<string>,alias_config:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    wrong = rows.where("viruses is null or exists(viruses, e -> coalesce(e.virus_name, '') = '' or coalesce(e.alias_config, '') = '')")
    if rows.isEmpty() or not wrong.isEmpty():
        raise ValueError("a registry needs a list viruses, each with virus_name, keywords and alias_config")
    words = F.coalesce(F.col("e.keywords"), F.array().cast("array<string>"))
    if with_name:
        longest = F.transform(F.array_sort(F.transform(F.concat(F.array("e.virus_name"), words), lambda w, k: F.struct((-F.length(w)).alias("n"), k.alias("k"), w.alias("w")))), lambda x: x["w"])
        words = longest
    rows = rows.select(F.posexplode("viruses").alias("ord", "e"))
    return rows.select("ord", F.col("e.virus_name").alias("virus"), F.posexplode(words).alias("kw_ord", "keyword"), F.col("e.alias_config").alias("alias_config")).select("ord", "virus", "keyword", "kw_ord", "alias_config")


def scan_alias_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """config_tables() of a configuration file, of any size, as columns; ord is a name's place times ORDS, plus the place in its list."""
    lists = ("excluded_names", "ignored_names", "ambiguous_names")
    rows = spark.read.schema("canonical_names map<string,string>, " + ", ".join(f"{x} array<string>" for x in lists)).json(path, multiLine=True)
    entries = rows.select(F.posexplode("canonical_names").alias("i", "name", "entry"))
    # An entry is a list of aliases, or an object that has one and perhaps a parent.
    shaped = F.startswith(F.ltrim("entry"), F.lit("{"))
    of = F.from_json("entry", "aliases array<string>, parent string")
    entries = entries.select("i", "name", F.when(shaped, F.coalesce(of["aliases"], F.array().cast("array<string>"))).otherwise(F.from_json("entry", "array<string>")).alias("aliases"), F.when(shaped, of["parent"]).alias("parent"))
    if rows.where("canonical_names is not null").isEmpty() or not entries.where("aliases is null").isEmpty():
        raise ValueError("an alias configuration needs an object canonical_names, whose entries list their aliases")
    terms = entries.select("i", F.col("name").alias("canonical"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("k", "alias"))
    barred = rows.select(F.posexplode(F.array(*lists)).alias("i", "l")).select("i", F.posexplode("l").alias("k", "name"))
    ord_ = (F.col("i").cast("long") * ORDS + F.col("k")).alias("ord")
    return terms.select("canonical", "alias", ord_), barred.select("name", ord_), entries.select("name", "parent")


def upsert_entry(registry: dict, virus: str, keywords: list[str], alias_config: str) -> dict:
    """The registry with the entry added, or its keywords extended; keywords are distinct regardless of case."""
    entries = [dict(e) for e in check_registry(registry)]
    mine = next((e for e in entries if e["virus_name"].lower() == virus.lower()), None)
    if mine is None:
        mine = {"virus_name": virus, "keywords": [], "alias_config": alias_config}
        entries.append(mine)
    known = {k.lower() for k in mine["keywords"]}
    mine["keywords"] = mine["keywords"] + [k for k in dict.fromkeys(k.strip() for k in keywords) if k and k.lower() not in known]
    return {**registry, "viruses": entries}


def remove_entry(registry: dict, virus: str) -> dict:
    return {**registry, "viruses": [e for e in check_registry(registry) if e["virus_name"].lower() != virus.lower()]}


def set_keywords(registry: dict, virus: str, keywords: list[str]) -> dict:
    """The registry with an entry's keywords replaced; they are distinct regardless of case, blank ones are left out."""
    kept = {k.strip().lower(): k.strip() for k in reversed(keywords) if k.strip()}
    chosen = [k for k in dict.fromkeys(kept[k.strip().lower()] for k in keywords if k.strip())]
    return {**registry, "viruses": [{**e, "keywords": chosen} if e["virus_name"].lower() == virus.lower() else e for e in check_registry(registry)]}


def rename_entry(registry: dict, virus: str, name: str) -> dict:
    """The registry with an entry renamed; an error where the new name is taken or the old one is not there."""
    entries = check_registry(registry)
    names = [e["virus_name"].lower() for e in entries]
    if virus.lower() not in names or (name.lower() in names and name.lower() != virus.lower()) or not name.strip():
        raise ValueError(f"cannot rename {virus} to {name}")
    return {**registry, "viruses": [{**e, "virus_name": name.strip()} if e["virus_name"].lower() == virus.lower() else e for e in entries]}


def resolve_config(name: str, registry_path: str, packaged: str) -> str | None:
    """The first that exists of: the path as written, next to the registry, in the packaged folder."""
    p = Path(name)
    return next((str(c) for c in (p, Path(registry_path).parent / p.name, Path(packaged) / p.name) if c.exists()), None)


def free_path(path: str) -> str:
    """path, or path with _2, _3, … where it is taken."""
    p, n = Path(path), 2
    out = p
    while out.exists():
        out = p.with_name(f"{p.stem}_{n}{p.suffix}")
        n += 1
    return str(out)


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    return accessions(spark.read.text(path))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(accession); a folder that doesn't exist yet is an empty ledger."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "accession string")
    return lines.select(F.trim("value").alias("accession")).where("accession <> '' and not startswith(accession, '#')").distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


BLAST = "record_id string, feature string, s_start int, s_end int, q_start int, q_end int, frame int, align_length int, identities int, bits double"


def read_tabular_hits(spark: SparkSession, path: str) -> DataFrame:
    """HSPs from tab-separated rows: record_id, feature_idx, s_start, s_end, q_start, q_end, frame, align_length, identities, bits."""
    rows = spark.read.schema(BLAST.replace("feature string", "feature_idx int")).option("sep", "\t").option("comment", "#").csv(path)
    return numbered_hits(rows)


def numbered_hits(rows: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in HSP.split(", ")]
    by = Window.partitionBy("record_id", "feature_idx").orderBy(F.col("bits").desc(), "s_start", "q_start")
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return rows.withColumns({"hsp_idx": F.row_number().over(by) - 1, "strand": hsp_strand(F.col("frame"), F.col("s_start"), F.col("s_end")), "s_lo": low("s_start", "s_end"), "s_hi": high("s_start", "s_end"), "q_lo": low("q_start", "q_end"), "q_hi": high("q_start", "q_end")}).select(names)


def read_blast_xml(spark: SparkSession, path: str, record_id: str) -> DataFrame:
    """HSPs of one search report (XML); the query's definition is the feature number, and only its first alignment counts."""
    part = T.StructType([T.StructField(n, T.DoubleType() if n == "Hsp_bit-score" else T.IntegerType()) for n in ("Hsp_bit-score", "Hsp_query-from", "Hsp_query-to", "Hsp_hit-from", "Hsp_hit-to", "Hsp_hit-frame", "Hsp_identity", "Hsp_align-len")])
    hits = T.StructType([T.StructField("Hit", T.ArrayType(T.StructType([T.StructField("Hit_hsps", T.StructType([T.StructField("Hsp", T.ArrayType(part))]))])))])
    schema = T.StructType([T.StructField("Iteration_query-def", T.StringType()), T.StructField("Iteration_hits", hits)])
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(schema).load(path)
    first = F.try_element_at(F.col("Iteration_hits.Hit"), F.lit(1))["Hit_hsps"]["Hsp"]
    rows = rows.select(F.lit(record_id).alias("record_id"), F.col("`Iteration_query-def`").cast("int").alias("feature_idx"), F.explode(first).alias("h"))
    col = lambda n: F.col(f"h.`Hsp_{n}`")
    return numbered_hits(rows.select("record_id", "feature_idx", col("hit-from").alias("s_start"), col("hit-to").alias("s_end"), col("query-from").alias("q_start"), col("query-to").alias("q_end"), col("hit-frame").alias("frame"), col("align-len").alias("align_length"), col("identity").alias("identities"), col("bit-score").alias("bits")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, ref_start, cigar): each query's first primary alignment."""
    names = "record_id string, flag int, ref string, ref_start int, mapq int, cigar string"
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t")).withColumn("n", F.monotonically_increasing_id())
    rows = rows.select("n", *(F.col("f")[i].cast(t).alias(c) for i, (c, t) in enumerate(x.split() for x in names.split(", ")))).where("flag & 4 = 0 and flag & 256 = 0 and flag & 2048 = 0")
    return rows.groupBy("record_id").agg(F.min_by(F.struct("ref_start", "cigar"), "n").alias("a")).select("record_id", "a.*")
