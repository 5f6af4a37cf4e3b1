"""Command line: annotate, crawl, summary, suggest, names, evaluate. `python -m strandline annotate --help` lists the options of each."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import counters
from strandline.operators.lift import LiftConfig
from strandline.operators.summary import annotation_classes
from strandline.plans import workflows
from strandline.plans.annotate import annotate, detect_virus, prepare_reference
from strandline.sources import entrez, ncbi, sinks, tables
from strandline.sources.genbank import features_of, read_genbank, single_genbank


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="transfer a reference's features to query records")
    s = sub.add_parser("suggest", help="suggest aliases from where names stand")
    n = sub.add_parser("names", help="payloads for the review of names that nothing resolves")
    e = sub.add_parser("evaluate", help="compare what is lifted with the records' own annotation")
    for x in (a, s, n, e):
        x.add_argument("--reference", required=True)
        x.add_argument("--query", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--alias-config")
        x.add_argument("--registry", help="finds the alias configuration by the reference's keywords, where none is given")
        x.add_argument("--min-coverage", type=float, default=0.5)
        x.add_argument("--min-identity", type=float, default=0.3)
        x.add_argument("--evalue", type=float, default=1e-5)
        x.add_argument("--rescue-window", type=int, default=200)
    c = sub.add_parser("crawl", help="fetch records, split them by species and drop those known")
    c.add_argument("--raw", help="flat files to split instead of fetching")
    c.add_argument("--query", help="what to search for")
    c.add_argument("--accessions", help="file of accessions to fetch")
    for name in ("--registry", "--ledger", "--output"):
        c.add_argument(name)
    c.add_argument("--email", default=os.environ.get("NCBI_EMAIL"))
    c.add_argument("--api-key", default=os.environ.get("NCBI_API_KEY"))
    c.add_argument("--base", default=ncbi.BASE, help="address of the service")
    c.add_argument("--retmax", type=int, default=10_000)
    c.add_argument("--batch", type=int, default=200)
    c.add_argument("--count", action="store_true", help="only tell how many records the query matches")
    c.add_argument("--count-only", action="store_true", help="report what a run would do, write nothing")
    sub.add_parser("summary", help="how records, such as references, are annotated").add_argument("--query", required=True)
    return p


def crawl(spark: SparkSession, o: argparse.Namespace) -> None:
    if not (o.raw or o.query or o.accessions):
        raise SystemExit("one of --raw, --query and --accessions is needed")
    if o.count:
        if not o.query:
            raise SystemExit("--count needs --query")
        print(ncbi.Entrez(o.email, o.api_key, base=o.base).count(o.query))
        return
    if not (o.registry and o.ledger and o.output):
        raise SystemExit("--registry, --ledger and --output are needed")
    raw = o.raw
    if not raw:
        raw = f"{o.output}/raw"
        spark.dataSource.register(entrez.EntrezSource)
        common = {"email": o.email or "", "batch": str(o.batch), "retmax": str(o.retmax), "base": o.base} | ({"api_key": o.api_key} if o.api_key else {})
        for k, wanted in enumerate({x: y} for x, y in (("query", o.query), ("accessions", o.accessions)) if y):
            spark.read.format("entrez").options(**common, **wanted).load().select("value").write.mode("overwrite").option("lineSep", "\n//\n").text(f"{raw}/{k}")
        raw = f"{raw}/*"
    registry = json.loads("\n".join(r[0] for r in spark.read.text(o.registry, wholetext=True).collect()))
    table = workflows.split_crawl(spark, raw, registry, o.ledger, o.output, o.count_only)
    table.groupBy("matched_virus", "status").count().orderBy("matched_virus", "status").show(100, False)


def alias_tables(spark: SparkSession, o: argparse.Namespace, record) -> tuple:
    """(terms, excluded) of the configuration given, or of the one that the registry has for the record; else nothing."""
    path = o.alias_config
    if not path and o.registry:
        registry = json.loads("\n".join(r[0] for r in spark.read.text(o.registry, wholetext=True).collect()))
        virus = detect_virus(record, tables.registry_table(spark, registry)).first()["virus"]
        entry = next((e for e in tables.check_registry(registry) if e["virus_name"] == virus), None)
        path = tables.resolve_config(entry["alias_config"], o.registry, os.path.dirname(o.registry)) if entry else None
    return tables.read_alias_config(spark, path)[:2] if path else (None, None)


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandline {o.command}").getOrCreate()
    if o.command == "crawl":
        crawl(spark, o)
        return
    if o.command == "summary":
        annotation_classes(features_of(read_genbank(spark, o.query))).orderBy(F.col("record_id").isNull(), "record_id").show(100, False)
        return
    record = single_genbank(spark, o.reference)
    terms, excluded = alias_tables(spark, o, record)
    reference = prepare_reference(record, terms, excluded)
    config = LiftConfig(o.min_coverage, o.min_identity, o.evalue, o.rescue_window, reference.level == "CDS")
    records = read_genbank(spark, o.query)
    if o.command == "suggest":
        sinks.write_json(workflows.coordinate_suggestions(records, reference, config=config), o.output)
        return
    if o.command == "names":
        sinks.write_json(workflows.unresolved_review(records, reference), o.output)
        return
    if o.command == "evaluate":
        bare = records.withColumn("features", F.filter("features", lambda f: f["type"] == "source"))
        rows, accuracy = workflows.evaluation(annotate(bare, reference, config).lifted, records, reference)
        sinks.write_table(rows, f"{o.output}/features")
        sinks.write_table(accuracy, f"{o.output}/records")
        accuracy.where("record_id is null").show(truncate=False)
        return
    run = annotate(records, reference, config)
    rows, seen = counters.observed(run.lifted)
    rows.write.mode("overwrite").parquet(f"{o.output}/lifted")
    sinks.write_results(spark.read.parquet(f"{o.output}/lifted"), f"{o.output}/tsv")
    told = counters.told(seen)
    print(f"{told['features']} features, {told['pass_rate']} % pass, {told['needs_review']} to review; " + ", ".join(f"{n} {m}" for m, n in told["methods"].items()))
    for status, n in told["statuses"].items():
        print(f"  {status}: {n}")
    run.errors.show(50, False)


if __name__ == "__main__":
    main()
