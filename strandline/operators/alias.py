"""Alias tables: lookup, conflicts, feature resolution, configuration edits.

Alias terms are rows (canonical, alias, ord), exclusions rows (name). What resolve() sends to the executors is bounded by
MOST_TERMS, beyond which it joins instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import written
from strandline.functions.names import AMBIGUOUS, QUALIFIERS, SENTINEL, filled, norm, parts

MOST_TERMS = 200_000


def alias_lookup(terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """(norm, target). A term of two canonicals is ambiguous; an exclusion never overrides a mapped term."""
    own = terms.select("canonical", F.col("canonical").alias("term"))
    every = own.union(terms.select("canonical", "alias")).select("canonical", norm(F.col("term")).alias("norm")).where("norm <> ''")
    mapped = every.groupBy("norm").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    mapped = mapped.select("norm", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(AMBIGUOUS).alias("target"))
    out = excluded.select(norm(F.col("name")).alias("norm")).where("norm <> ''").distinct().join(mapped, "norm", "left_anti")
    return mapped.union(out.select("norm", F.lit(SENTINEL)))


def alias_conflicts(terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """(kind, norm, canonicals): aliases claimed by several canonicals, and exclusions that are aliases too."""
    claims = terms.select(norm(F.col("alias")).alias("norm"), "canonical").where("norm <> ''").distinct()
    shared = claims.groupBy("norm").agg(F.array_join(F.sort_array(F.collect_set("canonical")), ", ").alias("canonicals"), F.count("*").alias("n"))
    barred = excluded.select(norm(F.col("name")).alias("norm")).where("norm <> ''").distinct()
    return shared.where("n > 1").select(F.lit("several canonicals").alias("kind"), "norm", "canonicals").union(shared.join(barred, "norm", "left_semi").select(F.lit("excluded alias"), "norm", "canonicals"))


def lookup_map(lookup: DataFrame, most: int = MOST_TERMS) -> Column:
    """The lookup as a map literal. Raises when it has over `most` terms: resolve() takes tables of any size."""
    rows = lookup.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} alias terms; give resolve() the table")
    return F.from_json(F.lit(json.dumps({r["norm"]: r["target"] for r in rows})), "map<string,string>")


def is_sentinel(x: Column) -> Column:
    return x.isin(SENTINEL, AMBIGUOUS)


def target_of(value: Column, table: Column) -> Column:
    """Target of a compound value: the whole value, else the first part with a real canonical, else the first with any."""
    found = F.filter(F.transform(parts(value), lambda p: F.try_element_at(table, norm(p))), lambda t: t.isNotNull())
    real = F.filter(found, lambda t: ~is_sentinel(t))
    return F.coalesce(F.try_element_at(table, norm(value)), F.try_element_at(real, F.lit(1)), F.try_element_at(found, F.lit(1)))


def resolve_values(values: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """values with `target`, by a join, of the whole values."""
    return values.join(lookup.select(F.col("norm").alias("_norm"), "target"), norm(F.col(column)) == F.col("_norm"), "left").drop("_norm")


def joined_targets(features: DataFrame, lookup: DataFrame, values: list[str]) -> DataFrame:
    """features with column _<value>, the target of each value, by joins: every distinct value is looked up once, with its parts."""
    for c in values:
        once = features.select(F.col(c).alias("__sought")).where("__sought <> ''").distinct()
        pieces = once.select("__sought", F.posexplode(F.concat(F.array("__sought"), parts(F.col("__sought")))).alias("_k", "_p"))
        found = resolve_values(pieces, "_p", lookup).where("target is not null")
        first = F.min(F.struct((F.col("_k") > 0).alias("part"), ((F.col("_k") > 0) & is_sentinel(F.col("target"))).alias("barred"), "_k", "target"))
        found = found.groupBy("__sought").agg(first.alias("_x")).select("__sought", F.col("_x.target").alias(f"_{c}"))
        features = features.join(found, F.col(c) == F.col("__sought"), "left").drop("__sought")
    return features


def resolve(features: DataFrame, lookup: DataFrame | Column, qualifiers: tuple[str, ...] = QUALIFIERS, most: int = MOST_TERMS) -> DataFrame:
    """features with raw_name, name, alias_source_value and name_source (raw, alias, alias_conflict_resolved, excluded).

    A lookup table of up to `most` terms becomes an expression; a larger one is joined, with the same result.
    """
    values, columns = [c for c in qualifiers if c in features.columns], features.columns
    if isinstance(lookup, DataFrame) and lookup.limit(most + 1).count() > most:
        features = joined_targets(features, lookup, values)
        of = lambda c: F.col(f"_{c}")
    else:
        table = lookup if isinstance(lookup, Column) else lookup_map(lookup, most)
        of = lambda c: F.when(filled(F.col(c)).isNotNull(), target_of(F.col(c), table))
    hits = F.array(*(F.struct(F.col(c).alias("value"), of(c).alias("target")) for c in values))
    out = features.withColumn("_hits", F.filter(hits, lambda h: h["target"].isNotNull()))
    real = F.filter("_hits", lambda h: ~is_sentinel(h["target"]))
    kinds = F.size(F.array_distinct(F.transform("_hits", lambda h: h["target"])))
    won = F.coalesce(F.try_element_at(real, F.lit(1)), F.try_element_at(F.col("_hits"), F.lit(1)))
    out = out.withColumns({"_real": F.size(real) > 0, "_kinds": kinds, "_won": won, "raw_name": F.col("name")})
    return out.withColumns({
        "name": F.when(F.col("_real"), F.col("_won.target")).otherwise(F.col("raw_name")),
        "alias_source_value": F.col("_won.value"),
        "name_source": F.when(F.col("_kinds") == 0, "raw").when(~F.col("_real"), "excluded").when(F.col("_kinds") == 1, "alias").otherwise("alias_conflict_resolved"),
    }).drop("_hits", "_real", "_kinds", "_won", *(f"_{c}" for c in values if f"_{c}" not in columns))


def ordered_distinct(names: DataFrame, value: str = "name", order: str = "ord") -> DataFrame:
    """The first row of each normal form; blank names are left out."""
    first = Window.partitionBy("norm").orderBy(order, value)
    rows = names.withColumn("norm", norm(F.col(value))).where("norm <> ''")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def without(excluded: DataFrame, saved: DataFrame) -> DataFrame:
    """Exclusions less the names now saved as aliases."""
    return excluded.withColumn("_norm", norm(F.col("name"))).join(saved.select(norm(F.col("alias")).alias("_norm")), "_norm", "left_anti").drop("_norm")


def overlay(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """(norm, target) with the decisions (norm, target) winning over the base."""
    both = base.select("norm", "target", F.lit(1).alias("p")).union(decisions.select("norm", "target", F.lit(0)))
    return both.groupBy("norm").agg(F.min_by("target", F.struct("p", "target")).alias("target"))


def _steps(links: DataFrame) -> DataFrame:
    return links.where("parent is not null and name is not null").select("name", F.col("parent").alias("ancestor")).distinct()


def _several(steps: DataFrame) -> bool:
    """Whether a name has several parents."""
    return not steps.groupBy("name").count().where("count > 1").isEmpty()


def _cyclic(steps: DataFrame, rounds: int) -> DataFrame:
    """(name) on a cycle, of (name, ancestor) rows with one ancestor for each name.

    Every name jumps to the ancestor of its ancestor, so jumps double, and a name whose jump passes the top is left out. What
    has made as many steps as there are names left stands on a cycle, and each name of a cycle is where another one stands.
    """
    at, step = steps, 1
    for _ in range(rounds):
        left = at.count()
        if step >= left:
            return at.select(F.col("ancestor").alias("name")).distinct()
        on = at.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("further")).hint("merge")
        at, step = written(at.join(on, "ancestor").select("name", F.col("further").alias("ancestor"))), step * 2
    raise RuntimeError(f"parent links did not settle in {rounds} rounds")


def parent_closure(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(name, ancestor, distance) over (name, parent) rows, distances the shortest; a name that reaches itself lies on a cycle.

    Paths of a length of exactly `step` go on with all known ones, which are no longer, so lengths double with every round and
    each path is made and written once. Where names have one parent and none lies on a cycle no path can come twice; else a
    round's paths are told apart from each other and from those before. Only counts reach the driver.
    """
    steps = written(_steps(links))
    plain = not _several(steps) and _cyclic(steps, rounds).isEmpty()
    paths = ends = written(steps.withColumn("distance", F.lit(1)))
    step = 1
    for _ in range(rounds):
        on = paths.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = ends.select("name", "ancestor").hint("merge").join(on, "ancestor").select("name", F.col("further").alias("ancestor"), (F.col("more") + step).alias("distance"))
        if not plain:
            longer = longer.groupBy("name", "ancestor").agg(F.min("distance").alias("distance")).join(paths.select("name", "ancestor").hint("merge"), ["name", "ancestor"], "left_anti")
        longer = written(longer)
        if longer.isEmpty():
            return paths
        paths, step = paths.union(longer), step * 2
        ends = longer.where(F.col("distance") == step)
    raise RuntimeError(f"parent links did not settle in {rounds} rounds")


def parent_faults(names: DataFrame, links: DataFrame) -> DataFrame:
    """(name, fault): a parent that is no canonical, or a chain that returns to the name.

    Where names have one parent, cycles are found by a row for each name, without the paths between names.
    """
    lost = links.where("parent is not null").join(names.select(F.col("name").alias("parent")).hint("merge"), "parent", "left_anti").select("name", F.lit("missing parent").alias("fault"))
    steps = written(_steps(links))
    cycles = parent_closure(links).where("name = ancestor").select("name") if _several(steps) else _cyclic(steps, 60)
    return lost.union(cycles.select("name", F.lit("cycle"))).distinct()


def children(links: DataFrame) -> DataFrame:
    """(parent, children), the children in name order."""
    return links.where("parent is not null").groupBy("parent").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("children"))


def search_canonicals(terms: DataFrame, text: str) -> DataFrame:
    """(canonical, aliases) of the canonicals whose name or aliases hold the text in its normal form; blank text: all."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"])
    rows = terms.groupBy("canonical").agg(listed.alias("_a"))
    return rows.where(F.contains(norm(F.concat_ws(" ", "canonical", F.array_join("_a", " "))), norm(F.lit(text)))).select("canonical", F.array_join("_a", "; ").alias("aliases"))


def add_alias(terms: DataFrame, canonical: str, alias: str) -> DataFrame:
    """terms with one alias more, unless its normal form is there already."""
    new = terms.sparkSession.createDataFrame([(canonical, alias, 1 << 30)], "canonical string, alias string, ord int")
    known = terms.where(F.col("canonical") == canonical).select(norm(F.col("alias")).alias("_n"))
    new = new.withColumn("_n", norm(F.col("alias"))).join(known, "_n", "left_anti").drop("_n")
    return terms.select("canonical", "alias", "ord").unionByName(new)


def drop_alias(terms: DataFrame, canonical: str, alias: str) -> DataFrame:
    return terms.where(~((F.col("canonical") == canonical) & (norm(F.col("alias")) == norm(F.lit(alias)))))


def drop_canonical(terms: DataFrame, canonical: str) -> DataFrame:
    return terms.where(F.col("canonical") != canonical)


def excluded_to_alias(terms: DataFrame, excluded: DataFrame, name: str, canonical: str) -> tuple[DataFrame, DataFrame]:
    return add_alias(terms, canonical, name), excluded.where(norm(F.col("name")) != norm(F.lit(name)))


def without_conflicts(terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """terms less those that alias_conflicts() names."""
    return terms.withColumn("_n", norm(F.col("alias"))).join(alias_conflicts(terms, excluded).select(F.col("norm").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def validated(terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """terms, or an error that names the first conflicts."""
    found = alias_conflicts(terms, excluded).limit(5).collect()
    if found:
        raise ValueError("alias conflicts: " + "; ".join(f"{r['norm']} ({r['kind']}: {r['canonicals']})" for r in found))
    return terms
