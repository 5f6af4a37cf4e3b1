"""Distributed connected components over an edge table, and candidate pairs from shared keys without all pairs of a bucket."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.llm.shared import cut, stored, tidy

#: Longs of bits in an odd_sketches() row.
LONGS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. The least neighbour comes from a partial aggregate and a join of two plain exchanges, so a hub's rows,
    however many, need not meet in one task: adaptive execution splits them. Both sides grow with the corpus, so neither is
    broadcast through the driver, whatever the session's threshold."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
    least = cut(least)
    near = both.join(least.hint("merge"), both.a == least.hub)
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    Null ends and loops are left out; repeated edges count once; an empty edge table gives an empty result. Rounds are
    logarithmic in the number of nodes; each is checkpointed to the shared folder. Only two counters reach the driver.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges, seen = cut(edges), None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False))
        with tidy(edges.sparkSession):
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, content and what goes with a key; one row for a key and content) whose key more than one
    content has, and n, the number of these contents.

    Partial counts and a join of two plain exchanges, so a key of very many contents need not meet in one task.
    """
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k"))
    return stored(keyed.join(shared.hint("merge"), F.col("key") == F.col("k")).drop("k"))


def hub_pairs(members: DataFrame, buckets: int = 16) -> DataFrame:
    """(a, b): each member (key, content, n) with the hubs of its `buckets` largest buckets. A bucket's hub is the content
    with most collisions in all buckets.

    These links only save work: a group of very many alike contents is connected by a few rows for each of them, and what
    stays unconnected meets all of its buckets, the others too, in open_pairs().
    """
    own = Window.partitionBy("content")
    placed = members.withColumns({"weight": F.sum("n").over(own), "place": F.row_number().over(own.orderBy(F.desc("n"), "key"))})
    placed = stored(placed.select("key", "content", "weight", "place"))
    hubs = stored(placed.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", "content"))["content"].alias("b")))
    placed = stored(placed.where(F.col("place") <= buckets).select("key", "content"))
    return placed.join(hubs.hint("merge"), F.col("key") == F.col("k")).where("content <> b").select(F.col("content").alias("a"), "b").distinct()


def combined(parts: str, n: int, size: int) -> Column:
    """Array of struct(key, last): a key for each choice of `size` of the n values of the array column, and the last one's place."""
    keys = [F.struct(F.xxhash64(*(x for i in some for x in (F.lit(i), F.get(parts, F.lit(i))))).alias("key"), F.lit(some[-1]).alias("last")) for some in itertools.combinations(range(n), size)]
    return F.array(*keys)


def odd_sketches(h: np.ndarray, owner: np.ndarray, n: int, longs: int = LONGS) -> np.ndarray:
    """(n, 1 + longs) longs for each of n sets, whose elements are h by owner (ascending): the number of different elements,
    and 64 * longs (a power of two) bits, each the parity of how many of them hash there. Two sets' bits differ in no more places than the
    sets do, so within() leaves out no pair that is similar."""
    from strandline.llm.words import mix

    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner, width = h[first], owner[first].astype(np.int64), 64 * longs
    bits = np.bincount(owner * width + (mix(h) & np.uint64(width - 1)).astype(np.int64), minlength=n * width).reshape(n, width) & 1
    return np.concatenate((np.bincount(owner, minlength=n)[:, None].astype(np.int64), np.packbits(bits.astype(bool), axis=1).view(np.int64)), axis=1)


def odd_fields(column: str) -> list[Column]:
    """The longs of an odd_sketches() row as columns of their own, which a join compares faster than an array's items."""
    return [F.get(column, F.lit(i)).alias(f"odd{i}") for i in range(LONGS + 1)]


def within(x, y, least: float) -> Column:
    """False only where the sets of two odd_sketches(), given by their odd_fields(), surely have a Jaccard similarity below least.

    Sets of p and q elements of which d are in one of them alone have (p + q - d) / (p + q + d).
    """
    most = (x["odd0"] + y["odd0"]) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
    bits = sum(F.bit_count(x[f"odd{i}"].bitwiseXOR(y[f"odd{i}"])) for i in range(1, LONGS + 1))
    return (F.abs(x["odd0"] - y["odd0"]) <= most) & (bits <= most)


def within_wide(x, y, least: float) -> Column:
    """within() by two odd_sketches() of any one width, given as arrays; true where one of them is null."""
    most = (x[0] + y[0]) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda n, b: n + b)
    return F.coalesce(bits - F.bit_count(x[0].bitwiseXOR(y[0])) <= most, F.lit(True))


def open_pairs(members: DataFrame, nodes: DataFrame, links: DataFrame, n: int, near, most: int = 1 << 12, size: int = 2) -> DataFrame:
    """(a, b): all pairs of contents that share a key, may be near, and that links (a, b) do not connect already.

    members: key, last, content, as combined() makes them of nodes (content, parts: array of n values, sketch: anything)
    with this size; near(x, y): a condition on the parts and sketch of two contents, which is part of the join, so that only what
    passes it is made. In each bucket all members but those of its largest component meet every member of another component,
    however many they are: no bucket is left out or cut short. A bucket of over `most` members is dealt in blocks of about
    `most`, and each two blocks meet in a task of their own. A pair is made once, in the bucket of the first values that it
    has in common; where n is 0 keys are no combinations, and a pair may be made in each bucket that it shares.
    """
    roots = stored(components(links).withColumnRenamed("node", "of"))
    level = members.join(roots.hint("merge"), F.col("content") == F.col("of"), "left").select("key", "last", "content", F.coalesce("root", "content").alias("root"))
    level = stored(level)
    sizes = level.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda x: F.ceil(x / most).cast("int")
    sizes = stored(sizes.where("n > top.n").select("k", F.col("top.root").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("rows"), blocks(F.col("n")).alias("columns")))
    kind = nodes.schema["sketch"].dataType
    sketch = {f"s_{f}": f"sketch.{f}" for f in kind.names} if isinstance(kind, StructType) else {"s": "sketch"}
    nodes = nodes.select(F.col("content").alias("c"), "parts", *(F.col(path).alias(name) for name, path in sketch.items()))
    here = level.join(sizes.hint("merge"), F.col("key") == F.col("k")).drop("k")
    here = stored(here.join(nodes.hint("merge"), F.col("content") == F.col("c")).drop("c"))
    dealt = lambda salt, among: F.pmod(F.xxhash64("content", F.lit(salt)), F.col(among)).cast("int")
    each = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    met = here.select("key", "last", "content", "root", "main", "parts", *sketch, dealt(1, "columns").alias("column"), each("rows").alias("row"))
    asking = here.where("root <> main").select(F.col("key").alias("k"), F.col("content").alias("b"), F.col("root").alias("own"), *(F.col(c).alias(f"y_{c}") for c in ("parts", *sketch)), dealt(2, "rows").alias("r"), each("columns").alias("c"))
    # The work is the product of two blocks' rows, not their bytes: tasks of few bytes are not to be put together.
    tasks = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met, asking = met.repartition(tasks, "key", "row", "column"), asking.repartition(tasks, "k", "r", "c")
    x, y = ({"parts": F.col(f"{p}parts"), "sketch": {n[2:]: F.col(f"{p}{n}") for n in sketch} if len(sketch) > 1 else F.col(f"{p}s")} for p in ("", "y_"))
    first = F.lit(True) if not n else sum(F.when((F.get(x["parts"], F.lit(i)) == F.get(y["parts"], F.lit(i))) & (F.col("last") >= i), 1).otherwise(0) for i in range(n)) == size
    once = (F.col("root") == F.col("main")) | (F.col("content") < F.col("b"))
    on = (F.col("key") == F.col("k")) & (F.col("row") == F.col("r")) & (F.col("column") == F.col("c"))
    met = met.join(asking.hint("merge"), on & (F.col("root") != F.col("own")) & once & near(x, y) & first)
    return stored(met.select(F.least("content", "b").alias("a"), F.greatest("content", "b").alias("b")).distinct())
