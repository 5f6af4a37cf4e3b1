"""Helpers that several corpus operators share: checkpoint tables, tables with clashing columns, hash splits."""

from __future__ import annotations

import contextlib
import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a warehouse folder only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, an action's shuffle files are deleted when it ends, and not when the driver's JVM next collects its garbage.

    A chain of many small tables would else keep the files of all its shuffles, three for each task, to its end.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a read and not the whole chain."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with tidy(spark):
        # The setting counts when a query is made, not when it runs.
        return df.select("*").checkpoint(eager=True)


#: Paths of the tables that stored() has written and nothing has released.
_tables: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: as cut(), columnar and with column pruning.

    The table is deleted when the driver's JVM ends, or by released() before.
    """
    return appended(df.sparkSession, [df])


def appended(spark: SparkSession, frames) -> DataFrame:
    """One stored() table of all frames, which are taken and written one by one; at least one, all of one schema."""
    path, schema = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", None
    for df in frames:
        with tidy(spark):
            df.write.mode("append").parquet(path)
        schema = schema or df.schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _tables.append(path)
    return spark.read.schema(schema).parquet(path)


def released(df: DataFrame, work) -> DataFrame:
    """work(df) as a stored table; df's own table, where stored() wrote it, and all that work stored on the way are deleted."""
    spark, old = df.sparkSession, len(_tables)
    out = stored(work(df))
    done = _tables[old:-1] + [p for p in _tables[:old] if any(f.startswith(p + "/") or f"{p}/" in f for f in df.inputFiles()[:1])]
    for path in done:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _tables.remove(path)
    return out


def own_names(docs: DataFrame, n: int) -> list[str]:
    """n column names that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    free = (name for i in itertools.count(1) if (name := f"__own_{i}") not in taken)
    return list(itertools.islice(free, n))


def text_hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes of the column text, null as empty."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def only_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, t1, t2: the text_hashes()) names, with all their columns.

    Of rows that repeat a doc_id and a text the one stays whose other columns, written as JSON, come first.
    """
    names = own_names(docs, 3)
    kept = cut(kept.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "t1", "t2"), names))))
    on = F.col("doc_id").eqNullSafe(F.col(names[0]))
    for value, name in zip(text_hashes(), names[1:]):
        on = on & (value == F.col(name))
    out = docs.join(kept, on, "left_semi")
    with tidy(docs.sparkSession):
        if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
            return out
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce(others, F.lit("")))
    once = out.groupBy(F.col("doc_id").alias(names[0]), *(value.alias(name) for value, name in zip(text_hashes(), names[1:]))).agg(row.alias("row"))
    return once.select("row.*")


def crc_part(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo modulus: the split into training and held-out rows. Null ids fall to part 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def sampled(rows: DataFrame, n: int, salt: int, by: str | None = None, values: int = 256) -> DataFrame:
    """The n rows (of each of the `values` most frequent values of `by`) with the least hash of doc_id, for any number of
    rows and partitions.

    Rows are first thinned to about 8 n by that same hash, from a count, so that the final choice never gathers n rows
    from each of very many tasks. No more than `values` counts are read to the driver.
    """
    scale = 1 << 30
    h = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(scale))
    share = lambda total: int(min(1.0, 8 * n / max(1, total)) * scale)
    if by is None:
        return rows.where(h < share(rows.count())).orderBy(h, *rows.columns).limit(n)
    counts = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(values).collect()
    if not counts:
        return rows
    limit = F.create_map(*(F.lit(x) for r in counts for x in (r[by], share(r["count"]))))
    first = Window.partitionBy(by).orderBy(h, "doc_id")
    return rows.where(h < F.try_element_at(limit, F.col(by))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def slices(texts, limit: int = 1 << 20):
    """Cut an Arrow string array into (start, end) row ranges of about `limit` bytes; a longer text is a range alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
