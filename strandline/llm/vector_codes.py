"""Vector code compression: product codes of 8 parts with 16 integer entries each, assigned exactly.

The nearest entry of a part comes from a float32 matrix product: |c|^2 - 2 x.c orders the entries as the squared distance
does. Each value carries an interval that holds the true one whatever the order of the product's sums; all entries whose
interval overlaps the best one's are computed again in int64, and the lowest index of the least distance is taken. So codes
do not depend on the machine, though nearly all parts are decided by the product alone.

A round is one scan: a task holds the sums of its parts, at most 8 x 16 x (components of a part) numbers, whatever its size;
they are added up in Spark, and one codebook, of bounded size, reaches the driver and goes out with the next round's
function. Vectors are never shuffled or stored; what is stored is a code and a number a row, for the sums by label.

Defined results: vectors that are null or hold a null or non-finite component are dropped. A vector shorter than the longest
kept one counts as ending in zeros, and so do all up to the next multiple of `parts` components. The first codebook is of the
least vec_ids, null last; rows that share one come by vector. With fewer kept rows than entries each is an entry. Repeated
rows give repeated rows. An empty table gives an empty result. Components of 2^15 and more raise ValueError: their squared
distances do not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stored
from strandline.llm.vectors import finite, integers, longest

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27
#: Sums by label go to all executors where there are no more labels than this.
MOST_LABELS = 100_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lowest of equals; squared distance) of each row of x; both int64, x and book too."""
    n, d = x.shape
    norm = (book * book).sum(1)
    screened = (norm.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ book.T.astype(np.float32))).astype(np.float64)
    # |computed - true| <= gamma (|c|^2 + 2 |x||c|): d + 2 roundings of the product and its factors, and those of |c|^2,
    # its conversion and the difference. The factor on the outside covers the roundings of this bound itself.
    steps = d + 8
    gamma = steps * 2.0**-24 / (1 - steps * 2.0**-24)
    size = np.sqrt((x * x).sum(1).astype(np.float64))
    error = 1.0001 * gamma * (norm + 2 * np.outer(size, np.sqrt(norm.astype(np.float64)))) + 1e-30
    best = screened.argmin(1)
    open_ = screened - error <= (screened + error).min(1)[:, None]
    many = np.flatnonzero(open_.sum(1) > 1)
    if len(many):
        row, entry = np.nonzero(open_[many])
        exact = np.full((len(many), len(book)), np.iinfo(np.int64).max)
        for s in range(0, len(row), 1 << 16):
            r, e = row[s : s + (1 << 16)], entry[s : s + (1 << 16)]
            exact[r, e] = ((x[many[r]] - book[e]) ** 2).sum(1)
        best[many] = exact.argmin(1)
    return best, ((x - book[best]) ** 2).sum(1)


def _blocks(batches, column: str, width: int, rows: int = 4096):
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            part = batch.slice(s, rows)
            yield part, integers(part.column(column), SCALE, width, LIMIT)


def _sums(kept: DataFrame, column: str, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, position, total, n): the sums of all parts by their nearest entry."""
    parts, entries, size = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _blocks(batches, column, width):
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                code, _ = nearest(own, books[p])
                np.add.at(total[p], code, own)
                count[p] += np.bincount(code, minlength=entries)
        p, e, i = (a.ravel() for a in np.indices(books.shape))
        used = count[p, e] > 0
        yield pa.RecordBatch.from_pydict({"part": pa.array(p[used], pa.int32()), "entry": pa.array(e[used], pa.int32()), "position": pa.array(i[used], pa.int32()), "total": total.ravel()[used], "n": count[p, e][used]})

    sums = kept.select(column).mapInArrow(run, "part int, entry int, position int, total long, n long")
    return sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))


def codebooks(kept: DataFrame, column: str, width: int) -> np.ndarray:
    """(parts, entries, components) int64 after all rounds."""
    first = kept.select("vec_id", column).orderBy(F.asc_nulls_last("vec_id"), column).limit(ENTRIES).toArrow().combine_chunks()
    x = integers(first.column(column).combine_chunks(), SCALE, width, LIMIT)
    books = np.ascontiguousarray(x.reshape(len(x), PARTS, width // PARTS).swapaxes(0, 1))
    for _ in range(ROUNDS):
        for r in _sums(kept, column, books.copy(), width).collect():  # one row a number of the codebook
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // int(r["n"])
    return books


def vector_codes(df: DataFrame, column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row."""
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("x"), F.col(label).alias("label")).where(finite("x"))
    width = -(-longest(kept, "x") // PARTS) * PARTS
    books = codebooks(kept, "x", width)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    size = books.shape[2]

    def run(batches):
        for batch, x in _blocks(batches, "x", width):
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p in range(PARTS if len(x) else 0):
                codes[:, p], d = nearest(x[:, p * size : (p + 1) * size], books[p])
                error += d
            flat = codes.tobytes().hex()
            written = [flat[i : i + 2 * PARTS] for i in range(0, len(flat), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(written, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = stored(kept.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"))
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= MOST_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
