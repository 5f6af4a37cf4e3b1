"""Substring dedup: paragraph MinHash banding, exact verification, clusters of removals by components.

Two sorts of paragraphs are compared, over five-word shingles:

* Natural paragraphs: a line, joined to the next ones while it has fewer than min_words words (what is left at the end of a
  text belongs to the paragraph before). Each has BANDS band keys of ROWS MinHash values. Two paragraphs with a Jaccard
  similarity of 0.8 collide with probability 1 - 1e-6, of 0.7 with 0.9999, of 0.41 (one word in twelve changed) with 0.92.
  Colliding paragraphs are joined to the hub of their bucket, the paragraph that most others collide with, and verified on
  their words: the exact Jaccard similarity of their shingles (with edits also the similarity by word edit distance, which
  one word changed in twelve leaves at 0.92) must be SIMILAR.
  Then paragraphs that these links do not connect meet all others of their buckets, linked or not, whatever the bucket's
  size (graph.open_pairs); of these pairs only those are made that a bound on the shingles in one of the two alone (the
  parities of graph.odd_sketches) leaves possible.
* Content-defined paragraphs, because a passage may be pasted into the middle of a line: of every `spread` consecutive
  shingles the one with the least hash begins a paragraph of `length` shingles. spread + length - 1 shingles make
  min_words words, so any common run of min_words words holds such a paragraph, whole, in every text, wherever it stands.
  Their one band is the whole paragraph, so colliding is agreeing. Chains of repeated ones are looked at again: every run of
  min_words words around the paragraphs of a shorter chain, and around a longer chain's ends, is compared in turn. So a
  common run of min_words words is found whole; where a longer one's end is within another text's longer chain, fewer than
  `spread` words at that end may be left out.

Of repeated paragraphs and runs those in the document with the least doc_id stay; all others are marked for removal.
Passages that share a paragraph, or have linked ones, are one cluster, by distributed connected components.

Defined results: null and empty texts, and texts of fewer than min_words words, repeat nothing; rows whose doc_id is null
take no part; rows that repeat a doc_id are one document, which does not repeat itself, and rows that repeat a doc_id and
its text are one row (text_hash tells texts apart); an empty table gives an empty result; other columns are ignored.
Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.graph import LONGS, combined, components, hub_pairs, odd_fields, odd_sketches, open_pairs, shared_keys, within
from strandline.llm.shared import slices, stored

K, MIN_WORDS, SIMILAR = 5, 50, 0.8
BANDS, ROWS = 14, 2
_LOW = np.uint64((1 << 27) - 1)
_SEEDS = np.random.default_rng(20240612).integers(1 << 62, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def layout(min_words: int) -> tuple[int, int]:
    """(spread, length) of content-defined paragraphs, in shingles."""
    spread = max(1, (min_words - K + 1) // 2)
    return spread, max(1, min_words - K + 2 - spread)


def boundaries(h: np.ndarray, row: np.ndarray, spread: int) -> np.ndarray:
    """Indices of the shingles that are least among some `spread` consecutive ones of their text, in ascending order."""
    n = len(h) - spread + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= spread:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[spread - width : spread - width + n])
    found = (low & _LOW)[row[:n] == row[spread - 1 :]]
    return np.unique(found).astype(np.int64)


def run_hash(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values of h from each index of at."""
    from strandline.llm.words import mix

    out, step = np.zeros(len(at), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(length):
        out = out * step + h[at + i]
    return mix(out + np.uint64(length))


def natural(words, lines: np.ndarray, min_words: int) -> np.ndarray:
    """(n, 2) first word and end of each natural paragraph; lines numbers the line of every word."""
    if len(words.row) < min_words:
        return np.zeros((0, 2), np.int64)
    turn = np.flatnonzero(np.concatenate(([True], (np.diff(lines) != 0) | (np.diff(words.row) != 0))))
    ends, rows = np.append(turn[1:], len(lines)).tolist(), words.row[turn].tolist()
    found, begin, row = [], 0, -1
    for start, end, r in zip(turn.tolist(), ends, rows):
        if r != row:
            begin, row = start, r
        if end - begin >= min_words:
            found.append([begin, end])
            begin = end
    # What is left behind a text's last paragraph belongs to it.
    out = np.array(found, np.int64).reshape(-1, 2)
    if len(out):
        row_end = np.searchsorted(words.row, words.row[out[:, 0]], "right")
        last = np.append(words.row[out[1:, 0]] != words.row[out[:-1, 0]], True)
        out[last, 1] = row_end[last]
    return out


def band_keys(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of the shingle ranges [lo, hi), none of them empty."""
    from strandline.llm.words import mix

    edges = np.stack((lo, hi), 1).ravel()
    least = [np.minimum.reduceat(np.append((h ^ a) * b, ~np.uint64(0)), edges)[::2] for a, b in _SEEDS]
    keys = []
    for band in range(BANDS):
        key = np.full(len(lo), np.uint64(band + 1))
        for x in least[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
        keys.append(key)
    return np.stack(keys, 1)


def _lines(texts: pa.Array, words) -> np.ndarray:
    from strandline.llm.words import raw

    data, offsets = raw(texts)
    return np.cumsum(data == 10)[words.start + offsets[words.row]] if len(words.row) else np.zeros(0, np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text of the rows that take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null and text is not null")


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, word, words, start, end, content and, for natural paragraphs alone, keys."""
    spread, length = layout(min_words)

    def run(batches):
        from strandline.llm.words import PLAIN, Words

        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                part = texts.slice(s, e - s)
                words = Words(part, PLAIN)
                h, at = words.shingles(K)
                first = np.searchsorted(words.row, words.row, "left")
                edge = boundaries(h, words.row[at], spread)
                edge = edge[edge + length <= len(h)]
                edge = edge[words.row[at[edge]] == words.row[at[edge + length - 1]]]
                spans = natural(words, _lines(part, words), min_words)
                lo, hi = np.searchsorted(at, spans[:, 0]), np.searchsorted(at, spans[:, 1] - K + 1)
                fixed = np.stack((at[edge], at[edge] + length + K - 1), 1)
                both = np.concatenate((fixed, spans)).astype(np.int64)
                if not len(both):
                    continue
                content, keys = [run_hash(h, edge, length)], pa.nulls(len(fixed), pa.list_(pa.int64()))
                if len(spans):
                    place = np.arange(lo[0], hi[-1])
                    powers = np.multiply.accumulate(np.full(int((hi - lo).max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
                    begin = np.repeat(lo, np.append(lo[1:], hi[-1]) - lo)
                    used = np.minimum(place - begin, len(powers) - 1)
                    ended = place < np.repeat(hi, np.append(lo[1:], hi[-1]) - lo)
                    content.append(np.add.reduceat(np.where(ended, h[lo[0] : hi[-1]] * powers[used], np.uint64(0)), lo - lo[0]) + (hi - lo).astype(np.uint64))
                    keys = pa.concat_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(h, lo, hi).view(np.int64).ravel()))])
                rows = pa.array(words.row[both[:, 0]].astype(np.int64) + s)
                ints = (both[:, 0] - first[both[:, 0]], both[:, 1] - both[:, 0], words.start[both[:, 0]], words.end[both[:, 1] - 1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(np.concatenate(content).view(np.int64)), keys], names=["doc_id", "text_hash", "word", "words", "start", "end", "content", "keys"])

    return _identified(docs).mapInArrow(run, "doc_id long, text_hash long, word int, words int, start int, end int, content long, keys array<long>")


def looked_at(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """A second scan of the texts that wanted (doc_id, text_hash, word, words) names.

    For words = 0: doc_id, text_hash, word, words, start, end and content of every run of min_words words that holds the
    content-defined paragraph at word. Else content (as given in wanted), passage, the paragraph's words, and sketch, of its shingles.
    """
    spread, length = layout(min_words)
    size = length + K - 1

    def run(batches):
        from strandline.llm.words import DROP, PLAIN, SPACE, Words, raw

        for batch in batches:
            texts, wants = batch.column("text"), batch.column("wants").to_pylist()
            for s, e in slices(texts):
                part = texts.slice(s, e - s)
                words = Words(part, PLAIN)
                base = np.searchsorted(words.row, np.arange(e - s + 1))
                data, offsets = raw(part)
                folded = PLAIN[data]
                runs, passages, contents, spans = [], [], [], []
                for i in range(e - s):
                    starts = np.array([w["word"] for w in wants[s + i] if not w["words"]], np.int64)
                    if len(starts):
                        at = np.unique((starts[:, None] - np.arange(min_words - size + 1)).ravel())
                        runs.append(at[(at >= 0) & (at + min_words <= base[i + 1] - base[i])] + base[i])
                    for w in wants[s + i]:
                        if w["words"]:
                            a, b = base[i] + w["word"], base[i] + w["word"] + w["words"] - 1
                            text = folded[offsets[i] + words.start[a] : offsets[i] + words.end[b]]
                            passages.append(np.where(text == SPACE, ord(" "), text)[text != DROP].astype(np.uint8).tobytes())
                            contents.append(w["content"])
                            spans.append((a, b))
                runs = np.concatenate(runs) if runs else np.zeros(0, np.int64)
                n, m = len(runs), len(passages)
                sketches = np.zeros((0, LONGS + 1), np.int64)
                if m:
                    h, at = words.shingles(K)
                    first, end = np.searchsorted(at, np.array(spans) + np.array([0, 2 - K])).T
                    owner = np.repeat(np.arange(m), end - first)
                    sketches = odd_sketches(h[np.arange(len(owner)) + np.repeat(first - np.append(0, np.cumsum(end - first)[:-1]), end - first)], owner, m)
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(sketches.ravel()), LONGS + 1).cast(pa.list_(pa.int64()))
                rows = pa.array(words.row[runs].astype(np.int64) + s)
                some = lambda x: pa.concat_arrays([x, pa.nulls(m, x.type)])
                ints = (runs - base[words.row[runs]], np.full(n, min_words), words.start[runs], words.end[runs + min_words - 1]) if n else [np.zeros(0)] * 4
                content = pa.array(np.concatenate((run_hash(words.hashes, runs, min_words).view(np.int64), np.array(contents, np.int64))))
                yield pa.RecordBatch.from_arrays([some(batch.column("doc_id").take(rows)), some(batch.column("text_hash").take(rows)), *(some(pa.array(x.astype(np.int32))) for x in ints), content, pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(passages, pa.binary())]), pa.concat_arrays([pa.nulls(n, sketches.type), sketches])], names=["doc_id", "text_hash", "word", "words", "start", "end", "content", "passage", "sketch"])

    wants = wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_set(F.struct("word", "words", "content")).alias("wants"))
    rows = _identified(docs).join(wants, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t"))).drop("d", "t")
    return rows.mapInArrow(run, "doc_id long, text_hash long, word int, words int, start int, end int, content long, passage binary, sketch array<long>")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, one column of the table at a time as the bits of an integer."""
    if not a:
        return len(b)
    peq: dict = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = every, 0, len(a)
    for y in b:
        eq = peq.get(y, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & every
        up, down = (minus | ~(diagonal | plus)) & every, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & every, down << 1 & every
        plus, minus = (down | ~(diagonal | up)) & every, up & diagonal
    return score


def alike(a: bytes, b: bytes, edits: bool = False) -> bool:
    """Whether two paragraphs are SIMILAR: by the Jaccard similarity of their shingles, with edits also by edit distance in words."""
    a, b = a.split(), b.split()
    x, y = ({tuple(w[i : i + K]) for i in range(max(1, len(w) - K + 1))} for w in (a, b))
    if len(x & y) >= SIMILAR * len(x | y):
        return True
    if not edits:
        return False
    most = max(len(a), len(b))
    return abs(len(a) - len(b)) <= (1 - SIMILAR) * most and edit_distance(a, b) <= (1 - SIMILAR) * most + 1e-9


def verified(pairs: DataFrame, passages: DataFrame, edits: bool) -> DataFrame:
    """The rows of pairs (a, b) whose passages are alike."""

    def run(batches):
        for batch in batches:
            kept = [alike(a, b, edits) for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left, right = passages.select(F.col("content").alias("a"), F.col("passage").alias("left")), passages.select(F.col("content").alias("b"), F.col("passage").alias("right"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, every: DataFrame, ends: DataFrame, min_words: int, edits: bool) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) of the contents of alike natural paragraphs, runs around ends): both need a second scan of texts."""
    parts = every.where("keys is not null").groupBy("content").agg(F.min("keys").alias("parts"))
    members = shared_keys(parts.select("content", F.explode(combined("parts", BANDS, 1)).alias("x")).select("x.key", "x.last", "content"))
    contents = stored(members.select(F.col("content").alias("c")).distinct())
    least = every.where("keys is not null").join(contents, F.col("content") == F.col("c")).groupBy("content").agg(F.min(F.struct("doc_id", "text_hash", "word", "words")).alias("at"))
    wanted = ends.select("doc_id", "text_hash", "word", F.lit(0).alias("words"), F.lit(0).cast("long").alias("content")).unionByName(least.select("at.*", "content"))
    seen = stored(looked_at(docs, wanted, min_words))
    passages = seen.where("passage is not null")
    near = lambda x, y: F.lit(True) if edits else within(x["sketch"], y["sketch"], SIMILAR)
    sketches = passages.select("content", F.struct(*odd_fields("sketch")).alias("sketch"))
    sides = [sketches.select(F.col("content").alias(c), F.struct("sketch").alias(x)).hint("merge") for c, x in (("a", "x"), ("b", "y"))]
    pairs = stored(hub_pairs(members.select("key", "content", "n")).join(sides[0], "a").join(sides[1], "b").where(near(F.col("x"), F.col("y"))).select("a", "b"))
    links = stored(verified(pairs, passages, edits))
    parts = sketches.join(parts.withColumnRenamed("content", "c").hint("merge"), F.col("content") == F.col("c"))
    more = open_pairs(members, parts, links, BANDS, near, size=1)
    links = links.union(stored(verified(more, passages, edits)))
    return links, seen.where("passage is null").drop("passage", "sketch")


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose content more than one document has, with low, the least of these documents."""
    # As a table of its own this side leaves the join two plain exchanges, whose hot partitions adaptive execution splits.
    least = stored(rows.groupBy(F.col("content").alias("c")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").drop("high"))
    return rows.join(least, F.col("content") == F.col("c")).drop("c")


def chained(rows: DataFrame, *by: str) -> DataFrame:
    """Numbers in column chain the groups of rows of a text that overlap or touch."""
    order = Window.partitionBy("doc_id", "text_hash", *by).orderBy("word", F.desc("words"))
    reach = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("turn", (reach.isNull() | (F.col("word") > reach)).cast("int")).withColumn("chain", F.sum("turn").over(order)).drop("turn")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, edits: bool = False) -> DataFrame:
    """doc_id, text_hash, start, end, n_words, kind, removed, component_id: the repeated passages of all documents.

    kind is `run` for a run of min_words words or more that another document has word for word, and `paragraph` for a
    natural paragraph that is alike to another document's. component_id is the least doc_id of the passages linked to this
    one. A run of which part goes and part stays is given in as many rows, which may overlap; so may the two kinds.
    """
    every = stored(paragraphs(docs, min_words))
    at = ["doc_id", "text_hash", "word", "words", "start", "end", "content"]
    fixed = chained(repeated(every.where("keys is null").select(at)).dropDuplicates(["doc_id", "text_hash", "word"]))
    whole = Window.partitionBy("doc_id", "text_hash", "chain")
    span = lambda: F.max(F.col("word") + F.col("words")).over(whole) - F.min("word").over(whole)
    fixed = stored(fixed.withColumns({"unsure": span() < min_words, "rim": (F.col("word") == F.min("word").over(whole)) | (F.col("word") == F.max("word").over(whole))}))
    # A short chain's common run may begin or end at any of its paragraphs, so these are looked at in all texts.
    unsure = stored(fixed.where("unsure").select(F.col("content").alias("c")).distinct())
    ends = fixed.where("rim").select(at).union(fixed.join(unsure, F.col("content") == F.col("c")).select(at))
    links, runs = near_links(docs, every, ends, min_words, edits)
    # Chains of content-defined paragraphs that have min_words words, with the common runs of as many words.
    units = fixed.drop("chain", "unsure", "rim").withColumn("long", F.lit(False)).unionByName(repeated(runs).dropDuplicates(["doc_id", "text_hash", "word"]).withColumn("long", F.lit(True)))
    units = chained(units).withColumn("span", span()).where(F.col("span") >= min_words).withColumn("removed", F.col("doc_id") > F.col("low"))
    units = stored(units.select(*at, "long", "removed", F.xxhash64("doc_id", "text_hash", "chain").alias("node")))
    parts = chained(units, "removed").groupBy("doc_id", "text_hash", "removed", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("n_words"), F.min("node").alias("node"))
    hubs = stored(units.where("not long").groupBy(F.col("content").alias("c")).agg(F.min("node").alias("hub")))
    joined = units.where("not long").join(hubs, F.col("content") == F.col("c")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = stored(components(joined.union(links)).withColumnsRenamed({"node": "of"}))
    near = every.where("keys is not null").select(at).join(roots, F.col("content") == F.col("of")).dropDuplicates(["doc_id", "text_hash", "word"]).drop("of", "content")
    near = stored(near)
    lows = stored(near.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high"))
    near = near.join(lows, F.col("root") == F.col("r")).select("doc_id", "text_hash", "start", "end", F.col("words").alias("n_words"), F.lit("paragraph").alias("kind"), (F.col("doc_id") > F.col("low")).alias("removed"), F.col("low").alias("component_id"))
    parts = stored(parts.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of"))
    names = stored(parts.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id")))
    parts = parts.join(names, F.col("root") == F.col("r")).select("doc_id", "text_hash", "start", "end", "n_words", F.lit("run").alias("kind"), "removed", "component_id")
    return parts.union(near)
