"""SimHash near-dedup: Golay-code fuzzy keys, join, verification, connected components.

Fingerprints (64 bits) link at three or fewer differing bits. They are cut into three segments. Of three errors over
three segments, either one segment has none and another has at most one, or each has exactly one. The perfect binary
Golay code (23, 12) turns "at most one error" into equality: a segment's index key is the codeword nearest to it, its
probe keys are all codewords within four bits (one, or six where the nearest is three bits off). If u and v differ in at
most one bit, u's nearest codeword is within four bits of v, so u's index key is among v's probe keys. So keys are
  A  exact segment i with a fuzzy segment j, six ordered pairs, 33 to 34 bits;
  B  the three fuzzy indices together, 36 bits;
and the join on them finds every link; each is then verified on the fingerprints themselves.

Equal fingerprints become one row before the keys are made, so exact copies never meet in a join; a key that many
different fingerprints share is one side of a plain sort-merge join, which adaptive execution splits. Each table here has
a row for a fingerprint, so the joins ask for a merge: a broadcast, which Spark would choose below its threshold, is built
in the driver's heap.

similar_texts() and drop_near_copies() go by the texts instead: a Jaccard similarity of 0.8 or more over five-word shingles.
Its fingerprints differ there in 15 % of their bits, too many for the search above. So the fingerprint is longer, SEGMENTS
segments of 23 bits, and every segment is decoded by its margins (how far the shingles' votes lie from a draw) and not by
its bits: the codeword that agrees best with them is the same for 0.26 of segments at a similarity of 0.8, for 0.43 at 0.9.
Each two segments' codewords make a key of 24 bits, so texts that agree in two of the segments share one: 0.91 of pairs at
0.8, 0.95 at 0.83, 0.99 at 0.9. Candidates are joined to the hub of their bucket, compared by fingerprint, and verified by
the exact similarity of their words; what these links do not connect meets all others of its buckets, whatever their size
(graph.open_pairs). Pairs that share no key, or whose fingerprints differ too much by chance, are found by an exact way: of two
sets of p and q shingles with a similarity of 0.8, the p // 5 + 1 and q // 5 + 1 first ones in any one order of all shingles have
one in common, so what is still unconnected meets all others that have a shingle of its rarest() in theirs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; a null
doc_id is given a component but names none; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import LONGS, combined, components, hub_pairs, odd_fields, odd_sketches, open_pairs, shared_keys, within, within_wide
from strandline.llm.shared import cut, only_rows, slices, stored, text_hashes, tidy

BITS, SEGMENTS = 3, 14
CUTS = (22, 21, 21)
#: Longs of a fingerprint of signatures().
WIDTH = -(-SEGMENTS * 23 // 64)
#: Longs of a long text's second odd_sketches() row.
WIDE = 64
#: Fixed value: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
GENERATOR = 0b101011100011


def fingerprints_of(texts: pa.Array, k: int = 3) -> np.ndarray:
    """One unsigned 64-bit SimHash for each text: bit set where over half of the shingles' XXH64 (seed 42) have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            continue
        n = max(1, len(words) - k + 1)
        if len(words) <= k:
            hashes = [digest(b" ".join(words), 42)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[: n - 1])).tolist()
            hashes = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())]
        counts, h = np.zeros(64, np.int64), np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        for s in range(0, n, 1 << 16):
            counts += np.unpackbits(h[s : s + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out


def simhash(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), pa.array(fingerprints_of(texts.slice(s, e - s), k).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the 23 unit vectors, table of 6 error patterns by syndrome, the lightest first).

    Codewords within four bits of a vector differ from it by the patterns of weight four or less in its coset: one of
    weight three or less always, and five more of weight four where that one has weight three; else it is repeated.
    """
    unit = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        unit[i] = r
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    from itertools import combinations

    for w in range(5):
        for at in combinations(range(23), w):
            syndrome, pattern = 0, 0
            for i in at:
                syndrome ^= int(unit[i])
                pattern |= 1 << i
            if w < 4 or (count[syndrome] and bin(int(table[syndrome, 0])).count("1") == 3):
                table[syndrome, count[syndrome]] = pattern
                count[syndrome] += 1
    for s in range(2048):
        table[s, count[s] :] = table[s, 0]
    return unit, table


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices: column 0 the nearest codeword, all columns those within four bits, repeats allowed."""
    unit, table = golay_tables()
    syndrome = np.zeros(len(segment), np.int64)
    for i in range(23):
        syndrome ^= ((segment >> i) & 1) * unit[i]
    return (segment[:, None] ^ table[syndrome]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of the index side and (row, key) of the probe side, each without repeats within a row."""
    fp = fp.view(np.uint64)
    parts, low = [], 0
    for width in CUTS:
        parts.append(((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width
    near = [golay_indices(p) for p in parts]
    n, rows = len(fp), np.arange(len(fp))
    left, right = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        head = (np.int64(tag) << 36) | (parts[i] << 12)
        left.append(head | near[j][:, 0])
        right.append(head[:, None] | near[j])
    head = np.int64(6) << 36
    left_b = head | (near[0] << 24) | (near[1][:, :1] << 12) | near[2][:, :1]
    right_b = head | (near[0][:, :1, None] << 24) | (near[1][:, :, None] << 12) | near[2][:, None, :]
    left = np.concatenate([np.stack(left, 1), left_b], 1)
    right = np.concatenate([*right, right_b.reshape(n, 36)], 1)
    out = []
    for keys in (left, right):
        keys = np.sort(keys, 1)
        first = np.ones(keys.shape, bool)
        first[:, 1:] = keys[:, 1:] != keys[:, :-1]
        out += [np.repeat(rows, first.sum(1)), keys[first]]
    return tuple(out)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints of the column fp within BITS bits, each once, a < b."""

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for s in range(0, len(fp), 4096):
                part = fp[s : s + 4096]
                lr, lk, rr, rk = fuzzy_keys(part)
                for rows, keys, side in ((lr, lk, 0), (rr, rk, 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys), pa.array(np.full(len(keys), side, np.int8))], names=["fp", "key", "side"])

    keyed = fps.select("fp").mapInArrow(run, "fp long, key long, side byte")
    left = keyed.where("side = 0").select("key", F.col("fp").alias("u"))
    right = keyed.where("side = 1").select("key", F.col("fp").alias("v"))
    met = left.join(right.hint("merge"), "key").where(F.expr(f"u <> v and bit_count(u ^ v) <= {BITS}"))
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def near_dedup(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id linked to it, directly or through others)."""
    rows = stored(simhash(docs, k))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(least)).withColumnsRenamed({"node": "fp"})
    joined = least.join(roots.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of = joined.where("root is not null").select("fp", "root").join(named.hint("merge"), "root").select(F.col("fp").alias("f"), "component_id")
    # As a table of its own this side leaves the join two plain exchanges, so a fingerprint with very many rows is split.
    of = stored(of)
    out = rows.join(of.hint("merge"), rows.fp == of.f)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@functools.cache
def codewords() -> np.ndarray:
    """(23, 4096) signs of all codewords of the Golay code."""
    rows = np.zeros(1, np.int64)
    for i in range(12):
        rows = np.concatenate((rows, rows ^ (GENERATOR << i)))
    return (((rows[None, :] >> np.arange(23)[:, None]) & 1) * 2 - 1).astype(np.float32)


def contents_of(words, n_texts: int) -> np.ndarray:
    """A hash of each text's words in their order; 0 for a text without words."""
    from strandline.llm.words import mix

    out = np.zeros(n_texts, np.uint64)
    if len(words.row):
        first = np.flatnonzero(np.concatenate(([True], words.row[1:] != words.row[:-1])))
        n = np.diff(np.append(first, len(words.row)))
        place = np.arange(len(words.row)) - np.repeat(first, n)
        powers = np.multiply.accumulate(np.full(int(n.max()), np.uint64(0x9E3779B97F4A7C15)))
        out[words.row[first]] = mix(np.add.reduceat(words.hashes * powers[place], first) + n.astype(np.uint64))
    return out


def shingles_of(words, contents: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the text of each, ascending."""
    h, at = words.shingles(k)
    row, n_texts = words.row[at], len(contents)
    # A text of fewer than k words is one shingle of all of them.
    count = np.bincount(words.row, minlength=n_texts)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        h, row = np.concatenate((h, contents[few])), np.concatenate((row, few.astype(row.dtype)))
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, ascending."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order].astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def rarest(h: np.ndarray, row: np.ndarray, n_texts: int, least: float, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): the first shingles of each text that decide whether it can have a similarity of `least` to another.

    The order of all shingles is by their counts, those in often (ascending), else 0, and then by their hash. Any counts
    give all pairs; right ones keep a shingle that many texts have out of their first ones.
    """
    h, row = _distinct(h, row)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        order = np.lexsort((np.where(often[at] == h, counts[at], 0), row))
        h = h[order]
    size = np.bincount(row, minlength=n_texts)
    taken = np.where(size, np.floor(size * (1 - least) + 1e-6).astype(np.int64) + 1, 0)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    return np.cumsum(taken), h[place < np.repeat(taken, size)]


def margins_of(h: np.ndarray, row: np.ndarray, n_texts: int) -> np.ndarray:
    """(texts, SEGMENTS * 23) votes of each text's shingles for each bit less those against it, as a share of all."""
    from strandline.llm.words import mix

    size, out = SEGMENTS * 23, np.zeros((n_texts, -(-SEGMENTS * 23 // 64) * 64), np.float32)
    for s in range(0, len(h), 1 << 15):
        part, of = h[s : s + (1 << 15)], row[s : s + (1 << 15)]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        n = np.diff(np.append(first, len(of)))[:, None]
        for w in range(out.shape[1] // 64):
            bits = np.unpackbits(mix(part * np.uint64(2 * w + 3) + np.uint64(w)).view(np.uint8).reshape(-1, 8), axis=1)
            out[of[first], w * 64 : (w + 1) * 64] += 2 * np.add.reduceat(bits, first, 0, dtype=np.int32) - n
    return out[:, :size] / np.maximum(np.bincount(row, minlength=n_texts), 1)[:, None]


def often_met(docs: DataFrame, k: int, sample: int = 1 << 13, least: int = 8, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and their counts) of the at most `most` shingles that most texts have, of a sample of about `sample`
    texts. They only set the order of rarest(), which finds all pairs in any order."""

    def run(batches):
        from strandline.llm.words import FOLDED, Words

        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                words = Words(texts.slice(s, e - s), FOLDED)
                h, row = shingles_of(words, contents_of(words, e - s), k)
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(h, row)[0].view(np.int64))], names=["h"])

    with tidy(docs.sparkSession):
        share = max(1, docs.count() // sample)
        counts = docs.where(F.pmod("t2", F.lit(share)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
        found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def signatures(docs: DataFrame, k: int = 5, extra: tuple[str, ...] = (), least: float = 0.8) -> DataFrame:
    """The extra columns (of type long), content (a hash of the words), codes (a codeword for each segment), bits (signs of the margins), odd (odd_sketches() of the shingles), rare (the rarest() shingles),
    wide (for texts of more shingles than odd has bits: odd_sketches() of WIDE longs).

    docs: text, its text_hashes() t1 and t2, and the extra columns.
    """
    known = docs.sparkSession.sparkContext.broadcast(often_met(docs, k))

    def run(batches):
        from strandline.llm.words import FOLDED, Words

        for batch in batches:
            texts = batch.column("text")
            for s, e in slices(texts):
                words = Words(texts.slice(s, e - s), FOLDED)
                content = contents_of(words, e - s)
                h, row = shingles_of(words, content, k)
                margin, odd = margins_of(h, row, e - s), odd_sketches(h, row, e - s)
                ends, rare = rarest(h, row, e - s, least, *known.value)
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(rare.view(np.int64)))
                long = odd[:, 0] > 64 * LONGS
                some = long[row]
                sketch = odd_sketches(h[some], (np.cumsum(long) - 1)[row[some]], int(long.sum()), WIDE)
                wide = pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), WIDE + 1).cast(pa.list_(pa.int64()))
                wide = wide.take(pa.array(np.cumsum(long) - 1, mask=~long))
                codes = np.zeros((e - s, SEGMENTS), np.int16)
                for i in range(0, e - s, 512):
                    for j in range(SEGMENTS):
                        codes[i : i + 512, j] = (margin[i : i + 512, j * 23 : (j + 1) * 23] @ codewords()).argmax(1)
                packed = np.packbits(np.pad(margin > 0, ((0, 0), (0, -margin.shape[1] % 64))), axis=1).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((codes, pa.int16()), (packed, pa.int64()), (odd, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s, e - s) for c in extra), pa.array(content.view(np.int64)), *lists, rare, wide], names=[*extra, "content", "codes", "bits", "odd", "rare", "wide"])

    fields = "".join(f"{c} long, " for c in extra)
    return docs.select(*extra, "text").mapInArrow(run, f"{fields}content long, codes array<short>, bits array<long>, odd array<long>, rare array<long>, wide array<long>")


def jaccard(a: bytes, b: bytes, k: int) -> float:
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def similar_texts(docs: DataFrame, rows: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): links of contents whose texts are similar, that connect all pairs of a similarity of least. docs: t1, t2 (hashes
    of the text) and text; rows: signatures() with t1, t2 and this least."""
    nodes = stored(rows.groupBy("content").agg(F.min_by(F.struct("t1", "t2", "codes", "rare", "wide", F.struct(*(F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(WIDTH)), *odd_fields("odd")).alias("sketch")), F.struct("t1", "t2")).alias("x")).select("content", "x.*"))
    members = shared_keys(nodes.select("content", F.explode(combined("codes", SEGMENTS, 2)).alias("x")).select("x.key", "x.last", "content"))
    near = lambda x, y: within(x, y, least) & (apart(x, y) <= int(0.22 * SEGMENTS * 23))
    sides = [nodes.select(F.col("content").alias(c), F.col("sketch").alias(x)).hint("merge") for c, x in (("a", "x"), ("b", "y"))]
    pairs = hub_pairs(members.select("key", "content", "n")).join(sides[0], "a").join(sides[1], "b").where(near(F.col("x"), F.col("y"))).select("a", "b")
    links = _similar(docs, nodes, stored(pairs), k, least)
    more = open_pairs(members, nodes.select("content", F.col("codes").alias("parts"), "sketch"), links, SEGMENTS, lambda x, y: near(x["sketch"], y["sketch"]))
    links = links.union(_similar(docs, nodes, more, k, least))
    # The rest: pairs that share no key above or whose fingerprints are too far apart, by their rarest shingles.
    members = shared_keys(nodes.select("content", F.lit(0).alias("last"), F.explode("rare").alias("key")))
    rest = open_pairs(members, nodes.select("content", F.lit(0).alias("parts"), "sketch"), links, 0, lambda x, y: within(x["sketch"], y["sketch"], least))
    # The short sketches of long texts are full, so these are told apart by wide ones before their texts are fetched.
    sides = [nodes.select(F.col("content").alias(c), F.col("wide").alias(x)).hint("merge") for c, x in (("a", "x"), ("b", "y"))]
    rest = stored(rest.join(sides[0], "a").join(sides[1], "b").where(within_wide(F.col("x"), F.col("y"), least)).select("a", "b"))
    return links.union(_similar(docs, nodes, rest, k, least))


def apart(p, q) -> Column:
    """The number of bits in which two fingerprints, given by their columns bits0 and on, differ."""
    return sum(F.bit_count(p[f"bits{i}"].bitwiseXOR(q[f"bits{i}"])) for i in range(WIDTH))


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, least: float) -> DataFrame:
    """The rows of pairs (a, b), a stored table, whose texts are similar by their shingles."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(wanted, F.col("content") == F.col("c")).select("content", F.col("t1").alias("_t1"), F.col("t2").alias("_t2")))
    texts = docs.join(wanted, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).groupBy("content").agg(F.min("text").alias("text"))

    def folded(batches):
        from strandline.llm.words import DROP, FOLDED, SPACE, raw

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = FOLDED[raw(batch.column("text").slice(i, 1))[0]]
                out.append(np.where(text == SPACE, ord(" "), text)[text != DROP].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(out, pa.binary())], names=["content", "words"])

    def verified(batches):
        for batch in batches:
            kept = [jaccard(x, y, k) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    texts = stored(texts.mapInArrow(folded, "content long, words binary"))
    both = pairs.join(texts.select(F.col("content").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("content").alias("b"), F.col("words").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"))


def drop_near_copies(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar texts the one with the least doc_id.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id with another text are judged each for itself; rows
    that repeat both become one, as only_rows() tells. A null doc_id loses every tie.
    """
    t1, t2 = text_hashes()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2"))
    rows = stored(signatures(keyed, k, ("doc_id", "t1", "t2"), least))
    low = rows.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("low"))
    roots = stored(components(similar_texts(keyed, rows, k, least)))
    best = low.join(roots, F.col("content") == F.col("node"), "left").groupBy(F.coalesce("root", "content").alias("root")).agg(F.min("low").alias("low"))
    return only_rows(docs, best.select("low.doc_id", "low.t1", "low.t2"))
