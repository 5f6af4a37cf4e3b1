"""Piece encoding against the library, hard negatives and vector codes against brute force, on small tables with every edge case."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from strandline.llm import hard_negatives, piece_bpe, vector_codes
from strandline.llm.vectors import finite

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_tokens int, ids string, lang string"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(rng, n):
    pieces = piece_bpe.model(MODEL).pieces[259:]
    makers = [
        lambda k: "".join(rng.choice(" ab▁\n\t") for _ in range(k)),
        lambda k: "".join(rng.choice(pieces) for _ in range(k)),
        lambda k: "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F600), rng.randrange(0x400, 0x460)])) for _ in range(k)),
        lambda k: " " * rng.randrange(50) + rng.choice(["the", "", "<s>", "<0x41>", "x"]) + " " * rng.randrange(50),
        lambda k: rng.choice(["a", "ab", "xx", "the ", "0", "\t", "  "]) * k,
        lambda k: "".join(rng.choice("etaoinshrdlu") for _ in range(6 * k)),
        lambda k: "".join(rng.choice(["in", "er", "the", "tion", "ing", "s", "an", "re"]) for _ in range(3 * k)),
        lambda k: " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randrange(1, 12))) for _ in range(k)),
    ]
    return ["", " ", "  ", *(" " * k for k in range(13, 50)), *(rng.choice(makers)(rng.randrange(150)) for _ in range(n))]


@pytest.mark.parametrize("long", [piece_bpe.LONG, 12, 0])
def test_pieces_equal_the_library(library, monkeypatch, long):
    monkeypatch.setattr(piece_bpe, "LONG", long)
    encoder, rows = piece_bpe.Encoder(MODEL), texts(random.Random(long), 1200)
    got = [encoder.ids(x).tolist() for x in encoder.numbered(rows)]
    assert got == [library.encode(t, add_bos=True, add_eos=True) for t in rows]
    assert [piece_bpe.decode_ids(x, MODEL) for x in got] == [library.decode(x) for x in got]


def test_pieces_decode_any_ids(library):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(12))]
        assert piece_bpe.decode_ids(ids, MODEL) == library.decode(ids)


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 200_000, "ab" * 60_000 + "c", "etaoin" * 30_000])
def test_long_words(library, text):
    encoder = piece_bpe.Encoder(MODEL)
    assert encoder.ids(encoder.numbered([text])[0]).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_dictionary_is_bounded(library):
    encoder, rows = piece_bpe.Encoder(MODEL, memory=500), texts(random.Random(9), 300)
    for s in range(0, len(rows), 10):
        part = rows[s : s + 10]
        assert [encoder.ids(x).tolist() for x in encoder.numbered(part)] == [library.encode(t, add_bos=True, add_eos=True) for t in part]
        encoder.trimmed()
        assert encoder.held <= 500


def test_piece_digests_and_round_trip(spark, library):
    rows = [(1, None), (2, ""), (None, "no id"), (4, "one two"), (4, "one two"), (5, "﻿日本 😀\r\n x"), (6, "long " * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "x", "l") for d, t in rows], DOCS)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_bpe.digests(df, MODEL).collect()), key=repr) == sorted(want, key=repr)
    back = piece_bpe.decode(piece_bpe.encode(df, MODEL, ("doc_id", "lang")), MODEL).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert piece_bpe.digests(df.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        whole = f.read()
    (tmp_path / "m").write_bytes(whole.replace("▁the".encode(), "the▁".encode(), 1))
    with pytest.raises(ValueError, match="not a BPE model"):
        piece_bpe.Model(str(tmp_path / "m"))


# ---- vectors

VECTORS = "vec_id long, embedding array<float>, label int, x int, rest string, code string, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "r", "c", 7) for i, v, y in rows], VECTORS)


def as_kept(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v, scale, width):
    return [math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (width - len(v))


def made(seed, n, width=16, labels=4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.15, width)], int(rng.integers(labels))) for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, same, i % 3) for i in range(60)]  # a vector that many rows share
    rows += [(n + 100, None, 1), (n + 101, [NAN] * width, 1), (n + 102, [0.1] * (width - 1) + [INF], 1), (n + 103, [None] + [0.1] * (width - 1), 1), (n + 104, [0.1] * width, None)]
    rows += [(200, rows[200][1], rows[200][2]), (7, rows[3][1], 2), (n + 105, [0.2] * (width // 2), 1), (n + 106, [], 1), (None, [0.1] * width, 1)]
    return rows


def brute_negatives(rows):
    rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and as_kept(v)]
    width = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, floored(v, 256, width), y) for i, v, y in rows]
    out = []
    for k, (i, a, y) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted(((-sum(map(lambda p, q: p * q, a, v)), j, z) for n, (j, v, z) in enumerate(rows) if n != k))
        for s, p, _ in [r for r in scored if r[2] == y][:5]:
            found = [(-t, j) for t, j, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, r + 1, j, -s, t) for r, (t, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [hard_negatives.BLOCK, 3])
def test_hard_negatives_against_brute_force(spark, block):
    rows = made(1, 700)
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(5), block=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert len(brute_negatives(rows)) > 200


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 1)], [(100, [], 1)], [(100, [0.5, 0.5], 1)], [(100, [], 1), (100, [], 1), (3, [], 2), (None, [], 2)]):
        got = hard_negatives.hard_negatives(vectors(spark, rows)) if rows else hard_negatives.hard_negatives(vectors(spark, [(1, None, 1)]).limit(0))
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 40, (3000, 32)).astype(np.int64)
    books = hard_negatives.fitted(x[:1000])
    codes, left = np.zeros((len(x), len(books)), np.uint8), x.copy()
    for p, book in enumerate(books):
        own = x[:, 2 * p : 2 * p + 2]
        codes[:, p] = ((own[:, None] - book) ** 2).sum(2).argmin(1)
        left[:, 2 * p : 2 * p + 2] -= book[codes[:, p]]
    rest = np.sqrt((left**2).sum(1)) * (1 + 1e-12)
    block = hard_negatives.Anchors(np.arange(20), np.zeros(20), x[:20], books)
    low, high = block.bounds(codes, rest, np.arange(20))
    exact = x @ x[:20].T
    assert (low <= exact).all() and (exact <= high).all()
    tenth = np.sort(exact, 0)[-10]
    assert (high >= tenth).mean() < 0.1


def test_too_large_components(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        hard_negatives.hard_negatives(vectors(spark, [(100, [3e9], 1), (1, [1.0], 1)])).collect()
    with pytest.raises(Exception, match="do not fit a long"):
        vector_codes.vector_codes(vectors(spark, [(1, [1e6] * 8, 1)])).collect()


def brute_codes(rows):
    rows = sorted(((i, v, y) for i, v, y in rows if as_kept(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 8) * 8
    size = width // 8
    parts = [[x[p * size : (p + 1) * size] for p in range(8)] for x in (floored(v, 4096, width) for _, v, _ in rows)]
    books = [[parts[i][p] for i in range(min(16, len(rows)))] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(6):
        for p in range(8):
            owned = {}
            for x in parts:
                owned.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, xs in owned.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, y), e in zip(rows, errors):
        total[y] = total.get(y, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), e, total[y], digest) for (i, _, y), f, e in zip(rows, found, errors)]


@pytest.mark.parametrize(("seed", "n", "width"), [(1, 400, 16), (2, 5, 24), (3, 60, 11)])
def test_codes_against_brute_force(spark, seed, n, width):
    rows = made(seed, max(n, 201), width)[-(n + 70) :]
    got = vector_codes.vector_codes(vectors(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_codes(rows)))


def test_codes_with_many_labels_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    for rows in ([], [(1, [0.5] * 8, None)], [(1, [], 1), (2, [], None)], [(i, [0.1 * i] * 8, [None, 1, 2][i % 3]) for i in range(9)]):
        df = vectors(spark, rows) if rows else vectors(spark, [(1, None, 1)])
        assert sorted(map(repr, map(tuple, vector_codes.vector_codes(df).collect()))) == sorted(map(repr, brute_codes(rows)))


def test_nearest_is_exact_where_float32_is_not():
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 22, 1 << 23, 8)
    book = base + rng.integers(-2, 3, (16, 8))
    x = base + rng.integers(-3, 4, (2000, 8))
    code, distance = vector_codes.nearest(x, book)
    exact = ((x[:, None] - book) ** 2).sum(2)
    assert (code == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    rough = (book.astype(np.float32) ** 2).sum(1) - 2 * x.astype(np.float32) @ book.T.astype(np.float32)
    assert (rough.argmin(1) != exact.argmin(1)).any()


def test_finite(spark):
    rows = made(8, 210)
    got = {r["vec_id"] for r in vectors(spark, rows).where(~finite("embedding")).collect()}
    assert got == {i for i, v, _ in rows if not as_kept(v)}
