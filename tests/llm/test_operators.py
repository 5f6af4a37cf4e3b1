"""Corpus operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, exact_dedup, graph, language, near_dedup, pii, shared, substring_dedup, token_counts, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, name string, key string, a string, hub string"


def docs(spark, rows):
    """rows of (doc_id, text[, lang]); further columns bear names that the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, 1, "n", "k", "a", "h") for r in rows], DOCS)


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (5, "one"), (5, "one"), (6, "Ünïcödé 日本語 😀"), (7, "x" * 30_000), (8, "a b " * 9000), (9, "one"), (10, " o n e ")]


# ---- shared


def test_crc_split(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("p", shared.crc_part("doc_id", 4)).collect()
    assert all(r["p"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows)


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], None])
def test_components(spark, edges):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] if edges is None else edges
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([(a, b) for a, b in edges if a is not None and b is not None and a != b])


# ---- 1 byte-level BPE


@pytest.fixture(scope="module")
def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken_on_odd_texts(reference_encoder):
    rng = random.Random(1)
    odd = "aab \n\t\x1c\x85  29٣²½éñßÆ'sstllre.,!?日本語한국😀🏽́_-\r\x0b\x00"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5001, "ab" * 3000, "=+" * 999, " " * 777, "<|endoftext|>", "the" * 500, "'s" * 50, "aaab" * 200, "", None]
    encoder = bpe.Encoder(RANKS, P.PATTERN, memory=20_000)
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, numbers in zip(part, encoder.numbered(part)):
            ids = encoder.ids(numbers).tolist()
            assert ids == reference_encoder.encode_ordinary(text or "")
            assert encoder.text_of(numbers) == " ".join(map(str, ids))


def test_bpe_tables(spark, reference_encoder):
    table = docs(spark, EDGES)
    want = sorted((r[0] or 0, len(ids := reference_encoder.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in EDGES)
    assert sorted((r[0] or 0, *r[1:]) for r in bpe.digests(table, RANKS, P.PATTERN).collect()) == want
    back = bpe.decode(bpe.encode(table, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((r[1] or "").encode() for r in EDGES)
    assert bpe.encode(table.limit(0), RANKS, P.PATTERN).count() == bpe.digests(table.limit(0), RANKS, P.PATTERN).count() == 0


# ---- 2 url filter


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/x", "https://example.org/en/12?q", "http://b.org", "http://b.org/", "x://y.com/fr/", "x://com/de/1", "nothing", None, "http://notexample.org/es/", "http://h/p#f://z", "ftp://q.com?x=/fr/"]
    pages = spark.createDataFrame([(i, u, None, "k") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("b.org", "", None, "allow"), 3: ("b.org", "/", "org/", "allow"),
        4: ("y.com", "/fr/", "com/fr/", "allow"), 5: ("com", "/de/1", "com/de/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.org", "/es/", "org/", "allow"), 9: ("h", "/p", None, "allow"), 10: ("q.com", "", None, "allow"),
    }


def test_block_reaches_aliases_unless_allowed(spark):
    link = '<LINK href="{}" rel=canonical>'
    rows = [
        (1, "http://mirror.net/a", link.format("https://x.com/de/a")), (2, "http://mirror.net/b#top", link.format("/a")), (3, "http://mirror.net/c", '<meta http-equiv="refresh" content="0; url=b">'),
        (4, "http://ok.net/1", link.format("https://x.com/de/z")), (5, "http://ok.net/1", link.format("http://good.org/")), (6, "http://alone.net/", "<p>"), (7, "http://x.com/de/a", None), (None, "http://mirror.net/a", "")]
    got = [(r["page_id"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "block"), (None, "block")], key=str)
    more = spark.createDataFrame([("http://alone.net/", "http://mirror.net/c")], "source string, target string")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, redirects=more).collect()}[6] == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_links_equal_brute_force(spark):
    """References resolved by urllib, classes by union-find."""
    from urllib.parse import urljoin, urlsplit

    def key(url):
        u = urlsplit(urljoin(url, url))
        path = urlsplit(urljoin(f"http://h{u.path or '/'}", urlsplit(f"http://h{u.path or '/'}").path)).path
        return (u.netloc.lower(), path, u.query)

    def rule(url):
        u = urlsplit(url)
        fits = [(len(h + p), len(h), v == "allow", v) for v, h, p in url_filter.RULES if f".{u.netloc.lower()}".endswith("." + h) and u.path.startswith(p)]
        return max(fits)[-1] if fits else None

    rng = random.Random(20)
    hosts, refs = ["N.net", "x.com", *(f"h{j}.net" for j in range(90))], ["../x", "./y", "?id=2", "#top", "z?a=1&amp;b=2", "/de/a", "//x.com/de/a", "../../q/", "..", "https://x.com/de/../de/b", "http://good.org/", "http://n.net", "a/b/../c", "mailto:x"]
    rows = []
    for i in range(300):
        url = f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/a/b', '/a/b/', '/de/a', '/x', '/a/./y', '/q/', '/c?id=2'])}"
        tag = f'<link data-href="http://x.com/de/no" rel="canonical" href="{rng.choice(refs)}">'
        rows.append((i, url, [tag, f"<!-- {tag} -->", f"<!-- {tag}", "<p>canonical"][rng.choice([0, 0, 1, 2, 3])] if rng.random() < 0.3 else None))
    rows.append((900, "http://late.net/", "<p> " * 50_000 + '<meta http-equiv=refresh content="0;url=//x.com/de/a">'))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    urls = [u for _, u, _ in rows]
    for _, u, html in rows:
        ref = re.search(r'(?: href="|url=)([^">]*)', re.sub(r"(?s)<!--.*?(-->|$)", "", html or ""))
        if ref and not re.match("#|mailto", ref[1]):
            to = urljoin(u, ref[1].replace("&amp;", "&"))
            urls.append(to)
            parent[find(key(u))] = find(key(to))
    rules = {}
    for u in urls:
        rules.setdefault(find(key(u)), set()).add(rule(u))
    want = {i: rule(u) or ("block" if "block" in rules[find(key(u))] and "allow" not in rules[find(key(u))] else "allow") for i, u, _ in rows}
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and sum(want[i] == "block" and rule(u) is None for i, u, _ in rows) > 3
    none = spark.createDataFrame([("http://n.net/", None), (None, "http://x.com/de/a")], "source string, target string")
    assert url_filter.judge(spark.createDataFrame([(1, "http://n.net", None)], "page_id long, url string, html string"), redirects=none).first()["verdict"] == "allow"


# ---- 3 pseudonyms


def luhn(d):
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_pseudonyms_keep_their_formats(spark):
    text = "+1 (017) 555-7713; Réa.90@m2.example.com 4111 1111 1111 1111 4111111111111112 10.0.0.1. 1984-02-29 31.12.1999 02/30/2001 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 123-45-6789 000-12-3456 300.1.1.1"
    rows = docs(spark, [(1, text), (2, text + " end"), (3, None), (4, ""), (5, "nothing 12"), (None, "a@b.co")])
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "nothing 12" and got[3]["n_values"] == got[5]["n_values"] == 0
    assert got[1]["kinds"] == ["phone", "email", "card", "ip", "date", "date", "iban", "iban", "ssn"] and got[None]["kinds"] == ["email"]
    assert got[2]["text"] == got[1]["text"] + " end"
    out = got[1]["text"]
    m = re.fullmatch(r"\+1 (\(\d{3}\) \d{3}-\d{4}); (\S+)@m2.example.com (\d{4} \d{4} \d{4} \d{4}) 4111111111111112 (\d+\.\d+\.\d+\.\d+)\. (\d{4})-(\d\d)-(\d\d) (\d\d)\.(\d\d)\.(\d{4}) 02/30/2001 (GB\d\d WEST \d{4} \d{4} \d{4} \d\d) (DE\d{20}) (\d{3})-(\d\d)-(\d{4}) 000-12-3456 300.1.1.1", out)
    assert m and luhn(m[3].replace(" ", "")) and m[3][0] == "4" and iban_ok(m[11]) and iban_ok(m[12])
    assert 1800 <= int(m[5]) <= 2199 and 1 <= int(m[6]) <= 12 and int(m[13]) not in (0, 666) and int(m[13]) < 900
    assert "Réa" not in out and "5698" not in out.split("WEST")[1] and out != pii.pseudonymise(rows, "other").where("doc_id = 1").first()["text"]


def test_pseudonyms_are_permutations(spark):
    phones = [f"555-{i // 100:03d}-{i % 100:04d}" for i in range(3000)]
    days = [f"{1990 + i // 336:04d}-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}" for i in range(2000)]
    cards = [d for i in range(4000) if luhn(d := f"40000000000{i:05d}")]
    names = [f"{a}{b}@x.io" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    values = phones + days + cards + names
    got = [r["text"] for r in pii.pseudonymise(docs(spark, list(enumerate(values))), "k").orderBy("doc_id").collect()]
    for part in (phones, days, cards, names):
        out = [got[values.index(v)] for v in part[:1]] + [g for g, v in zip(got, values) if v in set(part)]
        assert len(set(out)) == len(part) and all(len(g) == len(v) for g, v in zip(out[1:], part))
    assert all(luhn(g) for g, v in zip(got, values) if v in set(cards))


def brute_feistel(a, b, size_a, size_b, key, tweak):
    for r in range(10):
        digest = lambda x: int(hashlib.sha256(f"{key}:{tweak}:{r}:{x}".encode()).hexdigest()[:15], 16)
        a, b = ((a + digest(b)) % size_a, b) if r % 2 == 0 else (a, (b + digest(a)) % size_b)
    return a, b


def test_pseudonyms_equal_an_independent_network(spark):
    """Phones, IPv4, dates, numbers and IPv6 against the network written again in Python."""
    import datetime
    import ipaddress

    def digits(d, tweak):
        h = len(d) // 2
        a, b = brute_feistel(int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h), "k", f"{tweak}{len(d)}")
        return (f"{a:0{h}d}" if h else "") + f"{b:0{len(d) - h}d}"

    def day(y, m, d):
        n = (datetime.date(y, m, d) - datetime.date(1800, 1, 1)).days
        a, b = brute_feistel(n // 773, n % 773, 189, 773, "k", "date")
        return datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)

    def second(y, m, d):
        t = day(y, m, d)
        while t.day <= 12:
            t = day(t.year, t.month, t.day)
        return t

    def phone(code, rest):
        return code + digits(rest, f"phone{code}/")

    def ip(x):
        a, b = brute_feistel(*divmod(int(ipaddress.IPv4Address(x)), 65536), 65536, 65536, "k", "ip")
        return str(ipaddress.IPv4Address(a * 65536 + b))

    def ipv6(x):
        n, out = int(ipaddress.IPv6Address(x)), []
        for i, half in ((0, n >> 64), (4, n & (1 << 64) - 1)):
            out += brute_feistel(*divmod(half, 1 << 32), 1 << 32, 1 << 32, "k", f"ipv6/{i}")
        return ":".join(f"{w >> 16:x}:{w & 65535:x}" for w in out)

    want = {
        "+15551234567": "+" + phone("1", "5551234567"), "+1 5551234567": "+1 " + phone("1", "5551234567")[1:], "+35312345678": "+" + phone("353", "12345678"),
        "10.1.2.3": ip("10.1.2.3"), "1999-02-28": day(1999, 2, 28).isoformat(), "02/28/1999": day(1999, 2, 28).strftime("%m/%d/%Y"), "25/12/1990": second(1990, 12, 25).strftime("%d/%m/%Y"),
        "25.12.1990": day(1990, 12, 25).strftime("%d.%m.%Y"), "12.25.1990": second(1990, 12, 25).strftime("%m.%d.%Y"), "31-12-1999": day(1999, 12, 31).strftime("%d-%m-%Y"),
        "1.5.1990": "{0.day}.{0.month}.{0.year}".format(day(1990, 5, 1)), "3/4/2020": "{0.month}/{0.day}/{0.year}".format(day(2020, 3, 4)), "31/31/1999": "31/31/1999", "2001-02-30": "2001-02-30",
        "2001:db8::1": ipv6("2001:db8::1"), "2001:0db8:0:0:0:0:0:1": ipv6("2001:db8::1"), "fe80::A:2": ipv6("fe80::a:2"), "std::vector": "std::vector", "1:2:3:4:5:6:7:8:9": "1:2:3:4:5:6:7:8:9",
    }
    rows = [*enumerate(want), (100, "иван@mail.com"), (101, "Иван@mail.com"), (102, "ПЁТР@mail.com"), (103, "a@mail.com " * 20_000)]
    secret = spark.createDataFrame([("k",)], "key string")
    for key in ("k", secret):
        got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(spark, rows), key).collect()}
        assert {x: got[i] for i, x in enumerate(want)} == want
        assert got[100] == got[101] and len({got[100], got[102], "иван@mail.com"}) == 3 and got[100].endswith("@mail.com") and len(set(got[103].split())) == 1
    hidden = pii.pseudonymise(docs(spark, rows), spark.createDataFrame([("s3cr3t",)], "key string"))
    assert "s3cr3t" not in hidden._jdf.queryExecution().toString()
    names = [f"{a}{b}@x.io" for a in "абвгдежз" for b in "éàüñ日本語ξ"]
    assert len({r["text"] for r in pii.pseudonymise(docs(spark, list(enumerate(names))), "k").collect()}) == 64
    slashes = [f"{d:02d}/{m:02d}/1990" for m in range(1, 13) for d in range(1, 29)]
    assert len({r["text"] for r in pii.pseudonymise(docs(spark, list(enumerate(slashes))), "k").collect()}) == len(slashes)


# ---- 4 decontamination


def fold(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[ \t-\r]+", re.sub(r"[\x00-\x08\x0e-\x1f]|[!-/:-@\[-`{-~]", "", text)) if w]


def brute_contained(texts, items, k=5, least=0.8):
    out = {}
    for d, text in texts:
        w = fold(text)
        for i, item in items:
            x = fold(item)
            n = min(k, len(x))
            if n and i is not None:
                s = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
                m = len(s & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
                if m >= 0.8 * len(s) - 1e-9:
                    out[d, i] = (m, len(s))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(1, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "Two words."), (None, prose(rng, 20)), (93, "same same same same same same same")]
    texts = [(i, prose(rng, 80)) for i in range(40)]
    for n, (i, t) in enumerate(items[:30]):
        w = t.split()
        for j in range(n % 4):
            w[rng.randrange(len(w))] = "zz"
        texts.append((100 + n, prose(rng, 500) + " " + " ".join(w).upper() + "! " + prose(rng, 50)))
    texts += [(200, None), (201, ""), (202, "two, words"), (203, "same " * 20_000), (203, "same " * 9)]
    got = {}
    for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), block_shingles=block).collect():
        got[r["doc_id"], r["item_id"]] = (r["n_shared"], r["n_shingles"])
    want = brute_contained(texts, items)
    assert got == want and 15 < len(want)
    kept = decontaminate.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in texts if d not in {d for d, _ in want}) and kept.columns == docs(spark, []).columns
    texts += [(300, prose(rng, 30)), (300, items[20][1])]
    kept = decontaminate.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block)
    assert [r["text"] for r in kept.where("doc_id = 300").collect()] == [texts[-2][1]]
    assert decontaminate.contaminated(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---- 5 SimHash


def brute_fp(text, k=3):
    xxhash = pytest.importorskip("xxhash")
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if x]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_golay_tables_cover_every_vector():
    unit, table = near_dedup.golay_tables()
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 400)
    words = np.arange(1 << 12, dtype=np.int64) << 11
    syndrome = sum(((words >> i) & 1) * 0 for i in range(23))
    for i in range(23):
        syndrome = syndrome ^ (((words >> i) & 1) * unit[i])
    code = words ^ syndrome  # the codeword with those twelve bits
    d = np.bitwise_count(v[:, None] ^ code[None, :])
    got = near_dedup.golay_indices(v)
    assert (np.take_along_axis(d, got[:, :1], 1)[:, 0] == d.min(1)).all() and d.min(1).max() <= 3
    assert all(set(got[i]) == set(np.flatnonzero(d[i] <= 4)) for i in range(len(v)))


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for n in range(1, 6):
            for _ in range(6):
                y = x
                for b in rng.sample(range(64), n):
                    y ^= 1 << b
                fps.add(y)
    fps |= {(0b111) << s for s in range(0, 60, 7)}
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in near_dedup.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == want and len(want) > 1000


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = list(EDGES)
    for i in range(40):
        w = prose(rng, 300).split()
        for j in range(rng.randrange(4)):
            x = list(w)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = "changed"
            rows.append((1000 - 10 * i - j, " ".join(x)))
    fps = [brute_fp(t) for _, t in rows]
    root = brute_components([(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(low.get(root[i], d), d)
    want = sorted((str(d), f"{fps[i]:016x}", str(low.get(root[i]))) for i, (d, _) in enumerate(rows))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in near_dedup.near_dedup(docs(spark, rows)).collect()) == want
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_fingerprint_joins_build_nothing_in_the_driver(spark):
    """A broadcast is collected in the driver's heap; these tables have a row for a fingerprint."""
    rows = docs(spark, [(i, f"some words of text number {i % 7}") for i in range(50)])
    fps = near_dedup.cut(near_dedup.simhash(rows).select("fp").distinct())
    for out in (near_dedup.near_dedup(rows), near_dedup.links(fps), graph._star(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), True)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def similarity(a, b, k=5):
    x, y = ([w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in (a, b))
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_against_all_pairs(spark):
    """The stage's links against the exact similarity of all pairs: none below 0.8, recall 0.9 at least above it."""
    rng = random.Random(31)
    rows = list(EDGES) + [(20, "Same Words here"), (21, "same words HERE"), (22, "two words")]
    for i in range(150):
        w = prose(rng, rng.randrange(40, 300)).split()
        x = [("new" + str(rng.random()) if rng.random() < (0.004, 0.01, 0.02, 0.03)[i % 4] else t) for t in w]
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(x))]
    kept = near_dedup.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    left = {r["doc_id"] for r in kept.collect()}
    near = [i for i in range(150) if similarity(rows[-300 + 2 * i][1], rows[-299 + 2 * i][1]) >= 0.8]
    gone = {i for i in range(150) if 1001 + 2 * i not in left}
    assert gone <= set(near) and len(gone) >= 0.9 * len(near) > 60 and all(1000 + 2 * i in left for i in range(150))
    # 1, 2 and 3 have no words, 5 is there twice, 9 has its word; 20 and 21 differ by case alone.
    assert left & set(range(30)) == {1, 5, 6, 7, 8, 10, 20, 22} and None in left and kept.where("doc_id = 5").count() == 1
    same_id = docs(spark, [(1, rows[-1][1]), (5, rows[-1][1]), (5, prose(rng, 80)), (None, prose(rng, 70))])
    assert sorted((r["doc_id"] or 0, len(r["text"].split()) == 80) for r in near_dedup.drop_near_copies(same_id).collect()) == [(0, False), (1, False), (5, True)]
    base = prose(rng, 150).split()
    group = [(i, " ".join(t if i == 40 or rng.random() >= 0.01 else "x" + str(rng.random()) for t in base)) for i in range(80)]
    assert near_dedup.drop_near_copies(docs(spark, group)).count() <= 4
    assert near_dedup.drop_near_copies(docs(spark, [])).count() == 0


# ---- 6 substring dedup


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(5000)]
    make = lambda n: prose(rng, n, vocabulary)
    rows, planted = [], {}
    for i in range(40):
        passage = make(rng.randrange(60, 120))
        planted[i] = passage
        for j in range(3):
            rows.append((i * 10 + j, make(rng.randrange(0, 200)) + " " + (passage.upper() if j == 1 else passage.replace(" ", "\n")) + " " + make(rng.randrange(0, 200))))
    clean = [(5000 + i, make(300)) for i in range(40)]
    short = make(12)
    boiler = [(6000 + i, make(100) + " " + short + " " + make(100)) for i in range(20)]
    edge = [(7000, None), (7001, ""), (7002, "few words"), (None, planted[0]), (7003, "x" * 20_000)]
    got = substring_dedup.repeated_passages(docs(spark, rows + clean + boiler + edge)).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    texts = dict(rows)
    for r in got:
        i = r["doc_id"] // 10
        assert r["component_id"] == i * 10 and not (r["removed"] and r["doc_id"] == i * 10)
        span = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert r["kind"] == "paragraph" or " ".join(span.lower().split()) in planted[i]
    assert {r["doc_id"] for r in got if r["removed"]} == {d for d, _ in rows if d % 10}
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0
    twice = substring_dedup.repeated_passages(docs(spark, rows[:3] + rows[:3])).collect()
    assert {r["doc_id"] for r in twice} == {0, 1, 2}


def test_passages_of_50_to_59_words_are_found_whole(spark):
    rng = random.Random(66)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(200_000)]
    make = lambda n: prose(rng, n, vocabulary)
    rows, where = [], {}
    for i in range(300):
        passage = make(50 + i % 10)
        for j in range(2):
            head = make(rng.randrange(1, 80))
            rows.append((i * 10 + j, f"{head} {passage} {make(rng.randrange(1, 80))}"))
            where[i * 10 + j] = (len(head) + 1, len(head) + 1 + len(passage), 50 + i % 10, j == 1)
    got = substring_dedup.repeated_passages(docs(spark, rows)).where("kind = 'run'").collect()
    assert {r["doc_id"]: (r["start"], r["end"], r["n_words"], r["removed"]) for r in got} == where and len(got) == len(where)
    # Two later texts have more in common than the first has with them: what only they share goes once and stays once.
    a, b, c = make(12), make(60), make(12)
    got = substring_dedup.repeated_passages(docs(spark, [(1, f"{make(30)} {b} {make(30)}"), (2, f"{make(30)} {a} {b} {c} {make(30)}"), (3, f"{make(30)} {a} {b} {c} {make(30)}")])).where("kind = 'run'").collect()
    covered = {d: sum(r["n_words"] for r in got if r["doc_id"] == d and r["removed"]) for d in (1, 2, 3)}
    assert covered[1] == 0 and 60 <= covered[2] < 84 <= covered[3] and 1 <= len([r for r in got if r["doc_id"] == 2 and not r["removed"]]) <= 2


def brute_similarity(a, b):
    """Jaccard similarity of five-word shingles, and similarity by word edit distance, both by their definitions."""
    a, b = ([w for w in re.split(r"\s+", re.sub(r"[!-/:-@\[-`{-~]", "", t.lower())) if w] for t in (a, b))
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        last, row = row, [i]
        for j, v in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (u != v)))
    return len(x & y) / max(1, len(x | y)), 1 - row[-1] / max(len(a), len(b), 1)


def test_changed_paragraphs_against_all_pairs(spark):
    """Recall of pairs of whole texts at a Jaccard or edit similarity of 0.8, and nothing below it."""
    rng = random.Random(60)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(50_000)]
    make = lambda n: prose(rng, n, vocabulary).split()

    def changed(words, every):
        return [make(1)[0] if i % every == every // 2 else w for i, w in enumerate(words)]

    rows, n = [], 0
    for size, every in [(24, 1000), (24, 30), (120, 30), (120, 12), (120, 4), (60, 60), (300, 45)]:
        for _ in range(30):
            words = make(size)
            rows += [(n, words), (n + 1, changed(words, every))]
            n += 2
    rows = [(d, " ".join(w)) for d, w in rows]
    got = substring_dedup.repeated_passages(docs(spark, rows), min_words=20, edits=True).collect()
    named = {}
    for r in got:
        named.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert all(c <= {d - d % 2} for d, c in named.items())
    pairs = {d: max(brute_similarity(rows[d][1], rows[d + 1][1])) for d in range(0, len(rows), 2)}
    for low, high in ((0, 60), (60, 120), (120, 180), (180, 240), (300, 360), (360, 420)):
        of = [d for d in range(low, high, 2) if pairs[d] >= 0.8]
        assert of and sum(d in named and d + 1 in named for d in of) >= 0.9 * len(of), (low, len(of))
    assert not named.keys() & set(range(240, 300))
    # By shingles alone, no pair below 0.8 is linked as a paragraph; texts that are the same are runs and no paragraphs.
    plain = {r["doc_id"] - r["doc_id"] % 2 for r in substring_dedup.repeated_passages(docs(spark, rows), min_words=20).where("kind = 'paragraph'").collect()}
    assert plain == {d for d in pairs if rows[d][1] != rows[d + 1][1] and brute_similarity(rows[d][1], rows[d + 1][1])[0] >= 0.8}
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        assert substring_dedup.edit_distance(a, b) == round((1 - brute_similarity(" ".join(a), " ".join(b))[1]) * max(len(a), len(b), 1))


def test_repeated_ids_are_one_document_and_hubs_link_large_groups(spark):
    rng = random.Random(61)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(50_000)]
    make = lambda n: prose(rng, n, vocabulary)
    a, b = make(80), make(80)
    got = substring_dedup.repeated_passages(docs(spark, [(1, a), (1, f"{a} {b}"), (1, a), (2, make(90)), (3, f"{make(5)} {b}")])).collect()
    assert {(r["doc_id"], r["removed"]) for r in got} == {(1, False), (3, True)}


def group_of_changed_copies(rng, n, size=100, share=0.02):
    """n copies of a text with some words changed, and their components by all pairs at a Jaccard similarity of 0.8."""
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(7))
    base = [word() for _ in range(size)]
    rows = [(i, [word() if rng.random() < share else w for w in base]) for i in range(n)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in rows]
    alike = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return [(i, " ".join(w)) for i, w in rows], brute_components(alike)


@pytest.mark.parametrize("n", [60, 600])
def test_changed_copies_have_the_components_of_all_pairs(spark, n):
    rows, want = group_of_changed_copies(random.Random(n), n)
    got = {r["doc_id"]: r["component_id"] for r in substring_dedup.repeated_passages(docs(spark, rows)).where("kind = 'paragraph'").collect()}
    lost = [d for d, c in want.items() if got.get(d) != c]
    assert len(want) > n / 2 and not got.keys() - want.keys() and len(lost) <= 0.01 * len(want), len(lost)


def test_near_copies_are_found_where_buckets_hold_many_other_texts(spark):
    """Recall by all pairs, with keys so few that each bucket holds several texts that have nothing in common."""
    rng = random.Random(77)
    rows, want = group_of_changed_copies(rng, 150)
    left = {r["doc_id"] for r in near_dedup.drop_near_copies(docs(spark, rows)).collect()}
    gone = {d for d, c in want.items() if d != c}
    assert not set(range(150)) - left - gone and len(gone - left) >= 0.97 * len(gone) > 50

    parts = [(i, [rng.randrange(40) for _ in range(6)]) for i in range(3000)]
    near = [(10_000 + i, [x if j % 6 in (a, b, c) else rng.randrange(40) for j, x in enumerate(p)]) for i, (_, p) in enumerate(parts[:400]) for a, b, c in [rng.sample(range(6), 3)]]
    table = spark.createDataFrame(parts + near, "content long, parts array<long>")
    members = graph.shared_keys(table.select("content", F.explode(graph.combined("parts", 6, 2)).alias("x")).select("x.key", "x.last", "content"))
    none = spark.createDataFrame([], "a long, b long")
    for most in (4096, 2):  # the buckets hold about two texts by chance; of a most of 2, many are split
        agree = lambda x, y: sum((x["parts"][i] == y["parts"][i]).cast("int") for i in range(6)) >= 2
        got = {(r["a"], r["b"]) for r in graph.open_pairs(members, table.withColumn("sketch", F.lit(0)), none, 6, agree, most).collect()}
        assert sum((i, 10_000 + i) in got for i in range(400)) >= (400 if most == 4096 else 320)


@pytest.mark.parametrize("most", [4096, 16])
def test_pairs_of_large_buckets_are_all_of_them(spark, most):
    """Values so few that every bucket holds many texts: whatever the size of a block, the pairs are those of brute force."""
    rng = random.Random(78)
    parts = {i: [rng.randrange(3) for _ in range(6)] for i in range(200)}
    linked = [(i, i + 1) for i in range(0, 40, 2)] + [(i, 150) for i in range(100, 150)]
    root = brute_components(linked)
    agree = lambda p, q: sum(u == v for u, v in zip(p, q))
    want = sorted((i, j) for i in parts for j in parts if i < j and agree(parts[i], parts[j]) >= 4 and root.get(i, i) != root.get(j, j))
    table = spark.createDataFrame(list(parts.items()), "content long, parts array<long>").withColumn("sketch", F.lit(0))
    members = graph.shared_keys(table.select("content", F.explode(graph.combined("parts", 6, 2)).alias("x")).select("x.key", "x.last", "content"))
    near = lambda x, y: sum((x["parts"][i] == y["parts"][i]).cast("int") for i in range(6)) >= 4
    got = graph.open_pairs(members, table, spark.createDataFrame(linked, "a long, b long"), 6, near, most)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 1000


def test_near_stage_loses_no_pair_at_its_threshold(spark):
    """Pairs a little above a Jaccard similarity of 0.8, of which one in ten shares no key, with a line that all texts begin with."""
    rng = random.Random(80)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(7))
    line, rows = [word() for _ in range(20)], []
    for i in range(250):
        w = line + [word() for _ in range(80)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(word() if j in (40, 70) else t for j, t in enumerate(w)))]
    assert all(0.8 <= similarity(rows[i][1], rows[i + 1][1]) < 0.82 for i in range(0, 500, 2))
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(docs(spark, rows)).collect()) == list(range(0, 500, 2))


def test_hub_rows_are_bounded_for_each_content(spark):
    """Copies that share 91 buckets make at most 16 rows each for their hubs, and these connect them."""
    members = spark.range(91).select(F.col("id").alias("key")).crossJoin(spark.range(300).select(F.col("id").alias("content"))).withColumn("n", F.lit(300))
    pairs = graph.hub_pairs(members)
    assert spark.read.parquet(shared._tables[-1]).count() == 16 * 300
    assert pairs.count() == 299 and graph.components(pairs).count() == 300


def test_first_shingles_meet_in_any_order():
    rng = np.random.default_rng(81)
    for least in (0.5, 0.8, 0.9):
        for _ in range(200):
            own = rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64)
            other = np.concatenate((own[rng.random(len(own)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)))
            often = np.sort(rng.choice(own, len(own) // 2, replace=False))
            ends, first = near_dedup.rarest(np.concatenate((own, other)), np.repeat([0, 1], [len(own), len(other)]), 2, least, often, rng.integers(1, 9, len(often)))
            same = len(set(own.tolist()) & set(other.tolist()))
            if same >= least * len(set(own.tolist()) | set(other.tolist())):
                assert set(first[: ends[0]].tolist()) & set(first[ends[0] :].tolist())


def test_odd_sketches_leave_out_no_similar_pair(spark):
    rng = np.random.default_rng(79)
    h, owner, sets = [], [], []
    for i in range(60):
        own = rng.integers(0, 1 << 63, int(rng.integers(20, 400)), dtype=np.uint64)
        for share in (0, 0.05, 0.09, 0.12, 0.3):
            some = np.where(rng.random(len(own)) < share, rng.integers(0, 1 << 63, len(own), dtype=np.uint64), own)
            some = np.concatenate((some, some[:9]))  # repeats count once
            h.append(some)
            owner.append(np.full(len(some), len(sets)))
            sets.append(set(some.tolist()))
    rows = graph.odd_sketches(np.concatenate(h), np.concatenate(owner), len(sets)).tolist()
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, odd array<long>").select("i", F.struct(*graph.odd_fields("odd")).alias("x"))
    met = table.join(table.select(F.col("i").alias("j"), F.col("x").alias("y")), F.expr("i < j")).where(graph.within(F.col("x"), F.col("y"), 0.8))
    got = {(r["i"], r["j"]) for r in met.select("i", "j").collect()}
    wide = graph.odd_sketches(np.concatenate(h), np.concatenate(owner), len(sets), 64).tolist()
    wide = spark.createDataFrame([(i, r if i % 7 else None) for i, r in enumerate(wide)], "i int, x array<long>")
    met = wide.join(wide.select(F.col("i").alias("j"), F.col("x").alias("y")), F.expr("i < j")).where(graph.within_wide(F.col("x"), F.col("y"), 0.8))
    by_wide = {(r["i"], r["j"]) for r in met.select("i", "j").collect()}
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert by_wide >= {(i, j) for i in range(300) for j in range(i + 1, 300) if similar(i, j) >= 0.8 or not i % 7 or not j % 7}
    assert not [(i, j) for i, j in by_wide if i % 7 and j % 7 and similar(i, j) < 0.7]
    assert got >= {(i, j) for i in range(300) for j in range(i + 1, 300) if similar(i, j) >= 0.8}
    assert len(got) < 600 and not [p for p in got if similar(*p) < 0.5]


def test_stored_tables_and_checkpoints_leave_no_shuffle_files(spark):
    """Else a chain of many tables keeps the files of all its shuffles to its end; the session's setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, was = files(), spark.conf.get(name, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert shared.stored(counts).count() == shared.cut(counts).count() == 7 and spark.conf.get(name, None) == was
    plain = files()
    counts = spark.range(1000).groupBy((F.col("id") % 5).alias("k")).agg(F.max("id").alias("m"))
    shared.stored(counts)
    shared.cut(counts)
    for _ in range(40):  # files go a moment after the action
        if not (left := files() - before - plain):
            break
        time.sleep(0.25)
    assert not left


def test_repeated_rows_and_clashing_names_in_the_stages(spark):
    schema = "doc_id long, text string, __own_1 string, __own_2 int, tags map<string,string>"
    rows = [(1, "a b c", "z", 2, {"k": "v"}), (1, "a b c", "b", 1, {}), (1, "a b c", "b", 3, None), (2, "other words here", None, None, None), (None, "a b c", "a", 0, None)]
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        for order in (rows, rows[::-1]):
            got = sorted((r["doc_id"], r["__own_1"], r["__own_2"]) for r in stage(spark.createDataFrame(order, schema)).collect())
            assert got == [(1, "b", 1), (2, None, None)]


@pytest.mark.parametrize("spread", [1, 2, 23])
def test_boundaries_are_window_minima(spread):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    row = np.repeat(np.arange(5), [10, 200, 22, 23, 245])
    want = {i + int(h[i : i + spread].argmin()) for i in range(500 - spread + 1) if row[i] == row[i + spread - 1]}
    assert substring_dedup.boundaries(h, row, spread).tolist() == sorted(want)


# ---- 7 language


def brute_likelihood(word, table):
    """Forward sums in logarithms, letter by letter."""
    word = language.MARK + word
    hashes, numbers, longest = language.vocabulary(PIECES)
    known = dict(zip(hashes.tolist(), numbers.tolist()))
    alpha = [np.zeros(table.shape[1])]
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(max(0, j - longest), j):
            at = known.get(language._hash(word[i:j]))
            if at is not None:
                ways.append(alpha[i] + np.log(table[at]))
            elif j - i == 1:
                ways.append(alpha[i] + np.log(language.UNKNOWN))
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_forward_sums_all_segmentations():
    size = len(language.vocabulary(PIECES)[0])
    table = np.random.default_rng(0).random((size + 1, 3)) * 1e-3
    table[size] = 0
    words = ["the", "nation", "straße", "日本", "q", "internationalization"]
    for w in words:
        got = language.forward(PIECES, language.matrix([w]), table)[0]
        assert np.allclose(got, brute_likelihood(w, table))
    long = "nation" * 300 + "straße" * 5
    for step in (1, 7, 64, 4096):
        assert np.allclose(language.forward(PIECES, language.matrix([long]), table, step)[0], brute_likelihood(long, table))
    counted = language.expected(PIECES, language.matrix(["nation"]), np.array([2.0]), table[:, :1])
    assert 2 <= counted.sum() <= 14


def test_language_id(spark):
    rng = random.Random(7)
    kinds = {"en": ["the", "house", "running", "with", "nation", "thing"], "de": ["der", "haus", "laufend", "mit", "straße", "ding"], "es": ["el", "casa", "corriendo", "con", "nación", "cosa"]}
    rows = [(i, prose(rng, 30, kinds[x]), x) for i in range(120) for x in [("en", "de", "es")[i % 3]]]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "es"), (503, "das haus mit der straße", None), (None, "the house", "en"), (504, "der " * 20_000, "de"), (505, "z" * 5000, "en")]
    got = {r["doc_id"]: r for r in language.language_id(docs(spark, rows), PIECES).collect()}
    assert all(got[d]["lang_pred"] == x for d, _, x in rows[:120])
    assert [got[d]["lang_pred"] for d in (500, 501, 502)] == ["und"] * 3 and got[500]["score"] == 0.0
    assert got[503]["lang_pred"] == "de" and got[504]["lang_pred"] == "de" and 0 <= got[505]["score"] <= 1 and None in got
    kept = language.keep_identified(docs(spark, rows), PIECES)
    assert kept.columns == docs(spark, []).columns and {500, 501, 502}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language.language_id(docs(spark, []), PIECES).count() == 0
    unlabelled = language.language_id(docs(spark, [(1, "the house")]), PIECES).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)


def test_long_documents_teach_and_repeated_ids_teach_once(spark):
    rng = random.Random(77)
    kinds = {"en": ["the", "house", "running", "with", "nation", "thing"], "de": ["der", "haus", "laufend", "mit", "straße", "ding"]}
    rows = [(i, prose(rng, 30, kinds["en"]), "en") for i in range(40)] + [(100 + i, prose(rng, 2000, kinds["de"]), "de") for i in range(20)]
    assert min(len(t) for _, t, x in rows if x == "de") > 6000
    languages, _ = language.fit(docs(spark, rows), PIECES)
    assert languages == ["de", "en"]
    # A repeated row changes nothing, however often it is repeated.
    once, many = (language.fit(docs(spark, rows + rows[:1] * n), PIECES, per_language=10) for n in (0, 500))
    assert once[0] == many[0] and np.array_equal(once[1], many[1])


def test_posteriors_equal_brute_force(spark):
    """The query's language and score against posteriors computed word by word from the fitted table."""
    rng = random.Random(70)
    kinds = {"en": ["the", "house", "running", "nation"], "de": ["der", "haus", "laufend", "nation"], "fr": ["le", "maison", "courant", "nation"]}
    rows = [(i, prose(rng, 12, kinds[x]), x) for i in range(60) for x in [("en", "de", "fr")[i % 3]]]
    rows += [(600, "nation nation", None), (601, "haus the", None), (602, "maison" * 40, None)]
    table = docs(spark, rows)
    languages, model = language.fit(table.where(shared.crc_part("doc_id", 4) != 2), PIECES)
    assert languages == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language.language_id(table, PIECES).collect()}
    for d, text, _ in rows:
        total = sum(brute_likelihood(w, model) for w in re.findall(r"[^\W\d_]+", text.lower()))
        post = np.exp(total - np.logaddexp.reduce(total))
        assert got[d]["lang_pred"] == languages[int(total.argmax())] and abs(got[d]["score"] - post.max()) < 1e-9
    few, _ = language.fit(docs(spark, [*rows, *((900 + i, "der haus", f"x{i}") for i in range(9))]), PIECES, languages=3)
    assert few == ["de", "en", "fr"]


# ---- 8 token counts


def test_token_counts(spark, reference_encoder):
    texts = ["one two\nthree\n\n\nfour", "", None, "\n\n", "日本\n語😀x", "a  \n  b\n", "no line end", "x" * 20_000 + "\n" + "y z " * 5000]
    got = {}
    for r in token_counts.section_token_counts(docs(spark, list(enumerate(texts))), RANKS, P.PATTERN).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for d, text in enumerate(texts):
        text = text or ""
        bounds = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        bounds = bounds[:-1] if len(bounds) > 1 and bounds[-1] == len(text) else bounds
        spans = list(zip(bounds, [*bounds[1:], len(text)]))
        counts, at, data = [0] * len(spans), 0, text.encode()
        for token in reference_encoder.encode_ordinary(text):
            n = len(reference_encoder.decode_single_token_bytes(token))
            first = len(data[:at].decode("utf-8", "ignore")) if data[:at].decode("utf-8", "ignore").encode() == data[:at] else len(data[:at].decode("utf-8", "ignore"))
            last = len(data[: at + n].decode("utf-8", "ignore"))
            last += data[: at + n].decode("utf-8", "ignore").encode() != data[: at + n]
            shares = [min(last, e) - max(first, s) for s, e in spans]
            counts[shares.index(max(shares))] += 1
            at += n
        rows = [got[d][i] for i in range(len(spans))]
        assert [r["n_tokens"] for r in rows] == counts and [(r["start"], r["end"]) for r in rows] == spans
        assert all(r["doc_tokens"] == sum(counts) for r in rows)
    assert token_counts.section_token_counts(docs(spark, []), RANKS, P.PATTERN).count() == 0


# ---- 9 toxicity


def test_deobfuscation_and_scores(spark):
    rng = random.Random(9)
    words = ["house", "garden", "little", "water", "people", "morning", "seven", "letter", "coffee", "summer"]
    bad = ["idiot", "moron", "stupid"]
    hide = {"idiot": ["1d10t", "id!ot", "i d i o t", "idiiiot", "i.d.i.o.t", "!d10t", "id iot", "a i d i o t"], "moron": ["m0r0n", "m o r o n", "mooooron", "mo ron", "moron$$$"], "stupid": ["$tup1d", "stup!d", "s-t-u-p-i-d", "s t u p i d a"]}
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 30, words).split()
        toxic = i % 3 == 0
        if toxic:
            x = rng.choice(bad)
            w[rng.randrange(30)] = rng.choice([x, x.upper() + "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    hidden = [(1000 + i, f"{prose(rng, 12, words)} {x} {prose(rng, 12, words)}") for i, x in enumerate(x for xs in hide.values() for x in xs)]
    rest = [(2000, None), (2001, ""), (None, "you idiot"), (2002, "calm 12:30 on 2020-01-01, e-mail a.b@c.de"), (2003, "a " * 20_000), (2004, "ha" * 10_000)]
    table, marks = docs(spark, rows + hidden + rest), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, marks).collect()}
    assert len(got) == len(rows) + len(hidden) + len(rest)
    wrong = [d for d, _, t in labels if got[d]["predicted"] != t]
    assert not wrong and all(got[d]["predicted"] == 1 for d, _ in hidden), [x for x in hidden if got[x[0]]["predicted"] != 1]
    assert got[2000]["predicted"] == got[2001]["predicted"] == got[2002]["predicted"] == 0 and got[None]["predicted"] == 1
    assert toxicity.toxicity(docs(spark, []), marks).count() == 0
    assert {r["score"] for r in toxicity.toxicity(table, marks.limit(0)).collect()} <= {toxicity.toxicity(table, marks.limit(0)).first()["score"]}


def test_restore_is_the_best_of_all_paths():
    """Viterbi against every path through the lattice, scored in full."""
    import itertools

    rng = np.random.default_rng(90)
    model = toxicity.log_model(rng.integers(0, 50, (28, 28, 28)).astype(float))
    channel = toxicity.Channel(model)
    for token, gaps in [("1d10t", False), ("m00r0n", False), ("@$$", False), ("a i d t", True), ("i.d.1.t", True), ("heyyyy", False), ("7|2@", False), ("é1x", False)]:
        best = max(itertools.product(*toxicity.lattice(token, gaps)), key=lambda path: sum(c for _, c in path) + channel.likelihood("".join(t for t, _ in path)))
        assert channel.restore(token, gaps) == "".join(t for t, _ in best), token
    assert channel.readings("455") == () and channel.readings("(12:30)") == () and channel.readings("house") == ("house",) and channel.readings("house!") == ("house",)
    assert len(channel.readings("(lown")) == 2 and channel.readings("@$$")


# ---- 10 exact dedup


@pytest.mark.parametrize("size", [4096, 7])
def test_exact_dedup_equals_brute_force(spark, size):
    rng = random.Random(10)
    rows = list(EDGES)
    for i in range(60):
        t = prose(rng, rng.randrange(1, 30))
        rows += [(100 + 3 * i, t), (101 + 3 * i, t.replace(" ", "  \n")), (102 + 3 * i, t + "x" * (i % 2))]
    groups = {}
    for n, (d, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), d if d is not None else 1 << 62, n))
    want = []
    for key, members in groups.items():
        _, keep, stays = min(members)
        for _, d, n in members:
            want.append((d if d < 1 << 62 else None, keep if keep < 1 << 62 else None, len(members), hashlib.sha256(key.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs(spark, rows), size).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.drop_copies(docs(spark, rows), size)
    assert kept.count() == len(groups) and kept.columns == docs(spark, []).columns
    assert exact_dedup.exact_dedup(docs(spark, []), size).count() == 0 and exact_dedup.drop_copies(docs(spark, []), size).count() == 0


def test_exact_dedup_by_blocks_where_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_keys", lambda block: ((F.length(block) % 3).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    rows = [(1, "aaaa bbbb"), (2, "aaaab bbb"), (3, "ccccdddd"), (4, "aaaa"), (5, "bbbb"), (6, "aaaabbbc")]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs(spark, rows), 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n if n else None for n in (0, 5, 50, 3, 0, 7)])
    got = list(shared.slices(texts, 10))
    assert got[0][0] == 0 and got[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and list(shared.slices(texts.slice(0, 0))) == []
