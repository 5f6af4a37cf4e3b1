"""Queries and DuckDB SQL of the corpus operators, for the driver."""

from __future__ import annotations

import public_tokenizers

from strandline.llm.bpe import digests
from strandline.llm.decontaminate import contaminated
from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.hard_negatives import hard_negatives
from strandline.llm.language import language_id
from strandline.llm.near_dedup import near_dedup
from strandline.llm.pii import pseudonymise
from strandline.llm.piece_bpe import digests as piece_digests
from strandline.llm.substring_dedup import repeated_passages
from strandline.llm.token_counts import section_token_counts
from strandline.llm.toxicity import toxicity
from strandline.llm.url_filter import judge
from strandline.llm.vector_codes import ROUNDS, vector_codes

BPE, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A stand-in: a deployment passes its own secret.
PII_KEY = "demonstration key"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark, sf_dir):
    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), public_tokenizers.PATTERN)


def op2_url_filter(spark, sf_dir):
    return judge(_table(spark, sf_dir, "pages"))


def op3_pii_pseudonyms(spark, sf_dir):
    return pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def op4_decontaminate(spark, sf_dir):
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark, sf_dir):
    return near_dedup(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language_id(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_token_counts(spark, sf_dir):
    return section_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), public_tokenizers.PATTERN)


def op9_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark, sf_dir):
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_url_filter, op3_pii_pseudonyms, op4_decontaminate, op5_simhash_near_dedup, op6_substring_dedup, op7_language_id,
        op8_token_counts, op9_toxicity, op10_exact_dedup, op11_piece_bpe, op12_hard_negatives, op13_vector_codes, pipeline,
    )
}

FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex(regexp_replace(" + FOLDED.format("coalesce(text, '')") + r", '[\x00-\x08\x0e-\x1f!-/:-@\[-`{-~]', '', 'g'), '[\x09-\x0D ]+'), lambda x: x <> '')"

FINITE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"


def _codebook_sql(rounds: int) -> str:
    """The rounds one after another: c<i> is a round's codebook, b<i> each part's nearest entry in it."""
    nearest = """b{i} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT rid, p.part, entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, c.x)]) AS d FROM p JOIN c{i} c ON c.part = p.part) GROUP BY rid, part)"""
    moved = """c{j} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
            SELECT part, entry, list(v ORDER BY place) AS x FROM (SELECT b.part, b.entry, place, floor(sum(p.x[place])::DOUBLE / count(*))::BIGINT AS v
                FROM b{i} b JOIN p ON p.rid = b.rid AND p.part = b.part, generate_series(1, 8) s(place) GROUP BY ALL) GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""
    steps = [nearest.format(i=0)]
    for i in range(rounds):
        steps += [moved.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE {FINITE}),
        p AS MATERIALIZED (SELECT rid, part, v[part * 8 + 1 : part * 8 + 8] AS x FROM k, range(8) r(part)),
        c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 16),
        {", ".join(steps)},
        r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM b{rounds} GROUP BY rid),
        h AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry)) AS s FROM (SELECT part, entry, array_to_string(x, ',') AS y FROM c{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM r JOIN k USING (rid), h
    """


SQL = {
    # Rules only: the pages of these tables have no canonical link or refresh, so without a rule the verdict is allow.
    "op2_url_filter": rf"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, {FOLDED.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        v AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM v
    """,
    "op4_decontaminate": rf"""
        WITH i AS (SELECT item_id, {WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        iw AS (SELECT item_id, least(5, len(w)) AS k, w FROM i WHERE item_id IS NOT NULL AND len(w) > 0),
        s AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM iw)),
        n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
        e AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
        m AS (SELECT doc_id, item_id, count(*) AS c FROM e JOIN s USING (k, x) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, c AS n_shared, n AS n_shingles, c / n AS containment FROM m JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY s) AS g
              FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, g AS group_size, kept, s AS text_sha256, n AS n_points FROM k
    """,
    "op12_hard_negatives": f"""
        WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS rid, [floor(256 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}),
        s AS MATERIALIZED (SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label AS own, r.rid, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score FROM k a, k r WHERE a.vec_id % 100 = 0),
        p AS (SELECT aid, anchor_id, own, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS n FROM s WHERE label = own AND rid <> aid QUALIFY n <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY aid, n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (aid) WHERE s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
    """,
    "op13_vector_codes": _codebook_sql(ROUNDS),
}
