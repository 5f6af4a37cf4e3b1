"""Column functions over gene and record names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Qualifiers by how much they say about a gene's name.
STRONG_FIELDS, WEAK_FIELDS = ("gene", "label", "standard_name"), ("product", "note", "locus_tag")
#: Qualifiers in the order in which a name is looked up.
QUALIFIERS = ("gene", "product", "label", "standard_name", "locus_tag", "note")
SENTINEL = "__excluded__"
AMBIGUOUS = "__ambiguous__"

#: Names that no single gene can bear.
GENERIC_NAMES = (
    "gene", "protein", "viral protein", "unknown", "unknown protein", "hypothetical protein", "putative protein", "open reading frame",
    "orf", "polyprotein", "structural protein", "structural membrane protein", "non-structural protein", "nonstructural protein",
    "proteinase", "cysteine/serine protease", "cysteine serine protease",
)
#: Descriptive words that deserve a look.
DESCRIPTIVE_TERMS = (
    "polymerase", "protease", "helicase", "nucleocapsid", "capsid", "matrix", "envelope", "glycoprotein", "membrane", "replicase",
    "attachment", "polyprotein", "structural", "nonstructural",
)
#: Descriptive names and the short symbol each stands for.
DESCRIPTIVE_SYMBOLS = {"envelope protein": "E", "membrane protein": "M", "nucleocapsid protein": "N", "spike protein": "S", "spike glycoprotein": "S"}

#: Words that may follow a canonical.
PLAIN_ENDINGS = ("protein", "polyprotein", "gene", "cds")


def _norm(text: str) -> str:
    return text.strip().lower().replace("-", "").replace("_", "").replace(" ", "")


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm(x: Column) -> Column:
    """Strip, lower, and delete hyphens, underscores and spaces; null gives ''."""
    return F.coalesce(F.translate(F.lower(stripped(x)), "-_ ", ""), F.lit(""))


def filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def display_name(kind: Column, ordinal: Column, *values: Column) -> Column:
    """The first value that isn't empty, else type_NNN."""
    return F.coalesce(*(filled(v) for v in values), F.format_string("%s_%03d", kind, ordinal))


def search_text(*values: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(filled(v) for v in values)))


def slug(x: Column, default: str = "unnamed") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(stripped(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(filled(out), F.lit(default))


def parts(x: Column, pattern: str = ";") -> Column:
    """Trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), pattern), stripped), lambda p: p != "")


def first_wins(values: Column) -> Column:
    """Values with distinct, non-empty normal forms, the first of each, in order."""
    def add(kept, v):
        known = F.exists(kept, lambda k: norm(k) == norm(v)) | (norm(v) == "")
        return F.when(known, kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(values, F.array().cast("array<string>"), add)


def compound_parts(x: Column) -> Column:
    """The parts of a compound name where it has more than one, else the name; distinct by normal form."""
    split = parts(x)
    return first_wins(F.when(F.size(split) > 1, split).otherwise(F.array(stripped(F.coalesce(x, F.lit(""))))))


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def contains_canonical(raw: Column, canonical: Column) -> Column:
    """Longer canonicals may stand anywhere in the name; one of a single character must be a token by itself."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.lower(t))
    c = norm(canonical)
    return (F.length(c) > 1) & F.contains(norm(raw), c) | (F.length(c) == 1) & F.array_contains(tokens, c)


def short_symbol(raw: Column, canonical: Column) -> Column:
    """The last group of digits in some token of the name is the last one in the canonical."""
    r, c = F.lower(stripped(F.coalesce(raw, F.lit("")))), F.lower(stripped(F.coalesce(canonical, F.lit(""))))
    last = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit("[0-9]+[a-z]*"), F.lit(0)), F.lit(-1))
    tokens = F.concat(F.regexp_extract_all(r, F.lit("[a-z]+[0-9]+[a-z]*"), F.lit(0)), F.when(F.length(r) <= 12, F.array(r)).otherwise(F.array().cast("array<string>")))
    return r.rlike("[0-9]") & last(c).isNotNull() & F.exists(tokens, lambda t: F.coalesce(last(t) == last(c), F.lit(False)))


def descriptive_symbol(raw: Column, canonical: Column) -> Column:
    out = F.lit(False)
    for name, symbol in DESCRIPTIVE_SYMBOLS.items():
        out = out | ((norm(raw) == _norm(name)) & (norm(canonical) == symbol.lower()))
    return out


def orf_polyprotein(raw: Column, canonical: Column) -> Column:
    mine = F.regexp_extract(norm(canonical), "^orf([0-9]+[a-z]*)$", 1)
    return (mine != "") & (F.regexp_extract(norm(raw), "polyprotein(?:orf)?([0-9]+[a-z]*)$", 1) == mine)


def combined_orf(raw: Column, canonical: Column) -> Column:
    """The name speaks of both halves of the canonical ORF1ab."""
    r = F.lower(F.coalesce(raw, F.lit("")))
    spelt = norm(raw).isin("orf1a/1b", "orf1a/b") | r.rlike(r"orf\s*1a\s*/\s*(?:orf\s*)?1?b") | r.rlike(r"orf\s*1a\s+and\s+orf\s*1b")
    return (norm(canonical) == "orf1ab") & spelt


def match_tier(raw: Column, canonical: Column) -> Column:
    """0 the same name, 1 the name with a word that says nothing more, 2 its ORF polyprotein, 3 both its halves; null: none."""
    r, c = norm(raw), norm(canonical)
    with_word = F.lit(False)
    for word in PLAIN_ENDINGS:
        with_word = with_word | (r == F.concat(c, F.lit(word)))
    tier = F.when(r == c, 0).when(with_word, 1).when(orf_polyprotein(raw, canonical), 2).when(combined_orf(raw, canonical), 3)
    return F.when((r != "") & (c != ""), tier)


def best_canonical(raw: Column, canonicals: Column) -> Column:
    """Of an array of canonicals the one that matches best: by tier, then the shortest, then the first; null where none does."""
    ranked = F.transform(canonicals, lambda c, i: F.struct(match_tier(raw, c).alias("tier"), F.length(c).alias("n"), i.alias("i"), c.alias("canonical")))
    return F.array_min(F.filter(ranked, lambda x: x["tier"].isNotNull()))["canonical"]


def first_matching(values: Column, canonicals: Column) -> Column:
    """The best canonical of the first of the values that has one."""
    found = F.filter(F.transform(values, lambda v: best_canonical(v, canonicals)), lambda c: c.isNotNull())
    return F.try_element_at(found, F.lit(1))


def generic(raw: Column) -> Column:
    spelt = F.array_join(words(raw), " ")
    return norm(raw).isin([_norm(g) for g in GENERIC_NAMES]) | (~F.coalesce(raw, F.lit("")).rlike("[0-9]") & spelt.isin(list(GENERIC_NAMES)))


def locus_tag_like(raw: Column) -> Column:
    return stripped(F.coalesce(raw, F.lit(""))).rlike(r"^[A-Z]{2,}[_-]?[0-9]{3,}[A-Z0-9_.-]*$")


def classify(raw: Column, field: Column, canonical: Column, iou: Column, same_strand: Column) -> Column:
    """struct(score, action, confidence, default_save, reason) for a name supported by coordinates."""
    exact = norm(raw) == norm(canonical)
    holds = (norm(canonical) != "") & contains_canonical(raw, canonical)
    symbol, synonym, orf = short_symbol(raw, canonical), descriptive_symbol(raw, canonical), orf_polyprotein(raw, canonical)
    named = exact | holds | symbol | synonym | orf
    plain = generic(raw) & ~(synonym | orf)
    described = ~plain & F.arrays_overlap(words(raw), F.array(*map(F.lit, DESCRIPTIVE_TERMS)))
    rules = [
        (iou >= 0.95, 5, F.format_string("coordinate IoU %.2f", iou)),
        ((iou >= 0.90) & (iou < 0.95), 4, F.format_string("coordinate IoU %.2f", iou)),
        (F.coalesce(same_strand, F.lit(False)), 1, F.lit("same strand")),
        (field.isin(*STRONG_FIELDS), 3, F.concat(F.lit("strong field: "), field)),
        (field.isin(*WEAK_FIELDS), -1, F.concat(F.lit("weak/descriptive field: "), field)),
        (exact, 5, F.lit("exact canonical text")),
        (~exact & holds, 4, F.lit("contains canonical name")),
        (~exact & ~holds & symbol, 3, F.lit("short gene symbol consistent with canonical")),
        (synonym, 5, F.lit("descriptive synonym matches canonical")),
        (orf, 5, F.lit("specific ORF polyprotein description matches canonical")),
        (plain, -8, F.lit("generic name")),
        (described & named, 1, F.lit("descriptive term with specific gene name")),
        (described & ~named, 0, F.lit("descriptive biological term")),
        (locus_tag_like(raw), -6, F.lit("locus tag-like value")),
    ]
    total = sum((F.when(test, points).otherwise(0) for test, points, _ in rules), F.lit(0))
    capped = (total >= 8) & ~named
    score = F.when(capped, 5).otherwise(total)
    reasons = F.concat_ws("; ", *(F.when(test, text) for test, _, text in rules), F.when(capped, F.lit("no name-specific alias evidence")))
    return F.struct(
        score.alias("score"),
        F.when(score >= 8, "save_alias").when(score >= 3, "manual_review").otherwise("ignore").alias("action"),
        F.when(score >= 8, "high").when(score >= 3, "medium").otherwise("low").alias("confidence"),
        (score >= 8).alias("default_save"),
        F.coalesce(filled(reasons), F.lit("no strong alias evidence")).alias("reason"),
    )


def ncbi_query(organism: Column, clause: Column, low: Column, high: Column, since: Column, until: Column, region: Column, extra: Column) -> Column:
    """A search expression of the clauses that are given; null clauses are left out."""
    return F.concat_ws(
        " AND ",
        F.when(filled(organism).isNotNull(), F.format_string('"%s"[Organism]', organism)),
        filled(clause),
        F.when(low.isNotNull() & high.isNotNull(), F.format_string("%d:%d[SLEN]", low, high)),
        F.when(since.isNotNull() & until.isNotNull(), F.format_string('("%s"[PDAT] : "%s"[PDAT])', F.date_format(since, "yyyy/MM/dd"), F.date_format(until, "yyyy/MM/dd"))),
        F.when(filled(region).isNotNull(), F.format_string('"%s"[All Fields]', region)),
        F.when(filled(extra).isNotNull(), F.format_string("(%s)", extra)),
    )
