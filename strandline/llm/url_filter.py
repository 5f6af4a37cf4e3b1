"""URL filters with redirect equivalence: block decisions reach aliases through canonical links and redirects.

A url's own rule decides where one fits. Where none does, the url takes the decision of its equivalence class: pages and
link targets are joined by edges (rel=canonical links, meta refresh redirects, and any further redirect table given), a
distributed connected-components run finds the classes, and a class with an allowed member is allowed, else one with a
blocked member is blocked, else it is allowed. Scheme and fragment do not tell urls apart, nor do dot segments or the
slash of an empty path. References are resolved as RFC 3986 says; links inside comments don't count; `&amp;` is read as `&`.

Only urls that have an edge enter the graph. A class's decision comes from two partial aggregates, so a class of any size
never meets in one task. Defined results: a null url, or one without `://`, has empty host and path and no rule; null html
gives no edge, nor does a redirect with a null end; long html is read whole; a null page_id is kept; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import components
from strandline.llm.shared import cut

#: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: of equal lengths the longer host, then allow, wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its segments `.` and `..` resolved."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))),
        lambda s: F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(s, F.array(F.lit("")))).otherwise(s), "/"),
    )
    return F.when(path.contains("/."), kept).otherwise(path)


def key_of(url: Column) -> Column:
    """A url without scheme and fragment, its host folded and its path normalised: urls with one key are one resource."""
    path, query = path_of(url), F.regexp_extract(F.regexp_replace(_rest(url), r"(?s)#.*$", ""), r"(?s)^[^?]*(.*)$", 1)
    return F.concat(host_of(url), without_dots(F.when(path == "", F.lit("/")).otherwise(path)), query)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)(?<![\w-]){name}\s*=\s*(["'])(.*?)\1""", 2)
    return F.when(quoted != "", F.trim(quoted)).otherwise(F.regexp_extract(tag, rf"""(?is)(?<![\w-]){name}\s*=\s*["']?([^"'\s>]+)""", 1))


def resolved(href: Column, url: Column) -> Column:
    """An absolute form of href on the page url, dot segments left in; null where it names nothing else than the page."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    out = F.when(href.rlike("^(?i)[a-z][a-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(site, href))
    out = out.when(href.startswith("?"), F.concat(site, path, href))
    return out.when(href.rlike("^[^#?:/]+([/?#]|$)"), F.concat(site, F.regexp_replace(path, r"[^/]*$", ""), href))


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target): the page's url, and where its canonical link or its refresh points."""
    some = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    some = some.withColumn("html", F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", ""))
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?(?:[^"'>]*\s)?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    to = F.array(_attribute(canonical, "href"), F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    found = some.select("url", F.explode(F.array_distinct(F.filter(to, lambda x: F.length(x) > 0))).alias("href"))
    href = F.regexp_replace("href", "&(?:amp|#38|#[xX]26);", "&")
    return found.select(F.col("url").alias("source"), resolved(href, F.col("url")).alias("target"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. redirects: optional further edges (source, target) of urls."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = cut(edges.where("source is not null and target is not null and source <> target").select("source", "target", key_of(F.col("source")).alias("a"), key_of(F.col("target")).alias("b")))
    roots = components(edges.select("a", "b"))
    urls = edges.select(F.col("source").alias("url"), F.col("a").alias("node")).union(edges.select("target", "b")).distinct()
    known = urls.select("node", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v"))
    classes = roots.join(known, "node").groupBy("root").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    aliases = roots.join(classes.where("blocked and not coalesce(allowed, false)"), "root").select(F.col("node").alias("alias")).distinct()
    judged = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    judged = judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, F.col("key") == F.col("alias"), "left")
    method = F.when(F.col("alias").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"))
