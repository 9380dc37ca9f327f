"""URL rules with redirect equivalence: block decisions reach the aliases of a blocked address.

An address is host, path and query without tracking parameters; scheme and fragment do not count. Edges join an
address with the target of its canonical link or its refresh redirect. Addresses of one connected component are
aliases. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import connected_components

#: (verdict, host, path) as named in the contract.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, ASCII lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query of a URL, tracking parameters (utm_*) and fragment removed; null without host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))), "&")
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, nulls if none; at equal length allow goes first."""
    text = verdict = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    return (F.lit(None).cast("string"),) * 2 if text is None else (text, verdict)


def _target(base_host: Column, base_path: Column, href: Column) -> Column:
    """Absolute form of a link target."""
    return (F.when(F.contains(href, F.lit("://")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(F.lit("http://"), base_host, href))
            .when((href == "") | F.rlike(href, F.lit(r"^([#?]|[a-zA-Z][a-zA-Z0-9+.\-]*:)")), F.lit(None))
            .otherwise(F.concat(F.lit("http://"), base_host, F.regexp_replace(base_path, r"[^/]*$", ""),
                                F.when(F.contains(base_path, F.lit("/")), "").otherwise("/"), href)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's address and the address its canonical link or refresh redirect names."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(tag: Column, name: str) -> Column:
        pattern = rf"(?is)[\s\"'/]{name}{value}"
        return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))

    tags = pages.where(F.col(html).rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")).select(
        F.col(url).alias("u"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    is_link = F.rlike("tag", F.lit(r"(?i)^<link"))
    href = (F.when(is_link & F.rlike(F.lower(attribute(F.col("tag"), "rel")), F.lit(r"(^|\s)canonical(\s|$)")),
                   attribute(F.col("tag"), "href"))
            .when(~is_link & (F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh"),
                  F.trim(F.regexp_extract(attribute(F.col("tag"), "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))))
    targets = tags.select("u", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href")).where("href <> ''")
    return targets.select(
        address_of(F.col("u")).alias("a"),
        address_of(_target(host_of(F.col("u")), path_of(F.col("u")), F.col("href"))).alias("b"),
    ).where("a is not null and b is not null and a <> b").distinct()


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(address): members of components that hold a blocked address and no explicitly allowed one."""
    members = connected_components(edges)
    as_url = F.concat(F.lit("http://"), "node")
    _, verdict = rule_of(host_of(as_url), path_of(as_url), rules)
    judged = members.withColumn("verdict", verdict)
    roots = judged.groupBy("root").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"),
    ).where("blocked and not coalesce(allowed, false)").select("root")
    return members.join(roots, "root").select(F.col("node").alias("address")).distinct()


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A fitting rule decides. Other addresses are blocked if an alias is blocked and none is explicitly allowed, else
    allowed. Null and malformed URLs have no host, no rule and no alias: allowed. Repeated rows are judged alike;
    edges default to those of the pages' own html. Columns of these names are replaced.
    """
    edges = link_edges(pages, url) if edges is None else edges.select("a", "b")
    parts = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "verdict": verdict,
        # Rows that need no alias get one of many keys that match nothing, so that they do not meet in one task.
        "__address": F.coalesce(F.when(rule.isNull(), address_of(F.col(url))),
                                F.concat(F.lit(" "), F.pmod(F.xxhash64(url), F.lit(65536)).cast("string")))})
    aliases = blocked_aliases(edges, rules).select(F.col("address").alias("__address"), F.lit("block").alias("__by_alias"))
    return judged.join(aliases, "__address", "left").withColumn(
        "verdict", F.coalesce("verdict", "__by_alias", F.lit("allow"))).drop("__address", "__by_alias")
