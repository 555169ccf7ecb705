"""URL filtering with redirect equivalence, in DataFrame operations only.

Every url is judged by the longest rule that fits its host (or a domain above it) and the start of its
path. Urls without a rule take the decision of their class: redirect and canonical-link edges join urls
to classes (connected components), and a class that holds a blocked url is blocked, unless it also holds
an explicitly allowed one: allow takes precedence.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule, belongs to no class
and is allowed; null html has no edges; repeated rows each get their row; an edge to the url itself is
no edge; an empty table gives an empty result; other input columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelumen.llm.components import connected_components

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?\s*canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
)
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[\d.]+\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: host lower-cased, fragment gone, an empty path written as ``/``."""
    scheme = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    node = F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(url.contains("://"), node)


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute url; relative paths are taken from the base's last slash."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct (a, b) nodes that a page's canonical link or refresh redirect joins."""
    found = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    targets = F.array(F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1))
    edges = found.select("url", F.explode(targets).alias("target")).where(F.col("target") != "")
    edges = edges.select(node_of(F.col("url")).alias("a"), node_of(_resolved(F.col("url"), F.col("target"))).alias("b"))
    return edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, via``; via is ``rule``, ``alias`` or ``default``.

    ``redirects`` may give more edges: ``source`` and ``target`` urls, as a crawl's redirect log has them.
    Only urls that have an edge take part in the component search, and only they are joined back.
    """
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        more = redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))
        edges = edges.unionByName(more.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))).distinct()
    members = connected_components(edges)
    # The nodes' own rules decide for their class, whether or not a page of that url was stored.
    node = F.col("node")
    _, own = rule_of(host_of(node), path_of(node), rules)
    by_class = members.withColumn("own", own).groupBy("component").agg(
        F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked")
    )
    blocked = by_class.where(F.col("blocked") & ~F.coalesce(F.col("allowed"), F.lit(False))).select("component")
    aliases = members.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    url = F.col("url")
    name, verdict = rule_of(host_of(url), path_of(url), rules)
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), name.alias("rule"), verdict.alias("own"), node_of(url).alias("node"))
    joined = judged.join(aliases, "node", "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias_blocked"), "alias").otherwise("default").alias("via"),
    )
