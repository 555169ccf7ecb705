"""The link graph of a corpus of stored pages: edges, degrees, duplicates, orphans, broken links, depth."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.functions import html as H
from pagelumen.functions import urls as U
from pagelumen.operators.lineage import cut


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, internal``: distinct links of each page to web addresses, normalised, in no order.

    ``src`` is the page's own normalised url; links to the page itself count.
    """
    anchors, decode = H.tags(H.without_code(F.col("html")), "a"), H.unescaping(pages)
    found = pages.where(F.col("html").isNotNull() & (U.netloc(F.col("url")) != "")).select("url", F.explode(F.array_distinct(F.transform(anchors, lambda t: F.trim(H.attribute(t, "href", decode))))).alias("href"))
    found = found.where((F.col("href") != "") & ~F.col("href").startswith("#"))
    target = U.resolved(F.col("url"), F.col("href"))
    edges = found.select(U.crawl_normal(F.col("url")).alias("src"), target.alias("target"), U.netloc(F.col("url")).alias("host"))
    edges = edges.where(F.col("target").rlike(r"^(?i)https?://[^/?#]"))
    return edges.select("src", U.crawl_normal(F.col("target")).alias("dst"), (U.netloc(F.col("target")) == F.col("host")).alias("internal")).distinct()


def ordered_links(pages: DataFrame) -> DataFrame:
    """``src, dst, internal, position``: the same links with where a page names the target first."""
    anchors, decode = H.tags(H.without_code(F.col("html")), "a"), H.unescaping(pages)
    found = pages.where(F.col("html").isNotNull() & (U.netloc(F.col("url")) != "")).select("url", F.posexplode(F.transform(anchors, lambda t: F.trim(H.attribute(t, "href", decode)))).alias("position", "href"))
    found = found.where((F.col("href") != "") & ~F.col("href").startswith("#")).withColumn("target", U.resolved(F.col("url"), F.col("href")))
    found = found.where(F.col("target").rlike(r"^(?i)https?://[^/?#]"))
    rows = found.select(U.crawl_normal(F.col("url")).alias("src"), U.crawl_normal(F.col("target")).alias("dst"), (U.netloc(F.col("target")) == U.netloc(F.col("url"))).alias("internal"), "position")
    return rows.groupBy("src", "dst", "internal").agg(F.min("position").alias("position"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_links, in_links`` of every node. Counted from the edges once each way, without a self-join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


def duplicates(pages: DataFrame, value: Column) -> DataFrame:
    """``value, n, first_url``: non-empty values that several pages share, and the first of their urls by name."""
    rows = pages.select(value.alias("value"), "url").where(F.coalesce("value", F.lit("")) != "")
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("url").alias("first_url")).where(F.col("n") > 1)


def duplicate_counts(pages: DataFrame, value: Column) -> DataFrame:
    """``value, n``: the same without the urls; groups of any size."""
    rows = pages.select(value.alias("value")).where(F.coalesce("value", F.lit("")) != "")
    return rows.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def _title(pages: DataFrame) -> Column:
    return H.element_text(H.without_comments(F.col("html")), "title", H.unescaping(pages))


def _description(pages: DataFrame) -> Column:
    return H.meta_content(H.metas(H.without_comments(F.col("html")), H.unescaping(pages)), "description")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return duplicates(pages, _title(pages))


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    return duplicates(pages, _description(pages))


def orphans(pages: DataFrame, edges: DataFrame, start: list[str] | None = None) -> DataFrame:
    """Pages that no link leads to, start pages aside."""
    nodes = pages.select("page_id", "url", U.crawl_normal(F.col("url")).alias("node"))
    if start:
        nodes = nodes.where(~F.col("url").isin(start))
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").select("page_id", "url")


def broken_links(pages: DataFrame, edges: DataFrame, status: DataFrame, most: int | None = None) -> DataFrame:
    """``src, dst, code``: links to uncrawled targets whose probe failed (0) or gave 400 or more.

    ``status``: ``url, code``. A target never probed counts as failed. ``most`` keeps the links to the first
    so many targets by name.
    """
    crawled = pages.select(U.crawl_normal(F.col("url")).alias("dst")).distinct()
    open_ = edges.join(crawled, "dst", "left_anti")
    if most is not None:
        open_ = open_.join(open_.select("dst").distinct().orderBy("dst").limit(most), "dst", "left_semi")
    probed = open_.join(status.select(F.col("url").alias("dst"), "code"), "dst", "left")
    return probed.select("src", "dst", F.coalesce("code", F.lit(0)).alias("code")).where((F.col("code") == 0) | (F.col("code") >= 400))


def depths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node, depth``: least number of links from a start node (``node``), breadth first, to any depth.

    One join of the frontier per level; each level is checkpointed, and every few levels what was seen is
    written as one table, so plans stay short.
    """
    links = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())  # joined at every level
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in itertools.count(1):
        reached = frontier.join(links, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier) if depth % 16 else cut(seen.unionByName(frontier))
    return seen


def crawl(pages: DataFrame, edges: DataFrame, start: DataFrame, most_pages: int = 20) -> DataFrame:
    """``page_id, url, depth, number``: stored pages as a queue would fetch them, at most ``most_pages`` per host.

    ``edges`` as of ``ordered_links`` (without a ``position``, links are taken in order of their names), ``start``: ``node``. A page joins its host's queue
    behind the pages whose links came before: pages of one level stand in the order of (number of the page that names them first,
    position of the link there). A level is one join of the last one with the links. Hosts that have spent their budget leave
    before the next level is opened, so no more is read than a crawler would fetch. Targets that aren't stored
    cost nothing and lead nowhere. Of pages with one normalised url the one of least id counts.
    """
    place = F.col("position") if "position" in edges.columns else F.lit(0)
    links = cut(edges.where("internal").select(F.col("src").alias("node"), F.col("dst").alias("next"), place.alias("position")))  # joined at every level
    own = pages.select(U.crawl_normal(F.col("url")).alias("node"), "page_id", "url")
    stored = cut(own.groupBy("node").agg(F.min(F.struct("page_id", "url")).alias("p")).select("node", "p.page_id", "p.url"))
    site = F.lower(U.netloc(F.col("node")))
    # Numbers are given within a host; the limit on them is applied before rows meet, so that no host is one large group.
    order = Window.partitionBy("site").orderBy("by", "position", "node")
    waiting = start.select("node").distinct().select("node", site.alias("site"), F.lit(0).alias("by"), F.lit(0).alias("position"), F.lit(0).alias("spent"))
    found = None
    for depth in itertools.count():
        fetched = waiting.join(stored, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_pages)
        fetched = fetched.withColumn("number", F.col("spent") + F.col("place")).where(F.col("number") <= most_pages)
        level = cut(fetched.select("site", "node", "page_id", "url", F.lit(depth).alias("depth"), "number"))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        if depth % 16 == 15:
            found = cut(found)
        spent = level.groupBy("site").agg(F.max("number").alias("spent")).where(F.col("spent") < most_pages)
        named = level.join(spent, "site").join(links, "node").groupBy("site", F.col("next").alias("node")).agg(F.min(F.struct(F.col("number").alias("by"), "position")).alias("first"), F.max("spent").alias("spent"))
        waiting = named.join(found.select("node"), "node", "left_anti").select("node", "site", "first.by", "first.position", "spent")
    rows = level if found is None else found
    return rows.select("page_id", "url", "depth", "number")


def longest_depths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node, depth``: what ``depths`` gives, for graphs with long chains.

    A node that one link enters and one link leaves can be reached by its chain alone. Pointers along the chains double their reach each
    round, so a chain of n nodes takes log n rounds and becomes one link with a length. Between the other nodes, lengths are relaxed until none
    shrinks: as many rounds as such nodes follow each other on a shortest way. Chains that close upon themselves are reached by none.
    """
    links = cut(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    begins = cut(start.select("node").distinct())
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    between = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").join(begins, "node", "left_anti").select("node", F.lit(True).alias("inner"))
    # Of each node on a chain: a node before it, how far before, and whether that one is on a chain too.
    marked = links.join(between.select(F.col("node").alias("src"), F.col("inner").alias("more")), "src", "left").join(between.select(F.col("node").alias("dst"), "inner"), "dst", "left")
    marked = cut(marked.select("src", "dst", F.coalesce("more", F.lit(False)).alias("more"), F.coalesce("inner", F.lit(False)).alias("inner")))
    chain = cut(marked.where("inner").select(F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(1).cast("long").alias("far"), "more"))
    for _ in range(chain.count().bit_length()):
        if chain.where("more").isEmpty():
            break
        back = chain.select(F.col("node").alias("before"), F.col("before").alias("b"), F.col("far").alias("f"), F.col("more").alias("m"))
        joined = chain.where("more").join(back, "before").select("node", F.col("b").alias("before"), (F.col("far") + F.col("f")).alias("far"), F.col("m").alias("more"))
        chain = cut(chain.where("NOT more").unionByName(joined))
    chain = chain.where("NOT more").select("node", "before", "far")
    # The last link of a chain begins where the chain does.
    out = marked.where("NOT inner").join(chain.select(F.col("node").alias("src"), "before", "far"), "src", "left")
    hops = out.where(F.col("before").isNotNull() | ~F.col("more")).select(F.coalesce("before", "src").alias("node"), F.col("dst").alias("next"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    hops = cut(hops.groupBy("node", "next").agg(F.min("far").alias("far")))
    known = nearer = cut(begins.withColumn("depth", F.lit(0).cast("long")))
    while not nearer.isEmpty():
        offered = nearer.join(hops, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
        nearer = cut(offered.join(known.withColumnRenamed("depth", "old"), "node", "left").where("old IS NULL OR depth < old").select("node", "depth"))
        known = cut(known.unionByName(nearer).groupBy("node").agg(F.min("depth").alias("depth")))
    inner = chain.join(known.withColumnRenamed("node", "before"), "before").select("node", (F.col("depth") + F.col("far")).alias("depth"))
    return known.unionByName(inner).select("node", F.col("depth").cast("int").alias("depth"))


def crawl_depths(pages: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node, depth``: how deep a crawl without a budget meets the stored pages, along links within their hosts."""
    stored = cut(pages.select(U.crawl_normal(F.col("url")).alias("node")).distinct())
    inner = edges.where("internal").select("src", "dst").join(stored.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return longest_depths(inner.join(stored.withColumnRenamed("node", "src"), "src", "left_semi"), start.join(stored, "node", "left_semi"))


def crawl_report(pages: DataFrame, edges: DataFrame, status: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """One row: counts of the crawl's findings, their score, and the greatest depth."""
    title, description = _title(pages), _description(pages)
    counts = [
        pages.agg(F.count("*").alias("pages")),
        broken_links(pages, edges, status).agg(F.count("*").alias("broken")),
        orphans(pages, edges).agg(F.count("*").alias("orphans")),
        duplicate_counts(pages, title).agg(F.count("*").alias("duplicate_titles")),
        duplicate_counts(pages, description).agg(F.count("*").alias("duplicate_descriptions")),
        (pages.select(F.lit(0).alias("depth")) if depth is None else depth).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")),
    ]
    row = counts[0]
    for other in counts[1:]:
        row = row.join(other)  # single rows
    loss = sum((F.least(F.lit(most), F.col(c) * each) for c, each, most in (("broken", 5, 30), ("orphans", 3, 15), ("duplicate_titles", 5, 20), ("duplicate_descriptions", 3, 15))), F.when(F.col("max_depth") > 5, 15).otherwise(0))
    return row.withColumn("score", F.greatest(F.lit(0), F.lit(100) - loss).cast("int"))
