"""Robots files and sitemaps as tables, the inventory of sitemap urls, and their summary.

Snapshots: ``robots(base_url, status, body)`` and ``sitemaps(url, status, content_type, body)``; gzip is
undone by Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.functions import html as H
from pagelumen.functions import urls as U
from pagelumen.operators.lineage import cut

#: Places a sitemap is looked for, after those a robots file names.
PLACES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/sitemap-index.xml"]
AGENTS = ["*", "pagelumen"]
STALE_DAYS = 365


def _lines(body: Column) -> Column:
    """Lines of a robots file without comments and outer blanks."""
    return F.filter(F.transform(F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")


def _value(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^[^:]*:", ""))


def robots_rules(robots: DataFrame, agents: list[str] = AGENTS) -> DataFrame:
    """``base_url, line, agents, kind, path``: rules of the groups for the agents. Consecutive User-agent lines share a group."""
    rows = robots.where((F.col("status") == 200) & F.col("body").isNotNull()).select("base_url", F.posexplode(_lines(F.col("body"))).alias("line", "text"))
    key = F.lower(F.trim(F.regexp_extract("text", r"^([^:]*):", 1)))
    rows = rows.select("base_url", "line", key.alias("key"), _value(F.col("text")).alias("value"))
    order = Window.partitionBy("base_url").orderBy("line")  # a file's lines
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("group", F.sum(starts.cast("int")).over(order))
    named = rows.where(F.col("key") == "user-agent").groupBy("base_url", "group").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("agents"))
    rules = rows.where(F.col("key").isin("disallow", "allow") & (F.col("value") != "")).join(named, ["base_url", "group"])
    chosen = F.arrays_overlap("agents", F.array(*map(F.lit, agents)))
    return rules.where(chosen).select("base_url", "line", "agents", F.col("key").alias("kind"), F.col("value").alias("path"))


def robots_facts(robots: DataFrame) -> DataFrame:
    """``base_url, body, sitemaps, disallows, allows, paths, full_block``, agents not told apart."""
    lines = _lines(F.col("body"))
    starts = lambda p: F.filter(lines, lambda x: F.lower(x).startswith(p))
    paths = F.filter(F.transform(starts("disallow:"), _value), lambda p: p != "")
    body = F.when(F.col("status") == 200, F.col("body"))
    return robots.select("base_url", body.alias("body"), F.size(starts("sitemap:")).alias("sitemaps"), F.size(starts("disallow:")).alias("disallows"), F.size(starts("allow:")).alias("allows"), paths.alias("paths"), F.array_contains(paths, "/").alias("full_block"))


def with_robots(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages with the columns the robots category needs; known for sites whose file was fetched."""
    facts = robots_facts(robots).withColumnsRenamed({"base_url": "r_base", "body": "r_body", "sitemaps": "r_sitemaps", "full_block": "r_full_block"})
    joined = pages.withColumn("r_base", U.base_url(F.col("url"))).join(facts, "r_base", "left")
    blocked = F.exists("paths", lambda p: U.path(F.col("url")).startswith(p))
    return joined.withColumns({"r_known": F.col("disallows").isNotNull(), "r_blocked": F.coalesce(blocked, F.lit(False)), "r_full_block": F.coalesce("r_full_block", F.lit(False))}).drop("r_base", "paths", "disallows", "allows")


def discover(robots: DataFrame, sitemaps: DataFrame, sites: DataFrame) -> DataFrame:
    """``base_url, url``: sitemaps that robots files name, and the first well-known place that is stored."""
    named = robots.where(F.col("status") == 200).select("base_url", F.explode(F.transform(F.filter(_lines(F.col("body")), lambda x: F.lower(x).startswith("sitemap:")), _value)).alias("url"))
    places = sites.select("base_url", F.posexplode(F.array(*map(F.lit, PLACES))).alias("place", "path"))
    there = places.withColumn("url", F.concat("base_url", "path")).join(sitemaps.where(F.col("status") == 200).select("url"), "url", "left_semi")
    first = there.groupBy("base_url").agg(F.min_by("url", "place").alias("url"))
    return named.unionByName(first).distinct()


def _read(sitemaps: DataFrame) -> DataFrame:
    """``url, is_index, entries``: entries of a sitemap or index as written; null where the body is no XML of either kind."""
    body = F.col("body")
    block = lambda tag: F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    inner = lambda text, tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))
    entry = lambda b: F.struct(*(inner(b, t).alias(t) for t in ("loc", "lastmod", "changefreq", "priority")))
    xml = body.rlike(r"(?is)<(sitemapindex|urlset)\b")
    index = body.rlike(r"(?is)<sitemapindex\b")
    entries = F.transform(F.when(index, block("sitemap")).otherwise(block("url")), entry)
    return sitemaps.select("url", "status", (xml & F.coalesce(F.col("content_type").contains("xml"), F.lit(True))).alias("is_xml"), index.alias("is_index"), F.filter(entries, lambda e: e["loc"].isNotNull()).alias("entries"))


def entries(sitemaps: DataFrame, roots: DataFrame, most_depth: int = 3) -> DataFrame:
    """``root, sitemap, url, lastmod, changefreq, priority, norm``: entries below the roots (``url``), each
    normalised url once per root: the one met first (by depth, sitemap, position). Bodies are columns of ``sitemaps``."""
    read = _read(sitemaps.where(F.col("status") == 200))
    # Outer: else the whole expression of the entries would be evaluated once more, to see whether there are any.
    rows = read.select(F.col("url").alias("sitemap"), "is_index", F.posexplode_outer("entries").alias("position", "e")).where(F.col("e").isNotNull()).select("sitemap", "is_index", "position", "e.*")
    return walk(rows.withColumn("loc", H.decoded(F.col("loc"))), roots, most_depth)


def sitemap_rows(spark, path: str) -> DataFrame:
    """``file, is_index, position, loc, lastmod, changefreq, priority`` of a folder of sitemap files, plain or gzipped (``.gz``).

    Files are read row by row, so none is ever one string: ``url`` elements of lists and ``sitemap`` elements of indexes.
    A file that has any of the latter is an index. ``file``: the file's address; ``position`` grows within it.
    """
    schema = "loc string, lastmod string, changefreq string, priority string"

    def elements(tag: str) -> DataFrame:
        found = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(schema).load(path)
        # Blocks of a large file are read apart: first where the block starts, then the order within it.
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        tidy = (F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("loc", "lastmod", "changefreq", "priority"))
        return found.select(F.col("_metadata.file_path").alias("file"), F.lit(tag == "sitemap").alias("is_index"), place.alias("position"), *tidy)

    return elements("url").unionByName(elements("sitemap")).where(F.col("loc").isNotNull())


def entries_of_files(rows: DataFrame, names: DataFrame, roots: DataFrame, most_depth: int = 3) -> DataFrame:
    """The same as ``entries`` from ``sitemap_rows``; ``names``: ``file, sitemap`` (the url under which a file was fetched)."""
    return walk(cut(rows.join(names.select("file", "sitemap"), "file").drop("file")), roots, most_depth)  # parsed once


def walk(rows: DataFrame, roots: DataFrame, most_depth: int = 3) -> DataFrame:
    """Entries below the roots (``url``) from ``sitemap, is_index, position, loc, lastmod, changefreq, priority``.

    Level by level from the roots; a sitemap that a root has opened isn't opened again, so indexes that name each other
    end. Below ``most_depth`` nothing is opened. An index's own ``url`` elements don't count.
    """
    children = cut(rows.where("is_index").select("sitemap", F.col("loc").alias("child")).distinct())  # joined at every level
    level = cut(roots.select(F.col("url").alias("root"), F.col("url").alias("sitemap")).distinct().withColumn("depth", F.lit(0)))
    opened = level
    for depth in range(1, most_depth + 1):
        below = level.join(children, "sitemap").select("root", F.col("child").alias("sitemap")).distinct()
        level = cut(below.join(opened, ["root", "sitemap"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        opened = opened.unionByName(level)
    lists = rows.where(~F.col("is_index")).join(children.select("sitemap").distinct(), "sitemap", "left_anti")
    met = opened.join(lists, "sitemap").withColumn("norm", U.export_normal(F.col("loc")))
    entry = F.struct("depth", "sitemap", "position", F.col("loc").alias("url"), "lastmod", "changefreq", "priority")
    first = met.groupBy("root", "norm").agg(F.min(entry).alias("e"))  # combines before the shuffle: a url in very many sitemaps is no hot group
    return first.select("root", "e.sitemap", "e.url", "e.lastmod", "e.changefreq", "e.priority", "norm")


def sitemap_facts(sitemaps: DataFrame, now: str) -> DataFrame:
    """``url, m_status, m_is_xml, m_urls, m_stale, m_foreign, m_locs`` (as written) of each sitemap file itself.

    An entry is stale if its last change is more than 365 whole days before ``now``; dates without a time
    count from midnight.
    """
    read = _read(sitemaps)
    age = lambda e: F.floor((F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp(e["lastmod"]))) / 86400)
    stale = F.size(F.filter("entries", lambda e: F.coalesce(age(e) > STALE_DAYS, F.lit(False))))
    foreign = F.size(F.filter("entries", lambda e: ~e["loc"].startswith(U.base_url(F.col("url")))))
    return read.select("url", F.col("status").alias("m_status"), F.col("is_xml").alias("m_is_xml"), F.size("entries").alias("m_urls"), stale.alias("m_stale"), foreign.alias("m_foreign"), F.transform("entries", lambda e: e["loc"]).alias("m_locs"))


def with_sitemap(pages: DataFrame, sitemaps: DataFrame, now: str, place: str = "/sitemap.xml") -> DataFrame:
    """Pages with the columns the sitemap category needs, from the site's own sitemap file.

    Whether a page is listed is a semi-join on (site, url), so a site's list is never held in one row.
    """
    facts = sitemap_facts(sitemaps, now)
    listed = facts.select("url", F.explode_outer("m_locs").alias("loc")).select(F.col("url").alias("m_file"), F.regexp_replace(H.decoded(F.col("loc")), "/+$", "").alias("loc")).where(F.col("loc").isNotNull()).distinct().withColumn("m_listed", F.lit(True))
    rows = pages.withColumn("m_file", F.concat(U.base_url(F.col("url")), F.lit(place))).withColumn("loc", F.regexp_replace("url", "/+$", ""))
    rows = rows.join(facts.drop("m_locs").withColumnRenamed("url", "m_file"), "m_file", "left").join(listed, ["m_file", "loc"], "left")
    return rows.withColumns({"m_known": F.col("m_is_xml").isNotNull(), "m_has_page": F.coalesce("m_listed", F.lit(False))}).drop("m_file", "loc", "m_listed")


def banned(urls: DataFrame, rules: DataFrame, column: str = "disallowed") -> DataFrame:
    """Adds whether a rule of the url's site bans its path, and ``banned_by``, the longest rule that does.

    ``rules`` as of ``robots_rules``; a rule bans what starts with its path, stars at the end aside. Every path is cut to
    the lengths that the site's rules have, and the cuts are looked up by equality: a site of 100,000 rules costs a path as many
    rows as its rules have lengths, and no site's rules are ever held in one row.
    """
    prefixes = rules.where(F.col("kind") == "disallow").select("base_url", F.rtrim(F.col("path"), F.lit("*")).alias("prefix")).distinct()
    lengths = prefixes.select("base_url", F.length("prefix").alias("size")).distinct()
    keyed = urls.withColumns({"_site": U.base_url(F.col("url")), "_path": U.path(F.col("url"))})
    paths = keyed.select(F.col("_site").alias("base_url"), F.col("_path").alias("path")).distinct()
    cuts = paths.join(lengths, "base_url").where(F.length("path") >= F.col("size")).withColumn("prefix", F.expr("left(path, size)"))
    hits = cuts.join(prefixes, ["base_url", "prefix"]).groupBy(F.col("base_url").alias("_site"), F.col("path").alias("_path")).agg(F.max_by("prefix", "size").alias("banned_by"))
    return keyed.join(hits, ["_site", "_path"], "left").withColumn(column, F.col("banned_by").isNotNull()).drop("_site", "_path")


def inventory(listed: DataFrame, pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per listed url with what its stored page says: the export's columns.

    ``listed``: ``url, norm`` and optional lastmod etc.; ``pages`` as for the audit; ``rules`` as of ``robots_rules``.
    """
    from pagelumen.operators.facts import with_facts

    # Several pages can share a normalised url: the one of least id speaks for it.
    own = pages.withColumn("norm", U.export_normal(F.col("url")))
    chosen = own.groupBy("norm").agg(F.min("page_id").alias("page_id"))
    facts = with_facts(own.join(chosen, ["norm", "page_id"], "left_semi"))
    html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(True))
    code = F.coalesce("status_code", F.lit(200))
    robots = F.array_join(F.transform(F.filter("f_metas", lambda m: F.coalesce(m["name"] == "robots", F.lit(False))), lambda m: F.lower(F.coalesce(m["content"], F.lit("")))), ",")
    h1 = F.filter("f_headings", lambda h: h["level"] == 1)
    words = F.when(F.col("f_document_text") == "", 0).otherwise(F.size(F.split("f_document_text", " ")))
    seen = facts.select(
        "norm", code.alias("status_code"), html.alias("is_html"),
        F.substring("f_title", 1, 500).alias("title"), F.length("f_title").alias("title_length"), F.substring("f_description", 1, 500).alias("description"), F.length("f_description").alias("description_length"),
        F.get(F.transform(h1, lambda h: h["text"]), F.lit(0)).alias("h1"), F.size(h1).alias("h1_count"), F.col("f_canonical").alias("canonical"), robots.contains("noindex").alias("noindex"), words.alias("word_count"), F.col("f_og_count").alias("og_tags"),
        F.coalesce("content_type", F.lit("")).alias("content_type"), F.get(F.transform(F.filter("f_metas", lambda m: F.coalesce(m["name"] == "robots", F.lit(False))), lambda m: m["content"]), F.lit(0)).alias("robots_meta"),
        F.substring(_property("og:title"), 1, 500).alias("og_title"), F.substring(_property("og:description"), 1, 500).alias("og_description"),
        F.coalesce("elapsed_ms", F.lit(None).cast("long")).alias("response_ms"),
    )
    rows = listed.join(seen, "norm", "left")
    if rules is not None:
        rows = banned(rows, rules)
    else:
        rows = rows.withColumn("disallowed", F.lit(False))
    norm = U.export_normal(F.col("canonical"))
    return rows.withColumns(
        {
            "canonical_status": F.when(F.coalesce(F.col("canonical"), F.lit("")) == "", "missing").when(norm == F.col("norm"), "match").otherwise("mismatch"),
            "indexable": F.when(F.coalesce(F.col("status_code"), F.lit(0)) != 200, "No").when(~F.col("is_html"), "Unknown").when(F.col("noindex") | F.col("disallowed"), "No").otherwise("Yes"),
            "error": F.when(F.col("status_code").isNull(), "not stored").when(F.col("status_code") >= 400, F.concat(F.lit("status "), F.col("status_code").cast("string"))),
            "extraction_method": F.when(F.coalesce(F.col("status_code"), F.lit(0)) != 200, "failed").when(~F.col("is_html"), "non_html").otherwise("html_parse"),
        }
    )


def _property(name: str) -> Column:
    """Content of the first meta of a property."""
    return F.get(F.transform(F.filter("f_metas", lambda m: F.coalesce(m["property"] == name, F.lit(False))), lambda m: m["content"]), F.lit(0))


def inventory_summary(rows: DataFrame) -> DataFrame:
    """The export's summary: one row of counts; the mean of words is over pages with words, cut to whole."""
    code, n = F.col("status_code"), F.count_if
    return rows.agg(
        F.count("*").alias("total_urls"),
        n(code == 200).alias("status_200"),
        n(code.isin(301, 302)).alias("status_301"),
        n(code == 404).alias("status_404"),
        n(code >= 500).alias("status_5xx"),
        n(F.col("error").isNotNull()).alias("errors"),
        n(F.coalesce(F.col("title"), F.lit("")) == "").alias("missing_title"),
        n(F.coalesce(F.col("description"), F.lit("")) == "").alias("missing_description"),
        n(F.coalesce(F.col("h1"), F.lit("")) == "").alias("missing_h1"),
        n(F.col("canonical_status") == "mismatch").alias("canonical_mismatch"),
        n(F.coalesce(F.col("noindex"), F.lit(False))).alias("noindex"),
        n(F.col("indexable") == "Yes").alias("indexable"),
        n(F.col("extraction_method") != "failed").alias("fetched_ok"),
        n(F.col("extraction_method") == "failed").alias("failed"),
        n((F.col("extraction_method") == "html_parse") & (F.col("canonical_status") == "missing")).alias("missing_canonical"),
        n(F.col("indexable") == "No").alias("non_indexable"),
        F.coalesce(F.avg(F.nullif(F.col("word_count"), F.lit(0))).cast("int"), F.lit(0)).alias("avg_word_count"),
    )
