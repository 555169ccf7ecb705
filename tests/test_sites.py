"""Crawls, hierarchies, robots rules and sitemap files against plain loops."""

import gzip
import random
from collections import deque

from pyspark.sql import functions as F

from pagelumen.operators import linkgraph, schemaorg, sitemaps

PAGES = "page_id long, url string, html string"


def queue(links, stored, start, most):
    """A crawler's queue: (node, depth) in the order of fetching."""
    out, visited, waiting = [], set(), deque([(start, 0)])
    while waiting and len(out) < most:
        node, depth = waiting.popleft()
        if node in visited:
            continue
        visited.add(node)
        if node not in stored:
            continue
        out.append((node, depth))
        waiting.extend((n, depth + 1) for n in links.get(node, []) if n not in visited)
    return out


def test_crawl_is_a_queue_with_a_budget(spark):
    rng = random.Random(7)
    rows, want, starts = [], set(), []
    for site, most in (("a", 15), ("b", 15), ("c", 15)):
        name = lambda i, site=site: f"https://{site}.test/p{i}"
        n = {"a": 40, "b": 9, "c": 30}[site]
        links = {name(i): [name(rng.randrange(n + 6)) for _ in range(rng.randrange(6))] + [name((i + 1) % n)] for i in range(n)}
        stored = {name(i) for i in range(n) if i % 7 != 3}
        rows += [(len(rows) + k, u, "".join(f'<a href="{t}">x</a><a href="https://other.test/">o</a>' for t in links[u])) for k, u in enumerate(sorted(stored))]
        starts.append((name(0),))
        want |= {(u, d, i + 1) for i, (u, d) in enumerate(queue(links, stored, name(0), most))}
    pages = spark.createDataFrame(rows, PAGES)
    found = linkgraph.crawl(pages, linkgraph.ordered_links(pages), spark.createDataFrame(starts, "node string"), most_pages=15)
    assert {(r.url, r.depth, r.number) for r in found.collect()} == want
    assert linkgraph.crawl(pages.limit(0), linkgraph.ordered_links(pages), spark.createDataFrame(starts, "node string")).count() == 0


def test_no_level_is_opened_after_the_budget(spark, monkeypatch):
    """A star of chains: with a budget of five, the second level is the last that is written."""
    rows = [(0, "https://s.test/", "".join(f'<a href="/n{i}-0">x</a>' for i in range(6)))]
    rows += [(1 + i * 10 + k, f"https://s.test/n{i}-{k}", f'<a href="/n{i}-{k + 1}">x</a>') for i in range(6) for k in range(10)]
    pages, written = spark.createDataFrame(rows, PAGES), []
    whole = linkgraph.cut
    monkeypatch.setattr(linkgraph, "cut", lambda df: written.append(df.columns) or whole(df))
    found = linkgraph.crawl(pages, linkgraph.ordered_links(pages), spark.createDataFrame([("https://s.test/",)], "node string"), most_pages=5)
    assert [(r.url, r.number) for r in found.orderBy("number").collect()] == [("https://s.test/", 1)] + [(f"https://s.test/n{i}-0", i + 2) for i in range(4)]
    assert sum("number" in c for c in written) == 3  # two levels, and the empty one that ends it


def test_long_and_circular_hierarchies(spark):
    up = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(200)] + [("t0", "t200"), ("x", None)], "type string, parent string")
    own = spark.createDataFrame([("t0", "p"), ("t150", "q"), ("alone", "r")], "type string, property string")
    got = {(r.type, r.property) for r in schemaorg.inherited(own, up).collect()}
    assert got == {(f"t{i}", p) for i in range(201) for p in "pq"} | {("alone", "r")}
    chain = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(200)], "type string, parent string")
    assert schemaorg.ancestors(chain).count() == 200 * 201 // 2
    assert schemaorg.inherited(own, up.limit(0)).count() == 3


def test_rules_by_prefix_joins(spark):
    rng = random.Random(9)
    alphabet = "ab/*"
    rules = [(f"https://s{i % 2}.test", rng.choice(["disallow", "allow"]), "/" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(5)))) for i in range(60)] + [("https://s2.test", "disallow", "*"), ("https://s3.test", "disallow", "/é")]
    urls = [(i, f"https://s{rng.randrange(5)}.test/" + "".join(rng.choice("ab/é") for _ in range(rng.randrange(8))) + rng.choice(["", "?q=/a", "#f"])) for i in range(400)] + [(1000, "https://s2.test"), (1001, None), (1002, "nonsense")]
    got = {r.page_id: (r.disallowed, r.banned_by) for r in sitemaps.banned(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "base_url string, kind string, path string")).collect()}
    for i, url in urls:
        base, _, rest = (url or "").partition(".test")
        path = rest.split("?")[0].split("#")[0]
        fits = [p.rstrip("*") for b, k, p in rules if k == "disallow" and url and b == base + ".test" and path.startswith(p.rstrip("*"))]
        assert got[i] == (bool(fits), max(fits, key=len) if fits else None), (i, url)
    many = spark.range(100_000).select(F.lit("https://s.test").alias("base_url"), F.lit("disallow").alias("kind"), F.concat(F.lit("/d"), F.col("id")).alias("path"))
    asked = spark.range(2000).select("id", F.concat(F.lit("https://s.test/d"), F.col("id") * 77, F.lit("x")).alias("url"))
    frame = sitemaps.banned(asked, many)
    assert frame.where("disallowed").count() == 2000
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_sitemap_files_row_by_row(spark, tmp_path):
    entry = lambda tag, *locs: f'<?xml version="1.0" encoding="UTF-8"?>\n<{"sitemapindex" if tag == "sitemap" else "urlset"} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"\n<{tag}>\n <loc>\n  {x}\n </loc><lastmod>2024-01-01</lastmod></{tag}>" for x in locs) + f'</{"sitemapindex" if tag == "sitemap" else "urlset"}>'
    files = {
        "root.xml": entry("sitemap", "https://s.test/inner.xml", "https://s.test/list0.xml"),
        "inner.xml": entry("sitemap", "https://s.test/root.xml", "https://s.test/inner.xml", "https://s.test/deep.xml", "https://s.test/missing.xml"),
        "deep.xml": entry("sitemap", "https://s.test/list1.xml.gz", "https://s.test/below.xml"),
        "below.xml": entry("sitemap", "https://s.test/toodeep.xml"),
        "toodeep.xml": entry("url", "https://s.test/never"),
        "list0.xml": entry("url", "https://s.test/a?x=1&amp;y=2", "https://s.test/b", "https://S.test/b/"),
        "list1.xml.gz": entry("url", *(f"https://s.test/c{i}" for i in range(500)), "https://s.test/a"),
        "broken.xml": "<urlset><url><loc>https://s.test/z</loc>",
        "empty.xml": "",
    }
    for name, body in files.items():
        data = body.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    rows = sitemaps.sitemap_rows(spark, str(tmp_path))
    names = spark.createDataFrame([(f"file:{tmp_path}/{n}", f"https://s.test/{n}") for n in files], "file string, sitemap string").withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
    rows = rows.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///"))
    roots = spark.createDataFrame([("https://s.test/root.xml",)], "url string")
    got = {(r.url, r.sitemap.rpartition("/")[2], r.lastmod) for r in sitemaps.entries_of_files(rows, names, roots).collect()}
    assert got == {("https://s.test/a?x=1&y=2", "list0.xml", "2024-01-01"), ("https://s.test/b", "list0.xml", "2024-01-01")} | {(f"https://s.test/c{i}", "list1.xml.gz", "2024-01-01") for i in range(500)}


def test_pages_of_one_normal_url(spark):
    pages = spark.createDataFrame([(5, "https://s.test/a?x=1", "<title>later</title>"), (3, "https://s.test/a/#f", "<title>first</title>"), (4, "https://S.test/a", "<title>middle</title>")], PAGES)
    listed = spark.createDataFrame([("https://s.test/a", "https://s.test/a")], "url string, norm string")
    for parts in (1, 3):
        assert [r.title for r in sitemaps.inventory(listed, pages.repartition(parts)).collect()] == ["first"]
