"""What only larger tables hold."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelumen.functions import html as H
from pagelumen.operators import audit, linkgraph
from pagelumen.plans.catalog import QUERIES
from pagelumen.plans.oracles import ORACLES
from pagelumen.sources.tables import PAGES_A_TASK, spread

PAGES = "page_id long, url string, html string"
LISTED = ["advised_issues", "category_scores_long", "category_severities", "issue_rules", "meta_tags_score", "metric_verdicts", "narrative_variant", "overall_score", "page_title_facts", "quick_wins_top3", "recommendations_by_impact", "report_categories", "report_totals", "severity_shares"]


def against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Titles that were cut within a reference, of 29 characters and of 32 with what is left of it."""
    folder = tmp_path_factory.mktemp("cut")
    page = "<html lang='en'><head><title>{}&amp</title></head><body><h1>{}</h1><p>a &amp; b</p></body></html>"
    rows = [(i, f"https://s{i % 2}.test/p{i}", page.format("x" * n, "h")) for i, n in enumerate((28, 28, 40, 58, 10))]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", LISTED)
def test_cut_references_as_in_sql(spark, cut_pages, name):
    got, want = against_sql(spark, cut_pages, name)
    assert got == want


def test_closed_references_end_in_a_semicolon(spark):
    frame = spark.createDataFrame([("a &amp;&copy; b&amp", True), ("&#65;&#66 &notin;&not &amp;lt;", True), ("a &copy", False), ("a &copy", None)], f"t string, {H.CLOSED} boolean")
    rows = frame.select(H.unescaping(frame)(frame.t).alias("d"), "t").collect()
    assert [r.d for r in rows] == ["a &© b&amp", "A&#66 ∉&not &lt;", "a ©", "a ©"]
    settled = H.with_settled(frame, "t", "m").select(H.restored("m").alias("d")).collect()
    assert [r.d for r in settled] == [r.d for r in rows]


def test_ties_of_the_content_ratio_as_in_sql(spark, tmp_path):
    """Pages of 2,000 characters: the ratios lie halfway between two tenths, but their doubles beside it."""
    tie = lambda n: "<body>" + "x" * n + "</body>" + "<!--" + " " * (2000 - 13 - 7 - n) + "-->"
    lengths = (1279, 1267, 1241, 1233, 1201, 1199)
    rows = [(i, f"https://s.test/{i}", tie(n)) for i, n in enumerate(lengths)]
    assert {len(html) for _, _, html in rows} == {2000}
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, tmp_path, "metric_verdicts")
    assert got == want
    assert [r[3] for r in got if r[1] == "content_to_html_ratio"] == [64.0, 63.4, 62.0, 61.6, 60.0, 60.0]


def breadth_first(links, starts):
    found, level = {s: 0 for s in starts}, list(starts)
    while level:
        level = [b for a in level for b in links.get(a, ()) if b not in found and found.setdefault(b, found[a] + 1)]
    return found


def test_depths_along_chains(spark):
    """Chains with short cuts, ways back, forks and circles, against a plain loop."""
    rng = random.Random(3)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(300)] + [(f"b{i}", f"b{i + 1}") for i in range(90)] + [(f"c{i}", f"c{(i + 1) % 17}") for i in range(17)]
    pairs += [(f"{s}{rng.randrange(90)}", f"{t}{rng.randrange(90)}") for s, t in ("aa", "ab", "ba", "bb", "aa", "bb", "ab")] + [("a7", "a7"), ("d0", "d1"), ("d1", "d0")]
    links = {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for starts in (["a0"], ["b3", "a150"], ["c5", "c5"], ["d1", "alone"]):
        found = linkgraph.longest_depths(edges, spark.createDataFrame([(s,) for s in starts], "node string")).collect()
        assert len(found) == len({r.node for r in found})
        assert {r.node: r.depth for r in found} == breadth_first(links, starts)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    written, whole = [], linkgraph.cut
    monkeypatch.setattr(linkgraph, "cut", lambda df: written.append(df.columns) or whole(df))
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(2000)], "src string, dst string")
    assert linkgraph.longest_depths(edges, spark.createDataFrame([("0",)], "node string")).agg({"depth": "max"}).first()[0] == 2000
    assert len(written) < 30


def test_report_of_a_long_chain_as_in_sql(spark, tmp_path):
    rows = [(i, f"https://s.test/{i}", "<title>t</title>") for i in range(450)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, tmp_path, "crawl_report")
    assert got == want and got[0][5] == 400


def test_report_counts_every_level_as_in_sql(spark, tmp_path):
    """A chain of 450 pages with ways back, which close circles, and one of 20 with a short cut."""
    back = {449: "<a href='/0'>first</a>", 300: "<a href='/299'>before</a><a href='/7'>seventh</a>", 500: "<a href='/510'>on</a>"}
    rows = [(i, f"https://s{i // 500}.test/{i}", f"<title>t</title>{back.get(i, '')}") for i in [*range(450), *range(500, 520)]]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, tmp_path, "crawl_report")
    assert got == want and got[0][5] == 449


def test_tasks_do_not_grow_with_the_table(spark, tmp_path):
    """One file of one row group: a split each, but all rows in one of them."""
    spark.range(20_500).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 50) AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    dealt = spread(spark.read.parquet(f"{tmp_path}/pages.parquet"), "page_id")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 21 and sum(sizes) == 20_500 and max(sizes) < 2 * PAGES_A_TASK


def test_only_what_is_asked_for_is_evaluated(spark, sf_dir):
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "<!--" not in plan("heaviest_categories")
    assert "<link" not in plan("heading_evidence")
    assert "from_json" not in plan("worst_severity")


def test_parts_of_the_audit_are_those_of_the_whole(spark):
    rows = [(i, "https://s.test/", f"<title>{'t' * 40 * i}</title><h1>a</h1><h3>b</h3><h6>c</h6>", t) for i, t in enumerate(("900", "slow", "3500", None))]
    pages = spark.createDataFrame(rows, f"{PAGES}, elapsed_ms string")
    whole = audit.issues(pages).drop("evidence").collect()
    assert sorted(audit.issues(pages, with_evidence=False).drop("evidence").collect()) == sorted(whole)
    assert sorted(audit.issues(pages, ["headings"]).drop("evidence").collect()) == sorted(r for r in whole if r.category == "headings")
    long = audit.categories_long(pages, with_issues=False).drop("issues").collect()
    assert sorted(audit.categories_long(pages, names=["links", "performance"], with_evidence=False).drop("issues").collect(), key=repr) == sorted((r for r in long if r.category in ("links", "performance")), key=repr)
    assert {r.status for r in long} == {"ok", "error"}
    assert sorted(audit.listed(pages).collect()) == sorted((r.page_id, r.url, r.position, r.category) for r in long)
