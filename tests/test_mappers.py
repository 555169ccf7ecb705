"""Third-party payloads, scalars, history, enrichment, sinks and streaming."""

import json

from pyspark.sql import functions as F

from pagelumen.functions import scalars as S
from pagelumen.functions import urls as U
from pagelumen.operators import enrich, history, intel
from pagelumen.sources import tables
from pagelumen.streaming import pages as stream


def payloads(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "payload string")


def test_pagespeed(spark):
    audits = {
        "largest-contentful-paint": {"numericValue": 3200.04},
        "cumulative-layout-shift": {"numericValue": 0.12},
        "a": {"title": "A", "score": 0.2, "details": {"type": "opportunity", "overallSavingsMs": 300}},
        "b": {"title": "B", "score": 0.1, "details": {"type": "opportunity", "overallSavingsMs": 900}},
        "c": {"title": "C", "score": 0.5},
    }
    out = intel.pagespeed(payloads(spark, {"lighthouseResult": {"categories": {"performance": {"score": 0.72}}, "audits": audits}}, "broken")).collect()
    assert (out[0].score, out[0].lcp_ms, out[0].cls) == (72, 3200.0, 0.12)
    assert [o.id for o in out[0].opportunities] == ["b", "a"] and [d.id for d in out[0].diagnostics] == ["c"]
    assert out[1].score is None
    issues = intel.pagespeed_issues(intel.pagespeed(payloads(spark, {"lighthouseResult": {"categories": {"performance": {"score": 0.72}}, "audits": audits}})))
    assert {(r.rule_id, r.severity) for r in issues.collect()} == {("psi_score", "warning"), ("lcp", "warning"), ("cls", "warning"), ("a", "info"), ("b", "info")}


def test_traffic(spark):
    body = {"total_visits": {"visits": [{"visits": 10}, {"visits": 1_500_000}]}, "engagement": {"average_visit_duration": 185, "bounce_rate": 0.45, "pages_per_visit": 0}, "pages_per_visit": 2.5, "traffic_sources": {"overview": {"direct": 0.2, "mail": 0.5}}}
    row = intel.traffic(payloads(spark, body, "nothing")).first()
    assert (row.visits_display, row.visit_display, row.bounce_display, row.pages_per_visit) == ("1.5M", "3m 5s", "45.0%", 2.5)
    assert [c.channel for c in row.channels] == ["direct", "email"]


def test_separated_reports(spark):
    frame = payloads(spark, "Ph;Po;Ur;Nq;Td\nshoes;3;https://a.b/c;1000;1.5\nhats;x;u;;2\n", "ERROR 50 :: NOTHING FOUND")
    rows = intel.organic_keywords(intel.separated_rows(frame)).orderBy("keyword").collect()
    assert [(r.keyword, r.position, r.volume) for r in rows] == [("hats", None, None), ("shoes", 3, 1000)]
    buckets = intel.position_buckets(intel.organic_keywords(intel.separated_rows(frame)), F.col("position")).collect()
    assert {r.bucket: r.n for r in buckets} == {"1-3": 1, "4-10": 0, "11-20": 0, "21-100": 0}


def test_keywords_and_accessibility(spark):
    ideas = spark.createDataFrame([("a", 800, 10), ("b", 1200, None), ("c", None, 20)], "keyword string, avg_monthly_searches long, competition_index int")
    row = intel.keyword_summary(ideas).first()
    assert (row.ideas, row.avg_volume, row.max_volume, row.avg_competition) == (3, 1000, 1200, 15)
    body = {"categories": {"error": {"count": 4, "items": {"alt_missing": {"description": "d", "count": 4}}}, "contrast": {"count": 1, "items": {}}, "alert": {"count": 0, "items": {}}}}
    got = intel.accessibility_report(payloads(spark, body)).first()
    assert (got.a_known, got.a_errors, got.a_errors_items) == (True, 4, ["alt_missing"])


def test_scalars_and_urls(spark):
    one = spark.range(1)
    row = one.select(
        S.compact_number(F.lit(85_000)).alias("k"), S.compact_number(F.lit(2_000_000_000)).alias("b"), S.compact_number(F.lit(7)).alias("n"), S.redact(F.lit("GTM-ABC1234")).alias("r"), S.redact(F.lit("x")).alias("x"),
        S.latin1(F.lit("a–b’c中")).alias("l"), U.domain(F.lit(" HTTPS://WWW.Ex.com:80/p")).alias("d"), U.domain(F.lit("  ")).alias("e"), U.crawl_normal(F.lit("https://A.b/c/?q#f")).alias("c"), U.export_normal(F.lit("https://A.b/?q")).alias("x2"),
        U.resolved(F.lit("https://a.b/c/d/e"), F.lit("../../x/./y")).alias("u"), U.is_private_host(F.lit("http://10.0.0.8/x")).alias("p"), S.micros(F.lit(1_234_567)).cast("string").alias("m"),
    ).first()
    assert list(row) == ["85.0K", "2.0B", "7", "GTM********", "x", "a-b'c?", "ex.com", None, "https://A.b/c?q", "https://a.b/", "https://a.b/x/y", True, "1.23"]


def test_history(spark):
    rows = spark.sql("select * from values ('a','1',timestamp'2024-01-01',50),('a','2',timestamp'2024-02-01',70),('b','3',timestamp'2024-01-01',10) t(brand_id,audit_id,created_at,overall_score)")
    assert {r.audit_id: r.delta for r in history.deltas(rows).collect()} == {"1": None, "2": 20, "3": None}
    got = {r.brand_id: (r.audits, r.latest_score, r.previous_score, r.trend) for r in history.overview(rows).collect()}
    assert got == {"a": (2, 70, 50, "up"), "b": (1, 10, None, None)}
    assert history.upsert(rows, rows.where("brand_id = 'a'").limit(1), "audit_id").count() == 3


def test_enrichment(spark):
    frame = spark.createDataFrame([(1, "https://a.b/", '<title>T</title><meta property="og:description" content="O"><link rel="icon" href="/f.ico"><body>our hotel, flight and booking')], "page_id long, url string, html string")
    row = enrich.from_homepage(frame).first()
    assert (row.description, row.description_confidence, row.industry, row.favicon) == ("O", 0.7, "Travel & Hospitality", "https://a.b/f.ico")
    typed = spark.createDataFrame([(" x ", "", "junk", "d" * 600, ["a", " ", "b"])], "industry string, persona string, revenue_range string, description string, competitors array<string>")
    row = enrich.manual(typed).first()
    assert (row.industry, row.persona, row.revenue_range, len(row.description), row.competitors) == ("x", None, None, 500, ["a", "b"])


def test_sinks_and_stream(spark, sf_dir, tmp_path):
    pages = tables.table(spark, sf_dir, "pages")
    tables.write_sheets({"a": pages.select("page_id", F.array("url").alias("urls")).limit(3)}, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/a"), header=True).count() == 3
    tables.write_table(pages.limit(20), str(tmp_path / "in"))
    found = stream.once_per_url(stream.read_pages(spark, str(tmp_path / "in")))
    stream.write(stream.scored(found), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_character_references(spark):
    from pagelumen.functions import html as H

    pairs = {
        "Caf&eacute; &#8217;&rsquo;": "Café ’’",
        "&amp;lt; &&amp;& &": "&lt; &&& &",
        "&#x1F600;&#128;&#X41;&#x00000027;": "😀€A'",
        "&#0;&#xD800;&#99999999999;&#x110000;": "�" * 4,
        "&nosuch; &lt": "&nosuch; &lt",
        "x&nbsp;y&#160;z": "x y z",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in [*pairs, None]], "t string")
    found = {r.t: r.d for r in df.select("t", H.decoded(F.col("t")).alias("d")).collect()}
    assert found == {**pairs, None: None}


def test_one_decimal_as_printed_elsewhere(spark):
    import random

    rng = random.Random(11)
    given = [i / 1000 for i in range(0, 20_000, 50)] + [rng.uniform(0, 1100) for _ in range(300)] + [0.25, 0.75, 1.25, 999.95, 1023.95, 1024.05, 5e6 + 0.05, -1.15, -0.01, -0.05, 0.05, 1e-9]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double")
    got = {r.i: r.t for r in frame.select("i", S.one_decimal(F.col("x")).alias("t")).collect()}
    for i, x in enumerate(given):
        assert got[i] == f"{x:.1f}".replace("-0.0", "0.0"), x
    counts = [*range(1000, 20_000, 50), 1_150_000, 1_250_000, 999_999, 999_950, 1_050_000_000, 7]
    frame = spark.createDataFrame([(n,) for n in counts], "n long")
    want = {n: f"{n / 1e9:.1f}B" if n >= 10**9 else f"{n / 1e6:.1f}M" if n >= 10**6 else f"{n / 1e3:.1f}K" if n >= 1000 else str(n) for n in counts}
    assert {r.n: r.t for r in frame.select("n", S.compact_number(F.col("n")).alias("t")).collect()} == want


def test_full_payloads(spark):
    body = {
        "geo": {"countries": [{"country_name": "X", "traffic_share": 0.5}, {}, "junk"] + [{"country": f"c{i}", "share": i} for i in range(12)]},
        "referrals": {"records": [{"domain": "a.b", "share": 0.1}, {"site": "", "domain": "", "share": None}]},
        "outgoing": {"referrals": "none"},
        "similar_sites": {"records": [{"url": "u", "affinity": 0.9}]},
    }
    row, bare = intel.audience(payloads(spark, body, "nothing")).collect()
    assert [tuple(c) for c in row.countries[:2]] == [("X", 0.5), ("Unknown", 0.0)] and len(row.countries) == 9
    assert [tuple(c) for c in row.referring_sites] == [("a.b", 0.1), ("", None)]
    assert row.destination_sites == [] and [tuple(c) for c in row.similar_sites] == [("u", 0.9)]
    assert bare.countries == bare.referring_sites == bare.similar_sites == []
    ideas = intel.keyword_ideas(payloads(spark, {"results": [{"text": "k", "keywordIdeaMetrics": {"avgMonthlySearches": "10", "competition": "HIGH", "competitionIndex": 3, "lowTopOfPageBidMicros": "x"}}, {}]}, "junk", {"results": []})).orderBy("place").collect()
    assert [tuple(r) for r in ideas] == [(0, "k", 10, "HIGH", 3, None, None), (1, "", None, None, None, None, None)]
    rows = intel.separated_rows(payloads(spark, "total;domains_num\n5;x\n6;7\n", "ERROR 1", "total\n"))
    assert [(r.total_backlinks, r.referring_domains) for r in intel.backlink_overview(rows).collect()] == [(5, None)]
    rows = intel.separated_rows(payloads(spark, "Dn;Cr\n" + "".join(f"d{i};0.{i}\n" for i in range(14)) + "e;\n"))
    assert [(r.domain, r.affinity) for r in intel.organic_competitors(rows).orderBy("position").collect()] == [(f"d{i}", float(f"0.{i}")) for i in range(10)]
    rows = intel.separated_rows(payloads(spark, "Dn;Or;Ot\nd;5;1150\n", "Dn;Or;Ot\nd;5;\n"))
    assert sorted((r.organic_traffic, r.organic_display) for r in intel.organic_traffic(rows).collect()) == [(5.0, "5"), (1150.0, "1.1K")]


def test_report_tables(spark):
    from pagelumen.operators import audit, report

    frame = spark.createDataFrame([(1, "https://a.b/", f"<title>{'t' * 40}</title><h1>x</h1><h3>y</h3><img src=a>"), (2, "https://a.b/c", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.metric): (r.value, r.verdict) for r in report.verdicts(frame).collect()}
    assert got[1, "title_length"] == (40.0, "good") and got[2, "title_length"] == (0.0, "bad")
    assert got[1, "hierarchy_valid"] == (0.0, "bad") and got[1, "missing_alt_count"] == (1.0, "bad") and got[1, "total_images"] == (1.0, None)
    assert (1, "response_time_ms") not in got and got[1, "is_https"] == (1.0, "good") and got[1, "zoom_disabled"] == (0.0, "good")
    found = audit.issues(frame)
    sums = {r.page_id: r for r in report.totals(found).collect()}
    assert sums[1].n_findings == sums[1].n_error + sums[1].n_warning + sums[1].n_info + sums[1].n_pass == found.where("page_id = 1").count()
    rows = report.categories(audit.categories_long(frame, with_issues=False)).where("page_id = 1").orderBy("place").collect()
    assert [(r.category, r.weight_pct) for r in rows[:3]] == [("meta_tags", 10), ("performance", 9), ("ads_quality", 8)]
    assert [r.rule_id for r in audit.top_issues(found).where("page_id = 2").orderBy("rank").collect()][:2] == ["title_missing", "description_missing"]
