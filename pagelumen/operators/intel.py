"""Third-party metrics: raw responses in, typed columns out.

Payloads are text columns (JSON, or semicolon-separated tables), read inside the JVM; what can't be read
becomes null rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.functions.scalars import compact_number, duration, percent

_AUDIT = "STRUCT<numericValue: DOUBLE, score: DOUBLE, title: STRING, description: STRING, details: STRUCT<type: STRING, overallSavingsMs: DOUBLE>>"
PSI = f"lighthouseResult STRUCT<categories: STRUCT<performance: STRUCT<score: DOUBLE>>, audits: MAP<STRING, {_AUDIT}>>"
# Audits with the metrics, their names and decimals.
PSI_METRICS = [("largest-contentful-paint", "lcp_ms", 1), ("first-contentful-paint", "fcp_ms", 1), ("total-blocking-time", "tbt_ms", 1), ("speed-index", "speed_index_ms", 1), ("cumulative-layout-shift", "cls", 4)]


def pagespeed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``score, lcp_ms, fcp_ms, tbt_ms, speed_index_ms, cls, opportunities, diagnostics``.

    Opportunities are the ten of greatest savings; diagnostics the first ten other audits that fail.
    """
    df = df.withColumn("_l", F.from_json(F.col(payload), PSI)["lighthouseResult"])
    audits = F.col("_l.audits")
    made = {"score": (F.col("_l.categories.performance.score") * 100).cast("int")}
    for key, name, digits in PSI_METRICS:
        made[name] = F.bround(F.try_element_at(audits, F.lit(key))["numericValue"], digits)
    rows = F.transform(F.map_entries(audits), lambda e: F.struct((-F.coalesce(e["value"]["details"]["overallSavingsMs"], F.lit(0.0))).alias("order"), e["key"].alias("id"), e["value"]["title"].alias("title"), e["value"]["details"]["type"].alias("kind"), e["value"]["score"].alias("score")))
    opportunities = F.filter(rows, lambda r: (r["kind"] == "opportunity") & (F.coalesce(r["score"], F.lit(0.0)) < 1))
    top = F.slice(F.array_sort(opportunities, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)), 1, 10)
    rest = F.filter(rows, lambda r: (F.coalesce(r["kind"], F.lit("")) != "opportunity") & (r["score"] < 0.9))
    made["opportunities"] = F.transform(top, lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), (-r["order"]).alias("savings_ms")))
    made["diagnostics"] = F.transform(F.slice(rest, 1, 10), lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["score"].alias("score")))
    return df.withColumns(made).drop("_l")


def pagespeed_issues(df: DataFrame) -> DataFrame:
    """One row per issue of a measured page; keeps the other columns."""
    s, lcp, cls, tbt = (F.col(c) for c in ("score", "lcp_ms", "cls", "tbt_ms"))

    def banded(rule: str, value: Column, *bands: tuple[Column, str, str | None]) -> Column:
        out = F.lit(None).cast("struct<rule_id:string,severity:string,impact:string,value:double>")
        for when, severity, impact in reversed(bands):
            out = F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(impact).cast("string").alias("impact"), value.cast("double").alias("value"))).otherwise(out)
        return out

    fixed = F.array(
        banded("psi_score", s, (s >= 90, "pass", None), (s >= 50, "warning", "medium"), (s < 50, "error", "high")),
        banded("lcp", lcp, (lcp > 4000, "error", "high"), (lcp > 2500, "warning", "medium")),
        banded("cls", cls, (cls > 0.25, "error", "high"), (cls > 0.1, "warning", "medium")),
        banded("tbt", tbt, (tbt > 600, "error", "high")),
    )
    saves = F.transform(F.filter(F.slice("opportunities", 1, 3), lambda o: o["savings_ms"] > 100), lambda o: F.struct(o["id"].alias("rule_id"), F.lit("info").alias("severity"), F.when(o["savings_ms"] > 500, "medium").otherwise("low").alias("impact"), o["savings_ms"].alias("value")))
    keep = [c for c in df.columns if c not in ("opportunities", "diagnostics")]
    return df.select(*keep, F.explode(F.concat(F.filter(fixed, lambda i: i.isNotNull()), saves)).alias("i")).select(*keep, "i.*")


# Sources of visits as the payload and as the report names them, in the report's order.
CHANNELS = {"Direct": "direct", "Search": "search", "Social": "social", "Referrals": "referrals", "Mail": "email", "Display Ads": "display"}


def traffic(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds visits, pages per visit, duration and bounce rate with their display forms, and channel shares.

    Of several months the last counts; a zero falls through to the next name of a figure, as a missing one.
    """
    raw = F.try_parse_json(F.col(payload))
    get = lambda path, kind: F.try_variant_get(raw, path, kind)
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in cs))
    months = get("$.total_visits.visits", "array<struct<visits: double>>")
    visits = first(F.try_element_at(months, F.lit(-1))["visits"], get("$.visits", "double"))
    seconds = first(get("$.engagement.average_visit_duration", "double"), get("$.average_visit_duration", "double"))
    bounce = first(get("$.engagement.bounce_rate", "double"), get("$.bounce_rate", "double"))
    shares = get("$.traffic_sources.overview", "map<string, double>")
    # The payload's name, the report's, the payload's in small letters: the first that isn't zero.
    share = lambda raw, name: F.coalesce(first(*(F.try_element_at(shares, F.lit(k)) for k in (raw, name))), F.try_element_at(shares, F.lit(raw.lower())))
    channels = F.filter(F.array(*(F.struct(F.lit(name).alias("channel"), share(raw, name).alias("share")) for raw, name in CHANNELS.items())), lambda c: c["share"].isNotNull())
    return df.withColumns(
        {
            "visits": visits, "visits_display": compact_number(visits), "visit_seconds": seconds, "visit_display": duration(seconds),
            "bounce_rate": bounce, "bounce_display": percent(bounce), "pages_per_visit": first(get("$.engagement.pages_per_visit", "double"), get("$.pages_per_visit", "double")),
            "channels": channels,
        }
    )


def separated_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of a semicolon-separated report with a header, as a map of strings; none for an error report."""
    lines = F.filter(F.split(F.regexp_replace(F.col(payload), "\r", ""), "\n"), lambda x: F.trim(x) != "")
    keep = [c for c in df.columns if c != payload]
    rows = df.where(~F.ltrim(F.col(payload)).startswith("ERROR")).select(*keep, F.split(F.get(lines, F.lit(0)), ";").alias("h"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("position", "line"))
    cells = F.split("line", ";")
    return rows.select(*keep, "position", F.map_from_arrays("h", F.transform("h", lambda x, i: F.get(cells, i))).alias("row"))


# Upper ends of the position buckets.
BUCKETS = [("1-3", 3), ("4-10", 10), ("11-20", 20), ("21-100", 100)]


def position_bucket(position: Column) -> Column:
    """Name of the bucket; null beyond the last and for null."""
    out = F.lit(None).cast("string")
    for name, top in reversed(BUCKETS):
        out = F.when(position <= top, name).otherwise(out)
    return out


def position_buckets(df: DataFrame, position: Column, *by: str) -> DataFrame:
    """Number of keywords per bucket, all buckets, those without any too."""
    counts = df.select(*by, position_bucket(position).alias("bucket")).groupBy(*by).agg(*(F.count_if(F.col("bucket") == name).alias(f"b{i}") for i, (name, _) in enumerate(BUCKETS)))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (name, _) in enumerate(BUCKETS)))).alias("b")
    return counts.select(*by, pairs).select(*by, "b.*")


def organic_keywords(rows: DataFrame) -> DataFrame:
    """Typed keyword rows (``row`` maps): phrase, position, url, volume, traffic share."""
    cell = lambda k, kind: F.expr(f"try_cast(try_element_at(row, '{k}') as {kind})")
    return rows.select(*(c for c in rows.columns if c not in ("row", "position")), cell("Ph", "string").alias("keyword"), cell("Po", "int").alias("position"), cell("Ur", "string").alias("url"), cell("Nq", "long").alias("volume"), cell("Td", "double").alias("traffic_share"))


def referring_domains(backlinks: DataFrame, url: str = "source_url", k: int = 10) -> DataFrame:
    """The k hosts with most backlinks; ties by name."""
    from pagelumen.functions.urls import netloc

    host = F.lower(F.regexp_replace(netloc(F.col(url)), r":\d*$", ""))
    return backlinks.select(host.alias("host")).where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("backlinks")).orderBy(F.desc("backlinks"), "host").limit(k)


def keyword_summary(df: DataFrame, *by: str) -> DataFrame:
    """Number of ideas, mean and greatest volume and mean competition index over those known; half to even."""
    return df.groupBy(*by).agg(
        F.count("*").alias("ideas"), F.bround(F.avg("avg_monthly_searches")).cast("long").alias("avg_volume"), F.max("avg_monthly_searches").alias("max_volume"), F.bround(F.avg("competition_index")).cast("long").alias("avg_competition")
    )


def top_keywords(df: DataFrame, k: int = 10, by: str = "avg_monthly_searches", descending: bool = True) -> DataFrame:
    order = F.coalesce(F.col(by), F.lit(0))
    return df.orderBy(order.desc() if descending else order, "keyword").limit(k)


def accessibility_report(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``a_known, a_errors, a_contrast, a_alerts`` and up to 8, 5 and 5 items of an accessibility report."""
    kind = "categories MAP<STRING, STRUCT<count: INT, items: MAP<STRING, STRUCT<description: STRING, count: INT>>>>"
    got = F.from_json(F.col(payload), kind)["categories"]
    made = {"a_known": got.isNotNull()}
    for key, name, most in (("error", "a_errors", 8), ("contrast", "a_contrast", 5), ("alert", "a_alerts", 5)):
        made[name] = F.try_element_at(got, F.lit(key))["count"]
        made[f"{name}_items"] = F.slice(F.map_keys(F.try_element_at(got, F.lit(key))["items"]), 1, most)
    return df.withColumns(made)


def distinct_keywords(ideas: DataFrame) -> DataFrame:
    """One row per keyword: that of greatest volume."""
    order = Window.partitionBy(F.lower("keyword")).orderBy(F.desc_nulls_last("avg_monthly_searches"), "keyword")
    return ideas.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).drop("n")


def _listed(raw: Column, paths: list[str], first: list[str], second: list[str], most: int = 10) -> Column:
    """array<struct<name, share>> of the first list there is: of each entry the first name and the first share that isn't empty."""
    entries = F.slice(F.coalesce(*(F.try_variant_get(raw, p, "array<variant>") for p in paths), F.array().cast("array<variant>")), 1, most)
    entries = F.filter(entries, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    name = lambda e: F.coalesce(*(F.nullif(F.try_variant_get(e, f"$.{k}", "string"), F.lit("")) for k in first), F.lit(""))
    share = lambda e: F.coalesce(*(F.try_variant_get(e, f"$.{k}", "double") for k in second))
    return F.transform(entries, lambda e: F.struct(name(e).alias("name"), share(e).alias("share")))


def audience(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``countries, referring_sites, destination_sites, similar_sites`` of a traffic payload: arrays of (name, share), ten at most.

    A country without a name is ``Unknown``, one without a share has 0; other entries keep what they lack.
    """
    raw = F.try_parse_json(F.col(payload))
    countries = _listed(raw, ["$.geo.records", "$.geo.countries"], ["country", "country_name"], ["share", "traffic_share"])
    countries = F.transform(countries, lambda c: F.struct(F.when(c["name"] == "", "Unknown").otherwise(c["name"]).alias("name"), F.coalesce(c["share"], F.lit(0.0)).alias("share")))
    sites = lambda key: _listed(raw, [f"$.{key}.referrals", f"$.{key}.records"], ["site", "domain"], ["share"])
    alike = _listed(raw, ["$.similar_sites.similar_sites", "$.similar_sites.records"], ["url", "domain"], ["affinity"])
    return df.withColumns({"countries": countries, "referring_sites": sites("referrals"), "destination_sites": sites("outgoing"), "similar_sites": alike})


def keyword_ideas(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per idea of a planner's payload, with its ``place``; numbers may come as text, and what a payload lacks is null."""
    ideas = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.results", "array<variant>")
    keep = [c for c in df.columns if c != payload]
    rows = df.select(*keep, F.posexplode(ideas).alias("place", "i"))
    whole = lambda key: F.try_variant_get("i", f"$.keywordIdeaMetrics.{key}", "string").try_cast("long")
    return rows.select(
        *keep, "place", F.coalesce(F.try_variant_get("i", "$.text", "string"), F.lit("")).alias("keyword"), whole("avgMonthlySearches").alias("avg_monthly_searches"), F.try_variant_get("i", "$.keywordIdeaMetrics.competition", "string").alias("competition"),
        whole("competitionIndex").alias("competition_index"), whole("lowTopOfPageBidMicros").alias("low_cpc_micros"), whole("highTopOfPageBidMicros").alias("high_cpc_micros"),
    )


def _typed(rows: DataFrame, cells: dict[str, tuple[str, str]], most: int) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("row", "position")]
    typed = [F.expr(f"try_cast(try_element_at(row, '{cell}') as {kind})").alias(name) for name, (cell, kind) in cells.items()]
    return rows.where(F.col("position") < most).select(*keep, "position", *typed)


def backlink_overview(rows: DataFrame) -> DataFrame:
    """The first row of a backlinks report, typed; ``rows`` as of ``separated_rows``."""
    return _typed(rows, {"total_backlinks": ("total", "long"), "referring_domains": ("domains_num", "long"), "follow_count": ("follows_num", "long"), "nofollow_count": ("nofollows_num", "long")}, 1)


def organic_competitors(rows: DataFrame) -> DataFrame:
    """The first ten rows of a competitors report: ``domain, affinity``."""
    return _typed(rows, {"domain": ("Dn", "string"), "affinity": ("Cr", "double")}, 10)


def organic_traffic(rows: DataFrame) -> DataFrame:
    """The traffic estimate of a domain overview, with its display form; without one, the rank stands in."""
    keep = [c for c in rows.columns if c not in ("row", "position")]
    value = F.expr("try_cast(coalesce(nullif(try_element_at(row, 'Ot'), ''), try_element_at(row, 'Or')) as double)")
    return rows.where(F.col("position") == 0).select(*keep, value.alias("organic_traffic"), compact_number(value).alias("organic_display"))
