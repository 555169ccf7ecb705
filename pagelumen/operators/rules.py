"""The audit's rules, as data: a condition, a severity and a penalty over the fact columns.

A category scores 100 less its penalties, never under 0. Every rule has an id; wording lives in
``WORDING`` so that results stay stable when it changes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelumen.operators.facts import SEMANTIC_TAGS

# Weights of the categories in the overall score, in order of evaluation.
WEIGHTS = {
    "meta_tags": 0.10,
    "performance": 0.09,
    "tracking": 0.07,
    "images": 0.07,
    "links": 0.07,
    "headings": 0.05,
    "mobile": 0.06,
    "semantic": 0.05,
    "structured_data": 0.07,
    "sitemap": 0.05,
    "robots": 0.04,
    "ads_quality": 0.08,
    "serp_features": 0.07,
    "accessibility": 0.13,
}
#: Order in which the overall score adds up, which fixes its floating-point result.
ORDER = ["meta_tags", "headings", "images", "links", "performance", "mobile", "structured_data", "sitemap", "robots", "tracking", "semantic", "ads_quality", "serp_features", "accessibility"]

# Thresholds.
TITLE_LENGTH, DESCRIPTION_LENGTH, H1_LENGTH = (30, 60), (120, 160), 70
SLOW_MS, LARGE_KB = (800, 1500, 3000), (1500, 3000)


@dataclass(frozen=True)
class Rule:
    id: str
    when: Column
    severity: str
    impact: str | None = None
    penalty: Column | int = 0
    evidence: Column | None = None

    def wording(self) -> tuple[str, str | None]:
        """What the rule says, and what to do about it."""
        return WORDING.get(self.id, (self.id.replace("_", " ").capitalize() + ".", None))


@dataclass(frozen=True)
class Category:
    name: str
    rules: list[Rule]
    metrics: dict[str, Column] = field(default_factory=dict)
    start: Column | None = None
    available: Column | None = None

    @functools.cached_property
    def _score(self) -> Column:
        total = F.lit(100) if self.start is None else self.start
        for rule in self.rules:
            if not (isinstance(rule.penalty, int) and rule.penalty == 0):
                penalty = F.lit(rule.penalty) if isinstance(rule.penalty, int) else rule.penalty
                total = total - F.when(rule.when, penalty).otherwise(F.lit(0))
        return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")

    def score(self) -> Column:
        return self._score

    @functools.cached_property
    def _found(self) -> Column:
        made = [F.when(rule.when, F.struct(F.lit(rule.id).alias("rule_id"), (F.lit(None) if rule.evidence is None else rule.evidence).cast("string").alias("evidence"))) for rule in self.rules]
        return F.filter(F.array(*made), lambda i: i.isNotNull())

    @functools.cached_property
    def _named(self) -> Column:
        return F.array_compact(F.array(*(F.when(rule.when, F.lit(rule.id)) for rule in self.rules)))

    def named(self) -> Column:
        """array<string> of the names of the rules that hold, in rule order."""
        return self._named

    def found(self) -> Column:
        """array<struct<rule_id, evidence>> of the issues, in rule order."""
        return self._found


def _capped(most: int, each: int, n: Column) -> Column:
    return F.least(F.lit(most), n * each)


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def meta_tags() -> Category:
    title, description = F.coalesce(F.col("f_title"), F.lit("")), F.trim(F.coalesce(F.col("f_description"), F.lit("")))
    t, d = F.length(title), F.length(description)
    missing = F.array_except(F.array(*(F.lit(f"og:{p}") for p in ("title", "description", "image", "url"))), F.col("f_og"))
    return Category(
        "meta_tags",
        [
            Rule("title_missing", t == 0, "error", "high", 25),
            Rule("title_short", (t > 0) & (t < TITLE_LENGTH[0]), "warning", "medium", 10, title),
            Rule("title_long", t > TITLE_LENGTH[1], "warning", "medium", 10, title),
            Rule("title_ok", t.between(*TITLE_LENGTH), "pass"),
            Rule("description_missing", d == 0, "error", "high", 20),
            Rule("description_short", (d > 0) & (d < DESCRIPTION_LENGTH[0]), "warning", "medium", 10, description),
            Rule("description_long", d > DESCRIPTION_LENGTH[1], "warning", "low", 5, description),
            Rule("description_ok", d.between(*DESCRIPTION_LENGTH), "pass"),
            Rule("canonical_missing", F.col("f_canonical").isNull(), "warning", "medium", 10),
            Rule("canonical_ok", F.col("f_canonical").isNotNull(), "pass", evidence=F.col("f_canonical")),
            Rule("og_incomplete", F.size(missing) > 0, "warning", "medium", _capped(15, 4, F.size(missing)), F.array_join(missing, ", ")),
            Rule("og_ok", F.size(missing) == 0, "pass"),
            Rule("twitter_missing", ~F.col("f_twitter"), "info", "low", 5),
            Rule("lang_missing", _blank(F.col("f_lang")), "warning", "medium", 5),
        ],
        {"title_length": t, "description_length": d, "has_canonical": F.col("f_canonical").isNotNull(), "og_tags_count": F.col("f_og_count"), "has_lang": ~_blank(F.col("f_lang"))},
    )


def headings() -> Category:
    h1 = F.filter("f_headings", lambda h: h["level"] == 1)
    n, text = F.size(h1), F.get(F.transform(h1, lambda h: h["text"]), F.lit(0))
    levels = F.array_sort(F.array_distinct(F.transform("f_headings", lambda h: h["level"])))
    steps = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    skips = F.transform(F.filter(steps, lambda s: s["b"] - s["a"] > 1), lambda s: F.concat(F.lit("H"), s["a"].cast("string"), F.lit(" > H"), s["b"].cast("string")))
    counts = F.transform(levels, lambda v: F.concat(F.lit("H"), v.cast("string"), F.lit(": "), F.size(F.filter("f_headings", lambda h: h["level"] == v)).cast("string")))
    return Category(
        "headings",
        [
            Rule("h1_missing", n == 0, "error", "high", 30),
            Rule("h1_several", n > 1, "warning", "medium", 15, F.array_join(F.transform(h1, lambda h: F.substring(h["text"], 1, 50)), "; ")),
            Rule("h1_empty", (n == 1) & (text == ""), "error", "high", 20),
            Rule("h1_long", (n == 1) & (F.length(text) > H1_LENGTH), "warning", "low", 10, text),
            Rule("h1_ok", (n == 1) & F.length(text).between(1, H1_LENGTH), "pass", evidence=text),
            # Each skip is an issue; six levels have room for two.
            Rule("level_skipped", F.size(skips) > 0, "warning", "medium", 10, F.get(skips, F.lit(0))),
            Rule("level_skipped_again", F.size(skips) > 1, "warning", "medium", 10, F.get(skips, F.lit(1))),
            Rule("hierarchy_ok", (F.size(skips) == 0) & (F.size(levels) > 1), "pass"),
            Rule("headings_missing", F.size("f_headings") == 0, "error", "high", 20),
            Rule("headings_counted", F.size("f_headings") > 0, "info", evidence=F.array_join(counts, ", ")),
        ],
        {"h1_count": n, "h1_text": F.substring(F.coalesce(text, F.lit("")), 1, 80), "total_headings": F.size("f_headings"), "hierarchy_valid": F.size(skips) == 0},
    )


def images() -> Category:
    total = F.size("f_images")

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("f_images", test))

    no_alt = count(lambda i: i["alt"].isNull())
    empty_alt = count(lambda i: F.coalesce(F.trim(i["alt"]) == "", F.lit(False)))
    no_size = count(lambda i: (F.coalesce(i["width"], F.lit("")) == "") | (F.coalesce(i["height"], F.lit("")) == ""))
    eager = count(lambda i: ~F.coalesce(F.lower(i["loading"]) == "lazy", F.lit(False)))
    shown = F.array_join(F.slice(F.transform(F.filter("f_images", lambda i: i["alt"].isNull()), lambda i: F.substring(i["src"], 1, 80)), 1, 5), ", ")
    return Category(
        "images",
        [
            Rule("images_none", total == 0, "info"),
            Rule("alt_missing", no_alt > 0, "error", "high", _capped(40, 5, no_alt), shown),
            Rule("alt_empty", empty_alt > 0, "info", "low", 0, empty_alt),
            Rule("alt_ok", (total > 0) & (no_alt == 0), "pass"),
            Rule("size_missing", no_size > 0, "warning", "medium", _capped(20, 3, no_size), no_size),
            Rule("lazy_missing", (total > 3) & (eager > 3), "warning", "medium", 10, eager),
        ],
        {"total_images": total, "missing_alt": no_alt, "empty_alt": empty_alt, "missing_dimensions": no_size, "lazy_loaded": total - eager},
    )


def _link_kinds() -> tuple[Column, Column, Column, Column]:
    """(invalid, internal, external, nofollow internal) counts. Whatever names no other host is internal."""

    def invalid(a: Column) -> Column:
        href = F.trim(F.coalesce(a["href"], F.lit("")))
        return (href == "") | (href == "#") | href.startswith("javascript:")

    def host(a: Column) -> Column:
        return F.regexp_extract(F.trim(a["href"]), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)

    valid = F.filter("f_anchors", lambda a: ~invalid(a))
    external = F.filter(valid, lambda a: (host(a) != "") & (host(a) != F.col("f_host")))
    internal = F.filter(valid, lambda a: (host(a) == "") | (host(a) == F.col("f_host")))
    nofollow = F.filter(internal, lambda a: F.array_contains(a["rel"], "nofollow"))
    return F.size(F.filter("f_anchors", invalid)), F.size(internal), F.size(external), F.size(nofollow)


def links() -> Category:
    invalid, internal, external, nofollow = _link_kinds()
    total = F.size("f_anchors")
    return Category(
        "links",
        [
            Rule("href_empty", invalid > 0, "warning", "medium", _capped(15, 3, invalid), invalid),
            Rule("nofollow_internal", nofollow > 0, "warning", "medium", _capped(15, 5, nofollow), nofollow),
            Rule("internal_none", (internal == 0) & (total > 0), "error", "high", 20),
            Rule("internal_ok", internal > 0, "pass", evidence=internal),
            Rule("external_none", (external == 0) & (total > 5), "info", "low"),
        ],
        {"total_links": total, "internal_links": internal, "external_links": external, "nofollow_links": nofollow, "empty_links": invalid},
    )


def performance() -> Category:
    ms, kb, blocking = F.col("elapsed_ms"), F.col("f_size_kb"), F.col("f_blocking")
    return Category(
        "performance",
        [
            Rule("response_very_slow", F.coalesce(ms > SLOW_MS[2], F.lit(False)), "error", "high", 25, ms),
            Rule("response_slow", F.coalesce((ms > SLOW_MS[1]) & (ms <= SLOW_MS[2]), F.lit(False)), "warning", "medium", 15, ms),
            Rule("response_moderate", F.coalesce((ms > SLOW_MS[0]) & (ms <= SLOW_MS[1]), F.lit(False)), "info", "low", 5, ms),
            Rule("response_ok", F.coalesce(ms <= SLOW_MS[0], F.lit(False)), "pass"),
            Rule("page_very_large", kb > LARGE_KB[1], "error", "high", 25, F.round(kb, 1)),
            Rule("page_large", (kb > LARGE_KB[0]) & (kb <= LARGE_KB[1]), "warning", "medium", 10, F.round(kb, 1)),
            Rule("page_size_ok", kb <= LARGE_KB[0], "pass"),
            Rule("not_https", F.col("f_scheme") != "https", "error", "high", 20),
            Rule("blocking_many", blocking > 3, "warning", "medium", 10, blocking),
            Rule("blocking_some", blocking.between(1, 3), "info", "low", 0, blocking),
        ],
        {"response_ms": ms, "page_size_kb": kb, "is_https": F.col("f_scheme") == "https", "render_blocking_scripts": blocking},
    )


def mobile() -> Category:
    viewport, has = F.coalesce("f_viewport", F.lit("")), F.col("f_viewport").isNotNull()
    no_zoom = viewport.rlike(r"user-scalable\s*=\s*no") | viewport.rlike(r"maximum-scale\s*=\s*1(?:\.0+)?(?![\d.])")
    wide = F.col("f_wide_styles")
    return Category(
        "mobile",
        [
            Rule("viewport_missing", ~has, "error", "high", 40),
            Rule("viewport_ok", has, "pass", evidence=F.substring(viewport, 1, 80)),
            Rule("viewport_not_device_width", has & ~viewport.contains("width=device-width"), "warning", "medium", 15),
            Rule("zoom_disabled", has & no_zoom, "warning", "medium", 15),
            Rule("fixed_widths", wide > 0, "warning", "medium", _capped(20, 5, wide), wide),
            Rule("media_queries_ok", F.col("f_media_queries"), "pass"),
            Rule("media_queries_none", ~F.col("f_media_queries"), "info", "low"),
        ],
        {"has_viewport": has, "zoom_disabled": has & no_zoom, "fixed_width_elements": wide, "has_media_queries": F.col("f_media_queries")},
    )


def semantic() -> Category:
    counts = F.col("f_tag_counts")
    found = F.filter(F.array(*(F.when(counts[t] > 0, F.lit(t)) for t in SEMANTIC_TAGS)), lambda t: t.isNotNull())
    # By rint, as bround goes by the decimal that names the double, and the quotient of a tie may miss it: 1279 of 2000 are 64.0.
    tenths = F.rint(F.length("f_body_text") / F.col("f_html_length") * 100 * 10)
    ratio = F.when(F.col("f_has_body") & (F.col("f_html_length") > 0), tenths / 10).otherwise(F.lit(0.0))
    has = F.col("f_has_body") & (F.col("f_html_length") > 0)
    main = counts["main"]
    return Category(
        "semantic",
        [
            Rule("semantic_ok", F.size(found) > 0, "pass", evidence=F.array_join(found, ", ")),
            Rule("semantic_none", F.size(found) == 0, "error", "high"),
            Rule("main_missing", main == 0, "error", "high", 20),
            Rule("main_ok", main == 1, "pass"),
            Rule("main_several", main > 1, "warning", "medium", 10, main),
            Rule("nav_missing", counts["nav"] == 0, "warning", "medium", 15),
            Rule("nav_ok", counts["nav"] > 0, "pass", evidence=counts["nav"]),
            Rule("header_missing", counts["header"] == 0, "warning", "low", 10),
            Rule("footer_missing", counts["footer"] == 0, "warning", "low", 10),
            Rule("roles_ok", F.size("f_roles") > 0, "pass", evidence=F.array_join("f_roles", ", ")),
            Rule("roles_none", F.size("f_roles") == 0, "info", "low"),
            Rule("ratio_ok", has & (ratio >= 25), "pass", evidence=ratio),
            Rule("ratio_moderate", has & (ratio >= 10) & (ratio < 25), "info", None, 0, ratio),
            Rule("ratio_low", has & (ratio < 10), "warning", "medium", 15, ratio),
            Rule("lists_found", (counts["ul"] > 0) | (counts["ol"] > 0), "info"),
            Rule("lists_none", (counts["ul"] == 0) & (counts["ol"] == 0), "info"),
            Rule("figures_found", counts["figure"] > 0, "info", None, 0, counts["figcaption"]),
            Rule("times_found", counts["time"] > 0, "info", None, 0, F.col("f_times_dated")),
        ],
        {"semantic_elements": F.size(found), "aria_roles": F.size("f_roles"), "content_to_html_ratio": ratio, "main_count": main},
    )


def tracker_flags() -> dict[str, Column]:
    """Which trackers a page loads, from script sources, inline scripts and the markup."""
    inline, html = F.col("f_inline"), F.col("html")

    def loads(*parts: str) -> Column:
        return F.exists("f_sources", lambda s: reduce(or_, (s.contains(part) for part in parts)))

    return {
        "gsc": F.exists("f_metas", lambda m: F.coalesce(m["name"] == "google-site-verification", F.lit(False))),
        "ga4": (inline.contains("gtag(") & inline.contains("G-")) | loads("googletagmanager.com/gtag"),
        "ua": html.rlike(r"UA-\d{4,10}-\d{1,4}"),
        "gtm": loads("gtm.js", "googletagmanager.com") | html.rlike(r"GTM-[A-Z0-9]+"),
        "facebook": loads("connect.facebook.net") | inline.contains("fbq("),
        "linkedin": loads("snap.licdn.com") | inline.contains("_linkedin_partner_id"),
        "tiktok": loads("analytics.tiktok.com") | inline.contains("ttq.load"),
        "pinterest": loads("s.pinimg.com") | inline.contains("pintrk"),
        "bing": loads("bat.bing.com") | inline.contains("bat.bing.com"),
        "hotjar": loads("hotjar.com") | inline.contains("hotjar.com"),
        "clarity": loads("clarity.ms") | inline.contains("clarity.ms"),
    }


def tracking() -> Category:
    flags = tracker_flags()
    pixels = ["facebook", "linkedin", "tiktok", "pinterest", "bing", "hotjar", "clarity"]
    any_pixel = F.lit(False)
    for p in pixels:
        any_pixel = any_pixel | flags[p]
    measured = flags["ga4"] | flags["ua"]
    return Category(
        "tracking",
        [
            Rule("gsc_missing", ~flags["gsc"], "error", "high", 25),
            Rule("gsc_ok", flags["gsc"], "pass"),
            Rule("ga4_ok", flags["ga4"], "pass"),
            Rule("ua_legacy", ~flags["ga4"] & flags["ua"], "warning", "medium"),
            Rule("gtm_ok", flags["gtm"], "pass"),
            Rule("gtm_missing", ~flags["gtm"], "warning", "medium", 15),
            *(Rule(f"pixel_{p}", flags[p], "info") for p in pixels),
            Rule("nothing_measures", ~measured & ~any_pixel, "error", "high", 30),
            Rule("analytics_missing", ~measured & any_pixel, "warning", "medium", 15),
        ],
        flags,
    )


# What counts as conversion tracking.
CONVERSION = {
    "ga4": r"(?i)gtag\(|googletagmanager\.com|google-analytics\.com|GA1\.",
    "gtm": r"(?i)gtm\.js|GTM-[A-Z0-9]+",
    "google_ads": r"(?i)googleads\.g\.doubleclick\.net|AW-[0-9]+|conversion\.js",
    "facebook": r"(?i)fbq\(|connect\.facebook\.net/.*fbevents",
}


def ads_quality() -> Category:
    ms, words = F.col("elapsed_ms"), _words("f_body_text")
    conversion = F.lit(False)
    for pattern in CONVERSION.values():
        conversion = conversion | F.col("html").rlike(pattern)
    has_h1 = F.exists("f_headings", lambda h: h["level"] == 1)
    titled, forms = ~_blank(F.col("f_title")), F.col("f_tag_counts")["form"]
    complete = (F.col("f_tag_counts")["label"] > 0) & (F.col("f_submits") > 0)
    return Category(
        "ads_quality",
        [
            Rule("ads_not_https", F.col("f_scheme") != "https", "error", "high", 15),
            Rule("ads_fast", F.coalesce(ms < 1000, F.lit(False)), "pass"),
            Rule("ads_moderate", F.coalesce((ms >= 1000) & (ms < 3000), F.lit(False)), "warning", "medium", 5, ms),
            Rule("ads_slow", F.coalesce(ms >= 3000, F.lit(False)), "error", "high", 15, ms),
            Rule("ads_no_viewport", F.col("f_viewport").isNull(), "error", "high", 15),
            Rule("ads_thin", words < 100, "warning", "medium", 10, words),
            Rule("ads_short", words.between(100, 299), "info", "low", 3, words),
            Rule("ads_content_ok", words >= 300, "pass", evidence=words),
            Rule("ads_no_title", ~titled, "warning", "medium", 5),
            Rule("ads_no_h1", titled & ~has_h1, "info", "low", 2),
            Rule("conversion_missing", ~conversion, "warning", "medium", 10),
            Rule("conversion_ok", conversion, "pass"),
            Rule("cta_missing", F.col("f_ctas") == 0, "warning", "medium", 5),
            Rule("cta_ok", F.col("f_ctas") > 0, "pass", evidence=F.col("f_ctas")),
            Rule("forms_ok", (forms > 0) & complete, "pass", evidence=forms),
            Rule("forms_incomplete", (forms > 0) & ~complete, "info", None, 0, forms),
            Rule("ad_schema_ok", F.col("s_ad_schema"), "pass"),
        ],
        {"word_count": words, "cta_count": F.col("f_ctas"), "form_count": forms, "has_conversion_tracking": conversion},
    )


def _words(column: str) -> Column:
    return F.when(F.col(column) == "", F.lit(0)).otherwise(F.size(F.split(column, " ")))


#: Features that make a full score.
MOST_FEATURES = 8


def serp_features() -> Category:
    robots = F.array_join("f_robots_metas", ",")
    links = F.size(F.filter("f_anchors", lambda a: a["href"].isNotNull()))
    sitelinks = (F.col("f_nav_links") >= 4) & (links >= 10)
    pack = F.size(F.filter("f_images", lambda i: ~_blank(i["alt"]))) >= 3
    features = F.size("s_features") + sitelinks.cast("int") + pack.cast("int")
    noindex, nosnippet = robots.contains("noindex"), robots.contains("nosnippet")
    no_length = robots.rlike(r"max-snippet:\s*0(?!\d)")
    blocked = F.greatest(F.when(noindex, 30).otherwise(0), F.when(nosnippet, 20).otherwise(0), F.when(no_length, 10).otherwise(0))
    other = F.coalesce((F.col("f_canonical") != "") & (F.regexp_replace("f_canonical", "/+$", "") != F.regexp_replace("url", "/+$", "")), F.lit(False))
    return Category(
        "serp_features",
        [
            Rule("features_found", features > 0, "pass", evidence=features),
            Rule("features_none", features == 0, "warning", "medium"),
            Rule("sitelinks_ok", sitelinks, "pass"),
            Rule("image_pack_ok", pack, "pass"),
            Rule("snippets_blocked", blocked > 0, "error", "high", blocked, robots),
            Rule("canonical_elsewhere", other, "warning", "medium", 5, F.col("f_canonical")),
        ],
        {"features": features, "sitelinks": sitelinks, "image_pack": pack},
        start=F.floor(features / F.lit(float(MOST_FEATURES)) * 100).cast("int"),
    )


def structured_data() -> Category:
    none, micro = ~F.col("s_has_jsonld"), F.col("f_microdata")
    return Category(
        "structured_data",
        [
            Rule("jsonld_missing", none, "warning", "high", 25),
            Rule("jsonld_ok", ~none, "pass"),
            Rule("microdata_missing", none & ~micro, "warning", "medium", 10),
            Rule("microdata_ok", micro, "info"),
            Rule("rdfa_found", F.col("f_rdfa"), "info"),
            Rule("rich_properties_missing", F.col("s_rich_missing") > 0, "warning", "medium", F.col("s_rich_missing") * 5, F.col("s_rich_missing")),
            Rule("rich_eligible", F.col("s_rich_eligible"), "pass"),
            Rule("structured_none", none & ~micro, "error", "high", 15),
        ],
        {"has_jsonld": ~none, "has_microdata": micro, "has_rdfa": F.col("f_rdfa"), "types": F.array_join("s_types", ", "), "rich_snippet_eligible": F.col("s_rich_eligible")},
    )


def robots() -> Category:
    """Needs ``r_body`` (null: missing or empty), ``r_sitemaps``, ``r_blocked`` and ``r_full_block``."""
    missing = F.coalesce(F.trim("r_body"), F.lit("")) == ""
    return Category(
        "robots",
        [
            Rule("robots_missing", missing, "warning", "medium", 20),
            Rule("robots_ok", ~missing, "pass"),
            Rule("robots_no_sitemap", ~missing & (F.col("r_sitemaps") == 0), "warning", "medium", 10),
            Rule("robots_blocks_page", ~missing & F.col("r_blocked"), "error", "high", 25),
            Rule("robots_blocks_all", ~missing & F.col("r_full_block"), "error", "high", 25),
        ],
        available=F.col("r_known"),
    )


def sitemap() -> Category:
    """Needs ``m_status, m_is_xml, m_urls, m_stale, m_foreign, m_has_page``."""
    reached = F.coalesce(F.col("m_status") == 200, F.lit(False))
    xml = reached & F.col("m_is_xml")
    return Category(
        "sitemap",
        [
            Rule("sitemap_unreachable", ~reached, "error", "high", 40),
            Rule("sitemap_not_xml", reached & ~F.col("m_is_xml"), "warning", "medium", 20),
            Rule("sitemap_empty", xml & (F.col("m_urls") == 0), "warning", "medium", 15),
            Rule("sitemap_stale", xml & (F.col("m_stale") > 0), "warning", "low", 10, F.col("m_stale")),
            Rule("sitemap_foreign", xml & (F.col("m_foreign") > 0), "warning", "low", 10, F.col("m_foreign")),
            Rule("sitemap_has_page", xml & F.col("m_has_page"), "pass"),
            Rule("sitemap_lacks_page", xml & (F.col("m_urls") > 0) & ~F.col("m_has_page"), "info", "low"),
        ],
        available=F.col("m_known"),
    )


def accessibility() -> Category:
    """Needs ``a_errors, a_contrast, a_alerts`` of an accessibility report."""
    e, c, a = (F.coalesce(F.col(f"a_{k}"), F.lit(0)) for k in ("errors", "contrast", "alerts"))
    return Category(
        "accessibility",
        [
            Rule("accessibility_errors", e > 0, "error", "high", _capped(40, 3, e), e),
            Rule("contrast_errors", c > 0, "warning", "medium", _capped(20, 2, c), c),
            Rule("accessibility_alerts", a > 0, "info", "low", _capped(15, 1, a), a),
            Rule("accessibility_ok", (e == 0) & (c == 0), "pass"),
        ],
        available=F.col("a_known"),
    )


CATEGORIES: dict[str, Callable[[], Category]] = {
    f.__name__: f for f in (meta_tags, headings, images, links, performance, mobile, structured_data, sitemap, robots, tracking, semantic, ads_quality, serp_features, accessibility)
}

#: Rule id: what it says, and what to do about it.
WORDING: dict[str, tuple[str, str | None]] = {
    "title_missing": ("The page has no title.", "Give the page a title that names its subject."),
    "title_short": ("The title is short.", "Use 30 to 60 characters."),
    "title_long": ("The title will be cut in result lists.", "Use 30 to 60 characters."),
    "description_missing": ("There is no meta description.", "Summarise the page in 120 to 160 characters."),
    "description_short": ("The meta description is short.", "Use 120 to 160 characters."),
    "description_long": ("The meta description will be cut.", "Use 120 to 160 characters."),
    "canonical_missing": ("No canonical link is declared.", "Declare the page's preferred address."),
    "og_incomplete": ("Open Graph tags are missing.", "Declare title, description, image and url."),
    "twitter_missing": ("There is no card for short-message sites.", "Add card tags."),
    "lang_missing": ("The document's language isn't declared.", "Set lang on the html element."),
    "h1_missing": ("There is no main heading.", "Add one h1."),
    "h1_several": ("There are several main headings.", "Keep one h1."),
    "h1_empty": ("The main heading is empty.", "Write a heading."),
    "h1_long": ("The main heading is long.", "Keep it within 70 characters."),
    "level_skipped": ("A heading level is skipped.", "Go down one level at a time."),
    "level_skipped_again": ("A second heading level is skipped.", "Go down one level at a time."),
    "headings_missing": ("The page has no headings at all.", "Structure the page by headings."),
    "headings_counted": ("Headings of each level.", None),
    "alt_missing": ("Images lack alternative text.", "Describe each image, or mark it decorative by an empty alt."),
    "size_missing": ("Images lack their dimensions.", "State width and height to avoid layout shifts."),
    "lazy_missing": ("Many images load eagerly.", "Load images below the fold lazily."),
    "href_empty": ("Some links lead nowhere.", "Give every link a target."),
    "nofollow_internal": ("Internal links are marked nofollow.", "Remove nofollow from them."),
    "internal_none": ("No link leads to the site's own pages.", "Link related pages."),
    "response_very_slow": ("The response takes over three seconds.", "Look for slow back-end work."),
    "response_slow": ("The response is slow.", "Cache what can be cached."),
    "page_very_large": ("The page is over 3 MB.", "Split or shrink it."),
    "page_large": ("The page is over 1.5 MB.", "Shrink it."),
    "not_https": ("The page isn't served over TLS.", "Redirect to https."),
    "blocking_many": ("Many scripts block rendering.", "Defer them or load them asynchronously."),
    "viewport_missing": ("There is no viewport declaration.", "Declare width=device-width."),
    "viewport_not_device_width": ("The viewport isn't the device's width.", "Declare width=device-width."),
    "zoom_disabled": ("Zooming is disabled.", "Allow zooming."),
    "fixed_widths": ("Elements have large fixed widths.", "Use relative widths."),
    "main_missing": ("There is no main element.", "Wrap the main content in one main element."),
    "main_several": ("There are several main elements.", "Keep one."),
    "nav_missing": ("There is no nav element.", "Mark up navigation."),
    "ratio_low": ("Little of the page is text.", "Reduce markup."),
    "gsc_missing": ("Site ownership isn't verified.", "Add the verification tag."),
    "ua_legacy": ("A retired analytics version is in use.", "Migrate."),
    "gtm_missing": ("No tag manager was found.", "Manage tags in one place."),
    "nothing_measures": ("Nothing measures visits.", "Install analytics."),
    "analytics_missing": ("There are pixels but no analytics.", "Install analytics."),
    "jsonld_missing": ("There is no JSON-LD.", "Describe the page's subject in JSON-LD."),
    "structured_none": ("There is no structured data.", "Add structured data."),
    "rich_properties_missing": ("Required properties of rich results are missing.", "Add them."),
    "snippets_blocked": ("Robots directives keep the page out of results or without a snippet.", "Review them."),
    "canonical_elsewhere": ("The canonical address is another page.", "Check that this is meant."),
}
