"""Tracking tags: which vendors' tags pages carry, how they are spread, and what to do about them.

The vendor table is small and fixed, so its tests become generated expressions, evaluated within the scan,
rather than a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.functions.reuse import once_a_session
from pagelumen.functions.scalars import redact
from pagelumen.operators.facts import with_facts

# Vendor, short name, category, pattern of its id, source parts, inline parts, noscript parts, load impact.
VENDORS = [
    ("Google Tag Manager", "GTM", "tag_manager", r"GTM-[A-Z0-9]{4,8}", ["googletagmanager.com/gtm.js"], ["GTM-"], ["googletagmanager.com/ns.html"], "low"),
    ("Google Analytics 4", "GA4", "analytics", r"G-[A-Z0-9]{8,12}", ["googletagmanager.com/gtag/js"], ["gtag(", "G-"], [], "low"),
    ("Google Analytics UA", "UA", "analytics", r"UA-\d{4,10}-\d{1,4}", ["google-analytics.com/analytics.js"], ["UA-"], [], "low"),
    ("Google Ads", "GAds", "advertising", r"AW-\d{8,12}", ["googleadservices.com"], ["AW-"], [], "medium"),
    ("Meta Pixel", "FBP", "advertising", r"\d{15,16}", ["connect.facebook.net"], ["fbq("], [], "medium"),
    ("TikTok Pixel", "TTP", "advertising", r"[A-Z0-9]{18,22}", ["analytics.tiktok.com"], ["ttq.load"], [], "medium"),
    ("Pinterest Tag", "PIN", "advertising", r"\d{13}", ["s.pinimg.com"], ["pintrk"], [], "low"),
    ("Snapchat Pixel", "SNAP", "advertising", r"[a-f0-9-]{36}", ["sc-static.net/scevent"], ["snaptr("], [], "low"),
    ("LinkedIn Insight", "LI", "advertising", r"\d{5,8}", ["snap.licdn.com"], ["_linkedin_partner_id"], [], "low"),
    ("Microsoft/Bing UET", "UET", "advertising", r"\d{7,9}", ["bat.bing.com"], ["uetq"], [], "low"),
    ("Microsoft Clarity", "CLAR", "heatmap", r"[a-z0-9]{8,12}", ["clarity.ms"], ["clarity("], [], "low"),
    ("Hotjar", "HJ", "heatmap", r"\d{6,8}", ["hotjar.com"], ["hj(", "_hjSettings"], [], "medium"),
    ("Segment", "SEG", "analytics", r"[a-zA-Z0-9]{20,32}", ["cdn.segment.com"], ["analytics.load"], [], "medium"),
    ("Klaviyo", "KLAV", "crm", r"[A-Za-z0-9]{6}", ["static.klaviyo.com"], ["_learnq"], [], "low"),
    ("Intercom", "ICOM", "crm", r"[a-z0-9]{8}", ["widget.intercom.io"], ["Intercom("], [], "medium"),
    ("Heap Analytics", "HEAP", "analytics", r"\d{8,12}", ["heapanalytics.com"], ["heap.load"], [], "medium"),
    ("Mixpanel", "MXP", "analytics", r"[a-f0-9]{32}", ["cdn.mxpnl.com"], ["mixpanel.init"], [], "medium"),
    ("Shopify Analytics", "SHOP", "analytics", r"trekkie", ["cdn.shopify.com/s/trekkie"], ["ShopifyAnalytics"], [], "low"),
    ("Lucky Orange", "LO", "heatmap", r"\d{5,8}", ["luckyorange.com"], ["__lo_site_id"], [], "medium"),
]
# Pages of a site that a scan looks at, and where they are looked for. Products have no fixed
# place: any page below PRODUCTS is one.
PAGE_TYPES = {
    "homepage": ["/"],
    "collection": ["/collections", "/collections/all"],
    "product": [],
    "cart": ["/cart"],
    "blog": ["/blogs", "/blogs/news"],
    "page": ["/pages/about", "/pages/contact"],
}
PRODUCTS = "/products/"


def _has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.coalesce(text.contains(part), F.lit(False))
    return out


def _loading(parts: list[str]) -> Column:
    """The scripts whose source holds one of the parts."""
    return F.filter("f_scripts", lambda s: _has_any(s["src"], parts))


def detect(pages: DataFrame) -> DataFrame:
    """``page_id, url, vendor_short, vendor, category, method, location, tag_id, script_url, blocking, load_impact``.

    One row per page and vendor: by a script's source, else inline script, else noscript markup. The tag's
    id is the first match of its pattern over sources, inline scripts and noscript markup.
    """
    noscript = F.array_join(F.regexp_extract_all(F.col("f_markup"), F.lit(r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>"), F.lit(1)), "\n")
    head = F.regexp_extract(F.col("f_markup"), r"(?is)^(.*?)</head\s*>", 1)
    facts = with_facts(pages).select("page_id", "url", "f_scripts", "f_inline", "f_sources", noscript.alias("noscript"), head.alias("head"))
    return facts.select("page_id", "url", F.explode(_by_vendor()).alias("t")).select("page_id", "url", "t.*")


@once_a_session
def _by_vendor() -> Column:
    made = []
    for i, (vendor, short, kind, pattern, sources, inline, nos, load) in enumerate(VENDORS):
        by_source = _loading(sources)
        script = F.get(by_source, F.lit(0))
        where = F.concat_ws("\n", F.array_join("f_sources", "\n"), "f_inline", "noscript")
        method = F.when(F.size(by_source) > 0, "src").when(_has_any(F.col("f_inline"), inline), "inline").when(_has_any(F.col("noscript"), nos), "noscript")
        found = F.regexp_extract(where, f"({pattern})", 1)
        made.append(
            F.when(
                method.isNotNull(),
                F.struct(
                    F.lit(i).alias("priority"), F.lit(short).alias("vendor_short"), F.lit(vendor).alias("vendor"), F.lit(kind).alias("category"), method.alias("method"),
                    F.when((method == "src") & F.col("head").contains(script["src"]), "head").otherwise("body").alias("location"),
                    F.when(found != "", found).alias("tag_id"), script["src"].alias("script_url"),
                    F.coalesce((method == "src") & ~script["async"] & ~script["defer"], F.lit(False)).alias("blocking"), F.lit(load).alias("load_impact"),
                ),
            )
        )
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def redacted(found: DataFrame) -> DataFrame:
    """Ids masked, in scripts' addresses too; done before anything is derived from them."""
    masked = F.when(F.col("tag_id").isNotNull(), F.replace(F.col("script_url"), F.col("tag_id"), redact(F.col("tag_id")))).otherwise(F.col("script_url"))
    return found.withColumn("script_url", masked).withColumn("tag_id", redact(F.col("tag_id")))


def inventory(found: DataFrame) -> DataFrame:
    """One row per vendor and id: on how many pages, and how the first of them loads it. ``pages_of`` lists the pages."""
    first = F.min_by(F.struct("vendor", "category", "method", "location", "script_url", "blocking", "load_impact"), "page_id")
    rows = found.groupBy("vendor_short", "tag_id").agg(F.countDistinct("page_id").alias("page_count"), F.min("url").alias("first_url"), first.alias("a"))
    return rows.select("vendor_short", "tag_id", "page_count", "first_url", "a.*")


def pages_of(found: DataFrame) -> DataFrame:
    """``vendor_short, tag_id, url``: the pages of each row of the inventory, a row each, in no order."""
    return found.select("vendor_short", "tag_id", "url").distinct()


def coverage(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per page: number of tags, the three main ones, and the names of the others."""
    of = lambda v: F.coalesce(F.bool_or(F.col("vendor_short") == v), F.lit(False))
    main = ["GTM", "GA4", "FBP"]
    others = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("vendor_short").isin(main), F.col("vendor_short")))), ", ")
    own = found.groupBy("page_id").agg(F.count("*").alias("tags"), *(of(v).alias(f"has_{v.lower()}") for v in main), others.alias("others"))
    return pages.select("page_id", "url").join(own, "page_id", "left").na.fill({"tags": 0, "others": ""}).na.fill(False)


def recommendations(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``site, rule_id, severity, detail``: what each site's tags call for; a site is a host."""
    from pagelumen.functions.urls import netloc

    site = F.lower(netloc(F.col("url"))).alias("site")
    sites = pages.groupBy(site).agg(F.count("*").alias("total"))
    tagged = found.withColumn("site", F.lower(netloc(F.col("url"))))
    names = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(c, F.col("vendor_short")))), 1, 5), ", ")
    direct = ~F.col("vendor_short").isin("GTM") & (F.col("method") == "src")
    has = lambda v: F.coalesce(F.bool_or(F.col("vendor_short") == v), F.lit(False))
    by_site = tagged.groupBy("site").agg(has("GTM").alias("gtm"), has("GA4").alias("ga4"), has("UA").alias("ua"), names(F.col("blocking")).alias("blocking"), names(direct).alias("direct"))
    flat = sites.join(by_site, "site", "left").na.fill({"blocking": "", "direct": ""}).na.fill(False)
    rule = lambda when, name, severity, detail=None: F.when(when, F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit("") if detail is None else detail).alias("detail")))
    rules = F.array(
        rule(~F.col("gtm"), "tag_manager_missing", "High"),
        rule(~F.col("ga4") & ~F.col("ua"), "analytics_missing", "Critical"),
        rule(F.col("blocking") != "", "blocking_tags", "High", F.col("blocking")),
        rule(F.col("gtm") & (F.col("direct") != ""), "direct_beside_manager", "Medium", F.col("direct")),
        rule(F.col("ua"), "legacy_analytics", "Medium"),
    )
    general = flat.select("site", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("site", "r.*")
    spread = tagged.groupBy("site", "vendor_short", "tag_id").agg(
        F.countDistinct("page_id").alias("on"), F.first("category").alias("category"), F.count("*").alias("times"), F.bool_or(_is_homepage()).alias("home")
    )
    spread = spread.join(sites, "site")
    gaps = spread.where((F.col("on") < F.col("total")) & (F.col("total") > 1) & F.col("home") & (F.col("category") == "advertising"))
    gaps = gaps.select("site", F.lit("coverage_gap").alias("rule_id"), F.lit("Critical").alias("severity"), F.col("vendor_short").alias("detail"))
    twice = spread.where(F.col("times") > F.col("on")).select("site", F.lit("duplicate_tag").alias("rule_id"), F.lit("High").alias("severity"), F.col("vendor_short").alias("detail"))
    return general.unionByName(gaps).unionByName(twice)


def _is_homepage() -> Column:
    from pagelumen.functions.urls import path

    return path(F.col("url")).isin("", "/")


def resolve_page_types(pages: DataFrame) -> DataFrame:
    """``site, page_type, page_id, url``: the first stored page of each type, by the order of its places."""
    from pagelumen.functions.urls import netloc, path

    kinds = []
    for kind, places in PAGE_TYPES.items():
        for i, place in enumerate(places or [PRODUCTS]):
            p = path(F.col("url"))
            fits = F.regexp_replace(p, "/+$", "") == place.rstrip("/") if places else p.startswith(place) & (F.length(p) > len(place))
            kinds.append(F.when(fits, F.struct(F.lit(kind).alias("page_type"), F.lit(i).alias("place"))))
    rows = pages.select(F.lower(netloc(F.col("url"))).alias("site"), "page_id", "url", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("k"))
    order = Window.partitionBy("site", "k.page_type").orderBy("k.place", "page_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).select("site", F.col("k.page_type").alias("page_type"), "page_id", "url")
