"""What a report shows, as tables: totals, categories by weight, and metrics with a verdict. Nothing is drawn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelumen.functions.scalars import score_band
from pagelumen.operators import audit
from pagelumen.operators.rules import WEIGHTS

Test = Callable[[Column], Column] | None
_YES: Test = lambda v: v == 1
_NONE: Test = lambda v: v == 0
_SOME: Test = lambda v: v > 0

# A metric's label, its unit, and what is good of it (none: it is only shown); truth values count as 1 and 0.
METRICS: dict[str, tuple[str, str, Test]] = {
    "response_time_ms": ("Response Time", "ms", lambda v: v < 800),
    "page_size_kb": ("Page Size", "KB", lambda v: v < 1500),
    "is_https": ("HTTPS", "", _YES),
    "blocking_scripts_count": ("Blocking Scripts", "", _NONE),
    "title_length": ("Title Length", "chars", lambda v: v.between(30, 60)),
    "description_length": ("Description", "chars", lambda v: v.between(70, 160)),
    "has_canonical": ("Canonical", "", _YES),
    "og_tags_count": ("OG Tags", "", lambda v: v >= 4),
    "has_lang": ("Lang Attr", "", _YES),
    "h1_count": ("H1 Count", "", lambda v: v == 1),
    "total_headings": ("Total Headings", "", _SOME),
    "hierarchy_valid": ("Hierarchy", "", _YES),
    "total_images": ("Total Images", "", None),
    "missing_alt_count": ("Missing Alt", "", _NONE),
    "missing_dimensions_count": ("Missing Dims", "", _NONE),
    "total_links": ("Total Links", "", None),
    "internal_links": ("Internal Links", "", _SOME),
    "external_links": ("External Links", "", None),
    "empty_invalid": ("Empty/Invalid", "", _NONE),
    "nofollow_internal": ("Nofollow Internal", "", _NONE),
    "has_viewport": ("Viewport", "", _YES),
    "zoom_disabled": ("Zoom Disabled", "", _NONE),
    "fixed_width_elements": ("Fixed Width", "", _NONE),
    "has_media_queries": ("Media Queries", "", _YES),
    "rich_snippets_eligible": ("Rich Snippets", "", _YES),
    "ga4": ("GA4", "", _YES),
    "gtm": ("GTM", "", _YES),
    "semantic_elements": ("Semantic Elements", "", lambda v: v >= 4),
    "aria_roles": ("ARIA Roles", "", None),
    "content_to_html_ratio": ("Content Ratio", "%", lambda v: v >= 25),
    "main_count": ("<main> Count", "", lambda v: v == 1),
    "word_count": ("Word Count", "", lambda v: v >= 300),
    "cta_count": ("CTAs Found", "", _SOME),
    "eligible_count": ("Eligible Features", "", lambda v: v >= 3),
    "sitelinks_eligible": ("Sitelinks", "", _YES),
    "image_pack_eligible": ("Image Pack", "", _YES),
}
#: The metrics that a category shows, by the name its evaluation gives them.
SHOWN: dict[str, dict[str, str]] = {
    "meta_tags": {n: n for n in ("title_length", "description_length", "has_canonical", "og_tags_count", "has_lang")},
    "headings": {n: n for n in ("h1_count", "total_headings", "hierarchy_valid")},
    "images": {"total_images": "total_images", "missing_alt": "missing_alt_count", "missing_dimensions": "missing_dimensions_count"},
    "links": {"total_links": "total_links", "internal_links": "internal_links", "external_links": "external_links", "empty_links": "empty_invalid", "nofollow_links": "nofollow_internal"},
    "performance": {"response_ms": "response_time_ms", "page_size_kb": "page_size_kb", "is_https": "is_https", "render_blocking_scripts": "blocking_scripts_count"},
    "mobile": {n: n for n in ("has_viewport", "zoom_disabled", "fixed_width_elements", "has_media_queries")},
    "structured_data": {"rich_snippet_eligible": "rich_snippets_eligible"},
    "tracking": {"ga4": "ga4", "gtm": "gtm"},
    "semantic": {n: n for n in ("semantic_elements", "aria_roles", "content_to_html_ratio", "main_count")},
    "ads_quality": {"word_count": "word_count", "cta_count": "cta_count"},
    "serp_features": {"features": "eligible_count", "sitelinks": "sitelinks_eligible", "image_pack": "image_pack_eligible"},
}


def verdicts(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``page_id, category, metric, label, unit, value, verdict``: every metric shown that is known, and whether it is good."""
    facts = audit.parsed(pages)
    made = []
    for name in names or SHOWN:
        found = audit.category(name).metrics
        for own, metric in SHOWN[name].items():
            label, unit, good = METRICS[metric]
            value = found[own].cast("double")
            made.append(F.struct(F.lit(name).alias("category"), F.lit(metric).alias("metric"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), value.alias("value")))
    rows = facts.select("page_id", F.explode(F.array(*made)).alias("m")).select("page_id", "m.*").where(F.col("value").isNotNull())
    verdict = F.lit(None).cast("string")
    for metric, (_, _, good) in METRICS.items():
        if good is not None:
            verdict = F.when(F.col("metric") == metric, F.when(good(F.col("value")), "good").otherwise("bad")).otherwise(verdict)
    return rows.withColumn("verdict", verdict)


def totals(found: DataFrame) -> DataFrame:
    """Per page its findings in all and by severity: the first line of a report's summary."""
    rows = audit.severity_counts(found, "page_id")
    return rows.withColumn("n_findings", sum((F.col(f"n_{s}") for s in audit.SEVERITY), F.lit(0)))


def categories(long: DataFrame) -> DataFrame:
    """Per page its categories as a report lists them: heaviest first, with their weight in per cent and the score's band."""
    weight = F.lit(0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("category") == name, int(w * 100)).otherwise(weight)
    heavier = [n for n in sorted(WEIGHTS, key=lambda n: -WEIGHTS[n])]  # of equal ones the first evaluated
    return long.select("page_id", "category", "score", weight.alias("weight_pct"), score_band(F.col("score")).alias("band"), F.array_position(F.array(*map(F.lit, heavier)), F.col("category")).cast("int").alias("place"))
