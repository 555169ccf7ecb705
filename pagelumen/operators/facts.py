"""Facts about pages: each an extraction from the markup, in a column ``f_*`` of its own.

Columns rather than one struct, so that Catalyst drops the facts a query doesn't use; a query for titles
then runs one pattern per page. Pages need ``url`` and ``html``; ``elapsed_ms``, ``status_code``,
``content_type`` and ``content_bytes`` are optional and null where a snapshot lacks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelumen.functions import html as H
from pagelumen.functions import urls as U
from pagelumen.functions.reuse import once_a_session

OPTIONAL = {"status_code": "int", "content_type": "string", "elapsed_ms": "long", "content_bytes": "long"}

# Elements that count as semantic, and landmark roles.
SEMANTIC_TAGS = ["header", "nav", "main", "article", "section", "aside", "footer"]
COUNTED_TAGS = [*SEMANTIC_TAGS, "ul", "ol", "figure", "figcaption", "time", "form", "label", "table"]
LANDMARK_ROLES = ["banner", "navigation", "main", "contentinfo"]
# Phrases of a call to action.
CTA = r"(?i)\b(buy\s*now|add\s*to\s*cart|shop\s*now|sign\s*up|get\s*started|subscribe|learn\s*more|contact\s*us|request\s*a?\s*quote|book\s*now|order\s*now|free\s*trial|download|register)\b"


def _wide_styles(html: Column) -> Column:
    """How many widths of over 500 px inline styles set; ``max-width`` and the like are not widths."""
    styles = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<[a-z][^>]*\sstyle\s*=[^>]*>"), F.lit(0)), lambda t: H.attribute(t, "style", H.restored)), lambda s: s.contains("px"))
    widths = F.flatten(F.transform(styles, lambda s: F.regexp_extract_all(s, F.lit(r"(?i)(?:^|[;\s])width\s*:\s*(\d+(?:\.\d+)?)\s*px"), F.lit(1))))
    return F.size(F.filter(widths, lambda w: w.cast("double") > 500))


@once_a_session
def _main_facts() -> dict[str, Column]:
    html, plain, live = F.col("html"), F.col("f_markup"), F.col("f_live")
    metas, rels, scripts = F.col("f_metas"), F.col("f_rels"), F.col("f_scripts")
    body = H.body_markup(F.col("f_prose"))
    viewport = H.meta_content(metas, "viewport")
    first_nav = F.regexp_extract(live, r"(?is)<nav\b[^>]*>(.*?)</nav\s*>", 1)
    canonical = F.filter(rels, lambda r: F.array_contains(r["rel"], "canonical"))
    return {
        "f_scheme": U.scheme(F.col("url")),
        "f_host": U.netloc(F.col("url")),
        "f_html_length": F.length(html),
        "f_size_kb": F.coalesce(F.col("content_bytes"), F.octet_length(html).cast("long")) / F.lit(1024.0),
        "f_title": H.element_text(live, "title", H.restored),
        "f_description": H.meta_content(metas, "description"),
        "f_canonical": F.when(F.size(canonical) > 0, F.coalesce(H.first(canonical)["href"], F.lit(""))),
        "f_og": F.array_distinct(F.filter(F.transform(metas, lambda m: m["property"]), lambda p: p.startswith("og:"))),
        "f_og_count": F.size(F.filter(metas, lambda m: m["property"].startswith("og:"))),
        "f_twitter": F.exists(metas, lambda m: F.coalesce(m["name"].startswith("twitter:"), F.lit(False))),
        "f_lang": H.attribute(H.first(H.tags(live, "html")), "lang", H.restored),
        "f_headings": H.headings(live, H.restored),
        "f_images": H.images(live, H.restored),
        "f_anchors": H.anchors(live, H.restored),
        "f_viewport": viewport,
        "f_wide_styles": _wide_styles(F.col("f_live")),
        "f_media_queries": F.coalesce(F.exists(F.regexp_extract_all(plain, F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1)), lambda s: s.contains("@media")), F.lit(False))
        | F.exists(rels, lambda r: F.array_contains(r["rel"], "stylesheet") & r["media"].isNotNull()),
        "f_tag_counts": F.struct(*(H.count_of(F.col("f_tag_names"), t).alias(t) for t in COUNTED_TAGS)),
        "f_times_dated": F.size(F.filter(H.tags(F.col("f_live"), "time"), lambda t: F.coalesce(H.attribute(t, "datetime", H.restored), F.lit("")) != "")),
        "f_roles": F.array_intersect(F.array(*map(F.lit, LANDMARK_ROLES)), F.regexp_extract_all(F.col("f_live"), F.lit(r"(?is)<[a-z][^>]*\srole\s*=\s*[\"']?([a-z]+)"), F.lit(1))),
        "f_body_text": H.visible_text(F.coalesce(body, F.lit("")), H.restored),
        "f_has_body": body.isNotNull(),
        "f_document_text": H.visible_text(F.col("f_prose"), H.restored),
        "f_nav_links": F.size(F.filter(H.tags(first_nav, "a"), lambda t: H.has_attribute(t, "href"))),
        "f_ctas": F.size(F.filter(F.regexp_extract_all(F.col("f_live"), F.lit(r"(?is)<(?:a|button)\b[^>]*>([^<]*)</(?:a|button)\s*>"), F.lit(1)), lambda t: H.restored(t).rlike(CTA)))
        + F.size(F.filter(H.tags(F.col("f_live"), "input"), lambda t: F.coalesce(H.attribute(t, "value", H.restored).rlike(CTA), F.lit(False)))),
        "f_submits": F.size(F.filter(H.tags(F.col("f_live"), "button|input"), lambda t: F.coalesce(H.attribute(t, "type", H.restored).rlike("(?i)submit"), F.lit(False)))),
        "f_inline": F.array_join(F.transform(F.filter(scripts, lambda s: s["src"].isNull()), lambda s: s["inline"]), "\n"),
        "f_sources": F.filter(F.transform(scripts, lambda s: s["src"]), lambda s: s.isNotNull()),
        "f_blocking": F.size(F.filter(scripts, lambda s: F.coalesce(s["src"] != "", F.lit(False)) & ~s["async"] & ~s["defer"])),
        "f_robots_metas": F.transform(F.filter(metas, lambda m: F.coalesce(m["name"].rlike("(?i)robots"), F.lit(False))), lambda m: F.lower(F.coalesce(m["content"], F.lit("")))),
        "f_jsonld": F.filter(F.transform(F.filter(scripts, lambda s: s["type"] == "application/ld+json"), lambda s: F.trim(s["inline"])), lambda b: b != ""),
        "f_microdata": F.col("f_live").rlike(r"(?is)<[a-z][^>]*\sitemscope"),
        "f_rdfa": F.col("f_live").rlike(r"(?is)<[a-z][^>]*\stypeof\s*="),
    }


@once_a_session
def _parsed() -> dict[str, Column]:
    """What several facts are read from."""
    live = F.col("f_live")
    return {"f_metas": H.metas(live, H.restored), "f_rels": H.rel_links(live, H.restored), "f_scripts": H.scripts(F.col("f_markup")), "f_tag_names": H.tag_names(live, COUNTED_TAGS)}


def with_facts(pages: DataFrame) -> DataFrame:
    """The pages with all facts; null html counts as an empty page."""
    for name, kind in OPTIONAL.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    staged = pages.withColumn("html", F.coalesce("html", F.lit("")))
    staged = staged.withColumn("f_markup", H.without_comments(F.col("html"))).withColumn("f_prose", H.without_code(F.col("html")))
    bare = F.regexp_replace("f_markup", r"(?is)(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)", "$1$2$3$4")
    staged = staged.withColumn("f_bare", bare)  # tags written inside scripts are no tags
    staged = H.with_settled(H.with_settled(staged, "f_bare", "f_live"), "f_prose", "f_prose")
    return staged.withColumns(_parsed()).withColumns(_main_facts())
