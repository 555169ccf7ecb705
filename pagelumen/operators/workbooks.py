"""The sheets of the exported workbooks, as tables with the exported headers in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelumen.operators import sitemaps, tags

# Header and column of the sheet of listed urls.
URL_SHEET = {
    "URL": "url", "Status Code": "status_code", "Content-Type": "content_type", "Page Title": "title", "Title Length": "title_length", "Meta Description": "description",
    "Description Length": "description_length", "H1 Text": "h1", "Canonical URL": "canonical", "Canonical Match": "canonical_match", "Robots Meta": "robots_meta", "Is Indexable": "indexable",
    "Robots.txt Status": "robots_txt_status", "Lastmod": "lastmod", "Changefreq": "changefreq", "Priority": "priority", "Word Count": "word_count", "OG Title": "og_title",
    "OG Description": "og_description", "Extraction Method": "extraction_method", "Notes": "notes", "Error": "error",
}
# Label and figure of the summary's rows, after the domain and the date.
SUMMARY_SHEET = {
    "Total URLs": "total_urls", "URLs Fetched Successfully": "fetched_ok", "URLs Failed": "failed", "HTTP 200": "status_200", "HTTP 301/302": "status_301", "HTTP 404": "status_404",
    "HTTP 5xx": "status_5xx", "Missing Title": "missing_title", "Missing Description": "missing_description", "Missing H1": "missing_h1", "Missing Canonical": "missing_canonical",
    "Non-Indexable": "non_indexable", "Avg Word Count": "avg_word_count",
}
# Headers of the sheets of tags, of recommendations and of page coverage.
TAG_SHEET = ["Vendor", "Vendor Short", "Category", "Tag ID", "Pages Found On", "Page Count", "Load Method", "DOM Location", "Script URL", "Code Snippet", "Async/Defer", "Duplicate?", "Impact", "Impact Detail", "Notes"]
ADVICE_SHEET = ["Priority", "Category", "Recommendation", "Affected Tags", "Expected Impact"]
COVERAGE_SHEET = ["Page Type", "URL", "Status", "Tags Found", "GTM", "GA4", "Meta Pixel", "Other Tags"]

#: What a tag rule is about, what it advises, and what following it brings.
ADVICE = {
    "tag_manager_missing": ("Tag management", "Load tags through a tag manager.", "Tags can be changed without releases"),
    "analytics_missing": ("Analytics", "Measure visits.", "Decisions on data"),
    "blocking_tags": ("Performance", "Load these tags asynchronously.", "Pages render sooner"),
    "direct_beside_manager": ("Tag management", "Move these tags into the tag manager.", "One place for all tags"),
    "legacy_analytics": ("Analytics", "Replace the retired analytics version.", "Measurement goes on"),
    "coverage_gap": ("Coverage", "Put this tag on all pages.", "Conversions are attributed"),
    "duplicate_tag": ("Data quality", "Load this tag once a page.", "Events count once"),
}


def _missing(value: str, note: str) -> Column:
    return F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) == "", F.lit(note))


def url_sheet(inventory: DataFrame) -> DataFrame:
    """One row per listed url, 22 columns; ``inventory`` as of ``sitemaps.inventory`` with what the sitemap says."""
    for name in ("lastmod", "changefreq", "priority"):
        if name not in inventory.columns:
            inventory = inventory.withColumn(name, F.lit(None).cast("string"))
    read = F.col("extraction_method") == "html_parse"
    code = F.coalesce("status_code", F.lit(0))
    lacks = F.concat_ws(", ", _missing("title", "Missing title"), _missing("description", "Missing description"), F.when(F.coalesce("h1_count", F.lit(0)) == 0, F.lit("Missing H1")), _missing("canonical", "Missing canonical"))
    answer = F.when(code.between(300, 399), "Redirect").when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string"))).otherwise("")
    rows = inventory.withColumns(
        {
            "canonical_match": F.when(read, F.col("canonical_status")),
            "robots_txt_status": F.when(F.col("disallowed"), "Disallowed").otherwise("Allowed"),
            "notes": F.when(read, lacks).otherwise(answer),
        }
    )
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c)
    return rows.select(*(text(c).alias(header) for header, c in URL_SHEET.items()))


def summary_sheet(inventory: DataFrame, domain: str, at: str) -> DataFrame:
    """15 rows of ``Metric, Value`` with their ``place``."""
    figures = sitemaps.inventory_summary(inventory)
    pairs = [("Domain", F.lit(domain)), ("Export Date", F.lit(at)), *((label, F.col(c).cast("string")) for label, c in SUMMARY_SHEET.items())]
    rows = figures.select(F.posexplode(F.array(*(F.struct(F.lit(label).alias("Metric"), value.alias("Value")) for label, value in pairs))).alias("place", "r"))
    return rows.select("place", "r.*")


def error_sheet(inventory: DataFrame) -> DataFrame:
    return url_sheet(inventory).where(F.col("Error") != "").select("URL", "Status Code", "Error")


def tag_sheet(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per vendor and id, 15 columns. Pages are named by their types (``other`` where they have none)."""
    kinds = tags.resolve_page_types(pages).select("page_id", "page_type")
    on = found.join(kinds, "page_id", "left").groupBy("vendor_short", "tag_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("page_type", F.lit("other")))), ", ").alias("pages_on"))  # six types
    rows = tags.inventory(found).alias("i").join(on.alias("o"), (F.col("i.vendor_short") == F.col("o.vendor_short")) & F.col("i.tag_id").eqNullSafe(F.col("o.tag_id")))
    src = F.col("i.method") == "src"
    detail = F.when(F.col("i.blocking"), "Blocks rendering").when(F.col("i.load_impact") == "high", "Uses much of the page's resources").otherwise("")
    values = [
        F.col("i.vendor"), F.col("i.vendor_short"), F.col("i.category"), F.coalesce("i.tag_id", F.lit("")), F.col("o.pages_on"), F.col("i.page_count"), F.col("i.method"), F.col("i.location"), F.coalesce("i.script_url", F.lit("")),
        F.when(F.coalesce("i.tag_id", F.lit("")) != "", F.lit("[REDACTED]")).otherwise(""), F.when(F.col("i.blocking"), "blocking").when(src, "async or defer").otherwise("N/A"), F.lit("No"), F.col("i.load_impact"), detail, F.lit(""),
    ]
    return rows.select(*(v.alias(header) for header, v in zip(TAG_SHEET, values, strict=True)))


def advice_sheet(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per recommendation, 5 columns, with the ``site`` it is for."""
    told = F.create_map(*(x for rule, words in ADVICE.items() for x in (F.lit(rule), F.array(*map(F.lit, words)))))
    rows = tags.recommendations(pages, found).withColumn("told", F.element_at(told, F.col("rule_id")))
    values = [F.col("severity"), F.col("told")[0], F.col("told")[1], F.col("detail"), F.col("told")[2]]
    return rows.select("site", *(v.alias(header) for header, v in zip(ADVICE_SHEET, values, strict=True)))


def coverage_sheet(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per page that is the first of its type on its site, 8 columns."""
    kinds = tags.resolve_page_types(pages).select("page_id", "page_type")
    rows = tags.coverage(pages, found).join(kinds, "page_id")
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    values = [F.col("page_type"), F.col("url"), F.lit("scanned"), F.col("tags"), yes("has_gtm"), yes("has_ga4"), yes("has_fbp"), F.col("others")]
    return rows.select(*(v.alias(header) for header, v in zip(COVERAGE_SHEET, values, strict=True)))
