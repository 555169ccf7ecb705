"""The audit: all categories of every page, the overall score, and what follows from the issues.

A page stays one row until its issues are exploded, so scoring needs no shuffle; only roll-ups do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelumen.functions.reuse import once_a_session
from pagelumen.operators.facts import with_facts
from pagelumen.operators.rules import CATEGORIES, ORDER, WEIGHTS, Category
from pagelumen.operators.schemaorg import with_structured

# Ranks, and each category's relevance to the business.
SEVERITY = {"error": 3, "warning": 2, "info": 1, "pass": 0}
IMPACT = {"high": 3, "medium": 2, "low": 1}
RELEVANCE = {
    "meta_tags": 9,
    "performance": 9,
    "tracking": 8,
    "accessibility": 8,
    "mobile": 7,
    "structured_data": 7,
    "serp_features": 7,
    "images": 6,
    "links": 6,
    "ads_quality": 6,
    "headings": 5,
    "sitemap": 5,
    "semantic": 4,
    "robots": 4,
}
#: Side inputs: what a category needs beside the page, and the column that tells whether it is known.
SIDE = {"robots": "r_known", "sitemap": "m_known", "accessibility": "a_known"}


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with the facts that the categories read."""
    return with_structured(with_facts(pages))


@once_a_session
def category(name: str) -> Category:
    return CATEGORIES[name]()


def scores(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per page: ``page_id, url`` and ``<category>`` scores; null where an input is not at hand."""
    facts = parsed(pages)
    return facts.select("page_id", "url", *(_score(facts, n).alias(n) for n in names or ORDER))


def _score(facts: DataFrame, name: str) -> Column:
    """A category's score; 0 where it can't be evaluated, null where its input is not at hand."""
    if name in SIDE and SIDE[name] not in facts.columns:
        return F.lit(None).cast("int")
    return _guarded_score(name)


@once_a_session
def _guarded_score(name: str) -> Column:
    own = category(name)
    score = F.coalesce(contained(own.score().cast("string")).try_cast("int"), F.lit(0))
    return score if own.available is None else F.when(own.available, score)


def contained(text: Column) -> Column:
    """A text, null where its evaluation fails: what a page breaks stays within that page and category.

    The condition holds for every page. It is there because Spark evaluates what several expressions share ahead of them, outside of what
    contains a failure, unless they stand in a branch.
    """
    always = F.coalesce(F.length("url"), F.lit(0)) >= 0
    return F.decode(F.when(always, F.try_to_binary(text, F.lit("utf-8"))), "utf-8")


def overall(wide: DataFrame) -> Column:
    """Weighted mean of the categories that were scored, rounded half to even; 0 if none was.

    The terms are added in a fixed order, as doubles: a shuffled sum would not be reproducible.
    """
    total = weight = F.lit(0.0)
    for name in ORDER:
        there = F.col(name).isNotNull()
        total = total + F.when(there, F.col(name) * F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
        weight = weight + F.when(there, F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
    return F.when(weight > 0, F.bround(total / weight)).otherwise(F.lit(0.0)).cast("int")


def overall_scores(pages: DataFrame) -> DataFrame:
    wide = scores(pages)
    return wide.select("page_id", "url", overall(wide).alias("overall_score"))


#: What a category's evaluation hands on with evidence: its score, and of its issues only which rule and what evidence.
_OUTCOME = "v struct<score: int, issues: array<struct<rule_id: string, evidence: string>>>"
_NO_ISSUES = "array<struct<rule_id:string,evidence:string>>"
UNREADABLE = "The category could not be evaluated on this page."


def _outcome(own: Category, with_issues: bool, with_evidence: bool) -> Column:
    """A category's outcome as text. With evidence it is JSON, as evidence is any text; else a score and names of rules, comma-joined."""
    if with_issues and with_evidence:
        return F.to_json(F.struct(F.struct(own.score().alias("score"), own.found().alias("issues")).alias("v")))
    score = F.coalesce(own.score().cast("string"), F.lit("0"))
    return F.concat_ws(",", score, own.named()) if with_issues else score


@once_a_session
def _outcomes(names: tuple[str, ...], with_issues: bool, with_evidence: bool) -> Column:
    """array<struct<position, category, outcome>> of the categories; an outcome is empty where the input is not at hand, null where its evaluation failed."""
    made = []
    for name in names:
        own = category(name)
        value = _outcome(own, with_issues, with_evidence)
        value = value if own.available is None else F.when(own.available, value).otherwise(F.lit(""))
        made.append(F.struct(F.lit(ORDER.index(name)).alias("position"), F.lit(name).alias("category"), contained(value).alias("outcome")))
    return F.array(*made)


def _read(outcome: Column, with_issues: bool, with_evidence: bool) -> Column:
    """An outcome as ``struct<score, issues>``."""
    if with_issues and with_evidence:
        return F.from_json(outcome, _OUTCOME)["v"]
    parts = F.split(outcome, ",")
    issues = F.transform(F.slice(parts, 2, F.size(parts)), lambda r: F.struct(r.alias("rule_id"), F.lit(None).cast("string").alias("evidence"))) if with_issues else F.array().cast(_NO_ISSUES)
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("score"), issues.alias("issues"))


@once_a_session
def _wording() -> Column:
    """Severity, impact, message and advice by rule; a few hundred fixed entries."""
    entries = {rule: F.struct(F.lit(severity).alias("severity"), F.lit(impact).cast("string").alias("impact"), F.lit(message).alias("message"), F.lit(advice).cast("string").alias("recommendation")) for rule, (severity, impact, message, advice) in _told().items()}
    return F.create_map(*(x for rule, words in entries.items() for x in (F.lit(rule), words)))


@once_a_session
def _told() -> dict[str, tuple[str, str | None, str, str | None]]:
    return {rule.id: (rule.severity, rule.impact, *rule.wording()) for name in ORDER for rule in category(name).rules}


def _at_hand(pages: DataFrame, names: list[str] | None) -> tuple[str, ...]:
    """The categories, or those of the given names, whose side inputs the pages have."""
    return tuple(n for n in ORDER if (names is None or n in names) and (n not in SIDE or SIDE[n] in pages.columns))


def listed(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``page_id, url, position, category`` of the categories that apply to each page; nothing is evaluated."""
    entries = [F.when(F.lit(True) if n not in SIDE else F.coalesce(F.col(SIDE[n]), F.lit(False)), F.struct(F.lit(ORDER.index(n)).alias("position"), F.lit(n).alias("category"))) for n in _at_hand(pages, names)]
    return pages.select("page_id", "url", F.explode(F.array(*entries)).alias("c")).where(F.col("c").isNotNull()).select("page_id", "url", "c.*")


def categories_long(pages: DataFrame, with_issues: bool = True, names: list[str] | None = None, with_evidence: bool = True) -> DataFrame:
    """``page_id, url, position, category, score, issues, status, error_message`` for every page and category.

    A category whose evaluation fails on a page has status ``error``, a message, score 0 and no issues there; the page's other categories
    stand. Until the rows are exploded an issue is a rule's name and its evidence; severity and wording join it afterwards.
    Without ``with_issues`` only scores are evaluated, without ``with_evidence`` only which rules hold; ``names`` are the categories wanted.
    """
    facts = parsed(pages)
    rows = facts.select("page_id", "url", F.explode(_outcomes(_at_hand(facts, names), with_issues, with_evidence)).alias("c")).select("page_id", "url", "c.*")
    rows = rows.where(F.coalesce(F.col("outcome") != "", F.lit(True)))  # the input is not at hand
    rows = rows.withColumn("v", _read(F.col("outcome"), with_issues, with_evidence))
    failed = F.col("outcome").isNull()
    none = F.array().cast(_NO_ISSUES)
    worded = rows.select(
        "page_id", "url", "position", "category",
        F.coalesce("v.score", F.lit(0)).alias("score"),
        F.transform(F.coalesce("v.issues", none), _full_issue).alias("issues"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, UNREADABLE).alias("error_message"),
    )
    return worded


def _full_issue(found: Column) -> Column:
    told = F.element_at(_wording(), found["rule_id"])
    return F.struct(found["rule_id"].alias("rule_id"), told["severity"].alias("severity"), told["impact"].alias("impact"), told["message"].alias("message"), told["recommendation"].alias("recommendation"), found["evidence"].alias("evidence"))


def metrics(pages: DataFrame, name: str) -> DataFrame:
    """A category's score and metrics, a column each."""
    facts = parsed(pages)
    return facts.select("page_id", _score(facts, name).alias("score"), *(c.alias(n) for n, c in category(name).metrics.items()))


def issues(pages: DataFrame, names: list[str] | None = None, with_evidence: bool = True) -> DataFrame:
    """Every issue, or those of the named categories: ``page_id, url, category_pos, category, issue_pos, rule_id, severity, impact, ...``."""
    # Outer: else the issues would be looked up once more, to see whether there are any.
    rows = categories_long(pages, True, names, with_evidence).select("page_id", "url", F.col("position").alias("category_pos"), "category", "score", F.posexplode_outer("issues").alias("issue_pos", "i"))
    return rows.where(F.col("i").isNotNull()).select("page_id", "url", "category_pos", "category", "score", "issue_pos", "i.*")


def _rank(column: Column, ranks: dict[str, int], default: int) -> Column:
    return reduce(lambda c, kv: F.when(column == kv[0], kv[1]).otherwise(c), ranks.items(), F.lit(default))


def priority() -> Column:
    """4 x severity + 2 x impact + relevance / 2; without an impact as for a low one."""
    return _rank(F.col("severity"), SEVERITY, 1) * 4 + _rank(F.col("impact"), IMPACT, 1) * 2 + _rank(F.col("category"), RELEVANCE, 3) * F.lit(0.5)


def severity_counts(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY))


def severity_shares(found: DataFrame, *by: str) -> DataFrame:
    """Share of every severity in per cent."""
    counted = severity_counts(found, *by)
    total = reduce(lambda a, b: a + b, (F.col(f"n_{s}") for s in SEVERITY))
    return counted.select(*by, *((F.col(f"n_{s}") * 100 / total).alias(f"pct_{s}") for s in SEVERITY))


def worst_severity(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(F.max_by("severity", _rank(F.col("severity"), SEVERITY, 1)).alias("worst"))


def by_impact(found: DataFrame) -> DataFrame:
    """Number of recommendations by impact."""
    return found.where(F.col("recommendation").isNotNull()).groupBy(F.coalesce("impact", F.lit("none")).alias("impact")).agg(F.count("*").alias("n"))


def select_issues(found: DataFrame, severity: str | None = None, text: str | None = None, with_evidence: bool = False, with_recommendation: bool = False) -> DataFrame:
    """Issues by severity, by words in their message or evidence, with evidence or advice."""
    if severity:
        found = found.where(F.col("severity") == severity)
    if text:
        found = found.where(F.lower("message").contains(text.lower()) | F.lower(F.coalesce("evidence", F.lit(""))).contains(text.lower()))
    if with_evidence:
        found = found.where(F.col("evidence").isNotNull())
    return found.where(F.col("recommendation").isNotNull()) if with_recommendation else found


def sort_issues(found: DataFrame, by: str = "severity", page: int = 0, size: int = 50) -> DataFrame:
    """A page of the issues in order of severity or impact, worst first; ties in audit order."""
    rank = {"severity": _rank(F.col("severity"), {"error": 0, "warning": 1, "info": 2, "pass": 3}, 3), "impact": _rank(F.col("impact"), {"high": 0, "medium": 1, "low": 2}, 3)}[by]
    return found.orderBy(rank, "page_id", "category_pos", "issue_pos").offset(page * size).limit(size)


def top_opportunities(found: DataFrame, k: int = 8) -> DataFrame:
    """Per page the k gravest issues, each message once; ties in audit order."""
    rows = found.where(F.col("severity") != "pass").withColumn("priority", priority())
    order = [F.desc("priority"), "category_pos", "issue_pos"]
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "message").orderBy(*order))).where(F.col("n") == 1)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("page_id", "rank", "category", "rule_id", "severity", "impact", "priority")


def immediate_fixes(found: DataFrame, k: int = 5) -> DataFrame:
    """Of the first k of the ranking of all issues, those that are errors or warnings; a message can come twice."""
    order = Window.partitionBy("page_id").orderBy(F.desc("priority"), "category_pos", "issue_pos")
    ranked = found.withColumn("priority", priority()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("severity").isin("error", "warning")).select("page_id", "rank", "category", "rule_id", "severity", "impact", "priority")


def quick_wins(found: DataFrame, k: int = 3) -> DataFrame:
    """Per page and category the k issues of highest priority, passes aside."""
    rows = found.where(F.col("severity") != "pass").withColumn("priority", priority())
    order = Window.partitionBy("page_id", "category").orderBy(F.desc("priority"), "issue_pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("page_id", "category", "rank", "rule_id", "priority")


def numbered_issues(found: DataFrame) -> DataFrame:
    """Errors numbered through per page, categories of greater weight first."""
    weight = reduce(lambda c, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(c), WEIGHTS.items(), F.lit(0.0))
    order = Window.partitionBy("page_id").orderBy(F.desc(weight), "category_pos", "issue_pos")
    return found.where(F.col("severity") == "error").select("page_id", "category", "rule_id", F.row_number().over(order).alias("number"))


def weakest_categories(wide_or_long: DataFrame, k: int = 3) -> DataFrame:
    """Per page the k lowest category scores; ties in audit order. Takes ``page_id, position, category, score``."""
    order = Window.partitionBy("page_id").orderBy("score", "position")
    return wide_or_long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("page_id", "rank", "category", "score")


def by_weight(rows: DataFrame) -> DataFrame:
    """Categories in order of weight, heaviest first."""
    weight = reduce(lambda c, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(c), WEIGHTS.items(), F.lit(0.0))
    return rows.withColumn("weight", weight).orderBy("page_id", F.desc("weight"), "position")


def host_rollup(wide: DataFrame) -> DataFrame:
    """Per host: pages, mean, least and greatest overall score. Takes ``url, overall_score``."""
    from pagelumen.functions.urls import netloc

    return wide.groupBy(F.lower(netloc(F.col("url"))).alias("host")).agg(F.count("*").alias("pages"), F.avg("overall_score").alias("mean_score"), F.min("overall_score").alias("min_score"), F.max("overall_score").alias("max_score"))


def rollup_scores(long: DataFrame) -> DataFrame:
    """Mean score by host and category, by host, and of all (an extension)."""
    from pagelumen.functions.urls import netloc

    rows = long.select(F.lower(netloc(F.col("url"))).alias("host"), "category", "score")
    return rows.rollup("host", "category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def narrative(found: DataFrame) -> DataFrame:
    """Per page which summary text applies: by its number of errors."""
    errors = F.count_if(F.col("severity") == "error")
    return found.groupBy("page_id").agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn(
        "variant", F.when(F.col("errors") > 5, "many_errors").when(F.col("errors") > 0, "some_errors").otherwise("no_errors")
    )


def top_issues(found: DataFrame, k: int = 8) -> DataFrame:
    """Per page the first k errors and warnings, errors first, else in audit order; a message can come twice."""
    order = Window.partitionBy("page_id").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "category_pos", "issue_pos")
    rows = found.where(F.col("severity").isin("error", "warning")).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("page_id", "rank", "category", "rule_id", "severity")
