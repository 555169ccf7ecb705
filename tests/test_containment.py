"""A failing expression costs a page one category, not the job."""

from pyspark.sql import functions as F

from pagelumen.operators import audit
from pagelumen.operators.rules import ORDER, Rule, WORDING


def frame(spark):
    rows = [(1, "https://s.test/a", "<title>t</title>", "900"), (2, "https://s.test/b", "<title>t</title>", "slow"), (3, "https://s.test/c", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, elapsed_ms string")


def test_other_categories_stand(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = {(r.page_id, r.category): r for r in audit.categories_long(frame(spark)).collect()}
    failed = {k for k, r in rows.items() if r.status == "error"}
    assert failed == {(2, "performance"), (2, "ads_quality")}
    for k in failed:
        assert (rows[k].score, rows[k].issues, rows[k].error_message) == (0, [], audit.UNREADABLE)
    assert all(r.error_message is None for k, r in rows.items() if k not in failed)
    names = [n for n in ORDER if n not in audit.SIDE]
    assert sorted(rows) == sorted((i, n) for i in (1, 2, 3) for n in names)
    bare = {(r.page_id, r.category): r.score for r in audit.categories_long(frame(spark).drop("elapsed_ms"), with_issues=False).collect()}
    assert all(rows[k].score == bare[k] for k in rows if k[1] not in ("performance", "ads_quality"))
    assert {i.rule_id for i in rows[1, "performance"].issues} >= {"response_moderate"}


def test_scores_count_a_failure_as_nothing(spark):
    wide = {r.page_id: r for r in audit.scores(frame(spark)).collect()}
    assert (wide[2].performance, wide[2].ads_quality) == (0, 0) and wide[2].meta_tags == wide[1].meta_tags and wide[1].performance > 0
    assert wide[1].robots is None
    total = {r.page_id: r.overall_score for r in audit.overall_scores(frame(spark)).collect()}
    assert total[2] < total[1]


def test_rules_say_one_thing(spark):
    told: dict[str, tuple] = {}
    for name in ORDER:
        for rule in audit.category(name).rules:
            assert isinstance(rule, Rule) and told.setdefault(rule.id, (rule.severity, rule.impact)) == (rule.severity, rule.impact)
    assert set(WORDING) <= set(told)
    issues = audit.issues(frame(spark).drop("elapsed_ms")).where(F.col("rule_id") == "description_missing").first()
    assert (issues.severity, issues.impact, issues.message, issues.recommendation) == ("error", "high", *WORDING["description_missing"])
