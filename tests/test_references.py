"""Character references of HTML 5, as the standard library decodes them."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from pagelumen.functions import html as H
from pagelumen.operators.facts import with_facts
from pagelumen.plans.catalog import queries


def cases():
    rng = random.Random(5)
    names = sorted(html5)
    made = [f"a&{n}b" for n in rng.sample(names, 250)] + [f"&{n}" for n in rng.sample(names, 100)] + [f"x&{n.rstrip(';')}{rng.choice(['', ' ', ';', 'y', '=', '1', '<', '&'])}" for n in rng.sample(names, 150)]
    made += [f"&#{rng.choice([0, 1, 9, 10, 11, 13, 31, 38, 60, 127, 128, 129, 150, 159, 160, 8217, 55296, 64976, 65534, 65535, 65536, 128512, 1114111, 1114112, 99999999999])}{rng.choice([';', '', 'x', ' '])}" for _ in range(80)]
    made += [f"&#{rng.choice('xX')}{rng.choice(['0', '26', '3c', '1F600', 'D800', '80', '9f', '000041', '110000', 'fffe'])}{rng.choice([';', '', 'g', ' '])}" for _ in range(80)]
    return [*dict.fromkeys(made), "", "&", "&&", "&;", "&#;", "&#x;", "&notit; &notin; &not", "&amp;lt;", "&ampamp;", "no references", "&NewLine;&Tab;x", "&" + "a" * 40 + ";", "&lt" + "a" * 40]


def test_all_forms_as_the_standard_library(spark):
    given = cases()
    assert len(given) >= 500
    frame = spark.createDataFrame([(t,) for t in given], "t string")
    rows = frame.select("t", H.unescaped(F.col("t")).alias("d"), H.restored(H.settled(F.col("t"))).alias("s")).collect()
    assert {r.t: r.d for r in rows} == {t: html.unescape(t) for t in given}
    assert {r.t: r.s for r in rows} == {t: html.unescape(t) for t in given}


def test_structure_is_read_before_references(spark):
    page = "<title>a &lt;b&gt; &amp;amp; c&ensp;&copy</title><body><a href='/p?a=1&copy=2&amp;b=&quot;3&quot;&#39;' title=x&#32;alt=y>l</a><img src=i alt=\"&lt;img&gt; &#xFDD0;\"><p>﷐ 1 &lt; 2"
    row = with_facts(spark.createDataFrame([(1, "https://s.test/", page), (2, "https://s.test/", None)], "page_id long, url string, html string")).orderBy("page_id").first()
    assert row.f_title == "a <b> &amp; c ©"
    assert [a.href for a in row.f_anchors] == ["/p?a=1&copy=2&b=\"3\"'"]
    assert [(i.src, i.alt) for i in row.f_images] == [("i", "<img> ")]
    assert row.f_body_text == "l � 1 < 2"


def test_names_are_in_a_plan_once_or_twice(spark, sf_dir):
    for name in ("sitemap_inventory", "tag_coverage"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 200_000, (name, len(plan))
