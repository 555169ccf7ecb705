from pagelumen.llm import url_filters as u

SCHEMA = "page_id long, url string, html string"


def verdicts(spark, rows, redirects=None):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as verdict", "1 as host")
    log = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    return {r.page_id: r for r in u.judge(frame, log).collect()}


def test_rules_and_parts(spark):
    urls = [
        "http://Example.ORG/es/x?y", "https://a.example.org/en/12#z", "http://example.org/fr", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/it",
        "no scheme", None, "http://com/de/", "http://notexample.org/es/", "http://host.net", "http://org?a/b://c", "ftp://x.com:80/de/", "",
    ]
    out = verdicts(spark, [(i, x, None) for i, x in enumerate(urls)])
    got = [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))]
    assert got == [
        ("example.org", "/es/x", "example.org/es/", "block"),
        ("a.example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/fr", "org/", "allow"),
        ("x.com", "/fr/1", "com/fr/", "allow"),
        ("x.com", "/de/1", "com/de/", "block"),
        ("x.com", "/it", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("com", "/de/", "com/de/", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("host.net", "", None, "allow"),
        ("org", "", None, "allow"),
        ("x.com:80", "/de/", None, "allow"),
        ("", "", None, "allow"),
    ]


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head>'


def test_blocks_reach_aliases(spark):
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")),
        (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://bad.com/de/x">'),
        (3, "http://c.net/3", link("/4")),
        (4, "http://c.net/4", None),
        (5, "http://d.net/5#frag", "<LINK HREF='http://bad.com/de/y' REL='canonical'>"),
        (6, "http://e.net/6", link("http://bad.com/de/z")),
        (7, "http://good.com/fr/7", link("http://e.net/6")),
        (8, "http://b.net/2", None),
        (9, "http://f.net/9", None),
        (10, "http://b.net/2?other", None),
    ]
    out = verdicts(spark, rows, [("http://g.net/", "http://a.net/1"), ("http://f.net/9", "http://f.net/9")])
    assert {i: (r.verdict, r.via) for i, r in out.items()} == {
        1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default"), 4: ("allow", "default"), 5: ("block", "alias"),
        6: ("allow", "default"), 7: ("allow", "rule"), 8: ("block", "alias"), 9: ("allow", "default"), 10: ("allow", "default"),
    }


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], SCHEMA)).count() == 0
