"""URL verdicts: rules, aliases and the explicit allow."""

from fleet_audit.llm.url_filter import Rule, alias_edges, judge_urls

RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/")]


def judged(spark, rows, edges=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    return {r.page_id: r for r in judge_urls(df, RULES, edges).collect()}


def test_hosts_paths_and_the_longest_rule(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x?q#f", None), (2, "http://a.example.com/en/", ""), (3, "http://xexample.com/en/", ""), (4, "http://a.com", ""), (5, "http://b.net/es/1", ""),
            (6, "http://b.net?/es/", ""), (7, None, "<link rel=canonical href='http://b.net/es/'>"), (8, "no scheme", ""), (9, "x://ÄB.net/es/y://z", ""), (5, "http://b.net/es/1", "")]
    got = judged(spark, rows)
    assert {p: (r.host, r.path, r.rule, r.verdict) for p, r in got.items()} == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("xexample.com", "/en/", "com/", "allow"),
        4: ("a.com", "", None, "allow"), 5: ("b.net", "/es/1", "net/es/", "block"), 6: ("b.net", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("Äb.net", "/es/y://z", "net/es/", "block")}


def test_blocks_travel_over_aliases_and_allows_hold(spark):
    rows = [(1, "http://A.org/x#f", '<link href="http://b.net/es/1" rel=canonical>'), (2, "http://b.org/q", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),
            (3, "http://w.com/", '<link rel="canonical" href="http://b.net/es/1">'), (4, "http://c.org/", '<link rel="stylesheet" href="http://b.net/es/1">'),
            (5, "http://d.org/dir/p", '<link rel="canonical" href="../q">'), (6, "http://e.org/", "<meta http-equiv=refresh content='5;URL=/r?a=1&amp;b=2'>")]
    got = judged(spark, rows)
    assert {p: r.verdict for p, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert ("http://e.org/", "http://e.org/r?a=1&b=2") in {(r.a, r.b) for r in alias_edges(df).collect()}
    crawled = spark.createDataFrame([("http://e.org/", "http://f.net/es/z")], "a string, b string")
    assert judged(spark, rows, crawled)[6].verdict == "block"


def test_empty_table(spark):
    assert judged(spark, []) == {}
