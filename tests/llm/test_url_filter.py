from pyspark.sql import functions as F

from contentspark.llm import url_filter
from contentspark.llm.common import connected_components

LINK = '<html><head><LINK href="{}" rel="canonical"></head></html>'
REFRESH = "<meta http-equiv='Refresh' content='0; URL={}'>"


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {}
    for r in url_filter.judge_urls(pages.withColumn("a", F.lit(1)), url_filter.link_edges(pages)).collect():
        out.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    return out


def test_parts_and_rules(spark):
    out = judged(spark, [
        (1, "HTTPS://A.Example.ORG/es/x?y=1#z", None), (2, "http://example.org/en/17", ""), (3, "x://example.org/en/2", None),
        (4, "http://m.shop.com/de/1", None), (5, "http://shop.com/fr/1", None), (6, "http://shop.com", None), (7, None, None),
        (8, "nothing", None), (9, "http://notexample.org/es/", None), (10, "http://ÄB.com?x", None), (10, "http://ÄB.com?x", None),
        (11, "http://a.net/x://y", None), (12, "://com/de/", None)])
    assert out[1] == [("a.example.org", "/es/x", "example.org/es/", "block")]
    assert out[2] == [("example.org", "/en/17", "example.org/en/1", "block")]
    assert out[3] == [("example.org", "/en/2", "org/", "allow")]
    assert out[4] == [("m.shop.com", "/de/1", "com/de/", "block")]
    assert out[5] == [("shop.com", "/fr/1", "com/fr/", "allow")]
    assert out[6] == [("shop.com", "", None, "allow")]
    assert out[7] == out[8] == [("", "", None, "allow")]
    assert out[9] == [("notexample.org", "/es/", "org/", "allow")]
    assert out[10] == [("Äb.com", "", None, "allow")] * 2
    assert out[11] == [("a.net", "/x://y", None, "allow")]
    assert out[12] == [("com", "/de/", "com/de/", "block")]


def test_aliases(spark):
    chain = [(i, f"http://h{i}.net/p", REFRESH.format(f"http://h{i + 1}.net/p?utm_source=x#top")) for i in range(1, 30)]
    out = judged(spark, chain + [
        (30, "https://h30.net/p", LINK.format("http://bad.com/de/x")), (31, "http://free.net/", LINK.format("//other.net/a")),
        (40, "http://two.net/", LINK.format("http://bad.com/de/y") + LINK.format("http://good.org/")),
        (50, "http://rel.net/a/b", LINK.format("c")), (51, "http://rel.net/a/c", LINK.format("http://bad.com/de/z?a=1&amp;b=2")),
        (52, "http://mail.net/", LINK.format("mailto:x")), (53, "http://own.org/q", LINK.format("http://bad.com/de/w"))])
    assert {out[i][0][3] for i in range(1, 31)} == {"block"}
    assert out[31][0][3] == "allow" and out[40][0][3] == "allow"
    assert out[50][0][3] == out[51][0][3] == "block"
    assert out[52][0][3] == "allow" and out[53][0][2:] == ("org/", "allow")


def test_plan_is_native(spark, small):
    from contentspark.llm.registry import op10_url_filter

    plan = op10_url_filter(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(300, i) for i in range(301, 400)] + [(5, 5), (None, 3), (500, 501), (501, 500)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 1) for i in range(1, 201)} | {(i, 300) for i in range(300, 400)} | {(500, 500), (501, 500)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
