"""Toxicity, language and main text: held-out accuracy on the tables, defined results on odd rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from contentspark.llm import htmltext, langid, registry, toxicity
from contentspark.llm.common import in_fold

MIDDLE = "/root/testdata/sf0.01"
#: The middle tables hold too few labels to tell the ten marking words from chance.
LARGE = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = registry.op5_language(spark, MIDDLE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.99 * len(held) > 0


def test_language_odd_rows(spark):
    base = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang").limit(200)
    odd = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "en"), (-3, "123 !!!", None), (None, "the and of", "de"), (-4, "der die das und " * 20000, None), (-4, "", None)],
        "doc_id long, text string, lang string")
    docs = base.unionByName(odd).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    out = {}
    for r in langid.identify(docs, F.lit(True), per_language=20).where("doc_id < 0 or doc_id is null").collect():
        out.setdefault(r.doc_id, []).append(r.lang_pred)
    assert out[-1] == out[-2] == out[-3] == ["und"]
    assert out[None] != ["und"] and sorted(out[-4]) == ["de", "und"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, F.lit(True)).count() == 0
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic"
    assert langid.family_of("xx") == "xx"


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = registry.op1_toxicity(spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.98 * len(held) > 0


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}", "x") for i in range(60)] + [(100 + i, f"you bleep {i}", "y") for i in range(60)]
                                 + [(None, None, "z"), (500, "", "z"), (500, "", "z"), (501, "b l e e p! " * 9000, "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in (*range(60), *range(100, 160))] + [(None, 1), (7, None), (100, 0)], "doc_id long, toxic int")
    out = {}
    for r in toxicity.score_toxicity(docs, labels.withColumn("text", F.lit("clash")), F.lit(True), trees=5).collect():
        out.setdefault(r.doc_id, []).append(r.predicted)
    assert out[3] == [0] and out[130] == [1] and len(out[500]) == 2 and len(out[None]) == len(out[501]) == 1
    same = toxicity.score_toxicity(docs, labels.where("toxic = 0"), F.lit(True)).collect()
    assert {(r.score, r.predicted) for r in same} == {(0.0, 0)} and len(same) == 124
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_fold(spark):
    row = spark.range(1).select(in_fold(F.lit(12), 5, 0).alias("a"), in_fold(F.lit(None).cast("long"), 5, 0).alias("b")).first()
    import zlib

    assert row.a == (zlib.crc32(b"12") % 5 == 0) and row.b is False


def article(page):
    """The same text by a plain rule that holds for the pages of the table."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(line for line in lines if line)


def test_pages_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = registry.op6_html(spark, MIDDLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


OTHER = """<html><head><title>T</title></head><body><header><h1>Site name</h1></header>
<div id="cookie-notice">We use cookies. Accept them now please, dear reader.</div>
<div class="main-content"><h2>Big &lt;news&gt;</h2><p>A long first paragraph with   many words &amp; a <a href="/x">link</a>, that goes on
for some time and ends.</p><div class="ad">Buy now!</div><p>Second part of it,<br>also long enough to be prose, with a full stop.</p>
<form><label>Name</label><input name=q></form><script>var x = "<p>no</p>";</script><!-- <p>hidden</p> --></div>
<div class="comments"><p>First! A reader comment that is fairly long, yes it is.</p></div>
<aside><ul><li><a href="/1">One more</a></li></ul></aside><footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.train(spark.read.parquet(f"{MIDDLE}/pages.parquet"))


def test_page_of_another_kind(model):
    want = ("Big <news>\nA long first paragraph with many words & a link, that goes on for some time and ends.\n"
            "Second part of it, also long enough to be prose, with a full stop.")
    assert htmltext.page_text(OTHER, model) == want
    assert htmltext.page_text(OTHER, htmltext.estimate({(0, 0): 1}, {})) == want


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no markup at all, but a sentence of some length."), (4, "u", "<p>" * 3000 + "deep"),
            (5, "u", "<article><p>x &amp; y&nbsp;z &#65;<p>b<div>c</article>"), (5, "u", "<article><p>x &amp; y&nbsp;z &#65;<p>b<div>c</article>"),
            (6, "u", "<script>never closed <article>x</article>"), (None, "u", "<nav>menu</nav><article>a < b</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {}
    for r in htmltext.extract_text(pages, model).collect():
        out.setdefault(r.page_id, []).append(r.text)
    assert out[1] == out[2] == out[6] == [""]
    assert out[5] == ["x & y z A\nb\nc"] * 2 and out[None] == ["a < b"]
    assert htmltext.extract_text(pages.limit(0)).count() == 0
