import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentspark.functions.text import words
from contentspark.functions.vectors import hash_vector
from contentspark.operators.ranking import top_k_per_group
from contentspark.operators.textsearch import (
    build_postings, parse_web_query, text_candidates_from_postings, text_candidates_many, text_matches,
)
from contentspark.operators.vectorsearch import vector_candidates, vector_candidates_many
from contentspark.plans.feed import unread_feed
from contentspark.plans.search import hybrid_search, hybrid_search_many

ITEM = "id string, title string, content_text string, url string, embedding array<float>"


def axis(i, dim=1536):
    return [1.0 if j == i else 0.0 for j in range(dim)]


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([
        ("1", "Ремонт лодки: Tide Table и приливы", "Весной мы чинили старую лодку и сверялись с Tide Table каждый день", "u1", axis(0)),
        ("2", "Harbour crane inspection", "Cranes and winches of the harbour are inspected by divers", "u2", axis(0)),
        ("3", "Починка лодки", "Как читать Tide Table перед выходом лодкой в море", "u3", axis(1)),
        ("4", "Выпечка ржаного хлеба", "Закваска, мука и соль для домашнего каравая", "u4", None),
    ], ITEM)


@pytest.mark.parametrize("stem", ["none", "light", "snowball"])
@pytest.mark.parametrize("stored", [False, True])
def test_hybrid_search_prefers_items_found_both_ways(four, stem, stored):
    postings = build_postings(four, stem) if stored else None
    rows = hybrid_search(
        four, "Tide Table", 10, vector=F.lit(axis(0)), stem=stem, postings=postings).collect()
    assert rows[0].content_id == "1"
    assert {r.content_id for r in rows} == {"1", "2", "3"}
    scores = [r.rrf_score for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert rows[0].clean_content.startswith("Весной")


def test_hybrid_search_finds_russian_word_forms(four):
    found = text_matches(four, "лодка", "snowball").collect()
    assert {r.id for r in found} == {"1", "3"}


def test_hybrid_search_embeds_the_query_text(four, spark):
    rows = hybrid_search(four, "Tide Table", 2, stem="light").collect()
    assert len(rows) == 2
    near = vector_candidates(four, hash_vector(F.lit("Tide Table"), 1536)).collect()
    assert {r.id for r in near} == {"1", "2", "3"}


def test_blank_query_has_no_text_matches(four):
    for text in ("", "   ", "the and", "-"):
        assert text_matches(four, text, "light").count() == 0
    rows = hybrid_search(four, " ", 10, stem="light").collect()
    assert {r.content_id for r in rows} == {"1", "2", "3"}


def test_query_table_agrees_with_single_queries(four, spark):
    queries = spark.createDataFrame([(1, "Tide Table"), (2, "cranes"), (3, "соль or divers"), (4, "the")],
                                    "query_id int, text string")
    postings = build_postings(four, "light")
    many = hybrid_search_many(four, queries, 10, postings=postings, stem="light").collect()
    scanned = hybrid_search_many(four, queries, 10, stem="light").collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, scanned))
    for query_id, text in ((1, "Tide Table"), (2, "cranes"), (3, "соль or divers"), (4, "the")):
        single = hybrid_search(four, text, 10, stem="light").collect()
        ours = sorted(((r.rrf_score, r.content_id) for r in many if r.query_id == query_id), key=lambda x: (-x[0], x[1]))
        assert ours == [(r.rrf_score, r.content_id) for r in single]


def test_lexemes(spark):
    items = spark.createDataFrame([("1", "Granite Vector Architecture", None)], "id string, title string, content_text string")
    for stem in ("light", "snowball"):
        rows = build_postings(items, stem).collect()
        assert {"vector", "architectur"} <= {r.lexeme for r in rows}
        assert [(r.pos, r.weight) for r in rows] == [(1, "A"), (2, "A"), (3, "A")]


def test_parse_web_query():
    parsed = parse_web_query('Cat "big dog" or -"bad bird" fish -cow the')
    assert parsed["terms"] == ["cat", "big", "dog", "bad", "bird", "fish", "cow"]
    first, second = parsed["groups"]
    assert first["need"] == [0, 1, 2]
    assert first["phrases"] == [[{"term": 1, "offset": 0}, {"term": 2, "offset": 1}]]
    assert (second["need"], second["deny"]) == ([5], [6])
    assert second["deny_phrases"] == [[{"term": 3, "offset": 0}, {"term": 4, "offset": 1}]]
    assert parse_web_query(None)["groups"] == []


TEXTS = {
    1: ("a", "red fox jumps over lazy red dog"), 2: ("fox", "red red fox"), 3: ("", "dog fox red"),
    4: ("red fox", "cat"), 5: ("cat", "dog bird"), 6: ("fox", "the red and lazy fox"), 7: (None, None),
}


@pytest.fixture(scope="module")
def animals(spark):
    return spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id int, title string, content_text string")


@pytest.mark.parametrize("query,expected", [
    ("red fox", {1, 2, 3, 4, 6}), ('"red fox"', {1, 2, 4}), ("red -lazy", {2, 3, 4}), ("cat or bird", {4, 5}),
    ('fox -"red fox"', {3, 6}), ("-red", {5, 7}), ('"lazy dog" or "dog bird"', {5}), ("red red", {1, 2, 3, 4, 6}),
    ('"red and lazy"', {6}), ("red-fox", {1, 2, 4}),
])
def test_matching(animals, query, expected):
    assert {r.id for r in text_matches(animals, query, "none").collect()} == expected


def brute_rank(words_with_weights, groups):
    """Sum over minimal spans, by trying every span."""
    terms = {t for g in groups for t in g}
    occ = [(p, w, x) for p, (w, x) in enumerate(words_with_weights, 1) if w in terms]
    spans = []
    for i, j in itertools.combinations_with_replacement(range(len(occ)), 2):
        inside = {o[1] for o in occ[i:j + 1]}
        if any(set(g) <= inside for g in groups):
            spans.append((i, j))
    minimal = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    total = 0.0
    for i, j in minimal:
        n = j - i + 1
        inv = sum(1 / o[2] for o in occ[i:j + 1])
        total += n / inv / (1 + (occ[j][0] - occ[i][0]) - (n - 1))
    return round(total, 9)


@pytest.mark.parametrize("query,groups", [
    ("red fox", [["red", "fox"]]), ("red", [["red"]]), ("cat or bird", [["cat"], ["bird"]]),
    ("red fox or dog", [["red", "fox"], ["dog"]]), ("lazy red fox", [["lazy", "red", "fox"]]),
])
def test_rank_against_all_spans(animals, query, groups):
    found = {r.id: r.text_score for r in text_matches(animals, query, "none").collect()}
    for doc, score in found.items():
        title, body = TEXTS[doc]
        weighted = [(w, 1.0) for w in title.split()] + [(w, 0.4) for w in body.split()]
        assert score == pytest.approx(brute_rank(weighted, groups))


def test_postings_and_scan_agree(animals, spark):
    postings = build_postings(animals, "none")
    for query in ("red fox", '"red fox"', "red -lazy", "cat or bird", 'fox -"red fox"'):
        scan = {(r.id, r.text_score) for r in text_matches(animals, query, "none").collect()}
        stored = {(r.id, r.text_score) for r in text_candidates_from_postings(postings, query, stem="none").collect()}
        queries = spark.createDataFrame([("q", query)], "query_id string, text string")
        many = {(r.id, r.text_score) for r in text_candidates_many(postings, queries, stem="none").collect()}
        scanned = {(r.id, r.text_score) for r in text_candidates_many(animals, queries, stem="none").collect()}
        assert scan == stored == many == scanned


def test_words_of_null(one):
    assert one(words(F.lit(None).cast("string"))) == []


def test_vector_table_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[17] = 0
    vectors[40] = vectors[41]
    items = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None)], "id long, embedding array<float>"
    ).repartition(7)
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in rng.normal(size=16)]) for i in range(5)] + [("none", None)],
        "query_id string, vector array<float>")
    got = vector_candidates_many(items, queries, 10).collect()
    for q in queries.where("vector is not null").collect():
        one_query = vector_candidates(items, F.lit(list(q.vector)), 10).orderBy("rank").collect()
        many = sorted((r.rank, r.id, r.distance) for r in got if r.query_id == q.query_id)
        assert many == [(r.rank, r.id, r.distance) for r in one_query]
        exact = 1 - vectors.astype(float) @ np.array(q.vector) / np.maximum(
            np.linalg.norm(vectors.astype(float), axis=1) * np.linalg.norm(q.vector), 1e-300)
        exact[17] = np.inf
        assert [r.id for r in one_query] == list(np.argsort(exact, kind="stable")[:10])
    assert not [r for r in got if r.query_id == "none"]


def test_vector_table_in_bands_and_shards(spark, monkeypatch):
    from contentspark.operators import vectorsearch

    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id int, vector array<float>")
    whole = {tuple(r) for r in vector_candidates_many(items, queries, 3).collect()}
    monkeypatch.setattr(vectorsearch, "BAND_QUERIES", 4)
    monkeypatch.setattr(vectorsearch, "SHARD_ROWS", 7)
    assert {tuple(r) for r in vector_candidates_many(items, queries, 3).collect()} == whole
    assert len(whole) == 27


def test_wrong_vector_size_is_an_error(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<float>")
    with pytest.raises(Exception, match="components"):
        vector_candidates_many(items, queries, 3).collect()


def test_unread_feed(spark):
    day = datetime(2025, 1, 1)
    rows = [(str(i), "s", f"x{i}", f"t{i}", "u", "c", i % 3 == 0, day + timedelta(days=i // 2)) for i in range(40)]
    items = spark.createDataFrame(
        rows, "id string, source_id string, external_id string, title string, url string, content_text string, "
              "read boolean, published_at timestamp_ntz")
    expected = sorted((r for r in rows if not r[6]), key=lambda r: (-r[7].timestamp(), r[0]))
    for limit in (1, 5, 20, 1000):
        got = unread_feed(items, limit).collect()
        assert [r.id for r in got] == [r[0] for r in expected[:limit]]
    assert unread_feed(items.where("read")).count() == 0
    assert got[0].clean_content == "c"


def test_top_k_per_group_with_one_huge_group(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    order = [F.col("v").asc(), F.col("id").asc()]
    got = {(r.k, r.rank): (r.v, r.id) for r in top_k_per_group(rows, 5, ["k"], order, fan_in=4).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append((r.v, r.id))
    assert got == {(k, n): x for k, g in groups.items() for n, x in enumerate(sorted(g)[:5], 1)}


def test_stop_word_with_the_stem_of_a_query_word(spark):
    items = spark.createDataFrame([(1, "heres", "her her heres"), (2, "", "her")], "id int, title string, content_text string")
    queries = spark.createDataFrame([(0, "heres")], "query_id int, text string")
    postings = build_postings(items, "light")
    expected = {(1, 1.4)}
    assert {tuple(r) for r in text_matches(items, "heres", "light").collect()} == expected
    for source in (items, postings):
        assert {(r.id, r.text_score) for r in text_candidates_many(source, queries, stem="light").collect()} == expected


def test_queries_that_only_deny(animals, spark):
    queries = spark.createDataFrame([(1, "-red"), (2, "red fox"), (3, "cat or -dog"), (4, "-cat -dog")], "query_id int, text string")
    scan = text_candidates_many(animals, queries, stem="none").collect()
    stored = text_candidates_many(build_postings(animals, "none"), queries, stem="none").collect()
    for query_id, text in ((1, "-red"), (2, "red fox"), (3, "cat or -dog"), (4, "-cat -dog")):
        single = {(r.id, r.text_score) for r in text_matches(animals, text, "none").collect()}
        assert {(r.id, r.text_score) for r in scan if r.query_id == query_id} == single
        # An item without any word has no postings.
        assert {(r.id, r.text_score) for r in stored if r.query_id == query_id} == {m for m in single if m[0] != 7}
        found = text_candidates_from_postings(build_postings(animals, "none"), text, stem="none").collect()
        assert {(r.id, r.text_score) for r in found} == {m for m in single if m[0] != 7}


def test_undated_rows_stay_in_the_feed(spark):
    day = datetime(2025, 1, 1)
    rows = [(i, None if i % 2 else day + timedelta(days=i), i == 4) for i in range(8)]
    items = spark.createDataFrame(rows, "id int, published_at timestamp, read boolean").selectExpr(
        "*", "'s' AS source_id", "'e' AS external_id", "'t' AS title", "'u' AS url", "'c' AS content_text")
    for limit in (1, 2, 3, 5, 20):
        assert [r.id for r in unread_feed(items, limit).collect()] == [6, 2, 0, 1, 3, 5, 7][:limit]
    assert [r.id for r in unread_feed(items.where("published_at is null"), 2).collect()] == [1, 3]


def test_long_feed_passes_through_no_single_task(spark):
    rows = spark.range(4000).selectExpr(
        "id % 3900 AS id", "if(id % 3 = 0, NULL, timestamp'2025-01-01' + make_dt_interval(0, 0, 0, id % 7)) AS published_at", "id % 10 = 0 AS read",
        "'s' AS source_id", "'e' AS external_id", "'t' AS title", "'u' AS url", "'c' AS content_text")
    open_rows = [(r.published_at, r.id) for r in rows.where("not read").collect()]
    expected = sorted(open_rows, key=lambda r: (r[0] is None, -r[0].timestamp() if r[0] else 0, r[1]))
    tied = next(i for i in range(2000, 4000) if expected[i] == expected[i + 1]) + 1
    for limit in (1200, 2900, tied, 3600, 5000):
        assert [(r.published_at, r.id) for r in unread_feed(rows, limit).collect()] == expected[:limit]
    plan = unread_feed(rows, 5000)._jdf.queryExecution().optimizedPlan().treeString()
    assert "GlobalLimit" not in plan and "LocalLimit" not in plan
