import random

import pytest

from contentspark.llm import ngram_join, registry


def brute(rows, n=5):
    """(doc_id, class_id, n_links) by comparing all pairs of sets of words."""
    def grams(text):
        words = tuple((text or "").lower().split())
        k = min(n, len(words))
        return frozenset(words[i:i + k] for i in range(len(words) - k + 1)) if words else frozenset()

    sets = [grams(t) for _, t in rows]
    holders, root, links = {}, list(range(len(rows))), [0] * len(rows)
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in holders[g]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, least.get(find(i)), n) for i, (d, _), n in zip(range(len(rows)), rows, links)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "'x' as bands")
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **options).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_banding():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert (bands, rows) == (24, 5) and (1 - 0.8**rows) ** bands <= 1e-4
    with pytest.raises(ValueError):
        ngram_join.banding(0.1, 0.9999999, 8)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(1, 6))) for i in range(120)]
    rows += [(200 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90)))) for i in range(150)]
    rows += [(400 + i, rows[121 + i][1].upper()) for i in range(40)] + [(500, rows[3][1])] * 3
    return rows


@pytest.mark.parametrize("together", [1024, 20])
def test_planted_groups(spark, planted, together):
    assert run(spark, planted, together=together) == brute(planted)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (6, "two one"),
            (None, "only nulls have this text here"), (None, "only nulls have this text here"), (7, "x " * 50000), (8, "x " * 60000),
            (9, "same id other text of words"), (9, "quite another text with words in it")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_query_on_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in registry.op8_ngram_join(spark, small).collect()), key=repr)
    assert got == brute(rows)


def test_links_do_not_depend_on_the_size_of_a_component(spark):
    """Texts around the threshold: verified together or by tiles of buckets, every row has the same class and links."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    together, tiles = (sorted(tuple(r) for r in ngram_join.near_duplicates(frame, together=n).collect()) for n in (1024, 20))
    assert together == tiles and max(r[2] for r in together) > 20


def test_many_rows_without_id(spark):
    """Rows without an id meet by their text, not all with all."""
    frame = spark.range(100_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('row number ', id, ' of many rows with words ', id * 7) AS text")
    got = ngram_join.near_duplicates(frame.unionByName(frame.limit(10))).groupBy("n_links").count().collect()
    assert {r["n_links"]: r["count"] for r in got} == {0: 99_990, 1: 20}
