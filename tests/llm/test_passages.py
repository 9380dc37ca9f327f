import random

from pyspark.sql import functions as F

from contentspark.llm import passages, registry

NO_ID = 2**63 - 1


def repeats(rows, least=50):
    """{doc_id: words covered by exact runs of at least so many words that a document with a smaller id holds}, by brute force."""
    split = [(d, (t or "").lower().split()) for d, t in rows]
    grams = {}
    for d, w in split:
        for i in range(len(w) - least + 1):
            grams.setdefault(tuple(w[i:i + least]), set()).add(d)
    out = {}
    for d, w in split:
        for i in range(len(w) - least + 1):
            if min(grams[tuple(w[i:i + least])]) < d:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def holds(places, got):
    """Whether all places are covered but for a few next to a covered one: there the first holder of the words differs by chance."""
    edge = passages.K + passages.WINDOW
    return bool(got) and all(any(p + d in got for d in range(-edge, edge + 1)) for p in places) and len(places - got) <= 2 * edge


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r.doc, set()).update(range(r.start_word, r.end_word))
    return out


def text(rng, n):
    return [f"v{rng.randrange(3000)}" for _ in range(n)]


def build():
    rng = random.Random(2)
    shared, fuzzy = text(rng, 60), text(rng, 120)
    rows = [(i, " ".join(text(rng, rng.randrange(60, 200)))) for i in range(40)]
    for i in range(100, 130):
        rows.append((i, " ".join(text(rng, rng.randrange(0, 80)) + shared + text(rng, 30))))
    for i in range(200, 210):
        own = list(fuzzy)
        for at in rng.sample(range(20, 120, 20), 3):
            own[at + rng.randrange(5)] = f"edit{rng.randrange(9999)}"
        del own[70 + i % 5]
        rows.append((i, " ".join(text(rng, 40) + own + text(rng, 40))))
    rows += [(300, rows[5][1]), (301, rows[5][1].upper()), (302, " ".join(shared[:49]))]
    # A run of 60 words whose halves come from two other documents.
    rows += [(400, " ".join(text(rng, 20) + rows[7][1].split()[:40] + rows[8][1].split()[:40] + text(rng, 20)))]
    return rows


def test_planted(spark):
    rows = build()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "tag": F.lit("y"), "words": F.lit("z")})
    found = passages.find_passages(df).collect()
    got, want = covered(found), repeats(rows)
    for doc, places in want.items():
        assert holds(places, got.get(doc, set())), doc
    assert not set(got) & (set(range(40)) | {100, 200, 302})
    for i in range(201, 210):
        assert len(got[i]) >= 105
    assert len(got[400]) >= 75 and sorted(r.of_doc_ids for r in found if r.doc == 400) == [[7, 8]]
    texts = dict(rows)
    for r in found:
        mine = texts[r.doc].lower().split()[r.start_word:r.end_word]
        other = texts[r.of_doc_id].lower().split()[r.of_start_word:r.of_end_word]
        assert r.of_doc_id < r.doc and r.end_word - r.start_word >= 50
        if len(r.of_doc_ids) == 1:
            assert lcs(mine, other) >= 0.8 * max(len(mine), len(other))


def test_every_copy_counts(spark):
    """A later document may hold a passage more often than the first one, also inside a longer passage."""
    rng = random.Random(12)
    shared, around = text(rng, 80), [text(rng, 70), text(rng, 70)]
    own = [text(rng, 30) for _ in range(12)]
    rows = [(1, own[0] + shared + own[1]), (2, own[2] + shared + own[3] + shared + own[4] + shared), (3, shared + shared + own[5]),
            (4, own[6] + around[0] + shared + around[1]), (5, own[7] + shared + own[8] + around[0] + shared + around[1] + own[9])]
    rows = [(d, " ".join(w)) for d, w in rows] + [(5, " ".join(shared + own[10] + shared))]
    got, want = {}, repeats(rows[:-1])
    for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc, r.tag), set()).update(range(r.start_word, r.end_word))
    for doc, words in rows[:-1]:
        found = got.get((doc, passages.text_tag(words)), set())
        assert len(found ^ want.get(doc, set())) <= 2, doc
    assert len(got[5, passages.text_tag(rows[-1][1])]) in range(160, 163)


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_chain_is_best():
    """The best chain's score equals that of a plain quadratic search."""
    rng = random.Random(4)
    for _ in range(200):
        parts = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(1, 8)) for _ in range(rng.randrange(1, 9))})

        def score(one):
            return sum(p[2] for p in one) - passages.GAP_COST * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(one, one[1:]))

        best = {}
        for i, (b, a, n) in enumerate(parts):
            best[i] = n + max([0] + [best[j] - passages.GAP_COST * (b - y[0] - y[2] + a - y[1] - y[2]) for j, y in enumerate(parts)
                                     if j in best and y[0] + y[2] <= b and y[1] + y[2] <= a])
        chains = passages.chain(parts, max_gap=10**6)
        assert abs(max(map(score, chains)) - max(best.values())) < 1e-9
        assert sorted(p for one in chains for p in one) == parts
        for one in chains:
            assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(one, one[1:]))


def test_common():
    rng = random.Random(6)
    import numpy as np

    for _ in range(100):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(0, 80))] for _ in range(2))
        assert passages._common(np.asarray(x), np.asarray(y)) == lcs(x, y)


def test_odd_rows(spark):
    rng = random.Random(9)
    long = " ".join(text(rng, 80))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (None, long + " more"), (4, "again " * 3000), (5, "again " * 4000),
            (6, " ".join(text(rng, 70))), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.find_passages(df).collect()
    got = covered(found)
    assert set(got) == {NO_ID, 5, 6} and len(got[6]) == 80 and len(got[5]) == 3000
    assert passages.find_passages(df.limit(0)).count() == 0
    left = {}
    for r in passages.cut_passages(df.withColumn("n_chars", F.lit(0)), passages.find_passages(df)).collect():
        left.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert left[1] == [(None, None)] and left[2] == [("", 0)] and left[3] == [(long, len(long))] * 2
    assert left[None] == [("more", 4)] and left[6] == [(rows[8][1], len(rows[8][1]))]


def test_query_on_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = registry.op7_passages(spark, small).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for doc, places in repeats(rows).items():
        assert holds(places, got.get(doc, set()))
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start_char:r.end_char].split() == texts[r.doc_id].split()[r.start_word:r.end_word] for r in found)
