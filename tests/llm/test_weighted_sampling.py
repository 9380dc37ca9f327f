import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from contentspark.llm import registry, weighted_sampling

KIND = "doc_id long, text string, a long, tag string, copies int"


def words_of(text):
    words = text.lower().strip(" \t\n\x0b\f\r")
    out = [""]
    for c in words:
        if c in " \t\n\x0b\f\r":
            out += [""] if out[-1] else []
        else:
            out[-1] += c
    return Counter(out)


def jaccard(x, y):
    x, y = words_of(x), words_of(y)
    return sum(min(x[w], y[w]) for w in x) / sum(max(x[w], y[w]) for w in x | y)


def winners(text, samples=weighted_sampling.SAMPLES):
    """The (word, t) of each sample, by the definition."""
    def gamma(h):
        return -math.log(((h >> 32) + 0.5) / 2**32 * (((h & 0xFFFFFFFF) + 0.5) / 2**32))

    out = []
    weights = words_of(text)
    for k in range(samples):
        best = None
        for word, w in weights.items():
            name = xxhash.xxh64(word.encode(), 42).intdigest()
            h = [xxhash.xxh64(struct.pack("<i", 3 * k + i), xxhash.xxh64(struct.pack("<Q", name), 42).intdigest()).intdigest() for i in range(3)]
            r, b = gamma(h[0]), ((h[2] >> 11) + 0.5) / 2**53
            t = math.floor(math.log(w) / r + b)
            value = math.log(gamma(h[1])) - r * (t + 1 - b)
            if best is None or value < best[0]:
                best = (value, word, t)
        out.append(best[1:])
    return out


def text(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n))


def brute(rows):
    order = sorted(((i is not None, i or 0, -(tag(i, t or "")), t or "", i) for i, t, *_ in rows), reverse=True)
    out = []
    for k, (_, _, _, own, doc_id) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), own, edited, following))
    return out


def tag(doc_id, value):
    h = xxhash.xxh64(struct.pack("<i", doc_id is None), xxhash.xxh64(value.encode(), 42).intdigest()).intdigest()
    return h - 2**64 if h >= 2**63 else h


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return registry.op12_weighted_fingerprints(spark, str(tmp_path))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["a", "B", "be", "é", "日本", "🙂", *(f"w{i}" for i in range(40))]
    rows = [(i * 3 - 20, text(rng, rng.choice([0, 1, 5, 40, 200]), vocabulary), 1, "x", 2) for i in range(60)]
    rows += [(500, None, 1, None, 0), (501, "", None, "", 0), (502, " \t\n", 0, "", 0), (None, "no id", 0, "", 0), (None, None, 0, "", 0),
             (7, "tie", 0, "", 0), (7, "tie too", 0, "", 0)] + [(8, "five times the same row, all of it", 0, "", 0)] * 5 + [(None, "no id", 1, "", 0)]
    frame = query(spark, tmp_path, rows)
    assert frame.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted(frame.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[6]))
    drawn = {}
    expected = []
    for doc_id, n, digest, *texts in brute(rows):
        own, edited, following = (drawn.setdefault(x, winners(x)) for x in texts)
        share = [sum(x == y for x, y in zip(own, other)) / len(own) for other in (edited, following)]
        expected.append((doc_id, n, digest, *share))
    expected.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4]))
    assert [(r[0], r[1], r[2]) for r in got] == [r[:3] for r in expected]
    # Two of 65536 hash values a sample may be the same by chance.
    extra = [round(weighted_sampling.SAMPLES * (x - y)) for r, e in zip(got, expected) for x, y in zip(r[5:7], e[3:5])]
    assert set(extra) <= {0, 1} and sum(extra) <= 2
    prints = {}
    for (_, _, _, own, *_), r in zip(sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])), got):
        assert len(r["fingerprint"]) == 4 * weighted_sampling.SAMPLES
        if len([1 for x in rows if x[0] == r[0]]) == 1:
            assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("rows", [[], [(4, "alone with itself", 0, "", 0)], [(4, None, 0, "", 0)] * 3])
def test_empty_single_and_repeated(spark, tmp_path, rows):
    got = sorted((r[0], r[1], r[2]) for r in query(spark, tmp_path, rows).collect())
    assert got == sorted(r[:3] for r in brute(rows))


def test_many_copies_of_one_row(spark, tmp_path):
    rows = [(1, "again and again", 0, "", 0)] * 3500 + [(2, "other", 0, "", 0)]
    got = query(spark, tmp_path, rows).groupBy("doc_id", "near_next", "edited_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 3499]


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many pairs of own words the mean difference to the true similarity vanishes, single ones stay within the sampling error."""
    rng = random.Random(9)
    pairs = []
    for i in range(400):
        base = [f"{i}{rng.choice('abcdefghijklmnopqrst')}" for _ in range(60)]
        other = [w if rng.random() < rng.choice([0.2, 0.7, 0.95]) else f"{i}{rng.choice('abc')}" for w in base]
        pairs.append((i, " ".join(base), " ".join(other)))
    frame = spark.createDataFrame(pairs, "i int, x string, y string")
    found = weighted_sampling.fingerprints(frame, ["i"], {"x": "fx", "y": "fy"})
    got = {r[0]: r[1] for r in found.select("i", weighted_sampling.likeness(F.col("fx"), F.col("fy"))).collect()}
    errors = [got[i] - jaccard(a, b) for i, a, b in pairs]
    assert abs(sum(errors) / len(errors)) < 4 * 0.5 / (400 * weighted_sampling.SAMPLES) ** 0.5
    assert max(map(abs, errors)) < 4.5 * 0.5 / weighted_sampling.SAMPLES**0.5


def test_no_python_in_the_plan(spark, small):
    frame = registry.op12_weighted_fingerprints(spark, small)
    plan = frame._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
