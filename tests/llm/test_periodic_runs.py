import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from contentspark.llm import common, periodic_runs, registry

KIND = "doc_id long, text string, lang string, n_words long"


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(q % p == 0 and s <= i and j + q <= s + m for s, m, p in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_texts(rng):
    space = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\f"]
    for _ in range(150):
        letters = rng.choice(["ab", "abcdefghij", "äé日🙂"])
        n = rng.choice([0, 1, 23, 24, 30, 72, 100, 400])
        words = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 24:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                b = rng.randint(a, n)
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        yield rng.choice(["", " ", "\n"]) + "".join(w + rng.choice(space) for w in words)


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    return registry.op13_periodic_runs(spark, str(tmp_path))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [*odd_texts(rng), None, "", " \t\n", "one", "same " * 23, "same " * 24, "a b " * 12, "a b " * 36, "    " * 40,
             "a b c " * 9 + "x " + "a b c " * 9, "x y " * 13 + "y x " * 13]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "a b " * 20, "en", 1), (None, None, None, None), (-3, "u v w " * 30, "", 0)]
    rows += rows[:40] + rows[-3:]
    got = query(spark, tmp_path, rows)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []


def test_runs_and_text_of_the_operator(spark):
    rows = [(1, "head " + "tick tock " * 20 + "tail"), (2, "no run"), (3, None)]
    got = {r["doc_id"]: r for r in periodic_runs.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 40, 2)] and tuple(got[1]["strongest"]) == (1, 40, 2)
    assert got[1]["collapsed"] == "head tick tock tail" and got[1]["n_words"] == 42
    assert got[2]["collapsed"] == "no run" and got[2]["strongest"] is None and got[3]["collapsed"] == "" and got[3]["n_words"] == 0


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5000, 400).astype(np.uint64)
    starts = np.arange(0, 320, 16)
    got = periodic_runs.squared_differences(values, starts, 16, 16, 16)
    plain = values.astype(np.int64)
    for k, s in enumerate(starts):
        assert [int(((plain[s: s + 16] - plain[s + 16 + d: s + 32 + d]) ** 2).sum()) for d in range(16)] == got[:, k].tolist()
    columns = rng.integers(0, periodic_runs.PRIME, (64, 5)).astype(np.uint64)
    assert (periodic_runs.inverse_transform(periodic_runs.transform(columns)) == columns).all()


@pytest.mark.parametrize("period", [1, 7, 1000, 25_000, 33_333])
def test_long_text_of_one_run(period):
    words = np.random.default_rng(2).integers(1, 2**62, 100_000).astype(np.uint64)
    words = words[np.arange(100_000) % period]
    assert periodic_runs.find_runs(words, np.array([0, 100_000])) == [[(0, 100_000, period)]]


def test_blocks_beyond_the_largest_pattern(monkeypatch):
    """Blocks sought by their first words only give the same runs."""
    monkeypatch.setattr(periodic_runs, "LARGEST_PATTERN", 16)
    rng = random.Random(8)
    for _ in range(40):
        n = rng.choice([200, 700])
        words = [rng.randrange(3) for _ in range(n)]
        a = rng.randrange(n // 3)
        p = rng.randint(1, (n - a) // 3)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        assert periodic_runs.find_runs(np.array(words, np.uint64), np.array([0, n])) == [brute_runs(words)]


def test_words_of_any_length():
    data = b"  " + b"x" * 5_000_000 + b" " + b"x" * 4_999_999 + b"\n" + b"x" * 5_000_000 + "\tä ".encode() + b"y" * 300
    view = np.frombuffer(data, np.uint8)
    starts, ends = common.word_spans(view)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
    hashes = common.hash_words(view, starts, ends)
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4
