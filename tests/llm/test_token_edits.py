import random

import pytest
from pyspark.sql import functions as F

from contentspark.llm import registry, token_edits

RANKS = f"{registry.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def counter():
    return token_edits.Counter(RANKS)


def plain(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_random_edits(counter):
    """After every edit the sum of the tree is the count of the whole text."""
    rng = random.Random(12)
    bits = ["a", "word", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "re", "12", "7", "!", "...", "é", "日本", "\t", " the", " ", "'l", "l"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 50, 1500])))
        document = token_edits.Document(counter, text)
        assert document.tokens == plain(counter, text)
        for _ in range(12):
            a = rng.randrange(-2, len(document.text) + 3)
            b = a + rng.choice([0, 0, 1, 2, 10, 300])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 400])))
            want = document.text[:max(0, a)] + new + document.text[max(0, a, b):]
            document.edit(a, b, new)
            assert document.text == want
            assert document.tokens == plain(counter, want), (text, a, b, new)
            chars, tokens = document.leaves()
            assert sum(chars) == len(want) and sum(tokens) == document.tokens


def test_edit_is_local(counter):
    rng = random.Random(3)
    text = " ".join(f"word{rng.randrange(999)}" for _ in range(50000))
    document = token_edits.Document(counter, text)
    for at in range(1000, 300000, 30000):
        document.edit(at, at + 5, "other text")
    assert document.tokens == plain(counter, document.text) and document.reencoded < 10000


def test_cleaning_edits():
    text = "mail a.b@c.org now\nsame\nsame\nsame\n+1 (017) 555-7713 token = \"2abc3ff2ca8fb1e4\" end"
    for a, b, new in token_edits.cleaning_edits(text):
        text = text[:a] + new + text[b:]
    assert text == "mail <masked> now\nsame\n<masked> <masked> end"


def test_state_and_edits_table(spark, counter):
    docs = [(1, "one two three"), (2, None), (3, ""), (None, "no id"), (4, "x" * 100000), (5, "same"), (5, "same")]
    counted = token_edits.count_tokens(
        spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "edits": F.lit("y")}), RANKS)
    edits = [(1, 1, 0, 3, "zero"), (1, 2, 4, 5, "  "), (2, 1, 0, 0, "new text"), (None, 1, 0, 2, "an"), (5, 1, 4, 4, "!"), (5, 2, None, None, None),
             (9, 1, 0, 1, "none")]
    rows = token_edits.apply_edits(counted, spark.createDataFrame(edits, "doc_id long, edit_no int, start int, end int, new string"), RANKS).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.n_tokens == (plain(counter, r.text) if r.text else 0)
    assert got == {1: ["zero  two three"], 2: ["new text"], 3: [""], None: ["an id"], 4: ["x" * 100000], 5: ["same!"] * 2}
    assert token_edits.count_tokens(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_query_on_table(spark, small, counter):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op2_token_counts(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id]
        assert r.n_tokens == plain(counter, text)
        edits = token_edits.cleaning_edits(text)
        for a, b, new in edits:
            text = text[:a] + new + text[b:]
        assert (r.edits, r.n_tokens_after, r.n_chars_after) == (len(edits), plain(counter, text), len(text))
    assert any(r.edits for r in rows)


def test_cleaning_takes_time_in_proportion():
    """Texts of one long word, of repeated lines and of numbers without an end: twice the length, about twice the time."""
    import time

    for make in (lambda n: "x" * n, lambda n: "same line\n" * (n // 10), lambda n: "a@b" * (n // 3), lambda n: "1 (" + " " * n,
                 lambda n: "mail me@you.net\n" * (n // 16)):
        took = []
        for n in (200_000, 400_000):
            text = make(n)
            start = time.perf_counter()
            token_edits.cleaning_edits(text)
            took.append(time.perf_counter() - start)
        assert took[1] < 3.5 * took[0] + 0.5, (make(30), took)


def test_cleaning_of_repeated_lines_and_masks():
    text = "write me@you.net\nwrite me@you.net\nwrite me@you.net\nkey = abcdefgh1\n\n\ncall +49 30 1234567"
    cleaned = text
    for start, end, new in token_edits.cleaning_edits(text):
        cleaned = cleaned[:start] + new + cleaned[end:]
    assert cleaned == "write <masked>\n<masked>\n\n\ncall <masked>"
