"""The stages against plain Python, each on what its predecessor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from contentspark.llm import registry
from tests.llm import test_decontaminate, test_ngram_join, test_passages

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage was given and gave, over the table with odd rows added."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id % 3 = 0 or doc_id < 150")
    odd = [(10**6, None, "en", "x", 0), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "42 !", None, None, None),
           (10**6 + 3, "the and of it is " * 3000, None, "x", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    folder = tmp_path_factory.mktemp("pipeline")
    out = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, MIDDLE).write.parquet(f"file://{folder}/{at}")
        docs = spark.read.parquet(f"file://{folder}/{at}")
        out[name] = before.collect(), docs.collect(), docs.columns
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_language(stages):
    before, after, _ = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {10**6, 10**6 + 1, 10**6 + 2} and len(after) == len(before) - 3


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    want = {d for d, c, _ in test_ngram_join.brute([(r.doc_id, r.text) for r in before]) if d == c}
    assert {r.doc_id for r in after} == want < {r.doc_id for r in before} and len(after) == len(want)


def test_repeated_passages(stages):
    before, after, _ = stages["repeated_passages"]
    old, new = {r.doc_id: r.text for r in before}, {r.doc_id: r for r in after}
    repeated = test_passages.repeats(list(old.items()))
    assert repeated
    for doc_id, text in old.items():
        if doc_id not in new:
            words = text.split()
            assert doc_id in repeated or any(
                len(set(words) & set(other.split())) >= 0.7 * len(set(words)) and
                test_passages.lcs(words, other.split()) >= 0.8 * len(words) for d, other in old.items() if d < doc_id)
            continue
        words, left = text.split(), new[doc_id].text.split()
        assert test_passages.lcs(words, left) == len(left) if len(left) < len(words) and len(words) < 1500 else len(left) <= len(words)
        assert new[doc_id].n_chars == len(new[doc_id].text) or new[doc_id].text == text
        if doc_id in repeated:
            assert len(left) <= len(words) - len(repeated[doc_id]) + 2 * (test_passages.passages.K + test_passages.passages.WINDOW)
    # What is left holds no passage of fifty words twice.
    assert not test_passages.repeats([(d, r.text) for d, r in new.items()])


def test_decontamination(stages, spark):
    before, after, _ = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    gone = [r for r in before if r.doc_id not in kept]
    assert gone and all(any(test_decontaminate.leaks(r.text, i) for i in items) for r in gone)
    assert not any(i in r.text for r in after for i in items)
    assert len(before) == len(after) + len(gone)


def test_packing(stages):
    before, after, _ = stages["packing"]
    tokenizer = Tokenizer.from_file(f"{registry.TOKENIZERS}/word_bpe_49k.json")
    parts = {}
    for r in after:
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in before:
        assert sum((ids for _, ids in sorted(parts[r.doc_id])), []) == tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
    assert set(parts) == {r.doc_id for r in before}


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).select("doc_id", "sequence_id", "offset").count() > 0


def test_stages_on_missing_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(60)
    twice = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, MIDDLE)
        assert out.columns == docs.columns and out.count() <= 85, name
    assert corpus_pipeline.drop_near_duplicates(spark, twice, MIDDLE).count() == corpus_pipeline.drop_near_duplicates(spark, docs, MIDDLE).count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), MIDDLE).count() == 0, name
