import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contentspark.llm import packing, registry

PATH = f"{registry.TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


ODD = ["", None, "a", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "it's we'll x<|endoftext|>y", "tab\tnew\nline\x1cfs\x85nel\u00a0nbsp\u2003em", "e\u0301 cafe\u0301 1234 ½",
       "x" * 30000, "word " * 9000, "\u3000 wide \u1680 ogham \u180e mvs \u200b zw", "İstanbul I\u0307", "!!! ??? ...---... 'S"]


def check(rows, texts, plain):
    """Every id of every row once, digests right, sequences gapless."""
    want = sorted(tuple(plain(t)) for t in texts)
    docs, sequences = {}, {}
    for r in rows:
        assert 0 < len(r.ids) // 4 <= packing.SEQUENCE
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    got = [sum((ids for _, ids in sorted(parts)), []) for parts in docs.values()]
    assert sorted(map(tuple, got)) == want


def test_odd_texts(spark, plain):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("grp", F.lit("x"))
    check(packing.pack_documents(rows, PATH).collect(), ODD, plain)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (3, "d e f")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4) for r in out) == [(0, 3), (0, 3), (3, 2), (3, 2), (3, 4)]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_on_table(spark, small, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op4_packing(spark, small).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(docs)
    fill = {}
    for doc_id, parts in by_doc.items():
        ids = np.asarray(plain(docs[doc_id]), "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
            at += r.length
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert at == len(ids)
    assert sum(fill.values()) / (4096 * len(fill)) > 0.95


def test_first_fit_decreasing():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 100):
        lengths = rng.integers(1, 50, n)
        bins, offsets, used = packing.first_fit_decreasing(lengths, 50)
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(50)
            want[i] = (b, 50 - room[b])
            room[b] -= lengths[i]
        assert used == len(room) and {i: (bins[i], offsets[i]) for i in range(n)} == want


def test_sequences(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "e")], "doc_id long, text string")
    lengths = [len(r.input_ids) for r in packing.sequences(packing.pack_documents(rows, PATH), pad_id=0).collect()]
    assert lengths == [4096]


def test_words_encoded_together(plain, monkeypatch):
    """Words share texts, and every word has the ids it has alone."""
    monkeypatch.setattr(packing, "_RUN", 5)
    encoder = packing.TextEncoder(PATH)
    asked, fresh = [], encoder._fresh
    monkeypatch.setattr(encoder, "_fresh", lambda pieces: asked.append(len(pieces)) or fresh(pieces))
    words = ["a", "hello", "x1y2", "3.14", ".", "e.g", "don't", "ß", "ñandú", "中文字", "ﬁ", "½", "٣", "ไทย", "한국어", "a" * 300, "Ⅳ", "zoë", "ǆ", "0", "\u0e33", "ª"]
    got = encoder._fresh_words(words)
    assert {w: np.frombuffer(x, "<u4").tolist() + [2] for w, x in got.items()} == {w: plain(w) for w in words}
    assert sum(asked) < len(words)


def test_memory_of_encoders_in_turn():
    """A worker's tasks of packing between those of other operators: MB that later encoders add, threads they leave, words they keep."""
    code = f"""
import os, re
import numpy as np
from contentspark.llm import common, packing
def now():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open('/proc/self/status').read())[1]) / 1024
def turn(seed):
    encoder = packing.TextEncoder({PATH!r})
    letters = np.random.default_rng(seed).integers(97, 123, (300_000, 9)).astype(np.uint8)
    letters[:, 8] = 32
    text = letters.tobytes().decode()
    kept = 0
    for at in range(0, len(text), 1 << 20):
        encoder.encode([text[at:at + (1 << 20)]])
        kept = max(kept, sum(200 + len(w) + len(i) for known in (encoder.known, encoder.before) for w, i in known.items()))
    return kept >> 20
threads = len(os.listdir('/proc/self/task'))
kept = turn(0)
common._give_back()
base = now()
for seed in (1, 2):
    turn(seed)
    common._give_back()
print(kept, round(now() - base), len(os.listdir('/proc/self/task')) - threads)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, capture_output=True, text=True)
    kept, more, threads = map(int, out.stdout.split())
    assert threads == 0 and kept <= 140 and more < 50
