import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from contentspark.llm import common


def test_word_hashes_by_brute_force():
    texts = ["One  two\tTHREE\n", None, "", "one two\xa0three\x1cfour　", "ÄÖ äö 日本", "x" * 5_000_000 + " x", " \x0b\x85 "]
    hashes, offsets = common.word_hashes(texts)
    words = [w for t in texts for w in (t or "").lower().split()]
    assert np.diff(offsets).tolist() == [len((t or "").lower().split()) for t in texts]
    by_word = {}
    for word, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("unit, most", [("'word%d ' % (i * i)", 600), ("'a '", 1100)])
def test_memory_of_one_long_text(unit, most):
    """A text of 40 million letters, also one of one-letter words; MB besides those of the imports."""
    code = f"""
import resource
from contentspark.llm import common
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
unit = ''.join({unit} for i in range(2000))
text = unit * (40_000_000 // len(unit))
hashes, offsets = common.word_hashes([text])
assert len(hashes) == offsets[-1] > 1_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, capture_output=True, text=True)
    assert int(out.stdout) < most


def test_slices_of_batches():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 35, "d" * 35, "e" * 35]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "text"])
    parts = list(common.few([batch], 1, most_bytes=70, most_rows=3))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(common.few([batch.slice(0, 0)], 1)) == []
