"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words that repeats with a smallest period q, is at least max(24, 3q) words long and
cannot be extended. Every run of period q in [B, 2B) holds a whole aligned block of B words together with that block's
copy q words further on. So at each dyadic scale B the aligned blocks are compared with the two blocks that follow, at
all distances of the scale at once: words become small numbers, and an exact number-theoretic transform gives the sums
of squared differences. A sum is zero only where the block occurs again, and that distance seeds an extension word by
word to both sides. The smallest scale, B = 8, covers the distances 1 to 15, because short periods need 24 words.

Texts of a task are handled together, about a million bytes at a time, as one row of words in which no block reaches
over the end of a text. A column of a transform has at most 2^17 points however long a text is: larger blocks are sought by their
first 2^16 words, and the extension decides. A document is one row; nothing is shuffled.

Null and empty texts have no words and no runs. Null ids stay null, repeated rows are answered each, an empty table
gives no rows, and columns other than the two named ones are ignored. Words are compared by a 64-bit hash of their
bytes. A very long text needs about forty bytes for each of its words besides the text itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import few, hash_words, small_batches, word_spans

MIN_WORDS = 24
MIN_EXPONENT = 3
SMALLEST_BLOCK = 8
LARGEST_PATTERN = 1 << 16

# A prime of the form k * 2^23 + 1 and a generator of its multiplicative group.
PRIME = 998244353
GENERATOR = 3

_P = np.uint64(PRIME)
# Numbers transformed together, in columns side by side so that the innermost loop is never short.
_CHUNK = 1 << 16
_COLUMNS = 8


def _reduced(x: np.ndarray) -> np.ndarray:
    """Products back below the prime; the division by a constant is vectorised, the remainder is not."""
    return x - x // _P * _P


def _once(x: np.ndarray) -> np.ndarray:
    """Sums below twice the prime back below it; a negative difference wraps to a large number."""
    return np.minimum(x, x - _P)


@lru_cache(maxsize=64)
def _twiddles(half: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(half, np.uint64)
    done, step = 1, root
    while done < half:
        out[done: 2 * done] = _reduced(out[:done] * np.uint64(step))
        done, step = 2 * done, step * step % PRIME
    return out


def transform(columns: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each column, in bit-reversed order."""
    size, count = columns.shape
    half = size // 2
    while half:
        pairs = columns.reshape(-1, 2, half, count)
        low, high = pairs[:, 0], pairs[:, 1]
        out = np.empty_like(pairs)
        out[:, 0] = _once(low + high)
        difference = low + (_P - high)
        out[:, 1] = _reduced(difference * _twiddles(half, False)[:, None]) if half > 1 else _once(difference)
        columns, half = out.reshape(size, count), half // 2
    return columns


def inverse_transform(columns: np.ndarray) -> np.ndarray:
    """Back from `transform`."""
    size, count = columns.shape
    half = 1
    while half < size:
        pairs = columns.reshape(-1, 2, half, count)
        low, high = pairs[:, 0], pairs[:, 1]
        if half > 1:
            high = _reduced(high * _twiddles(half, True)[:, None])
        out = np.empty_like(pairs)
        out[:, 0] = _once(low + high)
        out[:, 1] = _once(low + (_P - high))
        columns, half = out.reshape(size, count), half * 2
    return _reduced(columns * np.uint64(pow(size, -1, PRIME)))


@lru_cache(maxsize=32)
def _negated(size: int) -> np.ndarray:
    """Where the frequency -k stands for every place of the bit-reversed order."""
    order = np.zeros(1, np.int64)
    while len(order) < size:
        order = np.concatenate([2 * order, 2 * order + 1])
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[(size - order) % size]


def squared_differences(values: np.ndarray, starts: np.ndarray, pattern: int, first: int, distances: int) -> np.ndarray:
    """Sums over j < pattern of (values[s+j] - values[s+first+d+j])^2, a row for each d < distances, a column for each start s.

    Exact while pattern times the square of the largest value stays below the prime.
    """
    span = pattern + distances - 1
    size = 1 << max(0, span - 1).bit_length()
    blocks = np.zeros((size, len(starts)), np.uint64)
    blocks[:pattern] = values[np.arange(pattern)[:, None] + starts]
    windows = np.zeros((size, len(starts)), np.uint64)
    windows[:span] = values[(np.arange(span) + first)[:, None] + starts]
    own = (blocks[:pattern] * blocks[:pattern]).sum(axis=0)
    squares = np.cumsum(windows[:span] * windows[:span], axis=0)
    there = squares[pattern - 1:]
    there[1:] -= squares[: distances - 1].copy()
    product = _reduced(transform(blocks)[_negated(size)] * transform(windows))
    both = inverse_transform(product)[:distances]
    return _reduced(own + there + np.uint64(2) * (_P - both))


def _candidates(values: np.ndarray, ends: np.ndarray, block: int, first: int, last: int):
    """(places, distances) at which an aligned block occurs again in its own text."""
    starts = np.arange(0, len(values), block)
    starts = starts[starts + first + block <= ends[starts]]
    pattern = min(block, LARGEST_PATTERN)
    # Small enough that a sum of squares is exact, and never below two values.
    levels = np.uint64(max(2, int(((PRIME - 1) // pattern) ** 0.5)))
    # Windows may reach over the end of the last text; what lies there is never a candidate.
    small = np.concatenate([values % levels, np.zeros(2 * last + 2 * pattern, np.uint64)])
    places, found = [], []
    for lowest in range(first, last + 1, pattern if block > SMALLEST_BLOCK else last):
        distances = min(last + 1 - lowest, pattern if block > SMALLEST_BLOCK else last)
        size = 1 << (pattern + distances - 2).bit_length()
        columns = max(_COLUMNS, _CHUNK // size)
        for at in range(0, len(starts), columns):
            some = starts[at: at + columns]
            d, column = np.nonzero(squared_differences(small, some, pattern, lowest, distances) == 0)
            places.append(some[column])
            found.append(d + lowest)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    inside = places + found + pattern <= ends[places] if len(places) else np.zeros(0, bool)
    return places[inside], found[inside], pattern


def _equal_right(words: np.ndarray, at: int, distance: int, stop: int) -> int:
    """How many words from `at` on equal the word `distance` further, which lies before `stop`."""
    n, step = 0, 64
    while (size := min(step, stop - distance - at - n)) > 0:
        differ = words[at + n: at + n + size] != words[at + n + distance: at + n + distance + size]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, step = n + size, min(2 * step, 1 << 16)
    return n


def _equal_left(words: np.ndarray, at: int, distance: int, low: int) -> int:
    """How many words before `at`, none before `low`, equal the word `distance` further."""
    n, step = 0, 64
    while (size := min(step, at - low - n)) > 0:
        differ = (words[at - n - size: at - n] != words[at - n - size + distance: at - n + distance])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, step = n + size, min(2 * step, 1 << 16)
    return n


def _not_covered(places: np.ndarray, distances: np.ndarray, pattern: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Candidates, in order of place, that are no multiple of the period of a run around them."""
    keep = np.ones(len(places), bool)
    for start, stop, period in runs:
        a, b = np.searchsorted(places, (start, stop))
        if a < b:
            keep[a:b] &= (distances[a:b] % period != 0) | (places[a:b] + distances[a:b] + pattern > stop)
    return keep


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, in order; text i is words[bounds[i]: bounds[i + 1]]."""
    sizes = np.diff(bounds)
    out = [[] for _ in sizes]
    block, known = SMALLEST_BLOCK, {}
    while len(some := np.flatnonzero(sizes >= max(MIN_WORDS, MIN_EXPONENT * block if block > SMALLEST_BLOCK else 0))):
        # Texts too short for this scale are left out; the others stand side by side.
        if len(some) == len(sizes):
            values, offsets = words, bounds
        else:
            values = np.concatenate([words[bounds[i]: bounds[i + 1]] for i in some])
            offsets = np.append(0, np.cumsum(sizes[some]))
        ends = np.repeat(offsets[1:], sizes[some])
        first = 1 if block == SMALLEST_BLOCK else block
        places, distances, pattern = _candidates(values, ends, block, first, 2 * block - 1)
        order = np.lexsort((distances, places))
        places, distances = places[order], distances[order]
        low = first
        while low < 2 * block and len(places):
            part = (distances >= low) & (distances < 2 * low)
            owner = np.searchsorted(offsets, places[part], "right") - 1
            runs = [(s + offsets[k], e + offsets[k], q) for k in np.unique(owner).tolist() for s, e, q in known.get(int(some[k]), ())]
            at, by = places[part], distances[part]
            kept = _not_covered(at, by, pattern, runs)
            at, by = at[kept], by[kept]
            order = np.lexsort((at, by))
            done = (0, 0)
            for p, d in zip(at[order].tolist(), by[order].tolist()):
                if d == done[0] and p < done[1]:
                    continue
                k = int(np.searchsorted(offsets, p, "right")) - 1
                base, stop = int(offsets[k]), int(offsets[k + 1])
                right = p + _equal_right(values, p, d, stop)
                if right - p < pattern:
                    continue
                left = p - _equal_left(values, p, d, base)
                done = (d, right)
                if right + d - left >= max(MIN_WORDS, MIN_EXPONENT * d):
                    known.setdefault(int(some[k]), []).append((left - base, right + d - base, d))
            low *= 2
        block *= 2
    for i, runs in known.items():
        out[i] = sorted((s, e - s, q) for s, e, q in runs)
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; the first such, then the one of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _kept_text(data: bytes, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what repeats a run's first period."""
    n = len(starts)
    drop = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:n]) > 0
    turns = np.flatnonzero(np.diff(gone)) + 1
    cuts = [0, *turns.tolist(), n]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        if a < b and not gone[a]:
            for at in range(a, b, 1 << 18):
                parts.append(b" ".join(data[int(starts[at]): int(ends[min(at + (1 << 18), b) - 1])].split()))
    return b" ".join(parts)


_RUN = "start: long, length: long, period: long"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _as_run(run):
    return None if run is None else dict(zip(("start", "length", "period"), run))


def _detect(batches):
    for part in few(batches, 1, most_rows=1 << 12):
        texts = [t.as_py() or b"" for t in part.column(1).cast(pa.binary())]
        data = b"\n".join(texts)
        view = np.frombuffer(data, np.uint8)
        starts, ends = word_spans(view)
        limits = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        bounds = np.searchsorted(starts, limits)
        found = find_runs(hash_words(view, starts, ends), bounds)
        collapsed = [_kept_text(data, starts[a:b], ends[a:b], runs) for a, b, runs in zip(bounds, bounds[1:], found)]
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.array(np.diff(bounds), pa.int64()),
            pa.array([[_as_run(r) for r in runs] for runs in found], pa.list_(_RUN_TYPE)),
            pa.array([_as_run(strongest(runs)) for runs in found], _RUN_TYPE),
            pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of each document.

    `runs` holds (start, length, period) by start, then period, in words from 0; `strongest` is the run with the greatest
    length / period, null without runs; `collapsed` is the text with one period of each run left.
    """
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(
        _detect, f"doc_id long, n_words long, runs array<struct<{_RUN}>>, strongest struct<{_RUN}>, collapsed string")
