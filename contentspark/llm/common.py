"""What several operators of this folder share: tables, lineage cuts, word hashes and connected components."""

from __future__ import annotations

import ctypes
import re
import sys
import types
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.session import checkpoint_root, cut_lineage


#: Where the public tokenizers' files are on every executor.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Writes a table that several later stages read into the shared checkpoint folder and reads it back.

    Unlike a checkpoint it is columnar and compressed, and later stages read only the columns they need.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("contentspark_worker_state", types.ModuleType("contentspark_worker_state")).__dict__


#: Bytes that travel to a Python worker at once; long texts make small batches.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The table, after its session has been told to hand rows to Python by bytes; a smaller setting stays."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH_SETTING)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Something a Python worker keeps until a task of another operator comes, such as a tokenizer with the words it has met."""
    held = _held()
    if name not in held:
        held[name] = make()
    return held[name]


#: Bytes of text, and rows, that are worked on at once unless one text is larger.
FEW_BYTES, FEW_ROWS = 1 << 20, 256


def _give_back() -> None:
    """Returns what the allocators of a Python worker hold but do not use; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def few(batches, column: int, most_bytes: int = FEW_BYTES, most_rows: int = FEW_ROWS, keep: str | None = None):
    """Slices of Arrow batches with about so many bytes of text in a column; at least one row each.

    Of what the worker holds only the state named `keep` stays.
    """
    held = _held()
    old = [n for n in held if n != keep and not n.startswith("__")]
    for name in old:
        del held[name]
    if old:
        _give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.append(0, np.cumsum(sizes))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        del batch, sizes, total
    _give_back()


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


# Words of UTF-8 bytes and their hashes, worked out on slices of fixed size whatever the length of a text or a word.

def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values, so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SLICE = 1 << 21
_SHORT = 256
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
# White space that is not one of those six bytes.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _factors(places: np.ndarray) -> np.ndarray:
    """A fixed random-like odd factor for each place in a word."""
    return mixed((places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FIRST_FACTORS = _factors(np.arange(_SHORT))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words are cut at the space and the controls from tab to carriage return."""
    kind = np.int32 if len(data) < 2**31 else np.int64
    starts, ends, before = [], [], False
    for at in range(0, len(data), _SLICE):
        inside = _WORD_BYTE[data[at: at + _SLICE]]
        earlier = np.append(before, inside[:-1])
        starts.append((np.flatnonzero(inside & ~earlier) + at).astype(kind))
        ends.append((np.flatnonzero(earlier & ~inside) + at).astype(kind))
        before = bool(inside[-1])
    if before:
        ends.append(np.asarray([len(data)], kind))
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, kind), np.zeros(0, kind))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum over its bytes with a factor for each place, mixed."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, int(starts[i]) + _SLICE // 4)))
        if int(ends[i]) - int(starts[i]) > _SLICE:
            # One very long word, in pieces.
            for at in range(int(starts[i]), int(ends[i]), _SLICE):
                stop = min(at + _SLICE, int(ends[i]))
                factors = _factors(np.arange(at, stop) - int(starts[i]))
                out[i:i + 1] += ((data[at:stop].astype(np.uint64) + np.uint64(1)) * factors).sum(dtype=np.uint64, keepdims=True)
            i += 1
            continue
        while j > i + 1 and int(ends[j - 1]) - int(starts[i]) > 2 * _SLICE:
            j -= 1
        lengths = (ends[i:j] - starts[i:j]).astype(np.int64)
        firsts = np.append(0, np.cumsum(lengths)[:-1])
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        piece = data[int(starts[i]): int(ends[j - 1])]
        piece = piece[_WORD_BYTE[piece]].astype(np.uint64) + np.uint64(1)
        piece *= _FIRST_FACTORS[place] if lengths.max() <= _SHORT else _factors(place)
        out[i:j] = np.add.reduceat(piece, firsts)
        i = j
    return mixed(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the offsets of the texts in them (one more than texts).

    Words are lower-cased and cut at white space.
    """
    hashes, counts, joined, size = [], [0], [], 0

    def put():
        data = np.frombuffer(b"\n".join(joined), np.uint8)
        starts, ends = word_spans(data)
        hashes.append(hash_words(data, starts, ends))
        limits = np.append(0, np.cumsum([len(t) + 1 for t in joined]))
        counts.extend(np.diff(np.searchsorted(starts, limits)).tolist())

    for text in texts:
        text = (text or "").lower()
        if not text.isascii() and _OTHER_SPACE.search(text) or text.isascii() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            text = _OTHER_SPACE.sub(" ", text)
        joined.append(text.encode("utf-8", "surrogatepass"))
        size += len(joined[-1])
        if size > _SLICE:
            put()
            joined, size = [], 0
    if joined:
        put()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions with fewer words left are absent."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    h = words[:size].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[k: size + k]
    return mixed(h)


def text_tag(text: str | None) -> int:
    """31 bits of a text, to tell texts of one id apart."""
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) & 0x7FFFFFFF


# Connected components by alternating stars: every round links each node's larger neighbours to its smallest one, then
# its smaller neighbours to their smallest. Only minima are aggregated, so a hub is combined before the shuffle.

def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a")
    return small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        lowest.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the component's smallest node.

    edges has columns a and b of one orderable type; nulls and loops are ignored. Each round is written to the shared
    checkpoint folder; the driver sees two numbers a round.
    """
    current = cut_lineage(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        current = cut_lineage(_stars(current))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
