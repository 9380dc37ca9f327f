"""Repeated passages across documents by collinear chaining of shared k-mers.

Every document gives its minimizers: the smallest word k-mer hash of every window. The occurrences of a shared k-mer
are all joined to the one in the smallest document, so a passage in n documents makes n - 1 anchors per k-mer. Anchors
of two documents are chained in order by a Fenwick tree with gap costs, chains are aligned on the words themselves,
and the aligned pieces of a document are merged into passages. Anchors, chains and words of a document are bounded by
its own length, whatever the number of documents that share them.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import few, gram_hashes, small_batches, stored, text_tag, word_hashes

K, WINDOW = 7, 10
MIN_WORDS = 50
#: Longest stretch without a common k-mer inside a chain, cost of a skipped word, and words looked at beyond a chain.
MAX_GAP, GAP_COST, MARGIN = 40, 0.1, 24
MIN_PIECE = 10
_NO_ID = 2**63 - 1
_CUT = 10


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, turns) of the smallest k-mer of every window.

    The turn counts the occurrences of a k-mer in these words from 0; one that overlaps the occurrence before has -turn.
    """
    grams = gram_hashes(words, k)
    if not len(grams):
        return grams, np.zeros(0, np.int64), np.zeros(0, np.int32)
    width = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    hashes = grams[at]
    order = np.lexsort((at, hashes))
    same = np.append(False, hashes[order][1:] == hashes[order][:-1])
    index = np.arange(len(order))
    turn = index - np.maximum.accumulate(np.where(same, 0, index))
    close = np.append(False, np.diff(at[order]) < k) & same
    turns = np.empty(len(order), np.int32)
    turns[order] = np.where(close, -turn, turn)
    return hashes, at, turns


def _seeded(k: int, window: int, min_words: int):
    def run(batches):
        for part in few(batches, 1):
            texts = part.column(1).to_pylist()
            words, offsets = word_hashes(texts)
            seeds, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            turns = [np.zeros(0, np.int32)]
            for doc_id, text, a, b in zip(part.column(0).to_pylist(), texts, offsets, offsets[1:]):
                if b - a >= min_words:
                    h, at, turn = minimizers(words[a:b], k, window)
                    seeds.append(h)
                    turns.append(turn)
                    ids.append(np.full(len(h), _NO_ID if doc_id is None else doc_id))
                    places.append((text_tag(text) << 32) + at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places)),
                 pa.array(np.concatenate(turns))], names=["seed", "doc", "place", "turn"])

    return run


def _worded(min_words: int):
    """(doc, tag, words): 32 bits of every word of the documents long enough."""
    def run(batches):
        for part in few(batches, 1):
            texts = part.column(1).to_pylist()
            words, offsets = word_hashes(texts)
            short = (words >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rows = [(_NO_ID if d is None else d, text_tag(t), short[a:b])
                    for d, t, a, b in zip(part.column(0).to_pylist(), texts, offsets, offsets[1:]) if b - a >= min_words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc", "tag", "words"])

    return run


def segments(b: np.ndarray, a: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Anchors in order of b, merged where they overlap or touch on one diagonal: (start in b, start in a, length)."""
    cut = np.flatnonzero((b[1:] - b[:-1] > k) | (b[1:] - a[1:] != b[:-1] - a[:-1])) + 1
    starts, ends = np.append(0, cut), np.append(cut - 1, len(b) - 1)
    return list(zip(b[starts].tolist(), a[starts].tolist(), (b[ends] - b[starts] + k).tolist()))


def chain(parts: list[tuple[int, int, int]], max_gap: int = MAX_GAP, cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Best chains of segments that go up in both texts, every segment in one chain at most.

    A chain scores its words less the cost of the words skipped in both texts. The Fenwick tree holds, by end in the
    other text, the best score so far plus what had been paid up to there, so the best predecessor is a prefix maximum.
    """
    if len(parts) == 1:
        return [parts]
    parts = sorted(parts)
    ends = sorted({a + n for _, a, n in parts})
    rank = {e: i + 1 for i, e in enumerate(ends)}
    tree = [(float("-inf"), -1)] * (len(ends) + 1)
    score, before = [0.0] * len(parts), [-1] * len(parts)
    # Segments enter the tree when the walk along b has passed their end.
    waiting = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    nxt = 0
    def put(j: int) -> None:
        b, a, n = parts[j]
        entry = (score[j] + cost * (b + n + a + n), j)
        i = rank[a + n]
        while i < len(tree):
            if entry > tree[i]:
                tree[i] = entry
            i += i & -i

    for i, (b, a, n) in enumerate(parts):
        while nxt < len(waiting) and parts[waiting[nxt]][0] + parts[waiting[nxt]][2] <= b:
            put(waiting[nxt])
            nxt += 1
        at, best = bisect.bisect_right(ends, a), (float("-inf"), -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - cost * (a + b)
        score[i] = n + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        one = []
        while i >= 0 and not used[i]:
            used[i] = True
            one.append(parts[i])
            i = before[i]
        one.reverse()
        start = 0
        for j in range(1, len(one) + 1):
            if j == len(one) or max(one[j][0] - one[j - 1][0] - one[j - 1][2], one[j][1] - one[j - 1][1] - one[j - 1][2]) > max_gap:
                if j > start:
                    out.append(one[start:j])
                start = j
    return out


def _chained(k: int):
    """Rows of one document with the anchors it shares with others -> two rows a chain: the stretch wanted of either text."""
    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("doc", "tag", "chain", "side", "of_doc", "of_tag", "lo", "len", "parts")}
            anchors = batch.column(2)
            for row in range(batch.num_rows):
                doc, tag = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                items = anchors[row].values
                other, other_place, at = (items.field(i).to_numpy() for i in range(3))
                other_tag, a, b = other_place >> 32, other_place & 0xFFFFFFFF, at & 0xFFFFFFFF
                order = np.lexsort((b, other_tag, other))
                other, other_tag, a, b = other[order], other_tag[order], a[order], b[order]
                cuts = np.flatnonzero((other[1:] != other[:-1]) | (other_tag[1:] != other_tag[:-1])) + 1
                number = 0
                for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(b))):
                    for one in chain(segments(b[lo:hi], a[lo:hi], k)):
                        (b0, a0, _), (b1, a1, n1) = one[0], one[-1]
                        for side, where, start, end in ((0, (doc, tag), b0, b1 + n1), (1, (int(other[lo]), int(other_tag[lo])), a0, a1 + n1)):
                            start = max(0, start - MARGIN)
                            for name, value in zip(out, (doc, tag, number, side, *where, start, end + MARGIN - start,
                                                         [x for part in one for x in part] if side == 0 else None)):
                                out[name].append(value)
                        number += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    if not len(x) or not len(y):
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _grown(equal: np.ndarray) -> tuple[int, int]:
    """(words, matches) of the best extension along a diagonal: a match counts 1, a difference -2."""
    if not len(equal):
        return 0, 0
    total = np.cumsum(np.where(equal, 1, -2))
    best = int(total.argmax())
    return (best + 1, int(equal[:best + 1].sum())) if total[best] > 0 else (0, 0)


def align(parts: list[tuple[int, int, int]], b: np.ndarray, b_lo: int, a: np.ndarray, a_lo: int,
          similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Aligned pieces (start, end in b, start, end in a, matching words) of a chain, from the words of both stretches."""
    def same(i: int, j: int, n: int) -> np.ndarray:
        return b[i - b_lo: i - b_lo + n] == a[j - a_lo: j - a_lo + n]

    # Own matches of each segment, and common words in the gap before it.
    steps = []
    for at, (i, j, n) in enumerate(parts):
        gap = 0
        if at:
            pi, pj, pn = parts[at - 1]
            gap = _common(b[pi + pn - b_lo: i - b_lo], a[pj + pn - a_lo: j - a_lo])
            lost = max(i - pi - pn, j - pj - pn) - gap
            steps.append([i, j, n, int(same(i, j, n).sum()), gap, lost])
        else:
            steps.append([i, j, n, int(same(i, j, n).sum()), 0, 0])
    out, todo = [], []
    start = 0
    for at in range(1, len(steps) + 1):
        if at == len(steps) or steps[at][5] > _CUT:
            todo.append((start, at))
            start = at
    while todo:
        lo, hi = todo.pop()
        first, last = steps[lo], steps[hi - 1]
        back = min(first[0] - b_lo, first[1] - a_lo)
        more, extra = _grown(same(first[0] - back, first[1] - back, back)[::-1])
        on = min(len(b) + b_lo - last[0] - last[2], len(a) + a_lo - last[1] - last[2])
        forth, further = _grown(same(last[0] + last[2], last[1] + last[2], on))
        piece = (first[0] - more, last[0] + last[2] + forth, first[1] - more, last[1] + last[2] + forth,
                 sum(s[3] for s in steps[lo:hi]) + sum(s[4] for s in steps[lo + 1:hi]) + extra + further)
        if piece[4] >= similarity * max(piece[1] - piece[0], piece[3] - piece[2]):
            out.append(piece)
        elif hi - lo > 1:
            cut = max(range(lo + 1, hi), key=lambda s: steps[s][5])
            todo += [(lo, cut), (cut, hi)]
    return out


def merge(pieces: list[tuple], min_words: int, min_piece: int) -> list[dict]:
    """Passages of one document from its pieces (start, end, of_doc, of_start, of_end, matches): runs that overlap or touch."""
    out: list[list[tuple]] = []
    for piece in sorted(p for p in pieces if p[1] - p[0] >= min_piece):
        if out and piece[0] <= max(p[1] for p in out[-1]):
            out[-1].append(piece)
        else:
            out.append([piece])
    found = []
    for run in out:
        start, end = run[0][0], max(p[1] for p in run)
        if end - start >= min_words:
            main = max(run, key=lambda p: (p[1] - p[0], -p[2]))
            found.append({
                "start_word": start, "end_word": end, "of_doc_id": main[2], "of_start_word": main[3], "of_end_word": main[4],
                "similarity": main[5] / max(main[1] - main[0], main[4] - main[3]),
                "of_doc_ids": sorted({p[2] for p in run if p[2] != _NO_ID})})
    return found


_PASSAGE = ("doc long, tag long, start_word int, end_word int, of_doc_id long, of_start_word int, of_end_word int, "
            "similarity double, of_doc_ids array<long>")


def _aligned(min_words: int, similarity: float):
    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                doc, tag = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                sides: dict[int, dict] = {}
                for item in batch.column(2)[row]:
                    sides.setdefault(item["chain"].as_py(), {})[item["side"].as_py()] = item
                pieces = []
                for both in sides.values():
                    if len(both) < 2:
                        continue
                    flat = both[0]["parts"].as_py()
                    parts = list(zip(flat[::3], flat[1::3], flat[2::3]))
                    of = both[1]["of_doc"].as_py()
                    for p in align(parts, both[0]["words"].values.to_numpy(), both[0]["lo"].as_py(),
                                   both[1]["words"].values.to_numpy(), both[1]["lo"].as_py(), similarity):
                        pieces.append((p[0], p[1], of, p[2], p[3], p[4]))
                out += [{"doc": doc, "tag": tag, **p} for p in merge(pieces, min_words, MIN_PIECE)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("doc", pa.int64()), ("tag", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("of_doc_id", pa.int64()),
                ("of_start_word", pa.int32()), ("of_end_word", pa.int32()), ("similarity", pa.float64()), ("of_doc_ids", pa.list_(pa.int64()))]))

    return run


def find_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = 0.8, k: int = K, window: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, start_word, end_word, of_doc_id, of_start_word, of_end_word, similarity, of_doc_ids) per repeated passage.

    A passage is a run of at least min_words words (split at white space, lower-cased) whose pieces occur in documents
    with smaller ids, each piece of at least ten words with at least this share of words in common and in order.
    of_doc_id and its span are those of the longest piece, of_doc_ids all sources. A whole copy is one passage. Any exact run of
    k + window - 1 words has an anchor; where a longer copy of a run is not in the first document that holds its k-mers, the
    passage may end up to k + window words before that copy does; repeats inside one document alone do not count. Every copy
    of a passage in a later document counts, however many the first one holds; only a run of a period under k words (one word over
    and over) counts no longer than the first document's own. Null and empty texts have no
    passage; rows with the same id and text are one document; other texts of one id, or without id, are documents of
    their own, told apart by `tag`. Documents without id come last and have doc 2^63 - 1.
    """
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    seeds = texts.mapInArrow(_seeded(k, window, min_words), "seed long, doc long, place long, turn int")
    least = seeds.where("turn = 0").groupBy("seed").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1").select("seed", "first")
    shared = stored(seeds.join(least, "seed"))
    tag, of_tag = F.shiftright("place", 32), F.shiftright("of_place", 32)
    centers = shared.where("doc = first AND turn = 0").groupBy("seed").agg(F.min("place").alias("of_place"))
    # Most k-mers occur once in a document. Others meet the occurrence of their turn, or the first one where there are fewer.
    turns = shared.where("doc = first AND turn <> 0").groupBy("seed", F.abs("turn").alias("nth"), tag.alias("of_tag")).agg(
        F.min("place").alias("turn_place"))
    again = shared.where("turn <> 0").join(centers, "seed").withColumns({"nth": F.abs("turn"), "of_tag": of_tag}).join(
        turns, ["seed", "nth", "of_tag"], "left").withColumn(
        "of_place", F.coalesce("turn_place", F.when(F.col("turn") > 0, F.col("of_place"))))
    met = shared.where("turn = 0").join(centers, "seed").select("doc", "first", "place", "of_place").unionByName(
        again.where("of_place is not null").select("doc", "first", "place", "of_place"))
    anchors = met.where((F.col("doc") != F.col("first")) | (tag != of_tag)).groupBy("doc", tag.alias("tag")).agg(
        F.collect_set(F.struct(F.col("first").alias("of"), "of_place", "place")).alias("anchors"))
    chains = stored(anchors.mapInArrow(
        _chained(k), "doc long, tag long, chain int, side int, of_doc long, of_tag long, lo int, len int, parts array<int>"))
    words = texts.mapInArrow(_worded(min_words), "of_doc long, of_tag long, words array<int>")
    stretches = chains.join(words, ["of_doc", "of_tag"]).withColumn("words", F.slice("words", F.col("lo") + 1, F.col("len")))
    return stretches.groupBy("doc", "tag").agg(
        F.collect_list(F.struct("chain", "side", "of_doc", "lo", "parts", "words")).alias("stretches")).mapInArrow(
        _aligned(min_words, similarity), _PASSAGE)


def _spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of runs of words."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    return [(words[a][0], words[b - 1][1]) for a, b in runs if b <= len(words)]


def _with_passages(docs: DataFrame, passages: DataFrame, columns: list[str]) -> DataFrame:
    """Documents, with their passages as an array (null if none) in column __runs."""
    runs = passages.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("__runs"))
    tag = F.crc32(F.encode("text", "utf-8")).bitwiseAND(0x7FFFFFFF)
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__tag": tag})
    return keyed.join(runs.withColumnsRenamed({"doc": "__doc", "tag": "__tag"}), ["__doc", "__tag"], "left").drop("__doc", "__tag")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents (doc_id, text, ...) without their repeated passages; what is left empty goes, the first copy stays.

    n_chars, where there is such a column, follows the text. Rows without passages are unchanged, null texts included.
    """
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()):
                if runs:
                    kept, at = [], 0
                    for a, b in _spans(text, [(r["start_word"], r["end_word"]) for r in runs]):
                        kept.append(text[at:a])
                        at = b
                    text = "".join([*kept, text[at:]]).strip() or None
                texts.append(text)
            arrays = list(batch.columns[:-1])
            arrays[names.index("text")] = pa.array(texts, pa.string())
            gone = np.asarray([bool(r) and t is None for r, t in zip(batch.column(len(names)).to_pylist(), texts)], bool)
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(~gone))

    joined = _with_passages(docs, passages, ["start_word", "end_word"]).select(*names, "__runs")
    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def located(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages as (doc_id, start_word, end_word, start_char, end_char, of_doc_id, of_start_word, of_end_word, similarity,
    of_doc_ids), with character spans in the texts of documents (doc_id, text); a missing id is null again."""
    fields = ["start_word", "end_word", "of_doc_id", "of_start_word", "of_end_word", "similarity", "of_doc_ids"]

    def locate(batches):
        for batch in batches:
            spans = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = _spans(text, [(r["start_word"], r["end_word"]) for r in runs])
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "runs", "spans"])

    kind = "start_word:int,end_word:int,of_doc_id:bigint,of_start_word:int,of_end_word:int,similarity:double,of_doc_ids:array<bigint>"
    rows = _with_passages(docs.select(F.col("doc_id").cast("long"), "text").dropDuplicates(), passages, fields).where("__runs is not null")
    return rows.mapInArrow(locate, f"doc_id long, runs array<struct<{kind}>>, spans array<struct<start:int,end:int>>").select(
        "doc_id", F.explode(F.arrays_zip("runs", "spans")).alias("x")).select(
        "doc_id", "x.runs.start_word", "x.runs.end_word", F.col("x.spans.start").alias("start_char"), F.col("x.spans.end").alias("end_char"),
        F.when(F.col("x.runs.of_doc_id") != _NO_ID, F.col("x.runs.of_doc_id")).alias("of_doc_id"),
        *[F.col(f"x.runs.{n}") for n in fields[3:]])
