"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut into pre-tokens, which are tokenised apart, and these into leaves. A tree over the leaves sums their
characters and tokens. An edit re-encodes only the leaves it touches, with as much context as can change how they are
cut, and updates the sums above them. The state of a document is its text and the sizes of its leaves.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentspark.llm.common import few, small_batches, worker_state

#: The pattern that the vocabulary's pre-tokens follow. A fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a leaf.
LEAF = 32
#: Pre-tokens that a worker remembers, in two generations: those not met for long go.
_KNOWN = 160_000
_KEPT_LETTERS = 40
#: Characters behind its end that the cut of a pre-token other than white space can depend on.
_AHEAD = 3


class Counter:
    """Tokens of pre-tokens, kept by a worker from task to task."""

    def __init__(self, ranks_path: str):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def pieces(self, text: str, at: int):
        """Pre-tokens from a boundary on, one by one: nothing is cut before it is asked for."""
        while (m := self._pattern.match(text, at)) is not None:
            yield m[0]
            at = m.end()

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        return self._count(piece) if n is None else n

    def _count(self, piece: str) -> int:
        n = self.before.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= _KEPT_LETTERS:
            if len(self.known) >= _KNOWN // 2:
                # Callers hold on to the dictionary for a text, so it is emptied, not replaced.
                self.before = dict(self.known)
                self.known.clear()
            self.known[piece] = n
        return n

    def leaves(self, text: str, size: int = LEAF) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a text."""
        pieces = self._pattern.findall(text)
        counts = list(map(self.known.get, pieces))
        if None in counts:
            counts = [self._count(p) if n is None else n for p, n in zip(pieces, counts)]
        lengths = list(map(len, pieces))
        return ([sum(lengths[i:i + size]) for i in range(0, len(pieces), size)],
                [sum(counts[i:i + size]) for i in range(0, len(pieces), size)])


class Tree:
    """Sums of characters and tokens over leaves; leaf i is node size + i, node 1 the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds this character; the last one with any for a place at the end."""
        if at >= self.chars[1]:
            at = self.chars[1] - 1
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self._sum(node)


class Document:
    """A text with its tree."""

    def __init__(self, counter: Counter, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.counter, self.text, self.reencoded = counter, text, 0
        if chars is None or tokens is None:
            chars, tokens = counter.leaves(text)
        self.tree = Tree(chars, tokens)

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        t = self.tree
        some = [i for i in range(t.size, 2 * t.size) if t.chars[i]]
        return [t.chars[i] for i in some], [t.tokens[i] for i in some]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end; places outside the text count as its nearest end."""
        tree, old = self.tree, self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + new + old[end:]
        if not old:
            self.tree = Tree(*self.counter.leaves(self.text))
            self.reencoded += len(self.text)
            return
        # A pre-token that ends a little before the edit, or white space that runs up to it, may be cut anew.
        first, lo = tree.find(max(0, start - 1 - _AHEAD))
        while first and old[lo - 1: start].isspace():
            first, lo = tree.find(lo - 1)
        last, hi = tree.find(min(end, len(old) - 1))
        hi += tree.chars[tree.size + last]
        shift = len(new) - (end - start)
        # Up to a boundary of leaves that is a boundary again: what follows is cut as before.
        pieces, at = [], lo
        for piece in self.counter.pieces(self.text, lo):
            while at > hi + shift and hi < len(old):
                last, hi = tree.find(hi)
                hi += tree.chars[tree.size + last]
            if at == hi + shift:
                break
            pieces.append(piece)
            at += len(piece)
        if hi + shift < at:
            last, hi = tree.find(len(old) - 1)[0], len(old)
        region = self.text[lo:hi + shift]
        counts = list(map(self.counter.count, pieces))
        self.reencoded += len(region)
        tree.set(first, len(region), sum(counts))
        for leaf in range(first + 1, last + 1):
            if tree.chars[tree.size + leaf]:
                tree.set(leaf, 0, 0)
        if len(region) > 64 * LEAF:
            # The edit brought a long text into one leaf: cut it up again.
            chars = [sum(map(len, pieces[i:i + LEAF])) for i in range(0, len(pieces), LEAF)]
            tokens = [sum(counts[i:i + LEAF]) for i in range(0, len(pieces), LEAF)]
            before = [(tree.chars[i], tree.tokens[i]) for i in range(tree.size, tree.size + first)]
            after = [(tree.chars[i], tree.tokens[i]) for i in range(tree.size + last + 1, 2 * tree.size)]
            every = [x for x in [*before, *zip(chars, tokens), *after] if x[0]]
            self.tree = Tree([c for c, _ in every], [t for _, t in every])


# What a cleaning step of a corpus changes: personal data and secrets are masked, a line that repeats the one before goes.
# An address begins where a run of its letters begins, and such runs are never tried again from their middle, so a text is
# read in time proportional to its length.
_MASKED = re.compile(
    r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+|\+?\d[\d\- ()]{7,}\d"
    r"|\b(?:token|key|secret|password)\s*[=:]\s*[\"']?[\w\-/+=]{8,}[\"']?", re.I)


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, new text) of the changes to a text, from its end to its start, so that earlier places hold."""
    gone, at, before = [], 0, None
    for line in text.split("\n"):
        if line == before and line:
            gone.append((at - 1, at + len(line), ""))
        at, before = at + len(line) + 1, line
    found, k = list(gone), 0
    for m in _MASKED.finditer(text):
        while k < len(gone) and gone[k][1] <= m.start():
            k += 1
        if k == len(gone) or m.end() <= gone[k][0]:
            found.append((m.start(), m.end(), "<masked>"))
    found.sort(reverse=True)
    return found


_STATE = (("leaf_chars", "array<int>"), ("leaf_tokens", "array<int>"), ("n_tokens", "long"))


def _state(documents: list[Document | None]) -> list[pa.Array]:
    leaves = [d.leaves() if d else (None, None) for d in documents]
    return [pa.array([x[0] for x in leaves], pa.list_(pa.int32())), pa.array([x[1] for x in leaves], pa.list_(pa.int32())),
            pa.array([d.tokens if d else 0 for d in documents], pa.int64())]


def count_tokens(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """Adds leaf_chars, leaf_tokens and n_tokens to every row: its tree, and its number of tokens.

    A null text has null leaves and no tokens, an empty one empty leaves. Columns of these names are replaced.
    """
    docs = small_batches(docs).drop(*[n for n, _ in _STATE])
    names = docs.columns

    def counted(batches):
        name = f"counts {ranks_path}"
        counter = worker_state(name, lambda: Counter(ranks_path))
        for part in few(batches, names.index(text_col), keep=name):
            found = [None if t is None else Document(counter, t) for t in part.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *_state(found)], names=[*names, *[n for n, _ in _STATE]])

    schema = StructType(list(docs.schema.fields))
    return docs.mapInArrow(counted, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{n} {t}" for n, t in _STATE]))


def apply_edits(counted: DataFrame, edits: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, n_tokens, edits, reencoded) after the edits of each document.

    `counted` has doc_id, text, leaf_chars and leaf_tokens; `edits` has doc_id, edit_no, start, end and new, places
    meant in the text as the edits before have left it. Rows without edits are unchanged; a null text is edited as an
    empty one; repeated rows are edited each; null places and texts are 0 and empty; ties of edit_no go by start, end and new.
    reencoded is the number of characters that were looked at again.
    """
    own = edits.groupBy(F.col("doc_id").alias("__doc")).agg(F.sort_array(F.collect_list(F.struct(
        "edit_no", F.coalesce(F.col("start"), F.lit(0)).cast("int").alias("start"), F.coalesce(F.col("end"), F.lit(0)).cast("int").alias("end"),
        F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))
    counted = counted.select("doc_id", "text", "leaf_chars", "leaf_tokens")
    rows = counted.join(own, counted["doc_id"].eqNullSafe(own["__doc"]), "left").select(
        counted["doc_id"].cast("long").alias("doc_id"), "text", "leaf_chars", "leaf_tokens", "edits")

    def edited(batches):
        name = f"counts {ranks_path}"
        counter = worker_state(name, lambda: Counter(ranks_path))
        for part in few(batches, 1, keep=name):
            found, changes = [], []
            for text, chars, tokens, changed in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if text is None and not changed:
                    found.append(None)
                else:
                    found.append(Document(counter, text or "", chars or None, tokens or None))
                    for e in changed or ():
                        found[-1].edit(e["start"], e["end"], e["new"])
                changes.append(len(changed or ()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([d.text if d else None for d in found], pa.string()), *_state(found),
                 pa.array(changes, pa.int32()), pa.array([d.reencoded if d else 0 for d in found], pa.int64())],
                names=["doc_id", "text", *[n for n, _ in _STATE], "edits", "reencoded"])

    return rows.mapInArrow(edited, "doc_id long, text string, " + ", ".join(f"{n} {t}" for n, t in _STATE) + ", edits int, reencoded long")


def recount_cleaned(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, edits, n_tokens_after, reencoded, n_chars_after) of every row, counted once and then after its cleaning edits.

    The tree of a row lives as long as its edits take: nothing is shuffled. Null and empty texts have no tokens.
    """
    def recounted(batches):
        name = f"counts {ranks_path}"
        counter = worker_state(name, lambda: Counter(ranks_path))
        for batch in few(batches, 1, keep=name):
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                document = Document(counter, text)
                before, edits = document.tokens, cleaning_edits(text)
                for edit in edits:
                    document.edit(*edit)
                out.append((before, len(edits), document.tokens, document.reencoded, len(document.text)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                names=["doc_id", "n_tokens", "edits", "n_tokens_after", "reencoded", "n_chars_after"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        recounted, "doc_id long, n_tokens long, edits int, n_tokens_after long, reencoded long, n_chars_after long")
