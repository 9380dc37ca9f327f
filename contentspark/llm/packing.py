"""Packing token ids into sequences of fixed length: first-fit decreasing with a tournament tree of bin capacities.

Tasks tokenise texts, close every document with an end id and cut it at multiples of the sequence length. Whole pieces
are sequences of their own and travel a few together; the remainders of a randomised group of documents are packed
together, groups independently of each other. Groups are chosen by the place of a document in the input, not by its id
or text, so copies and repeated ids spread evenly, and there are so many that a group stays small in documents and in
tokens at every size.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import few, small_batches, worker_state

SEQUENCE = 4096
END_ID = 2
#: Rows and bytes of text whose remainders are packed together, and whole sequences that travel together.
GROUP_DOCUMENTS = 2048
GROUP_BYTES = 8 << 20
_WHOLE = 64

#: Bytes of words and ids that a worker keeps, in two generations: words not met for long go.
_KNOWN_BYTES = 128 << 20
_ENTRY_BYTES = 200
_KEPT_LETTERS = 64
#: Words that are encoded as one text, and the mark that stands between them.
_RUN, _BETWEEN = 512, "."
# Characters that some white-space rules split at and others do not, a letter whose lower case depends on its
# neighbours, and special tokens: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff\u03a3\u0130]|<\\|")
# Texts of nothing but Latin letters, digits, plain white space and marks: there words and runs of marks are tokenised
# apart. An apostrophe may belong to either, so texts with one are cut at white space only.
_ALIEN = re.compile(r"[^ \t\n\r\x0b\x0ca-zA-Z0-9À-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]")
_TWO_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]{2}")
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")
_SINGLE = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]


class TextEncoder:
    """Ids as little-endian unsigned 32-bit bytes. The tokenizer lower-cases, drops white space and never joins words
    across it, so the ids of words are kept and looked up again."""

    def __init__(self, path: str):
        # A task has one core; the threads of the tokenizer's own pool keep memory that outlives the tokenizer.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.bytes = Tokenizer.from_file(path), {}, {}, 0
        mark = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def _fresh_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words. Those of letters and digits alone are encoded many in one text, with a mark between any two."""
        found, alone, plain = {}, [], []
        for word in words:
            (plain if word.isalnum() else alone).append(word)
        runs = [plain[i:i + _RUN] for i in range(0, len(plain), _RUN)]
        for run, data in zip(runs, self._fresh([f" {_BETWEEN} ".join(run) for run in runs]) if runs else ()):
            ids = np.frombuffer(data, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(run) - 1:
                alone += run
                continue
            starts, ends = 4 * np.append(0, marks + 1), 4 * np.append(marks, len(ids))
            found.update((w, data[a:b]) for w, a, b in zip(run, starts.tolist(), ends.tolist()))
        found.update(zip(alone, self._fresh(alone)) if alone else ())
        return found

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Parts of a text that are tokenised alone; None if it has to be encoded whole."""
        if "<|" in text or _ALIEN.search(text):
            return None if _ODD.search(text) else text.lower().split()
        if _TWO_MARKS.search(text):
            return _MARKS.sub(r" \g<0> ", text.lower()).split()
        text = text.lower()
        for mark in _SINGLE:
            if mark in text:
                text = text.replace(mark, f" {mark} ")
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, a few at a time: words not met before are encoded together."""
        if self.bytes > _KNOWN_BYTES // 2:
            self.known, self.before, self.bytes = {}, self.known, 0
        known, rows, missing = self.known, [], set()
        for text in texts:
            words = self._words(text) if text else []
            ids = None if words is None else list(map(known.get, words))
            if ids is not None and None in ids:
                gaps = [i for i, x in enumerate(ids) if x is None]
                names = [words[i] for i in gaps]
                missing.update(names)
                rows.append((ids, gaps, names))
            else:
                rows.append((ids, (), ()))
        found = {w: ids for w in missing if (ids := self.before.get(w)) is not None}
        found.update(self._fresh_words([w for w in missing if w not in found]))
        kept = {w: ids for w, ids in found.items() if len(w) <= _KEPT_LETTERS}
        known.update(kept)
        self.bytes += sum(_ENTRY_BYTES + len(w) + len(ids) for w, ids in kept.items())
        out = []
        for text, (ids, gaps, names) in zip(texts, rows):
            if ids is None:
                out.append(self._fresh([text])[0])
                continue
            for i, name in zip(gaps, names):
                ids[i] = found[name]
            out.append(b"".join(ids))
        return out


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins; lengths are between 1 and capacity.

    Every inner node of the tree holds the larger capacity of its two children, so the first bin that fits is found
    by going down from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        used = max(used, node - leaves + 1)
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets, used


_PIECES = "doc_id long, start long, ids binary, doc_tokens long, grp long"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence: int = SEQUENCE, end_id: int = END_ID, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian 32-bit numbers.

    Null and empty texts are one end id. A null id stays null; rows with equal ids are packed each. An empty table
    gives no pieces.
    """
    rows, size = small_batches(docs).agg(F.count("*"), F.sum(F.octet_length(F.col(text_col)))).first()
    groups = max(1, -(-rows // group_documents), -(-(size or 0) // GROUP_BYTES))
    piece_bytes = 4 * sequence
    end = np.asarray([end_id], "<u4").tobytes()

    def tokenised(batches):
        name = f"packing {tokenizer_path}"
        encoder = worker_state(name, lambda: TextEncoder(tokenizer_path))
        context = TaskContext.get()
        task, at, whole = (context.partitionId() if context else 0), 0, 0
        for part in few(batches, 1, most_rows=1 << 12, keep=name):
            out = {"doc_id": [], "start": [], "ids": [], "doc_tokens": [], "grp": []}
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                ids += end
                for start in range(0, len(ids), piece_bytes):
                    at += 1
                    piece = ids[start: start + piece_bytes]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start // 4)
                    out["ids"].append(piece)
                    out["doc_tokens"].append(len(ids) // 4)
                    if len(piece) == piece_bytes:
                        out["grp"].append(-1 - (task << 20) - whole // _WHOLE)
                        whole += 1
                    else:
                        # A fixed mix of task and place: random-like, yet the same when a task runs again.
                        out["grp"].append(((task * 0x9E3779B1 + at) * 0x85EBCA6B >> 7) % groups)
            yield _batch(out)

    def _batch(out):
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "grp": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in out.items()], names=list(out))

    def packed(key, pieces):
        lengths = np.asarray([len(x.as_py()) // 4 for x in pieces["ids"]], np.int64)
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        part = np.flatnonzero(lengths < sequence)
        bins[part], offsets[part], used = first_fit_decreasing(lengths[part], sequence)
        whole = np.flatnonzero(lengths == sequence)
        bins[whole] = used + np.arange(len(whole))
        return pieces.drop_columns(["grp"]).append_column(
            "sequence_id", pa.array(bins + (key[0].as_py() << 21))).append_column("offset", pa.array(offsets))

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenised, _PIECES)
    return pieces.groupBy("grp").applyInArrow(
        packed, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, pad_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """(sequence_id, input_ids): the padded training sequences of a packing; a length that is a power of two stays."""
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64).tolist()
                rows.append(ids if len(ids) & (len(ids) - 1) == 0 else ids + [pad_id] * (sequence - len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["sequence_id", "input_ids"])

    return ordered.mapInArrow(joined, "sequence_id long, input_ids array<long>")
