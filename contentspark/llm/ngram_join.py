"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

A text is the set of its word n-grams. Texts with equal sets are one class, so copies never meet each other. Band
hashes are shuffled; classes that share one are joined to the smallest of them, which gives candidate components. The
classes of a component meet once, in one task, if they are few; of a large component only the members of a bucket
meet, cut into blocks, and a pair counts in its first common band alone. Tasks return link counts and spanning trees,
never pairs.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentspark.llm.common import connected_components, few, gram_hashes, mixed, small_batches, stored, word_hashes

#: Components of up to so many classes are verified in one task; blocks of larger buckets have half as many.
TOGETHER = 1024


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which so many hashes still find a pair at the threshold with this chance."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall; allow more hashes")
    return best


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text of fewer words is one gram, a text without words none."""
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    """64 bits of a gram set: equal sets have one class."""
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
    terms = rng.integers(0, 2**64, bands * rows, np.uint64)
    salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes, one row per non-empty set."""
        values = np.concatenate(sets)
        starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
        out = np.empty((len(sets), bands), np.uint64)
        for band in range(bands):
            h = np.full(len(sets), salts[band])
            for row in range(band * rows, (band + 1) * rows):
                h = mixed(h ^ np.minimum.reduceat(values * factors[row] + terms[row], starts))
            out[:, band] = h
        return out

    return sign


def _signed(n: int, bands: int, rows: int):
    def run(batches):
        sign = _signer(bands, rows)
        for part in few(batches, 2, most_rows=64):
            words, offsets = word_hashes(part.column(2).to_pylist())
            sets = [gram_set(words[a:b], n) for a, b in zip(offsets, offsets[1:])]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes = sign([sets[i] for i in full]).view(np.int64).tolist() if full else []
            rows_of = dict(zip(full, hashes))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([rows_of.get(i) for i in range(len(sets))], pa.list_(pa.int64()))], names=["doc_id", "tag", "cls", "bands"])

    return run


def _resigned(n: int):
    """(cls, grams) of texts whose class is still the one asked for."""
    def run(batches):
        for part in few(batches, 1, most_rows=64):
            words, offsets = word_hashes(part.column(1).to_pylist())
            out = [(cls, s.tobytes()) for cls, a, b in zip(part.column(0).to_pylist(), offsets, offsets[1:])
                   if class_of(s := gram_set(words[a:b], n)) == cls]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())],
                                             names=["cls", "grams"])

    return run


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of slices of the membership matrix."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    gram = np.cumsum(first) - 1
    shared = np.bincount(gram)[gram] > 1
    owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float64)
    width = 4096
    cuts = np.searchsorted(gram, np.arange(0, (gram[-1] if len(gram) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(gram)))):
        if b > a:
            block = np.zeros((n, min(width, int(gram[b - 1]) - k * width + 1)), np.float32)
            block[owner[a:b], gram[a:b] - k * width] = 1
            common += block @ block.T
    np.fill_diagonal(common, sizes)
    return common


def _trees(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component."""
    root = np.arange(len(linked))
    seen = np.zeros(len(linked), bool)
    for i in range(len(linked)):
        if not seen[i]:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                seen |= front
                root[front] = i
                front = linked[front].any(0) & ~seen
    return root


def _verified(numerator: int, denominator: int):
    def run(key, rows):
        """Links of the classes of one unit; of a tile of two blocks only links between the blocks, in their first common band."""
        cls = rows["cls"].to_numpy()
        order = np.unique(cls, return_index=True)[1]
        rows, cls = rows.take(order), cls[order]
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]
        sizes = np.asarray([len(s) for s in sets])
        common = common_grams(sets)
        linked = denominator * common >= numerator * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        band, one, other = key[1].as_py(), key[2].as_py(), key[3].as_py()
        bands = np.asarray(rows["bands"].to_pylist(), np.int64)
        if band < 0:
            # As in the tiles of large components, only a pair that shares a band counts.
            i, j = np.nonzero(linked)
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                linked[a, b] = (bands[a] == bands[b]).any(1)
        else:
            for earlier in range(band):
                linked &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
            if one != other:
                block = rows["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
        links = linked @ rows["copies"].to_numpy()
        root = _trees(linked)
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "links": links[some].astype(np.int64), "tree": cls[root[some]]})

    return run


def near_duplicates(docs: DataFrame, n: int = 5, numerator: int = 4, denominator: int = 5, recall: float = 0.9999,
                    id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.

    Two documents are linked if the Jaccard similarity of their sets of lower-case word n-grams is at least
    numerator / denominator; copies are linked too. class_id is the smallest doc_id of the connected component, n_links
    the number of other rows linked with this one. Texts of fewer than n words are one gram; null texts and texts
    without words are linked to nothing and keep their own id. Repeated rows are rows; a class without any id has a
    null class_id. A pair counts if it shares a band, whatever the size of its component; one right at the threshold is
    missed with chance 1 - recall, a more similar one with less. Sets are told apart by 64-bit hashes.
    """
    bands, rows = banding(numerator / denominator, recall)
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signed(n, bands, rows), "doc_id long, tag long, cls long, bands array<long>"))
    # One row stands for a class: that of the smallest id, or of the smallest text hash where no row has an id.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag"))
    classes = stored(signed.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("copies"), least.alias("one"), F.first("bands").alias("bands")).select(
        "cls", "copies", F.col("one.doc_id").alias("rep"), F.col("one.tag").alias("rep_tag"), "bands"))

    # Candidate components: each class of a shared bucket with the bucket's smallest.
    entries = classes.select("cls", F.posexplode("bands").alias("band", "h"))
    shared = entries.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1")
    members = stored(entries.join(shared, ["band", "h"]))
    components = connected_components(members.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    sizes = components.groupBy("root").agg(F.count("*").alias("size"))
    placed = stored(components.join(sizes, "root").select(F.col("node").alias("cls"), "root", "size"))

    # Units of verification: small components, and tiles of the buckets of large ones.
    small = placed.where(F.col("size") <= together).select(
        "cls", F.col("root").alias("unit"), F.lit(-1).alias("band"), F.lit(0).alias("one"), F.lit(0).alias("other"), F.lit(0).alias("block"))
    blocks = F.ceil(F.col("n") / (together // 2)).cast("int")
    spread = members.join(placed.where(F.col("size") > together).select("cls"), "cls").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("cls", "h"), F.col("blocks")).cast("int"))
    large = spread.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cls", F.col("h").alias("unit"), "band", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("other"), "block")
    units = small.unionByName(large)

    wanted = placed.join(classes, "cls").select("cls", "rep", "rep_tag")
    grams = texts.join(wanted, (texts["tag"] == wanted["rep_tag"]) & texts["doc_id"].eqNullSafe(wanted["rep"])).select("cls", "text").mapInArrow(
        _resigned(n), "cls long, grams binary").dropDuplicates(["cls"])
    payload = grams.join(classes.select("cls", "copies", "bands"), "cls")
    verified = stored(units.join(payload, "cls").groupBy("unit", "band", "one", "other").applyInArrow(
        _verified(numerator, denominator), "cls long, links long, tree long"))

    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.select(F.col("cls").alias("a"), F.col("tree").alias("b"))).withColumnRenamed("node", "cls")
    named = joined.join(classes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("class_id"))
    facts = classes.select("cls", "copies", "rep").join(links, "cls", "left").join(
        joined.join(named, "root").select("cls", "class_id"), "cls", "left").select(
        "cls", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "cls").join(facts, "cls", "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents (doc_id, text, ...) without near duplicates: of every class the smallest id stays.

    Where ids are missing or repeat, rows take their place for an id. Texts without words have no duplicates and stay.
    """
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        stay = near_duplicates(docs, **options).where("doc_id = class_id").select("doc_id")
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    placed = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    stay = near_duplicates(placed, id_col="__row", **options).where("doc_id = class_id").select(F.col("doc_id").alias("__row"))
    return placed.join(stay, "__row", "left_semi").select(*docs.columns)
