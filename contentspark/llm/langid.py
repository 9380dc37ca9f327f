"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

A text is the square-root frequencies of its hashed letter trigrams (words padded with a space, everything but letters
counts as space). One-versus-one linear SVMs choose the family, further ones the language within it. They are
trained on a bounded sample; every whole text is predicted.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentspark.llm.common import few, mixed, small_batches, stored

UNKNOWN = "und"
DIMENSIONS = 4096
#: Training rows per language, chosen by hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: Texts below this score are in no language that was learned; short ones of a learned language reach more.
LEAST_SCORE = 0.3

#: Families of languages by ISO 639-1 code; a language not named here is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


@cache
def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    return out * np.arange(0x110000, dtype=np.uint32)


_SLICE = 1 << 18


def trigram_vector(text: str | None) -> np.ndarray | None:
    """Unit vector of square-root trigram frequencies; None if the text has no letter. Long texts are counted by slices."""
    if not text:
        return None
    text, letters = text.lower(), _letters()
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(text), _SLICE):
        # With the neighbours of the slice's ends; outside the text there are spaces.
        piece = text[max(0, at - 1): at + _SLICE + 1]
        points = letters[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
        padded = np.concatenate(([0] * (at == 0), points, [0] * (at + _SLICE >= len(text)))).astype(np.uint64)
        start, middle, end = padded[:-2], padded[1:-1], padded[2:]
        codes = (start << np.uint64(42) | middle << np.uint64(21) | end)[middle > 0]
        total += np.bincount((mixed(codes) >> np.uint64(20)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS)
    if not total.any():
        return None
    counts = np.sqrt(total)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights and bias of an L1-loss linear SVM by dual coordinate descent; y is +1 or -1, classes weigh alike.

    x stays in its own precision; only the row at hand is widened. The last weight is that of a constant 1.
    """
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    limit = c * 0.5 / share
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1] + 1)
    squares = np.asarray([np.append(row, 1).astype(np.float64) @ np.append(row, 1).astype(np.float64) for row in x])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            row = np.append(x[i], 1).astype(np.float64)
            gradient = y[i] * (row @ w) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return w


def training_sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """(lang, text) of at most so many documents per language among the rows where `learn` holds."""
    order = F.xxhash64("doc_id", F.lit(17))
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "lang", "doc_id").distinct()
    # Of a common language about twice as many as wanted are let through by their hash; only these are put in order.
    shares = usable.groupBy("lang").agg((F.lit(2.0 * per_language + 200) / F.count("*")).alias("share"))
    few_ids = usable.join(F.broadcast(shares), "lang").where(F.pmod(order, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ids = few_ids.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")).alias("n"))
    # At most per_language ids of each language: the one small side.
    chosen = F.broadcast(ids.where(F.col("n") <= per_language).select("lang", "doc_id").distinct())
    return docs.join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def train(sample: DataFrame) -> dict:
    """{"families": [...], "languages": {family: [...]}, "weights": {(one, other): vector}} from (lang, text) rows.

    Every pair is trained in a task of its own on the bounded rows of its two sides.
    """
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    names = sorted(families)
    roles = {}
    for family in names:
        for lang in families[family]:
            roles[lang] = [(0, a, b, 1 if a == family else -1) for i, a in enumerate(names) for b in names[i + 1:] if family in (a, b)]
            own = families[family]
            roles[lang] += [(1, a, b, 1 if a == lang else -1) for i, a in enumerate(own) for b in own[i + 1:] if lang in (a, b)]

    def described(batches):
        for batch in batches:
            out = {"level": [], "one": [], "other": [], "side": [], "vector": []}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = trigram_vector(text)
                for level, one, other, side in roles[lang] if vector is not None else ():
                    for name, value in zip(out, (level, one, other, side, vector.astype(np.float16).tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()))], names=list(out))

    def fitted(key, rows):
        vectors, sides = rows["vector"].to_pylist(), rows["side"].to_numpy()
        order = np.lexsort((np.asarray([zlib.crc32(v) for v in vectors]), sides))
        x = np.frombuffer(b"".join(vectors[i] for i in order), np.float16).reshape(-1, DIMENSIONS)
        y = sides[order].astype(np.float64)
        del vectors
        w = train_svm(x, y) if len(set(y)) == 2 else np.append(np.zeros(DIMENSIONS), y[0])
        return pa.table({"level": pa.array([key[0].as_py()], pa.int32()), "one": [key[1].as_py()], "other": [key[2].as_py()],
                         "w": [w.astype(np.float32).tobytes()]})

    pairs = sample.mapInArrow(described, "level int, one string, other string, side int, vector binary").groupBy(
        "level", "one", "other").applyInArrow(fitted, "level int, one string, other string, w binary")
    weights = {(r["level"], r["one"], r["other"]): np.frombuffer(r["w"], np.float32) for r in pairs.collect()}
    return {"families": names, "languages": families, "weights": weights}


def _duel(names: list[str], level: int, x: np.ndarray, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner's index and its mean probability over its duels, for each row."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    total = np.zeros((len(x), len(names)))
    for i, one in enumerate(names):
        for j in range(i + 1, len(names)):
            w = weights.get((level, one, names[j]))
            p = 1 / (1 + np.exp(-3 * np.clip(x @ w[:-1] + w[-1], -50, 50))) if w is not None else np.full(len(x), 0.5)
            total[:, i] += p
            total[:, j] += 1 - p
    best = total.argmax(1)
    return best, total[np.arange(len(x)), best] / (len(names) - 1)


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; (`und`, 0) for null, for a text without a letter and without any language learned."""
    vectors = [trigram_vector(t) for t in texts]
    out = [(UNKNOWN, 0.0)] * len(texts)
    at = [i for i, v in enumerate(vectors) if v is not None]
    if not at or not model["families"]:
        return out
    x = np.stack([vectors[i] for i in at])
    family, sure = _duel(model["families"], 0, x, model["weights"])
    for f, name in enumerate(model["families"]):
        rows = np.flatnonzero(family == f)
        if len(rows):
            langs = model["languages"][name]
            best, inner = _duel(langs, 1, x[rows], model["weights"])
            for row, b, p in zip(rows, best, inner):
                out[at[row]] = langs[b], float(sure[row] * p)
    return out


def identify(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE, pred: str = "lang_pred",
             score: str = "lang_score") -> DataFrame:
    """Adds the predicted language and its score (0 to 1) to every row of documents (doc_id, text, lang, ...).

    `learn` says which rows may be learned from; their null texts, languages and ids are left out. Null, empty and
    letterless texts are `und` with score 0, as is everything if nothing can be learned. Whole texts are read;
    repeated rows are predicted each; columns of the new names are replaced.
    """
    docs = small_batches(docs).drop(pred, score)
    model = train(stored(training_sample(docs, learn, per_language)))
    kept = docs.columns

    def predicted(batches):
        for part in few(batches, kept.index("text")):
            found = predict(model, part.column(kept.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, pred, score])

    schema = StructType(list(docs.schema.fields)).add(pred, "string").add(score, "double")
    return docs.mapInArrow(predicted, schema)


def keep_identified(docs: DataFrame, learn: Column, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of documents whose language is identified: not `und`, and with at least this score."""
    names = docs.columns
    found = identify(docs.select(*names), learn, pred="__lang", score="__score")
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(*names)
