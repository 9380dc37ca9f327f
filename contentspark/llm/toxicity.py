"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon learned from the labelled sample, nearness of its words to second-person words,
capitals, punctuation, repeated marks and disguised spellings. Trees and calibration are Spark ML models.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from contentspark.llm.common import stored

#: Labelled documents learned from, chosen by hash of the id.
SAMPLE = 12000
LEXICON = 200

#: Second-person words of the languages in the data. Fixed values.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos "
                 "tú ti tuyo tuya usted ustedes vosotros").split()

_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
# Usual letter disguises; marks inside a word are taken out.
_DISGUISE = b"013457@$"
_PLAIN = bytes.maketrans(_DISGUISE + b"\t\n\r,;:?!()[]{}\"", b"oieastas" + b" " * 15)
_INNER = b"*._-'~^`|#%&+=/\\<>"
_REPEATED = re.compile(rb"([!?#$%&*.])\1")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, ASCII marks taken as space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def features(text: str | None, lexicon: dict[bytes, float], second: frozenset) -> list[float]:
    """The dense features of a text; all zero for an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    words = low.translate(_TO_SPACE).split()
    n = len(words)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    plain = low.translate(_PLAIN, _INNER).split()
    opened = sum(w in lexicon for w in plain)
    spaced = _SPACED.findall(text) if b" " in raw else []
    hidden = max(0, opened - len(hits)) + sum(re.sub(r"\W|_", "", s).lower().encode() in lexicon for s in spaced)
    near = 0
    for i in hits:
        near += any(w in second for w in words[max(0, i - 5): i + 6])
    weight = sum(lexicon[words[i]] for i in hits)
    closest = 0.0
    if hits:
        at = np.asarray(hits)
        closest = float((np.searchsorted(at, at + 100) - np.arange(len(at))).max())
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    size = max(1, len(raw))
    return [
        len(hits) / max(1, n), float(np.log1p(len(hits))), weight / max(1, n), float(np.log1p(weight)),
        float(len({words[i] for i in hits})), closest, near / max(1, n), float(np.log1p(near)),
        hidden / max(1, n), float(np.log1p(hidden)), capitals / max(1, capitals + small), marks / size,
        int(counts[33]) / size, int(counts[63]) / size, len(_REPEATED.findall(raw)) / max(1, n),
        int(counts[48:58].sum()) / size, float(np.log1p(n)), sum(w in second for w in words) / max(1, n),
    ]


def learn_lexicon(sample: DataFrame, size: int) -> dict[bytes, float]:
    """Words that mark the label, with their log odds, from (text, label) rows: counted by document, at most `size`."""
    def distinct_words(batches):
        for batch in batches:
            out, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {w for w in words_of(text) if 2 < len(w) <= 40}
                out += found
                labels += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.float64())], names=["word", "label"])

    totals = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic = totals["toxic"] or 0.0
    clean = totals["n"] - toxic
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (clean + 1))
    found = sample.select("text", "label").mapInArrow(distinct_words, "word binary, label double").groupBy("word").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")).where(
            # Rarer words could lean to one label by chance.
            F.col("toxic") * F.log(F.col("toxic") * (toxic + clean) / (F.col("n") * toxic)) >= 12).select("word", odds.alias("w"), "toxic")
    best = found.where("w > 2").orderBy(F.desc(F.col("w") * F.log1p("toxic")), "word").limit(size).collect()
    return {bytes(r["word"]): float(r["w"]) for r in best}


def with_features(docs: DataFrame, lexicon: dict[bytes, float], keep: list[str]) -> DataFrame:
    """Adds `features`, an array of numbers, to the kept columns; the text is read whole and not passed on."""
    second = frozenset(w.encode() for w in SECOND_PERSON)

    def described(batches):
        for batch in batches:
            found = [features(t.as_py(), lexicon, second) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    schema = StructType(list(docs.select(*keep).schema.fields)).add("features", ArrayType(DoubleType()))
    return docs.select(*keep, "text").mapInArrow(described, schema)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most so many labelled documents; several labels of one id: the highest counts."""
    chosen = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("double").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(rows)
    # At most `rows` ids: the one small side. Rows that repeat an id count once.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",),
                   trees: int = 20, depth: int = 3) -> DataFrame:
    """The kept columns, `score` (0 to 1) and `predicted` (1 from 0.5 on) of every document (doc_id, text).

    `labels` has doc_id and toxic; `learn` says which of its rows may be learned from. Null and empty texts are
    scored as texts without words; repeated rows are scored each; if the sample lacks one of the two labels, every
    score is the share of label 1 (0 without labels). Extra columns of docs and labels have no effect.
    """
    docs = docs.select(*dict.fromkeys((*keep, "doc_id", "text")))
    sample = stored(training_sample(docs, labels.select("doc_id", "toxic"), learn, rows))
    share = sample.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return docs.select(*keep).withColumns({"score": F.lit(float(share or 0.0)), "predicted": F.lit(int((share or 0) >= 0.5))})
    lexicon = learn_lexicon(sample, LEXICON)
    points = stored(with_features(sample, lexicon, ["doc_id", "label"]).repartition(6, "doc_id")).withColumn("x", array_to_vector("features"))
    # One part of four calibrates, the rest grows the trees.
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4))
    trees_model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, predictionCol="tree",
                                subsamplingRate=0.8).fit(points.where(part != 0))
    raw = vector_to_array("probability")[1]
    held = trees_model.transform(points.where(part == 0)).select(raw.alias("p"), "label")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(held) if held.limit(1).count() else None
    scored = trees_model.transform(with_features(docs, lexicon, list(keep)).withColumn("x", array_to_vector("features"))).withColumn("p", raw)
    if isotonic is not None:
        scored = isotonic.transform(scored)
    score = F.least(F.greatest(F.col("p" if isotonic is None else "calibrated"), F.lit(0.0)), F.lit(1.0))
    return scored.withColumn("score", score).select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
