"""Document fingerprints by consistent weighted sampling; DataFrame functions only.

A text is a set of words, lower-cased and cut at white space, each weighted by how often it occurs. For sample k a word
with weight w draws r and c from a Gamma(2, 1) distribution and b evenly from (0, 1), all from hashes of the word and k,
and is given

    t = floor(ln w / r + b),   ln a = ln c - r (t + 1 - b).

The word with the least a wins, and its (word, t) is the sample. Two texts draw the same sample with a chance equal to
their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones. As a depends on word and t
alone, equal samples have equal least values, so one minimum per sample does; 16 bits of its hash enter the fingerprint.
Texts that agree by chance in those bits add 1/65536 to a likeness.

Words are counted and minima taken in the tasks that hold the texts; where a table is already dealt by its key columns
nothing is shuffled. A null text counts as empty; a text without words has one word, the empty one, so texts without
words are alike and differ from all others. An empty table has no fingerprints. A task splits one text into its words
at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentspark.llm.common import stored

#: Samples per fingerprint; a multiple of eight. The standard error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 48
#: Samples worked out in one row of an aggregation: the compiled code of more of them grows too long to run fast.
_TOGETHER = 8
_DIGITS = 4
_BLANKS = " \t\n\x0b\f\r"


def _even(h: Column, upper: bool) -> Column:
    """32 bits of a hash as a number strictly between 0 and 1."""
    bits = F.shiftrightunsigned(h, 32) if upper else h.bitwiseAND(0xFFFFFFFF)
    return (bits.cast("double") + 0.5) / 4294967296.0


def _gamma(h: Column) -> Column:
    """A Gamma(2, 1) number: minus the logarithm of the product of two even ones."""
    return -F.log(_even(h, True) * _even(h, False))


def sample_value(word: Column, log_weight: Column, k: Column) -> Column:
    """ln a of a word, given by its hash, in sample k; null for a null weight."""
    first, second, third = (F.xxhash64(word, 3 * k + i) for i in range(3))
    r = _gamma(first)
    b = (F.shiftrightunsigned(third, 11).cast("double") + 0.5) / 9007199254740992.0
    t = F.floor(log_weight / r + b).cast("double")
    return F.log(_gamma(second)) - r * (t + 1.0 - b)


def _fingerprint(values: list[Column]) -> Column:
    """Hexadecimal digits of the values' hashes, four a sample."""
    bits = [F.shiftrightunsigned(F.xxhash64(v), 48) for v in values]
    fours = [reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(b, 48 - 16 * i) for i, b in enumerate(bits[at: at + 4])))
             for at in range(0, len(bits), 4)]
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in fours)))


def fingerprints(texts: DataFrame, keys: list[str], columns: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprints) of each distinct key: for each text column of `columns` a fingerprint of the name given there.

    Rows of one key count as one text. The texts of a row share the random numbers of the words they have in common.
    """
    parts = F.array(*(F.struct(F.lit(i).alias("which"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(columns)))
    split = texts.select(*keys, F.explode(parts).alias("part")).select(
        *keys, "part.which", F.explode(F.split(F.btrim(F.lower("part.text"), F.lit(_BLANKS)), "[ \\t-\\r]+")).alias("word"))
    # The logarithm of 0 is null, and a null weight takes no part in a minimum.
    weighted = split.select(*keys, "which", F.xxhash64("word").alias("word")).groupBy(*keys, "word").agg(
        *(F.log(F.count_if(F.col("which") == i).cast("double")).alias(f"w{i}") for i in range(len(columns))))
    dealt = weighted.withColumn("eight", F.explode(F.sequence(F.lit(0), F.lit(samples // _TOGETHER - 1))))
    least = dealt.groupBy(*keys, "eight").agg(*(
        F.min(sample_value(F.col("word"), F.col(f"w{i}"), F.col("eight") * _TOGETHER + k)).alias(f"s{i}_{k}")
        for k in range(_TOGETHER) for i in range(len(columns))))
    parts = least.select(*keys, F.struct("eight", *(
        _fingerprint([F.col(f"s{i}_{k}") for k in range(_TOGETHER)]).alias(f"f{i}") for i in range(len(columns)))).alias("part"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(*keys, *(F.array_join(F.col(f"parts.f{i}"), "").alias(name) for i, name in enumerate(columns.values())))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = (F.substring(a, _DIGITS * k + 1, _DIGITS) == F.substring(b, _DIGITS * k + 1, _DIGITS) for k in range(samples))
    return reduce(lambda x, y: x + y, (s.cast("int") for s in same)) / float(samples)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, tag, text): two numbers, never null, that tell the rows apart; rows of equal id and text share them."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("a"),
                       F.xxhash64(text, doc_id.isNull()).alias("tag"), text.alias("text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(doc_id, a, tag, copies, n_chars, next_a, next_tag) of each distinct row, stored.

    The next row is the one that follows by descending id, null ids last and equal ids by tag; the first row follows the
    last. Rows are dealt by range, so a next row is in the same range, or first in the following one.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tag")]
    narrow = rows.groupBy("doc_id", "a", "tag").agg(F.count("*").alias("copies"), F.min(F.char_length("text")).cast("long").alias("n_chars"))
    ranged = stored(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumn("next", F.lead(F.struct("a", "tag")).over(within))
    firsts = ranged.groupBy("part").agg(F.max(F.struct(
        F.col("doc_id").isNotNull(), "doc_id", (-F.col("tag").cast("decimal(20,0)")).alias("up"), "a", "tag")).alias("first"))
    # One row per range: the window over all of them is as small as the number of ranges.
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select(
        "part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(around)).alias("first"))
    joined = placed.join(follow, "part").withColumn("next", F.coalesce("next", F.struct(F.col("first.a"), F.col("first.tag"))))
    return stored(joined.select("doc_id", "a", "tag", "copies", "n_chars", F.col("next.a").alias("next_a"), F.col("next.tag").alias("next_tag")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text of a row is its text with the last floor(n_chars / 2) characters replaced by the first as many, or
    all, of the next row's. Null ids stay null and come last in the order; repeated rows are answered each, and each but
    the last is followed by its own copy. A single row is its own next.

    Texts are shuffled once, by key, and the pieces that move to another row once more; every key has one next row
    and one row before it, so nothing gathers.
    """
    rows = distinct_texts(docs, id_col, text_col)
    links = neighbours(rows)
    asked = links.select(F.col("next_a").alias("a"), F.col("next_tag").alias("tag"), F.col("a").alias("to_a"),
                         F.col("tag").alias("to_tag"), F.expr("cast(n_chars div 2 as int)").alias("need"))
    plan = links.select("a", "tag", "copies", "n_chars").join(asked, ["a", "tag"])
    held = rows.groupBy("a", "tag").agg(F.first("text").alias("text")).join(plan, ["a", "tag"])
    moved = held.select(F.col("to_a").alias("a"), F.col("to_tag").alias("tag"), F.expr("substring(text, 1, need)").alias("piece"))
    start = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))")
    both = held.join(moved, ["a", "tag"]).select(
        "a", "tag", "copies", "text", F.concat(start, "piece").alias("edited"),
        F.when(F.col("copies") > 1, F.concat(start, F.expr("substring(text, 1, cast(n_chars div 2 as int))"))).alias("doubled"))
    # Repeated rows have a second edited text, with the row's own copy.
    pairs = both.select("a", "tag", F.explode(F.expr("""
        if(copies > 1, array(struct(0 AS kind, text, edited), struct(1 AS kind, '' AS text, doubled AS edited)),
           array(struct(0 AS kind, text, edited)))
        """)).alias("x")).select("a", "tag", "x.kind", "x.text", "x.edited")
    each = fingerprints(pairs, ["a", "tag", "kind"], {"text": "fingerprint", "edited": "edited_fingerprint"}, samples)
    first = F.col("kind") == 0
    prints = each.groupBy("a", "tag").agg(
        F.max(F.when(first, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(first, F.col("edited_fingerprint"))).alias("edited_fingerprint"),
        F.max(F.when(~first, F.col("edited_fingerprint"))).alias("doubled_fingerprint"))
    digests = both.select("a", "tag", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                          F.sha2(F.col("doubled").cast("binary"), 256).alias("doubled_sha256"))
    every = stored(links.join(prints, ["a", "tag"]).join(digests, ["a", "tag"]))

    following = every.select(F.col("a").alias("next_a"), F.col("tag").alias("next_tag"), F.col("fingerprint").alias("next_fingerprint"))
    answer = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    last = every.join(following, ["next_a", "next_tag"]).select(*answer, "next_fingerprint")
    # The other copies of repeated rows, dealt out in thousands.
    copies = every.where("copies > 1").select(
        "doc_id", "n_chars", F.col("doubled_sha256").alias("edited_sha256"), "fingerprint",
        F.col("doubled_fingerprint").alias("edited_fingerprint"), F.col("fingerprint").alias("next_fingerprint"), "a", "tag",
        F.expr("copies - 1").alias("left"), F.explode(F.expr("sequence(0, (copies - 2) div 1000)")).alias("thousand"))
    dealt = copies.repartition("a", "tag", "thousand").select(
        *answer, "next_fingerprint", F.explode(F.expr("sequence(1, least(1000, left - 1000 * thousand))")).alias("copy")).drop("copy")
    return last.unionByName(dealt).select(
        *answer, likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
