"""Full-text matching and cover-density ranking.

A query is data: ``struct<terms, groups>``. ``groups`` are alternatives; each lists the terms it needs and
denies (by index into ``terms``) and the phrases it needs and denies. One document's query-word occurrences are
an array ``(pos, lexeme, weight)`` in position order. Matching and ranking are column expressions over those
two, so they are the same for a scan of the items, for a stored postings table and for a table of queries.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentspark.functions.binding import bind, let_sql, quoted
from contentspark.functions.stem import common_start
from contentspark.functions.text import STOP_WORDS, Stemmer, is_stop_word, is_stop_word_sql, stemmer, words, words_sql
from contentspark.operators.ranking import top_k, top_k_per_group, with_rank
from contentspark.plans.sizing import broadcast_if_small
from contentspark.session import cut_lineage

CANDIDATES = 50
# Weight of a word in the title and in the body.
WEIGHTS = {"A": 1.0, "B": 0.4}
RANK_DIGITS = 9
_LEXEME_BYTES = 64

PHRASE = T.ArrayType(T.StructType([T.StructField("term", T.IntegerType()), T.StructField("offset", T.IntegerType())]))
GROUP = T.StructType([
    T.StructField("need", T.ArrayType(T.IntegerType())),
    T.StructField("deny", T.ArrayType(T.IntegerType())),
    T.StructField("phrases", T.ArrayType(PHRASE)),
    T.StructField("deny_phrases", T.ArrayType(PHRASE)),
])
SPEC = T.StructType([
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("groups", T.ArrayType(GROUP)),
])

_STOP = frozenset(STOP_WORDS)
_PIECE = re.compile(r'-?"[^"]*"?|\S+')
_WORD = re.compile(r"[^\W_]+")


def parse_web_query(text: str | None) -> dict:
    """Search-box syntax: words are all needed, ``or`` separates alternatives, ``-`` denies, quotes keep order."""
    terms: list[str] = []
    groups: list[dict] = []

    def new_group() -> dict:
        return {"need": [], "deny": [], "phrases": [], "deny_phrases": []}

    def index(word: str) -> int:
        if word not in terms:
            terms.append(word)
        return terms.index(word)

    group = new_group()
    for piece in _PIECE.findall((text or "").lower()):
        if piece == "or":
            groups.append(group)
            group = new_group()
            continue
        denied = piece.startswith("-")
        phrase = [
            {"term": index(word), "offset": offset}
            for offset, word in enumerate(_WORD.findall(piece)) if word not in _STOP
        ]
        if not phrase:
            continue
        if not denied:
            group["need"] += [p["term"] for p in phrase if p["term"] not in group["need"]]
        if len(phrase) > 1:
            group["deny_phrases" if denied else "phrases"].append(phrase)
        elif denied:
            group["deny"].append(phrase[0]["term"])
    groups.append(group)
    return {"terms": terms, "groups": [g for g in groups if any(g.values())]}


class WebQuery(NamedTuple):
    """One parsed query text, its words' lexemes and the starts their words have in common."""

    groups: list[dict]
    lexemes: list[str]
    starts: list[str]

    def spec(self) -> Column:
        groups = F.from_json(F.lit(json.dumps(self.groups)), SPEC["groups"].dataType)
        return F.struct(self.terms().alias("terms"), groups.alias("groups"))

    def terms(self) -> Column:
        return F.array(*map(F.lit, self.lexemes)).cast("array<string>")


def web_query(text: str, stem: str) -> WebQuery:
    """Parses one query text; its few words are stemmed on the spot, so that searches see constants."""
    parsed = parse_web_query(text)
    terms = ", ".join(map(quoted, parsed["terms"]))
    both = f"named_struct('lexeme', q, 'start', replace({common_start('q')}, 'ё', 'е'))"
    row = SparkSession.active().sql(
        f"SELECT transform(CAST(array({terms}) AS array<string>), w -> {let_sql('q', stemmer(stem)('w'), both)}) AS t"
    ).first()
    return WebQuery(parsed["groups"], [t.lexeme for t in row.t], [t.start for t in row.t])


def query_specs(queries: DataFrame, stem: Stemmer) -> DataFrame:
    """``(query_id, text)`` as ``(query_id, spec)``."""
    @F.udf(SPEC, useArrow=True)
    def parsed(text: str) -> dict:
        return parse_web_query(text)

    stemmed = f"named_struct('terms', transform(spec.terms, w -> {stem('w')}), 'groups', spec.groups)"
    return queries.select("query_id", parsed(F.col("text")).alias("spec")).select(
        "query_id", F.expr(stemmed).alias("spec"))


def build_postings(items: DataFrame, stem: str = "snowball") -> DataFrame:
    """``(id, lexeme, pos, weight)``: one row per word that is not a stop word; body positions follow the title's.

    Store it once, clustered by lexeme; searches then read the query's lexemes only.
    """
    to_lexeme = stemmer(stem)
    return (
        items.select("id", words(F.col("title")).alias("t"), words(F.col("content_text")).alias("b"))
        .select("id", F.size("t").alias("n_title"), F.posexplode(F.concat("t", "b")).alias("i", "word"))
        .where(~is_stop_word(F.col("word")))
        .select(
            "id", F.expr(to_lexeme("word")).alias("lexeme"), (F.col("i") + 1).alias("pos"),
            F.when(F.col("i") < F.col("n_title"), "A").otherwise("B").alias("weight"),
        )
    )


def occurrences(title: Column, body: Column, terms: Column, stem: Stemmer) -> Column:
    """Query-word occurrences of one item, in position order, straight from its text.

    Only words that begin like a query word are stemmed.
    """
    numbered = (
        f"transform(concat(t, {words_sql('p.body')}), (w, i) -> named_struct('pos', i + 1, 'word', w, "
        f"'weight', if(i < size(t), {WEIGHTS['A']}D, {WEIGHTS['B']}D)))"
    )
    alike = f"filter({numbered}, x -> exists(starts, s -> startswith(replace(x.word, 'ё', 'е'), s)))"
    lexemes = (
        f"transform({alike}, x -> named_struct('pos', x.pos, 'lexeme', {stem('x.word')}, 'weight', x.weight, "
        "'word', x.word))"
    )
    kept = f"filter({lexemes}, x -> array_contains(p.terms, x.lexeme) AND NOT {is_stop_word_sql('x.word')})"
    located = let_sql("starts", f"transform(p.terms, q -> replace({common_start('q')}, 'ё', 'е'))", kept)
    return bind(let_sql("t", words_sql("p.title"), located), title=title, body=body, terms=terms)


_STARTS = "transform(filter(p.occ, x -> x.lexeme = get(p.q.terms, part.term)), x -> x.pos - part.offset)"
_PHRASE = (
    "size(aggregate(ph, CAST(NULL AS array<int>), (acc, part) -> "
    f"if(acc IS NULL, {_STARTS}, array_intersect(acc, {_STARTS})))) > 0"
)
_PRESENT = "array_contains(lexemes, get(p.q.terms, i))"
MATCH_SQL = let_sql(
    "lexemes", "array_distinct(transform(p.occ, x -> x.lexeme))",
    f"exists(p.q.groups, g -> forall(g.need, i -> {_PRESENT}) AND forall(g.deny, i -> NOT {_PRESENT}) "
    f"AND forall(g.phrases, ph -> {_PHRASE}) AND forall(g.deny_phrases, ph -> NOT ({_PHRASE})))",
)

# Running state of a document: occurrences seen, sum of 1/weight, begin of the last span, score, and per term the
# latest position with the totals before it.
_MARK = "struct<pos:int,n:int,inv:double>"
_ZERO = (
    "named_struct('n', 0, 'inv', 0D, 'begun', 0, 'score', 0D, "
    f"'last', transform(p.q.terms, t -> CAST(NULL AS {_MARK})))"
)
_LATEST = (
    "transform(acc.last, (m, i) -> if(get(p.q.terms, i) = x.lexeme, "
    "named_struct('pos', x.pos, 'n', acc.n, 'inv', acc.inv), m))"
)
_BEGIN = (
    "array_max(transform(p.q.groups, g -> if(size(g.need) > 0 AND forall(g.need, i -> get(last, i) IS NOT NULL), "
    "array_min(transform(g.need, i -> get(last, i))), NULL)))"
)
_GAIN = (
    "(acc.n + 1 - begin.n) / (acc.inv + 1 / x.weight - begin.inv) "
    "/ (1 + (x.pos - begin.pos) - (acc.n - begin.n))"
)
_STEP = let_sql("last", _LATEST, let_sql("begin", _BEGIN, let_sql(
    "fresh", "begin IS NOT NULL AND begin.pos > acc.begun",
    "named_struct('n', acc.n + 1, 'inv', acc.inv + 1 / x.weight, 'begun', if(fresh, begin.pos, acc.begun), "
    f"'score', acc.score + if(fresh, {_GAIN}, 0D), 'last', last)")))
RANK_SQL = f"round(aggregate(p.occ, {_ZERO}, (acc, x) -> {_STEP}, acc -> acc.score), {RANK_DIGITS})"


def text_match(occ: Column, spec: Column) -> Column:
    """Whether a document with these occurrences satisfies any alternative of the query."""
    return bind(MATCH_SQL, occ=occ, q=spec)


def cover_density_rank(occ: Column, spec: Column) -> Column:
    """Sum over minimal spans that hold a whole alternative: denser and weightier spans count more.

    A span with ``c`` occurrences over positions ``s..p`` adds ``c / sum(1/weight)`` divided by one plus the
    number of other words inside. One pass keeps each term's latest occurrence and the running totals before it.
    """
    return bind(RANK_SQL, occ=occ, q=spec)


def _score_if_matching(occ: Column, spec: Column) -> Column:
    """The rank of a matching document; other rows vanish.

    A generator is never copied by the optimizer, so query and occurrences are computed once for both questions.
    """
    return F.explode(bind(f"if({MATCH_SQL}, array({RANK_SQL}), NULL)", occ=occ, q=spec)).alias("text_score")


def _may_match(query: WebQuery) -> Column:
    """Cheap necessary condition: the text holds the common start of every needed word."""
    title, body = [
        F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")) for c in ("title", "content_text")]
    condition = F.lit(False)
    for group in query.groups:
        every = F.lit(True)
        for i in group["need"]:
            every = every & (title.contains(query.starts[i]) | body.contains(query.starts[i]))
        condition = condition | every
    return condition


def _ranked(matches: DataFrame, k: int) -> DataFrame:
    order = [F.col("text_score").desc_nulls_last(), F.col("id").asc()]
    return with_rank(top_k(matches, k, order), order)


def text_matches(items: DataFrame, text: str, stem: str = "snowball") -> DataFrame:
    """``(id, text_score)`` of every item that satisfies the query; no shuffle."""
    query = web_query(text, stem)
    occ = occurrences(F.col("title"), F.col("content_text"), query.terms(), stemmer(stem))
    return items.where(_may_match(query)).select("id", _score_if_matching(occ, query.spec()))


def text_candidates(items: DataFrame, text: str, k: int = CANDIDATES, stem: str = "snowball") -> DataFrame:
    """``(id, text_score, rank)`` of the ``k`` best matches of one query, by scan of the items."""
    return _ranked(text_matches(items, text, stem), k)


def _weight_value(weight: Column) -> Column:
    return F.when(weight == "A", F.lit(WEIGHTS["A"])).otherwise(F.lit(WEIGHTS["B"]))


def _occurrence_list() -> Column:
    return F.array_sort(F.collect_list(F.struct(
        F.col("pos"), F.col("lexeme"), _weight_value(F.col("weight")).alias("weight")))).alias("occ")


def text_candidates_from_postings(
    postings: DataFrame, text: str, k: int = CANDIDATES, stem: str = "snowball",
) -> DataFrame:
    """As :func:`text_candidates`, reading only the query's lexemes from a stored postings table.

    The shuffle is on the item id, so a lexeme found in a third of all items spreads over all tasks. An alternative
    that only denies words is met by items without postings of the query, so their ids are read as well; an item
    without any word has no postings and is found by scan alone.
    """
    query = web_query(text, stem)
    matches = (
        postings.where(F.col("lexeme").isin(*query.lexemes) if query.lexemes else F.lit(False))
        .groupBy("id").agg(_occurrence_list())
    )
    if any(not g["need"] for g in query.groups):
        matches = postings.select("id").distinct().join(matches, "id", "left")
    return _ranked(matches.select("id", _score_if_matching(_or_none(F.col("occ")), query.spec())), k)


def _or_none(occ: Column) -> Column:
    """No occurrences for an item that holds none."""
    return F.coalesce(occ, F.expr("CAST(array() AS array<struct<pos:int,lexeme:string,weight:double>>)"))


_OPEN = "exists(spec.groups, g -> size(g.need) = 0)"


def _split_open(specs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Queries whose alternatives all need a word, and those that items without any query word may meet (None if none)."""
    open_specs = specs.where(_OPEN)
    return specs.where(f"NOT {_OPEN}"), None if open_specs.isEmpty() else open_specs


def _asked_of_all(rows: DataFrame, open_specs: DataFrame) -> DataFrame:
    """Rows with every open query's query_id and spec; the queries reach the scan as one array, without a join."""
    asked = open_specs.agg(F.collect_list(F.struct("query_id", "spec"))).scalar()
    return rows.withColumn("__asked", F.explode(asked)).select("*", "__asked.query_id", "__asked.spec").drop("__asked")


def _anchors(specs: DataFrame) -> DataFrame:
    """``(query_id, lexeme)``: per alternative its longest needed lexeme, which every match must hold."""
    longest = ("array_max(transform(g.need, i -> named_struct('n', length(get(spec.terms, i)), "
               "'w', get(spec.terms, i)))).w")
    each = f"array_distinct(transform(spec.groups, g -> {longest}))"
    return specs.select("query_id", F.explode(F.expr(each)).alias("lexeme"))


def text_matches_many(postings: DataFrame, queries: DataFrame, stem: str = "snowball") -> DataFrame:
    """``(query_id, id, text_score)`` for a table of queries ``(query_id, text)``, from stored postings.

    Only items holding an anchor of a query are paired with it, and only postings of query words are read and
    moved, by item id. A query with an alternative that only denies words is asked of every item with postings.
    """
    specs, open_specs = _split_open(query_specs(queries, stemmer(stem)).where(F.size("spec.groups") > 0))
    anchors = broadcast_if_small(_anchors(specs), _LEXEME_BYTES)
    terms = specs.select("query_id", F.explode(F.array_distinct("spec.terms")).alias("lexeme"))
    asked = broadcast_if_small(terms.select("lexeme").distinct(), _LEXEME_BYTES)
    used = postings.join(asked, "lexeme", "left_semi")
    pairs = used.select("id", "lexeme").join(anchors, "lexeme").select("query_id", "id").distinct()
    found = (
        used.join(pairs.join(terms, "query_id"), ["id", "lexeme"])
        .groupBy("query_id", "id").agg(_occurrence_list())
        .join(specs, "query_id")
        .select("query_id", "id", _score_if_matching(F.col("occ"), F.col("spec")))
    )
    if open_specs is None:
        return found
    words_asked = broadcast_if_small(
        open_specs.select(F.explode("spec.terms").alias("lexeme")).distinct(), _LEXEME_BYTES)
    held = postings.join(words_asked, "lexeme", "left_semi").groupBy("id").agg(_occurrence_list())
    every = _asked_of_all(postings.select("id").distinct().join(held, "id", "left"), open_specs)
    own = F.filter(_or_none(F.col("occ")), lambda x: F.array_contains(F.col("spec.terms"), x["lexeme"]))
    return found.unionByName(every.select("query_id", "id", _score_if_matching(own, F.col("spec"))))


def text_matches_table(items: DataFrame, queries: DataFrame, stem: str = "snowball") -> DataFrame:
    """As :func:`text_matches_many` by scan of the items.

    A first scan finds which items hold an anchor of which query; those pairs are few, so they are stored and,
    when their count allows, sent to the second scan, which reads the words of the paired items only. A query with an
    alternative that only denies words is asked of every item in one more scan.
    """
    to_lexeme = stemmer(stem)
    specs, open_specs = _split_open(query_specs(queries, to_lexeme).where(F.size("spec.groups") > 0))
    anchors = broadcast_if_small(_anchors(specs), _LEXEME_BYTES)
    vocabulary = items.select("id", F.explode(F.array_distinct(
        F.concat(words(F.col("title")), words(F.col("content_text"))))).alias("word"))
    pairs = cut_lineage(
        vocabulary.select("id", F.expr(to_lexeme("word")).alias("lexeme")).join(anchors, "lexeme")
        .select("query_id", "id").distinct())
    texts = items.select("id", "title", "content_text")
    occ = occurrences(F.col("title"), F.col("content_text"), F.col("spec.terms"), to_lexeme)
    scored = ("query_id", "id", _score_if_matching(occ, F.col("spec")))
    found = texts.join(broadcast_if_small(pairs, _LEXEME_BYTES), "id").join(specs, "query_id").select(*scored)
    return found if open_specs is None else found.unionByName(_asked_of_all(texts, open_specs).select(*scored))


def text_candidates_many(
    source: DataFrame, queries: DataFrame, k: int = CANDIDATES, stem: str = "snowball",
) -> DataFrame:
    """The ``k`` best matches per query; ``source`` is a postings table or the items themselves."""
    matches = text_matches_many if "lexeme" in source.columns else text_matches_table
    order = [F.col("text_score").desc_nulls_last(), F.col("id").asc()]
    return top_k_per_group(matches(source, queries, stem), k, ["query_id"], order)
