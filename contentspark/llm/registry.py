"""The registered queries of these operators, and the same queries as DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentspark.llm import decontaminate, htmltext, langid, ngram_join, packing, passages, periodic_runs, prefix_trie, token_edits, topk, toxicity, url_filter, weighted_sampling
from contentspark.llm.common import TOKENIZERS, in_fold, stored, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 5, 0)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_edits.recount_cleaned(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("place")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")
    return packed.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.located(docs, stored(passages.find_passages(docs)))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    edges = url_filter.link_edges(pages)
    return url_filter.judge_urls(pages.select("page_id", "url"), edges).select("page_id", "host", "path", "rule", "verdict")


def _rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation begins with the first turns of the one its id falls back to."""
    lists = prefix_trie.turn_lists(conversations)
    heads = lists.where("conv_id % 5 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    joined = lists.withColumn("h", h).join(heads, F.expr("conv_id - conv_id % 5 = head_id"), "left")
    return joined.select("conv_id", F.expr(
        "concat(coalesce(slice(head, 1, h), array()), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; rows without conv_id are left out, an empty table has no node."""
    nodes = prefix_trie.prefix_trie(_rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.withColumnRenamed("saved", "saved_tokens").withColumnRenamed("ends", "ends_sha256")


def op12_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; null texts are empty, null ids come last, repeated rows are answered each."""
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


_BLANKS = " \t\n\x0b\f\r"


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents the words from one place on repeat the first few of them."""
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANKS))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0) & (bare != ""), F.split(bare, "[ \\t-\\r]+")).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = chosen.withColumn("n", n).withColumn("a", (g % F.col("n")).cast("int")).withColumn(
        "p", F.expr("cast(1 + floor((n - a) / (3 + floor(h / 10) % 8)) as int)"))
    repeated = F.expr("""array_join(concat(slice(words, 1, a),
        slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')""")
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document; a null id is in no tenth, a null or empty text has no words and no runs."""
    found = periodic_runs.repeated_runs(_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"strongest.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_html": op6_html,
    "op7_passages": op7_passages,
    "op8_ngram_join": op8_ngram_join,
    "op9_topk": op9_topk,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_weighted_fingerprints": op12_weighted_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_URL_SQL = """
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
                                     lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS query
  FROM u
), address AS (
  SELECT page_id, host, path, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS node, html FROM parts
), links AS (
  SELECT node AS a, host, path, replace(unnest(regexp_extract_all(html,
    '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)), '&amp;', '&') AS href FROM address WHERE host <> ''
  UNION ALL
  SELECT node, host, path, replace(unnest(regexp_extract_all(html,
    '(?is)<meta[^>]*http-equiv="refresh"[^>]*content="[^";,]*[;,][ ]*url=([^"]*)"', 1)), '&amp;', '&') FROM address WHERE host <> ''
), full_links AS (
  SELECT a, CASE WHEN strpos(href, '://') > 0 THEN substr(href, strpos(href, '://') + 3)
                 WHEN starts_with(href, '//') THEN substr(href, 3)
                 WHEN starts_with(href, '/') THEN host || href
                 ELSE host || regexp_replace(path, '[^/]*$', '') || href END AS rest FROM links WHERE href <> ''
), edges AS (
  SELECT a, lower(regexp_extract(rest, '^[^/?#]*')) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM full_links
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), rules(action, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), places AS (
  SELECT DISTINCT host, path FROM parts
  UNION SELECT DISTINCT split_part(b, '/', 1), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM both_ways
), decided AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.action, length(r.host || r.path)) AS verdict
  FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL
), alias AS (
  SELECT r.a AS node, bool_or(d.verdict = 'block') AND NOT bool_or(d.verdict = 'allow') AS blocked
  FROM reach r JOIN decided d ON d.host = split_part(r.b, '/', 1) AND d.path = regexp_extract(r.b, '^[^/?]*([^?]*)', 1)
  GROUP BY r.a
)
SELECT a.page_id, coalesce(a.host, '') AS host, coalesce(a.path, '') AS path, d.rule,
       coalesce(d.verdict, CASE WHEN x.blocked THEN 'block' END, 'allow') AS verdict
FROM address a LEFT JOIN decided d ON d.host = a.host AND d.path = a.path LEFT JOIN alias x ON x.node = a.node
"""

_TRIE_SQL = """
WITH ordered AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS symbol,
         octet_length(encode(coalesce(text, ''))) AS weight,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), rebuilt AS (
  SELECT i.conv_id, o.place, o.symbol, o.weight FROM ids i JOIN ordered o ON o.conv_id = i.conv_id - i.conv_id % 5 AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, 100 + o.place, o.symbol, o.weight FROM ids i JOIN ordered o ON o.conv_id = i.conv_id AND o.place > i.h
), paths AS (
  SELECT conv_id, weight, row_number() OVER w AS depth, md5(string_agg(symbol, '') OVER w) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids
), places AS (
  SELECT conv_id, depth, node, weight, lag(node) OVER v AS parent, lead(node) OVER v IS NULL AS ends
  FROM paths WINDOW v AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS (
  SELECT node, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS least, count(*) AS n, any_value(weight) AS weight,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM places GROUP BY node
), families AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT p.node, sum((y.n - 1) * y.weight) AS saved, count(*) FILTER (WHERE f.node IS NULL) AS n_leaves
  FROM nodes y JOIN places p ON p.conv_id = y.least AND p.depth <= y.depth LEFT JOIN families f ON f.node = y.node
  GROUP BY p.node
)
SELECT x.least AS conv_id, x.depth, u.least AS parent_conv_id, x.n AS n_convs, coalesce(f.n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN nodes u ON u.node = x.parent LEFT JOIN families f ON f.node = x.node
"""

ORACLES = {"op9_topk": _TOPK_SQL, "op10_url_filter": _URL_SQL, "op11_conversation_trie": _TRIE_SQL}
