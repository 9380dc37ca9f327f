"""The registered queries again, as SQL over the same tables."""

from __future__ import annotations

import html.entities

from contentspark.functions.text import LIGHT_ENGLISH, STOP_WORDS

ORACLES: dict[str, str] = {}

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
DIM = 64

DOCS = """docs AS (
  SELECT doc_id AS id, source AS source_id, CAST(doc_id AS VARCHAR) AS external_id,
         split_part(text, chr(10), 1) AS title,
         concat('https://', source, '.example.org/', CAST(doc_id AS VARCHAR)) AS url,
         text AS content_text, (doc_id % 3 = 0) AS read
  FROM documents)"""

ITEMS = DOCS + """, items AS (
  SELECT d.*, e.ts AS published_at, v.embedding
  FROM docs d JOIN events e ON e.event_id = d.id LEFT JOIN embeddings v ON v.vec_id = d.id)"""

OUTBOX = f"""outbox AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS aggregate_id, props AS payload, ts AS created_at,
         CASE WHEN event_type IN ('signup', 'purchase') THEN ts END AS processed_at,
         CASE WHEN event_type = 'click' THEN ts END AS locked_until, 0 AS retry_count
  FROM events), pending AS (
  SELECT * FROM outbox
  WHERE processed_at IS NULL AND (locked_until IS NULL OR locked_until < {NOW}))"""


def hash_vector_sql(source: str, key: str, text: str, dim: int) -> str:
    """CTEs ending in ``hv(key, v)``."""
    return f"""hx AS (SELECT {key} AS k, hex(encode({text})) AS h, octet_length(encode({text})) AS n FROM {source}),
raw AS (SELECT k, list_transform(range({dim}), lambda i: list_extract(list_transform(
    [(instr('0123456789ABCDEF', substr(h, 2 * (i % n) + 1, 1)) - 1) * 16
     + (instr('0123456789ABCDEF', substr(h, 2 * (i % n) + 2, 1)) - 1)],
    lambda b: CAST((abs(xor(i * 31 + (CASE WHEN b > 127 THEN b - 256 ELSE b END), n * 17)) % 1000) / 1000.0 AS FLOAT)), 1)) AS v
  FROM hx),
sq AS (SELECT k, v, list_reduce(list_prepend(CAST(0 AS FLOAT), list_transform(v, lambda x: CAST(x * x AS FLOAT))),
  lambda a, x: CAST(a + x AS FLOAT)) AS s FROM raw),
hv AS (SELECT k AS key, list_transform(v, lambda x: CAST(x / CAST(sqrt(CAST(s AS DOUBLE)) AS FLOAT) AS FLOAT)) AS v FROM sq)"""


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RU = ("иями|ями|ами|ого|его|ому|ему|ыми|ими|ия|ие|ии|ий|ой|ый|ая|яя|ое|ее|ые|ую|юю|ов|ев|ах|ях|ам|ям|"
       "ом|ем|а|я|ы|и|у|ю|е|о|ь")


def light_sql(word: str) -> str:
    return (f"CASE WHEN {word} >= 'Ѐ' AND {word} < 'Ԯ' THEN regexp_replace({word}, '^(.{{3,}}?)(?:{_RU})$', '\\1') "
            f"ELSE regexp_replace({word}, '^(.{{3,}}?)(?:{'|'.join(LIGHT_ENGLISH)})$', '\\1') END")


POSTINGS = rf"""ws AS (
  SELECT id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS t,
         regexp_extract_all(lower(content_text), '[\p{{L}}\p{{N}}]+') AS b FROM docs),
wp AS (SELECT id, len(t) AS nt, unnest(list_concat(t, b)) AS word, generate_subscripts(list_concat(t, b), 1) AS pos FROM ws),
post AS (SELECT id, {light_sql('word')} AS lexeme, pos, CASE WHEN pos <= nt THEN 'A' ELSE 'B' END AS weight
  FROM wp WHERE word NOT IN ({_STOP}))"""


def text_rank_sql(groups: list[list[str]], where: str) -> str:
    """CTEs ending in ``ranked(id, text_score, text_rank)`` for alternatives of needed lexemes."""
    terms = sorted({t for g in groups for t in g})
    lasts = ", ".join(
        f"last_value(CASE WHEN lexeme = '{t}' THEN pos END IGNORE NULLS) OVER w AS l{i}" for i, t in enumerate(terms))

    def begin(group: list[str]) -> str:
        cols = [f"l{terms.index(t)}" for t in group]
        return f"CASE WHEN {' AND '.join(c + ' IS NOT NULL' for c in cols)} THEN least({', '.join(cols)}) END"

    start = f"greatest({', '.join(begin(g) for g in groups)})" if len(groups) > 1 else begin(groups[0])
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""lex AS (SELECT id, list(DISTINCT lexeme) AS ls FROM post GROUP BY id),
hit AS (SELECT id FROM lex WHERE {where}),
occ AS (SELECT id, pos, lexeme, CASE weight WHEN 'A' THEN 1.0 ELSE 2.5 END AS inv FROM post
  WHERE lexeme IN ({names}) AND id IN (SELECT id FROM hit)),
lst AS (SELECT id, pos, {lasts} FROM occ WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
spn AS (SELECT id, pos AS p, {start} AS s FROM lst),
cov AS (SELECT id, s, min(p) AS p FROM spn WHERE s IS NOT NULL GROUP BY id, s),
sco AS (SELECT c.id, c.s, c.p, count(*) AS n, sum(CAST(o.inv AS DOUBLE)) AS inv FROM cov c
  JOIN occ o ON o.id = c.id AND o.pos BETWEEN c.s AND c.p GROUP BY c.id, c.s, c.p),
tot AS (SELECT h.id, coalesce(round(sum(n / inv / (1 + (p - s) - (n - 1))), 9), 0.0) AS text_score
  FROM hit h LEFT JOIN sco ON sco.id = h.id GROUP BY h.id),
ranked AS (SELECT id, text_score, row_number() OVER (ORDER BY text_score DESC, id) AS text_rank FROM tot
  QUALIFY text_rank <= 50)"""


def _has(*lexemes: str) -> str:
    return " AND ".join(f"list_contains(ls, '{w}')" for w in lexemes)


RANKED_OUT = "SELECT id, text_score, CAST(text_rank AS INTEGER) AS text_rank FROM ranked"

# Search and feeds

ORACLES["unread_feed_newest"] = f"""WITH {ITEMS}
SELECT id, source_id, external_id, title, url, content_text AS clean_content, published_at
FROM items WHERE NOT read ORDER BY published_at DESC, id LIMIT 20"""

ORACLES["unread_feed_undated"] = f"""WITH {ITEMS}
SELECT id, source_id, external_id, title, url, content_text AS clean_content,
  CASE WHEN id % 5 = 0 THEN published_at END AS published_at FROM items WHERE NOT read"""

ORACLES["content_scan"] = f"""WITH {ITEMS}
SELECT id, source_id, external_id, title, url, content_text AS clean_content, published_at FROM items"""


def near_sql(query: str) -> str:
    return f"""near AS (SELECT id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 10) AS distance
  FROM items, {query} q WHERE embedding IS NOT NULL),
vec AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS vector_rank FROM near QUALIFY vector_rank <= 50)"""


def one_query(text: str) -> str:
    return f"q AS (SELECT 0 AS k, '{text}' AS t), " + hash_vector_sql("q", "k", "t", DIM)


# "anat ated" after the light stemmer
ANAT, ATED = "anat", "ated"

ORACLES["hybrid_search_one"] = f"""WITH {ITEMS}, {one_query('anat ated')}, {near_sql('hv')},
{POSTINGS}, {text_rank_sql([[ANAT, ATED]], _has(ANAT, ATED))},
fused AS (SELECT coalesce(v.id, t.id) AS id,
    coalesce(1.0::DOUBLE / (60 + v.vector_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + t.text_rank), 0.0) AS rrf_score
  FROM vec v FULL OUTER JOIN ranked t ON v.id = t.id)
SELECT f.id AS content_id, i.title, i.url, i.content_text AS clean_content, f.rrf_score
FROM fused f JOIN items i ON i.id = f.id ORDER BY f.rrf_score DESC, f.id LIMIT 20"""

ORACLES["vector_top50"] = f"""WITH {ITEMS}, {one_query('atat')}, {near_sql('hv')}
SELECT id, distance, CAST(vector_rank AS INTEGER) AS vector_rank FROM vec"""

ORACLES["vector_top50_pruned"] = ORACLES["vector_top50"]

ORACLES["vector_top50_table"] = f"""WITH {hash_vector_sql('benchmark', 'item_id', 'text', DIM)},
near AS (SELECT q.key AS query_id, e.vec_id AS id,
    round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 10) AS distance
  FROM embeddings e, hv q)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS vector_rank
FROM near QUALIFY vector_rank <= 50"""

ORACLES["text_top50_all_words"] = (
    f"WITH {DOCS}, {POSTINGS}, {text_rank_sql([[ANAT, ATED]], _has(ANAT, ATED))} {RANKED_OUT}")
ORACLES["text_top50_one_word"] = (
    f"WITH {DOCS}, {POSTINGS}, {text_rank_sql([['ananbl']], _has('ananbl'))} {RANKED_OUT}")
_EITHER = f"({_has('atat', 'ated')}) OR ({_has('ananbl')} AND NOT {_has('thion')})"
ORACLES["text_top50_either_not"] = f"""WITH {DOCS}, {POSTINGS},
{text_rank_sql([['atat', 'ated'], ['ananbl']], _EITHER).replace(
    "lexeme IN ('ananbl', 'ated', 'atat')", "lexeme IN ('ananbl', 'ated', 'atat', 'thion')")} {RANKED_OUT}"""
ORACLES["text_top50_postings"] = ORACLES["text_top50_either_not"]
ORACLES["text_top50_phrase"] = f"""WITH {DOCS}, {POSTINGS}, {text_rank_sql(
    [[ANAT]], "id IN (SELECT id FROM post WHERE lexeme = 'anat')")} {RANKED_OUT}"""



def adjacent(first: str, second: str) -> str:
    return (f"(SELECT a.id FROM post a JOIN post b ON a.id = b.id AND b.pos = a.pos + 1 "
            f"WHERE a.lexeme = '{first}' AND b.lexeme = '{second}')")


ORACLES["text_top50_two_word_phrase"] = f"""WITH {DOCS}, {POSTINGS}, {text_rank_sql(
    [['eriner', 'thanea']], f"id IN {adjacent('eriner', 'thanea')} AND id NOT IN {adjacent('de', 'la')}").replace(
    "lexeme IN ('eriner', 'thanea')", "lexeme IN ('eriner', 'thanea', 'de', 'la')")} {RANKED_OUT}"""

ORACLES["text_top50_deny_only"] = f"""WITH {DOCS}, {POSTINGS},
asked(query_id) AS (VALUES (1), (2), (3)),
{text_rank_sql([['ananbl']], _has('ananbl'))},
word AS (SELECT id, text_score FROM ranked),
words AS (SELECT DISTINCT id, lexeme FROM post),
denied AS (SELECT 1 AS query_id, id, 0.0::DOUBLE AS text_score FROM docs
    WHERE id NOT IN (SELECT id FROM words WHERE lexeme IN ('{ANAT}', '{ATED}'))),
either AS (SELECT 3 AS query_id, d.id, coalesce(w.text_score, 0.0::DOUBLE) AS text_score FROM docs d
    LEFT JOIN tot w ON w.id = d.id
    WHERE w.id IS NOT NULL OR d.id NOT IN (SELECT id FROM words WHERE lexeme = '{ANAT}')),
every_one AS (SELECT * FROM denied UNION ALL SELECT * FROM either UNION ALL SELECT 2, id, text_score FROM word),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, id) AS r FROM every_one)
SELECT query_id, id, text_score, CAST(r AS INTEGER) AS text_rank FROM placed WHERE r <= 50"""

ORACLES["postings"] = f"WITH {DOCS}, {POSTINGS} SELECT id, lexeme, CAST(pos AS INTEGER) AS pos, weight FROM post"

QUERY_TERMS = rf"""qt AS (SELECT DISTINCT item_id AS query_id, {light_sql('word')} AS lexeme FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM benchmark)
  WHERE word NOT IN ({_STOP}) AND word <> 'or'),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
hits AS (SELECT query_id, id FROM (SELECT DISTINCT q.query_id, p.id, p.lexeme FROM post p JOIN qt q ON q.lexeme = p.lexeme)
  JOIN qn USING (query_id) GROUP BY query_id, id, n HAVING count(*) = n),
qocc AS (SELECT h.query_id, h.id, p.pos, p.lexeme, CASE p.weight WHEN 'A' THEN 1.0 ELSE 2.5 END AS inv
  FROM hits h JOIN qt USING (query_id) JOIN post p ON p.id = h.id AND p.lexeme = qt.lexeme),
qlast AS (SELECT a.query_id, a.id, a.pos AS p, t.lexeme, max(b.pos) AS l FROM qocc a JOIN qt t ON t.query_id = a.query_id
  LEFT JOIN qocc b ON b.query_id = a.query_id AND b.id = a.id AND b.lexeme = t.lexeme AND b.pos <= a.pos
  GROUP BY a.query_id, a.id, a.pos, t.lexeme),
qspan AS (SELECT query_id, id, p, CASE WHEN count(l) = count(*) THEN min(l) END AS s FROM qlast GROUP BY query_id, id, p),
qcov AS (SELECT query_id, id, s, min(p) AS p FROM qspan WHERE s IS NOT NULL GROUP BY query_id, id, s),
qsco AS (SELECT c.query_id, c.id, c.s, c.p, count(*) AS n, sum(CAST(o.inv AS DOUBLE)) AS inv FROM qcov c
  JOIN qocc o ON o.query_id = c.query_id AND o.id = c.id AND o.pos BETWEEN c.s AND c.p GROUP BY ALL),
qtot AS (SELECT query_id, id, round(sum(n / inv / (1 + (p - s) - (n - 1))), 9) AS text_score FROM qsco GROUP BY query_id, id),
qranked AS (SELECT query_id, id, text_score, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, id) AS text_rank
  FROM qtot QUALIFY text_rank <= 50)"""

ORACLES["text_top50_table"] = f"""WITH {DOCS}, {POSTINGS}, {QUERY_TERMS}
SELECT query_id, id, text_score, CAST(text_rank AS INTEGER) AS text_rank FROM qranked"""

ORACLES["text_top50_table_scan"] = ORACLES["text_top50_table"]

ORACLES["hybrid_search_table"] = rf"""WITH {ITEMS}, {POSTINGS}, {QUERY_TERMS},
qs AS (SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w <> 'or'), ' ') AS text
  FROM benchmark),
{hash_vector_sql('qs', 'item_id', 'text', DIM)},
near AS (SELECT q.key AS query_id, i.id,
    round(list_cosine_distance(CAST(i.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 10) AS distance
  FROM items i, hv q WHERE i.embedding IS NOT NULL),
vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vector_rank
  FROM near QUALIFY vector_rank <= 50),
fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id,
    coalesce(1.0::DOUBLE / (60 + v.vector_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + t.text_rank), 0.0) AS rrf_score
  FROM vec v FULL OUTER JOIN qranked t ON v.query_id = t.query_id AND v.id = t.id),
best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) <= 20)
SELECT b.query_id, b.id AS content_id, i.title, i.url, b.rrf_score FROM best b JOIN items i ON i.id = b.id"""

ORACLES["rrf_scores"] = """SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_linenumber <> 3 AND l_linenumber > 1 THEN 1.0::DOUBLE / (60 + l_linenumber - 1) ELSE 0 END
    + CASE WHEN CAST(l_quantity AS INTEGER) > 0 THEN 1.0::DOUBLE / (60 + CAST(l_quantity AS INTEGER)) ELSE 0 END, 9) AS rrf_score
FROM lineitem"""

# Vectors

ORACLES["unit_vectors"] = """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS v FROM embeddings),
b AS (SELECT vec_id, v, list_reduce(list_prepend(CAST(0 AS FLOAT), list_transform(v, lambda x: CAST(x * x AS FLOAT))),
  lambda p, q: CAST(p + q AS FLOAT)) AS s FROM a),
c AS (SELECT vec_id, list_transform(v, lambda x: CAST(x / CAST(sqrt(CAST(s AS DOUBLE)) AS FLOAT) AS FLOAT)) AS u FROM b)
SELECT vec_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS i, round(CAST(unnest(u) AS DOUBLE), 6) AS x FROM c"""

ORACLES["hash_vectors"] = f"""WITH {hash_vector_sql('documents', 'doc_id', 'text', DIM)}
SELECT key AS doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(CAST(unnest(v) AS DOUBLE), 6) AS x FROM hv"""

ORACLES["vector_literals"] = """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings"""

ORACLES["rows_with_vector"] = f"""WITH {ITEMS}
SELECT embedding IS NOT NULL AS has_vector, count(*) AS n FROM items GROUP BY 1"""

# Ids, keys, events

def uuid3_sql(text: str) -> str:
    m = f"md5({text})"
    return (f"concat(substr({m}, 1, 8), '-', substr({m}, 9, 4), '-3', substr({m}, 14, 3), '-', "
            f"translate(substr({m}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({m}, 18, 3), '-', substr({m}, 21, 12))")


ORACLES["name_uuids"] = f"""SELECT doc_id,
  {uuid3_sql("concat(source, ':', CASE WHEN doc_id % 5 <> 0 THEN text ELSE 'null' END)")} AS aggregate_id FROM documents"""

ORACLES["cache_keys"] = """SELECT c_custkey, concat('search:', lower(c_name), ':20') AS search_key,
  concat('feed:', c_custkey, ':v', c_nationkey, ':l50') AS feed_key FROM customer"""

ORACLES["shifted_times"] = """SELECT event_id, ts + to_milliseconds(CAST(trunc(value * 100) AS BIGINT)) AS later,
  ts - INTERVAL 1 DAY AS earlier FROM events"""


def iso_sql(ts: str) -> str:
    return f"replace(CAST({ts} AS VARCHAR), ' ', 'T')"


def event_sql(event_id: str, source: str, external: str, title: str, url: str, published: str) -> str:
    return f"""CAST(to_json({{'eventId': {event_id}, 'timestamp': '2024-01-20T00:00:00', 'sourceId': {source},
  'externalId': {external}, 'contentType': 'RSS', 'title': {title}, 'url': {url}, 'publishedAt': {published}}}) AS VARCHAR)"""


ORACLES["encoded_events"] = f"""WITH {ITEMS} SELECT id, {event_sql(
    'external_id', 'source_id', "CASE WHEN id % 4 <> 0 THEN external_id ELSE '' END", 'content_text', 'url',
    "CASE WHEN id % 5 <> 0 THEN " + iso_sql('published_at') + " ELSE '2024-01-20T00:00:00' END")} AS payload FROM items"""

RECORDS = f"""sent AS (SELECT d.*, r.round, r.edition FROM docs d, (VALUES (0, 'first'), (1, 'second')) r(round, edition)),
recs AS (SELECT *, external_id AS key, {event_sql(
    "concat('e', external_id)", 'source_id', 'external_id', "concat(title, ' ', edition)", 'url', "'2024-01-20T00:00:00'")} AS whole,
  id * 2 + round AS "offset", CAST(id % 4 AS INTEGER) AS "partition" FROM sent)"""

ORACLES["decoded_events"] = f"""WITH {DOCS}, {RECORDS}
SELECT "offset", CASE WHEN id % 10 <> 0 THEN concat('e', external_id) END AS event_id,
  CASE WHEN id % 10 <> 0 THEN source_id END AS source_id, CASE WHEN id % 10 <> 0 THEN external_id END AS external_id,
  CASE WHEN id % 10 <> 0 THEN concat(title, ' ', edition) END AS title, CASE WHEN id % 10 <> 0 THEN url END AS url,
  CASE WHEN id % 10 <> 0 THEN {NOW} END AS published_at, id % 10 = 0 AS failed FROM recs"""

# URLs, text, dates, constraints, sources

_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"

ORACLES["url_safety"] = f"""SELECT page_id, CASE WHEN {_HOST} = '' THEN 'default' ELSE {_HOST} END AS domain,
  contains({_HOST}, '.') AND NOT regexp_matches({_HOST}, '^[.]|[.]$') AS safe FROM pages"""

ORACLES["address_safety"] = """WITH o AS (SELECT o_orderkey, o_custkey % 256 AS a, o_orderkey % 256 AS b, o_custkey % 200 AS d,
    o_orderkey % 3 AS s FROM orders)
SELECT o_orderkey, concat(CASE s WHEN 0 THEN 'http' WHEN 1 THEN 'HTTPS' ELSE 'ftp' END, '://', a, '.', b, '.7.', d, ':8080/x') AS url,
  s < 2 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)) AS safe FROM o"""

ORACLES["resolved_url_safety"] = f"""SELECT page_id, {_HOST} AS domain,
  CASE WHEN length({_HOST}) % 4 IN (0, 2) THEN false ELSE contains({_HOST}, '.') END AS safe FROM pages"""

# Elements that break a line of text.
_BREAKING = (
    "address article aside audio blockquote body br canvas caption center col colgroup dd del details dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html ins li link main math menu meta "
    "nav noframes noscript ol p plaintext pre script section style svg table tbody td template tfoot th thead title tr ul video")
_NAMES = ", ".join("'%s': '%s'" % (n, t.replace("'", "'" * 2)) for n, t in html.entities.html5.items())
_BARE = " ".join(f"WHEN starts_with(p, '{n}') THEN '{n}'" for n in sorted(
    (n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))
ORACLES["cleaned_pages"] = rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html, '<!--.*?-->', '', 'gs'), '<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'gis'),
    '</?({_BREAKING.replace(" ", "|")})(\s[^>]*|/)?>', ' ', 'gi'), '</?[A-Za-z][^>]*>|<![A-Za-z][^>]*>|<\?[^>]*>', '', 'g') AS t FROM pages),
names AS (SELECT MAP {{{_NAMES}}} AS m),
parts AS (SELECT page_id, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM a),
taken AS (SELECT page_id, i, p, CASE WHEN i = 1 THEN ''
    WHEN map_extract_value(m, regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')) IS NOT NULL THEN regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')
    {_BARE} ELSE '' END AS n FROM parts, names),
dec AS (SELECT page_id, i, CASE WHEN i = 1 THEN p WHEN n <> '' THEN concat(map_extract_value(m, n), substr(p, length(n) + 1))
    WHEN regexp_matches(p, '^#[0-9]{{1,7}};?') THEN concat(chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INTEGER)),
      regexp_replace(p, '^#[0-9]+;?', ''))
    ELSE concat('&', p) END AS q FROM taken, names),
whole AS (SELECT page_id, string_agg(q, '' ORDER BY i) AS t FROM dec GROUP BY page_id)
SELECT page_id, trim(regexp_replace(regexp_replace(t, concat('[', chr(8203), chr(173), ']'), '', 'g'),
  concat('[ \t\n\f\r', chr(160), ']+'), ' ', 'g')) AS text FROM whole"""

ORACLES["feed_dates"] = """SELECT event_id, CASE WHEN event_id % 7 < 5 THEN date_trunc('second', ts) END AS published_at FROM events"""

ORACLES["constraint_check"] = f"""WITH {ITEMS}
SELECT id, array_to_string(list_filter([
  CASE WHEN id % 7 = 0 THEN 'external_id is null' END, CASE WHEN content_text IS NULL THEN 'title is null' END,
  CASE WHEN length(content_text) > 512 THEN 'title longer than 512' END, CASE WHEN length(url) > 34 THEN 'url longer than 34' END,
  CASE WHEN len(embedding) <> {DIM} THEN 'embedding size is not {DIM}' END], lambda x: x IS NOT NULL), '; ') AS violations FROM items"""

ORACLES["payload_size_guard"] = """SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS length,
  octet_length(encode(html)) <= 4096 AS fits FROM pages"""

ORACLES["accepted_payloads"] = """SELECT o_orderkey, 100 + o_orderkey % 500 AS status FROM orders
WHERE 100 + o_orderkey % 500 BETWEEN 200 AND 299"""

ORACLES["payload_sources"] = """SELECT c_custkey, n_name AS source_id,
  concat('https://feed.example.org/', n_nationkey) AS url FROM customer JOIN nation ON n_nationkey = c_custkey % 40"""

FEED_LINES = """lines AS (SELECT doc_id, source, doc_id % 3 AS kind, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
clean AS (SELECT *, concat(doc_id, '-', n - 1) AS number,
  trim(regexp_replace(line, concat('[ \\t\\n\\f\\r', chr(160), ']+'), ' ', 'g')) AS t FROM lines),
feed AS (SELECT source AS source_id, CASE kind WHEN 0 THEN 'rss' ELSE 'atom' END AS format, CAST(n AS INTEGER) AS position,
  CASE WHEN kind = 0 AND (n - 1) % 2 = 0 THEN concat('g-', number) WHEN kind = 0 THEN concat('https://feed.example.org/', number)
       WHEN kind = 1 THEN concat('urn:', number) ELSE concat('v', number) END AS external_id,
  t AS title, concat('https://feed.example.org/', number) AS url, t AS content_text,
  CASE kind WHEN 0 THEN TIMESTAMP '2025-03-19 21:05:00' WHEN 1 THEN TIMESTAMP '2024-05-02 06:15:00'
       ELSE TIMESTAMP '2024-01-20 00:00:00' END AS published_at FROM clean)"""

ORACLES["feed_items"] = f"WITH {FEED_LINES} SELECT * FROM feed"

ORACLES["ingested_feeds"] = f"""WITH {FEED_LINES}, {DOCS},
known AS (SELECT {uuid3_sql("concat(source_id, ':g-', external_id, '-0')")} AS aggregate_id FROM docs),
ids AS (SELECT *, {uuid3_sql("concat(source_id, ':', external_id)")} AS aggregate_id FROM feed)
SELECT aggregate_id, 'CONTENT' AS aggregate_type, 'ContentDiscoveredEvent' AS type,
  {event_sql('external_id', 'source_id', 'external_id', 'title', 'url', iso_sql('published_at'))} AS payload,
  {NOW} AS created_at, 0 AS retry_count FROM ids WHERE aggregate_id NOT IN (SELECT aggregate_id FROM known)"""

# Outbox

ORACLES["first_insert_wins"] = f"""WITH {DOCS}
SELECT source_id, external_id, concat(title, ' 1') AS title, 1 AS "offset" FROM docs WHERE id % 2 <> 0"""

ORACLES["new_outbox"] = f"""WITH {DOCS}
SELECT 'CONTENT' AS aggregate_type, {uuid3_sql("concat(source_id, ':', external_id)")} AS aggregate_id,
  'ContentDiscoveredEvent' AS type,
  {event_sql('external_id', 'source_id', 'external_id', 'title', 'url', "'2024-01-20T00:00:00'")} AS payload,
  {NOW} AS created_at, CAST(NULL AS TIMESTAMP) AS processed_at, 0 AS retry_count, CAST(NULL AS VARCHAR) AS error_message,
  CAST(NULL AS TIMESTAMP) AS locked_until, source_id, external_id FROM docs"""

ORACLES["pending_outbox"] = f"WITH {OUTBOX} SELECT id, created_at FROM pending"
ORACLES["expired_outbox"] = f"""WITH {OUTBOX} SELECT id, processed_at FROM outbox WHERE processed_at < {NOW} - INTERVAL 7 DAY"""


def claimed(limit: int) -> str:
    return f"claimed AS (SELECT * FROM pending ORDER BY created_at, id LIMIT {limit})"


ORACLES["claimed_batch"] = f"WITH {OUTBOX}, {claimed(50)} SELECT id, aggregate_id, payload FROM claimed"
ORACLES["claimed_state"] = f"""WITH {OUTBOX}, {claimed(50)}
SELECT id, processed_at, CASE WHEN id IN (SELECT id FROM claimed) THEN {NOW} + INTERVAL 30 SECOND ELSE locked_until END AS locked_until
FROM outbox"""
ORACLES["processed_state"] = f"""WITH {OUTBOX}
SELECT id, CASE WHEN id % 3 = 0 THEN {NOW} ELSE processed_at END AS processed_at, retry_count, locked_until FROM outbox"""
ORACLES["failed_state"] = f"""WITH {OUTBOX}
SELECT id, processed_at, CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN id % 3 = 1 THEN concat('broker ', id) END AS error_message, locked_until FROM outbox"""
ORACLES["published_state"] = f"""WITH {OUTBOX}, {claimed(200)}
SELECT o.id, CASE WHEN c.id IS NOT NULL AND o.id % 2 = 0 THEN {NOW} ELSE o.processed_at END AS processed_at,
  CASE WHEN c.id IS NOT NULL AND o.id % 2 = 1 THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN c.id IS NOT NULL AND o.id % 2 = 1 THEN 'timeout' END AS error_message,
  CASE WHEN c.id IS NOT NULL THEN {NOW} + INTERVAL 30 SECOND ELSE o.locked_until END AS locked_until
FROM outbox o LEFT JOIN claimed c ON c.id = o.id"""
ORACLES["published_number"] = f"""WITH {OUTBOX}, {claimed(200)}
SELECT count(*) FILTER (WHERE id % 2 = 0) AS published FROM claimed"""
ORACLES["purged_state"] = f"""WITH {OUTBOX} SELECT id, processed_at FROM outbox
WHERE processed_at IS NULL OR processed_at >= {NOW} - INTERVAL 7 DAY"""
ORACLES["purged_number"] = f"""WITH {OUTBOX} SELECT count(*) AS purged FROM outbox WHERE processed_at < {NOW} - INTERVAL 7 DAY"""

# Consuming and enrichment

ORACLES["consumed_items"] = f"""WITH {DOCS}, {RECORDS}
SELECT source_id, external_id, concat(title, ' first') AS title, url, concat(title, ' first') AS content_text, false AS read,
  {NOW} AS published_at, {NOW} AS created_at FROM docs
WHERE id % 10 <> 0 AND id % 4 <> 1 AND length(concat(title, ' first')) <= 512"""
_LONG = "(id % 10 <> 0 AND length(concat(title, ' ', edition)) > 512)"
ORACLES["dead_letters"] = f"""WITH {DOCS}, {RECORDS}
SELECT key, CASE WHEN id % 10 = 0 THEN substr(whole, 1, CAST(floor(length(whole) / 2) AS BIGINT)) ELSE whole END AS value,
  'content-discovered.DLT' AS topic, CASE WHEN id % 10 = 0 THEN 'DecodingError' ELSE 'ConstraintError' END AS error_class,
  'content-discovered' AS source_topic, "partition" AS source_partition, "offset" AS source_offset
FROM recs WHERE id % 10 = 0 OR {_LONG}"""
ORACLES["consumed_items_keyed"] = ORACLES["consumed_items"]
ORACLES["dead_letters_keyed"] = ORACLES["dead_letters"]
ORACLES["inserted_items"] = f"""WITH {ITEMS}
SELECT source_id, external_id, title, url, content_text, false AS read, published_at, {NOW} AS created_at, {NOW} AS updated_at FROM items"""
ORACLES["enriched_without_model"] = f"""WITH {DOCS}
SELECT id, title AS summary, 0 AS n_tags, 'General' AS primary_category, 1 AS estimated_read_minutes, true AS no_vector,
  'FALLBACK' AS status FROM docs"""
_TEXT = "concat(title, ' ', content_text)"
ORACLES["enriched_with_model"] = f"""WITH {DOCS}
SELECT id, CASE WHEN contains({_TEXT}, '?') THEN 'FALLBACK' ELSE 'SUCCESS' END AS status,
  CASE WHEN NOT contains({_TEXT}, '?') THEN CAST(length({_TEXT}) AS DOUBLE) END AS length,
  CASE WHEN NOT contains({_TEXT}, '?') THEN CAST(length({_TEXT}) - length(replace({_TEXT}, 'a', '')) AS DOUBLE) END AS letters FROM docs"""
ORACLES["query_vectors"] = f"""WITH c AS (SELECT *, row_number() OVER () AS k FROM conversations),
{hash_vector_sql('c', 'k', 'text', 2)}
SELECT conv_id, turn,
  round(CASE WHEN contains(text, '?') THEN CAST(hv.v[1] AS DOUBLE) ELSE CAST(length(text) AS DOUBLE) END, 6) AS x,
  round(CASE WHEN contains(text, '?') THEN CAST(hv.v[2] AS DOUBLE) ELSE CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) END, 6) AS y
FROM c JOIN hv ON hv.key = c.k"""

# Policies

ORACLES["rate_limited_calls"] = """WITH bursts AS (
  SELECT CAST(user_id AS VARCHAR) AS domain, ts, event_id * 8 + unnest(range(0, event_id % 8 + 1)) AS call_id FROM events)
SELECT domain, call_id, row_number() OVER (PARTITION BY domain, date_trunc('second', ts) ORDER BY call_id) <= 5 AS admitted FROM bursts"""
ORACLES["breaker_signal"] = """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS call_id,
  count(*) OVER w AS window_calls, count(*) FILTER (WHERE event_type = 'error') OVER w AS window_failures
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT *, window_calls >= 5 AND window_failures >= 0.5 * window_calls AS tripped FROM c"""
ORACLES["refresh_decisions"] = """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 5 - 20 AS left_ms,
  0.0001::DOUBLE + (l_orderkey % 9999) / 10000.0::DOUBLE AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN left_ms <= 0 THEN 'expired'
  WHEN left_ms <= 150 AND -50 * ln(r) > left_ms THEN 'refresh' ELSE 'fresh' END AS decision FROM a"""
ORACLES["user_feed_versions"] = """SELECT c_custkey AS user_id, 1 + count(o_orderkey) AS version
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
ORACLES["retry_decisions"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'done'
  WHEN l_linenumber <= 3 THEN 'retry' ELSE 'dead_letter' END AS decision FROM lineitem"""

# Metrics

ORACLES["ingested_counts"] = """SELECT source AS source_id, count(*) AS ingested FROM documents GROUP BY ROLLUP (source)"""
ORACLES["row_counts"] = f"""WITH {ITEMS}
SELECT count(*) AS total, count(*) FILTER (WHERE NOT read) AS unread, count(embedding) AS with_vector FROM items"""
ORACLES["request_rates"] = """SELECT date_trunc('minute', ts) AS window_start, round(count(*) / 60.0::DOUBLE, 9) AS rate FROM events GROUP BY 1"""
ORACLES["hourly_metrics_from_minutes"] = """SELECT event_type AS endpoint, date_trunc('hour', ts) AS window_start,
  round(count(*) / 3600.0::DOUBLE, 9) AS rate, round(count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE), 9) AS error_rate,
  max(value) AS max_value FROM events GROUP BY 1, 2"""
ORACLES["max_per_minute"] = """SELECT date_trunc('minute', ts) AS window_start, max(value) AS max_value FROM events GROUP BY 1"""
_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
ORACLES["latency_quantiles_by_endpoint"] = f"SELECT event_type AS endpoint, {_Q} FROM events GROUP BY 1"
ORACLES["latency_quantiles_null_group"] = f"""SELECT endpoint, {_Q} FROM (
  SELECT CASE WHEN event_type <> 'click' THEN event_type END AS endpoint, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value
  FROM events) GROUP BY 1"""
ORACLES["latency_quantiles_by_minute"] = f"SELECT date_trunc('minute', ts) AS window_start, {_Q} FROM events GROUP BY 1"


def histogram_sql(q: float) -> str:
    bounds = [1, 2, 5, 10, 20, 50, 100]
    cases, low, low_count = "", 0, "0"
    for b in bounds:
        cases += (f" WHEN le{b} >= {q} * n THEN {low} + {b - low} * coalesce(({q} * n - {low_count}) / "
                  f"nullif(CAST(le{b} - {low_count} AS DOUBLE), 0), 0)")
        low, low_count = b, f"le{b}"
    return f"round(CAST(CASE{cases} ELSE 100 END AS DOUBLE), 6)"


_LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le{b}" for b in (1, 2, 5, 10, 20, 50, 100))
ORACLES["histogram_quantiles_by_endpoint"] = f"""WITH h AS (SELECT event_type AS endpoint, count(*) AS n, {_LE} FROM events GROUP BY 1)
SELECT endpoint, {histogram_sql(0.95)} AS p95, {histogram_sql(0.99)} AS p99 FROM h"""
ORACLES["service_levels"] = """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS domain,
  count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS e,
  quantile_cont(value, 0.95) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1)
SELECT domain, round(e, 9) AS error_rate, round(a, 6) AS p95, round(b, 6) AS p99, e < 0.2 AS errors_ok, a < 40 AS p95_ok, b < 100 AS p99_ok FROM s"""

ORACLES["outbox_log_state"] = """SELECT event_id AS id,
  CASE WHEN event_id % 3 <> 0 AND event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) + INTERVAL 3 SECOND END AS processed_at,
  CASE WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 2 ELSE 0 END AS retry_count,
  CASE WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 'second' END AS error_message,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_type = 'click' THEN CAST(ts AS TIMESTAMP) + INTERVAL 70 SECOND
       ELSE CAST(ts AS TIMESTAMP) + INTERVAL 30 SECOND END AS locked_until FROM events"""

ORACLES["outbox_constraint_check"] = """SELECT event_id AS id, concat_ws('; ',
  CASE WHEN event_id % 11 = 0 THEN 'payload is null' END,
  CASE WHEN event_id % 70 > 64 THEN 'aggregate_type longer than 64' END) AS violations FROM events"""
ORACLES["rejected_payloads"] = """SELECT page_id, CASE WHEN strlen(coalesce(html, '')) > 3000 THEN 'too long' ELSE 'empty' END AS reason
FROM pages WHERE strlen(coalesce(html, '')) > 3000 OR strlen(coalesce(html, '')) = 0"""
