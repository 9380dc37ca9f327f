"""Feed items out of landed payloads.

Everything works on the payload text with built-in functions: character data is escaped first, then the text is
split at the start tags of items, which also finds the items of documents whose tags are never closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentspark.functions.binding import bind, let_sql, quoted
from contentspark.functions.dates import parse_feed_date
from contentspark.functions.html import COMMENT, clean_html, decode_entities_sql, escape_cdata_sql, plain_text_sql

MAX_PAYLOAD_BYTES = 5 * 1024 * 1024


def size_fits(length: Column, max_bytes: int = MAX_PAYLOAD_BYTES) -> Column:
    return length <= max_bytes


def split_by_size(payloads: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Payloads to read, and those rejected for their size."""
    fits = size_fits(F.col("length"), max_bytes)
    return payloads.where(fits), payloads.where(~fits)


def _start(tag: str) -> str:
    return quoted(rf"(?i)<{tag}(?=[\s>/])")


def inner_sql(text: str, tag: str) -> str:
    """Mark-up inside the first element of this name; NULL without one, to the end when it is never closed."""
    end = rf"</{tag}\s*>|\z"
    pattern = rf"(?is)<{tag}(?:\s[^>]*?)?(?:/>|>([^<]*+(?:(?={end})|.*?))(?:{end}))"
    return let_sql("r", f"regexp_extract({text}, {quoted(pattern)}, 1)", f"if(r <> '', r, if({text} RLIKE {_start(tag)}, '', NULL))")


def text_sql(text: str, tag: str) -> str:
    """Visible text of the first element of this name."""
    return plain_text_sql(inner_sql(text, tag))


def non_blank_sql(text: str) -> str:
    return let_sql("b", text, "if(b = '', NULL, b)")


def atom_link_sql(entry: str) -> str:
    """Target of the first link that has one, else the text of the first link."""
    tag = quoted(r"""(?is)<link\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*')""")
    value = quoted(r"""(?is)^<link\s(?:[^>]*?\s)?href\s*=\s*["'](.*)["']$""")
    target = decode_entities_sql(f"regexp_extract(tag, {value}, 1)")
    return let_sql("tag", f"regexp_extract({entry}, {tag}, 0)", f"if(tag = '', {text_sql(entry, 'link')}, {target})")


def atom_content_sql(entry: str) -> str:
    media = let_sql("media", inner_sql(entry, "media:group"), text_sql("media", "media:description"))
    return (f"coalesce({non_blank_sql(media)}, {non_blank_sql(text_sql(entry, 'summary'))}, "
            f"{text_sql(entry, 'content')})")


def _fields_sql(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


RSS_FIELDS = let_sql("url", text_sql("p.m", "link"), _fields_sql(
    external_id=f"coalesce({non_blank_sql(text_sql('p.m', 'guid'))}, url)",
    url="url", title=text_sql("p.m", "title"), date=text_sql("p.m", "pubDate"),
))
ATOM_FIELDS = let_sql("url", atom_link_sql("p.m"), _fields_sql(
    external_id=f"coalesce({text_sql('p.m', 'yt:videoId')}, {text_sql('p.m', 'id')}, url)",
    url="url", title=text_sql("p.m", "title"),
    date=f"coalesce({non_blank_sql(text_sql('p.m', 'published'))}, {text_sql('p.m', 'updated')})",
))
RSS_BODY, ATOM_BODY = text_sql("p.m", "description"), atom_content_sql("p.m")


def _pieces_sql(text: str) -> str:
    """RSS items when there is any item, else Atom entries when there is any entry, else NULL."""
    def pieces(tag: str, name: str) -> str:
        after = quoted(rf"(?is)</{tag}\s*>.*")
        item = f"named_struct('format', '{name}', 'markup', regexp_replace(piece, {after}, ''))"
        return let_sql("s", f"split(d, {_start(tag)})", f"transform(slice(s, 2, size(s)), piece -> {item})")

    return let_sql("d", text, f"CASE WHEN d RLIKE {_start('item')} THEN {pieces('item', 'rss')} "
                              f"WHEN d RLIKE {_start('entry')} THEN {pieces('entry', 'atom')} END")


def _segments(payloads: DataFrame) -> DataFrame:
    """One row per item: ``format``, ``position`` and the item's mark-up.

    The document stays inside the generator, so exploded rows do not carry it along.
    """
    text = escape_cdata_sql("make_valid_utf8(CAST(p.content AS string))")
    plain = let_sql("t", text, f"if(contains(t, '<!--'), regexp_replace(t, {quoted(COMMENT)}, ''), t)")
    pieces = bind(_pieces_sql(plain), content=F.col("content"))
    return payloads.select("source_id", "ingest_ts", F.posexplode(pieces).alias("i", "piece")).select(
        "source_id", "ingest_ts", (F.col("i") + 1).alias("position"), "piece.format",
        F.col("piece.markup").alias("markup"))


def extract_feed_items(payloads: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """``payloads(source_id, length, content, ingest_ts)`` to one row per feed item, in document order."""
    def by_format(rss: str, atom: str) -> Column:
        return F.when(F.col("format") == "rss", bind(rss, m=F.col("markup"))).otherwise(bind(atom, m=F.col("markup")))

    # What comes out of a generator is worked out once, even where later filters read it. The body is left out of it: a
    # caller that needs none pays for none.
    read = _segments(payloads.where(size_fits(F.col("length"), max_bytes))).select("*", F.inline(F.array(by_format(RSS_FIELDS, ATOM_FIELDS))))
    kept = read.select("source_id", "ingest_ts", "format", "position", "markup", F.inline(F.array(F.struct(
        "external_id", clean_html(F.col("title")).alias("title"), "url",
        F.coalesce(parse_feed_date(F.col("date")), F.col("ingest_ts").cast("timestamp_ntz")).alias("published_at")))))
    return kept.select(
        "source_id", "format", "position", "external_id", "title", "url",
        clean_html(by_format(RSS_BODY, ATOM_BODY)).alias("content_text"), "published_at", "ingest_ts")
