"""Mark-up to plain text with built-in string functions."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentspark.functions.binding import bind, let_sql, quoted

# Elements that break a line of text; every other tag vanishes without a gap.
BLOCK_TAGS = (
    "html head body frameset script noscript style meta link title frame noframes section nav aside "
    "hgroup header footer p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption "
    "form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col tr th td video "
    "audio canvas details menu plaintext template article main svg math center dir br"
).split()

COMMENT = r"(?s)<!--.*?-->"
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>"
BLOCK = r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")(\s[^>]*|/)?>"
TAG = r"</?[A-Za-z][^>]*>|<![A-Za-z][^>]*>|<\?[^>]*>"
INVISIBLE = "[\u200b\u00ad]"
BLANKS = "[ \\t\\n\\f\\r\u00a0]+"
# What those two change: any but a single blank.
UNEVEN = "[ \\t\\n\\f\\r\u00a0\u200b\u00ad](?<! (?! ))"

# The standard's named references come from Python's own table. Those that may stand without a semicolon come first: they
# are the common ones, and a look-up walks along the names.
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
_CLOSED = {name[:-1]: text for name, text in sorted(html5.items(), key=lambda x: x[0][:-1] not in _BARE) if name.endswith(";")}

# What the numbers 128 to 159 stand for: the characters of code page 1252 where it has one.
_LOW = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))

_NUMBER = quoted(r"^#([0-9]+|[xX][0-9a-fA-F]+)")
_NAME = quoted(r"^[A-Za-z][A-Za-z0-9]*")
_CDATA, _CDATA_END = "<![CDATA[", "]]>"


def _escaped(text: str) -> str:
    """A text as escapes of its UTF-16 units, for a SQL string."""
    units = text.encode("utf-16-be")
    return "".join(f"\\u{units[i]:02x}{units[i + 1]:02x}" for i in range(0, len(units), 2))


def _names_sql(names: dict[str, str]) -> str:
    return "str_to_map('" + "\\u0002".join(f"{n}\\u0001{_escaped(t)}" for n, t in names.items()) + "', '\\u0002', '\\u0001')"


def _numbered_sql(number: str, part: str) -> str:
    """What follows an ampersand, with the character number at its start replaced. Impossible numbers become U+FFFD."""
    value = (f"try_cast(if(lower(substring({number}, 1, 1)) = 'x', conv(substring({number}, 2), 16, 10), {number}) AS bigint)")
    char = let_sql("c", value, f"CASE WHEN c BETWEEN 128 AND 159 THEN substring('{_escaped(_LOW)}', CAST(c - 127 AS int), 1) "
                               "WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 "
                               "THEN decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') ELSE '\\ufffd' END")
    rest = f"substring({part}, length({number}) + 2)"
    return f"concat({char}, if(startswith({rest}, ';'), substring({rest}, 2), {rest}))"


def _named_sql(name: str, part: str) -> str:
    """What follows an ampersand, with the name at its start replaced; NULL if it begins with no name.

    A name closed by a semicolon counts whole; else the longest beginning counts that may stand without one.
    """
    closed = f"if(substring({part}, length({name}) + 1, 1) = ';', concat({_names_sql(_CLOSED)}[{name}], substring({part}, length({name}) + 2)), NULL)"
    bare = [f"if(length({name}) >= {k}, concat({_names_sql(names)}[substring({name}, 1, {k})], substring({part}, {k + 1})), NULL)"
            for k in range(max(map(len, _BARE)), 1, -1) if (names := {n: t for n, t in _BARE.items() if len(n) == k})]
    return f"coalesce({closed}, {', '.join(bare)})"


def decode_entities_sql(text: str) -> str:
    """Named and numeric character references, each decoded once, from left to right."""
    number = let_sql("n", f"regexp_extract(part, {_NUMBER}, 1)", f"if(n = '', NULL, {_numbered_sql('n', 'part')})")
    name = let_sql("n", f"regexp_extract(part, {_NAME}, 0)", f"if(n = '', NULL, {_named_sql('n', 'part')})")
    replaced = f"coalesce(if(startswith(part, '#'), {number}, {name}), concat('&', part))"
    decoded = f"array_join(transform(split(t, '&'), (part, i) -> if(i = 0, part, {replaced})), '')"
    return let_sql("t", text, f"if(contains(t, '&'), {decoded}, t)")


def strip_tags_sql(text: str) -> str:
    plain = "t"
    for pattern, gap in ((COMMENT, ""), (HIDDEN, ""), (BLOCK, " "), (TAG, "")):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, '{gap}')"
    return let_sql("t", text, f"if(contains(t, '<'), {plain}, t)")


def collapse_blanks_sql(text: str) -> str:
    changed = f"regexp_replace(regexp_replace(t, {quoted(INVISIBLE)}, ''), {quoted(BLANKS)}, ' ')"
    return let_sql("t", text, f"trim(if(t RLIKE {quoted(UNEVEN)}, {changed}, t))")


def plain_text_sql(markup: str) -> str:
    """Visible text of mark-up; NULL stays NULL."""
    return collapse_blanks_sql(decode_entities_sql(strip_tags_sql(markup)))


def decode_entities(text: Column) -> Column:
    return bind(decode_entities_sql("p.text"), text=text)


def clean_html(text: Column) -> Column:
    """Visible text of a fragment: no tags, entities decoded, single blanks; '' for NULL."""
    return F.coalesce(bind(plain_text_sql("p.text"), text=text), F.lit(""))


def escape_cdata_sql(text: str) -> str:
    """Character-data sections rewritten as escaped text, so that later tag matching cannot see into them."""
    def escaped(raw: str) -> str:
        return f"replace(replace(replace({raw}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    section = let_sql(
        "e", f"locate('{_CDATA_END}', part)",
        f"if(e > 0, concat({escaped('substring(part, 1, e - 1)')}, substring(part, e + {len(_CDATA_END)})), {escaped('part')})")
    sections = f"array_join(transform(split(t, {quoted(re.escape(_CDATA))}), (part, i) -> if(i = 0, part, {section})), '')"
    return let_sql("t", text, f"if(contains(t, '{_CDATA}'), {sections}, t)")
