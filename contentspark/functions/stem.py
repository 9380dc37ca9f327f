"""Snowball stemming rules (English and Russian) as SQL expressions over a lower-cased word."""

from __future__ import annotations

from contentspark.functions.binding import let_sql, quoted
from contentspark.functions.text import is_cyrillic_sql

# The published English rules.
ENGLISH_WHOLE = (
    "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli "
    "singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes"
)
ENGLISH_KEPT = "inning outing canning herring earring proceed exceed succeed"
ENGLISH_STEP2 = (
    "ational>ate ization>ize fulness>ful iveness>ive ousness>ous biliti>ble tional>tion lessli>less alism>al "
    "aliti>al ation>ate entli>ent fulli>ful iviti>ive ousli>ous abli>able alli>al anci>ance ator>ate enci>ence "
    "izer>ize bli>ble ogi>og li>"
)
ENGLISH_STEP3 = "ational>ate tional>tion alize>al icate>ic iciti>ic ative> ical>ic ness> ful>"
ENGLISH_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic"

# The published Russian endings; (1) follow а or я, (2) stand alone.
GERUND_1, GERUND_2 = "вшись вши в", "ывшись ившись ывши ивши ыв ив"
REFLEXIVE = "ся сь"
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем нн вш ющ щ", "ивш ывш ующ"
VERB_1 = "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н"
VERB_2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю"
NOUN = (
    "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я"
)

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_TO_REGION = f"^{_OTHER}*{_VOWEL}+{_OTHER}"
_SHORT_END = f"(?:^{_VOWEL}{_OTHER}|{_OTHER}{_VOWEL}[^aeiouywxY])$"


def _any(words: str) -> str:
    return "|".join(words.split())


def _pairs(rules: str) -> str:
    """The rules as a SQL map."""
    return f"str_to_map('{rules}', ' ', '>')"


def _keys(rules: str) -> str:
    return "|".join(rule.split(">")[0] for rule in rules.split())


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, '{by}')"


def _cut(text: str, ending: str) -> str:
    return f"substring({text}, 1, length({text}) - length({ending}))"


def _ending(pattern: str, body: str) -> str:
    """``body`` with ``s`` bound to the longest ending of ``w``, ``w`` itself when there is none."""
    return let_sql("s", f"regexp_extract(w, {quoted(f'(?:{pattern})$')}, 0)", f"if(s = '', w, {body})")


def _within(region: str, body: str) -> str:
    return f"if(length(w) - length(s) >= {region}, {body}, w)"


def _last_two(rules: str) -> str:
    """A cheap necessary condition for an ending: the word's last two letters."""
    return "substring(w, -2) IN (" + ", ".join(sorted({f"'{e[-2:]}'" for e in _keys(rules).split("|")})) + ")"


def _when(condition: str, expression: str) -> str:
    return f"if({condition}, {expression}, w)"


def _english() -> str:
    def steps(*expressions: str) -> str:
        """Each step sees the result of the one before as ``w``."""
        last = "w"
        for expression in reversed(expressions):
            last = let_sql("w", expression, last)
        return last

    plural = (
        "CASE WHEN w RLIKE 'sses$' THEN " + _cut("w", "'es'")
        + " WHEN w RLIKE '^..+ie[ds]$' THEN " + _cut("w", "'es'")
        + " WHEN w RLIKE '^.ie[ds]$' THEN " + _cut("w", "'s'")
        + f" WHEN w RLIKE '[us]s$' THEN w ELSE {_replace('w', f'({_VOWEL}.+)s$', '$1')} END"
    )
    mended = let_sql("b", _cut("w", "s"), (
        "CASE WHEN b RLIKE '(?:at|bl|iz)$' THEN concat(b, 'e') "
        "WHEN b RLIKE '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$' THEN " + _cut("b", "'b'")
        + f" WHEN r1 >= length(b) AND b RLIKE {quoted(_SHORT_END)} THEN concat(b, 'e') ELSE b END"))
    past = _ending("eedly|eed|ingly|edly|ing|ed", (
        f"if(startswith(s, 'ee'), {_within('r1', 'concat(' + _cut('w', 's') + ', ' + quoted('ee') + ')')}, "
        f"if({_cut('w', 's')} RLIKE '{_VOWEL}', {mended}, w))"))
    final_y = _replace("w", f"^(.+{_OTHER})[yY]$", "$1i")
    step2 = _ending(_keys(ENGLISH_STEP2), _within("r1", (
        "CASE WHEN s = 'ogi' AND NOT w RLIKE 'logi$' THEN w WHEN s = 'li' AND NOT w RLIKE '[cdeghkmnrt]li$' THEN w "
        f"ELSE concat({_cut('w', 's')}, {_pairs(ENGLISH_STEP2)}[s]) END")))
    step3 = _ending(_keys(ENGLISH_STEP3), _within(
        "if(s = 'ative', r2, r1)", f"concat({_cut('w', 's')}, {_pairs(ENGLISH_STEP3)}[s])"))
    step4 = _ending(_any(ENGLISH_STEP4), _within(
        "r2", f"if(s = 'ion' AND NOT w RLIKE '[st]ion$', w, {_cut('w', 's')})"))
    without_last = _cut("w", "'e'")
    step5 = (
        f"CASE WHEN endswith(w, 'e') AND (length(w) > r2 OR (length(w) > r1 AND NOT {without_last} RLIKE {quoted(_SHORT_END)})) "
        f"THEN {without_last} WHEN endswith(w, 'll') AND length(w) > r2 THEN {without_last} ELSE w END"
    )
    # Most words meet few of the rules; plain comparisons keep them from the patterns.
    plural = _when("endswith(w, 's') OR endswith(w, 'ied')", plural)
    past = _when("endswith(w, 'ed') OR endswith(w, 'ing') OR endswith(w, 'ly')", past)
    final_y = _when("endswith(w, 'y') OR endswith(w, 'Y')", final_y)
    step2 = _when(f"length(w) > r1 AND {_last_two(ENGLISH_STEP2)}", step2)
    step3 = _when(f"length(w) > r1 AND {_last_two(ENGLISH_STEP3)}", step3)
    step4 = _when(f"length(w) > r2 AND {_last_two(ENGLISH_STEP4)}", step4)
    rest = steps(past, final_y, step2, step3, step4, step5)
    body = let_sql("w", plural, f"if(w IN ({', '.join(repr(k) for k in ENGLISH_KEPT.split())}), w, {rest})")
    region2 = f"r1 + length(regexp_extract(substring(w, r1 + 1), {quoted(_TO_REGION)}, 0))"
    # A missing region starts at the end of the word.
    with_regions = let_sql(
        "r1", f"length(regexp_extract(w, {quoted('^(?:gener|commun|arsen)|' + _TO_REGION)}, 0))",
        let_sql("r1", "if(r1 = 0, length(w), r1)", let_sql(
            "r2", region2, let_sql("r2", "if(r2 = r1, length(w), r2)", body))))
    marked = _when("contains(w, 'y')", _replace(_replace("w", "^y", "Y"), f"({_VOWEL})y", "$1Y"))
    stemmed = f"replace({let_sql('w', marked, with_regions)}, 'Y', 'y')"
    return f"if(length(w) <= 2, w, coalesce({_pairs(ENGLISH_WHOLE)}[w], {stemmed}))"


def _russian() -> str:
    vowel, other = "[аеиоуыэюя]", "[^аеиоуыэюя]"

    def endings(after_a: str, alone: str) -> str:
        return f"(?:(?<=[ая])(?:{_any(after_a)})|(?:{_any(alone)}))"

    gerund = f"{endings(GERUND_1, GERUND_2)}$"
    adjectival = f"{endings(PARTICIPLE_1, PARTICIPLE_2)}?(?:{_any(ADJECTIVE)})$"
    verb = f"{endings(VERB_1, VERB_2)}$"

    def first_that_applies(text: str, patterns: list[str]) -> str:
        *some, last = patterns
        cases = " ".join(f"WHEN {text} RLIKE {quoted(p)} THEN {_replace(text, p)}" for p in some)
        return f"CASE {cases} ELSE {_replace(text, last)} END"

    main = f"if(v RLIKE {quoted(gerund)}, {_replace('v', gerund)}, " + let_sql(
        "v", _replace("v", f"(?:{_any(REFLEXIVE)})$"),
        first_that_applies("v", [adjectival, verb, f"(?:{_any(NOUN)})$"])) + ")"
    derived = let_sql(
        "d", f"regexp_extract(v, {quoted('ость?$')}, 0)",
        f"if(d <> '' AND length(h) + length(v) - length(d) >= r2, {_cut('v', 'd')}, v)")
    tidy = (
        f"CASE WHEN v RLIKE {quoted('ейше?$')} THEN {_replace(_replace('v', 'ейше?$'), 'нн$', 'н')} "
        f"WHEN v RLIKE {quoted('нн$')} THEN {_cut('v', quoted('н'))} ELSE {_replace('v', 'ь$')} END"
    )
    rest = let_sql("v", main, let_sql("v", _replace("v", "и$"), let_sql("v", derived, tidy)))
    # r2: after the second vowel group that a consonant closes.
    region2 = f"regexp_extract(w, {quoted(f'^{other}*{vowel}+{other}+{vowel}+{other}')}, 0)"
    body = let_sql("r2", f"length({region2})", let_sql(
        "r2", "if(r2 = 0, length(w), r2)", let_sql(
            "h", f"regexp_extract(w, {quoted(f'^{other}*{vowel}')}, 0)",
            f"if(h = '', w, concat(h, {let_sql('v', 'substring(w, length(h) + 1)', rest)}))")))
    return let_sql("w", "replace(w, 'ё', 'е')", body)


def common_start(lexeme: str) -> str:
    """A start that every word with this lexeme has, once ё is read as е.

    Only a final e, i, l or y of a lexeme can come from a rule that rewrites a letter; three lexemes change two.
    """
    return (f"CASE WHEN {lexeme} IN ('die', 'lie', 'tie') THEN substring({lexeme}, 1, 1) "
            f"WHEN substring({lexeme}, -1) IN ('e', 'i', 'l', 'y') THEN substring({lexeme}, 1, length({lexeme}) - 1) "
            f"ELSE {lexeme} END")


_ENGLISH, _RUSSIAN = _english(), _russian()


def stem_snowball(word: str) -> str:
    return let_sql("w", word, f"if({is_cyrillic_sql('w')}, {_RUSSIAN}, {_ENGLISH})")
