"""Words of a text: splitting, stop words and stems, routed by script."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentspark.functions.binding import quoted

WORD = r"([\p{L}\p{N}]+)"

# English stop words.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()

# Russian stop words.
RUSSIAN_STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от "
    "меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам "
    "ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего "
    "раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем "
    "чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через "
    "эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том "
    "нельзя такой им более всегда конечно всю между"
).split()

STOP_WORDS = ENGLISH_STOP_WORDS + RUSSIAN_STOP_WORDS

# Endings the light stemmer takes off, longest first, leaving at least three letters.
LIGHT_ENGLISH = "ing ed ly es s e".split()
LIGHT_RUSSIAN = (
    r"^(.{3,}?)(?:иями|ями|ами|ого|его|ому|ему|ыми|ими|ия|ие|ии|ий|ой|ый|ая|яя|ое|ее|ые|ую|юю|ов|ев|ах|ях|ам|ям|"
    r"ом|ем|а|я|ы|и|у|ю|е|о|ь)$"
)
LIGHT_MIN_STEM = 3

# A stemmer maps the SQL text of a word to the SQL text of its lexeme.
Stemmer = Callable[[str], str]


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), {quoted(WORD)}, 1)"


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def is_stop_word_sql(word: str) -> str:
    return f"{word} IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def is_cyrillic_sql(word: str) -> str:
    """Whether a word starts in the Cyrillic block; plain byte comparisons."""
    return f"({word} >= '\\u0400' AND {word} < '\\u0530')"


def stem_none(word: str) -> str:
    return word


def stem_light(word: str) -> str:
    # Few branches on purpose: a longer chain makes the generated method too big to be compiled.
    english = "".join(
        f" WHEN endswith({word}, '{e}') AND length({word}) >= {LIGHT_MIN_STEM + len(e)}"
        f" THEN substring({word}, 1, length({word}) - {len(e)})" for e in LIGHT_ENGLISH)
    return (
        f"CASE WHEN {is_cyrillic_sql(word)} THEN regexp_replace({word}, {quoted(LIGHT_RUSSIAN)}, '$1')"
        f" WHEN length({word}) <= {LIGHT_MIN_STEM} THEN {word}{english} ELSE {word} END"
    )


def stemmer(name: str) -> Stemmer:
    """``none``, ``light`` (one ending off) or ``snowball`` (the full suffix rules)."""
    from contentspark.functions.stem import stem_snowball

    return {"none": stem_none, "light": stem_light, "snowball": stem_snowball}[name]
