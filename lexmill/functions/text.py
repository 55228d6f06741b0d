"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own. Russian, Ukrainian, English.
STOPWORDS = tuple(dict.fromkeys("""
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему
теперь когда ничего ей при можно хоть были вы вас нас могу который это этого этом для или чтобы под
і в во не що він на я з со як а то все вона так його але да ти к у же ви за були по тільки її мені було ось від мене ще немає о з
йому тепер коли нічого їй при можна хоча були вас нас можу який це цього цьому для аби
the a an and or but in on at to for of with by from up about into over after is it this that be are was were have has had do does
did can could will would should may might must shall you your we they them their our us i me my he she him her his its who which
what when where why how all each every both few more most other some such no nor not only own same so than too very
""".split()))  # fmt: skip
#: Weak phrases of generated text. Fixed values.
FORBIDDEN_PHRASES = (
    "click here", "learn more", "read more", "find out more", "нажмите здесь", "узнайте больше", "читать далее", "подробнее", "натисніть тут", "дізнайтеся більше", "читати далі",
)
TAG = "<[^>]+>"
WORD = "[a-zа-яіїєґё0-9]+(?:-[a-zа-яіїєґё0-9]+)*"
SIGNAL_WORD = "[a-zа-яёіїєґ0-9]{2,}"
ANCHOR_WORD = "[a-zа-я0-9]{2,}"
WIDE_WORD = r"[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(text: Column | str, stopwords: Sequence[str] = STOPWORDS, word: str = WORD) -> Column:
    """Lower-case words of a text without tags and stopwords, in order; hyphens join. Accented Latin letters part words
    unless word is WIDE_WORD. Null gives an empty array."""
    out = F.regexp_extract_all(F.lower(F.regexp_replace(_text(text), TAG, " ")), F.lit(f"({word})"), F.lit(0))
    return F.filter(out, lambda t: ~t.isin(*stopwords)) if stopwords else out


#: Endings that are taken off words of more than four letters, the first that fits. Fixed values.
SUFFIXES = ("ий", "ия", "ое", "ый", "ая", "ой", "ем", "их", "ых", "ому", "ему", "ого", "его", "ому", "ими", "ами", "сть", "ность", "тель")


def without_suffix(word: Column) -> Column:
    """A word of more than four letters without the first of SUFFIXES, in their order, that it ends with."""
    cut = F.coalesce(*(F.when(F.endswith(word, F.lit(s)), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in dict.fromkeys(SUFFIXES)), word)
    return F.when(F.length(word) > 4, cut).otherwise(word)


def stripped(words: Column) -> Column:
    """tokens() without their suffixes."""
    return F.transform(words, without_suffix)


def signal_tokens(text: Column | str) -> Column:
    """Words of two or more letters or digits, repeats included; no stopwords, hyphens part."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(f"({SIGNAL_WORD})"), F.lit(0))


def signal_terms(text: Column | str) -> Column:
    return F.array_distinct(signal_tokens(text))


def anchor_terms(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(f"({ANCHOR_WORD})"), F.lit(0)))


def collapsed(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(text), r"(?U)\s+", " "))


def keyword_key(keyword: Column | str) -> Column:
    """What keywords are joined on: lower case, trimmed, without double and then single quotes around it."""
    bare = F.trim(F.lower(_text(keyword)))
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}+|{quote}+$", "")
    return F.trim(bare)


def clean_keyword(keyword: Column | str) -> Column:
    """Only word characters, spaces and hyphens; single spaces; lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_text(keyword), r"(?U)[^\w\s-]", ""), r"(?U)\s+", " ")))


def is_valid_keyword(keyword: Column, least: int = 2, script: str = r"[Ѐ-ӿ]") -> Column:
    """Long enough and with a letter of the wanted script."""
    return (F.length(F.trim(keyword)) >= least) & keyword.rlike(script)


def is_url_like(query: Column | str) -> Column:
    q = F.trim(_text(query))
    return q.rlike(r"(?i)^(https?://|www\.)") | q.rlike(r"^[a-zA-Z0-9-]+\.[a-zA-Z]{2,}")


def density(words: Column, keyword: Column | str) -> Column:
    """Percent of words that are keyword; several words never are."""
    key = F.lower(_text(keyword) if isinstance(keyword, Column) else F.lit(keyword))
    return F.when(F.size(words) > 0, 100.0 * F.size(F.filter(words, lambda t: t == key)) / F.size(words)).otherwise(0.0)


def contains(text: Column, needle: Column) -> Column:
    """Case-blind substring; false if either is empty."""
    return (F.length(needle) > 0) & F.contains(F.lower(_text(text)), F.lower(needle))


def contains_words(text: Column, needle: Column) -> Column:
    """Words of needle in a row among the words of text; needles of stopwords alone are looked for as substrings."""
    wanted = F.array_join(tokens(needle), " ")
    found = F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.concat(F.lit(" "), wanted, F.lit(" ")))
    return (F.length(_text(text)) > 0) & (F.length(_text(needle)) > 0) & F.when(wanted == "", contains(text, needle)).otherwise(found)


def forbidden_phrases(text: Column) -> Column:
    low = F.lower(_text(text))
    return F.filter(F.array(*map(F.lit, FORBIDDEN_PHRASES)), lambda p: F.contains(low, p))


def without_thinking(text: Column) -> Column:
    """A model's answer without its <think> and <thinking> blocks."""
    return F.trim(F.regexp_replace(_text(text), r"(?is)<(think|thinking)>.*?</\1>", ""))


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_text(text), TAG, " "), r"\s+", " "))


def cut_at_space(text: Column, most: int) -> Column:
    """At most most characters, ending before a space if one is there."""
    head = F.substring(_text(text), 1, most)
    short = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(_text(text)) <= most, _text(text)).when(short == "", head).otherwise(short)


def filled_prompt(template: Column, values: dict[str, Column], most_chars: int = 5000, most_keywords: int = 20) -> Column:
    """Put values in the places {name} of a template. content is cut at a space, keywords (an array) after most_keywords."""
    out = template
    for name, v in values.items():
        v = cut_at_space(v, most_chars) if name == "content" else F.array_join(F.slice(v, 1, most_keywords), ", ") if name == "keywords" else _text(v)
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def selection_key(keyword: Column, source_url: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}::kw_"), F.substring(F.sha2(F.concat(F.lower(_text(keyword)), F.lit("||"), F.lower(_text(source_url))), 256), 1, 8))


def half_even_int(value: Column) -> Column:
    """A number in text as an integer, halves to even; null if there is none."""
    return F.bround(F.regexp_replace(F.trim(value), ",", "").try_cast("double"), 0).try_cast("long")


def rich_snippet(snippet: Column, first: Sequence[str] = ("price", "rating", "reviews", "availability")) -> Column:
    """A map of texts as "Key: value, ...", the first keys ahead, five at most, blank values left out."""
    entries = F.filter(F.map_entries(snippet), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    rank = F.transform(entries, lambda e: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), e["key"]), F.lit(0)), F.lit(len(first) + 1)).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    shown = F.transform(F.slice(F.array_sort(rank), 1, 5), lambda e: F.concat(F.initcap(F.replace(e["k"], F.lit("_"), F.lit(" "))), F.lit(": "), e["v"]))
    return F.array_join(shown, ", ")


def redacted(params: Column, secret: str = r"(?i)(api.?key|token|secret|password|authorization|cookie)") -> Column:
    """A map without the entries whose key names a secret."""
    return F.map_filter(params, lambda k, v: ~k.rlike(secret))
