"""Pages: headings, links, metadata and main text, by regular expressions in the JVM.

Libraries for main-content extraction decide otherwise in places; exact agreement with one of them is not claimed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalized

#: Named character references that are written out besides numeric ones. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&"}
#: Phrases of pages that block a visitor instead of answering. Fixed values.
BLOCKED = r"(?i)(captcha|unusual traffic|access denied|verify you are (a )?human|enable javascript and cookies|are you a robot|429 too many requests|consent\.google)"


def unescaped(text: Column) -> Column:
    for name, c in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def inner_text(markup: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " ")))


def _first_wins(texts: Column) -> Column:
    """Texts that aren't blank, without those that an earlier one equals in lower case."""
    low = F.transform(texts, F.lower)
    pairs = F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.transform(F.filter(pairs, lambda p: (p["t"] != "") & (F.array_position(low, F.lower(p["t"])) == p["i"] + 1)), lambda p: p["t"])


def headings(html: Column) -> Column:
    return _first_wins(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), inner_text))


def links(html: Column, base: Column) -> Column:
    """Normalised targets of links, each once, without anchors, mail, phone and script links."""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s+[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda h: F.trim(unescaped(h)))
    kept = F.filter(found, lambda h: (h != "") & ~h.rlike("^(#|mailto:|tel:|javascript:)"))
    return F.array_distinct(F.filter(F.transform(kept, lambda h: normalized(h, base)), lambda u: u != ""))


def meta(html: Column, name: str) -> Column:
    return unescaped(F.regexp_extract(F.coalesce(html, F.lit("")), rf"""(?is)<meta\s+(?:name|property)\s*=\s*["']{name}["']\s+content\s*=\s*["']([^"']*)["']""", 1))


def main_text(html: Column) -> Column:
    """The article or main element, else the body, without scripts, navigation and other furniture, as lines of text."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1>|<!--.*?-->", " ")
    body = F.coalesce(*(F.nullif(F.regexp_extract(h, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("article", "main", "body")), h)
    lines = F.split(F.regexp_replace(body, r"(?i)</?(p|div|br|li|h[1-6]|tr|section)\b[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, inner_text), lambda x: x != ""), "\n")


def is_blocked(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(BLOCKED)


def scraped(pages: DataFrame, least: int = 50) -> DataFrame:
    """pages: url, html. title, meta_description, meta_keywords, headings, body, text (what a model is shown) and success: false for blocked pages
    and those with less than least characters and no metadata."""
    rows = pages.withColumn("title", inner_text(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))).withColumn("meta_description", meta(F.col("html"), "description")).withColumn("meta_keywords", F.filter(F.transform(F.split(meta(F.col("html"), "keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")).withColumn("headings", headings(F.col("html"))).withColumn("body", main_text(F.col("html")))
    line = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), c))
    rows = rows.withColumn("text", F.concat_ws("\n\n", line("Meta title", "title"), line("Meta description", "meta_description"), F.when(F.col("body") != "", F.concat(F.lit("Page content:\n"), "body"))))
    return rows.withColumn("success", ~is_blocked(F.col("body")) & ((F.length("body") >= least) | (F.col("title") != "") | (F.col("meta_description") != "")))


def rendered_results(pages: DataFrame) -> DataFrame:
    """pages: keyword, html of a rendered result page. Titles (h3 of 5 to 300 characters) inside links: keyword, position, title, url, each URL once."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)(<a\s[^>]*href="https?://[^"]+"[^>]*>(?:(?!</a>).)*?<h3[^>]*>.*?</h3>)"""), F.lit(1))
    rows = pages.select("keyword", F.posexplode(found).alias("i", "block"))
    rows = rows.select("keyword", "i", inner_text(F.regexp_extract("block", r"(?is)<h3[^>]*>(.*?)</h3>", 1)).alias("title"), unescaped(F.regexp_extract("block", r'(?i)href="([^"]+)"', 1)).alias("url")).filter(F.length("title").between(5, 300))
    first = rows.groupBy("keyword", "url").agg(F.min(F.struct("i", "title")).alias("f"))
    return first.groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("f.i", "f.title", "url"))).alias("l")).select("keyword", F.posexplode("l").alias("p", "x")).select("keyword", (F.col("p") + 1).alias("position"), "x.title", "x.url")


def offer(text: Column) -> Column:
    """price, rating and stock mentioned in a snippet."""
    grab = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(grab(r"(?i)((?:[$€£₴]\s?\d[\d\s.,]*)|(?:\d[\d\s.,]*\s?(?:грн|руб|usd|eur|uah|₴|€|\$)))").alias("price"), grab(r"(?i)(?:rating|рейтинг)[:\s]*([0-5](?:[.,]\d)?)").alias("rating"), grab(r"(?i)(in stock|out of stock|в наличии|нет в наличии|в наявності|немає в наявності)").alias("stock"))
