"""Search intent of a corpus, by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

CATEGORIES = ("informational", "commercial", "transactional", "navigational")
#: Words that show an intent: strong ones, their weight, other ones, their weight. Fixed values.
WORDS = {
    "informational": ("how what why guide tutorial faq", 1.15, "wiki explain definition meaning examples overview introduction basics beginner advanced questions answers choose choosing review comparison compare vs versus", 0.85),
    "commercial": ("best top price pricing cost catalog product products", 1.15, "shop store availability offer offers deal deals", 0.95),
    "transactional": ("buy order checkout cart pay payment", 1.2, "delivery shipping discount sale coupon purchase subscribe subscription reserve book", 1.0),
    "navigational": ("official login account portal dashboard", 1.35, "site log signin sign profile", 0.9),
}
#: Beginnings of Cyrillic words that show an intent, and their weight. Fixed values.
STEMS = {
    "informational": ("как что обзор сравнен инструкц совет выбира выбор рейтинг топ лучши полезн стат почему зачем які що огляд порівня інструкц порад вибира вибір рейтинг кращ корисн статт чому навіщо", 0.95),
    "commercial": ("цен стоим дешев каталог товар продукт магазин предложен опт прайс цін варт пропозиц роздріб ціна вартіст", 0.9),
    "transactional": ("куп заказ оплат достав скидк корзин промокод акци распрод покуп купув замов знижк кошик акці розпрод бронь", 1.05),
    "navigational": ("офиц главн домашн вход аккаунт личн кабинет портал админ офіцій головн увій акаунт кабінет", 1.2),
}
#: Parts of URLs. Fixed values.
URL_TRANSACTIONAL = "buy order checkout cart pay payment shipping delivery discount sale coupon".split()
URL_COMMERCIAL = "price pricing catalog product shop store".split()
URL_NAVIGATIONAL = "login account home homepage official signin portal dashboard profile site".split()
CYRILLIC = "[а-яіїєґ]"
SIGNAL = "struct<category:string,signal:string,weight:double>"


def field_multiplier(field: Column) -> Column:
    f = F.lower(field)
    has = lambda x: F.contains(f, F.lit(x))
    return F.when(f.isin("title", "serp_title", "page_title", "h1"), 1.4).when(has("title") | (f == "headline"), 1.25).when(has("snippet") | has("description"), 1.0).when(f.isin("related_searches", "related_search", "people_also_ask", "paa"), 0.6).when(f == "displayed_link", 0.85).otherwise(0.9)


def _signal(category: str, name: Column | str, weight: Column | float) -> Column:
    return F.struct(F.lit(category).alias("category"), (F.lit(name) if isinstance(name, str) else name).alias("signal"), (F.lit(weight) if isinstance(weight, float) else weight).alias("weight"))


def _rules(category: str) -> Column:
    strong, a, other, b = WORDS[category]
    return F.array(*(F.struct(F.lit(w).alias("word"), F.lit(weight).alias("weight")) for words, weight in ((strong, a), (other, b)) for w in words.split()))


def _url_signals(raw: Column, field: Column) -> Column:
    """Of a displayed link or text with a URL in it: shop words make it transactional or commercial, others navigational."""
    has = lambda w: F.contains(raw, F.lit(w))
    some = lambda words: F.greatest(*(has(w) for w in words))
    here = (F.lower(field) == "displayed_link") | raw.rlike(r"https?://|www\.|\.[a-z]{2,}(/|$)")
    none = F.expr(f"cast(array() as array<{SIGNAL}>)")
    buying, shop = some(URL_TRANSACTIONAL), some(URL_COMMERCIAL)
    found = lambda words, category, weight: F.filter(F.array(*(F.when(has(w), _signal(category, f"url:{w}", weight)) for w in words)), F.isnotnull)
    nav = F.when(has("login") | has("account"), F.array(_signal("navigational", "nav:login", 1.7), _signal("navigational", "nav:account", 1.5))).when(has("home"), F.array(_signal("navigational", "nav:homepage", 1.5))).when(has("official") | has("site"), F.array(_signal("navigational", "nav:official", 1.4))).otherwise(none)
    nav = F.concat(nav, F.array(_signal("navigational", "nav:domain", 1.2)))
    return F.when(~here, none).when(buying, found(URL_TRANSACTIONAL, "transactional", 1.6)).when(shop, found(URL_COMMERCIAL, "commercial", 1.3)).when(some(URL_NAVIGATIONAL), nav).otherwise(none)


def source_signals(corpus: DataFrame) -> DataFrame:
    """source_idx, weight (of source and field) and signals: array of category, signal, weight.

    Of Cyrillic stems that a word begins with the longest counts, then the first by name."""
    raw = corpus.select("source_idx", "field", F.col("weight").cast("double").alias("weight"), F.lower(F.coalesce("text", F.lit(""))).alias("raw"), tokens("text").alias("tokens"))
    words = F.array_distinct("tokens")
    parts = [_url_signals(F.col("raw"), F.col("field"))]
    for c in CATEGORIES:
        prefix = F.lit("nav:" if c == "navigational" else "")
        parts.append(_exact(c, prefix))
        parts.append(_stemmed(c, prefix, words))
    return raw.select("source_idx", (F.col("weight") * field_multiplier(F.col("field"))).alias("weight"), F.concat(*parts).alias("signals"))


def _exact(category: str, prefix: Column) -> Column:
    return F.transform(F.filter(_rules(category), lambda r: F.array_contains("tokens", r["word"])), lambda r: _signal(category, F.concat(prefix, r["word"]), r["weight"]))


def _stemmed(category: str, prefix: Column, words: Column) -> Column:
    stems, weight = STEMS[category]
    ordered = F.array(*map(F.lit, sorted(set(stems.split()), key=lambda s: (-len(s), s))))
    best = F.transform(F.filter(words, lambda t: t.rlike(CYRILLIC)), lambda t: F.get(F.filter(ordered, lambda s: F.startswith(t, s)), 0))
    return F.transform(F.filter(best, F.isnotnull), lambda s: _signal(category, F.concat(prefix, s), weight))


def category_scores(corpus: DataFrame) -> DataFrame:
    """category, score, sources and signals (sorted) of the categories that a corpus shows."""
    rows = source_signals(corpus).select("source_idx", F.col("weight").alias("w"), F.inline("signals"))
    return rows.groupBy("category").agg(F.sum(F.col("w") * F.col("weight")).alias("score"), F.countDistinct("source_idx").alias("sources"), F.sort_array(F.collect_set("signal")).alias("signals"))


def intent(corpus: DataFrame) -> DataFrame:
    """One row: intent_type, score, confidence (neither rounded) and signals (sorted).

    confidence = .55 * share of sources with a signal + .25 * share of the top category + .20 * different signals / (4 * sources), 1 at
    most. Too little score is undetermined, a close second category mixed; ties go to the category named first.
    """
    # One pass: sources without a signal come along as one row, the first signal of a source counts it.
    flat = source_signals(corpus).select(F.col("weight").alias("w"), F.posexplode_outer("signals").alias("pos", "s")).select("w", "pos", "s.*")
    score = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("w") * F.col("weight"))), F.lit(0.0))
    # The different signals are at most as many as there are rules.
    sums = flat.agg(*(score(c).alias(c) for c in CATEGORIES), F.sort_array(F.collect_set("signal")).alias("signals"), F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("N"), F.count_if(F.col("pos") == 0).alias("matched"))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CATEGORIES))))
    sums = sums.withColumn("r", ranked).withColumn("top", -F.col("r")[0]["s"]).withColumn("second", -F.col("r")[1]["s"]).withColumn("all", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])))
    confidence = F.least(F.lit(1.0), 0.55 * F.col("matched") / F.col("N") + 0.25 * F.col("top") / F.col("all") + 0.20 * F.size("signals") / (4 * F.col("N")))
    low = (F.col("top") < 0.8) & (F.col("all") < 1.2)
    close = (F.col("second") > 0) & (F.col("top") - F.col("second") <= F.greatest(F.lit(0.45), 0.18 * F.col("top")))
    some = F.col("all") > 0
    return sums.select(F.when(~some | low, "undetermined").when(close, "mixed").otherwise(F.col("r")[0]["c"]).alias("intent_type"), F.when(~some | low, 0.0).otherwise(F.col("top")).alias("score"), F.when(some, confidence).otherwise(0.0).alias("confidence"), "signals")
