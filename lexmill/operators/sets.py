"""Set operations that keep the first of equal rows in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_keyword, is_url_like, is_valid_keyword, keyword_key
from .signals import first_rows

PAIR = ["source_url", "keyword"]


def first_pairs(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """The first row of each (source_url, keyword)."""
    return first_rows(rows, PAIR, [order])


def union_first(parts: list[DataFrame], order: str = "row_idx") -> DataFrame:
    """All parts one after the other, columns by name, missing ones null; the first row of each (source_url, keyword)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return first_rows(out, PAIR, ["_part", order]).drop("_part")


def append_absent(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows, and those of more whose (source_url, keyword) rows doesn't have."""
    return rows.unionByName(more.join(rows.select(*PAIR).distinct(), PAIR, "left_anti"), allowMissingColumns=True)


def across_sources(rows: DataFrame) -> DataFrame:
    """rows: source, source_pos, keyword, keyword_pos. Each keyword stays with the first source that has it."""
    return first_rows(rows, ["keyword"], ["source_pos", "keyword_pos"])


def distinct_in_order(rows: DataFrame, value: str, order: str, key: Column | None = None) -> DataFrame:
    """The first row of each trimmed, non-blank value; key: what counts as equal, e.g. lower case."""
    rows = rows.withColumn(value, F.trim(value)).filter(F.coalesce(F.col(value), F.lit("")) != "")
    return first_rows(rows.withColumn("_key", F.col(value) if key is None else key), ["_key"], [order]).drop("_key")


def processed_keywords(rows: DataFrame, order: str, least: int = 2, script: str = r"[Ѐ-ӿ]") -> DataFrame:
    """keyword cleaned, valid and the first of equals."""
    cleaned = rows.withColumn("keyword", clean_keyword("keyword"))
    return first_rows(cleaned.filter(is_valid_keyword(F.col("keyword"), least, script)), ["keyword"], [order])


def restricted(ads: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of ads whose normalised keyword is a seed's (keyword)."""
    keys = seeds.select(keyword_key("keyword").alias("_key")).distinct()
    return ads.withColumn("_key", keyword_key("keyword")).join(keys, "_key", "left_semi").drop("_key")


def related_first(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """Related items of one kind, rank, label (case-blind), value, topic type (case-blind) and keywords: the first."""
    keyed = rows.withColumn("_l", F.lower("label")).withColumn("_t", F.lower(F.coalesce("topic_type", F.lit("")))).withColumn("_s", F.array_join("source_keywords", "\x1f"))
    return first_rows(keyed, ["item_type", "rank_type", "_l", "value", "_t", "_s"], [order]).drop("_l", "_t", "_s")


def regions_first(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    return first_rows(rows.withColumn("_r", F.lower("region")), ["_r", "keyword", "value"], [order]).drop("_r")


def selection_signature(rows: DataFrame) -> DataFrame:
    """source_url and its sorted different keywords."""
    return rows.groupBy("source_url").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))


def page_of(rows: DataFrame, order: list, page: int, size: int = 10) -> DataFrame:
    """The first page * size rows in order (pages add up)."""
    return rows.orderBy(*order).limit(page * size)


def term_overlap(left: DataFrame, right: DataFrame, order: str = "row_idx") -> dict[str, DataFrame]:
    """left, right: term and order. By normalised term, with the first form of each: both, left_only and right_only (key and forms)."""
    key = lambda d, name: d.withColumn("key", keyword_key("term")).filter("key <> ''").groupBy("key").agg(F.min_by("term", order).alias(name))
    a, b = key(left, "left_term"), key(right, "right_term")
    return {"both": a.join(b, "key"), "left_only": a.join(b, "key", "left_anti"), "right_only": b.join(a, "key", "left_anti")}


def selected_pairs(selected: DataFrame, order: str = "row_idx") -> DataFrame:
    """selected: keyword, source_url and order. Trimmed pairs without blanks, the first of equals."""
    rows = selected.withColumn("keyword", F.trim("keyword")).withColumn("source_url", F.trim("source_url"))
    return first_pairs(rows.filter((F.coalesce("keyword", F.lit("")) != "") & (F.coalesce("source_url", F.lit("")) != "")), order)


def selection_context(selected: DataFrame, processed: DataFrame, order: str = "row_idx") -> dict[str, DataFrame]:
    """What a selection of (keyword, source_url) leads to: rows, processed with the pairs that it lacks (other columns null), and
    by_source, source_url with its keywords in the order selected and their number. An empty selection adds nothing."""
    pairs = selected_pairs(selected, order)
    lists = pairs.groupBy("source_url").agg(F.sort_array(F.collect_list(F.struct(order, "keyword"))).alias("l"))
    by_source = lists.select("source_url", F.transform("l", lambda x: x["keyword"]).alias("keywords"), F.size("l").alias("selected"))
    return {"rows": append_absent(processed, pairs.select(*PAIR)), "by_source": by_source}


def source_contexts(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """A run of results for each source: pairs (keyword, source_url), trimmed, without blank keywords and those that are URLs, each once,
    with the results (keyword, …) of their keyword; source_context_key is keyword and source URL. A blank source is a context too."""
    clean = pairs.select(F.trim("keyword").alias("keyword"), F.trim(F.coalesce("source_url", F.lit(""))).alias("source_url"))
    clean = clean.filter((F.coalesce("keyword", F.lit("")) != "") & ~is_url_like(F.col("keyword"))).distinct()
    return clean.withColumn("source_context_key", F.concat_ws("||", "keyword", "source_url")).join(results, "keyword")
