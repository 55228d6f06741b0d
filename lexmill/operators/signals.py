"""Signals of pages and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_terms, collapsed, signal_terms, signal_tokens
from .corpus import runs

LISTS, TABLES = r"(?i)<(ul|ol|li|list)", r"(?i)<table"
CITATION, LINK = r"(?i)\[(\d+|[a-z]{1,3})\]", r"(?i)https?://[^\s]+"
MEDIA = r"(?i)<(img|video|iframe|audio)"
DEFINITION = r"(?iU)\b(is|are|это|означает|means|defined)\b"
COMMERCIAL = r"(?i)(buy|price|cheap|order|service|quote|demo|trial|contact|купить|цена|заказать|услуга|замовити|ціна)"


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def page_text_signals(pages: DataFrame, top: int = 50) -> DataFrame:
    """pages: page_id, title, meta_description, h1, intro_text, body; null is empty. Adds word_count (different words), the
    counts of list, table, citation and media marks in the body, has_answer_first, and top_terms (array of term, count)."""
    p = pages.select("page_id", *(collapsed(c).alias(c) for c in ("title", "meta_description", "h1", "intro_text", "body")))
    everything = F.concat_ws(" ", "title", "meta_description", "h1", "intro_text", "body")
    counted = p.select("page_id", F.explode(F.array(signal_tokens(everything))).alias("tokens"))
    lead = F.when(F.col("intro_text") != "", F.col("intro_text")).otherwise(F.substring("body", 1, 500))
    terms = runs(counted, F.col("tokens")).groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term", F.col("n").alias("count")))), 1, top).alias("t"), F.count(F.lit(1)).alias("word_count"))
    terms = terms.select("page_id", F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["count"].alias("count"))).alias("top_terms"), "word_count")
    out = p.withColumns({"list_count": F.regexp_count("body", F.lit(LISTS)), "table_count": F.regexp_count("body", F.lit(TABLES)), "citation_count": F.regexp_count("body", F.lit(CITATION)) + F.regexp_count("body", F.lit(LINK)), "media_count": F.regexp_count("body", F.lit(MEDIA)), "has_answer_first": lead.rlike(DEFINITION) | lead.rlike(r"(?i)<table|<ul|<ol|<li")})
    out = out.join(terms, "page_id", "left").withColumn("word_count", F.coalesce("word_count", F.lit(0)))
    return out.withColumn("intro_text", F.substring("intro_text", 1, 320)).withColumn("body", F.substring("body", 1, 1000))


def title_alignment(pages: DataFrame) -> DataFrame:
    """pages: page_id, title, h1, intro_text. title_h1_overlap, title_intro_overlap (Jaccard), duplicate_title_risk (other titles of
    the same first ten sorted words, as a share of all rows), title_alignment_score (mean) and title_rewrite_risk (not rounded).
    A title without words has risk 1 and zeros."""
    rows = pages.select("page_id", signal_terms("title").alias("t"), signal_terms("h1").alias("h"), signal_terms("intro_text").alias("i"))
    rows = rows.withColumn("signature", F.array_join(F.slice(F.array_sort("t"), 1, 10), " "))
    same = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("same")).filter("same > 1")
    rows = rows.join(same, "signature", "left").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("N"))))
    some = F.size("t") > 0
    of = lambda x: F.when(some, x).otherwise(0.0)
    rows = rows.withColumn("title_h1_overlap", of(jaccard(F.col("t"), F.col("h")))).withColumn("title_intro_overlap", of(jaccard(F.col("t"), F.col("i"))))
    rows = rows.withColumn("duplicate_title_risk", of(F.coalesce((F.col("same") - 1) / F.col("N"), F.lit(0.0)))).withColumn("title_alignment_score", (F.col("title_h1_overlap") + F.col("title_intro_overlap")) / 2)
    risk = F.when(some, F.least(F.lit(1.0), 0.6 * (1 - F.col("title_alignment_score")) + 0.4 * F.col("duplicate_title_risk"))).otherwise(1.0)
    return rows.select("page_id", "title_h1_overlap", "title_intro_overlap", "duplicate_title_risk", "title_alignment_score", risk.alias("title_rewrite_risk"))


def content_effort(signals: DataFrame) -> DataFrame:
    """Adds length_score, structure_score, citations_score, media_score, answer_score, effort_score and effort_level."""
    part = lambda x, most: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / most))
    rows = signals.withColumns({"length_score": part(F.coalesce("word_count", F.lit(0)), 900.0), "structure_score": part(F.col("list_count") + F.col("table_count"), 4.0), "citations_score": part(F.col("citation_count"), 6.0), "media_score": part(F.col("media_count"), 4.0), "answer_score": F.when(F.col("has_answer_first"), 1.0).otherwise(0.0)})
    rows = rows.withColumn("effort_score", 0.35 * F.col("length_score") + 0.20 * F.col("structure_score") + 0.20 * F.col("citations_score") + 0.15 * F.col("media_score") + 0.10 * F.col("answer_score"))
    return rows.withColumn("effort_level", F.when(F.col("effort_score") >= 0.7, "high").when(F.col("effort_score") >= 0.4, "medium").otherwise("low"))


def centroid_terms(pages: DataFrame, top: int = 60) -> DataFrame:
    """term, count (pages that have it) of the most common terms; ties go to the first by name."""
    return pages.select(F.explode(signal_terms(F.concat_ws(" ", "title", "body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(top)


def page_overlaps(pages: DataFrame, top: int = 60) -> DataFrame:
    """page_id, overlap (share of the page's terms that are centroid terms) of pages with terms. The centroid, top rows, is broadcast."""
    centre = centroid_terms(pages, top).agg(F.collect_list("term").alias("centre"))
    rows = pages.select("page_id", signal_terms(F.concat_ws(" ", "title", "body")).alias("t")).filter(F.size("t") > 0).crossJoin(F.broadcast(centre))
    return rows.select("page_id", (F.size(F.array_intersect("t", "centre")) / F.size("t")).alias("overlap"))


def topical_overlap(pages: DataFrame, top: int = 60, threshold: float = 0.15) -> DataFrame:
    """One row: page_count, off_topic_ratio, mean_topical_overlap, site_focus_score; zeros without pages."""
    out = page_overlaps(pages, top).agg(F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("overlap") < threshold).alias("off"), F.avg("overlap").alias("mean"))
    ratio = F.when(F.col("page_count") > 0, F.col("off") / F.col("page_count")).otherwise(0.0)
    return out.select("page_count", ratio.alias("off_topic_ratio"), F.coalesce("mean", F.lit(0.0)).alias("mean_topical_overlap"), F.when(F.col("page_count") > 0, 1 - ratio).otherwise(0.0).alias("site_focus_score"))


def simhash64(texts: DataFrame, key: str = "doc_id", top: int = 256) -> DataFrame:
    """key, simhash64_hex (16 digits), simhash64 (the bits as a signed long) and term_count.

    Terms weigh ln(1 + count); the top of them by count, then name, vote with the first 64 bits of their md5. Weights are
    counted in billionths, so that a sum doesn't depend on its order and a tie leaves the bit unset. All is done in the row: each of the 64 votes is summed over the row's terms, no row is exploded.
    """
    rows = texts.select(key, F.explode(F.array(F.array_sort(signal_tokens("text")))).alias("_sorted"))
    starts = F.when(F.size("_sorted") > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size("_sorted") - 1, F.lit(0))), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", starts)
    ranked = F.array_sort(F.transform("_starts", lambda i, k: F.struct((i - F.coalesce(F.get("_starts", k + 1), F.size("_sorted"))).alias("o"), F.get("_sorted", i).alias("term"))))
    rows = rows.select(key, F.slice(ranked, 1, top).alias("terms"))
    halves = lambda t, a: F.conv(F.substring(F.md5(t), a, 8), 16, 10).cast("long")
    rows = rows.select(key, F.transform("terms", lambda x: F.struct(F.round(F.log1p(-x["o"]) * 1e9).cast("long").alias("w"), halves(x["term"], 1).alias("hi"), halves(x["term"], 9).alias("lo"))).alias("terms"))
    vote = lambda half, bit: F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + F.when(F.getbit(x[half], F.lit(bit)) == 1, x["w"]).otherwise(-x["w"])) > 0
    word = lambda half: sum((F.when(vote(half, b), F.lit(1 << b)).otherwise(0) for b in range(1, 32)), F.when(vote(half, 0), F.lit(1)).otherwise(0)).cast("long")
    rows = rows.select(key, F.size("terms").alias("term_count"), word("hi").alias("hi"), word("lo").alias("lo"))
    return rows.select(key, F.lower(F.concat(F.lpad(F.hex("hi"), 8, "0"), F.lpad(F.hex("lo"), 8, "0"))).alias("simhash64_hex"), F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("simhash64"), "term_count")


def anchor_summary(links: DataFrame, page_terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """links: anchor_text, url; page_terms: url, terms (array). Tables: totals (total_links, unique_anchors, mismatched), top_anchors (20),
    mismatch_targets (urls with three or more links whose anchor shares less than a fifth of its words; 30) and
    overused_commercial_anchors (at least 8 and 8 % of the links; 10). Blank anchors and urls are left out."""
    rows = links.select(F.lower(collapsed("anchor_text")).alias("anchor"), collapsed("url").alias("url")).filter("anchor <> '' and url <> ''")
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("count"))
    total = anchors.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_links"), F.count(F.lit(1)).alias("unique_anchors"))
    words = rows.withColumn("a", anchor_terms("anchor")).filter(F.size("a") > 0)
    words = words.withColumn("terms", F.array().cast("array<string>")) if page_terms is None else words.join(page_terms.groupBy("url").agg(F.max("terms").alias("terms")), "url", "left")
    apart = F.size(F.array_intersect("a", F.coalesce("terms", F.array().cast("array<string>")))) / F.size("a") < 0.2
    bad = words.filter(apart).groupBy("url").agg(F.count(F.lit(1)).alias("count")).filter("count >= 3")
    often = F.greatest(F.lit(8), F.floor(0.08 * F.greatest("total_links", F.lit(1))))
    return {
        "totals": total.crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("mismatched")))),
        "top_anchors": anchors.orderBy(F.desc("count"), "anchor").limit(20),
        "mismatch_targets": bad.orderBy(F.desc("count"), "url").limit(30),
        "overused_commercial_anchors": anchors.crossJoin(F.broadcast(total)).filter(F.col("anchor").rlike(COMMERCIAL) & (F.col("count") >= often)).orderBy(F.desc("count"), "anchor").select("anchor", "count").limit(10),
    }


def near_duplicates(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints that several rows have: simhash64_hex, n, first (least key). Equal fingerprints are to be confirmed by terms."""
    return prints.groupBy("simhash64_hex").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def first_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
