"""Statistics of a text corpus.

A corpus has source_idx, text, field, weight; a document is one source. token_table() adds the words once, and every
statistic is derived from that. Counts of a word inside a source are made inside its row (sorted words, run lengths), so each
statistic needs one shuffle on the word, with partial sums before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokens
from ..session import checkpointed

#: Weights and length normalisation of fields. Fixed values.
FIELD_WEIGHTS = {"serp_title": 3.0, "page_title": 3.0, "h1": 2.5, "meta_description": 1.5, "serp_snippet": 1.5, "related_searches": 1.2, "people_also_ask": 1.1, "trends_related": 1.2, "body_text": 1.0, "anchor_text": 1.4}
TITLE_B, SNIPPET_B, BODY_B = 0.5, 0.6, 0.75


def token_table(corpus: DataFrame, words: Column | None = None) -> DataFrame:
    """source_idx, field, weight, tokens and n_tokens of each source; null fields are "", null weights 1. words: another tokenizer's array."""
    # The one-element generator keeps the optimizer from copying the tokenizer into filters and lambdas further on.
    out = corpus.select("source_idx", F.coalesce("field", F.lit("")).alias("field"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), F.explode(F.array(tokens("text") if words is None else words)).alias("tokens"))
    return out.withColumn("n_tokens", F.size("tokens"))


def with_lemmas(table: DataFrame, lemmas: DataFrame, most: int = 1_000_000, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """A token table with each word in its dictionary form (lemmas: word, lemma; words that aren't in it stay), then without stopwords.

    A dictionary of most rows at most goes to the rows as one map; a larger one is joined word by word."""
    lemmas = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    if lemmas.limit(most + 1).count() <= most:
        entries = lemmas.agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_forms"))
        out = table.crossJoin(F.broadcast(entries)).withColumn("tokens", F.transform("tokens", lambda t: F.coalesce(F.try_element_at("_forms", t), t))).drop("_forms")
    else:
        words = table.select("source_idx", F.posexplode("tokens").alias("_i", "word")).join(lemmas, "word", "left")
        whole = words.groupBy("source_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("lemma", "word").alias("w")))), lambda x: x["w"]).alias("_tokens"))
        out = table.join(whole, "source_idx", "left").withColumn("tokens", F.coalesce("_tokens", "tokens")).drop("_tokens")
    kept = F.filter("tokens", lambda t: ~t.isin(*stopwords)) if stopwords else F.col("tokens")
    return out.withColumn("tokens", F.explode(F.array(kept))).withColumn("n_tokens", F.size("tokens"))


def runs(rows: DataFrame, words: Column, name: str = "term") -> DataFrame:
    """One row for each different entry of words in a row: the entry as name, and how often it is there as n."""
    keep = [c for c in rows.columns if c not in ("tokens", name, "n")]
    rows = rows.select(*keep, F.explode(F.array(F.array_sort(words))).alias("_sorted"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    rows = rows.withColumn("_starts", F.when(F.size("_sorted") > 0, starts).otherwise(F.array().cast("array<int>")))
    pairs = F.transform("_starts", lambda i, k: F.struct(F.get("_sorted", i).alias(name), (F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - i).alias("n")))
    return rows.select(*keep, F.inline(pairs))


def word_total(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_word_count"))


def grams(words: Column, size: int) -> Column:
    if size == 1:
        return words
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(table: DataFrame, size: int, min_count: int = 2, min_df: int = 2) -> DataFrame:
    """N-grams that occur min_count times in min_df sources: ngram, raw_count, weighted_count, doc_frequency,
    total_word_count, density_pct (not rounded). Windows stay inside a source. Rank by weighted_count desc, ngram."""
    per = runs(table.select("source_idx", "weight", "tokens"), grams(F.col("tokens"), size), "ngram")
    out = per.groupBy("ngram").agg(F.sum("n").cast("long").alias("raw_count"), F.sum(F.col("n") * F.col("weight")).alias("weighted_count"), F.count(F.lit(1)).alias("doc_frequency"))
    out = out.filter((F.col("raw_count") >= min_count) & (F.col("doc_frequency") >= min_df)).crossJoin(F.broadcast(word_total(table)))
    return out.withColumn("density_pct", 100.0 * F.col("raw_count") / F.col("total_word_count"))


def ngram_fields(table: DataFrame, size: int, min_count: int = 2, min_df: int = 2) -> DataFrame:
    """How the raw counts of those n-grams divide by field: ngram, field, field_count."""
    per = runs(table.select("source_idx", "field", "tokens"), grams(F.col("tokens"), size), "ngram")
    by_field = per.groupBy("ngram", "field").agg(F.sum("n").cast("long").alias("field_count"), F.count(F.lit(1)).alias("df"))
    kept = by_field.groupBy("ngram").agg(F.sum("field_count").alias("raw"), F.sum("df").alias("df")).filter((F.col("raw") >= min_count) & (F.col("df") >= min_df))
    return by_field.drop("df").join(kept.select("ngram"), "ngram", "left_semi")


def ngrams_with_sources(table: DataFrame, size: int, min_count: int = 2, min_df: int = 2) -> DataFrame:
    """ngrams() with sources, a map from field to count."""
    fields = ngram_fields(table, size, min_count, min_df).groupBy("ngram").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "field_count")))).alias("sources"))
    return ngrams(table, size, min_count, min_df).withColumn("gram_size", F.lit(size)).join(fields, "ngram")


def tfidf(table: DataFrame, min_df: int = 1) -> DataFrame:
    """term, tfidf, raw_tf (in the first source that has it), idf, doc_frequency, raw_count, total_word_count, density_pct.

    idf = ln((N + 1) / (df + 1)) + 1 is the same in all sources, so tfidf = idf * sum(tf * weight). Rank by tfidf desc, term.
    """
    per = runs(table.select("source_idx", "weight", "n_tokens", "tokens"), F.col("tokens")).withColumn("tf", F.col("n") / F.col("n_tokens"))
    totals = table.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_word_count"))
    out = per.groupBy("term").agg(F.sum(F.col("tf") * F.col("weight")).alias("s"), F.min_by("tf", "source_idx").alias("raw_tf"), F.count(F.lit(1)).alias("doc_frequency"), F.sum("n").cast("long").alias("raw_count"))
    out = out.filter(F.col("doc_frequency") >= min_df).crossJoin(F.broadcast(totals)).withColumn("idf", F.log((F.col("N") + 1) / (F.col("doc_frequency") + 1)) + 1)
    return out.select("term", (F.col("s") * F.col("idf")).alias("tfidf"), "raw_tf", "idf", "doc_frequency", "raw_count", "total_word_count", (100.0 * F.col("raw_count") / F.col("total_word_count")).alias("density_pct"))


def field_b(field: Column, given: dict[str, float] | None = None) -> Column:
    low = F.lower(field)
    out = F.when(F.contains(low, F.lit("title")), TITLE_B).when(F.contains(low, F.lit("snippet")) | F.contains(low, F.lit("description")), SNIPPET_B).otherwise(BODY_B)
    for name, b in (given or {}).items():
        out = F.when(field == name, b).otherwise(out)
    return out


def _lookup(field: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(field == name, F.lit(float(v))).otherwise(out)
    return out


def field_profile(table: DataFrame, weights: dict[str, float] | None = None, b: dict[str, float] | None = None) -> DataFrame:
    """field, total_length, avg_length, doc_count, weight (of the defaults and weights; 1 if neither has it) and b."""
    out = table.groupBy("field").agg(F.sum("n_tokens").cast("long").alias("total_length"), F.avg("n_tokens").alias("avg_length"), F.count(F.lit(1)).alias("doc_count"))
    return out.withColumn("weight", _lookup(F.col("field"), FIELD_WEIGHTS | (weights or {}), 1.0)).withColumn("b", field_b(F.col("field"), b))


def _count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda t: t == word))


def bm25f(table: DataFrame, query: list[str], weights: dict[str, float] | None = None, b: dict[str, float] | None = None, k1: float = 1.2, top_n: int | None = None) -> DataFrame:
    """source_idx, score, query_coverage, matched_terms, term_scores (map) and field of the sources that match.

    A term's part is w / (k1 + w) * idf, w = count * length norm * field weight; the norm is 1 / (1 - b + b * length / mean
    length of the field). idf = ln((N - df + .5) / (df + .5) + 1), 0 if no source or every source has the term. Terms are
    compared in lower case; weights and b name fields (1 and .75 if not named). Rank by score desc, coverage desc, source_idx.
    Counts are made in each row; only one row of document frequencies and one row for each field are joined.
    """
    terms = list(dict.fromkeys(q.lower() for q in query))
    if not terms:
        return table.select("source_idx", F.lit(0.0).alias("score"), F.lit(0.0).alias("query_coverage"), F.array().cast("array<string>").alias("matched_terms"), F.create_map().cast("map<string,double>").alias("term_scores"), "field").limit(0)
    counts = F.array(*(_count(F.col("tokens"), F.lit(q)) for q in terms))
    rows = table.withColumn("tf", counts)
    totals = rows.agg(F.count(F.lit(1)).alias("N"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms)))).alias("df"))
    means = rows.groupBy("field").agg(F.avg("n_tokens").alias("mean"))
    rows = rows.filter(F.exists("tf", lambda n: n > 0)).join(means, "field").crossJoin(F.broadcast(totals))
    norm = 1 - F.col("b") + F.col("b") * F.col("n_tokens") / F.col("mean")
    rows = rows.withColumn("b", _lookup(F.col("field"), b or {}, BODY_B)).withColumn("norm", F.when((F.col("mean") == 0) | (norm <= 0), 1.0).otherwise(1 / norm) * _lookup(F.col("field"), weights or {}, 1.0))
    idf = F.transform("df", lambda d: F.when((d == 0) | (d >= F.col("N")), 0.0).otherwise(F.log((F.col("N") - d + 0.5) / (d + 0.5) + 1)))
    named = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("tf"), idf.alias("idf"))
    parts = F.transform(F.filter(named, lambda x: x["tf"] > 0), lambda x: F.struct(x["term"].alias("term"), (x["tf"] * F.col("norm") / (F.lit(k1) + x["tf"] * F.col("norm")) * x["idf"]).alias("part")))
    out = rows.withColumn("parts", parts).select(
        "source_idx", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"), (F.size("parts") / len(query)).alias("query_coverage"),
        F.transform("parts", lambda x: x["term"]).alias("matched_terms"), F.map_from_entries("parts").alias("term_scores"), "field",
    )
    return out if top_n is None else out.orderBy(F.desc("score"), F.desc("query_coverage"), "source_idx").limit(top_n)


#: Words that are broadcast at most.
MOST_BROADCAST = 1_000_000


def neighbour_counts(table: DataFrame, window: int = 5, only: DataFrame | None = None, seeds: list[str] | None = None) -> DataFrame:
    """term, other, n: how often two different words stand at most window places apart, in both directions.

    only: a table of different terms; pairs of other terms are left out before they are shuffled to be counted. seeds: the same as a
    list, for a few terms: only their surroundings are looked at.
    """
    t = F.col("tokens")

    def shifted(d: int) -> Column:
        # A place and the one d further on (d places back, if d is negative): both directions come out of one pass.
        first, last = max(0, -d), F.size(t) - 1 - max(0, d)
        places = F.sequence(F.lit(first), last)
        if seeds is not None:
            places = F.filter(places, lambda i: F.get(t, i).isin(*seeds))
        pairs = F.transform(places, lambda i: F.struct(F.get(t, i).alias("term"), F.get(t, i + d).alias("other")))
        return F.when(F.size(t) > abs(d), pairs).otherwise(F.expr("cast(array() as array<struct<term:string,other:string>>)"))

    all_ = F.flatten(F.array(*(shifted(d) for d in range(-window, window + 1) if d)))
    pairs = table.select(F.inline(all_)).filter("term <> other")
    if only is not None:
        pairs = pairs.join(only, "term", "left_semi")
    return pairs.groupBy("term", "other").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(table: DataFrame, seeds: list[str], window: int = 5, top_n: int | None = 30) -> DataFrame:
    """Neighbours of seed words: term, cooccurrence_count (over all seeds), jaccard_similarity (of the sets of neighbours, the
    largest over seeds), context_terms (seeds it stands by), total_word_count, density_pct. Seeds themselves are left out.
    Rank by count desc, jaccard desc, term. Contexts are gathered for seeds and their neighbours only, in one pass each; the pairs of
    the seeds, on which all else is built, are checkpointed.
    """
    seeds = list(dict.fromkeys(s.lower() for s in seeds))
    near = checkpointed(neighbour_counts(table, window, seeds=seeds))
    kept = near.filter(~F.col("other").isin(*seeds)) if seeds else near
    # Which seeds a word stands by, for the words that neighbours stand by.
    by = near.groupBy("other").agg(F.collect_set("term").alias("by"))
    words = kept.select(F.col("other").alias("term")).distinct()
    # Few words are sent to the texts, so pairs are counted before they are shuffled; more are joined.
    context = neighbour_counts(table, window, F.broadcast(words) if words.count() <= MOST_BROADCAST else words)
    shared = F.create_map(*(x for s in seeds for x in (F.lit(s), F.count_if(F.array_contains("by", s))))) if seeds else F.create_map().cast("map<string,bigint>")
    words = context.join(by, "other", "left").groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("b"), shared.alias("shared"))
    sizes = near.groupBy(F.col("term").alias("seed")).agg(F.count(F.lit(1)).alias("a"))
    rows = kept.select(F.col("term").alias("seed"), F.col("other").alias("word"), "n").join(sizes, "seed").join(words, "word").withColumn("common", F.element_at("shared", F.col("seed")))
    rows = rows.withColumn("j", F.col("common") / (F.col("a") + F.col("b") - F.col("common")))
    out = rows.groupBy(F.col("word").alias("term")).agg(F.sum("n").cast("long").alias("cooccurrence_count"), F.max("j").alias("jaccard_similarity"), F.sort_array(F.collect_set("seed")).alias("context_terms"))
    out = out.crossJoin(F.broadcast(word_total(table))).withColumn("density_pct", 100.0 * F.col("cooccurrence_count") / F.col("total_word_count"))
    return out if top_n is None else out.orderBy(F.desc("cooccurrence_count"), F.desc("jaccard_similarity"), "term").limit(top_n)


def content_gap(texts: DataFrame, target: Column) -> DataFrame:
    """texts (any columns and text) against an array of target terms: coverage_ratio, jaccard_overlap, cosine_similarity,
    missing_high_value (sorted), overused_low_value (words found more than three times that are no target, sorted).
    Without targets everything is zero or empty."""
    base = texts.select("*", F.explode(F.array(tokens("text"))).alias("_words")).withColumn("_want", F.transform(target, F.lower))
    base = base.withColumn("_have", F.array_distinct("_words")).withColumn("_set", F.array_distinct("_want"))
    base = base.withColumn("_hn", F.transform("_have", lambda x: _count(F.col("_words"), x))).withColumn("_wn", F.transform("_set", lambda x: _count(F.col("_want"), x))).withColumn("_dot", F.transform("_set", lambda x: _count(F.col("_words"), x)))
    common = F.size(F.array_intersect("_have", "_set"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with("_wn", "_dot", lambda a, b: (a * b).cast("double")))
    norms = F.sqrt(total(F.transform("_hn", lambda x: (x * x).cast("double")))) * F.sqrt(total(F.transform("_wn", lambda x: (x * x).cast("double"))))
    some = F.size("_set") > 0
    empty = F.array().cast("array<string>")
    out = base.withColumns({
        "coverage_ratio": F.when(some, common / F.size("_set")).otherwise(0.0),
        "jaccard_overlap": F.when(some, common / F.size(F.array_union("_have", "_set"))).otherwise(0.0),
        "cosine_similarity": F.when(some & (norms > 0), dot / norms).otherwise(0.0),
        "missing_high_value": F.when(some, F.array_sort(F.array_except("_set", "_have"))).otherwise(empty),
        "overused_low_value": F.when(some, F.array_sort(F.transform(F.filter(F.arrays_zip("_have", "_hn"), lambda x: (x["_hn"] > 3) & ~F.array_contains("_set", x["_have"])), lambda x: x["_have"]))).otherwise(empty),
    })
    return out.drop("_words", "_want", "_have", "_set", "_hn", "_wn", "_dot")
