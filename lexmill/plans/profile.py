"""Math profiles: corpora built from results, pages or generated texts, and all analyses over one token table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import corpus as stats
from ..operators.intent import intent
from ..operators.quality import SECTION_FIELDS, sections
from ..operators.sets import term_overlap

RESULT_WEIGHTS = {"title": 3.0, "snippet": 1.5, "displayed_link": 1.0, "rich_snippet": 1.0}
RELATED_WEIGHT = 2.0
PAGE_WEIGHTS = {"title": ("crawl_title", 3.0), "meta_description": ("crawl_meta_description", 1.5), "body_text": ("crawl_body", 1.0)}


@dataclass
class Settings:
    ngram_min: int = 1
    ngram_max: int = 4
    min_count: int = 2
    min_df: int = 2
    top: int = 50
    window: int = 5
    k1: float = 1.2
    relax: bool = True  # thresholds of 1 if there are fewer sources than min_df
    tfidf_min_df: int | None = None
    use_bm25f: bool = True


@dataclass
class Profile:
    """Lazy tables; rank columns aside they are those of the operators."""

    sources: DataFrame
    ngrams: dict[int, DataFrame] = field(default_factory=dict)
    tfidf: DataFrame | None = None
    cooccurrence: DataFrame | None = None
    intent: DataFrame | None = None
    fields: DataFrame | None = None
    bm25f: DataFrame | None = None


def _unpivot(rows: DataFrame, parts: list[tuple[str, str, float]], keep: list[str]) -> DataFrame:
    """A row for each part (column, field, weight) that isn't blank."""
    items = F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).cast("string").alias("text"), F.lit(f).alias("field"), F.lit(w).alias("weight")) for i, (c, f, w) in enumerate(parts)))
    return rows.select(*keep, F.inline(items)).filter(F.coalesce("text", F.lit("")) != "")


def _indexed(rows: DataFrame, key: Column) -> DataFrame:
    return rows.withColumn("source_idx", key)


def result_corpus(serp: DataFrame, related: DataFrame | None = None, use_related: bool = True, use_questions: bool = True) -> DataFrame:
    """serp: row_idx, title, snippet, displayed_link, rich_snippet; related: row_idx, related_query, type. source_idx orders results
    before related queries, each by row and part."""
    out = _unpivot(serp, [(c, c, w) for c, w in RESULT_WEIGHTS.items()], ["row_idx"])
    out = _indexed(out, F.col("row_idx") * 8 + F.col("part")).select("source_idx", "text", "field", "weight")
    if related is not None:
        kinds = ([] if not use_related else ["related_search"]) + ([] if not use_questions else ["people_also_ask"])
        more = related.filter(F.col("type").isin(*kinds)).select((F.lit(1 << 60) + F.col("row_idx")).alias("source_idx"), F.col("related_query").alias("text"), F.col("type").alias("field"), F.lit(RELATED_WEIGHT).alias("weight"))
        out = out.unionByName(more)
    return out


def has_partial_data(serp: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: fewer than three sources for each result."""
    return serp.agg(F.count(F.lit(1)).alias("rows")).crossJoin(sources.filter(F.col("field").isin(*RESULT_WEIGHTS)).agg(F.count(F.lit(1)).alias("sources"))).select((F.col("sources") < 3 * F.col("rows")).alias("has_partial_data"))


def page_corpus(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, title, meta_description, headings (array), body_text."""
    parts = _unpivot(pages, [(c, f, w) for c, (f, w) in PAGE_WEIGHTS.items()], ["page_id", F.col("url").alias("provenance_url")])
    heads = pages.select("page_id", F.col("url").alias("provenance_url"), F.posexplode("headings").alias("part", "text")).withColumn("part", F.col("part") + 8).withColumn("field", F.lit("crawl_heading")).withColumn("weight", F.lit(2.0)).filter("text <> ''")
    return _indexed(parts.unionByName(heads), F.col("page_id") * (1 << 20) + F.col("part")).select("source_idx", "text", "field", "weight", "provenance_url")


def generated_corpus(texts: DataFrame) -> DataFrame:
    """texts: text_id, text: its sections."""
    parts = texts.withColumn("s", sections(F.col("text")))
    parts = parts.select("text_id", *(F.element_at("s", F.lit(e)).alias(e) for e in SECTION_FIELDS))
    out = _unpivot(parts, [(e, f, w) for e, (f, w) in SECTION_FIELDS.items()], ["text_id"])
    return _indexed(out, F.col("text_id") * 8 + F.col("part")).select("source_idx", "text", "field", "weight")


def generated_profiles(texts: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), top: int = 30) -> dict[str, DataFrame]:
    """texts: text_id, text: a profile of each text, its sections being the sources, without least counts.

    ngrams: text_id, size, ngram, raw_count, weighted_count, doc_frequency (sections), density_pct; tfidf: text_id, term, tfidf,
    doc_frequency, raw_count; the top of each text and size, by weight, then name. Counts are made in the row of a section; one
    shuffle brings the sections of a text together."""
    rows = generated_corpus(texts).select(F.shiftright("source_idx", 3).alias("text_id"), "weight", F.explode(F.array(tokens("text"))).alias("tokens"))
    rows = rows.withColumn("len", F.size("tokens"))
    totals = rows.groupBy("text_id").agg(F.sum("len").alias("total"), F.count(F.lit(1)).alias("sections"))
    counts = None
    for n in sizes:
        part = stats.runs(rows, stats.grams(F.col("tokens"), n)).withColumn("size", F.lit(n))
        counts = part if counts is None else counts.unionByName(part)
    sums = counts.groupBy("text_id", "size", "term").agg(F.sum("n").cast("long").alias("raw_count"), F.sum(F.col("n") * F.col("weight")).alias("weighted_count"), F.count(F.lit(1)).alias("doc_frequency"), F.sum(F.col("n") / F.col("len") * F.col("weight")).alias("tf"))
    sums = sums.join(totals, "text_id")
    first = lambda by, *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(by, 9)), "term"))
    ngrams = sums.withColumn("k", first("weighted_count", "text_id", "size")).filter(F.col("k") <= top)
    terms = sums.filter("size = 1").withColumn("tfidf", F.col("tf") * (F.log((F.col("sections") + 1) / (F.col("doc_frequency") + 1)) + 1)).withColumn("k", first("tfidf", "text_id")).filter(F.col("k") <= top)
    return {
        "ngrams": ngrams.select("text_id", "size", F.col("term").alias("ngram"), "raw_count", "weighted_count", "doc_frequency", (100.0 * F.col("raw_count") / F.col("total")).alias("density_pct")),
        "tfidf": terms.select("text_id", "term", "tfidf", "doc_frequency", "raw_count"),
    }


def scraped_corpus(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, text, as bodies."""
    return pages.select(F.col("page_id").alias("source_idx"), "text", F.lit("body_text").alias("field"), F.lit(1.0).alias("weight"), F.col("url").alias("provenance_url")).filter("text <> ''")


def _top(rows: DataFrame, by: str, name: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), name).limit(n)


def build_profile(sources: DataFrame, settings: Settings | None = None) -> Profile:
    """All analyses of a corpus. Its ten first TF-IDF terms, ten rows fetched by the driver, seed co-occurrence, and twenty query BM25F; its
    number of sources is counted once for the thresholds. The token table is cached, as every analysis reads it."""
    s = settings or Settings()
    table = stats.token_table(sources).cache()
    few = s.relax and table.limit(s.min_df).count() < s.min_df
    count, df = (1, 1) if few else (s.min_count, s.min_df)
    out = Profile(sources)
    out.ngrams = {n: _top(stats.ngrams(table, n, count, df), "weighted_count", "ngram", s.top) for n in range(s.ngram_min, s.ngram_max + 1)}
    out.tfidf = _top(stats.tfidf(table, s.tfidf_min_df or df), "tfidf", "term", s.top)
    terms = [r.term for r in out.tfidf.limit(20).select("term").collect()]
    out.cooccurrence = stats.cooccurrence(table, terms[:10], s.window, s.top)
    out.intent = intent(sources)
    out.fields = stats.field_profile(table)
    if s.use_bm25f:
        b = {f: stats.TITLE_B if "title" in f else stats.SNIPPET_B if "snippet" in f or "description" in f else stats.BODY_B for f in stats.FIELD_WEIGHTS}
        out.bm25f = stats.bm25f(table, terms, stats.FIELD_WEIGHTS, b, s.k1, s.top)
    return out


def reverse_report(sources: DataFrame, ads: DataFrame) -> dict[str, DataFrame]:
    """Words of a corpus against keywords (keyword, row_idx): both, left_only (in results only), right_only (in ads only)."""
    words = sources.select(F.explode(tokens("text")).alias("term"), F.col("source_idx").alias("row_idx"))
    return term_overlap(words, ads.select(F.col("keyword").alias("term"), "row_idx"))


def candidate_keywords(profile: Profile, terms: int = 15, pairs: int = 10) -> DataFrame:
    """term, rank: the first TF-IDF terms, then the first bigrams, each once."""
    a = profile.tfidf.orderBy(F.desc("tfidf"), "term").limit(terms).select("term", F.col("tfidf").alias("w"), F.lit(0).alias("part"))
    b = profile.ngrams[2].orderBy(F.desc("weighted_count"), "ngram").limit(pairs).select(F.col("ngram").alias("term"), F.col("weighted_count").alias("w"), F.lit(1).alias("part"))
    return a.unionByName(b).groupBy("term").agg(F.min(F.struct("part", (-F.col("w")).alias("o"))).alias("rank")).orderBy("rank", "term")


def export_sheets(profile: Profile) -> dict[str, DataFrame]:
    """Flat tables for reports: rounded to four places, lists as texts."""
    r = lambda d, *cs: d.withColumns({c: F.bround(c, 4) for c in cs})
    sheets = {f"ngrams_{n}": r(d, "weighted_count", "density_pct") for n, d in profile.ngrams.items()}
    sheets["tfidf"] = r(profile.tfidf, "tfidf", "raw_tf", "idf", "density_pct")
    sheets["cooccurrence"] = r(profile.cooccurrence, "jaccard_similarity", "density_pct").withColumn("context_terms", F.array_join("context_terms", ", "))
    sheets["intent"] = profile.intent.withColumn("score", F.bround("score", 2)).withColumn("confidence", F.bround("confidence", 3)).withColumn("signals", F.array_join("signals", ", "))
    if profile.bm25f is not None:
        sheets["bm25f"] = r(profile.bm25f, "score", "query_coverage").withColumn("matched_terms", F.array_join("matched_terms", ", ")).drop("term_scores")
    return sheets


#: Sheets of a report, their columns and where they come from. Fixed values.
SHEETS = {
    "N-Grams": {"Gram Size": "gram_size", "N-Gram": "ngram", "Count": "raw_count", "Weighted Count": "weighted_count", "DF": "doc_frequency", "Total Words": "total_word_count", "Density %": "density_pct"},
    "TF-IDF Terms": {"Term": "term", "Count": "raw_count", "TF-IDF": "tfidf", "DF": "doc_frequency", "Total Words": "total_word_count", "Density %": "density_pct"},
    "Co-occurrence": {"Term": "term", "Count": "cooccurrence_count", "Jaccard": "jaccard_similarity", "Context Terms": "context_terms", "Total Words": "total_word_count", "Density %": "density_pct"},
    "Intent": {"Intent Type": "intent_type", "Score": "score", "Confidence": "confidence", "Signals": "signals"},
    "SERP Domains": {"Domain": "domain", "Avg Position": "avg_position", "Keyword SERPs": "keyword_serps", "Total Keywords": "total_keyword_serps", "Result Count": "result_count", "Total Results": "total_results"},
}


def report_sheet(name: str, rows: DataFrame) -> DataFrame:
    """A sheet by the names and in the order of SHEETS: doubles to four places, halves to even (an average position to one), lists as texts."""
    if name == "SERP Domains":
        rows = rows.withColumn("avg_position", F.bround("avg_position", 1)).withColumn("keyword_serps", F.concat_ws("/", "keyword_serp_count", "total_keyword_serps"))
    kinds = dict(rows.dtypes)
    shown = {c: F.bround(c, 4) if kinds[c] == "double" else F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c) for c in SHEETS[name].values()}
    return rows.select(*(shown[c].alias(label) for label, c in SHEETS[name].items()))


def report_sheets(profile: Profile, domains: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sheets of a profile, and of domain metrics if given."""
    grams = None
    for n, d in sorted(profile.ngrams.items()):
        d = d.withColumn("gram_size", F.lit(n))
        grams = d if grams is None else grams.unionByName(d)
    parts = {"N-Grams": grams, "TF-IDF Terms": profile.tfidf, "Co-occurrence": profile.cooccurrence, "Intent": profile.intent, "SERP Domains": domains}
    return {name: report_sheet(name, rows) for name, rows in parts.items() if rows is not None}
