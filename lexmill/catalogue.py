"""Queries over the driver's tables, and the same in DuckDB SQL.

The tables are no search results, metrics or trends; each query binds its operator to them by a projection. Sums of doubles
are rounded to six places, as their order is left open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores
from .functions import urls
from .functions.text import SIGNAL_WORD, STOPWORDS, WORD, clean_keyword, is_url_like, keyword_key, tokens
from .operators import corpus, crawl, intent, keyed, quality, sets, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in one small file is dealt to all cores before texts are taken apart; a large one has partitions enough."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- text statistics of documents ---

WEIGHT = "CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 1.5 ELSE 2.0 END"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')), '{WORD}'), lambda t: NOT list_contains({STOP_SQL}, t))"


def signal_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{SIGNAL_WORD}')"


TOKENS_SQL = f"tok AS (SELECT doc_id AS source_idx, source AS field, CAST({WEIGHT} AS DOUBLE) AS weight, {tokens_sql('text')} AS tokens FROM documents)"


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_idx"), "text", F.col("source").alias("field"), F.expr(WEIGHT).cast("double").alias("weight")))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_table(documents_corpus(spark, sf_dir))


@query(f"WITH {TOKENS_SQL} SELECT source_idx, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM tok")
def tokens_stats(spark, sf_dir):
    return document_tokens(spark, sf_dir).select("source_idx", F.col("n_tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def _ngram_sql(n: int) -> str:
    joined = " || ' ' || ".join(f"tokens[i + {k}]" for k in range(n))
    return f"""
WITH {TOKENS_SQL}, g AS (SELECT source_idx, weight, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: {joined})) AS ngram FROM tok),
per AS (SELECT ngram, source_idx, any_value(weight) AS weight, count(*) AS n FROM g GROUP BY ngram, source_idx),
total AS (SELECT CAST(sum(len(tokens)) AS BIGINT) AS total_word_count FROM tok)
SELECT ngram, CAST(sum(n) AS BIGINT) AS raw_count, CAST(sum(n * weight) AS DOUBLE) AS weighted_count, count(*) AS doc_frequency, any_value(total_word_count) AS total_word_count,
  100.0::DOUBLE * sum(n)::BIGINT / any_value(total_word_count) AS density_pct
FROM per, total GROUP BY ngram HAVING sum(n) >= 2 AND count(*) >= 2"""


for _n in (1, 2, 3, 4):
    query(_ngram_sql(_n), f"ngram_rank_{_n}")(lambda spark, sf_dir, n=_n: corpus.ngrams(document_tokens(spark, sf_dir), n))


@query(f"""
WITH {TOKENS_SQL}, g AS (SELECT source_idx, field, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS ngram FROM tok),
kept AS (SELECT ngram FROM g GROUP BY ngram HAVING count(*) >= 2 AND count(DISTINCT source_idx) >= 2)
SELECT ngram, field, count(*) AS field_count FROM g WHERE ngram IN (SELECT ngram FROM kept) GROUP BY ngram, field""")
def ngram_breakdown(spark, sf_dir):
    return corpus.ngram_fields(document_tokens(spark, sf_dir), 2)


TFIDF_SQL = f"""
WITH {TOKENS_SQL}, o AS (SELECT source_idx, weight, len(tokens) AS len, unnest(tokens) AS term FROM tok),
per AS (SELECT term, source_idx, any_value(weight) AS weight, count(*)::DOUBLE / any_value(len) AS tf, count(*) AS n FROM o GROUP BY term, source_idx),
t AS (SELECT count(*) AS N, CAST(sum(len(tokens)) AS BIGINT) AS total_word_count FROM tok),
a AS (SELECT term, sum(tf * weight) AS s, arg_min(tf, source_idx) AS raw_tf, count(*) AS doc_frequency, CAST(sum(n) AS BIGINT) AS raw_count FROM per GROUP BY term)
SELECT term, round(s * (ln((N + 1)::DOUBLE / (doc_frequency + 1)) + 1), 6) AS tfidf, round(raw_tf, 6) AS raw_tf, round(ln((N + 1)::DOUBLE / (doc_frequency + 1)) + 1, 6) AS idf,
  doc_frequency, raw_count, total_word_count FROM a, t"""


@query(TFIDF_SQL)
def tfidf_terms(spark, sf_dir):
    out = corpus.tfidf(document_tokens(spark, sf_dir))
    return out.select("term", r6("tfidf").alias("tfidf"), r6("raw_tf").alias("raw_tf"), r6("idf").alias("idf"), "doc_frequency", "raw_count", "total_word_count")


BM25F_TERMS = ["anat", "thonre", "eron", "leau", "ciónes", "zu", "keit", "anthe"]
_Q = "[" + ", ".join(f"'{t}'" for t in BM25F_TERMS) + "]"


@query(f"""
WITH {TOKENS_SQL}, q AS (SELECT unnest({_Q}) AS term), n AS (SELECT count(*) AS N FROM tok), means AS (SELECT field, avg(len(tokens)) AS mean FROM tok GROUP BY field),
per AS (SELECT source_idx, field, len(tokens) AS len, term, len(list_filter(tokens, lambda t: t = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM per GROUP BY term),
part AS (SELECT source_idx, term, tf / (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean) AS w, CASE WHEN df = 0 OR df >= N THEN 0.0 ELSE ln((N - df + 0.5) / (df + 0.5) + 1) END AS idf FROM per JOIN df USING (term) JOIN means USING (field), n WHERE tf > 0)
SELECT source_idx, round(sum(w / (1.2 + w) * idf), 6) AS score, count(*)::DOUBLE / {len(BM25F_TERMS)} AS query_coverage, string_agg(term, ' ' ORDER BY term) AS matched FROM part GROUP BY source_idx""")
def bm25f_rank(spark, sf_dir):
    out = corpus.bm25f(document_tokens(spark, sf_dir), BM25F_TERMS)
    return out.select("source_idx", r6("score").alias("score"), "query_coverage", F.array_join(F.array_sort("matched_terms"), " ").alias("matched"))


@query(f"WITH {TOKENS_SQL} SELECT field, CAST(sum(len(tokens)) AS BIGINT) AS total_length, round(avg(len(tokens)), 6) AS avg_length, count(*) AS doc_count, 1.0::DOUBLE AS weight, 0.75::DOUBLE AS b FROM tok GROUP BY field")
def field_profile(spark, sf_dir):
    return corpus.field_profile(document_tokens(spark, sf_dir)).withColumn("avg_length", r6("avg_length"))


SEEDS = ["anat", "leau", "keit"]


@query(f"""
WITH {TOKENS_SQL}, w AS (SELECT source_idx, unnest(tokens) AS term, unnest(range(len(tokens))) AS i FROM tok),
p AS (SELECT a.term, b.term AS other FROM w a JOIN w b ON a.source_idx = b.source_idx AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.term <> b.term),
c AS (SELECT term, other, count(*) AS n FROM p GROUP BY term, other), seeds AS (SELECT unnest({SEEDS!r}) AS seed),
near AS (SELECT seed, other AS word, n FROM c JOIN seeds ON c.term = seed WHERE other NOT IN (SELECT seed FROM seeds)),
size AS (SELECT term, count(*) AS s FROM c GROUP BY term),
common AS (SELECT seed, word, count(*) AS k FROM near JOIN c a ON a.term = seed JOIN c b ON b.term = word AND b.other = a.other GROUP BY seed, word),
j AS (SELECT n.seed, n.word, n.n, coalesce(k, 0)::DOUBLE / (x.s + y.s - coalesce(k, 0)) AS j FROM near n LEFT JOIN common USING (seed, word) JOIN size x ON x.term = seed JOIN size y ON y.term = word)
SELECT word AS term, CAST(sum(n) AS BIGINT) AS cooccurrence_count, round(max(j), 6) AS jaccard_similarity, string_agg(seed, ' ' ORDER BY seed) AS context FROM j GROUP BY word""")
def cooccurrence_terms(spark, sf_dir):
    out = corpus.cooccurrence(document_tokens(spark, sf_dir), SEEDS, top_n=None)
    return out.select("term", "cooccurrence_count", r6("jaccard_similarity").alias("jaccard_similarity"), F.array_join("context_terms", " ").alias("context"))


TARGETS = ["anat", "thonre", "eron", "leau", "anat", "keit", "nowhere"]


@query(f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents), x AS (SELECT {TARGETS!r} AS want),
c AS (SELECT doc_id, w, list_distinct(w) AS have, want, list_distinct(want) AS s FROM t, x),
d AS (SELECT doc_id, unnest(w) AS term FROM t), f AS (SELECT doc_id, term, count(*) AS n FROM d GROUP BY doc_id, term), wt AS (SELECT term, count(*) AS n FROM (SELECT unnest(want) AS term FROM x) GROUP BY term),
cs AS (SELECT f.doc_id, coalesce(sum(f.n * wt.n), 0) / (sqrt(sum(f.n * f.n)) * (SELECT sqrt(sum(n * n)) FROM wt)) AS cosine, string_agg(f.term, ' ' ORDER BY f.term) FILTER (f.n > 3 AND wt.n IS NULL) AS overused FROM f LEFT JOIN wt USING (term) GROUP BY f.doc_id)
SELECT doc_id, round(len(list_intersect(have, s))::DOUBLE / len(s), 6) AS coverage_ratio, round(len(list_intersect(have, s))::DOUBLE / len(list_distinct(have || s)), 6) AS jaccard_overlap,
  round(coalesce(cosine, 0.0), 6) AS cosine_similarity, coalesce(array_to_string(list_sort(list_filter(s, lambda z: NOT list_contains(have, z))), ' '), '') AS missing, coalesce(overused, '') AS overused
FROM c LEFT JOIN cs USING (doc_id)""")
def content_gap(spark, sf_dir):
    out = corpus.content_gap(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.array(*map(F.lit, TARGETS)))
    return out.select("doc_id", r6("coverage_ratio").alias("coverage_ratio"), r6("jaccard_overlap").alias("jaccard_overlap"), r6("cosine_similarity").alias("cosine_similarity"), F.array_join("missing_high_value", " ").alias("missing"), F.array_join("overused_low_value", " ").alias("overused"))


# --- intent ---

PHRASES = ["how to choose a guide", "best price catalog", "buy now with delivery discount", "official login portal", "купить чай цена", "обзор и сравнение", "личный кабинет вход", "nothing here", "compare top products vs order"]
FIELDS = ["title", "snippet", "h1", "people_also_ask", "body"]
_INTENT_CORPUS = f"SELECT p_partkey AS source_idx, ({PHRASES!r})[p_partkey % 9 + 1] || ' ' || p_name AS text, ({FIELDS!r})[p_partkey % 5 + 1] AS field, 1.0 + p_size % 3 AS weight FROM part"
_WORD_RULES = ", ".join(f"('{c}', '{'nav:' if c == 'navigational' else ''}{w}', '{w}', {x})" for c, (a, x1, b, x2) in intent.WORDS.items() for ws, x in ((a, x1), (b, x2)) for w in ws.split())
_STEM_RULES = ", ".join(f"('{c}', '{'nav:' if c == 'navigational' else ''}{s}', '{s}', {x})" for c, (ss, x) in intent.STEMS.items() for s in dict.fromkeys(ss.split()))
_INTENT_SQL = f"""
WITH src AS ({_INTENT_CORPUS}),
tok AS (SELECT source_idx, CAST(weight * CASE field WHEN 'title' THEN 1.4 WHEN 'h1' THEN 1.4 WHEN 'snippet' THEN 1.0 WHEN 'people_also_ask' THEN 0.6 ELSE 0.9 END AS DOUBLE) AS w, unnest(list_distinct({tokens_sql('text')})) AS term FROM src),
words(category, signal, word, weight) AS (VALUES {_WORD_RULES}), stems(category, signal, stem, weight) AS (VALUES {_STEM_RULES}),
hits AS (SELECT source_idx, w, category, signal, weight FROM tok JOIN words ON term = word
  UNION ALL SELECT source_idx, w, category, signal, weight FROM tok JOIN stems ON starts_with(term, stem) WHERE regexp_matches(term, '[а-яіїєґ]') QUALIFY row_number() OVER (PARTITION BY source_idx, term, category ORDER BY length(stem) DESC, stem) = 1)"""


def intent_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("p_partkey") % n).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_idx"), F.concat(pick(PHRASES, 9), F.lit(" "), "p_name").alias("text"), pick(FIELDS, 5).alias("field"), (1.0 + F.col("p_size") % 3).alias("weight"))


@query(_INTENT_SQL + " SELECT category, round(sum(w * weight), 4) AS score, count(DISTINCT source_idx) AS sources, string_agg(DISTINCT signal, ' ' ORDER BY signal) AS signals FROM hits GROUP BY category")
def intent_categories(spark, sf_dir):
    return intent.category_scores(intent_corpus(spark, sf_dir)).select("category", F.round("score", 4).alias("score"), "sources", F.array_join("signals", " ").alias("signals"))


@query(_INTENT_SQL + """, c AS (SELECT category, sum(w * weight) AS s FROM hits GROUP BY category),
r AS (SELECT category, s, row_number() OVER (ORDER BY s DESC) AS k FROM c),
x AS (SELECT (SELECT s FROM r WHERE k = 1) AS top, (SELECT category FROM r WHERE k = 1) AS cat, coalesce((SELECT s FROM r WHERE k = 2), 0) AS second, (SELECT sum(s) FROM c) AS total,
  (SELECT count(DISTINCT source_idx) FROM hits) AS matched, (SELECT count(*) FROM src) AS n, (SELECT count(DISTINCT signal) FROM hits) AS different)
SELECT CASE WHEN top < 0.8 AND total < 1.2 THEN 'undetermined' WHEN second > 0 AND top - second <= greatest(0.45, top * 0.18) THEN 'mixed' ELSE cat END AS intent_type,
  CASE WHEN top < 0.8 AND total < 1.2 THEN 0.0 ELSE round(top, 4) END AS score, round(least(1.0, 0.55 * matched / n + 0.25 * top / total + 0.20 * different / (4 * n)), 6) AS confidence, different AS n_signals FROM x""")
def intent_corpus_type(spark, sf_dir):
    return intent.intent(intent_corpus(spark, sf_dir)).select("intent_type", F.round("score", 4).alias("score"), r6("confidence").alias("confidence"), F.size("signals").cast("long").alias("n_signals"))


# --- pages ---

_TITLE, _H1 = "(?s)<title>(.*?)</title>", "(?s)<h1>(.*?)</h1>"
_PAGES_SQL = f"p AS (SELECT page_id, url, html, regexp_extract(html, '{_TITLE}', 1) AS title, regexp_extract(html, '{_H1}', 1) AS h1, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS intro FROM pages)"


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages"))
    return p.select("page_id", "url", "html", F.regexp_extract("html", _TITLE, 1).alias("title"), F.regexp_extract("html", _H1, 1).alias("h1"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("intro_text"), F.lit("").alias("meta_description"), F.col("html").alias("body"))


@query(f"""
WITH {_PAGES_SQL}, b AS (SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS body, trim(regexp_replace(intro, '\\s+', ' ', 'g')) AS intro, title || ' ' || h1 || ' ' || intro || ' ' || html AS everything FROM p)
SELECT page_id, CAST(len(list_distinct({signal_sql('everything')})) AS BIGINT) AS word_count, CAST(len(regexp_extract_all(body, '(?i)<(?:ul|ol|li|list)')) AS BIGINT) AS list_count, CAST(len(regexp_extract_all(body, '(?i)<table')) AS BIGINT) AS table_count,
  CAST(len(regexp_extract_all(body, '(?i)\\[(?:\\d+|[a-z]{{1,3}})\\]')) + len(regexp_extract_all(body, '(?i)https?://[^\\s]+')) AS BIGINT) AS citation_count, CAST(len(regexp_extract_all(body, '(?i)<(?:img|video|iframe|audio)')) AS BIGINT) AS media_count,
  regexp_matches(CASE WHEN intro <> '' THEN intro ELSE substr(body, 1, 500) END, '(?i)(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])(is|are|это|означает|means|defined)($|[^\\p{{L}}\\p{{N}}_\\p{{M}}])|<table|<ul|<ol|<li') AS has_answer_first FROM b""")
def page_signals(spark, sf_dir):
    out = signals.page_text_signals(page_table(spark, sf_dir))
    return out.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("word_count", "list_count", "table_count", "citation_count", "media_count")), "has_answer_first")


@query(f"""
WITH {_PAGES_SQL}, t AS (SELECT page_id, list_distinct({signal_sql('title')}) AS t, list_distinct({signal_sql('h1')}) AS h, list_distinct({signal_sql('intro')}) AS i FROM p),
s AS (SELECT *, coalesce(array_to_string(list_sort(t)[1:10], ' '), '') AS sig FROM t), d AS (SELECT sig, count(*) AS k FROM s GROUP BY sig), n AS (SELECT count(*) AS n FROM s),
o AS (SELECT page_id, len(t) AS lt, CASE WHEN len(t) = 0 OR len(list_distinct(t || h)) = 0 THEN 0.0 ELSE len(list_intersect(t, h))::DOUBLE / len(list_distinct(t || h)) END AS th, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(t, i))::DOUBLE / len(list_distinct(t || i)) END AS ti,
  CASE WHEN len(t) > 0 AND k > 1 THEN (k - 1)::DOUBLE / n ELSE 0.0 END AS dup FROM s JOIN d USING (sig), n)
SELECT page_id, round(th, 6) AS title_h1_overlap, round(ti, 6) AS title_intro_overlap, round(dup, 6) AS duplicate_title_risk, round((th + ti) / 2, 6) AS title_alignment_score,
  CASE WHEN lt = 0 THEN 1.0 ELSE round(least(1.0, 0.6 * (1 - (th + ti) / 2) + 0.4 * dup), 6) END AS title_rewrite_risk FROM o""")
def title_alignment(spark, sf_dir):
    out = signals.title_alignment(page_table(spark, sf_dir))
    return out.select("page_id", *(r6(c).alias(c) for c in out.columns[1:]))


@query(f"""
WITH s AS ({ORACLES['page_signals']}), c AS (SELECT page_id, least(1.0, word_count / 900.0) AS a, least(1.0, (list_count + table_count) / 4.0) AS b, least(1.0, citation_count / 6.0) AS c, least(1.0, media_count / 4.0) AS d, CASE WHEN has_answer_first THEN 1.0 ELSE 0.0 END AS e FROM s),
x AS (SELECT page_id, 0.35::DOUBLE * a + 0.20::DOUBLE * b + 0.20::DOUBLE * c + 0.15::DOUBLE * d + 0.10::DOUBLE * e AS effort FROM c)
SELECT page_id, round(effort, 6) AS effort_score, CASE WHEN effort >= 0.7 THEN 'high' WHEN effort >= 0.4 THEN 'medium' ELSE 'low' END AS effort_level FROM x""")
def content_effort(spark, sf_dir):
    return signals.content_effort(signals.page_text_signals(page_table(spark, sf_dir))).select("page_id", r6("effort_score").alias("effort_score"), "effort_level")


@query(f"""
WITH {_PAGES_SQL}, t AS (SELECT page_id, list_distinct({signal_sql("title || ' ' || html")}) AS t FROM p), c AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM t) GROUP BY term ORDER BY n DESC, term LIMIT 60),
o AS (SELECT page_id, len(list_intersect(t, (SELECT list(term) FROM c)))::DOUBLE / len(t) AS overlap FROM t WHERE len(t) > 0)
SELECT count(*) AS page_count, round(count(*) FILTER (overlap < 0.15) / count(*), 6) AS off_topic_ratio, round(avg(overlap), 6) AS mean_topical_overlap, round(1 - count(*) FILTER (overlap < 0.15) / count(*), 6) AS site_focus_score FROM o""")
def topical_overlap(spark, sf_dir):
    out = signals.topical_overlap(page_table(spark, sf_dir))
    return out.select("page_count", *(r6(c).alias(c) for c in out.columns[1:]))


_LINKS_SQL = "a AS (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS url, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)<', 1)) AS anchor FROM pages), l AS (SELECT lower(trim(anchor)) AS anchor, trim(url) AS url FROM a WHERE trim(anchor) <> '' AND trim(url) <> '')"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)<'), F.lit(1)).alias("anchor_text"))
    return spread(table(spark, sf_dir, "pages")).select(F.inline(pairs))


@query(f"WITH {_LINKS_SQL}, w AS (SELECT url, list_distinct(regexp_extract_all(anchor, '[a-zа-я0-9]{{2,}}')) AS w FROM l), b AS (SELECT url FROM w WHERE len(w) > 0 GROUP BY url HAVING count(*) >= 3) SELECT count(*) AS total_links, count(DISTINCT anchor) AS unique_anchors, (SELECT count(*) FROM b) AS mismatched FROM l")
def anchor_totals(spark, sf_dir):
    return signals.anchor_summary(anchors(spark, sf_dir))["totals"]


@query(f"WITH {_LINKS_SQL} SELECT anchor, count(*) AS \"count\" FROM l GROUP BY anchor ORDER BY count(*) DESC, anchor LIMIT 20")
def anchor_top(spark, sf_dir):
    return signals.anchor_summary(anchors(spark, sf_dir))["top_anchors"]


@query(f"""
WITH t AS (SELECT doc_id, unnest({signal_sql('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) <= 256),
h AS (SELECT doc_id, round(ln(1 + n) * 1e9)::BIGINT AS w, ('0x' || substr(md5(term), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(term), 9, 8))::BIGINT AS lo FROM c),
b AS (SELECT doc_id, bit, sum(CASE WHEN ((CASE WHEN bit < 32 THEN lo ELSE hi END) >> (bit % 32)) & 1 = 1 THEN w ELSE -w END) AS s FROM h, range(64) r(bit) GROUP BY doc_id, bit),
f AS (SELECT doc_id, coalesce(sum(CASE WHEN s > 0 AND bit >= 32 THEN 1::BIGINT << (bit - 32) END), 0)::BIGINT AS hi, coalesce(sum(CASE WHEN s > 0 AND bit < 32 THEN 1::BIGINT << bit END), 0)::BIGINT AS lo FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(printf('%08x%08x', hi, lo), '0000000000000000') AS simhash64_hex, CAST((SELECT count(*) FROM c WHERE c.doc_id = d.doc_id) AS BIGINT) AS term_count FROM documents d LEFT JOIN f USING (doc_id)""")
def simhash64(spark, sf_dir):
    return signals.simhash64(spread(table(spark, sf_dir, "documents"))).select("doc_id", "simhash64_hex", F.col("term_count").cast("long").alias("term_count"))


# --- URLs ---

_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in urls.SUFFIXES) + "]"
_HOST_SQL = "lower(regexp_extract(url, '^[^:/?#]*://([^/?#:]*)', 1))"
_DOMAIN_SQL = f"(SELECT CASE WHEN len(l) > s THEN array_to_string(l[len(l) - s:], '.') ELSE array_to_string(l, '.') END FROM (SELECT l, CASE WHEN len(l) >= 3 AND list_contains({_SUFFIX_SQL}, array_to_string(l[-3:], '.')) THEN 3 WHEN len(l) >= 2 AND list_contains({_SUFFIX_SQL}, array_to_string(l[-2:], '.')) THEN 2 ELSE 1 END AS s FROM (SELECT string_split({_HOST_SQL}, '.') AS l)))"


@query(f"""
SELECT page_id, {_HOST_SQL} AS host, {_DOMAIN_SQL} AS domain, regexp_extract(url, '^([^:]*://)', 1) || regexp_replace({_HOST_SQL}, '^www\\.', '') || regexp_replace(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS match_url,
  regexp_extract(url, '^([^:]*://)', 1) || {_HOST_SQL} || CASE WHEN regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) END
  || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') ELSE '' END AS normalized, true AS safe FROM pages""")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.match_domain("url").alias("domain"), urls.match_url("url").alias("match_url"), urls.normalized("url").alias("normalized"), urls.is_safe("url").alias("safe"))


# pages as search results: keyword = language of the path, position = place by page_id, every tenth without one
_SERP_SQL = "s AS (SELECT page_id, url, regexp_extract(url, '://[^/]*/([a-z]+)', 1) AS keyword, CASE WHEN page_id % 10 = 9 THEN NULL ELSE page_id % 40 + 1 END AS position FROM pages)"


def serp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("row_idx"), "url", F.regexp_extract("url", "://[^/]*/([a-z]+)", 1).alias("keyword"), F.when(F.col("page_id") % 10 == 9, None).otherwise(F.col("page_id") % 40 + 1).alias("position"), F.lit("").alias("displayed_link"))


_SERP_AGG_SQL = f"""{_SERP_SQL}, d AS (SELECT lower(trim(keyword)) AS k, position, page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS domain FROM s),
f AS (SELECT k, domain, min(coalesce(position, 1000000)::BIGINT * 1000000000 + page_id) AS spot FROM d GROUP BY k, domain QUALIFY row_number() OVER (PARTITION BY k ORDER BY min(coalesce(position, 1000000)::BIGINT * 1000000000 + page_id)) <= 3),
agg AS (SELECT k AS norm_kw, count(*) AS serp_results, min(position)::DOUBLE AS serp_top_position, (SELECT string_agg(domain, ', ' ORDER BY spot) FROM f WHERE f.k = d.k) AS serp_top3_domains FROM d GROUP BY k)"""


@query(f"WITH {_SERP_AGG_SQL} SELECT * FROM agg")
def serp_per_keyword(spark, sf_dir):
    return keyed.serp_per_keyword(serp_table(spark, sf_dir))


@query(f"""WITH {_SERP_AGG_SQL}, ads AS (SELECT c_custkey AS id, ('["En"]')[1:0] || (['en', ' De ', '"fr"', 'ES', 'it'])[c_custkey % 5 + 1] AS keyword FROM customer), t AS (SELECT event_type, avg(value) AS average_interest FROM events GROUP BY event_type),
tr(keyword, event_type) AS (VALUES ('EN', 'click'), ('de', 'view'), ('Fr', 'error'), ('it', 'signup'))
SELECT id, ads.keyword, serp_results, serp_top_position, serp_top3_domains, round(average_interest, 6) AS average_interest FROM ads LEFT JOIN agg ON trim(lower(trim(ads.keyword)), '"') = norm_kw LEFT JOIN (SELECT lower(keyword) AS kw, average_interest FROM tr JOIN t USING (event_type)) x ON trim(lower(trim(ads.keyword)), '"') = kw""")
def ads_enriched(spark, sf_dir):
    names = F.get(F.array(*map(F.lit, ["en", " De ", '"fr"', "ES", "it"])), (F.col("c_custkey") % 5).cast("int"))
    ads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.alias("keyword"))
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("keyword"), "value")
    named = F.create_map(*(F.lit(x) for kv in {"click": "EN", "view": "de", "error": "Fr", "signup": "it"}.items() for x in kv))
    averages = keyed.interest_averages(points).withColumn("keyword", named[F.col("keyword")]).filter("keyword is not null").withColumn("average_interest", r6("average_interest"))
    return keyed.enriched(ads, serp_table(spark, sf_dir), averages)


@query(f"""WITH {_SERP_SQL}, d AS (SELECT keyword, position, {_DOMAIN_SQL} AS domain FROM s), t AS (SELECT count(DISTINCT keyword) AS total_keyword_serps, count(*) AS total_results FROM s)
SELECT domain, round(avg(position), 6) AS avg_position, count(DISTINCT keyword) AS keyword_serp_count, count(*) AS result_count, any_value(total_keyword_serps) AS total_keyword_serps, any_value(total_results) AS total_results, round(100.0 * count(*) / any_value(total_results), 6) AS domain_visibility
FROM d, t WHERE domain <> '' GROUP BY domain HAVING count(position) > 0""")
def domain_metrics(spark, sf_dir):
    out = keyed.domain_metrics(serp_table(spark, sf_dir))
    return out.select("domain", r6("avg_position").alias("avg_position"), "keyword_serp_count", "result_count", "total_keyword_serps", "total_results", r6("domain_visibility").alias("domain_visibility"))


# pages as sources: every second as it is, the others written otherwise
_SOURCES_SQL = f"src AS (SELECT page_id AS source_pos, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || '/?x=1' END AS source_url FROM pages)"
_MATCH_SQL = lambda c: f"regexp_extract({c}, '^([^:]*://)', 1) || regexp_replace(lower(regexp_extract({c}, '^[^:/?#]*://([^/?#:]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({c}, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_DOM = lambda c: _DOMAIN_SQL.replace("(url,", f"({c},")


def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("source_pos"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/?x=1"))).alias("source_url"))


@query(f"""WITH {_SOURCES_SQL}, m AS (SELECT {_MATCH_SQL('source_url')} AS k, arg_min(source_url, source_pos) AS t FROM src GROUP BY 1), n AS (SELECT {_DOM('source_url')} AS k, arg_min(source_url, source_pos) AS t FROM src GROUP BY 1)
SELECT page_id, CASE WHEN m.t IS NOT NULL THEN 'full_url' WHEN n.t IS NOT NULL THEN 'domain' ELSE 'none' END AS match_type, coalesce(m.t, n.t, '') AS matched_target FROM pages p LEFT JOIN m ON m.k = {_MATCH_SQL('p.url')} LEFT JOIN n ON n.k = {_DOM('p.url')}""")
def url_classify(spark, sf_dir):
    return keyed.classified(table(spark, sf_dir, "pages").select("page_id", "url"), source_urls(spark, sf_dir)).select("page_id", "match_type", "matched_target")


@query(f"""WITH {_SERP_SQL}, {_SOURCES_SQL}, a AS (SELECT DISTINCT source_url, {_MATCH_SQL('source_url')} AS m, {_DOM('source_url')} AS d FROM src), r AS (SELECT keyword AS norm_kw, url, position, page_id, {_MATCH_SQL('url')} AS m, {_DOM('url')} AS d FROM s),
x AS (SELECT norm_kw, source_url, url, position, page_id, 0 AS p FROM a JOIN r USING (m) UNION ALL SELECT norm_kw, source_url, url, position, page_id, 1 FROM a JOIN r USING (d) WHERE a.d <> '')
SELECT norm_kw, source_url, url AS matched_serp_url, CASE p WHEN 0 THEN 'full_url' ELSE 'domain' END AS match_type, coalesce(position, 0) AS serp_rank FROM x QUALIFY row_number() OVER (PARTITION BY norm_kw, source_url ORDER BY p, coalesce(position, 1000000000), page_id) = 1""")
def match_index(spark, sf_dir):
    serp = serp_table(spark, sf_dir).withColumnRenamed("keyword", "norm_kw")
    out = keyed.match_index_of(serp, source_urls(spark, sf_dir))
    return out.select("norm_kw", "source_url", "matched_serp_url", "match_type", F.col("serp_rank").cast("long").alias("serp_rank"))


# --- metrics ---

_RAW_SQL = "raw AS (SELECT 'part ' || l_partkey AS keyword, l_quantity::BIGINT * 10 AS searches, l_returnflag AS competition, (l_discount * 100)::BIGINT AS competition_index, round(l_extendedprice)::BIGINT AS low_micros, round(l_extendedprice * 2)::BIGINT AS high_micros, l_orderkey * 10 + l_linenumber AS seq, l_shipdate FROM lineitem)"


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("part "), "l_partkey").alias("keyword"), (F.col("l_quantity").cast("long") * 10).alias("searches"), F.col("l_returnflag").alias("competition"), F.round(F.col("l_discount") * 100).cast("long").alias("competition_index"), F.round("l_extendedprice").cast("long").alias("low_micros"), F.round(F.col("l_extendedprice") * 2).cast("long").alias("high_micros"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_linenumber").alias("l"), "l_suppkey")


@query(f"WITH {_RAW_SQL} SELECT keyword, max(searches) AS avg_monthly_searches, max(competition_index) AS competition_index, max(low_micros) / 1e6 AS low_cpc, max(high_micros) / 1e6 AS high_cpc, arg_max(competition, competition_index * 1000000000000 + seq * 1000 + CASE competition WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS competition FROM raw GROUP BY keyword")
def metric_buckets(spark, sf_dir):
    raw = raw_metrics(spark, sf_dir)
    return keyed.metric_buckets(raw.withColumn("seq", F.struct("seq", "competition")), "seq")


@query(f"WITH {_RAW_SQL} SELECT keyword, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, max(searches) AS searches FROM raw GROUP BY ALL")
def monthly_volumes(spark, sf_dir):
    return keyed.monthly_volumes(raw_metrics(spark, sf_dir))


@query(f"WITH {_RAW_SQL}, m AS (SELECT keyword, year(l_shipdate) AS y, month(l_shipdate) AS m, max(searches) AS searches FROM raw GROUP BY ALL) SELECT keyword, count(*) FILTER (searches > 0) AS months_with_data FROM m GROUP BY keyword")
def months_with_data(spark, sf_dir):
    return keyed.months_with_data(keyed.monthly_volumes(raw_metrics(spark, sf_dir)))


@query("WITH r(currency, uah) AS (VALUES ('UAH', 1.0::DOUBLE), ('USD', 41.5::DOUBLE), ('EUR', 45.25::DOUBLE)), x AS (SELECT o_orderkey, (['UAH', 'USD', 'EUR', 'GBP'])[o_orderkey % 4 + 1] AS c, o_totalprice FROM orders) SELECT o_orderkey, CASE WHEN c = 'GBP' THEN o_totalprice ELSE round(o_totalprice * uah / 41.5, 4) END AS o_totalprice, CASE WHEN c = 'GBP' THEN c ELSE 'USD' END AS cpc_currency FROM x LEFT JOIN r ON c = currency")
def currency_conversion(spark, sf_dir):
    rates = spark.createDataFrame([("UAH", 1.0), ("USD", 41.5), ("EUR", 45.25)], "currency string, uah double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.get(F.array(*map(F.lit, ["UAH", "USD", "EUR", "GBP"])), (F.col("o_orderkey") % 4).cast("int")).alias("cpc_currency"))
    out = keyed.converted(rows, rates, ["o_totalprice"], "cpc_currency", "USD")
    return out.withColumn("o_totalprice", F.when(F.col("cpc_currency") == "GBP", F.col("o_totalprice")).otherwise(F.round("o_totalprice", 4)))


# events as interest points
_POINTS_SQL = "pt AS (SELECT strftime(ts, '%Y-%m-%d') AS time, strftime(ts, '%d.%m') AS formatted_time, event_type AS keyword, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, user_id % 3 AS batch, event_id AS seq FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("time"), F.date_format("ts", "dd.MM").alias("formatted_time"), F.col("event_type").alias("keyword"), F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value")).alias("value"), (F.col("user_id") % 3).alias("batch"), F.col("event_id").alias("seq"))


@query(f"WITH {_POINTS_SQL} SELECT time, formatted_time, keyword, arg_max(value, seq) AS value, string_agg(DISTINCT batch::VARCHAR, ' ' ORDER BY batch::VARCHAR) AS batches FROM pt GROUP BY ALL")
def trends_merged(spark, sf_dir):
    return keyed.merged_interest(points(spark, sf_dir)).withColumn("batches", F.array_join("batches", " "))


@query(f"WITH {_POINTS_SQL}, m AS (SELECT time, keyword, arg_max(value, seq) AS value FROM pt GROUP BY ALL) SELECT keyword, round(avg(value), 6) AS average_interest FROM m WHERE value IS NOT NULL GROUP BY keyword")
def trends_averages(spark, sf_dir):
    return keyed.interest_averages(keyed.merged_interest(points(spark, sf_dir))).withColumn("average_interest", r6("average_interest"))


EVENTS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {_POINTS_SQL} SELECT time, formatted_time, " + ", ".join(f"arg_max(value, seq) FILTER (keyword = '{k}') AS {k}" for k in EVENTS) + " FROM pt GROUP BY time, formatted_time")
def trends_wide(spark, sf_dir):
    return keyed.interest_wide(keyed.merged_interest(points(spark, sf_dir)), EVENTS)


@query("WITH r AS (SELECT user_id AS request, event_id AS provider_rank, value > 20 AS has_data, event_type = 'error' AS failed FROM events) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY request ORDER BY CASE WHEN has_data OR NOT failed THEN 0 ELSE 1 END, provider_rank) = 1")
def provider_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return keyed.first_with_data(e.select(F.col("user_id").alias("request"), F.col("event_id").alias("provider_rank"), (F.col("value") > 20).alias("has_data"), (F.col("event_type") == "error").alias("failed")))


_FAIL = "CASE WHEN value > 40 THEN NULL WHEN event_id % 9 = 0 THEN 'rate_limit' WHEN event_id % 9 < 8 THEN 'empty_data' ELSE 'timeout' END"


@query(f"WITH r AS (SELECT event_id // 3 AS request, value > 40 AS ok, {_FAIL} AS f FROM events), c AS (SELECT request, count(*) FILTER (ok) AS ok, count(*) FILTER (f = 'rate_limit') AS l, count(*) FILTER (f <> 'empty_data') AS o FROM r GROUP BY request) SELECT request, CASE WHEN ok = 0 AND l > 0 THEN 'blocked' WHEN ok = 0 THEN 'low' WHEN o > 0 THEN 'degraded' ELSE 'medium' END AS confidence FROM c")
def trends_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return keyed.trends_confidence(e.select(F.floor(F.col("event_id") / 3).alias("request"), F.col("event_type").alias("keyword"), (F.col("value") > 40).alias("has_data"), F.expr(_FAIL).alias("failure")))


# --- sets: orders and line items as (source_url, keyword) rows ---

_PAIRS_SQL = "SELECT 's' || l_suppkey AS source_url, 'k' || l_partkey % 50 AS keyword, l_orderkey * 10 + l_linenumber AS row_idx FROM lineitem"
_MORE_SQL = "SELECT 's' || o_custkey AS source_url, 'k' || o_orderkey % 60 AS keyword, o_orderkey AS row_idx FROM orders"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_url"), F.concat(F.lit("k"), F.col("l_partkey") % 50).alias("keyword"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"))


def more_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), "o_custkey").alias("source_url"), F.concat(F.lit("k"), F.col("o_orderkey") % 60).alias("keyword"), F.col("o_orderkey").alias("row_idx"))


@query(f"SELECT source_url, keyword, min(row_idx) AS row_idx FROM ({_PAIRS_SQL}) GROUP BY source_url, keyword")
def dedupe_first(spark, sf_dir):
    return sets.first_pairs(pairs(spark, sf_dir))


@query(f"SELECT source_url, keyword, coalesce(min(row_idx) FILTER (p = 0), min(row_idx)) AS row_idx FROM (SELECT *, 0 AS p FROM ({_PAIRS_SQL}) UNION ALL SELECT *, 1 AS p FROM ({_MORE_SQL})) GROUP BY source_url, keyword")
def union_first(spark, sf_dir):
    return sets.union_first([pairs(spark, sf_dir), more_pairs(spark, sf_dir)])


@query(f"SELECT * FROM ({_PAIRS_SQL}) UNION ALL SELECT m.* FROM ({_MORE_SQL}) m ANTI JOIN ({_PAIRS_SQL}) p USING (source_url, keyword)")
def append_absent(spark, sf_dir):
    return sets.append_absent(pairs(spark, sf_dir), more_pairs(spark, sf_dir))


@query("SELECT 'p' || l_partkey AS keyword, arg_min(l_suppkey, l_suppkey * 10000000000 + l_orderkey * 10 + l_linenumber) AS source_pos FROM lineitem GROUP BY l_partkey")
def cross_source_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_pos"), F.concat(F.lit("p"), "l_partkey").alias("keyword"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("keyword_pos"), F.col("l_suppkey").alias("source"))
    return sets.across_sources(rows).select("keyword", "source_pos")


@query("SELECT arg_min(p_name, p_partkey) AS keyword, min(p_partkey) AS first FROM part WHERE trim(p_name) <> '' GROUP BY lower(trim(p_name))")
def distinct_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword"), F.col("p_partkey").alias("first"))
    return sets.distinct_in_order(rows, "keyword", "first", F.lower("keyword"))


@query("SELECT lower(trim(regexp_replace(regexp_replace(c_name || '!  ' || c_mktsegment, '[^A-Za-z0-9_ -]', '', 'g'), '\\s+', ' ', 'g'))) AS keyword, min(c_custkey) AS first FROM customer GROUP BY 1")
def keyword_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("!  "), "c_mktsegment").alias("keyword"), F.col("c_custkey").alias("first"))
    return sets.processed_keywords(rows, "first", script="[a-z]")


@query("SELECT p_partkey, p_name FROM part SEMI JOIN (SELECT DISTINCT 'RED ' || lower(split_part(p_name, ' ', 2)) AS k FROM part) s ON lower(p_name) = lower(k)")
def restrict_to_input(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    seeds = p.select(F.concat(F.lit('"RED '), F.lower(F.get(F.split("p_name", " "), 1)), F.lit('" ')).alias("keyword"))
    return sets.restricted(p.select("p_partkey", F.col("p_name").alias("keyword")), seeds).select("p_partkey", F.col("keyword").alias("p_name"))


@query(f"SELECT source_url, string_agg(DISTINCT keyword, ' ' ORDER BY keyword) AS keywords FROM ({_PAIRS_SQL}) GROUP BY source_url")
def selection_signature(spark, sf_dir):
    return sets.selection_signature(pairs(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", " "))


_OVERLAP_SQL = f"WITH a AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS k FROM benchmark), b AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS k FROM documents)"


@query(_OVERLAP_SQL + " SELECT coalesce(a.k, b.k) AS term, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def reverse_terms(spark, sf_dir):
    terms = lambda t, i: spread(table(spark, sf_dir, t)).select(F.explode(tokens("text")).alias("term"), F.col(i).alias("row_idx"))
    parts = sets.term_overlap(terms("benchmark", "item_id"), terms("documents", "doc_id"))
    out = None
    for side, rows in parts.items():
        rows = rows.select(F.col("key").alias("term"), F.lit(side).alias("side"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT page_id, url, true AS url_like, lower(trim(url)) AS key FROM pages")
def url_like(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", is_url_like("url").alias("url_like"), keyword_key("url").alias("key"))


# --- generated texts, put together from pages ---

_GEN_SQL = f"{_PAGES_SQL}, g AS (SELECT page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(intro, '\\s+', ' ', 'g')) || ' order now' AS meta, trim(regexp_replace(h1, '\\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*<article>', ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body, lower(split_part(trim(title), ' ', 1)) AS keyword FROM p)"


@query(f"""WITH {_GEN_SQL}, e AS (SELECT page_id, 'META_TITLE' AS element, title AS t, keyword, NULL::VARCHAR AS body FROM g UNION ALL SELECT page_id, 'META_DESCRIPTION', meta, keyword, NULL FROM g UNION ALL SELECT page_id, 'H1', h1, keyword, NULL FROM g UNION ALL SELECT page_id, 'DESCRIPTION', body, keyword, 'META_TITLE: ' || title || chr(10) || 'META_DESCRIPTION: ' || meta || chr(10) || 'H1: ' || h1 || chr(10) || 'DESCRIPTION: ' || body FROM g),
x AS (SELECT *, length(t) AS n, keyword <> '' AND contains(lower(t), keyword) AS present, {tokens_sql('body')} AS w FROM e)
SELECT page_id AS text_id, element, greatest(0.0, 100.0 - CASE element
 WHEN 'META_TITLE' THEN CASE WHEN n < 50 THEN 20 WHEN n > 60 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT contains(lower(substr(t, 1, 30)), keyword) THEN 15 ELSE 0 END + 10
 WHEN 'META_DESCRIPTION' THEN CASE WHEN n < 150 THEN 15 WHEN n > 160 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT present THEN 15 ELSE 0 END
 WHEN 'H1' THEN CASE WHEN n < 30 THEN 15 WHEN n > 70 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT present THEN 20 ELSE 0 END
 ELSE CASE WHEN n < 500 THEN 20 ELSE 0 END + 15 + 15 + CASE WHEN len(w) > 0 AND 100.0 * len(list_filter(w, lambda z: z = keyword)) / len(w) > 7 THEN 20 ELSE 0 END END)::DOUBLE AS score, present AS primary_keyword_present FROM x""")
def generated_quality(spark, sf_dir):
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = page_table(spark, sf_dir)
    body = flat(F.regexp_replace(F.regexp_replace("html", "(?s)^.*<article>", ""), "<[^>]+>", " "))
    text = F.concat(F.lit("META_TITLE: "), flat("title"), F.lit("\nMETA_DESCRIPTION: "), flat("intro_text"), F.lit(" order now\nH1: "), flat("h1"), F.lit("\nDESCRIPTION: "), body)
    rows = p.select(F.col("page_id").alias("text_id"), text.alias("text"), F.lower(F.get(F.split(F.trim("title"), " "), 0)).alias("keyword"), F.lit(None).cast("array<string>").alias("top_ngrams"), F.lit(None).cast("string").alias("meta_title"), F.lit(0.0).alias("tfidf_overlap"), F.lit(0.0).alias("cooccurrence_coverage"))
    return quality.score_elements(rows).select("text_id", "element", "score", "primary_keyword_present")


# --- crawl and stores ---

@query("""WITH RECURSIVE l AS (SELECT DISTINCT s_nationkey AS a, s_suppkey % 25 AS b FROM supplier), r AS (SELECT 0 AS n, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN l ON a = n WHERE depth < 3)
SELECT 'http://n' || n || '.example.com/' AS url, min(depth) AS depth FROM r GROUP BY n""")
def crawl_frontier(spark, sf_dir):
    page = lambda c: F.concat(F.lit("http://n"), c.cast("string"), F.lit(".example.com/"))
    links = table(spark, sf_dir, "supplier").select(page(F.col("s_nationkey")).alias("url"), page(F.col("s_suppkey") % 25).alias("target")).distinct()
    seeds = spark.createDataFrame([("http://n0.example.com/", 0)], "url string, seq long")
    return crawl.crawl(links, seeds, 3, 1000, same_site=False).select("url", "depth")


_KINDS = {"click": "serp", "view": "ads", "error": "trends", "purchase": "llm_extract", "signup": "another"}


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("event_type")]
    return e.select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("cache_key"), kind.alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))


_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"
_HOURS_SQL = "CASE event_type WHEN 'error' THEN 24 WHEN 'purchase' THEN 720 ELSE 168 END"
_CACHE_SQL = f"WITH c AS (SELECT event_type || '-' || user_id % 40 AS cache_key, {_KIND_SQL} AS kind, ts AS created_at, event_id AS seq, props AS payload, ts + INTERVAL 1 HOUR * {_HOURS_SQL} AS expires_at FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, seq DESC) = 1)"
_NOW = "2024-01-30 12:00:00"


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.latest(stores.with_expiry(cache_rows(spark, sf_dir)))


def now() -> Column:
    return F.lit(_NOW).cast("timestamp")


@query(_CACHE_SQL + f" SELECT cache_key, seq, payload FROM l WHERE expires_at >= TIMESTAMP '{_NOW}'")
def cache_latest_valid(spark, sf_dir):
    return stores.valid(cached(spark, sf_dir), now()).select("cache_key", "seq", "payload")


# every event reads the key of the user after its own
_READS_SQL = "n AS (SELECT event_type || '-' || (user_id + 1) % 40 AS cache_key, count(*) AS n FROM events GROUP BY 1)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") + 1) % 40).alias("cache_key"))


@query(_CACHE_SQL + f", {_READS_SQL} SELECT cache_key, CASE WHEN expires_at >= TIMESTAMP '{_NOW}' THEN coalesce(n, 0) ELSE 0 END AS hits FROM l LEFT JOIN n USING (cache_key)")
def cache_hits(spark, sf_dir):
    return stores.with_hits(cached(spark, sf_dir), reads(spark, sf_dir), now()).select("cache_key", "hits")


@query(_CACHE_SQL + f", {_READS_SQL} SELECT kind, count(*) AS records, count(*) FILTER (expires_at < TIMESTAMP '{_NOW}') AS expired, CAST(sum(CASE WHEN expires_at >= TIMESTAMP '{_NOW}' THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS hits FROM l LEFT JOIN n USING (cache_key) GROUP BY kind")
def cache_stats(spark, sf_dir):
    return stores.cache_stats(stores.with_hits(cached(spark, sf_dir), reads(spark, sf_dir), now()), now())


@query(_CACHE_SQL + " SELECT cache_key, seq FROM l ORDER BY created_at DESC, seq DESC LIMIT 100")
def cache_evicted(spark, sf_dir):
    return stores.newest(cached(spark, sf_dir), 100).select("cache_key", "seq")


# events as history: clicks are cache records, those of the others that end in 7 have no time
_HISTORY_SQL = f"h AS (SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'cache' ELSE 'run' END AS record_type, event_id % 10 <> 7 AS timed, ts, ts + INTERVAL 168 HOUR AS expires_at FROM events)"


@query(f"WITH {_HISTORY_SQL} SELECT seq, record_type FROM h WHERE CASE WHEN record_type = 'cache' THEN expires_at >= TIMESTAMP '{_NOW}' ELSE NOT timed OR ts >= TIMESTAMP '{_NOW}' - INTERVAL 10 DAY END")
def history_trimmed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cache = F.col("event_type") == "click"
    rows = e.select(F.col("event_id").alias("seq"), F.when(cache, "cache").otherwise("run").alias("record_type"), F.when(cache | (F.col("event_id") % 10 != 7), F.col("ts").cast("string")).otherwise("no time").alias("created_at"), F.when(cache, F.col("ts") + F.expr("INTERVAL 168 HOURS")).cast("string").alias("expires_at"))
    return stores.trimmed_history(rows, now(), 10).select("seq", "record_type")


@query("SELECT event_id AS seq FROM events")
def history_untrimmed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("created_at"))
    return stores.trimmed_history(rows, now(), 0).select("seq")


@query("SELECT event_id, sha256('{\"a\":\"' || lower(event_type) || '\",\"user\":' || user_id || '}') AS key FROM events")
def cache_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", stores.key_of(F.struct(F.lower("event_type").alias("a"), F.col("user_id").alias("user"))).alias("key"))


from . import catalogue_joins, catalogue_sources  # noqa: E402, F401  their queries join those above
