"""Queries of the catalogue that write payloads out of the driver's tables and read them back, and profiles of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import ORACLES, TFIDF_SQL, documents_corpus, page_table, query, r6, table, tokens_sql
from .plans import profile
from .sources import serp, trends

# --- search results: pages of a language as results of three providers ---

_KIND = ["serper", "serpapi", "brave"]
_RESULT_SQL = "r AS (SELECT regexp_extract(url, '://[^/]*/([a-z]+)', 1) AS keyword, ['serper', 'serpapi', 'brave'][page_id % 3 + 1] AS provider, page_id, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, row_number() OVER (PARTITION BY regexp_extract(url, '://[^/]*/([a-z]+)', 1), page_id % 3 ORDER BY page_id) AS place FROM pages)"


def result_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    rows = p.select(F.regexp_extract("url", "://[^/]*/([a-z]+)", 1).alias("keyword"), F.get(F.array(*map(F.lit, _KIND)), (F.col("page_id") % 3).cast("int")).alias("provider"), "page_id", "title", F.col("url").alias("link"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 40 + 1).alias("position"))
    rows = rows.groupBy("keyword", "provider").agg(F.sort_array(F.collect_list(F.struct("page_id", "title", "link", "position"))).alias("l"))
    named = F.when(F.col("provider") == "serper", F.to_json(F.struct(F.col("l").alias("organic")))).when(F.col("provider") == "serpapi", F.to_json(F.struct(F.col("l").alias("organic_results")))).otherwise(F.to_json(F.struct(F.col("l").alias("results"))))
    return rows.select("keyword", "provider", named.alias("payload"))


@query(f"WITH {_RESULT_SQL} SELECT keyword, provider, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 40 + 1 ELSE place END AS INTEGER) AS position, title, url FROM r")
def payload_results(spark, sf_dir):
    return serp.organic_results(result_payloads(spark, sf_dir)).select("keyword", "provider", "position", "title", "url")


@query("WITH s AS (SELECT 'n' || s_nationkey AS keyword, s_name AS x FROM supplier) SELECT keyword, x AS related_query, 'related_search' AS type FROM s UNION ALL SELECT keyword, 'why ' || x, 'people_also_ask' FROM s")
def payload_related(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("keyword")).agg(F.collect_list("s_name").alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda v: F.struct(F.concat(F.lit(" "), v).alias("query"))).alias("relatedSearches"), F.transform("x", lambda v: F.struct(F.concat(F.lit("why "), v).alias("question"))).alias("peopleAlsoAsk")))
    return serp.related_queries(s.select("keyword", F.lit("serper").alias("provider"), body.alias("payload"))).select("keyword", "related_query", "type")


@query("SELECT lower(n_name) AS keyword, n_name AS title, r_name AS type, '' AS description FROM nation JOIN region ON n_regionkey = r_regionkey")
def payload_graphs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.to_json(F.struct(F.struct(F.col("n_name").alias("title"), F.lit(" ").alias("type"), F.col("r_name").alias("category")).alias("knowledge_graph")))
    return serp.knowledge_graphs(n.select(F.lower("n_name").alias("keyword"), F.lit("serpapi").alias("provider"), body.alias("payload"))).select("keyword", "title", "type", "description")


@query("WITH l AS (SELECT c_custkey, 'n' || c_nationkey AS keyword, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) SELECT keyword, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE k END AS INTEGER) AS position, 'd' || c_custkey AS title, 'https://d' || c_custkey || '.org/' AS url FROM l")
def payload_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(""), F.lit(";d"), "c_custkey", F.lit("; https://d"), "c_custkey", F.lit(".org/"))
    lines = c.select(F.concat(F.lit("n"), "c_nationkey").alias("keyword"), F.col("c_custkey").alias("id"), line.alias("line"))
    heads = lines.select("keyword").distinct().select("keyword", F.lit(-1).cast("long").alias("id"), F.lit("Position;Domain; URL ").alias("line"))
    numbered = lines.unionByName(heads).groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("l")).select("keyword", F.posexplode("l").alias("line_no", "x")).select("keyword", "line_no", "x.line")
    return serp.organic_report(numbered).select("keyword", "position", "title", "url")


# --- interest: events of a day, by kind ---

_EVENTS = ["click", "error", "view"]
_DAYS_SQL = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS time, event_type AS keyword, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT unnest(['click', 'error', 'view']) AS keyword), t AS (SELECT DISTINCT time FROM d)"
_POINTS_SQL = f"WITH {_DAYS_SQL} SELECT time, 'on ' || time AS formatted_time, keyword, coalesce(n, 0) AS value FROM t CROSS JOIN k LEFT JOIN d USING (time, keyword)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time and n, the events of each kind."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("time"))
    return e.agg(F.array(*(F.count_if(F.col("event_type") == k) for k in _EVENTS)).alias("n"))


def payload(rows: DataFrame, item: Column, wrap) -> DataFrame:
    """One payload of all rows' items, asked for _EVENTS."""
    one = rows.agg(F.sort_array(F.collect_list(item)).alias("l"))
    return one.select(F.array(*map(F.lit, _EVENTS)).alias("keywords"), wrap(F.col("l")).alias("payload"))


def told(points: DataFrame) -> DataFrame:
    return points.select("time", "formatted_time", "keyword", "value")


@query(_POINTS_SQL)
def interest_widget(spark, sf_dir):
    item = F.struct("time", F.concat(F.lit("on "), "time").alias("formattedTime"), F.col("n").alias("value"))
    wrap = lambda l: F.concat(F.lit(")]}',\n"), F.to_json(F.struct(F.struct(l.alias("timelineData")).alias("default"))))
    return told(trends.widget_points(payload(days(spark, sf_dir), item, wrap)))


@query(_POINTS_SQL)
def interest_timeline(spark, sf_dir):
    item = F.struct(F.col("time").alias("timestamp"), F.concat(F.lit("on "), "time").alias("date"), F.transform("n", lambda x: F.struct(x.cast("string").alias("value"), x.alias("extracted_value"))).alias("values"))
    wrap = lambda l: F.to_json(F.struct(F.struct(l.alias("timeline_data")).alias("interest_over_time")))
    return told(trends.timeline_points(payload(days(spark, sf_dir), item, wrap)))


@query(_POINTS_SQL.replace("'on ' || time", "time"))
def interest_tasks(spark, sf_dir):
    item = F.struct(F.col("time").alias("date_from"), F.col("n").alias("values"))
    wrap = lambda l: F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("google_trends_graph").alias("type"), l.alias("data")), F.struct(F.lit("map").alias("type"), l.alias("data"))).alias("items"))).alias("result"))).alias("tasks")))
    return told(trends.task_points(payload(days(spark, sf_dir), item, wrap)))


@query(f"WITH {_DAYS_SQL} SELECT 'f' AS file, 'click' AS keyword, time, time AS formatted_time, CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS INTEGER) AS value FROM d WHERE keyword = 'click'")
def interest_csv(spark, sf_dir):
    rows = days(spark, sf_dir).select("time", F.get("n", F.lit(0)).alias("n"))
    line = F.struct("time", F.concat("time", F.lit(',"'), F.when(F.col("n") % 3 == 0, "<1%").otherwise(F.col("n").cast("string")), F.lit('"')).alias("line"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")
    files = rows.filter("n > 0").agg(F.sort_array(F.collect_list(line)).alias("l")).select(F.lit("f").alias("file"), F.lit("click").alias("keyword"), F.concat(F.lit("﻿Category: all\n1999-01-01,7\n\nDay,clicks\n"), body).alias("content"))
    return trends.csv_points(files).select("file", "keyword", "time", "formatted_time", "value")


@query(f"WITH {_DAYS_SQL} SELECT 1 AS page, time, 'day ' || time AS formatted_time, CAST(n % 101 AS INTEGER) AS value FROM d WHERE keyword = 'view'")
def interest_tables(spark, sf_dir):
    rows = days(spark, sf_dir).select("time", F.get("n", F.lit(2)).alias("n")).filter("n > 0")
    row = F.struct("time", F.concat(F.lit("<tr><td><b>day "), "time", F.lit("</b></td><td> "), F.col("n") % 101, F.lit("</td></tr>\n")).alias("row"))
    html = F.concat(F.lit("<table><tr><th>Day</th><th>Views</th></tr><tr><td>one</td><td>5</td></tr></table><TABLE class=x>"), F.array_join(F.transform("l", lambda x: x["row"]), ""), F.lit("</TABLE>"))
    return trends.table_points(rows.agg(F.sort_array(F.collect_list(row)).alias("l")).select(F.lit(1).alias("page"), html.alias("html"))).select("page", "time", "formatted_time", "value")


@query("SELECT n_name AS region, CAST(n_nationkey * 3 AS BIGINT) AS value, 'click' AS keyword FROM nation")
def interest_regions_widget(spark, sf_dir):
    item = F.struct(F.col("n_name").alias("geoName"), F.array(F.col("n_nationkey") * 3).alias("value"))
    wrap = lambda l: F.to_json(F.struct(F.struct(l.alias("geoMapData")).alias("default")))
    return trends.widget_regions(payload(table(spark, sf_dir, "nation"), item, wrap)).select("region", "value", "keyword")


@query("SELECT n_name AS region, CAST(n_nationkey * 3 AS BIGINT) AS value, 'click, error, view' AS keyword FROM nation")
def interest_regions_section(spark, sf_dir):
    item = F.struct(F.col("n_name").alias("location"), (F.col("n_nationkey") * 3).cast("string").alias("value"))
    wrap = lambda l: F.to_json(F.struct(l.alias("interest_by_region")))
    return trends.section_regions(payload(table(spark, sf_dir, "nation"), item, wrap)).select("region", "value", "keyword")


@query("SELECT s_name AS label, CAST(s_suppkey AS VARCHAR) AS value, 'top' AS rank_type, 'query' AS item_type FROM supplier UNION ALL SELECT n_name, 'Breakout', 'rising', 'query' FROM nation")
def interest_related(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").agg(F.collect_list(F.struct(F.col("s_name").alias("query"), F.col("s_suppkey").cast("string").alias("value"))).alias("a"))
    b = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_name").alias("query"), F.lit("Breakout").alias("value"))).alias("b"))
    both = a.crossJoin(b).select(F.array(*map(F.lit, _EVENTS)).alias("keywords"), F.to_json(F.struct(F.struct(F.col("a").alias("top"), F.col("b").alias("rising")).alias("related_queries"))).alias("payload"))
    return trends.section_related(both).select("label", "value", "rank_type", "item_type")


@query("SELECT s_name AS label, CAST(s_suppkey AS VARCHAR) AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'rising' ELSE 'top' END AS rank_type, 'topic' AS item_type, 'kind ' || s_nationkey AS topic_type FROM supplier")
def interest_topics_widget(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "RISING").otherwise("").alias("formattedRankType"), F.struct(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("kind "), "s_nationkey").alias("type")).alias("topic"), F.col("s_suppkey").alias("value")).alias("e"))
    item = F.struct("formattedRankType", F.col("l").alias("rankedKeyword"))
    wrap = lambda l: F.to_json(F.struct(F.struct(l.alias("rankedList")).alias("default")))
    return trends.widget_related(payload(s.groupBy("formattedRankType").agg(F.collect_list("e").alias("l")), item, wrap), topics=True).select("label", "value", "rank_type", "item_type", "topic_type")


@query("""WITH f AS (SELECT s_suppkey AS id, ['now 7-d', ' all ', 'today 12-m', '2024-01-02 2024-03-04', 'else', 'now 1-H'][s_suppkey % 6 + 1] AS t FROM supplier)
SELECT id, CASE s_suppkey % 6 WHEN 0 THEN 'past_7_days' WHEN 1 THEN '2004_present' WHEN 3 THEN NULL WHEN 5 THEN 'past_hour' ELSE 'past_12_months' END AS "range", CASE WHEN s_suppkey % 6 = 3 THEN '2024-01-02' END AS date_from, CASE WHEN s_suppkey % 6 = 3 THEN '2024-03-04' END AS date_to FROM f JOIN supplier ON id = s_suppkey""")
def interest_windows(spark, sf_dir):
    frame = F.get(F.array(*map(F.lit, ["now 7-d", " all ", "today 12-m", "2024-01-02 2024-03-04", "else", "now 1-H"])), (F.col("s_suppkey") % 6).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), trends.time_window(frame).alias("w")).select("id", "w.*")


# --- profiles ---

@query("""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS snippet, url FROM pages), x AS (
  SELECT page_id * 8 AS source_idx, title AS text, 'title' AS field, 3.0::DOUBLE AS weight FROM p UNION ALL SELECT page_id * 8 + 1, snippet, 'snippet', 1.5 FROM p UNION ALL SELECT page_id * 8 + 2, url, 'displayed_link', 1.0 FROM p
  UNION ALL SELECT (1::BIGINT << 60) + s_suppkey, s_name, 'people_also_ask', 2.0 FROM supplier WHERE s_suppkey % 2 = 1)
SELECT source_idx, md5(text) AS digest, field, weight FROM x WHERE text <> ''""")
def profile_of_results(spark, sf_dir):
    p = page_table(spark, sf_dir).select(F.col("page_id").alias("row_idx"), "title", F.col("intro_text").alias("snippet"), F.col("url").alias("displayed_link"), F.lit(None).cast("string").alias("rich_snippet"))
    related = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("related_query"), F.when(F.col("s_suppkey") % 2 == 0, "related_search").otherwise("people_also_ask").alias("type"))
    return profile.result_corpus(p, related, use_related=False).select("source_idx", F.md5("text").alias("digest"), "field", "weight")


@query("""WITH p AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, html FROM pages), x AS (
  SELECT page_id * 1048576 AS source_idx, title AS text, 'crawl_title' AS field, 3.0::DOUBLE AS weight, url FROM p UNION ALL SELECT page_id * 1048576 + 2, html, 'crawl_body', 1.0, url FROM p
  UNION ALL SELECT page_id * 1048576 + 8, h1, 'crawl_heading', 2.0, url FROM p UNION ALL SELECT page_id * 1048576 + 9, 'last', 'crawl_heading', 2.0, url FROM p)
SELECT source_idx, md5(text) AS digest, field, weight, url AS provenance_url FROM x WHERE text <> ''""")
def profile_of_pages(spark, sf_dir):
    p = page_table(spark, sf_dir).select("page_id", "url", "title", "meta_description", F.array("h1", F.lit("last")).alias("headings"), F.col("body").alias("body_text"))
    return profile.page_corpus(p).select("source_idx", F.md5("text").alias("digest"), "field", "weight", "provenance_url")


@query("SELECT page_id AS source_idx, md5(html) AS digest, 'body_text' AS field, 1.0::DOUBLE AS weight, url AS provenance_url FROM pages WHERE html <> ''")
def profile_of_bodies(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    return profile.scraped_corpus(p).select("source_idx", F.md5("text").alias("digest"), "field", "weight", "provenance_url")


@query("SELECT c_custkey * 8 + k AS source_idx, CASE k WHEN 0 THEN '** ' || c_name WHEN 2 THEN c_mktsegment ELSE 'on ' || c_nationkey END AS text, CASE k WHEN 0 THEN 'page_title' WHEN 2 THEN 'h1' ELSE 'body_text' END AS field, CASE k WHEN 0 THEN 3.0 WHEN 2 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM customer CROSS JOIN (SELECT unnest([0, 2, 3]) AS k)")
def profile_of_generated(spark, sf_dir):
    """What follows the colon of a section's name belongs to it, asterisks too."""
    text = F.concat(F.lit("**META_TITLE:** "), "c_name", F.lit("\nmeta_description:\nH1: "), "c_mktsegment", F.lit("\n\nDESCRIPTION:\n on "), "c_nationkey", F.lit(" \n"))
    return profile.generated_corpus(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), text.alias("text"))).select("source_idx", "text", "field", "weight")


@query(f"SELECT ngram, raw_count, doc_frequency FROM ({ORACLES['ngram_rank_2']}) ORDER BY weighted_count DESC, ngram LIMIT 50")
def profile_bigrams(spark, sf_dir):
    p = profile.build_profile(documents_corpus(spark, sf_dir), profile.Settings(ngram_min=2, ngram_max=2))
    return p.ngrams[2].select("ngram", "raw_count", "doc_frequency")


@query(f"SELECT term, tfidf, doc_frequency FROM ({TFIDF_SQL}) WHERE doc_frequency >= 2 ORDER BY tfidf DESC, term LIMIT 50")
def profile_terms(spark, sf_dir):
    p = profile.build_profile(documents_corpus(spark, sf_dir), profile.Settings(ngram_min=2, ngram_max=2))
    return p.tfidf.select("term", r6("tfidf").alias("tfidf"), "doc_frequency")


@query(f"SELECT term FROM (SELECT term FROM ({TFIDF_SQL}) WHERE doc_frequency >= 2 ORDER BY tfidf DESC, term LIMIT 15) UNION SELECT ngram FROM (SELECT ngram FROM ({ORACLES['ngram_rank_2']}) ORDER BY weighted_count DESC, ngram LIMIT 10)")
def profile_candidates(spark, sf_dir):
    return profile.candidate_keywords(profile.build_profile(documents_corpus(spark, sf_dir), profile.Settings(ngram_min=2, ngram_max=2))).select("term")


# parts as generated texts: a title, a heading and a description that repeats both
_PARTS_SQL = f"""x AS (SELECT p_partkey AS text_id, unnest([p_name, p_type, p_name || ' ' || p_name || ' ' || p_type]) AS text, unnest([3.0, 2.5, 1.0])::DOUBLE AS weight FROM part),
t AS (SELECT text_id, weight, {tokens_sql('text')} AS w FROM x), n AS (SELECT text_id, CAST(sum(len(w)) AS BIGINT) AS total, count(*) AS sections FROM t GROUP BY text_id)"""


def part_profiles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    text = F.concat(F.lit("META_TITLE: "), "p_name", F.lit("\nH1: "), "p_type", F.lit("\nDESCRIPTION: "), "p_name", F.lit(" "), "p_name", F.lit(" "), "p_type")
    return profile.generated_profiles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), text.alias("text")), (2,), 3) | {"one": profile.generated_profiles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), text.alias("text")), (1,), 4)["tfidf"]}


@query(f"""WITH {_PARTS_SQL}, g AS (SELECT text_id, weight, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM t),
c AS (SELECT text_id, ngram, weight, count(*) AS k FROM g GROUP BY ALL)
SELECT text_id, 2 AS size, ngram, CAST(sum(k) AS BIGINT) AS raw_count, CAST(sum(k * weight) AS DOUBLE) AS weighted_count, count(*) AS doc_frequency, round(100.0 * sum(k) / any_value(total), 6)::DOUBLE AS density_pct FROM c JOIN n USING (text_id) GROUP BY text_id, ngram
QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY sum(k * weight) DESC, ngram) <= 3""")
def generated_ngrams(spark, sf_dir):
    return part_profiles(spark, sf_dir)["ngrams"].withColumn("density_pct", r6("density_pct"))


@query(f"""WITH {_PARTS_SQL}, g AS (SELECT text_id, weight, len(w) AS l, unnest(w) AS term FROM t), c AS (SELECT text_id, term, weight, l, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT text_id, term, round(sum(k / l::DOUBLE * weight) * (ln((any_value(sections) + 1)::DOUBLE / (count(*) + 1)) + 1), 6) AS tfidf, count(*) AS doc_frequency, CAST(sum(k) AS BIGINT) AS raw_count FROM c JOIN n USING (text_id) GROUP BY text_id, term)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY tfidf DESC, term) <= 4""")
def generated_terms(spark, sf_dir):
    return part_profiles(spark, sf_dir)["one"].withColumn("tfidf", r6("tfidf"))
