"""More queries of the catalogue: joins of reports, inputs, URLs seen from pages, prompts and generated texts with inputs that vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _DOMAIN_SQL, _GEN_SQL, _HOST_SQL, _SOURCES_SQL, ORACLES, TOKENS_SQL, document_tokens, page_table, points, query, r6, serp_table, source_urls, table, tokens_sql
from .functions import urls
from .functions.text import cut_at_space, filled_prompt, half_even_int, redacted, rich_snippet, selection_key, without_suffix, without_tags, without_thinking
from .operators import corpus, keyed, quality, sets
from .plans.profile import report_sheet
from .sources import inputs

# --- joins by keyword: customers as keywords, suppliers as metrics of which some keywords repeat ---

_BASE_SQL = "base AS (SELECT c_custkey AS id, 's' || c_nationkey AS source_url, 'k' || c_custkey % 60 AS keyword FROM customer), m AS (SELECT 'k' || s_suppkey % 40 AS keyword, s_acctbal AS price, s_suppkey AS seq FROM supplier)"


def base_and_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), "c_nationkey").alias("source_url"), F.concat(F.lit("k"), F.col("c_custkey") % 60).alias("keyword"))
    metrics = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey") % 40).alias("keyword"), F.col("s_acctbal").alias("price"), F.col("s_suppkey").alias("seq"), F.lit("not this").alias("source_url"))
    return base, metrics


@query(f"WITH {_BASE_SQL} SELECT id, source_url, keyword, price, seq FROM base LEFT JOIN m USING (keyword)")
def metrics_all_rows(spark, sf_dir):
    return keyed.with_metrics(*base_and_metrics(spark, sf_dir)).select("id", "source_url", "keyword", "price", "seq")


@query(f"WITH {_BASE_SQL}, f AS (SELECT keyword, arg_min(price, seq) AS price, min(seq) AS seq FROM m GROUP BY keyword) SELECT id, source_url, keyword, price, seq FROM base LEFT JOIN f USING (keyword)")
def metrics_first_row(spark, sf_dir):
    return keyed.with_metrics(*base_and_metrics(spark, sf_dir), order="seq").select("id", "source_url", "keyword", "price", "seq")


@query(f"WITH i AS ({ORACLES['match_index']}), {_SOURCES_SQL}, a AS (SELECT source_pos AS id, CASE WHEN source_pos % 3 = 0 THEN ' ' || source_url || ' ' ELSE source_url END AS source_url, (['EN', '\"de\"', ' fr ', 'none'])[source_pos % 4 + 1] AS keyword FROM src) SELECT id, a.source_url, a.keyword, coalesce(matched_serp_url, '') AS page_url_in_serp, serp_rank FROM a LEFT JOIN i ON norm_kw = trim(lower(trim(a.keyword)), '\"') AND i.source_url = trim(a.source_url)")
def ads_with_match_index(spark, sf_dir):
    s = source_urls(spark, sf_dir)
    index = keyed.match_index_of(serp_table(spark, sf_dir).withColumnRenamed("keyword", "norm_kw"), s)
    names = F.get(F.array(*map(F.lit, ["EN", '"de"', " fr ", "none"])), (F.col("source_pos") % 4).cast("int"))
    ads = s.select(F.col("source_pos").alias("id"), F.when(F.col("source_pos") % 3 == 0, F.concat(F.lit(" "), "source_url", F.lit(" "))).otherwise(F.col("source_url")).alias("source_url"), names.alias("keyword"))
    return keyed.with_match_index(ads, index).select("id", "source_url", "keyword", "page_url_in_serp", F.col("serp_rank").cast("long").alias("serp_rank"))


_POINTS_AVG_SQL = "avgs AS (SELECT CASE WHEN user_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS keyword, avg(CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END) AS v FROM events GROUP BY 1)"


@query(f"""WITH {_POINTS_AVG_SQL}, lo AS (SELECT lower(keyword) AS k, arg_min(v, keyword) AS v FROM avgs GROUP BY 1), c AS (SELECT c_custkey AS id, (['click', 'VIEW', 'Error', 'none'])[c_custkey % 4 + 1] AS keyword FROM customer)
SELECT id, c.keyword, round(coalesce(avgs.v, lo.v), 6) AS average_interest, 'ua' AS geo FROM c LEFT JOIN avgs ON avgs.keyword = c.keyword LEFT JOIN lo ON lo.k = lower(c.keyword)""")
def trend_columns(spark, sf_dir):
    e = points(spark, sf_dir).withColumn("odd", F.lit(0))
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 2).alias("odd"))
    rows = e.drop("odd").join(users, "seq").withColumn("keyword", F.when(F.col("odd") == 0, F.col("keyword")).otherwise(F.upper("keyword")))
    names = F.get(F.array(*map(F.lit, ["click", "VIEW", "Error", "none"])), (F.col("c_custkey") % 4).cast("int"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.alias("keyword"))
    return keyed.with_trend_columns(base, keyed.interest_averages(rows), {"geo": "ua"}).withColumn("average_interest", r6("average_interest"))


@query("WITH s AS (SELECT p_type AS text, max(p_retailprice) AS bm25f_score, max(p_size / 50.0) AS bm25f_coverage FROM part GROUP BY p_type) SELECT p_partkey, p_type AS keyword, bm25f_score, round(bm25f_coverage, 6) AS bm25f_coverage, 'serp' AS cache_kind, 3 AS cache_hits FROM part JOIN s ON text = p_type")
def scores_and_cache_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    scores = p.select(F.col("p_type").alias("text"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 50).alias("query_coverage"))
    rows = keyed.with_bm25f(p.select("p_partkey", F.col("p_type").alias("keyword")), scores).withColumn("bm25f_coverage", r6("bm25f_coverage"))
    return keyed.with_cache_metadata(rows, {"kind": "serp", "hits": 3})


@query("WITH f AS (SELECT url, arg_min(html, page_id) AS html FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN 'u' ELSE url END AS url FROM pages) GROUP BY url) SELECT p.page_id, md5(f.html) AS digest FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'u' WHEN page_id % 7 = 0 THEN 'nowhere' ELSE url END AS url FROM pages) p LEFT JOIN f USING (url)")
def page_content(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, "u")
    rows = p.select("page_id", name.when(F.col("page_id") % 7 == 0, "nowhere").otherwise(F.col("url")).alias("url"))
    return keyed.with_page_content(rows, p.select("page_id", name.otherwise(F.col("url")).alias("url"), F.col("html").alias("text"))).select("page_id", F.md5("page_content").alias("digest"))


# --- inputs ---

@query("""WITH r AS (SELECT c_custkey AS n, c_mktsegment || ',  "' || lower(c_mktsegment) || '", ''' || c_nationkey || ''',, n ' || c_custkey % 30 AS raw FROM customer),
k AS (SELECT n, unnest(string_split(raw, ',')) AS k, unnest(range(len(string_split(raw, ',')))) AS pos FROM r), c AS (SELECT n, pos, regexp_replace(trim(k), '^["'']+|["'']+$', '', 'g') AS keyword FROM k)
SELECT keyword, CAST(pos AS INTEGER) AS pos FROM c WHERE keyword <> '' QUALIFY row_number() OVER (PARTITION BY lower(keyword) ORDER BY n, pos) = 1""")
def seed_keywords(spark, sf_dir):
    raw = F.concat("c_mktsegment", F.lit(',  "'), F.lower("c_mktsegment"), F.lit("\", '"), F.col("c_nationkey").cast("string"), F.lit("',, n "), (F.col("c_custkey") % 30).cast("string"))
    return inputs.seed_keywords(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), order="c_custkey")


@query("""WITH l AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 7 = 0 THEN ' --- ' WHEN c_custkey % 11 = 0 THEN ' ,; ' ELSE c_mktsegment || ' ; ' || c_name || '| ' || c_nationkey || ',' END AS line FROM customer),
k AS (SELECT n, list_filter(list_transform(regexp_split_to_array(line, '[,;|]'), lambda x: trim(x)), lambda x: x <> '') AS k FROM l WHERE trim(line) <> '---')
SELECT CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS group_id, array_to_string(k, '/') AS keywords FROM k WHERE len(k) > 0""")
def keyword_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 7 == 0, " --- ").when(F.col("c_custkey") % 11 == 0, " ,; ").otherwise(F.concat("c_mktsegment", F.lit(" ; "), "c_name", F.lit("| "), F.col("c_nationkey").cast("string"), F.lit(",")))
    return inputs.keyword_groups(c.select(F.col("c_custkey").alias("line_no"), line.alias("line"))).withColumn("keywords", F.array_join("keywords", "/"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(CASE WHEN (p_partkey * 5) % 10 = 5 AND ((p_partkey * 5) // 10) % 2 = 0 THEN (p_partkey * 5) // 10 ELSE round(p_partkey * 0.5) END AS BIGINT) END AS n FROM part")
def numbers_in_text(spark, sf_dir):
    p = F.col("p_partkey")
    text = F.when(p % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.format_number(p * 0.5, 1), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", half_even_int(text).alias("n"))


# --- sets and pages of results ---

_RELATED_SQL = "SELECT l_returnflag AS item_type, l_linestatus AS rank_type, CASE WHEN l_linenumber % 2 = 0 THEN 'MODE ' ELSE 'mode ' END || l_suppkey % 7 AS label, CAST(l_quantity AS BIGINT) % 5 AS value, l_orderkey * 10 + l_linenumber AS row_idx FROM lineitem"


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    label = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "MODE ").otherwise("mode "), (F.col("l_suppkey") % 7).cast("string"))
    return li.select(F.col("l_returnflag").alias("item_type"), F.col("l_linestatus").alias("rank_type"), label.alias("label"), (F.col("l_quantity").cast("long") % 5).alias("value"), F.lit(None).cast("string").alias("topic_type"), F.array(F.lit("k")).alias("source_keywords"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"))


@query(f"SELECT item_type, rank_type, lower(label) AS label, value, min(row_idx) AS row_idx FROM ({_RELATED_SQL}) GROUP BY ALL")
def related_items(spark, sf_dir):
    return sets.related_first(related(spark, sf_dir)).select("item_type", "rank_type", F.lower("label").alias("label"), "value", "row_idx")


@query(f"SELECT lower(label) AS region, item_type AS keyword, value, min(row_idx) AS row_idx FROM ({_RELATED_SQL}) GROUP BY ALL")
def related_regions(spark, sf_dir):
    rows = related(spark, sf_dir).select(F.col("label").alias("region"), F.col("item_type").alias("keyword"), "value", "row_idx")
    return sets.regions_first(rows).select(F.lower("region").alias("region"), "keyword", "value", "row_idx")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def three_pages(spark, sf_dir):
    return sets.page_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)


# --- URLs seen from pages ---

_HREFS = ["/a/b?y=2&x=1#f", "?q=1", "img/x.png", "//other.example.org:8080/z", "", "HTTPS://Up.Example.COM", "mailto:a@b.c"]
_HREF_SQL = f"({_HREFS!r})[page_id % {len(_HREFS)} + 1]"
_ABS_SQL = f"""a AS (SELECT page_id, url AS base, {_HREF_SQL} AS h FROM pages),
b AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(base, '^([^:]+:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(base, '^([^:]+://[^/?#]*)', 1) || h
  WHEN starts_with(h, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || h WHEN h = '' THEN regexp_extract(base, '^([^?#]*)', 1) ELSE regexp_replace(regexp_extract(base, '^([^?#]*)', 1), '([^/:])/[^/]*$', '\\1') || '/' || h END AS u FROM a),
c AS (SELECT page_id, u AS url, regexp_extract(u, '\\?([^#]*)', 1) AS q, regexp_extract(u, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^:/?#]*://[^/?#]*(:[0-9]+)', 1) AS port FROM b)"""


@query(f"WITH {_ABS_SQL} SELECT page_id, CASE WHEN {_HOST_SQL} = '' THEN '' ELSE lower(regexp_extract(url, '^([^:]*://)', 1)) || {_HOST_SQL} || port || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END END AS link FROM c")
def links_of_pages(spark, sf_dir):
    href = F.get(F.array(*map(F.lit, _HREFS)), (F.col("page_id") % len(_HREFS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(href, F.col("url")).alias("link"))


@query(f"WITH h AS (SELECT page_id, {_HOST_SQL} AS h, {_DOMAIN_SQL} AS d FROM pages) SELECT a.page_id, a.h = b.h OR ends_with(a.h, '.' || b.h) OR ends_with(b.h, '.' || a.h) OR a.d = b.d AS same FROM h a JOIN h b ON b.page_id = a.page_id + 1")
def same_domains(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("h"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("h").alias("next"))
    return p.join(after, "page_id").select("page_id", urls.same_domain(F.col("h"), F.col("next")).alias("same"))


@query("""WITH u AS (SELECT s_suppkey AS id, s_suppkey % 8 AS k, s_suppkey // 8 AS n FROM supplier)
SELECT id, CASE k WHEN 0 THEN NOT n % 64 BETWEEN 16 AND 31 WHEN 1 THEN NOT n % 256 BETWEEN 64 AND 127 WHEN 2 THEN true WHEN 6 THEN n % 256 NOT IN (0, 10, 127) AND n % 256 < 224 WHEN 7 THEN n % 256 <> 168 ELSE false END AS safe FROM u""")
def url_safety(spark, sf_dir):
    n = lambda m: (F.floor(F.col("s_suppkey") / 8) % m).cast("string")
    kinds = [F.concat(F.lit("http://172."), n(64), F.lit(".1.1/")), F.concat(F.lit("http://100."), n(256), F.lit(".0.1/x")), F.concat(F.lit("https://host"), n(256), F.lit(".example.com/x")), F.lit("ftp://example.com/"), F.lit("http://localhost:80/"), F.lit("http://db.internal/"), F.concat(F.lit("http://"), n(256), F.lit(".1.1.1/")), F.concat(F.lit("HTTP://192."), n(256), F.lit(".0.1/"))]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), urls.is_safe(F.get(F.array(*kinds), (F.col("s_suppkey") % 8).cast("int"))).alias("safe"))


# --- texts of prompts and answers ---

@query("""WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '<think>' || o_orderpriority || chr(10) || '</think> ' || o_orderstatus WHEN 1 THEN o_orderstatus || '<THINKING>x</Thinking>' || o_orderpriority ELSE ' ' || o_orderpriority || ' ' END AS t FROM orders)
SELECT id, trim(regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gis'), '<thinking>.*?</thinking>', '', 'gis')) AS answer FROM a""")
def answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, pri, st = F.col("o_orderkey") % 3, F.col("o_orderpriority"), F.col("o_orderstatus")
    text = F.when(k == 0, F.concat(F.lit("<think>"), pri, F.lit("\n</think> "), st)).when(k == 1, F.concat(st, F.lit("<THINKING>x</Thinking>"), pri)).otherwise(F.concat(F.lit(" "), pri, F.lit(" ")))
    return o.select(F.col("o_orderkey").alias("id"), without_thinking(text).alias("answer"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def pages_without_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(without_tags(F.col("html"))).alias("digest"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_name AS t, [p_name, p_type, p_size::VARCHAR, p_brand] AS k FROM part), c AS (SELECT *, CASE WHEN length(t) <= 20 THEN t WHEN regexp_replace(substr(t, 1, 20), '\\s+\\S*$', '') = '' THEN substr(t, 1, 20) ELSE regexp_replace(substr(t, 1, 20), '\\s+\\S*$', '') END AS cut FROM p)
SELECT id, 'Use ' || array_to_string(k[1:3], ', ') || ' in: ' || cut || ' / ' || k[4] || ' {other}' AS prompt, cut FROM c""")
def prompts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_name")
    prompt = filled_prompt(F.lit("Use {keywords} in: {content} / {brand} {other}"), {"keywords": F.array("p_name", "p_type", F.col("p_size").cast("string"), "p_brand"), "content": text, "brand": F.col("p_brand")}, 20, 3)
    return p.select(F.col("p_partkey").alias("id"), prompt.alias("prompt"), cut_at_space(text, 20).alias("cut"))


@query("SELECT c_custkey, 'a::kw_' || substr(sha256(lower(c_name) || '||' || lower(c_mktsegment)), 1, 8) AS key FROM customer")
def selection_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", selection_key(F.col("c_name"), F.col("c_mktsegment"), "a").alias("key"))


@query("SELECT c_custkey, 'Price: ' || c_acctbal || ', Market Segment: ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', Nation: ' || c_nationkey ELSE '' END AS shown, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 3 END AS n FROM customer")
def snippets(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    fields = F.create_map(F.lit("nation"), F.when(even, F.col("c_nationkey").cast("string")).otherwise(" "), F.lit("market_segment"), F.col("c_mktsegment"), F.lit("price"), F.col("c_acctbal").cast("string"))
    params = F.map_concat(F.map_filter(fields, lambda k, v: F.trim(v) != ""), F.create_map(F.lit("Api-Key"), F.lit("x"), F.lit("q"), F.lit("y")))
    return table(spark, sf_dir, "customer").select("c_custkey", rich_snippet(fields).alias("shown"), F.size(redacted(params)).alias("n"))


# --- scores with inputs that vary ---

_B, _W = {"src0": 0.5, "src1": 0.1, "src2": 0.9}, {"src0": 2.0, "src3": 0.5}
_QUERY = ["anat", "Thonre", "eron", "leau", "keit"]


@query(f"""
WITH {TOKENS_SQL}, q AS (SELECT unnest({[x.lower() for x in _QUERY]}) AS term), n AS (SELECT count(*) AS N FROM tok), means AS (SELECT field, avg(len(tokens)) AS mean FROM tok GROUP BY field),
per AS (SELECT source_idx, field, len(tokens) AS len, term, len(list_filter(tokens, lambda t: t = term)) AS tf, CASE field {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _B.items())} ELSE 0.75 END::DOUBLE AS b, CASE field {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _W.items())} ELSE 1.0 END::DOUBLE AS fw FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM per GROUP BY term),
part AS (SELECT source_idx, term, fw * tf / (1 - b + b * len / mean) AS w, CASE WHEN df = 0 OR df >= N THEN 0.0 ELSE ln((N - df + 0.5) / (df + 0.5) + 1) END AS idf FROM per JOIN df USING (term) JOIN means USING (field), n WHERE tf > 0)
SELECT source_idx, round(sum(w / (1.5 + w) * idf), 6) AS score, count(*)::DOUBLE / {len(_QUERY)} AS query_coverage FROM part GROUP BY source_idx""")
def bm25f_weighted(spark, sf_dir):
    out = corpus.bm25f(document_tokens(spark, sf_dir), _QUERY, _W, _B, 1.5)
    return out.select("source_idx", r6("score").alias("score"), "query_coverage")


_VARIED_SQL = f"""{_GEN_SQL.replace(" || ' order now' AS meta", " || CASE WHEN page_id % 4 = 0 THEN '' ELSE ' order now' END AS meta")},
e AS (SELECT page_id, 'META_TITLE' AS element, title AS t, keyword, NULL::VARCHAR AS body, h1 FROM g UNION ALL SELECT page_id, 'META_DESCRIPTION', meta, keyword, NULL, h1 FROM g UNION ALL SELECT page_id, 'H1', h1, keyword, NULL, h1 FROM g UNION ALL SELECT page_id, 'DESCRIPTION', body, keyword, 'META_TITLE: ' || title || chr(10) || 'META_DESCRIPTION: ' || meta || chr(10) || 'H1: ' || h1 || chr(10) || 'DESCRIPTION: ' || body, h1 FROM g),
x AS (SELECT *, length(t) AS n, keyword <> '' AND contains(lower(t), keyword) AS present, {tokens_sql('body')} AS w, CASE WHEN page_id % 2 = 0 THEN list_filter([keyword, 'the', 'en'], lambda z: z <> '' AND contains(lower(t), z)) ELSE [] END AS covered, (page_id % 11) / 10.0 AS overlap, (page_id % 7) / 6.0 AS company, CASE WHEN page_id % 3 = 0 THEN h1 END AS given FROM e),
s AS (SELECT page_id AS text_id, element, greatest(0.0, 100.0 - CASE element
 WHEN 'META_TITLE' THEN CASE WHEN n < 50 THEN 20 WHEN n > 60 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT contains(lower(substr(t, 1, 30)), keyword) THEN 15 ELSE 0 END + CASE WHEN len(covered) < 2 THEN 10 ELSE 0 END
 WHEN 'META_DESCRIPTION' THEN CASE WHEN n < 150 THEN 15 WHEN n > 160 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT present THEN 15 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'купить|замовити|buy|order|shop') THEN 0 ELSE 10 END
 WHEN 'H1' THEN CASE WHEN n < 30 THEN 15 WHEN n > 70 THEN 10 ELSE 0 END + CASE WHEN keyword <> '' AND NOT present THEN 20 ELSE 0 END + CASE WHEN coalesce(given, '') <> '' AND trim(t) = trim(given) THEN 15 ELSE 0 END
 ELSE CASE WHEN n < 500 THEN 20 ELSE 0 END + CASE WHEN overlap < 0.3 THEN 15 WHEN overlap > 0.8 THEN 10 ELSE 0 END + CASE WHEN company < 0.5 THEN 15 ELSE 0 END + CASE WHEN len(w) > 0 AND 100.0 * len(list_filter(w, lambda z: z = keyword)) / len(w) > 7 THEN 20 ELSE 0 END END)::DOUBLE AS score,
 round(CASE WHEN page_id % 2 = 0 THEN len(covered) / 3.0 ELSE 0 END, 6)::DOUBLE AS keyword_coverage, CASE element WHEN 'META_TITLE' THEN n BETWEEN 50 AND 60 WHEN 'META_DESCRIPTION' THEN n BETWEEN 150 AND 160 WHEN 'H1' THEN n BETWEEN 30 AND 70 ELSE n >= 500 END AS length_compliant FROM x)"""


def varied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = page_table(spark, sf_dir)
    body = flat(F.regexp_replace(F.regexp_replace("html", "(?s)^.*<article>", ""), "<[^>]+>", " "))
    call = F.when(F.col("page_id") % 4 == 0, "").otherwise(" order now")
    text = F.concat(F.lit("META_TITLE: "), flat("title"), F.lit("\nMETA_DESCRIPTION: "), flat("intro_text"), call, F.lit("\nH1: "), flat("h1"), F.lit("\nDESCRIPTION: "), body)
    keyword = F.lower(F.get(F.split(F.trim("title"), " "), 0))
    rows = p.select(F.col("page_id").alias("text_id"), text.alias("text"), keyword.alias("keyword"), F.when(F.col("page_id") % 2 == 0, F.array(keyword, F.lit("the"), F.lit("en"))).alias("top_ngrams"), F.when(F.col("page_id") % 3 == 0, flat("h1")).alias("meta_title"), ((F.col("page_id") % 11) / 10).alias("tfidf_overlap"), ((F.col("page_id") % 7) / 6).alias("cooccurrence_coverage"))
    return quality.score_elements(rows)


@query(f"WITH {_VARIED_SQL} SELECT * FROM s")
def generated_quality_varied(spark, sf_dir):
    return varied_scores(spark, sf_dir).select("text_id", "element", "score", r6("keyword_coverage").alias("keyword_coverage"), "length_compliant")


@query(f"WITH {_VARIED_SQL}, o AS (SELECT text_id, avg(score) AS overall, count(*) FILTER (length_compliant) AS compliant FROM s GROUP BY text_id) SELECT text_id, round(overall, 6) AS overall, CASE WHEN overall >= 70 THEN 'Good' WHEN overall >= 50 THEN 'Fair' ELSE 'Poor' END AS status, compliant FROM o")
def generated_reports(spark, sf_dir):
    return quality.quality_report(varied_scores(spark, sf_dir)).select("text_id", r6("overall").alias("overall"), "status", "compliant")


# --- selections, source contexts, stems, sheets ---

_PICKS_SQL = "p AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE ' k' || c_custkey % 70 END AS keyword, 's' || c_nationkey || ' ' AS source_url, c_custkey AS row_idx FROM customer), done AS (SELECT 's' || s_nationkey AS source_url, 'k' || s_suppkey % 70 AS keyword, s_acctbal AS searches FROM supplier), f AS (SELECT trim(keyword) AS keyword, trim(source_url) AS source_url, min(row_idx) AS row_idx FROM p WHERE trim(keyword) <> '' GROUP BY 1, 2)"


def selection(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    picks = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" k"), F.col("c_custkey") % 70)).alias("keyword"), F.concat(F.lit("s"), "c_nationkey", F.lit(" ")).alias("source_url"), F.col("c_custkey").alias("row_idx"))
    done = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("source_url"), F.concat(F.lit("k"), F.col("s_suppkey") % 70).alias("keyword"), F.col("s_acctbal").alias("searches"))
    return sets.selection_context(picks, done)


@query(f"WITH {_PICKS_SQL} SELECT source_url, keyword, searches FROM done UNION ALL SELECT source_url, keyword, NULL FROM f ANTI JOIN done USING (source_url, keyword)")
def selection_rows(spark, sf_dir):
    return selection(spark, sf_dir)["rows"].select("source_url", "keyword", "searches")


@query(f"WITH {_PICKS_SQL} SELECT source_url, string_agg(keyword, ' ' ORDER BY row_idx) AS keywords, CAST(count(*) AS INTEGER) AS selected FROM f GROUP BY source_url")
def selection_by_source(spark, sf_dir):
    return selection(spark, sf_dir)["by_source"].withColumn("keywords", F.array_join("keywords", " "))


@query("WITH a AS (SELECT DISTINCT trim([' en', 'de', 'www.x.org', ' ', 'fr'][c_custkey % 5 + 1]) AS keyword, CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE 'https://n' || c_nationkey || '.org/' END AS source_url FROM customer), r AS (SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]+)', 1) AS keyword FROM pages) SELECT keyword, source_url, keyword || '||' || source_url AS source_context_key, page_id FROM a JOIN r USING (keyword) WHERE keyword NOT IN ('', 'www.x.org')")
def results_by_source(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pairs = c.select(F.get(F.array(*map(F.lit, [" en", "de", "www.x.org", " ", "fr"])), (F.col("c_custkey") % 5).cast("int")).alias("keyword"), F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit(" https://n"), "c_nationkey", F.lit(".org/"))).alias("source_url"))
    results = serp_table(spark, sf_dir).select("keyword", F.col("row_idx").alias("page_id"))
    return sets.source_contexts(pairs, results).select("keyword", "source_url", "source_context_key", "page_id")


_ENDS = ["ий", "ность", "тель", "ому", "у", "ами"]


@query(f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 < 2 THEN left('слов', 1 + s_suppkey % 7) || ({_ENDS!r})[s_suppkey % 6 + 1] ELSE 'слово' || s_suppkey % 3 END AS word, CASE WHEN s_suppkey % 7 >= 2 THEN 'слово' || s_suppkey % 3 WHEN length(left('слов', 1 + s_suppkey % 7) || ({_ENDS!r})[s_suppkey % 6 + 1]) <= 4 THEN left('слов', 1 + s_suppkey % 7) || ({_ENDS!r})[s_suppkey % 6 + 1] ELSE left('слов', 1 + s_suppkey % 7) || CASE s_suppkey % 6 WHEN 1 THEN 'но' WHEN 4 THEN 'у' ELSE '' END END AS stem FROM supplier")
def stems(spark, sf_dir):
    k = F.col("s_suppkey")
    end = F.get(F.array(*map(F.lit, _ENDS)), (k % 6).cast("int"))
    word = F.when(k % 7 < 2, F.concat(F.substring(F.lit("слов"), F.lit(1), (1 + k % 7).cast("int")), end)).otherwise(F.concat(F.lit("слово"), (k % 3).cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), word.alias("word"), without_suffix(word).alias("stem"))


@query(f"SELECT domain AS \"Domain\", round_even(avg_position, 1) AS \"Avg Position\", keyword_serp_count || '/' || total_keyword_serps AS \"Keyword SERPs\", total_keyword_serps AS \"Total Keywords\", result_count AS \"Result Count\", total_results AS \"Total Results\" FROM ({ORACLES['domain_metrics']})")
def sheet_of_domains(spark, sf_dir):
    return report_sheet("SERP Domains", keyed.domain_metrics(serp_table(spark, sf_dir)))


@query(f"SELECT 2 AS \"Gram Size\", ngram AS \"N-Gram\", raw_count AS \"Count\", round_even(weighted_count, 4) AS \"Weighted Count\", doc_frequency AS \"DF\", total_word_count AS \"Total Words\", round_even(density_pct, 4) AS \"Density %\" FROM ({ORACLES['ngram_rank_2']})")
def sheet_of_ngrams(spark, sf_dir):
    return report_sheet("N-Grams", corpus.ngrams(document_tokens(spark, sf_dir), 2).withColumn("gram_size", F.lit(2)))
