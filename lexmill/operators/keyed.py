"""Keyed roll-ups and joins of search results, advertising metrics and interest series.

Column names are snake case; report names are given at sinks. Every operator that depends on an order takes an explicit column
for it, and ties are broken by further columns, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_key
from ..functions.urls import displayed_domain, match_domain, match_url

#: Hryvnias for one unit. Rates are data: give a table for others.
CURRENCIES = ("UAH", "USD", "EUR")


def serp_per_keyword(serp: DataFrame, row: str = "row_idx") -> DataFrame:
    """serp: keyword, position (any type), url, displayed_link and row. norm_kw, serp_results, serp_top_position (null if no number) and
    serp_top3_domains: the first three different domains by position (rows without one last, then by row), joined by ", "."""
    rows = serp.select(keyword_key("keyword").alias("norm_kw"), F.col("position").cast("string").try_cast("double").alias("p"), displayed_domain(F.col("displayed_link"), F.col("url")).alias("domain"), F.col(row).alias("r"))
    spot = F.min(F.struct(F.col("p").isNull().alias("none"), "p", "r"))
    domains = rows.groupBy("norm_kw", "domain").agg(spot.alias("spot"), F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    # A keyword has as many rows left as it has domains; three of them are kept before they are gathered.
    ranked = domains.filter("domain <> ''").withColumn("k", F.row_number().over(Window.partitionBy("norm_kw").orderBy("spot"))).filter("k <= 3")
    top = ranked.groupBy("norm_kw").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "domain"))), lambda x: x["domain"]), ", ").alias("serp_top3_domains"))
    sums = domains.groupBy("norm_kw").agg(F.sum("n").cast("long").alias("serp_results"), F.min("p").alias("serp_top_position"))
    return sums.join(top, "norm_kw", "left").withColumn("serp_top3_domains", F.coalesce("serp_top3_domains", F.lit("")))


def _left(ads: DataFrame, right: DataFrame, keyword: str = "keyword") -> DataFrame:
    return ads.withColumn("norm_kw", keyword_key(keyword)).join(right, "norm_kw", "left").drop("norm_kw")


def with_serp(ads: DataFrame, serp: DataFrame | None) -> DataFrame:
    """ads with serp_per_keyword() by normalised keyword; every row of ads stays."""
    return ads if serp is None or "keyword" not in serp.columns or "keyword" not in ads.columns else _left(ads, serp_per_keyword(serp))


def with_trends(ads: DataFrame, averages: DataFrame | None) -> DataFrame:
    """ads with the other columns of averages (keyword, …) by normalised keyword; a keyword repeated there repeats rows of ads."""
    if averages is None or "keyword" not in averages.columns or "keyword" not in ads.columns:
        return ads
    return _left(ads, averages.withColumn("norm_kw", keyword_key("keyword")).drop("keyword"))


def enriched(ads: DataFrame, serp: DataFrame | None, averages: DataFrame | None) -> DataFrame:
    return with_trends(with_serp(ads, serp), averages)


def with_metrics(base: DataFrame, metrics: DataFrame, order: str | None = None, currency: str | None = None) -> DataFrame:
    """base (keyword, source_url) with metrics by the exact keyword; the source_url of metrics is left out. order: metrics are first cut to
    the first row of each keyword in this order. currency: fills cpc_currency where no row has any."""
    right = metrics.drop("source_url")
    if order:
        right = right.withColumn("_k", F.row_number().over(Window.partitionBy("keyword").orderBy(order))).filter("_k = 1").drop("_k")
    return with_currency(base.join(right, "keyword", "left"), currency)


def with_currency(rows: DataFrame, currency: str | None) -> DataFrame:
    if not currency or "cpc_currency" not in rows.columns:
        return rows
    known = rows.agg((F.count("cpc_currency") > 0).alias("_known"))
    return rows.crossJoin(F.broadcast(known)).withColumn("cpc_currency", F.when(F.col("_known"), F.col("cpc_currency")).otherwise(F.lit(currency))).drop("_known")


def canonical(rows: DataFrame, columns: dict[str, str], currency: str | None = None) -> DataFrame:
    """Exactly the columns (name -> type) in order; missing ones are null."""
    return with_currency(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items())), currency)


def metric_buckets(raw: DataFrame, order: str = "seq") -> DataFrame:
    """raw: keyword, searches, competition, competition_index, low_micros, high_micros and order, one row for each language or batch; null is 0.
    keyword, avg_monthly_searches, competition (of the row with the largest index, the last of equals), competition_index, low_cpc, high_cpc."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return raw.groupBy("keyword").agg(F.max(zero("searches")).alias("avg_monthly_searches"), F.max_by("competition", F.struct(zero("competition_index"), F.col(order))).alias("competition"), F.max(zero("competition_index")).alias("competition_index"), (F.max(zero("low_micros")) / 1e6).alias("low_cpc"), (F.max(zero("high_micros")) / 1e6).alias("high_cpc"))


def monthly_volumes(raw: DataFrame) -> DataFrame:
    """raw: keyword, year, month, searches. The largest searches of each month."""
    return raw.groupBy("keyword", "year", "month").agg(F.max("searches").alias("searches"))


def months_with_data(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("keyword").agg(F.count_if(F.col("searches") > 0).alias("months_with_data"))


def converted(rows: DataFrame, rates: DataFrame, columns: list[str], source: str, target: str) -> DataFrame:
    """columns from the currency in column source to target, by rates (currency, uah for one unit). Unknown currencies stay as they are.
    The rates, a row for each currency, are broadcast; as there are fewer than 1,000 currencies, more rows raise ValueError."""
    if rates.limit(1001).count() > 1000:
        raise ValueError("rates must have one row for each currency")
    few = F.broadcast(rates.select(F.col("currency").alias("_c"), F.col("uah").alias("_from")))
    to = F.broadcast(rates.filter(F.col("currency") == target).agg(F.max("uah").alias("_to")))
    out = rows.join(few, rows[source] == F.col("_c"), "left").crossJoin(to)
    known = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    for c in columns:
        out = out.withColumn(c, F.when(known, F.col(c) * F.col("_from") / F.col("_to")).otherwise(F.col(c)))
    return out.withColumn(source, F.when(known, F.lit(target)).otherwise(F.col(source))).drop("_c", "_from", "_to")


def merged_interest(points: DataFrame, order: str = "seq") -> DataFrame:
    """points: time, formatted_time, keyword, value, batch and order. For each time and keyword the last value that isn't null, and all batches."""
    return points.groupBy("time", "formatted_time", "keyword").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col(order))).alias("value"), F.sort_array(F.collect_set("batch")).alias("batches"))


def interest_averages(points: DataFrame) -> DataFrame:
    """keyword and average_interest over values that aren't null (not rounded)."""
    return points.filter("value is not null").groupBy("keyword").agg(F.avg("value").alias("average_interest"))


def interest_wide(points: DataFrame, keywords: list[str]) -> DataFrame:
    """time, formatted_time and a column for each keyword. Of several values of one keyword and time the largest; merged_interest() leaves one."""
    return points.groupBy("time", "formatted_time").pivot("keyword", keywords).agg(F.max("value"))


def first_with_data(results: DataFrame) -> DataFrame:
    """results: request, provider_rank, has_data, failed. For each request the first result by rank with data or without failure, else the first."""
    good = F.col("has_data") | ~F.col("failed")
    return results.withColumn("_k", F.row_number().over(Window.partitionBy("request").orderBy(F.when(good, 0).otherwise(1), "provider_rank"))).filter("_k = 1").drop("_k")


def trends_confidence(results: DataFrame) -> DataFrame:
    """results: request, keyword, has_data, failure (null, empty_data, rate_limit, …), a row for each keyword. request and confidence:
    without data low if all failures are empty_data, blocked with any rate_limit, else low; with some data medium unless a failure
    is of another kind than empty_data, then degraded; medium if all have data."""
    r = results.groupBy("request").agg(F.count_if("has_data").alias("ok"), F.count_if(F.col("failure") == "rate_limit").alias("limited"), F.count_if(F.col("failure").isNotNull() & (F.col("failure") != "empty_data")).alias("other"))
    return r.select("request", F.when((F.col("ok") == 0) & (F.col("limited") > 0), "blocked").when(F.col("ok") == 0, "low").when(F.col("other") > 0, "degraded").otherwise("medium").alias("confidence"))


def is_cacheable(has_data: Column, confidence: Column, limited: Column) -> Column:
    return has_data & ~confidence.isin("blocked", "degraded") & ~limited


def domain_metrics(serp: DataFrame) -> DataFrame:
    """serp: keyword, position, url. domain, avg_position, keyword_serp_count (different keywords), total_keyword_serps, result_count, total_results
    and domain_visibility (percent, not rounded); domains without any numeric position are left out. Rank by keywords desc, position."""
    rows = serp.select("keyword", F.col("position").cast("double").alias("p"), match_domain("url").alias("domain"))
    # distinct keywords inside a domain, counted after one row for each (domain, keyword)
    pairs = rows.filter("domain <> ''").groupBy("domain", "keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.count("p").alias("c"))
    out = pairs.groupBy("domain").agg((F.sum("s") / F.sum("c")).alias("avg_position"), F.count_if(F.coalesce(F.col("keyword"), F.lit("")) != "").alias("keyword_serp_count"), F.sum("n").cast("long").alias("result_count"), F.sum("c").alias("c")).filter("c > 0").drop("c")
    totals = rows.agg(F.countDistinct("keyword").alias("total_keyword_serps"), F.count(F.lit(1)).alias("total_results"))
    return out.crossJoin(F.broadcast(totals)).withColumn("domain_visibility", 100.0 * F.col("result_count") / F.col("total_results"))


def url_targets(sources: DataFrame, order: str = "source_pos") -> DataFrame:
    """sources: source_url and order. The first source of each normalised URL: source_url, normalized_url, domain, order."""
    rows = sources.withColumn("normalized_url", match_url("source_url")).withColumn("domain", match_domain("source_url"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("normalized_url").orderBy(order))).filter("_k = 1").drop("_k")


def classified(results: DataFrame, sources: DataFrame, order: str = "source_pos") -> DataFrame:
    """Each row of results (url, …) with match_type full_url, domain or none, matched_target and matched_domain: the first source of the same
    normalised URL, else the first of the same domain. Two equi-joins on one row for each URL and domain; no pair is formed twice."""
    first = lambda key: sources.select(key.alias("_key"), "source_url", order).filter("_key <> ''").groupBy("_key").agg(F.min_by("source_url", order).alias("_target"))
    full, domain = first(match_url("source_url")), first(match_domain("source_url"))
    rows = results.withColumn("_url", match_url("url")).withColumn("_domain", match_domain("url"))
    rows = rows.join(full.select(F.col("_key").alias("_url"), F.col("_target").alias("_full")), "_url", "left").join(domain.select(F.col("_key").alias("_domain"), F.col("_target").alias("_dom")), "_domain", "left")
    kind = F.when(F.col("_full").isNotNull(), "full_url").when(F.col("_dom").isNotNull(), "domain").otherwise("none")
    target = F.coalesce("_full", "_dom", F.lit(""))
    return rows.withColumn("match_type", kind).withColumn("matched_target", target).withColumn("matched_domain", F.when(kind == "none", "").otherwise(match_domain(target))).drop("_url", "_domain", "_full", "_dom")


def match_index(serp: DataFrame, row: str = "row_idx") -> DataFrame:
    """serp: norm_kw, source_url, url, position and row. For each keyword and source the best result that matches the source: the same URL before
    the same domain, then the lowest rank (a missing one last), then row: norm_kw, source_url, matched_serp_url, match_type, serp_rank, matched_domain."""
    rows = serp.withColumn("source_url", F.trim("source_url")).filter(F.coalesce(F.col("source_url"), F.lit("")) != "")
    full, domain = match_url("url") == match_url("source_url"), (match_domain("url") != "") & (match_domain("url") == match_domain("source_url"))
    rank = F.coalesce(F.col("position").try_cast("int"), F.lit(0))
    rows = rows.select("norm_kw", "source_url", F.col("url").alias("matched_serp_url"), F.when(full, "full_url").when(domain, "domain").alias("match_type"), rank.alias("serp_rank"), match_domain("source_url").alias("matched_domain"), F.col(row).alias("_row")).filter("match_type is not null")
    best = F.struct(F.when(F.col("match_type") == "full_url", 0).otherwise(1), F.when(F.col("serp_rank") > 0, F.col("serp_rank")).otherwise(F.lit(10**9)), "_row")
    cols = ["matched_serp_url", "match_type", "serp_rank", "matched_domain"]
    return rows.groupBy("norm_kw", "source_url").agg(F.min_by(F.struct(*cols), best).alias("b")).select("norm_kw", "source_url", "b.*")


def match_index_of(serp: DataFrame, sources: DataFrame, row: str = "row_idx") -> DataFrame:
    """match_index() of every result with every source, without pairing them: serp: norm_kw, url, position and row; sources: source_url.
    Results come down to the best one of each keyword and URL, and of each keyword and domain, before they meet sources by equality."""
    rank = F.coalesce(F.col("position").try_cast("int"), F.lit(0))
    rows = serp.select("norm_kw", F.col("url").alias("matched_serp_url"), rank.alias("serp_rank"), F.col(row).alias("_row"), match_url("url").alias("full"), match_domain("url").alias("domain"))
    best = F.min_by(F.struct("matched_serp_url", "serp_rank"), F.struct(F.when(F.col("serp_rank") > 0, F.col("serp_rank")).otherwise(F.lit(10**9)), "_row")).alias("b")
    asked = sources.select(F.trim("source_url").alias("source_url")).filter(F.coalesce(F.col("source_url"), F.lit("")) != "").distinct()
    asked = asked.select("source_url", match_url("source_url").alias("full"), match_domain("source_url").alias("domain"))
    kinds = []
    for place, (key, kind) in enumerate((("full", "full_url"), ("domain", "domain"))):
        found = rows.filter((F.col(key) != "") | F.lit(key == "full")).groupBy("norm_kw", key).agg(best)
        told = F.struct(F.col("b.matched_serp_url").alias("matched_serp_url"), F.lit(kind).alias("match_type"), F.col("b.serp_rank").alias("serp_rank"), F.col("domain").alias("matched_domain"))
        kinds.append(asked.join(found, key).select("norm_kw", "source_url", F.lit(place).alias("p"), told.alias("b")))
    return kinds[0].unionByName(kinds[1]).groupBy("norm_kw", "source_url").agg(F.min_by("b", "p").alias("b")).select("norm_kw", "source_url", "b.*")


def with_match_index(ads: DataFrame, index: DataFrame) -> DataFrame:
    """ads with page_url_in_serp ("" if none) and serp_rank by normalised keyword and trimmed source URL."""
    keyed = ads.withColumn("norm_kw", keyword_key("keyword")).withColumn("_source", F.trim(F.coalesce("source_url", F.lit(""))))
    right = index.select("norm_kw", F.col("source_url").alias("_source"), F.col("matched_serp_url").alias("page_url_in_serp"), "serp_rank")
    return keyed.join(right, ["norm_kw", "_source"], "left").drop("norm_kw", "_source").withColumn("page_url_in_serp", F.coalesce("page_url_in_serp", F.lit("")))


def with_trend_columns(rows: DataFrame, averages: DataFrame, constants: dict[str, object], keyword: str = "keyword") -> DataFrame:
    """rows with average_interest by the exact keyword (of a keyword that averages repeats, the largest), else by its lower case, and constant columns."""
    exact = averages.groupBy(F.col("keyword").alias("_e")).agg(F.max("average_interest").alias("_ev"))
    lower = averages.groupBy(F.lower("keyword").alias("_l")).agg(F.min_by("average_interest", F.struct("keyword", -F.col("average_interest"))).alias("_lv"))
    out = rows.join(exact, rows[keyword] == exact["_e"], "left").join(lower, F.lower(rows[keyword]) == lower["_l"], "left")
    return out.withColumn("average_interest", F.coalesce("_ev", "_lv")).drop("_e", "_ev", "_l", "_lv").withColumns({k: F.lit(v) for k, v in constants.items()})


def with_bm25f(rows: DataFrame, scores: DataFrame, keyword: str = "keyword") -> DataFrame:
    """rows with bm25f_score and bm25f_coverage of the source whose text is the keyword; scores: text, score, query_coverage."""
    best = scores.groupBy(F.col("text").alias("_t")).agg(F.max("score").alias("bm25f_score"), F.max("query_coverage").alias("bm25f_coverage"))
    return rows.join(best, rows[keyword] == best["_t"], "left").drop("_t")


def with_page_content(rows: DataFrame, pages: DataFrame, order: str = "page_id") -> DataFrame:
    """rows with page_content of the first page of their url."""
    first = pages.groupBy("url").agg(F.min_by("text", order).alias("page_content"))
    return rows.join(first, "url", "left")


def with_cache_metadata(rows: DataFrame, metadata: dict[str, object]) -> DataFrame:
    return rows.withColumns({f"cache_{k}": F.lit(v) for k, v in metadata.items()})
