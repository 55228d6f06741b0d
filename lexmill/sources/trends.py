"""Interest payloads of several providers, as tables: points (time, formatted_time, keyword, value), related items and regions.

Payloads come as rows with the keywords they were asked for (an array, in the order of values) and the JSON or CSV text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_even_int
from .serp import first_text

#: First cells of headers of exported CSV files. Fixed values.
HEADERS = ("День", "Day", "Ден", "Тиждень", "Тиж.", "Неделя", "Неделю", "Нед.", "Week", "Місяць", "Міс.", "Месяц", "Месяцев", "Мес.", "Month")


def without_prefix(text: Column) -> Column:
    """JSON text without the )]}' in front of it."""
    return F.regexp_replace(F.trim(text), r"^\)\]\}',?\s*", "")


def _json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json(without_prefix(F.col("payload"))))


def _number(v: Column, path: str) -> Column:
    return half_even_int(F.try_variant_get(v, path, "string"))


def _named(rows: DataFrame) -> DataFrame:
    """A row for each keyword with its place k."""
    return rows.select("*", F.posexplode("keywords").alias("k", "keyword"))


def widget_points(payloads: DataFrame) -> DataFrame:
    """default.timelineData: values by the place of the keyword."""
    rows = _json(payloads).select("keywords", F.explode(F.try_variant_get("v", "$.default.timelineData", "array<variant>")).alias("e"))
    rows = _named(rows.select("keywords", first_text(F.col("e"), ("time",)).alias("time"), first_text(F.col("e"), ("formattedTime", "formattedAxisTime")).alias("formatted_time"), F.try_variant_get("e", "$.value", "array<string>").alias("values")))
    return rows.select("time", "formatted_time", "keyword", half_even_int(F.get("values", F.col("k"))).alias("value"))


def widget_related(payloads: DataFrame, topics: bool = False) -> DataFrame:
    """default.rankedList: label, value (text), rank_type, item_type, topic_type, rising."""
    lists = _json(payloads).select("keywords", F.posexplode(F.try_variant_get("v", "$.default.rankedList", "array<variant>")).alias("i", "l"))
    lists = lists.select("keywords", "i", F.lower(first_text(F.col("l"), ("formattedRankType",))).alias("rank_type"), F.posexplode(F.try_variant_get("l", "$.rankedKeyword", "array<variant>")).alias("j", "e"))
    names = ("topic.title", "topic.name", "title") if topics else ("query", "title", "text")
    rows = lists.select(first_text(F.col("e"), names).alias("label"), F.try_variant_get("e", "$.value", "string").alias("value"), F.when(F.col("rank_type") == "", "top").otherwise(F.col("rank_type")).alias("rank_type"), F.lit("topic" if topics else "query").alias("item_type"), (first_text(F.col("e"), ("topic.type",)) if topics else F.lit("")).alias("topic_type"), F.col("rank_type").rlike("rising|breakout").alias("rising"), F.col("keywords").alias("source_keywords"), (F.col("i") * 1000 + F.col("j")).alias("row_idx"))
    return rows.filter("label <> ''")


def widget_regions(payloads: DataFrame) -> DataFrame:
    """default.geoMapData of one keyword: region, value, keyword."""
    rows = _json(payloads).select(F.get("keywords", F.lit(0)).alias("keyword"), F.explode(F.try_variant_get("v", "$.default.geoMapData", "array<variant>")).alias("e"))
    return rows.select(first_text(F.col("e"), ("geoName", "geo", "name")).alias("region"), F.coalesce(_number(F.col("e"), "$.value[0]"), _number(F.col("e"), "$.value")).alias("value"), "keyword").filter("region <> ''")


def timeline_points(payloads: DataFrame) -> DataFrame:
    """interest_over_time.timeline_data: values[].extracted_value, else value."""
    rows = _json(payloads).select("keywords", F.explode(F.try_variant_get("v", "$.interest_over_time.timeline_data", "array<variant>")).alias("e"))
    rows = _named(rows.select("keywords", first_text(F.col("e"), ("timestamp", "time")).alias("time"), first_text(F.col("e"), ("date", "formattedTime", "formatted_axis_time", "timestamp")).alias("formatted_time"), F.try_variant_get("e", "$.values", "array<variant>").alias("values")))
    value = F.get("values", F.col("k"))
    return rows.select("time", "formatted_time", "keyword", F.coalesce(_number(value, "$.extracted_value"), _number(value, "$.value"), _number(value, "$")).alias("value"))


def section_related(payloads: DataFrame, topics: bool = False) -> DataFrame:
    """related_queries or related_topics with top and rising."""
    section = "related_topics" if topics else "related_queries"
    names = ("topic.title", "topic.name", "topic_title") if topics else ("query", "title", "text")
    out = None
    for n, rank in enumerate(("top", "rising")):
        rows = _json(payloads).select("keywords", F.posexplode(F.try_variant_get("v", f"$.{section}.{rank}", "array<variant>")).alias("j", "e"))
        rows = rows.select(first_text(F.col("e"), names).alias("label"), F.try_variant_get("e", "$.value", "string").alias("value"), F.lit(rank).alias("rank_type"), F.lit("topic" if topics else "query").alias("item_type"), (first_text(F.col("e"), ("topic.type", "topic_type")) if topics else F.lit("")).alias("topic_type"), F.lit(rank == "rising").alias("rising"), F.col("keywords").alias("source_keywords"), (F.lit(n * 1000) + F.col("j")).alias("row_idx")).filter("label <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def section_regions(payloads: DataFrame) -> DataFrame:
    rows = _json(payloads).select(F.array_join("keywords", ", ").alias("keyword"), F.explode(F.coalesce(F.try_variant_get("v", "$.interest_by_region.geo_map_data", "array<variant>"), F.try_variant_get("v", "$.interest_by_region", "array<variant>"))).alias("e"))
    return rows.select(first_text(F.col("e"), ("location", "geoName", "name", "geo")).alias("region"), F.coalesce(_number(F.col("e"), "$.extracted_value"), _number(F.col("e"), "$.value"), _number(F.col("e"), "$.values[0].extracted_value")).alias("value"), "keyword").filter("region <> ''")


def task_items(payloads: DataFrame) -> DataFrame:
    """tasks[].result[].items[] with their type: type, item (variant), keywords."""
    rows = _json(payloads).select("keywords", F.explode(F.try_variant_get("v", "$.tasks", "array<variant>")).alias("t"))
    rows = rows.select("keywords", F.explode(F.try_variant_get("t", "$.result", "array<variant>")).alias("r"))
    rows = rows.select("keywords", first_text(F.col("r"), ("type",)).alias("outer"), F.explode(F.try_variant_get("r", "$.items", "array<variant>")).alias("item"))
    return rows.select("keywords", F.coalesce(F.nullif(first_text(F.col("item"), ("type",)), F.lit("")), F.col("outer")).alias("type"), "item")


def task_points(payloads: DataFrame) -> DataFrame:
    """Graph items of tasks: data[] with date_from, date_to and values."""
    rows = task_items(payloads).filter(F.col("type").isin("google_trends_graph", "graph")).select("keywords", F.explode(F.try_variant_get("item", "$.data", "array<variant>")).alias("e"))
    rows = _named(rows.select("keywords", first_text(F.col("e"), ("timestamp", "date_from")).alias("time"), first_text(F.col("e"), ("date_from", "timestamp")).alias("formatted_time"), F.try_variant_get("e", "$.values", "array<string>").alias("values")))
    return rows.select("time", "formatted_time", "keyword", half_even_int(F.get("values", F.col("k"))).alias("value"))


def csv_points(files: DataFrame) -> DataFrame:
    """files: file, keyword, content (exported CSV text). After the header, if a line begins with one of HEADERS, every line of a date and a whole
    number, <1% or %… is a point; what isn't a number is 0: file, keyword, line_no, time (the first date), formatted_time, value."""
    lines = files.select("file", "keyword", F.posexplode(F.split(F.regexp_replace("content", "^\ufeff", ""), r"\r?\n")).alias("line_no", "line"))
    cell = lambda i: F.trim(F.regexp_replace(F.coalesce(F.get(F.split("line", ","), i), F.lit("")), '^"|"$', ""))
    lines = lines.withColumn("a", cell(0)).withColumn("b", cell(1))
    heads = lines.filter(F.col("a").isin(*HEADERS)).groupBy("file").agg(F.min("line_no").alias("head"))
    rows = lines.join(heads, "file", "left").filter(F.col("line_no") > F.coalesce("head", F.lit(-1))).filter(F.col("a").rlike(r"\d{4}-\d{2}") & F.col("b").rlike(r"^(\d+$|<1%$|%)"))
    return rows.select("file", "keyword", "line_no", F.coalesce(F.nullif(F.regexp_extract("a", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.col("a")).alias("time"), F.col("a").alias("formatted_time"), F.coalesce(F.col("b").try_cast("int"), F.lit(0)).alias("value"))


def table_points(pages: DataFrame) -> DataFrame:
    """pages: page, html. The first table of a page with two rows at least of a label and a number from 0 to 100: page, time, formatted_time, value.
    A row without a date gets its place as time, 0000:000001 and on."""
    tables = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<table.*?</table>)"), F.lit(1))).alias("t", "table"))
    rows = tables.select("page", "t", F.posexplode(F.regexp_extract_all("table", F.lit(r"(?is)(<tr.*?</tr>)"), F.lit(1))).alias("r", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    rows = rows.withColumn("c", cells).withColumn("formatted_time", F.get("c", F.lit(0))).withColumn("value", F.get("c", F.lit(1)).try_cast("int")).filter(F.col("value").between(0, 100) & (F.col("formatted_time") != ""))
    first = rows.groupBy("page", "t").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("page").agg(F.min("t").alias("t"))
    rows = rows.join(first, ["page", "t"])
    place = F.row_number().over(Window.partitionBy("page").orderBy("r"))
    return rows.select("page", F.coalesce(F.nullif(F.regexp_extract("formatted_time", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.format_string("0000:%06d", place)).alias("time"), "formatted_time", "value")


def time_window(timeframe: Column) -> Column:
    """A struct of range, date_from and date_to for a timeframe: two dates, or a name such as "today 12-m", "now 7-d", "all"."""
    dates = F.regexp_extract_all(timeframe, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    names = {"now 1-H": "past_hour", "now 4-H": "past_4_hours", "now 1-d": "past_day", "now 7-d": "past_7_days", "today 1-m": "past_30_days", "today 3-m": "past_90_days", "today 12-m": "past_12_months", "today 5-y": "past_5_years", "all": "2004_present"}
    named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    two = F.size(dates) == 2
    return F.struct(F.when(~two, F.coalesce(F.try_element_at(named, F.trim(timeframe)), F.lit("past_12_months"))).alias("range"), F.when(two, F.get(dates, F.lit(0))).alias("date_from"), F.when(two, F.get(dates, F.lit(1))).alias("date_to"))
