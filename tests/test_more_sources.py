from pyspark.sql import functions as F

from lexmill.operators import keyed, sets
from lexmill.sources import html, trends
from lexmill.streaming.ngrams import windowed_ngrams


def test_tables_and_rendered_results(spark):
    page = "<table><tr><th>x</th></tr></table><table><tr><td>2024-01-01</td><td>5</td></tr><tr><td>Jan</td><td>100</td></tr><tr><td>b</td><td>101</td></tr></table>"
    got = trends.table_points(spark.createDataFrame([("p", page)], "page string, html string")).orderBy("time").collect()
    assert [(r.time, r.value) for r in got] == [("0000:000002", 100), ("2024-01-01", 5)]
    page = '<a href="https://a.com/?x=1&amp;y=2"><h3>First title</h3></a><a href="https://a.com/?x=1&amp;y=2"><h3>Again here</h3></a><a href="https://b.com"><span><h3>No</h3></span></a><a href="https://c.com"><div><h3>Third <b>one</b></h3></div></a>'
    got = html.rendered_results(spark.createDataFrame([("k", page)], "keyword string, html string")).orderBy("position").collect()
    assert [(r.position, r.title, r.url) for r in got] == [(1, "First title", "https://a.com/?x=1&y=2"), (2, "Third one", "https://c.com")]
    r = spark.createDataFrame([("Price 1 200 грн, rating: 4.5, in stock",)], "s string").select(html.offer(F.col("s")).alias("o")).first().o
    assert (r.price, r.rating, r.stock) == ("1 200 грн", "4.5", "in stock")
    assert spark.createDataFrame([("please solve the CAPTCHA",)], "s string").filter(html.is_blocked(F.col("s"))).count() == 1


def test_tasks_and_time_windows(spark):
    payload = '{"tasks":[{"result":[{"items":[{"type":"google_trends_graph","data":[{"date_from":"2024-01-01","timestamp":7,"values":[1,2]}]}]}]}]}'
    got = trends.task_points(spark.createDataFrame([(["a", "b"], payload)], "keywords array<string>, payload string")).orderBy("keyword").collect()
    assert [(r.time, r.formatted_time, r.keyword, r.value) for r in got] == [("7", "2024-01-01", "a", 1), ("7", "2024-01-01", "b", 2)]
    got = spark.createDataFrame([("today 12-m",), ("2024-01-01 2024-02-01",)], "t string").select(trends.time_window(F.col("t")).alias("w")).collect()
    assert got[0].w.range == "past_12_months" and (got[1].w.range, got[1].w.date_from, got[1].w.date_to) == (None, "2024-01-01", "2024-02-01")


def test_trend_joins(spark):
    rows = spark.createDataFrame([("Nike",), ("potato",), ("x",)], "keyword string")
    averages = spark.createDataFrame([("nike", 88.0), ("potato", 44.0)], "keyword string, average_interest double")
    got = {r.keyword: (r.average_interest, r.geo) for r in keyed.with_trend_columns(rows, averages, {"geo": "UA"}).collect()}
    assert got == {"Nike": (88.0, "UA"), "potato": (44.0, "UA"), "x": (None, "UA")}
    related = spark.createDataFrame([("query", "top", "A", "1", None, ["k"], 1), ("query", "top", "a", "1", "", ["k"], 2)], "item_type string, rank_type string, label string, value string, topic_type string, source_keywords array<string>, row_idx long")
    assert [r.label for r in sets.related_first(related).collect()] == ["A"]
    index = spark.createDataFrame([("nike", "u", "https://u/x", 3)], "norm_kw string, source_url string, matched_serp_url string, serp_rank int")
    ads = spark.createDataFrame([("Nike", " u "), ("x", None)], "keyword string, source_url string")
    assert {(r.keyword, r.page_url_in_serp, r.serp_rank) for r in keyed.with_match_index(ads, index).collect()} == {("Nike", "https://u/x", 3), ("x", "", None)}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "green tea, green tea"), ("2024-01-01 00:02:00", "green tea")], "ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = windowed_ngrams(stream).writeStream.outputMode("complete").format("memory").queryName("grams").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.ngram, r.raw_count) for r in spark.table("grams").collect()} == {("green tea", 3), ("tea green", 1)}
