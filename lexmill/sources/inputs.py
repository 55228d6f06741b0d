"""Uploaded keyword and URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signals import first_rows


class TooManyRows(ValueError):
    """An upload has more rows, or bytes, than allowed."""


def _limited(rows: DataFrame, most: int | None) -> DataFrame:
    """rows, after a look at most + 1 of them."""
    if most is not None and rows.limit(most + 1).count() > most:
        raise TooManyRows(f"more than {most} rows")
    return rows


def read_lines(spark: SparkSession, path: str, most: int | None = 1000) -> DataFrame:
    """value: the trimmed lines of a text file that aren't blank."""
    return _limited(spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''"), most)


def read_column(spark: SparkSession, path: str, kind: str = "keyword", most: int | None = 1000) -> DataFrame:
    """value: trimmed values of a CSV file's column url, or keyword or keywords, in any case, else the first; null ones are left out."""
    rows = spark.read.csv(path, header=True)
    wanted = ("url",) if kind == "url" else ("keyword", "keywords")
    by_name = {c.strip().lower(): c for c in rows.columns}
    column = next((by_name[w] for w in wanted if w in by_name), rows.columns[0])
    return _limited(rows.select(F.trim(F.col(f"`{column}`")).alias("value")).filter("value is not null"), most)


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;|]"), lambda k: F.trim(k)), lambda k: k != "")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Uploads have a thousand rows; these are numbered in one task."""
    return rows.filter(F.size("keywords") > 0).select((F.row_number().over(Window.orderBy(order))).alias("group_id"), "keywords")


def keyword_groups(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """lines: line and order. A group of keywords for each line but --- and blank ones: group_id from 1, keywords."""
    rows = lines.filter(F.trim("line") != "---").withColumn("keywords", split_keywords(F.col("line")))
    return _numbered(rows, order)


def keyword_groups_of_rows(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Of CSV rows: the column keywords split, or else all cells that aren't blank."""
    cells = [c for c in rows.columns if c != order]
    named = next((c for c in cells if c.strip().lower() == "keywords"), None)
    words = split_keywords(F.col(named)) if named else F.filter(F.transform(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells)), lambda k: F.trim(k)), lambda k: k != "")
    return _numbered(rows.withColumn("keywords", words), order)


def seed_keywords(raw: DataFrame, column: str = "raw", order: str | None = None) -> DataFrame:
    """Comma-separated seeds without quotes around them, in any case the first of equals: keyword, pos. order: the column that rows
    of raw come in, needed where there are several; of rows without an order the text of the row decides."""
    rows = raw.select(F.col(order or column).alias("row"), F.posexplode(F.split(column, ",")).alias("pos", "k")).withColumn("keyword", F.regexp_replace(F.trim("k"), "^[\"']+|[\"']+$", "")).filter("keyword <> ''")
    return first_rows(rows.withColumn("_k", F.lower("keyword")), ["_k"], ["row", "pos", "keyword"]).select("keyword", "pos")
