"""N-gram counts of a stream of texts by event time: an addition, nothing of it is asked for elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.corpus import grams


def windowed_ngrams(stream: DataFrame, size: int = 2, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """stream: ts, text. window, ngram, raw_count and weighted by nothing; texts later than late are dropped by the watermark."""
    rows = stream.withWatermark("ts", late).select("ts", F.explode(F.array(tokens("text"))).alias("tokens"))
    rows = rows.select("ts", F.explode(grams(F.col("tokens"), size)).alias("ngram"))
    return rows.groupBy(F.window("ts", window).alias("window"), "ngram").agg(F.count(F.lit(1)).alias("raw_count"))
