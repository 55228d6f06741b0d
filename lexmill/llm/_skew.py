"""Joins in which a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import partitions


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], counts: DataFrame | None = None) -> DataFrame:
    """rows, with the columns of table (one row for each key): an inner join by key that no key can pile up in one task.

    A key with more rows than a quarter of a partition's share is dealt over parts: its rows by a hash of the columns by (no
    draw, so a task that is run again deals alike), its table row copied to each part. At most four keys a partition can be
    so common, whatever the data, and only these, with their number of parts, are broadcast. Null keys match nothing.
    counts: key and rows (of that key), if known.
    """
    n = partitions(rows.sparkSession)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")) if counts is None else counts
    per = max(1, -(-rows.count() // (4 * n)))
    heavy = F.broadcast(counts.filter(F.col("rows") > per).select(key, F.ceil(F.col("rows") / per).cast("int").alias("_parts")))
    dealt = rows.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = table.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
