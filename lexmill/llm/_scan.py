"""Prefix scans that no single key can pile up in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import partitions, staged


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column], str, object]]) -> DataFrame:
    """Add to each row the totals of the rows of its keys that come before it in order.

    totals: name -> (aggregate, how two totals combine, column, total of no rows). Rows are range-partitioned by keys and
    order, so that a key with many rows spans partitions; totals inside a partition and those of the partitions before it,
    one row for each key and partition, are combined. Null keys are a key.
    """
    placed = staged(df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()), "scan")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*before)
    out, sums = placed, placed.groupBy(*keys, "_part").agg(*(f(F.col(c)).alias(f"_{name}") for name, (f, _, c, _) in totals.items()))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_at"), *(F.coalesce(f(F.col(f"_{name}")).over(across), F.lit(none)).alias(f"_{name}") for name, (f, _, _, none) in totals.items()))
    for name, (f, _, c, none) in totals.items():
        out = out.withColumn(name, F.coalesce(f(F.col(c)).over(inside), F.lit(none)))
    on = out["_part"] == sums["_at"]
    for k in keys:
        on = on & out[k].eqNullSafe(sums[f"_{k}"])
    out = out.join(sums, on)
    for name, (_, join, _, _) in totals.items():
        out = out.withColumn(name, join(F.col(f"_{name}"), F.col(name)))
    return out.drop("_part", "_at", *(f"_{k}" for k in keys), *(f"_{n}" for n in totals))


def added(column: str) -> tuple:
    return F.sum, lambda a, b: a + b, column, 0


def largest(column: str, none: int) -> tuple:
    return F.max, lambda a, b: F.greatest(a, b), column, none


def xored(column: str) -> tuple:
    return F.bit_xor, lambda a, b: a.bitwiseXOR(b), column, 0
