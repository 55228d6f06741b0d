"""Cache, history and checkpoints as tables."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hours that records of a kind stay valid, and those of any other kind. Fixed values.
TTL_HOURS = {"serp": 168, "ads": 168, "llm_extract": 720, "llm_generate": 720, "crawl": 168, "math": 168, "trends": 24, "model_fetch": 720}
TTL_DEFAULT = 168
SECRET = re.compile(r"(?i)(api.?key|token|secret|password|authorization|cookie)")


def canonical(value: object) -> object:
    """Parameters as they go into a key: texts trimmed and lower-case, lists sorted, keys that name secrets left out."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0])) if not SECRET.search(str(k))}
    if isinstance(value, list | tuple | set):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False))
    return value.strip().lower() if isinstance(value, str) else value


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(canonical(settings), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def cache_key(kind: str, provider: str, params: dict, settings: str = "") -> str:
    return settings_hash({"kind": kind, "provider": provider, "params": params, "settings_hash": settings})


def key_of(request: Column) -> Column:
    """The same for a struct column whose fields are canonical and in order."""
    return F.sha2(F.to_json(request), 256)


def with_expiry(records: DataFrame, ttl_hours: dict[str, int] | None = None, default: int = TTL_DEFAULT) -> DataFrame:
    """records (kind, created_at) with expires_at."""
    hours = F.lit(default)
    for kind, h in (TTL_HOURS if ttl_hours is None else ttl_hours).items():
        hours = F.when(F.col("kind") == kind, h).otherwise(hours)
    return records.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=hours))


def latest(records: DataFrame) -> DataFrame:
    """The last written record of each cache_key, by created_at, then seq. One aggregation: no key's records are sorted."""
    cols = [c for c in records.columns if c != "cache_key"]
    return records.groupBy("cache_key").agg(F.max_by(F.struct(*cols), F.struct("created_at", "seq")).alias("r")).select("cache_key", *(F.col(f"r.{c}").alias(c) for c in cols))


def valid(records: DataFrame, now: Column) -> DataFrame:
    return records.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def newest(records: DataFrame, most: int) -> DataFrame:
    """The most newest records; older ones are evicted."""
    return records.orderBy(F.desc("created_at"), F.desc("seq")).limit(most)


def upserted(records: DataFrame, more: DataFrame, most: int = 10_000) -> DataFrame:
    """records with those of more in place of records with the same key; the most newest stay."""
    return newest(latest(records.unionByName(more, allowMissingColumns=True)), most)


def without(records: DataFrame, condition: Column) -> DataFrame:
    return records.filter(~F.coalesce(condition, F.lit(False)))


def with_hits(records: DataFrame, reads: DataFrame, now: Column) -> DataFrame:
    """records (one for each cache_key; hits, 0 if there is no such column) after reads (cache_key, a row for each look-up): each
    read of a valid record counts as a hit. Expired and missing records aren't hit. Reads are counted before they are joined."""
    counted = reads.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_reads"))
    before = F.coalesce(F.col("hits"), F.lit(0)) if "hits" in records.columns else F.lit(0)
    hit = F.when(F.col("expires_at").isNull() | (F.col("expires_at") >= now), F.coalesce("_reads", F.lit(0))).otherwise(0)
    return records.join(counted, "cache_key", "left").withColumn("hits", (before + hit).cast("long")).drop("_reads")


def cache_stats(records: DataFrame, now: Column) -> DataFrame:
    """kind ("unknown" if null), records, expired and hits (0 without such a column)."""
    hits = F.sum(F.coalesce("hits", F.lit(0))) if "hits" in records.columns else F.lit(0)
    return records.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("expires_at") < now).alias("expired"), hits.cast("long").alias("hits"))


def trimmed_history(entries: DataFrame, now: Column, days: int = 30, most: int | None = None) -> DataFrame:
    """entries: created_at (text), seq, and, where there are cache records among them, record_type and expires_at (text).

    Cache records (record_type cache) stay until they expire; other entries stay for days, and what has no time stays. With days
    of 0 or less nothing is trimmed. most: entries other than cache records that stay at most, the newest."""
    if days <= 0:
        return entries
    old = F.coalesce(F.try_to_timestamp("created_at") < now - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    cache = F.lit(False)
    if "record_type" in entries.columns:
        cache = F.coalesce(F.col("record_type") == "cache", F.lit(False))
        over = F.coalesce(F.try_to_timestamp("expires_at") < now, F.lit(False)) if "expires_at" in entries.columns else F.lit(False)
        old = F.when(cache, over).otherwise(old)
    kept = entries.filter(~old)
    if most is None:
        return kept
    visible = kept.filter(~cache).withColumn("_at", F.try_to_timestamp("created_at")).orderBy(F.desc("_at"), F.desc("seq")).limit(most).drop("_at")
    return visible.unionByName(kept.filter(cache))


class Checkpoints:
    """Step results of a run as Parquet, with a manifest that goes stale when the inputs change. Written through Spark, so any store will do."""

    def __init__(self, spark: SparkSession, path: str, inputs: dict) -> None:
        self.spark, self.path, self.hash = spark, path.rstrip("/"), settings_hash(inputs)

    def _steps(self) -> set[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return set()
        rows = self.spark.read.schema("step string, input_hash string").json(f"{self.path}/done")
        return {r.step for r in rows.collect() if r.input_hash == self.hash}

    def save(self, step: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.hash}/{step}")
        self.spark.createDataFrame([(step, self.hash)], "step string, input_hash string").coalesce(1).write.mode("append").json(f"{self.path}/done")
        return self.load(step)

    def is_done(self, step: str) -> bool:
        return step in self._steps()

    def load(self, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.hash}/{step}")

    def next_incomplete(self, steps: list[str]) -> str | None:
        done = self._steps()
        return next((s for s in steps if s not in done), None)

    def clean(self) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
