"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexmill import catalogue  # noqa: E402
from lexmill.operators import corpus  # noqa: E402

HEADLINES = ("tokens_stats", "ngram_rank_2", "tfidf_terms", "bm25f_rank", "cooccurrence_terms", "simhash64", "page_signals", "topical_overlap", "intent_corpus_type", "domain_metrics", "ads_enriched", "metric_buckets", "trends_merged", "dedupe_first", "url_classify", "match_index", "generated_quality")


def seconds(make) -> float:
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def bm25f_1000(spark: SparkSession):
    """1,000 one-field sources of about eight words, five query terms, k1 1.2, top 100."""
    rows = spark.range(1000).select(F.col("id").alias("source_idx"), F.concat(F.lit("SEO tools and keyword analysis software number "), "id").alias("text"), F.lit("body_text").alias("field"), F.lit(1.0).alias("weight"))
    return corpus.bm25f(corpus.token_table(rows), ["seo", "tools", "keyword", "analysis", "software"], top_n=100)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {"bm25f_1000_cold": seconds(lambda: bm25f_1000(spark)), "bm25f_1000_warm": seconds(lambda: bm25f_1000(spark))}
    found |= {n: seconds(lambda n=n: catalogue.QUERIES[n](spark, sf_dir)) for n in HEADLINES}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
