"""The enrichment run: keywords, metrics, search results and interest in one table, and the crawl report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keyed, signals
from ..operators.crawl import crawl
from ..stores import Checkpoints
from .profile import Profile, Settings, build_profile, candidate_keywords, page_corpus

ADS_COLUMNS = {"source_url": "string", "keyword": "string", "avg_monthly_searches": "bigint", "competition": "string", "competition_index": "bigint", "low_cpc": "double", "high_cpc": "double", "cpc_currency": "string", "months_with_data": "bigint"}


@dataclass
class Inputs:
    """Tables that stand for what is fetched elsewhere; each may be missing."""

    keywords: DataFrame  # keyword, source_url
    metrics: DataFrame | None = None  # raw metrics by keyword, language and batch: see keyed.metric_buckets()
    serp: DataFrame | None = None  # see keyed.serp_per_keyword()
    points: DataFrame | None = None  # see keyed.merged_interest()
    currency: str | None = None


def run_enrichment(inputs: Inputs, checkpoints: Checkpoints | None = None) -> DataFrame:
    """Keywords with metrics, then results and interest. Every step is a checkpoint if checkpoints are given, and is not made again."""

    def step(name: str, make) -> DataFrame | None:
        if checkpoints is None:
            return make()
        if checkpoints.is_done(name):
            return checkpoints.load(name)
        rows = make()
        return None if rows is None else checkpoints.save(name, rows)

    def ads() -> DataFrame:
        base = inputs.keywords.select("source_url", "keyword")
        if inputs.metrics is None:
            return keyed.canonical(base, ADS_COLUMNS)
        months = keyed.months_with_data(keyed.monthly_volumes(inputs.metrics))
        buckets = keyed.metric_buckets(inputs.metrics).join(months, "keyword", "left")
        return keyed.canonical(keyed.with_metrics(base, buckets), ADS_COLUMNS).withColumn("cpc_currency", F.lit(inputs.currency).cast("string"))

    rows = step("ads", ads)
    averages = step("trends", lambda: None if inputs.points is None else keyed.interest_averages(keyed.merged_interest(inputs.points)))
    return step("merged", lambda: keyed.enriched(rows, inputs.serp, averages))


@dataclass
class CrawlReport:
    pages: DataFrame
    profile: Profile
    signals: DataFrame
    titles: DataFrame
    overlap: DataFrame
    prints: DataFrame
    candidates: DataFrame


def crawl_report(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 50, settings: Settings | None = None) -> CrawlReport:
    """pages: page_id, url, title, meta_description, headings, body_text, links (array). Those reached from seeds (url, seq), with a profile and signals."""
    links = pages.select("url", F.explode("links").alias("target"))
    reached = pages.join(crawl(links, seeds, max_depth, max_pages).select("url", "depth"), "url")
    flat = reached.select("page_id", "url", "title", "meta_description", F.get("headings", F.lit(0)).alias("h1"), F.substring("body_text", 1, 320).alias("intro_text"), F.col("body_text").alias("body"))
    profile = build_profile(page_corpus(reached), settings or Settings(relax=False, tfidf_min_df=1))
    return CrawlReport(reached, profile, signals.content_effort(signals.page_text_signals(flat)), signals.title_alignment(flat), signals.topical_overlap(flat), signals.simhash64(flat.select("page_id", F.col("body").alias("text")), "page_id"), candidate_keywords(profile))
