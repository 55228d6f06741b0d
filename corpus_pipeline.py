"""Cleaning of documents, stage by stage; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language_id
from lexmill.llm._session import FOLDERS, release, staged
from lexmill.llm.decontaminate import contamination
from lexmill.llm.line_templates import drop_templates
from lexmill.llm.ngram_join import similarity_classes
from lexmill.llm.sampled_pieces import encode_sampled

#: Share of its letters that a text's language must have.
LEAST_SHARE = 0.34
#: A text of which repeated lines make up more than this share of words may be a copy. It is left to the stage that joins copies if one other text has most of it.
COPY_SHARE = 0.5
#: Lines of more words than this are passages, which go from two documents on; shorter ones go from three.
LONG_LINE = 50
#: Words of a shingle, and the Jaccard similarity in percent from which texts are copies.
SHINGLE, PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that none of their names meets one of an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("_extra"))


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_extra")[c].alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and mixtures in which no language has a third of the letters, go."""
    found = language_id.identify(_packed(docs), language_id.learn(docs), carry=("doc_id", "text", "_extra"), spans=False)
    return _unpacked(found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs.columns)


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of linked documents, by row key rk and root (null for texts without words, which link with nothing), and the keys of those that stay."""
    since = len(FOLDERS)
    found = staged(similarity_classes(docs, SHINGLE, PERCENT, row_key=True, links=False), "classes")
    release(docs.sparkSession, since, (found._folder,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    stay = found.filter("root is not null").groupBy("root").agg(first.alias("first")).select(F.col("first.rk").alias("rk"))
    return found, stay.union(found.filter("root is null").select("rk"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first, in DataFrame functions only.

    A text that would lose more than COPY_SHARE of its words is left whole, to the join of copies, only if it shares lines of
    PERCENT of both texts' words with one other document.
    """
    return _unpacked(drop_templates(_packed(docs), most=COPY_SHARE, copies=PERCENT / 100, long=LONG_LINE), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id stays. Texts without words all stay; rows that repeat stay once."""
    _, stay = _classes(docs)
    return _unpacked(_packed(docs).withColumn("_rk", _key()).join(stay.withColumnRenamed("rk", "_rk"), "_rk", "left_semi").dropDuplicates(["_rk"]), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    found = contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("doc_id", "text", "_extra"))
    return _unpacked(found.filter(~F.col("contaminated")), docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of each document, and whether decoding gives the text back."""
    rows = encode_sampled(docs.select("doc_id", "text"), decoded=True)
    return rows.select("doc_id", "ids", "n_tokens", (F.col("decoded") == F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lossless"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminate), ("SentencePiece encoding", pieces)]
#: Language ID and sampled segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = len(FOLDERS)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
            release(spark, since, keep=(FOLDERS[-1],))
    return docs
