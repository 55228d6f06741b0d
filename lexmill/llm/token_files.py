"""Flat token files, and counts of tokens by document found in them without an index.

A file is nothing but token ids, little endian, each document followed by the end-of-document id. Counting reads blocks of
fixed size, cut anywhere. Each block is searched for separators at once; documents inside a block are then known, and those
that cross blocks are stitched by a prefix scan over one row for each block: the number of separators so far tells which
document a block begins in, the place of the last one how much of that document came before.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import added, largest, prefix_scan
from ._session import lean, open_store, partitions, run_dir, staged, tune

#: Bytes that are tokenised together, and bytes of a file at which the next one is begun.
PART_BYTES, FILE_BYTES = 1 << 20, 256 << 20
#: So much white space on end is tokenised by itself: the pattern goes back over white space, and runs out of stack on a million.
LONG_SPACE = re.compile(r"\s{10000}")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding_of(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding, text: str) -> list[int]:
    """Token ids of a whole text. Every 10,000 characters of white space on end are tokenised by themselves."""
    out, at = [], 0
    for m in LONG_SPACE.finditer(text):
        out += encoding.encode_ordinary(text[at : m.start()]) + encoding.encode_ordinary(m[0])
        at = m.end()
    return out + encoding.encode_ordinary(text[at:])


def _writer(ranks, pattern: str, path: str, end: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        store, root = open_store(path)
        stop = np.array([end], kind).tobytes()
        out, name, ordinal, size = None, "", 0, 0
        try:
            for batch in batches:
                ids = batch.column(0)
                texts = batch.column(1).to_pylist()
                names, places, sizes = [], [], []
                for text in texts:
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, ordinal, size = f"{uuid.uuid4().hex}.bin", 0, 0
                        out = store.open_output_stream(f"{root}/{name}")
                    tokens = np.array(encode_text(encoding, text), kind).tobytes() + stop if text else stop
                    out.write(tokens)
                    size += len(tokens)
                    names.append(name)
                    places.append(ordinal)
                    sizes.append(size)
                    ordinal += 1
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(places, pa.int64()), ids, pa.array(sizes, pa.int64())], ["file", "ordinal", "doc_id", "bytes"])
        finally:
            if out is not None:
                out.close()

    return write


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end: int = 50256, kind: str = "<u2") -> tuple[str, DataFrame]:
    """Tokenise every whole text into flat files in the shared folder. docs: doc_id, text.

    Returns the folder and a table of what was written where: file, ordinal, doc_id, bytes (of the file so far). A task that
    is run again writes new files; only those of tasks that ended well are in the table. Null and empty texts are documents
    of no tokens. end must be no id of the vocabulary, and all ids must fit kind, else ValueError.
    """
    import public_tokenizers

    spark = docs.sparkSession
    tune(spark)
    ranks = vocabulary_ranks(vocabulary or vocabulary_path())
    if end in set(ranks.values()) or max(end, *ranks.values()) > np.iinfo(kind).max:
        raise ValueError("end is an id of the vocabulary, or ids don't fit the kind")
    path = run_dir(spark, "tokens")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    wrote = rows.mapInArrow(lean(_writer(spark.sparkContext.broadcast(ranks), public_tokenizers.PATTERN, path, end, kind)), f"file string, ordinal long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes long")
    return path, staged(wrote, "wrote")


def _counter(path: str, end: int, kind: str, block: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            for file, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    width = np.dtype(kind).itemsize
                    tokens = np.frombuffer(f.read_at(min(block * width, size - at * block * width), at * block * width), kind)
                ends = np.flatnonzero(tokens == end)
                # -1 stands for the block itself: its length and last separator.
                order = np.append(-1, np.arange(len(ends)))
                spot = np.append(len(tokens), ends + at * block)
                n = np.append(len(ends), np.diff(ends, prepend=-1) - 1)
                last = np.append(ends[-1] + at * block if len(ends) else -1, np.full(len(ends), -1))
                yield pa.record_batch([pa.array([file] * len(order), pa.string()), pa.array(np.full(len(order), at)), pa.array(order), pa.array(spot), pa.array(n), pa.array(last)], ["file", "block", "nth", "spot", "n", "last"])

    return count


def count_tokens(spark: SparkSession, path: str, files: DataFrame, end: int = 50256, kind: str = "<u2", block: int = 4 << 20) -> DataFrame:
    """Documents of flat token files and their tokens. files: file (below path), bytes. block: tokens read at a time.

    Returns file, ordinal (place of the document in its file), start (token where it begins), n_tokens (without the end) and
    ended. Tokens after the last separator are a document that hasn't ended; an empty file has none.
    """
    tune(spark)
    width = np.dtype(kind).itemsize
    blocks = files.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (block * width)).cast("long"))).alias("block"), "bytes")
    found = staged(blocks.repartition(partitions(spark), "file", "block").mapInArrow(lean(_counter(path, end, kind, block)), "file string, block long, nth long, spot long, n long, last long"), "blocks")
    heads = prefix_scan(found.filter("nth = -1").select("file", "block", "n", "last", F.col("spot").alias("size")), ["file"], ["block"], {"before": added("n"), "stop": largest("last", -1)})
    heads = heads.select(F.col("file").alias("f"), F.col("block").alias("b"), "before", "stop", "n", "last", "size")
    docs = found.filter("nth >= 0").join(heads.drop("n", "last", "size"), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    # the first document to end in a block began after the last separator of the blocks before
    n = F.when(F.col("nth") == 0, F.col("spot") - F.col("stop") - 1).otherwise(F.col("n"))
    docs = docs.select("file", (F.col("before") + F.col("nth")).alias("ordinal"), (F.col("spot") - n).alias("start"), n.alias("n_tokens"), F.lit(True).alias("ended"))
    whole = heads.groupBy(F.col("f").alias("file")).agg(F.sum("n").alias("ordinal"), (F.max("last") + 1).alias("start"), F.max(F.col("b") * block + F.col("size")).alias("length"))
    rest = whole.filter("length > start").select("file", "ordinal", "start", (F.col("length") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(rest)


def document_tokens(docs: DataFrame, vocabulary: str | None = None, end: int = 50256, kind: str = "<u2", block: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, file and start of each row of docs, counted in the flat files it was written to; see write_token_files()."""
    path, wrote = write_token_files(docs, vocabulary, end, kind)
    files = wrote.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return count_tokens(docs.sparkSession, path, files, end, kind, block).join(wrote.drop("bytes"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
