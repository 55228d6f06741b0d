import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.token_files import count_tokens, document_tokens, vocabulary_path, vocabulary_ranks, write_token_files

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("file", StringType())])


def rows():
    r = random.Random(8)
    out = [(i, "".join(r.choice(["the ", "é", "日", "\n", "<|endoftext|>", "words "]) for _ in range(r.randint(0, 60)))) for i in range(80)]
    return [*out, (100, None), (101, ""), (None, "null id"), (5, "again"), (5, "again"), (102, "x" * 3000)]


@pytest.mark.parametrize("block", [4 << 20, 7, 1])
def test_as_brute_force(spark, block):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary_ranks(vocabulary_path()), special_tokens={})
    df = spark.createDataFrame([(*x, "clash") for x in rows()], DOCS).repartition(3)
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in document_tokens(df, block=block).collect()))
    assert got == sorted((i is None, i or 0, len(e.encode_ordinary(t or ""))) for i, t in rows())
    assert document_tokens(df.limit(0)).count() == 0


def test_foreign_files(spark, tmp_path):
    """Files of others: empty documents, no end at the end, nothing but separators."""
    files = {"a": [9, 9, 1, 2, 3, 9, 4], "b": [9], "c": [5, 6, 7, 8], "d": []}
    for name, ids in files.items():
        np.array(ids, "<u4").tofile(tmp_path / name)
    table = spark.createDataFrame([(n, 4 * len(x)) for n, x in files.items()], "file string, bytes long")
    for block in (2, 100):
        got = {(x.file, x.ordinal): (x.start, x.n_tokens, x.ended) for x in count_tokens(spark, f"file://{tmp_path}", table, 9, "<u4", block).collect()}
        assert got == {("a", 0): (0, 0, True), ("a", 1): (1, 0, True), ("a", 2): (2, 3, True), ("a", 3): (6, 1, False), ("b", 0): (0, 0, True), ("c", 0): (0, 4, False)}


def test_end_must_be_free(spark, tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([(1, "ab", "")], DOCS)
    with pytest.raises(ValueError):
        write_token_files(df, str(tmp_path / "v"), end=7)
    assert document_tokens(df, str(tmp_path / "v"), end=256).first().n_tokens == 2


def test_white_space_without_end(spark):
    from lexmill.llm.token_files import encode_text, encoding_of

    e = encoding_of(vocabulary_ranks(vocabulary_path()), P.PATTERN)
    for t in ("", " " * 9_999 + "a", "a" + " " * 10_000, " " * 1_000_000 + "b c", "x" * 300_000):
        assert e.decode(encode_text(e, t)) == t
    assert encode_text(e, "a  b\n\n c") == e.encode_ordinary("a  b\n\n c")
    got = document_tokens(spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {1: len(encode_text(e, " " * 1_000_000)), 2: 2}
