import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.suffix_dedup import remove_repeats

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("found", StringType())])


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        hit = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                hit[i : i + width] = [True] * width
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((doc_id, len(t), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(t, hit) if not h)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 4)))
    text = lambda n: "".join(word() for _ in range(n))
    passage, line = text(40), text(12)
    rows = [(i, text(r.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, text(r.randint(0, 40)) + passage + text(r.randint(0, 40))) for i in range(30)]
    rows += [(200 + i, text(20) + line + text(20)) for i in range(20)]
    rows += [(300 + i, passage) for i in range(5)] + [(300, passage), (None, passage), (400, None), (401, ""), (402, "a" * 300), (403, "ab\0" * 100), (404, "\n".join([line] * 9))]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 4096), (2, 3)])
def test_as_brute_force(spark, seed, group):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(5)
    got = [tuple(x)[:5] for x in remove_repeats(df, width=40, gram=20, group=group).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 40), key=str)


def test_kept_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 50, ""), (2, "yz" + "x" * 50, "")], SCHEMA)
    got = {x.doc_id: bytes(x.kept) for x in remove_repeats(df, width=40, gram=20).collect()}
    assert got == {1: b"", 2: b"yz"}
    assert remove_repeats(df.limit(0)).count() == 0
