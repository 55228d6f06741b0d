import hashlib
import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.decontaminate import contamination

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("item_id", LongType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("doc_id", LongType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size):
    out = []
    for d, t in docs:
        w = words(t)
        hit, names = [False] * len(w), set()
        for i, x in items:
            x = words(x)
            for win in [x[k : k + size] for k in range(len(x) - size + 1)] if len(x) >= size else [x] if x else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit[k : k + len(win)] = [True] * len(win)
                        names.add("" if i is None else str(i))
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 0])
def test_as_brute_force(spark, block):
    r = random.Random(3)
    vocabulary = ["a", "bé", "C3", "dog", "ß"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(20)] + [(100, "solo"), (101, "two words"), (3, "another text of item 3 goes on and on for ten"), (None, "no id here"), (7, None), (8, ".,;"), (9, "two words")]
    docs = [(i, text(r.randint(0, 80))) for i in range(60)] + [(200 + i, text(5) + items[i][1] + text(5)) for i in range(20)]
    docs += [(300, None), (301, ""), (302, "SOLO"), (303, "two\nWords two words"), (303, "two\nWords two words"), (304, items[0][1] * 3), (None, "no id HERE")]
    docs += [(305, "two"), (306, "words"), (307, text(20_000) + items[2][1] + text(20_000))]
    docs += [(400 + i, items[5][1]) for i in range(150)]  # one passage that very many have
    df = spark.createDataFrame([(*x, 1) for x in docs], DOCS).repartition(4)
    got = contamination(df, spark.createDataFrame([(*x, 1) for x in items], ITEMS), 10, block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items, 10), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "x", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert [x.contaminated for x in contamination(docs, items).collect()] == [False]
    assert contamination(docs.limit(0), items).count() == 0
