import dataclasses
import itertools
import random
import zlib

import numpy as np
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.language_id import identify, learn, viterbi

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("score", StringType())])
SOUNDS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["str", "eng", "ung", "cht"], "cc": ["да", "не", "мо", "ри"]}


def words(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows():
    r = random.Random(2)
    return [(i, words(r, k := r.choice(list(SOUNDS)), r.randint(3, 40)).capitalize() + ".", k) for i in range(400)]


def test_held_out_accuracy_and_spans(spark):
    r = random.Random(9)
    mixed = words(r, "aa", 12) + ", " + words(r, "bb", 5) + ". " + words(r, "cc", 3)
    data = rows() + [(1000, None, "aa"), (1001, "12 -- !", "aa"), (1002, "", None), (1003, mixed, None), (None, "kalo mita", "bb"), (0, "strung", None)]
    df = spark.createDataFrame([(*x, "clash") for x in data], DOCS).repartition(3)
    model = learn(df)
    got = identify(df, model).collect()
    assert len(got) == len(data)
    truth = {i: k for i, _, k in rows()}
    tested = [x for x in got if x.doc_id in truth and x.doc_id and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(tested) > 40 and sum(x.lang_pred == truth[x.doc_id] for x in tested) / len(tested) > 0.97
    by = {x.doc_id: x for x in got}
    assert [(by[i].lang_pred, by[i].score, by[i].spans) for i in (1000, 1001, 1002)] == [("und", 0.0, [])] * 3
    assert [s.lang for s in by[1003].spans] == ["aa", "bb", "cc"] and by[1003].lang_pred == "aa" and 0 < by[1003].score < 1
    spans = by[1003].spans
    assert spans[0].start == 0 and mixed[spans[1].start : spans[1].end] == mixed.split(", ")[1].split(".")[0] and spans[2].end == len(mixed)


def test_learns_nothing_from_held_out(spark):
    data = [x for x in rows() if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert learn(spark.createDataFrame([(*x, "") for x in data], DOCS)).languages == []
    df = spark.createDataFrame([(*x, "") for x in data], DOCS)
    assert {x.lang_pred for x in identify(df, learn(df)).collect()} == {"und"}
    assert identify(df.limit(0), learn(df)).count() == 0


def test_viterbi_as_brute_force():
    r = np.random.default_rng(3)
    first = np.array([0, 4, 4, 9, 10])
    scores = r.normal(size=(10, 3)).astype(np.float32)
    got = viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        worth = {p: sum(scores[a + i, k] for i, k in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:])) for p in itertools.product(range(3), repeat=b - a)}
        assert np.isclose(worth[tuple(got[a:b].tolist())], max(worth.values()), atol=1e-5)


def test_very_long_text_and_ties(spark):
    """A text of a million letters is judged whole; equal letters of two languages go to the first by name."""
    df = spark.createDataFrame([(*x, "") for x in rows()], DOCS)
    model = learn(df)
    some = {k: next(t for _, t, lang in rows() if lang == k and t) for k in ("aa", "bb")}
    long = (some["aa"] + " ") * (700_000 // len(some["aa"])) + (some["bb"] + " ") * (300_000 // len(some["bb"]))
    got = identify(spark.createDataFrame([(1, long, None, ""), (2, "x" * 1_000_000, None, "")], DOCS), model).collect()
    by = {x.doc_id: x for x in got}
    assert by[1].lang_pred == "aa" and 0.6 < by[1].score < 0.8 and {s.lang for s in by[1].spans} >= {"aa", "bb"}
    assert by[2].lang_pred in model.languages and by[2].score == 1.0
    blank = dataclasses.replace(model, weights=model.weights * 0)
    assert identify(spark.createDataFrame([(1, some["bb"], None, "")], DOCS), blank).first().lang_pred == "aa"
