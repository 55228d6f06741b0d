import itertools
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm import line_templates
from lexmill.llm.line_templates import drop_templates, oracle

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("leaf", StringType()), StructField("n_lines", StringType())])


def brute(rows, min_docs=3, depth=4, similarity=0.7, most=1.0, long=50):
    def tokens(line):
        raw = [t for t in re.split("[ \t\x0b\f\r]+", line) if t]
        return tuple(raw) if all(re.search("[0-9]", t) for t in raw) else tuple("<*>" if re.search("[0-9]", t) else t for t in raw)

    def templates(x):
        out, may = [x], (100 - round(100 * similarity)) * len(x) // 100
        if may and len(x) > depth and not all(re.search("[0-9]", t) for t in x):
            wide = max(1, may // 2)
            n = -(-(len(x) - depth) // wide)
            pairs = [(a, a) for a in range(n)] if may < 2 or n < 2 else list(itertools.combinations(range(n), 2))
            out += [(ab, *(t if i < depth or (i - depth) // wide not in ab else None for i, t in enumerate(x))) for ab in pairs]
        return out

    docs = {(d, t): [tokens(x) for x in t.split("\n")] for d, t in rows if t is not None}
    where = defaultdict(set)
    for k, ls in docs.items():
        for x in ls:
            for y in templates(x) if x else ():
                where[y].add(k)
    first = lambda ks: min(ks, key=lambda k: (k[0] is None, k[0] or 0))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines, keep, gone = t.split("\n"), [], 0
        for line, x in zip(lines, docs[d, t]):
            often = [where[y] for y in templates(x) if len(where[y]) >= min_docs or len(where[y]) > 1 and len(x) > long] if x else []
            drop = any((d, t) != first(ks) for ks in often)
            gone += len(x) if drop else 0
            keep += [] if drop else [line]
        if gone > most * sum(map(len, docs[d, t])):
            keep = lines
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def corpus():
    r = random.Random(6)
    line = lambda n: " ".join(r.choice("abcdefgh") + r.choice(["", "x", "7"]) for _ in range(n))
    shared = [line(n) for n in (1, 2, 4, 5, 9, 14)]
    forms = ["dear customer number of {} your order has been sent to {} today", "copyright by the owner {} all rights are reserved here"]
    rows = []
    for i in range(60):
        ls = [line(r.randint(1, 9)) for _ in range(r.randint(0, 5))]
        ls += r.sample(shared, r.randint(0, 3)) + [f.format(line(1), line(1)) for f in r.sample(forms, r.randint(0, 2))] + r.sample(["", " ", "\t"], 1)
        r.shuffle(ls)
        rows.append((i, "\n".join(ls)))
    passage = line(60)
    rows += [(70 + i, passage.replace("x", f"x{i}")) for i in range(2)] + [(80 + i, passage.replace(" a", f" new{'ab'[i]}")) for i in range(2)]
    rows += [(90 + i, "\n".join(f"{i + j} {j} {j + 1} {j * j}" for j in range(6))) for i in range(4)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, rows[0][1]), (105, rows[0][1])]


@pytest.mark.parametrize("most,broadcast", [(1.0, 1_000_000), (0.5, 0)])
def test_as_brute_force_and_sql(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(line_templates, "MOST_BROADCAST", broadcast)
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], DOCS).repartition(3)
    got = [(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in drop_templates(df, most=most).collect()]
    want = brute(rows, most=most)
    assert sorted(got) == sorted(want) and sum(x[3] for x in want) > 20
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.sql(f"SELECT doc_id, text, n_lines, n_dropped FROM ({oracle(most=most)})").fetchall()
    assert sorted(sql) == sorted(want)


def test_repeated_rows_and_nulls(spark):
    rows = [(None, "same line here"), (2, "same line here"), (2, "same line here"), (2, "same line here\nmore"), (3, "same line here")]
    got = drop_templates(spark.createDataFrame([(*x, "", "") for x in rows], DOCS)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in got) in (
        [(False, 2, "more"), (False, 2, "same line here"), (False, 2, "same line here"), (False, 3, ""), (True, 0, "")],
        [(False, 2, ""), (False, 2, ""), (False, 2, "same line here\nmore"), (False, 3, ""), (True, 0, "")],
    )
    assert set(got[0].asDict()) == {"doc_id", "text", "leaf", "n_lines", "n_dropped"}
    assert drop_templates(spark.createDataFrame([], DOCS)).count() == 0


def test_more_documents_never_bring_a_line_back(spark):
    """Two fields with values that repeat, in a leaf that fills up with other lines."""
    r = random.Random(9)
    names, cities = (["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)] for n in (10, 12))
    form = "your parcel has come for {} and was left at the shop in the town of {} today"
    noise = lambda: "your parcel has come " + " ".join(r.choice(names) for _ in range(12))
    rows = [(i, form.format(r.choice(names), r.choice(cities)) + "\nown " + " ".join(r.choice(cities) for _ in range(9)) + "\n" + noise()) for i in range(90)]
    dropped = set()
    for n in (3, 10, 30, 90):
        got = {x.doc_id: x.text for x in drop_templates(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()}
        gone = {(i, line) for i, t in rows[:n] for line in t.split("\n") if line not in got[i].split("\n")}
        assert dropped <= gone
        dropped = gone
    assert {(i, t.split("\n")[0]) for i, t in rows[1:]} <= dropped
    assert sum(line == t.split("\n")[0] for (i, line) in dropped for j, t in rows if i == j) == 89


def test_passages_go_from_two_documents_on(spark):
    words = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(60)]
    rows = [(1, "x\n" + " ".join(words[:51])), (2, " ".join(words[:51]) + "\ny"), (3, " ".join(words[:50])), (4, " ".join(words[:50]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in drop_templates(df).collect()} == dict(rows) | {2: "y"}
    assert {x.doc_id: x.text for x in drop_templates(df, long=None).collect()} == dict(rows)


def test_very_long_texts(spark):
    line = "word " * 200_000
    many = "\n".join(f"row {'abcdefghij'[i % 10]} of {i}" for i in range(100_000))
    rows = [(i, t) for i, t in enumerate([line, line, many, many, many])]
    got = {x.doc_id: (x.n_lines, x.n_dropped, len(x.text)) for x in drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1, 0, len(line)), 1: (1, 1, 0), 2: (100_000, 0, len(many)), 3: (100_000, 100_000, 0), 4: (100_000, 100_000, 0)}
