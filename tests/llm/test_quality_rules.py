import random
import re
from collections import Counter

import numpy as np
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lexmill.llm.quality_rules import COUNTS, judged, learn, statistics

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("text", StringType())])


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines), len(t), len(re.findall("[A-Z]", t)), len(re.findall("[0-9]", t)), len(re.findall(r"[!?.,;:]", t)), max((len(x.encode()) for x in w), default=0))


def texts():
    r = random.Random(4)
    pieces = ["a", "bé", "C#", "|", "\n", " ", "\n\n", "\t", "x|y", "ß ", "日本", "1 2 3", "!\n", "\r\n", "end."]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "\n", "\n\n", "a\na\n", "\na\n a\na", "one two three one two three", "one\none", "😀 b"]


def test_counts_as_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = {x.doc_id: tuple(x[1:]) for x in statistics(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}
    assert statistics(spark.createDataFrame([], DOCS)).columns == ["doc_id", *COUNTS]


def test_learns_planted_rules():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    keep = ~((x["a"] > 0.8) & (x["b"] < 0.5) | (x["c"] > 0.95))
    rules = learn(x, keep)
    out = np.ones(3000, bool)
    for rule in rules:
        out &= ~rule.matches(x)
    assert (out == keep).mean() > 0.98 and len(rules) <= 6
    assert learn(x, np.ones(3000, bool)) == []


def test_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}###" for i in range(60))
    rows = [(i, good + f" x{i}" if i % 2 else bad + f" x{i}", "") for i in range(200)] + [(200, "a b c " * 40, ""), (201, "short", ""), (202, None, ""), (1, good, ""), (None, good, "")]
    labels = [(i, i % 2, "") for i in range(150)] + [(1, 1, ""), (None, 0, ""), (3, None, "")]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = judged(df, lab).collect()
    assert len(got) == len(rows)
    assert all(x.kept == (not x.base_failed and x.n_symbols == 0) for x in got)
    assert {x.doc_id for x in got if x.base_failed} == {200, 201, 202}
    assert all(x.kept != x.base_failed for x in judged(df, lab.limit(0)).collect())
    assert judged(df.limit(0), lab).count() == 0


def brute_learn(x, keep, most_conditions=4, precision=0.9, support=8):
    """Covering by loops over all rows, features and thresholds."""
    bad = [not k for k in keep]
    n = len(bad)
    order = {True: 0, False: 0}
    prune = []
    for b in bad:
        prune.append(order[b] % 3 == 2)
        order[b] += 1
    support = min(support, max(3, -(-sum(bad) // 20)))
    covers = lambda cs, i: all(x[f][i] <= t if op == "<=" else x[f][i] >= t for f, op, t in cs)
    left, rules, aside = set(range(n)), [], set()
    while True:
        grow, test = [i for i in left if not prune[i]], [i for i in left if prune[i]]
        if not any(bad[i] for i in grow) or all(bad[i] for i in grow):
            return rules
        cs, inside = [], grow
        while len(cs) < most_conditions and any(not bad[i] for i in inside):
            p, best = sum(bad[i] for i in inside), (1e-9, None)
            base = np.log2(p / len(inside))
            for f in x:
                values = sorted({x[f][i] for i in inside})
                cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
                for op in ("<=", ">="):
                    for t in cuts:
                        hit = [i for i in inside if covers([(f, op, t)], i)]
                        good = sum(bad[i] for i in hit)
                        gain = good * (np.log2(good / len(hit)) - base) if good else -1
                        if gain > best[0] + 1e-12 and (cs or (f, op) not in aside):
                            best = (gain, (f, op, t))
            if best[1] is None:
                break
            cs.append(best[1])
            inside = [i for i in inside if covers([best[1]], i)]
        if not cs:
            return rules
        worth = []
        for k in range(1, len(cs) + 1):
            hit = [i for i in test if covers(cs[:k], i)]
            p = sum(bad[i] for i in hit)
            worth.append((2 * p - len(hit)) / len(hit) if hit else -1.0)
        k = worth.index(max(worth)) + 1
        hit = {i for i in left if covers(cs[:k], i)}
        right = sum(bad[i] for i in hit)
        if (max(worth) + 1) / 2 < precision or len(hit) < support or right < precision * len(hit):
            aside.add(cs[0][:2])
        else:
            rules.append(hit)
            left -= hit
            aside = set()


def test_covering_as_brute_force():
    for seed in range(6):
        r = np.random.default_rng(seed)
        x = {"a": r.integers(0, 12, 150).astype(float), "b": r.integers(0, 8, 150).astype(float), "c": r.random(150).round(2)}
        keep = ~((x["a"] > 8) | (x["b"] < 1) & (x["c"] > 0.4)) ^ (r.random(150) < 0.03)
        left, got = np.ones(150, bool), []
        for rule in learn(x, keep):
            hit = rule.matches(x) & left
            got.append(set(np.flatnonzero(hit).tolist()))
            left &= ~hit
        assert got == brute_learn({f: v.tolist() for f, v in x.items()}, keep.tolist()) and got


def test_goes_on_after_a_rule_that_fails():
    """The best first condition holds for too few rows; the rule behind it is found all the same."""
    r = np.random.default_rng(3)
    x = {"a": r.random(300), "b": r.random(300)}
    keep = np.ones(300, bool)
    keep[:2] = False
    x["a"][:2] = 5.0
    keep[np.flatnonzero(x["b"] > 0.9)] = False
    rules = learn(x, keep)
    assert rules and all(("b", ">=") == rule.conditions[0][:2] for rule in rules)


def test_very_long_text(spark):
    text = "word " * 300_000 + "\n" + "#" * 1_000_000
    got = statistics(spark.createDataFrame([(1, text, "")], DOCS)).first()
    assert tuple(got[1:])[:6] == (300_001, 2_200_000, 1_000_000, 0, 300_000, 2)
