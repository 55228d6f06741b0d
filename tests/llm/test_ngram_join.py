import random
import re

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm import ngram_join
from lexmill.llm.ngram_join import similarity_classes, trie_links

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("sid", StringType())])


def brute(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None), links[i]))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, passage = [], text(30)
    for n in (3, 5, 7, 9, 14, 20, 36, 42, 46, 60, 90, 150, 400):
        for _ in range(2):
            base = text(n)
            for _ in range(5):
                t = list(base)
                for _ in range(r.randint(0, max(1, n // 25))):
                    k = r.randrange(len(t))
                    t[k : k + 1] = r.choice([[], [r.choice(words)], [t[k].upper(), "new"]])
                rows.append(" ".join(t))
            rows.append("\t".join(base).upper())
            rows.append(" ".join(base + base[: n // 7]))
    rows += [" ".join(passage + text(3)) for _ in range(15)]
    rows += [None, "", " \n", "solo", "solo", "a b c d"]
    r.shuffle(rows)
    return [*enumerate(rows), (3, rows[3]), (3, "other text of one id"), (None, rows[5])]


@pytest.mark.parametrize("seed,members", [(1, 1000), (2, 3)])
def test_as_brute_force(spark, monkeypatch, seed, members):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
    rows = corpus(seed)
    got = [tuple(x) for x in similarity_classes(spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_routes_lose_no_link():
    r = np.random.default_rng(5)
    routes = ngram_join.Routes(85)
    for _ in range(3000):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        off, on = r.integers(0, max(1, n // 8) + 1, 2)
        b = np.unique(np.append(r.choice(a, max(0, len(a) - off), replace=False), r.integers(0, 1 << 63, on, dtype=np.uint64)))
        i = len(np.intersect1d(a, b))
        if len(b) and 185 * i >= 85 * (len(a) + len(b)):
            assert len(a) == len(b) == i or len(np.intersect1d(routes.keys(a), routes.keys(b)))


def test_trie_alone():
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = [np.unique(np.append(r.choice(base, int(r.integers(60, 100)), replace=False), r.integers(0, 1 << 62, int(r.integers(0, 9)), dtype=np.uint64))) for _ in range(60)]
    got = {(y, x) for y, xs in trie_links(sets, 70) for x in xs.tolist()}
    want = {(y, x) for y in range(60) for x in range(60) if x != y and 170 * len(np.intersect1d(sets[x], sets[y])) >= 70 * (len(sets[x]) + len(sets[y]))}
    assert got == want and want


def test_very_long_texts(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = [w if i % 100 else "x" for i, w in enumerate(words)]
    rows = [(1, " ".join(words), ""), (2, " ".join(near), ""), (3, " ".join(words[:30_000]), ""), (4, "y" * 1_000_000, ""), (5, "y" * 1_000_000, "")]
    got = {x.doc_id: tuple(x)[1:] for x in similarity_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[4] == got[5] == (1, 4, 1) and got[3][1:] == (3, 0)
    assert got[1][1:] == got[2][1:] == (1, 1)


def test_one_set_of_many_that_share_a_key(spark):
    """Sets that all share an n-gram range, of which only a few link: nothing is closed over what is merely shared."""
    r = random.Random(6)
    shared = [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(250)]), "") for i in range(40)]
    rows += [(100 + i, rows[0][1].replace("o0x3 ", f"e{i} "), "") for i in range(5)]
    got = sorted(tuple(x) for x in similarity_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(brute([x[:2] for x in rows]))
    assert got[1][2:] == (1, 0)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_few_routes_lose_no_link(percent):
    """At 80 percent a set used to have some 0.85 keys for each n-gram, which filled the disk of the pipeline's join at 0.5 GB."""
    r = np.random.default_rng(percent)
    routes, keys, grams, linked = ngram_join.Routes(percent), 0, 0, 0
    for _ in range(1500):
        n = int(r.integers(1, 500))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        off, on = r.integers(0, max(1, n * (100 - percent) // 150) + 1, 2)
        b = np.unique(np.append(r.choice(a, max(0, len(a) - off), replace=False), r.integers(0, 1 << 63, on, dtype=np.uint64)))
        i = len(np.intersect1d(a, b))
        keys, grams = keys + len(routes.keys(a)), grams + n
        if len(b) and (100 + percent) * i >= percent * (len(a) + len(b)) and not len(a) == len(b) == i:
            linked += 1
            assert len(np.intersect1d(routes.keys(a), routes.keys(b)))
    assert linked > 100
    assert percent < 80 or keys < 0.45 * grams


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.append(base[: int(r.integers(1, n + 1))], r.integers(0, 1 << 63, int(r.integers(0, n // 3 + 1)), dtype=np.uint64))) for n in (3, 40, 41, 300, 3000) for _ in range(25)]
    sets.append(np.arange(2000, dtype=np.uint64))  # all in one place: counts stop at 255
    sets.append(np.arange(1900, dtype=np.uint64))
    sketches, sizes = [ngram_join.sketch(x) for x in sets], np.array([len(x) for x in sets])
    near = {frozenset((y, x)) for y, xs in ngram_join.near_pairs(sizes, sketches, 80) for x in xs.tolist()}
    linked, far = 0, 0
    for x in range(len(sets)):
        for y in range(x):
            i = len(np.intersect1d(sets[x], sets[y]))
            least = ngram_join.least_apart(sketches[x], sketches[y])
            assert least <= sizes[x] + sizes[y] - 2 * i
            if 180 * i >= 80 * (sizes[x] + sizes[y]):
                linked += 1
                assert frozenset((x, y)) in near
            far += frozenset((x, y)) not in near
    assert linked > 30 and far > 1000


def test_texts_of_open_groups_that_cannot_link_are_not_moved(spark, monkeypatch):
    """Sets that share a key, of which sketches rule out all links: their texts used to be copied to each block of the group."""
    monkeypatch.setattr(ngram_join, "SKETCH_MEMBERS", 7)
    moved, joined = [], ngram_join._joined
    monkeypatch.setattr(ngram_join, "_joined", lambda groups, *rest: moved.append(groups.count()) or joined(groups, *rest))
    shared = [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(250)]), "") for i in range(40)]
    rows += [(100, " ".join(shared + [f"o3x{k}" for k in range(240)]), ""), (101, " ".join(shared + [f"o3x{k}" for k in range(10, 250)]), "")]
    got = {x.doc_id: x.component_id for x in similarity_classes(spark.createDataFrame(rows, SCHEMA), 5, 80, links=False).collect()}
    assert got == {i: i for i in range(40)} | {100: 3, 101: 3}
    assert sum(moved) < 20
