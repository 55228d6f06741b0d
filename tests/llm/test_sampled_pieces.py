import random
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm import queries, sampled_pieces
from lexmill.llm._text import mix, text_parts
from lexmill.llm.sampled_pieces import Vocabulary, decode_pieces, encode, encode_sampled, vocabulary_path

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("ids", StringType())])


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(vocabulary_path(), 1.0)


def texts():
    r = random.Random(1)
    pieces = ["the", " ", "  ", "▁", "ing", "\n", "日", "😀", "é", "\0", "words", "   x", "<s>", "<0x41>", "ß", "́"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["", " ", "    ", "▁", " a", "a ", "\n", "x" * 500, None, "▁▁ ▁"]


def one(v, text, key, before=0):
    import pyarrow as pa

    return encode(v, *text_parts(pa.array([text])), np.array([key], np.uint64), np.array([before]))[0].tolist()


def test_lossless(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "null id", ""), (1, "again", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = decode_pieces(encode_sampled(df)).collect()
    assert sorted((x.doc_id, x.decoded) for x in got if x.doc_id is not None) == sorted((i, t or "") for i, t, _ in rows if i is not None)
    assert all(len(x.ids) == x.n_tokens for x in got)
    assert decode_pieces(encode_sampled(df.limit(0))).count() == 0


def test_same_in_any_partition_and_other_by_seed(spark):
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts())], DOCS)
    ids = lambda d, **k: {x.doc_id: x.ids for x in encode_sampled(d, **k).collect()}
    a = ids(df.coalesce(1))
    assert a == ids(df.repartition(7)) and a != ids(df, seed=1)
    assert a == {x.doc_id: x.ids for x in encode_sampled(df.filter(F.col("doc_id") % 2 == 0)).union(encode_sampled(df.filter(F.col("doc_id") % 2 == 1))).collect()}


def test_long_texts_in_parts(spark, monkeypatch):
    text = " ".join(texts()[:150])
    df = spark.createDataFrame([(5, text, "")], DOCS)
    whole = encode_sampled(df).first().ids
    monkeypatch.setattr(sampled_pieces, "CHUNK", 100)
    v = Vocabulary.load(vocabulary_path(), 1.0)
    key = np.array([3], np.uint64)
    raw = np.frombuffer(text.encode(), np.uint8)
    edges = sampled_pieces._cuts(v, raw, 100)
    parts, before = [], 0
    for a, b in zip(edges, edges[1:]):
        parts += encode(v, raw[a:b], np.array([0, b - a]), key, np.array([before]))[0].tolist()
        before += len(raw[a:b].tobytes().decode())
    assert len(edges) > 5 and parts == one(v, text, 3) and len(whole) > 100


def test_drawn_in_proportion(vocabulary):
    """All segmentations of a word, listed by brute force, come in proportion to their weights."""
    v, word = vocabulary, "▁tests"
    names = {}
    for i, raw in enumerate(v.raw):
        if i > 258:
            names[raw.decode("utf-8", "replace").replace(" ", "▁")] = i

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            i = names.get(rest[:k])
            if i is not None:
                yield from ((i, *w) for w in ways(rest[k:]))

    weights = {w: exp(sum(v.weights[i] for i in w)) for w in ways(word)}
    n = 20_000
    import pyarrow as pa

    ids, count = encode(v, *text_parts(pa.array(["tests"] * n)), np.arange(n, dtype=np.uint64) * np.uint64(7919), np.zeros(n, np.int64))
    ends = np.append(0, np.cumsum(count))
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:]))
    assert set(drawn) <= set(weights)
    for w, x in weights.items():
        p = x / sum(weights.values())
        assert abs(drawn[w] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3


def in_parts(v, text, key, most):
    raw = np.frombuffer(text.encode(), np.uint8)
    edges, out, before = sampled_pieces._cuts(v, raw, most), [], 0
    for a, b in zip(edges[:-1], edges[1:]):
        out += encode(v, raw[a:b], np.array([0, b - a]), np.array([key], np.uint64), np.array([before]))[0].tolist()
        before += len(raw[a:b].tobytes().decode())
    return out, len(edges) - 1


def test_unspaced_texts_in_parts(vocabulary, monkeypatch):
    """Parting a text without spaces where no piece reaches across changes nothing."""
    r = random.Random(8)
    for letters in ("日本語中文字のはにを", "日本abcdeé", "\n\t😀ß", "▁x"):
        text = "".join(r.choice(letters) for _ in range(3000))
        monkeypatch.setattr(sampled_pieces, "LONG_UNIT", 10**9)
        whole = one(vocabulary, text, 7)
        monkeypatch.setattr(sampled_pieces, "LONG_UNIT", 16)
        assert one(vocabulary, text, 7) == whole
        parts, n = in_parts(vocabulary, text, 7, 300)
        assert parts == whole and n > 5
    assert in_parts(vocabulary, "e" * 2000, 7, 300)[0] == one(vocabulary, "e" * 2000, 7)


def test_no_place_is_called_uncrossed_that_a_piece_crosses(vocabulary):
    r = random.Random(2)
    pieces = {x for i, x in enumerate(vocabulary.raw) if x and i not in set(vocabulary.byte_ids.tolist())}
    text = "".join(r.choice("the日本 ing中er") for _ in range(400))
    code = np.array([0x2581 if c == " " else ord(c) for c in text], np.uint32)
    free = sampled_pieces.uncrossed(vocabulary, code)
    want = [i > 0 and not any(text[a:b].encode() in pieces for a in range(max(0, i - vocabulary.longest), i) for b in range(i + 1, min(len(text), a + vocabulary.longest) + 1)) for i in range(len(text))]
    assert free.tolist() == want and any(want)


def test_very_long_unspaced_text(spark):
    text = "".join(random.Random(3).choice("日本語中文字のはにを") for _ in range(1_000_000))
    row = decode_pieces(encode_sampled(spark.createDataFrame([(1, text, "")], DOCS))).first()
    assert row.decoded == text


def test_decoded_by_the_worker_that_encodes(spark):
    rows = [(i, t, "") for i, t in enumerate(texts())] + [(None, "null id", ""), (1, "again", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    row = lambda x: (str(x.doc_id), x.text or "", x.ids, x.n_tokens, x.decoded)
    got = encode_sampled(df, decoded=True)
    assert sorted(map(row, got.collect())) == sorted(map(row, decode_pieces(encode_sampled(df)).collect()))
    assert got.columns == decode_pieces(encode_sampled(df)).columns
    assert encode_sampled(df.limit(0), decoded=True).count() == 0


def plain(v, text, key):
    """Forward filtering and backward sampling over the lattice of one whole text, in plain Python."""
    mark = chr(sampled_pieces.MARK)
    ids = {raw.decode().replace(" ", mark): i for i, raw in enumerate(v.raw) if i > 258}
    # the word mark itself, no space, has no piece
    code = [mark, *(None if c == mark else mark if c == " " else c for c in text)] if text else []
    reach, edges = [0.0], [[]]
    for e in range(1, len(code) + 1):
        found = []
        for s in range(max(0, e - v.longest), e):
            i = None if None in code[s:e] else ids.get("".join(code[s:e]))
            if i is not None:
                found.append((s, [i], v.weights[i]))
            elif s == e - 1:
                found.append((s, v.byte_ids[list((code[s] or mark).encode())].tolist(), 3 * v.weights.min()))
        top = max(reach[s] + w for s, _, w in found)
        sums = sum(exp(reach[s] + w - top) for s, _, w in found)
        edges.append([(s, i, exp(reach[s] + w - top) / sums) for s, i, w in found])
        reach.append(top + log(sums))
    out, e, m = [], len(code), (1 << 64) - 1
    while e:
        x = (key + e * int(sampled_pieces.HASH)) & m
        u = int(mix(mix(np.array([x], np.uint64)))[0]) >> 32
        for s, i, share in edges[e]:
            u -= share * 2.0**32
            if u < 0:
                break
        out[:0], e = i, s
    return out


def test_equals_a_plain_sampler(vocabulary):
    r = random.Random(4)
    rows = [t or "" for t in texts()] + ["https://example.org/" + "".join(r.choice("abcdef0123456789-_/") for _ in range(400)), "".join(r.choice("日本語éeing") for _ in range(300))]
    import pyarrow as pa

    keys = [r.getrandbits(64) for _ in rows]
    ids, count = encode(vocabulary, *text_parts(pa.array(rows)), np.array(keys, np.uint64), np.zeros(len(rows), np.int64))
    ends = np.append(0, np.cumsum(count)).tolist()
    for text, key, a, b in zip(rows, keys, ends, ends[1:]):
        assert ids[a:b].tolist() == plain(vocabulary, text, key)


def test_decoding_of_any_ids(spark, vocabulary):
    """Ids that no text was encoded to, with broken characters, control pieces and none at all."""
    r = random.Random(6)
    rows = [(k, None if k % 9 == 0 else [r.randrange(len(vocabulary.raw)) if k % 2 else r.randrange(300) for _ in range(r.randint(0, 12))]) for k in range(100)]
    got = decode_pieces(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3)).collect()
    assert {x.doc_id: x.decoded for x in got} == {k: b"".join(vocabulary.raw[i] for i in ids or [])[1:].decode("utf-8", "replace") for k, ids in rows}


def test_query_takes_texts_to_python_once(spark):
    at = "/root/testdata/sf0.001"
    got = queries.op2_sentencepiece(spark, at)
    assert got._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    want = decode_pieces(encode_sampled(queries.table(spark, at, "documents"))).withColumn("sha", F.sha2("decoded", 256))
    rows = got.collect()
    assert sorted((x.doc_id, x.n_tokens, x.ids, x.decoded_sha256) for x in rows) == sorted((x.doc_id, x.n_tokens, x.ids, x.sha) for x in want.collect())
    assert len(rows) == queries.table(spark, at, "documents").count() and all(x.lossless for x in rows)


def test_work_does_not_sort_edges(vocabulary, monkeypatch):
    """The edges of a lattice, some times as many as its places, are dealt to their places; only places are sorted."""
    import pyarrow as pa

    most, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (most.append(len(x)), sort(x, *a, **k))[1])
    r = random.Random(9)
    words = " ".join("".join(r.choice("aeinrst") for _ in range(8)) for _ in range(500))
    encode(vocabulary, *text_parts(pa.array([words])), np.array([1], np.uint64), np.zeros(1, np.int64))
    assert max(most, default=0) <= len(words) + 1
