import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm import warc
from lexmill.llm.warc import digest_of, placed, ranges, read_archives, write_archives

PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()), StructField("file", StringType())])


def rows():
    r = random.Random(2)
    out = [(i, f"http://h{i}.test/\r\nX: 1\\", r.choice(["<p>é</p>\r\n\r\n", "same", "", f"own {i}", "x" * 5000])) for i in range(60)]
    return [*out, (100, None, None), (None, "u", "same"), (None, "u", "alone"), (101, "u", "a"), (101, "v", "a"), (3, "w", "b")]


def brute(rows, least):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, u, h in rows:
        raw, holder = (h or "").encode(), top.get(h or "")
        revisit = holder is not None and i != holder
        out.append((i, u or "", "revisit" if revisit else "response", holder if revisit else None, len(raw), digest_of(raw), None if revisit else raw))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*x, "clash") for x in rows()], PAGES).repartition(3)
    path, index = write_archives(df, least)
    got = [(*x[:6], None if x.payload is None else bytes(x.payload)) for x in read_archives(path, index).collect()]
    assert sorted(got, key=str) == sorted(brute(rows(), least), key=str)
    some = index.filter("page_id % 7 = 3")
    assert sorted(x.page_id for x in read_archives(path, some, payloads=False).collect()) == sorted(i for i, *_ in rows() if i is not None and i % 7 == 3)
    for f in Path(path.removeprefix("file://")).glob("*.gz"):  # any gzip reader takes an archive as a whole
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\n")
    path, index = write_archives(df.limit(0))
    assert read_archives(path, index).count() == 0


def test_damage_is_found():
    raw, _ = warc.record(1, "u", b"payload", None)
    import zlib

    broken = zlib.decompress(raw, 31).replace(b"payload\r", b"PAYLOAD\r")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(z.compress(broken) + z.flush())


def test_ranges():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 90, 5), ("b", 95, 5)]
    assert list(ranges(iter(places), gap=5, most=100)) == [("a", 0, 25, [(0, 10), (10, 5), (20, 5)]), ("a", 90, 95, [(90, 5)]), ("b", 95, 100, [(95, 5)])]
    assert [x[1:3] for x in ranges(iter([("a", 0, 10), ("a", 10, 10), ("a", 20, 10)]), gap=5, most=20)] == [(0, 20), (20, 30)]


def test_a_shuffled_selection_costs_as_few_reads(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50, "") for i in range(4000)], PAGES).repartition(2)
    path, index = write_archives(df)
    some = index.filter("page_id % 3 = 0")
    reads = lambda rows: sum(len(list(ranges(iter(p)))) for p in placed(rows).rdd.map(tuple).glom().collect() if p)
    assert reads(some.orderBy("file", "offset")) == reads(some.orderBy(F.rand(1)).repartition(7)) == index.select("file").distinct().count()
    assert {x.page_id for x in read_archives(path, some.orderBy(F.rand(1))).collect()} == set(range(0, 4000, 3))


def test_many_copies_and_very_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    long = "<p>long é</p>" * 300_000
    mine = [(i, f"u{i}", "same" if i % 3 else f"own {i}", "") for i in range(300)] + [(300, "l", long, ""), (301, "m", long, "")]
    df = spark.createDataFrame(mine, PAGES).repartition(5)
    got = [(*x[:6], None if x.payload is None else bytes(x.payload)) for x in read_archives(*write_archives(df)).collect()]
    assert sorted(got, key=str) == sorted(brute([x[:3] for x in mine], 0), key=str)
