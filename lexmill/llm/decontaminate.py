"""Benchmark decontamination by a prefix-filtered set join.

Windows of size words are cut from the benchmark items (an item of fewer words is one window). A document can only hold a
window if it holds every shingle of it, so a prefix of one shingle is enough: of a window's shingles in order of rarity,
only the rarest is joined. Matches are bounded by position (the shingle's place in the window fixes where the window starts),
by length (it must lie inside the document), and are then verified over the whole window, word by word.

A benchmark of few bytes is indexed as flat arrays, some thirty bytes for each word, and broadcast; rarity is counted over
benchmark and documents in a pass of its own. A larger one is never gathered: windows and documents meet in a join by the
rarest shingle, counted over the benchmark, to which documents send only shingles that pass a bit table of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import lean, staged, tune
from ._skew import salted_join
from ._text import ALNUM, U64, chunks, mix, prefix_hashes, shingle_hashes, span_hashes, text_parts, word_spans

SHINGLE_WORDS = 3
#: Bits of the tables that most shingles of documents are turned away by: beside a broadcast index, and before a join (16 MB).
FILTER_BITS, JOIN_BITS = 20, 27
FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@dataclass
class Words:
    """Words of texts end to end: hashes, the first of each text, and their bytes with a blank after each."""

    hashes: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    at: np.ndarray  # of each word in raw, one more than words

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        mapped, starts, ends, first = word_spans(data, offsets, ALNUM)
        at = np.append(0, np.cumsum(ends - starts + 1))
        raw = np.full(int(at[-1]), 0x20, np.uint8)
        step = np.repeat(starts - at[:-1], ends - starts + 1)
        place = np.arange(len(raw)) + step
        inside = np.ones(len(raw), bool)
        inside[at[1:] - 1] = False
        raw[inside] = mapped[place[inside]]
        return cls(span_hashes(prefix_hashes(mapped), starts, ends), first, raw, at)

    def bytes_of(self, start: int, n: int) -> bytes:
        return self.raw[self.at[start] : self.at[start + n] - 1].tobytes()


def grams_of(words: np.ndarray, size: int) -> np.ndarray:
    return mix(shingle_hashes(words, size) + U64(size))


@dataclass
class Index:
    """Different windows of some items, and by shingle size: sorted keys, and for each key a run of (window, place of the shingle in it)."""

    words: Words
    start: np.ndarray  # of each window
    length: np.ndarray
    owners: np.ndarray  # items of window i: owners[first[i]:first[i + 1]]
    first: np.ndarray
    items: list[str]
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each window."""
    n = np.diff(words.first)
    many = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return start, np.minimum(size, n[text]), text


def _spread(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(keys & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return seen


def shingles(words: Words, size: int) -> np.ndarray:
    """Different shingles of all windows."""
    start, length, _ = windows(words, size)
    out = [np.zeros(0, U64)]
    for s in range(1, min(SHINGLE_WORDS, size) + 1):
        mine = np.minimum(length, SHINGLE_WORDS) == s
        if mine.any():
            grams = grams_of(words.hashes, s)
            for j in range(int(length[mine].max()) - s + 1):
                out.append(grams[start[mine & (length - s >= j)] + j])
    return np.unique(np.concatenate(out))


def build_index(words: Words, ids: list, size: int, known: np.ndarray, counts: np.ndarray) -> Index:
    """known: sorted shingles, counts: how often each occurs. Equal windows are one; what tells them apart is 128 bits of hash."""
    names = sorted({"" if x is None else str(x) for x in ids})
    number = {x: i for i, x in enumerate(names)}
    own = np.array([number["" if x is None else str(x)] for x in ids], np.int64)
    start, length, text = windows(words, size)
    name = np.zeros((len(start), 2), U64)
    for n in np.unique(length).tolist():
        mine = length == n
        a = shingle_hashes(words.hashes, n)[start[mine]] + U64(n)
        name[mine, 0], name[mine, 1] = mix(a), mix(shingle_hashes(mix(words.hashes), n)[start[mine]])
    order = np.lexsort((name[:, 1], name[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]).any(axis=1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    pick = order[new]
    pairs = np.unique(np.stack([kind, own[text]], axis=1), axis=0) if len(kind) else np.zeros((0, 2), np.int64)
    start, length = start[pick], length[pick]
    keys = {}
    for s in range(1, min(SHINGLE_WORDS, size) + 1):
        mine = np.flatnonzero(np.minimum(length, SHINGLE_WORDS) == s)
        if not len(mine):
            continue
        grams = grams_of(words.hashes, s)
        least, spot = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.int64)
        for j in range(int(length[mine].max()) - s + 1):
            fits = np.flatnonzero(length[mine] - s >= j)
            often = counts[np.searchsorted(known, grams[start[mine[fits]] + j])]
            rarer = often < least[fits]  # the first of equals
            least[fits[rarer]], spot[fits[rarer]] = often[rarer], j
        key = grams[start[mine] + spot]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys[s] = (key[at], np.append(at, len(key)), mine[order], spot[order], _spread(key))
    return Index(words, start, length, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(start) + 1)), names, keys)


def occurrences(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Word where a window occurs and the window's number."""
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for s, (key, runs, window, spot, seen) in index.keys.items():
        grams = grams_of(words.hashes, s)
        at = np.flatnonzero(seen[(grams & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(key, grams[at]), len(key) - 1)
        hit = key[k] == grams[at]
        at, k = at[hit], k[hit]
        n = runs[k + 1] - runs[k]
        entry = np.repeat(runs[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
        start, win = np.repeat(at, n) - spot[entry], window[entry]
        inner = np.repeat(text[at], n)
        fits = (start >= words.first[inner]) & (start + index.length[win] <= words.first[inner + 1])
        start, win = start[fits], win[fits]
        # Hashes turn most away; what they leave is compared byte by byte.
        for j in range(int(index.length[win].max()) if len(win) else 0):
            beyond = index.length[win] <= j
            same = beyond | (words.hashes[np.minimum(start + j, len(words.hashes) - 1)] == index.words.hashes[np.minimum(index.start[win] + j, len(index.words.hashes) - 1)])
            start, win = start[same], win[same]
        same = [words.bytes_of(a, n) == index.words.bytes_of(b, n) for a, b, n in zip(start.tolist(), index.start[win].tolist(), index.length[win].tolist(), strict=True)]
        starts.append(start[np.array(same, bool)])
        found.append(win[np.array(same, bool)])
    return np.concatenate(starts), np.concatenate(found)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _counter(known):
    """How often each known shingle occurs, a batch at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        seen = _spread(keys)
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch, "_text"):
                words = Words.of(data, offsets)
                for s in range(1, SHINGLE_WORDS + 1):
                    grams = grams_of(words.hashes, s)
                    grams = grams[seen[(grams & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
                    k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    total += np.bincount(k[keys[k] == grams], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    return count


def _scan(index, carry: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        none = _digest(set())
        for batch in batches:
            for part, data, offsets in chunks(batch, "_text"):
                words = Words.of(data, offsets)
                start, win = occurrences(words, ix)
                doc = np.searchsorted(words.first, start, "right") - 1
                items: dict[int, set[str]] = {}
                for d, w in np.unique(np.stack([doc, win], axis=1), axis=0).tolist() if len(doc) else ():
                    items.setdefault(d, set()).update(ix.items[x] for x in ix.owners[ix.first[w] : ix.first[w + 1]])
                edge = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + ix.length[win], -1)
                total = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
                n_hit = total[words.first[1:]] - total[words.first[:-1]]
                yield pa.record_batch(
                    [*part.columns[:carry], pa.array(np.diff(words.first)), pa.array(n_hit), pa.array([len(items.get(i, ())) for i in range(part.num_rows)], pa.int64()), pa.array([_digest(items[i]) if i in items else none for i in range(part.num_rows)]), pa.array(n_hit > 0)],
                    [*part.schema.names[:carry], *FOUND],
                )

    return scan


def _cut(size: int):
    """Windows of items: item, window (its words, joined by blanks), words (their number) and grams (its shingles)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, most=1 << 18):
                words = Words.of(data, offsets)
                start, length, text = windows(words, size)
                by = {s: grams_of(words.hashes, s).view(np.int64) for s in range(1, SHINGLE_WORDS + 1)}
                grams = [by[min(n, SHINGLE_WORDS)][a : a + n - min(n, SHINGLE_WORDS) + 1] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                texts = [words.bytes_of(a, n).decode() for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(text)), pa.array(texts, pa.string()), pa.array(length), pa.array(grams, pa.list_(pa.int64()))], ["item", "window", "words", "grams"])

    return cut


def _spots(table, size: int):
    """Shingles of documents that the bit table lets pass: _rk, key, place, the words around it (joined by blanks), which of
    the document's words comes first there, and n_words."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "_text", 1 << 19):
                words = Words.of(data, offsets)
                text = np.repeat(np.arange(part.num_rows), np.diff(words.first))
                rk = part.column(part.schema.get_field_index("_rk"))
                for s in range(1, SHINGLE_WORDS + 1):
                    grams = grams_of(words.hashes, s)
                    slot = (grams >> U64(64 - JOIN_BITS)).astype(np.int64)
                    at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    at = at[at + s <= words.first[text[at] + 1]]
                    low = np.maximum(words.first[text[at]], at - size + s)
                    high = np.minimum(words.first[text[at] + 1], at + size)
                    around = [words.bytes_of(a, b - a).decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    base = words.first[text[at]]
                    yield pa.record_batch([rk.take(pa.array(text[at])), pa.array(grams[at].view(np.int64)), pa.array(at - base), pa.array(around, pa.string()), pa.array(low - base), pa.array(np.diff(words.first)[text[at]])], ["_rk", "key", "place", "around", "low", "n_words"])

    return spots


def _sizes(carry: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "_text"):
                _, _, _, first = word_spans(data, offsets, ALNUM)
                yield pa.record_batch([*part.columns[: carry + 1], pa.array(np.diff(first))], [*part.schema.names[: carry + 1], "n_words"])

    return sizes


def _bit_table(spark: SparkSession, keys: DataFrame):
    """JOIN_BITS bits, set where a key has its first ones; gathered as one row for each byte that isn't zero."""
    slot = F.shiftrightunsigned("key", 64 - JOIN_BITS)
    rows = keys.select(F.shiftright(slot, 3).alias("byte"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {64 - JOIN_BITS}) & 7 as int))").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (JOIN_BITS - 3), np.uint8)
    bits[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits)


def _joined(docs: DataFrame, items: DataFrame, size: int, carry: tuple[str, ...], head: str) -> DataFrame:
    spark = docs.sparkSession
    cut = staged(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(lean(_cut(size)), "item string, window string, words long, grams array<long>"), "windows")
    kinds = staged(cut.groupBy("window").agg(F.first("words").alias("words"), F.first("grams").alias("grams")), "kinds")
    owners = cut.select("window", "item").distinct()
    places = kinds.select("window", "words", F.posexplode("grams").alias("spot", "key"))
    often = kinds.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    places = salted_join(places, often, "key", ["window"], often)
    keyed = staged(places.groupBy("window").agg(F.first("words").alias("words"), F.min(F.struct("rows", "spot", "key")).alias("least")).select("window", "words", "least.spot", "least.key"), "keyed")
    spots = staged(docs.select("_rk", "_text").mapInArrow(lean(_spots(_bit_table(spark, keyed), size)), "_rk long, key long, place long, around string, low long, n_words long"), "spots")
    # A shingle may be common in documents and, as a key, in windows: its documents are dealt out, its windows go along as one row.
    by_key = keyed.groupBy("key").agg(F.collect_list(F.struct("spot", "words", "window")).alias("windows"))
    met = salted_join(spots, by_key, "key", ["_rk", "place"]).select("_rk", "place", "around", "low", "n_words", F.explode("windows").alias("w"))
    met = met.withColumn("start", F.col("place") - F.col("w.spot")).filter("start >= 0 and start + w.words <= n_words")
    same = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("w.words").cast("int")), " ") == F.col("w.window")
    hits = staged(met.filter(same).select("_rk", "start", (F.col("start") + F.col("w.words")).alias("end"), F.col("w.window").alias("window")).distinct(), "hits")
    total = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(F.sort_array(F.collect_set(F.struct("start", "end"))), total, lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    spans = hits.groupBy("_rk").agg(covered.alias("n_hit"))
    names = salted_join(hits.select("_rk", "window"), owners.groupBy("window").agg(F.collect_set("item").alias("items")), "window", ["_rk"]).select("_rk", F.explode("items").alias("item")).distinct()
    names = names.groupBy("_rk").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    rows = docs.mapInArrow(lean(_sizes(len(carry))), f"{head}_rk long, n_words long").join(spans.join(names, "_rk"), "_rk", "left")
    return rows.select(*carry, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(_digest(set()))).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 4 << 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of documents that lie in an occurrence of a benchmark window of size words.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Words are runs of 0-9, a-z (A-Z lower-cased)
    and characters beyond ASCII. Returns for each row carry (which names no column of the result), n_words, n_hit, n_items (distinct item_ids with a window that
    occurs), items_sha256 (of those ids, sorted as strings, comma-joined) and contaminated (n_hit > 0).
    Null or wordless texts have no words and no windows; a null item_id counts as the id "". Repeated rows of documents
    each give a row; repeated items count once. An empty benchmark leaves all documents clean.
    broadcast_bytes: text and ids up to which the benchmark is gathered, indexed and broadcast; a larger one is joined by key.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.col("text").cast("string")
    docs = docs.select(*carry, F.xxhash64(F.col("doc_id").cast("string"), text).alias("_rk"), text.alias("_text"))
    head = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    items = benchmark.select("item_id", text.alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32 + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)))).first()[0] or 0
    if total > broadcast_bytes:
        return _joined(docs, items, size, carry, head)
    rows = items.collect()  # broadcast_bytes at most
    words = Words.of(*text_parts(pa.array([x[1] for x in rows], pa.large_string())))
    known = shingles(words, size)
    counts = np.zeros(len(known), np.int64)
    if len(known):
        # One row for each shingle of the benchmark at most comes back.
        found = docs.select("_text").mapInArrow(lean(_counter(spark.sparkContext.broadcast(known))), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        counts[np.searchsorted(known, found.column("gram").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    index = spark.sparkContext.broadcast(build_index(words, [x[0] for x in rows], size, known, counts))
    return docs.mapInArrow(lean(_scan(index, len(carry))), f"{head}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
