"""Removal of byte strings that occur more than once, by suffix arrays.

A width-byte window is repeated if an equal one starts anywhere else. Sorting all suffixes of a corpus is out of
reach, and not needed: equal windows share their minimiser, the gram-byte string of least hash inside them.

1. Each text is cut into runs of windows with one minimiser. A run is kept as a row (minimiser, content hash, place).
   What a chunk of texts has twice is settled there: one row goes on for it, the others are only passed through.
2. Rows sorted by minimiser and content are streamed. A content seen twice is repeated throughout; a minimiser with
   one content, seen once, is unique; contents that share a minimiser but differ go on, one of each, as candidates.
3. Candidates of a minimiser meet in a shard. A shard's suffix array is built by Larsson-Sadakane refinement, common
   prefixes follow by Kasai's recurrence, and a window is repeated if a neighbour in the array shares width bytes.
4. A minimiser with very many candidates is dealt over several shards. These publish a fingerprint for each different
   window, and runs of published fingerprints are merged by binary search.

Every window lies in exactly one run, so no equal pair is missed. Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import lean, partitions, staged, tune
from ._text import BASE, U64, Powers, chunks, mix, prefix_hashes, span_hashes, text_parts

#: Longer texts are cut into overlapping pieces of this size; positions inside a piece have 24 bits.
PIECE = 4 << 20
SHARD_BYTES = 4 << 20
#: Minimisers of very many candidates that are broadcast at most, 16 bytes each; more are joined.
MOST_BROADCAST = 1_000_000
ROW = ["minimiser", "content", "rk", "start", "end"]
#: Of a run in its chunk: the only one of its content, the first of several, or another of several (dealt by a hash of its own).
ALONE, TWICE, PASSED = 0, 1, 2


def runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, minimiser, content) of each run of windows with one minimiser."""
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    _, down = Powers.upto(n + 1)
    prefix = prefix_hashes(data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    packed = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U64)
    w, starts = width - gram + 1, n - width + 1
    blocks = np.full((-(-len(packed) // w), w), np.iinfo(np.uint64).max)
    blocks.reshape(-1)[: len(packed)] = packed
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & U64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.arange(starts) + width <= offsets[text + 1]
    begins = np.ones(starts, bool)
    begins[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(begins & valid)
    last = offsets[text[begin] + 1] - width + 1
    end = np.minimum(np.append(begin[1:], starts), last) + width - 1
    return text[begin], begin, end, grams[least[begin]], span_hashes(prefix, begin, end)


def _cut(width: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                rk = part.column(0)
                pieces = [(data, offsets, 0)] if len(data) <= PIECE else [(data[a : a + PIECE + width - 1], np.array([0, min(PIECE + width - 1, len(data) - a)]), a) for a in range(0, len(data) - width + 1, PIECE)]
                for piece, ends, at in pieces:
                    text, start, end, minimiser, content = runs(piece, ends, width, gram)
                    if len(text):
                        base = at - ends[text]
                        _, first, kind, count = np.unique(content ^ (minimiser * U64(3)), return_index=True, return_inverse=True, return_counts=True)
                        state = np.where(count[kind] > 1, PASSED, ALONE).astype(np.int8)
                        state[first[count > 1]] = TWICE
                        spread = mix(content + (start + base).astype(U64) * U64(BASE) + rk.take(pa.array(text)).to_numpy().view(U64))
                        key = np.where(state == PASSED, spread, minimiser)
                        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), rk.take(pa.array(text)), pa.array(start + base), pa.array(end + base), pa.array(state)], [*ROW, "state"])

    return cut


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (minimiser, content): whole (its content is repeated), rival (one row of each content whose minimiser has others)."""
    held: pa.RecordBatch | None = None
    before = (None, None)  # minimiser and content of the row before the held ones

    def judge(t: pa.RecordBatch, before: tuple, after: tuple) -> pa.RecordBatch:
        m, c = (t.column(i).to_numpy() for i in (0, 1))
        n = len(m)
        same_m, same_c = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of row i with row i - 1
        same_m[1:n] = m[1:] == m[:-1]
        same_c[1:n] = same_m[1:n] & (c[1:] == c[:-1])
        same_m[0], same_m[n] = before[0] == m[0], after[0] == m[-1]
        same_c[0], same_c[n] = before == (m[0], c[0]), after == (m[-1], c[-1])
        state = t.column(5).to_numpy()
        whole = same_c[:-1] | same_c[1:] | (state != ALONE)
        # A run of equal contents has a rival if its minimiser goes on before or after it.
        other = (same_m & ~same_c)
        first = ~same_c[:-1]
        run = np.cumsum(first) - 1 + (0 if first[0] else 1)
        rivals = np.zeros(run[-1] + 2, bool)
        rivals[run[other[:-1]]] = True
        rivals[run[other[1:]]] = True
        rival = first & rivals[run] & (state != PASSED)
        keep = whole | rival
        out = t.filter(pa.array(keep))
        return pa.record_batch([*out.columns[:5], pa.array(whole[keep]), pa.array(rival[keep])], [*ROW, "whole", "rival"])

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
        m, c = (batch.column(i).to_numpy() for i in (0, 1))
        # The last run of equal contents is held, as what follows may belong to it; of a long run one row is enough.
        change = np.flatnonzero((m[1:] != m[:-1]) | (c[1:] != c[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield judge(batch.slice(0, cut), before, (m[cut], c[cut]))
            before = (m[cut - 1], c[cut - 1])
            held = batch.slice(cut)
        else:
            held = batch
        if held.num_rows > 4096 and held.num_rows > 2:  # all but the first and the last two rows of it are repeated, and no rivals
            mid = held.slice(1, held.num_rows - 2)
            ones = pa.array(np.ones(mid.num_rows, bool))
            yield pa.record_batch([*mid.columns[:5], ones, pa.array(np.zeros(mid.num_rows, bool))], [*ROW, "whole", "rival"])
            held = pa.Table.from_batches([held.slice(0, 1), held.slice(held.num_rows - 1)]).combine_chunks().to_batches()[0]
    if held is not None:
        yield judge(held, before, (None, None))


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. symbols: strings with a 0 after each, other symbols 1 to 256;
    ends: places of the zeros. A zero differs from all others and is ordered by place.

    Larsson-Sadakane refinement: ranks by the first h symbols give ranks by 2h, and only groups of equal rank are sorted on.
    """
    n, h = len(symbols), 7
    key = np.zeros(n, U64)
    wide = np.zeros(n + h, U64)
    wide[:n] = symbols
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    for j in range(h):
        part = wide[j : j + n].copy()
        part[np.arange(n) + j > stop] = 0
        key = (key << U64(9)) | part
    short = np.arange(n) + h > stop
    sa = np.argsort(key)
    slots = np.flatnonzero(short[sa])
    mine = sa[slots]
    sa[slots] = mine[np.lexsort((mine, key[mine]))]
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | short[sa[1:]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = sa[slots]
        key = (rank[at].astype(U64) << U64(32)) | rank[at + h].astype(U64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in sa, zeros not counted.

    Kasai's recurrence, by text position: where a suffix and its neighbour follow the same symbol, the length is one less
    than at the position before. Only the other places are compared, all at once.
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    r = np.flatnonzero(reducible)
    reducible[r] = (symbols[r - 1] == symbols[before[r] - 1]) & (symbols[r - 1] != 0)
    # the neighbour of the position before must be the position before the neighbour
    r = np.flatnonzero(reducible)
    reducible[r] = before[r - 1] == before[r] - 1
    open_ = np.flatnonzero(~reducible & (before >= 0))
    done = np.zeros(n, np.int64)
    while len(open_):
        a, b = open_ + done[open_], before[open_] + done[open_]
        same = (symbols[a] == symbols[b]) & (symbols[a] != 0)
        open_ = open_[same]
        done[open_] += 1
    lengths = done + at
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(lengths[source] - at, 0)[sa]


def repeated_windows(strings: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings laid out one after the other with a gap of one: windows that are repeated, a window of each class, starts of strings."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.uint16)
    starts = ends - sizes
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.concatenate(strings).astype(np.uint16) + 1
    sa = suffix_array(symbols, ends)
    far = common_prefixes(symbols, ends, sa) >= width
    fits = np.repeat(ends, sizes + 1) - np.arange(len(symbols)) >= width
    marks, firsts = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
    marks[sa] = far | np.append(far[1:], False)
    firsts[sa] = ~far
    return marks & fits, firsts & fits, starts


def _shards(width: int):
    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        body = t.column("body").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        raw = np.frombuffer(body.buffers()[2], np.uint8)
        strings = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        marks, firsts, starts = repeated_windows(strings, width)
        rk, base, dealt = t.column("rk"), t.column("start").to_numpy(), t.column("dealt").to_numpy(zero_copy_only=False)
        string = np.repeat(np.arange(len(strings)), np.array([len(s) for s in strings]) + 1)
        place = np.arange(len(marks)) - starts[string] + base[string]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
        a, b = edge[::2], edge[1::2] - 1
        who, begin, end, prints = string[a], place[a], place[b] + width, np.zeros(len(a), np.int64)
        if dealt.any():
            shown = np.flatnonzero(firsts & dealt[string])
            joined = np.zeros(len(marks), np.uint8)
            joined[np.concatenate([np.arange(s, s + len(x)) for s, x in zip(starts, strings, strict=True)])] = np.concatenate(strings)
            p = span_hashes(prefix_hashes(joined), shown, shown + width).view(np.int64)
            p[p == 0] = 1
            who, begin, end, prints = np.append(who, string[shown]), np.append(begin, place[shown]), np.append(end, place[shown] + width), np.append(prints, p)
        return pa.record_batch([pa.array(prints), rk.take(pa.array(who)).combine_chunks(), pa.array(begin), pa.array(end)], ["print", "rk", "start", "end"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m, salt = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("minimiser", "salt"))
            size += batch.column(batch.schema.get_field_index("body")).nbytes
            # A group of one minimiser and salt is never parted: what comes after its last change waits.
            change = np.flatnonzero((m[1:] != m[:-1]) | (salt[1:] != salt[:-1]))
            if size >= SHARD_BYTES and len(change):
                cut = int(change[-1]) + 1
                yield work([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
                size = held[0].column(batch.schema.get_field_index("body")).nbytes
            else:
                held.append(batch)
        if held:
            yield work(held)

    return shards


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut candidates' bytes out of their texts."""
    for batch in batches:
        data, offsets = text_parts(batch.column(batch.schema.get_field_index("text")))
        raw = data.tobytes()
        picks = batch.column(batch.schema.get_field_index("picks"))
        flat, counts = picks.flatten(), np.diff(picks.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), counts)
        start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
        body = [raw[a:b] for a, b in zip((start + offsets[owner]).tolist(), (end + offsets[owner]).tolist(), strict=True)]
        yield pa.record_batch([flat.field("minimiser"), flat.field("salt"), flat.field("dealt"), batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(body, pa.binary())], ["minimiser", "salt", "dealt", "rk", "start", "body"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Published fingerprints, sorted: those found twice or more, by binary search of each in the run."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        p = t.column(0).to_numpy()
        cut = int(np.searchsorted(p, p[-1], "left"))
        if t.num_rows - cut > 100_000:  # so many of one: all are repeated, two stay to tell
            yield t.slice(cut + 2).select(["rk", "start", "end"])
            t = t.slice(0, cut + 2)
        held = t.slice(cut)
        p, t = p[:cut], t.slice(0, cut)
        if cut:
            yield t.filter(pa.array(np.searchsorted(p, p, "right") - np.searchsorted(p, p, "left") > 1)).select(["rk", "start", "end"])
    if held is not None and held.num_rows > 1:
        yield held.select(["rk", "start", "end"])


def _stripper(texts: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _strip(batch, texts)

    return strip


def _strip(batch: pa.RecordBatch, texts: bool) -> pa.RecordBatch:
    data, offsets = text_parts(batch.column(batch.schema.get_field_index("text")))
    found = batch.column(batch.schema.get_field_index("found"))
    flat, places = found.flatten(), found.offsets.to_numpy()
    start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
    out = []
    null = found.is_null().to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        raw = data[offsets[i] : offsets[i + 1]]
        spans, kept = [], raw.tobytes()
        if not null[i] and places[i + 1] > places[i]:
            s, e = start[places[i] : places[i + 1]], end[places[i] : places[i + 1]]
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            first = np.append(True, s[1:] > e[:-1])
            a, b = s[first], e[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)]
            spans = list(zip(a.tolist(), b.tolist(), strict=True))
            edges = [0, *(x for ab in spans for x in ab), len(raw)]
            kept = b"".join(kept[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(raw), len(raw) - len(kept), len(spans), [{"start": x, "end": y} for x, y in spans], kept))
    n, gone, count, spans, kept = (list(x) for x in zip(*out, strict=True))
    return pa.record_batch(
        [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept if texts else [None] * len(kept), pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
    )


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 100, group: int = 4096, texts: bool = True) -> DataFrame:
    """Texts without the bytes that lie in a width-byte string which also starts anywhere else, in the same text or another.

    docs: doc_id, text; other columns are not read. Returns for each row doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (array of start and end bytes removed) and kept (the remaining bytes, which may cut a character).
    group: candidates of one minimiser beyond which they are dealt over several shards. texts: whether kept is filled.
    Null text counts as empty; texts shorter than width keep all. Rows that are repeated count each as a text, so they
    lose what they share; a null doc_id is kept as such. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("rk"), "doc_id", "text")
    rows = docs.select("rk", "text").mapInArrow(lean(_cut(width, gram)), "minimiser long, content long, rk long, start long, end long, state tinyint")
    sifted = staged(rows.repartition(n, "minimiser").sortWithinPartitions("minimiser", "content").mapInArrow(lean(_sift), "minimiser long, content long, rk long, start long, end long, whole boolean, rival boolean"), "sifted")
    # Minimisers of very many candidates are told by rows without bytes, before any bytes are cut out.
    rivals = sifted.filter("rival").select("minimiser", "content", "rk", "start", "end")
    many = staged(rivals.groupBy("minimiser").agg(F.ceil(F.count(F.lit(1)) / group).cast("long").alias("shards")).filter("shards > 1"), "many")
    rivals = rivals.join(F.broadcast(many) if many.count() <= MOST_BROADCAST else many, "minimiser", "left").withColumn("salt", F.pmod("content", F.coalesce("shards", F.lit(1))))
    picks = rivals.groupBy("rk").agg(F.collect_list(F.struct("minimiser", "salt", F.col("shards").isNotNull().alias("dealt"), "start", "end")).alias("picks"))
    # Repeated rows share rk; each is cut, and what they share is repeated in any case.
    bodies = picks.join(docs.select("rk", "text"), "rk").select("rk", "text", "picks").mapInArrow(lean(_bodies), "minimiser long, salt long, dealt boolean, rk long, start long, body binary")
    marks = staged(bodies.repartition(n, "minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(lean(_shards(width)), "print long, rk long, start long, end long"), "marks")
    merged = marks.filter("print <> 0").repartition(n, "print").sortWithinPartitions("print").mapInArrow(lean(_merge), "rk long, start long, end long")
    found = sifted.filter("whole").select("rk", "start", "end").unionByName(marks.filter("print = 0").select("rk", "start", "end")).unionByName(merged)
    found = found.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return docs.join(found, "rk", "left").select("doc_id", "text", "found").mapInArrow(lean(_stripper(texts)), f"{docs.select('doc_id').schema[0].simpleString().replace(':', ' ', 1)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
