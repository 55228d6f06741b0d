"""Exact similarity join of documents on their sets of word n-grams, and the classes that its links make.

Equal sets are one class from the start, so copies are never paired. The other sets reach a common shard by pigeonhole: a
set in the global order (of hashes) is cut into so many ranges that two linked sets must agree on one which is not empty.
Sets of few n-grams, where ranges may be empty, are routed by prefix tokens instead. Nothing is closed over candidates, only
over links that are verified:

1. of the sets with a key, each is joined with the least one, its pivot; a set meets a pivot once, however many keys they share;
2. these links are closed. A key is done if all its sets but the pivot are of one class by now;
3. the sets of the keys that are left are compared by sketches, in blocks (keys that overlap as one group where that takes fewer
   rows than key by key); those that may link are joined with one another, and all links are closed again;
4. if links are to be counted, the sets of each class are joined with one another, in blocks. All links lie inside classes.

A join stores sets in a prefix tree, each in one global order, that of hashes; n-grams found in the same members are one
weighted token. One traversal carries the partial overlaps of all probes at once, and a subtree is left when no probe can
still reach the threshold with the lengths that remain. Overlaps at the leaves are exact sums. Hashes of n-grams and sets
have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._session import discard, lean, partitions, staged, tune
from ._skew import salted_join
from ._text import SPACED, U64, chunks, mix, prefix_hashes, shingle_hashes, span_hashes, word_spans

#: Sets below this size are routed by prefix tokens; sizes from there on fall in classes of this ratio.
SMALL, RATIO = 40, 2.0
#: Ranges that a class of sizes has, times those needed.
SPARE = 1.15
#: Members and n-grams of a block of candidates.
BLOCK_MEMBERS, BLOCK_GRAMS = 250, 500_000
#: The same of a block of sketches.
SKETCH_MEMBERS, SKETCH_GRAMS = 2_000, 8_000_000
#: Row keys of classes that are broadcast at most, 8 bytes each; keys of sets are shuffled to more.
MOST_BROADCAST = 1_000_000


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; all words as one if there are fewer than size, none without words."""
    mapped, starts, ends, first = word_spans(data, offsets, SPACED)
    words = span_hashes(prefix_hashes(mapped), starts, ends)
    grams = shingle_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif b > a:
            out.append(mix(shingle_hashes(words[a:b], b - a) + U64(b - a)))
        else:
            out.append(words[:0])
    return out


def set_id(grams: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    with np.errstate(over="ignore"):
        return int((mix(grams).sum(dtype=U64) + U64(len(grams)) * U64(0x9E3779B97F4A7C15)).view(np.int64))


def sketch(grams: np.ndarray) -> bytes:
    """Counts of a set's hashes, up to 255, by their leading bits; a power of two of counts, one for two to four hashes."""
    bits = max(1, math.ceil(math.log2(max(1, len(grams)) / 4)))
    return np.minimum(np.bincount((grams >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Rows of counts as n counts each."""
    return counts.reshape(len(counts), n, -1).sum(axis=2, dtype=np.int32)


def least_apart(a: bytes, b: bytes) -> int:
    """Members that just one of two sets has, at least, by their sketches."""
    n = min(len(a), len(b))
    x, y = (folded(np.frombuffer(s, np.uint8)[None], n) for s in (a, b))
    return int(np.abs(x - y).sum())


def near_pairs(sizes: np.ndarray, sketches: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of different sets whose sketches don't rule out a link, each once: (index, indices)."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    widths = np.array([len(sketches[k]) for k in order.tolist()])  # they grow with sizes
    for width in np.unique(widths).tolist():
        lo, hi = np.searchsorted(widths, [width, width + 1]).tolist()
        end = int(np.searchsorted(sizes, 100 * sizes[hi - 1] // percent, "right"))
        table = np.concatenate([folded(np.frombuffer(sketches[k], np.uint8)[None], width) for k in order[lo:end].tolist()])
        table = table.astype(np.int16 if len(table) and table.max() < 1 << 14 else np.int32)
        for i in range(lo, hi):
            last = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
            apart = np.abs(table[i + 1 - lo : last - lo] - table[i - lo]).sum(axis=1, dtype=np.int64)
            met = np.flatnonzero((100 + percent) * apart <= (100 - percent) * (sizes[i + 1 : last] + sizes[i]))
            if len(met):
                yield int(order[i]), order[i + 1 + met]


class Routes:
    """Keys such that any two different sets linked at percent/100 share one at least."""

    def __init__(self, percent: int) -> None:
        self.p = percent
        self.bounds = [SMALL]
        self.edges: dict[int, np.ndarray] = {}

    def apart(self, a: int, b: int) -> int:
        """Members that just one of two linked sets of these sizes has, at most."""
        return (100 - self.p) * (a + b) // (100 + self.p)

    def scheme(self, i: int) -> tuple[int, np.ndarray]:
        """Upper size of class i, and the lower ends of its ranges."""
        while len(self.bounds) < i + 2:
            self.bounds.append(int(self.bounds[-1] * RATIO))
        top = self.bounds[i + 1]
        if i not in self.edges:
            n = int(self.apart(top - 1, top - 1) * SPARE) + 4
            self.edges[i] = np.array([(k << 64) // n for k in range(n)], U64)
        return top, self.edges[i]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        n, out = len(grams), []
        at = 0
        while n >= SMALL and n >= self.scheme(at)[0]:
            at += 1
        schemes = [at] if n >= SMALL else []
        above = at + 1 if n >= SMALL else 0
        low = self.scheme(above - 1)[0] if above else SMALL
        if 100 * n >= self.p * low:
            schemes.append(above)
        plain = n < SMALL
        mixed = mix(grams)
        for i in schemes:
            top, edges = self.scheme(i)
            cut = np.searchsorted(grams, edges)
            count = np.diff(cut, append=n)
            full = np.flatnonzero(count)
            apart = self.apart(n, min(top - 1, 100 * n // self.p))
            # Ranges in the order of falling counts, which their contents fix: of two linked sets each has at most apart before the first that they share.
            some = np.argsort(-count[full], kind="stable")[: apart + 1]
            out.append(mix(np.add.reduceat(mixed, cut[full])[some] + mix((full[some] + (i << 32)).astype(U64))))
            plain |= len(full) <= apart
        if plain and n:
            out.append(mix(grams[: n - -(-self.p * n // 100) + 1] + U64(0x5851F42D4C957F2D)))
        return np.concatenate(out) if out else np.zeros(0, U64)


def _sets(size: int, percent: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = Routes(percent)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = gram_sets(data, offsets, size)
                keys = [routes.keys(x).view(np.int64) for x in found]
                ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([set_id(x) if len(x) else None for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))],
                    ["doc_id", "rk", "n_shingles", "sid", "sketch", "keys"],
                )

    return sets


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sid): (sid, pivot) without a key, once a batch, for sets with a key that a lesser one, the pivot, has too;
    and with the key for keys of three sets or more. At most two rows and the pivot of the last key are carried on."""
    none = np.zeros(0, np.int64)
    held = (none, none)  # of a key of which two sets at most have been seen
    on: tuple | None = None  # a key of more, its pivot and its last set

    def told(key: np.ndarray, sid: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, on
        again = np.zeros(len(key), bool)  # repeated rows
        again[1:] = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
        again[:1] = on is not None and (key[0], sid[0]) == (on[0], on[2])
        key, sid = key[~again], sid[~again]
        if not len(key):
            return
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(start, append=len(key))
        pivot, more = sid[start].copy(), size > 2
        if on is not None and on[0] == key[0]:
            pivot[0], more[0] = on[1], True
        end = len(key)
        if not last and not more[-1]:
            end = int(start[-1])
            held, on = (key[end:], sid[end:]), None
        else:
            held, on = (none, none), (key[-1], pivot[-1], sid[-1])
        run = np.repeat(np.arange(len(start)), size)[:end]
        key, sid, pivot, more = key[:end], sid[:end], pivot[run], more[run]
        far = sid != pivot
        pairs = np.unique(np.stack([sid[far], pivot[far]], axis=1), axis=0)
        rest = more & far
        if len(pairs):
            yield pa.record_batch([pa.array(np.append(x, y)) for x, y in ((pairs[:, 0], sid[rest]), (pairs[:, 1], pivot[rest]))] + [pa.array(np.append(np.zeros(len(pairs), np.int64), key[rest]), mask=np.append(np.ones(len(pairs), bool), np.zeros(int(rest.sum()), bool)))], ["sid", "pivot", "key"])

    for batch in batches:
        if batch.num_rows:
            key, sid = (np.append(h, batch.column(i).to_numpy()) for i, h in enumerate(held))
            yield from told(key, sid, False)
    if len(held[0]):
        yield from told(*held, True)


def trie_links(sets: list[np.ndarray], percent: int, stored: np.ndarray | None = None, probes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set stored in the tree the probes that it links with, itself left out: (index, indices). All of both unless given."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    count = np.diff(start, append=len(every))
    marks = mix(np.arange(1, n + 1, dtype=U64))
    sig = np.add.reduceat(marks[owner], start)
    shared = np.flatnonzero(count > 1)  # an n-gram of one member adds to no overlap
    _, pick, weight = np.unique(sig[shared], return_index=True, return_counts=True)
    rep = shared[pick]
    rank = np.argsort(rep)  # the order of hashes, the same in every block
    rep, weight = rep[rank], weight[rank].astype(np.int64)
    # members of token r: owner[begin[r] : begin[r] + freq[r]]
    begin, freq = start[rep], count[rep]
    flat = np.repeat(begin - np.append(0, np.cumsum(freq)[:-1]), freq) + np.arange(int(freq.sum()))
    token = np.repeat(np.arange(len(rep)), freq)
    member = owner[flat]
    dense = None
    if len(rep) * n <= 8_000_000:
        dense = np.zeros((len(rep), n), np.float32)
        dense[token, member] = weight[token]
    by = np.lexsort((token, member))
    places = np.searchsorted(member[by], np.arange(n + 1))
    ordered = token[by]
    seqs = [ordered[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
    names = [x.astype(">u4").tobytes() for x in seqs]
    line = sorted(range(n) if stored is None else stored.tolist(), key=names.__getitem__)
    probes = np.arange(n) if probes is None else probes
    cum = np.append(0, np.cumsum(freq))

    def added(chain: np.ndarray, alive: np.ndarray) -> np.ndarray:
        if not len(chain):
            return np.zeros(len(alive), np.int64)
        if dense is not None:
            rows = dense[chain] if len(alive) == n else dense[np.ix_(chain, alive)]
            return rows.sum(axis=0, dtype=np.float64).astype(np.int64)
        who = np.concatenate([member[cum[t] : cum[t + 1]] for t in chain])
        return np.bincount(who, np.repeat(weight[chain], freq[chain]), minlength=n).astype(np.int64)[alive]

    stack = [(0, len(line), 0, 0, np.zeros(len(probes), np.int64), probes)] if line else []
    while stack:
        lo, hi, depth, passed, overlap, alive = stack.pop()
        first = seqs[line[lo]]
        if hi - lo > 1:
            last = seqs[line[hi - 1]]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            common = depth + int(differ[0]) if len(differ) else m
        else:
            common = len(first)
        chain = first[depth:common]
        overlap = overlap + added(chain, alive)
        passed += int(weight[chain].sum())
        inside = sizes[line[lo:hi]]
        left = np.minimum(inside.max() - passed, sizes[alive] - overlap)
        can = (100 + percent) * (overlap + left) >= percent * (sizes[alive] + inside.min())
        overlap, alive = overlap[can], alive[can]
        if not len(alive):
            continue
        if hi - lo == 1:
            y = line[lo]
            linked = (100 + percent) * overlap >= percent * (sizes[alive] + sizes[y])
            linked &= alive != y
            if linked.any():
                yield y, alive[linked]
            continue
        at = lo
        while at < hi:
            seq = seqs[line[at]]
            if len(seq) == common:  # ends here: a leaf of its own
                end = at + 1
                stack.append((at, end, common, passed, overlap, alive))
            else:
                head, end = seq[common], at + 1
                while end < hi and seqs[line[end]][common] == head:
                    end += 1
                stack.append((at, end, common, passed, overlap, alive))
            at = end


def _join(size: int, percent: int):
    def group(rows: dict[int, tuple], cross: bool) -> list[tuple[int, int, int]]:
        sids = list(rows)
        sets, mult = [rows[s][0] for s in sids], np.array([rows[s][1] for s in sids])
        sides = np.array([rows[s][2] for s in sids])
        parent = list(range(len(sids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = np.zeros(len(sids), np.int64)
        for y, others in trie_links(sets, percent, *((np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if cross else ())):
            links[y] += mult[others].sum()
            if cross:
                links[others] += mult[y]
            for x in others.tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        return [(sids[i], sids[root(i)], int(links[i])) for i in range(len(sids)) if links[i]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        last = None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for part, data, offsets in chunks(batch):
                sets = gram_sets(data, offsets, size)
                cols = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("comp", "i", "j", "side", "sid", "mult")]
                for comp, i, j, s, sid, mult, x in zip(*cols, sets, strict=True):
                    if (comp, i, j) != last:
                        if len(held) > 1:
                            out += group(held, last[1] != last[2])
                        held, last = {}, (comp, i, j)
                    held[sid] = (x, mult, s)
                if len(out) > 10_000:
                    yield _rows(out)
                    out = []
        if len(held) > 1:
            out += group(held, last[1] != last[2])
        if out:
            yield _rows(out)

    def _rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["sid", "root", "links"])

    return join


def _verify(size: int, percent: int):
    """Rows sorted by (pivot, part), the pivot's first: links (sid, pivot). Members are stored in trees of bounded size, the pivot probes them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead, held, grams = None, None, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held and lead is not None:
                sids = list(held)
                n = len(sids)
                found = [sids[y] for y, _ in trie_links([*held.values(), lead], percent, np.arange(n), np.array([n]))]
                if found:
                    yield pa.record_batch([pa.array(found, pa.int64()), pa.array([last[0]] * len(found), pa.int64())], ["a", "b"])
            held.clear()

        for batch in batches:
            for part, data, offsets in chunks(batch):
                cols = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("pivot", "part", "sid")]
                for pivot, k, sid, x in zip(*cols, gram_sets(data, offsets, size), strict=True):
                    if (pivot, k) != last or len(held) >= BLOCK_MEMBERS or grams >= BLOCK_GRAMS:
                        yield from flush()
                        grams = 0
                        if (pivot, k) != last:
                            last, lead = (pivot, k), None
                    if sid == pivot:
                        lead = x
                    else:
                        held[sid] = x
                        grams += len(x)
        yield from flush()

    return verify


def _unruled(percent: int):
    """Rows (sid, pivot, n, sketch, far_n, far_sketch): those, (sid, pivot), whose sketches don't rule out a link."""

    def unruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, far_n, a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "far_n", "sketch", "far_sketch"))
            may = [(100 + percent) * max(abs(i - j), least_apart(x, y)) <= (100 - percent) * (i + j) for i, j, x, y in zip(n, far_n, a, b, strict=True)]
            yield batch.select(["sid", "pivot"]).filter(pa.array(may, pa.bool_()))

    return unruled


def _near(percent: int):
    """Rows sorted by (comp, i, j), of sets with class and sketch: (a, b) such that sets of different classes that may link are connected."""

    def group(rows: dict[int, tuple], cross: bool) -> Iterator[pa.RecordBatch]:
        sids = np.array(list(rows))
        sizes, sketches, c, side = zip(*rows.values(), strict=True)
        c, side = np.array(c), np.array(side)
        parent = list(range(len(sids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for y, others in near_pairs(np.array(sizes), list(sketches), percent):
            met = c[others] != c[y]
            if cross:
                met &= side[others] != side[y]
            for x in others[met].tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = np.array([root(x) for x in range(len(sids))])
        found = np.flatnonzero(roots != np.arange(len(sids)))
        if len(found):
            yield pa.record_batch([pa.array(sids[found]), pa.array(sids[roots[found]])], ["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        last = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("comp", "i", "j", "sid", "n", "sketch", "c", "side")]
            for comp, i, j, sid, *row in zip(*cols, strict=True):
                if (comp, i, j) != last:
                    if len(held) > 1:
                        yield from group(held, last[1] != last[2])
                    held, last = {}, (comp, i, j)
                held[sid] = row
        if len(held) > 1:
            yield from group(held, last[1] != last[2])

    return near


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (sid, pivot) whose sketches don't rule out a link."""
    counts = staged(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows")), "pivots")
    leads = classes.select(F.col("sid").alias("pivot"), F.col("n").alias("far_n"), F.col("sketch").alias("far_sketch")).join(counts.select("pivot"), "pivot", "left_semi")
    rows = salted_join(pairs, leads, "pivot", ["sid"], counts).join(classes.select("sid", "n", "sketch"), "sid")
    return staged(rows.mapInArrow(lean(_unruled(percent)), "sid long, pivot long"), "near")


def _may_group(groups: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """groups: comp, sid, rk, mult, n. The same columns, for groups of sets that may link and aren't of one class yet (labels: v, c): none that may link are apart."""
    about = classes.select("sid", "n", "sketch").join(labels, F.col("sid") == labels.v, "left").select("sid", "n", "sketch", F.coalesce("c", "sid").alias("c"))
    about = staged(about.join(groups.select("sid").distinct(), "sid", "left_semi"), "about")
    rows = _blocks(groups, percent, SKETCH_MEMBERS, SKETCH_GRAMS).drop("rk", "mult").join(about, "sid")
    rows = rows.repartition(partitions(groups.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    met = components(staged(rows.mapInArrow(lean(_near(percent)), "a long, b long"), "near"))
    return staged(met.select(F.col("c").alias("comp"), F.col("v").alias("sid")).join(classes.select("sid", "rk", "mult", "n"), "sid"), "groups")


def _wanted(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that rows name by rk: the others aren't shuffled."""
    keys = staged(rows.select("rk").distinct(), "wanted")
    return texts.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "rk", "left_semi")


def _star_links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs: sid, pivot, all different. The links among them: a, b. A pivot of very many sets is copied to parts of them."""
    n = partitions(pairs.sparkSession)
    counts = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"))
    counts = staged(counts.withColumn("parts", F.ceil(F.col("rows") / BLOCK_MEMBERS).cast("int")), "pivots")
    rows = salted_join(pairs, counts.select("pivot", "parts"), "pivot", ["sid"], counts.select("pivot", "rows")).select("pivot", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("part"), "sid", F.lit(1).alias("later"))
    leads = counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("sid"), F.lit(0).alias("later"))
    rows = staged(rows.union(leads).join(classes.select("sid", "rk"), "sid"), "stars")
    rows = rows.join(_wanted(texts, rows), "rk").select("pivot", "part", "later", "sid", "text")
    return rows.repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", "later").mapInArrow(lean(_verify(size, percent)), "a long, b long")


def _blocks(found: DataFrame, percent: int, most: int, grams: int) -> DataFrame:
    """Rows of found for each block, of most members and so many grams, of their group: (comp, i, j), with side (whether in part i).

    A small group is one block. A large one is cut into bands of size, and these by hash into parts that fit. As linked sets
    are at most one band apart, part i and part j meet only if their bands are equal or next to each other.
    """
    step = math.log(100 / percent) * 1.001
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), ((F.count(F.lit(1)) > most) | (F.sum("n") > grams)).alias("large"))
    found = salted_join(found, sizes.select("comp", "large"), "comp", ["sid"], sizes.select("comp", "rows"))
    found = staged(found.withColumn("band", F.when(F.col("large"), F.floor(F.log("n") / step)).otherwise(0).cast("long")).withColumn("at", F.concat_ws(":", "comp", "band")), "banded")
    parts = found.groupBy("comp", "band").agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / grams)).cast("long").alias("parts"))
    parts = staged(parts, "parts")
    # For each band the parts of the bands that its members meet: its own and, of a large group, its neighbours'.
    near = parts.select("comp", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct(F.col("band").alias("near"), "parts").alias("met"))
    near = near.groupBy("comp", "band").agg(F.collect_list("met").alias("met")).join(parts, ["comp", "band"])
    near = near.select(F.concat_ws(":", "comp", "band").alias("at"), "met", "parts", "rows")
    own = salted_join(found, near.select("at", "met", "parts"), "at", ["sid"], near.select("at", "rows"))
    own = own.withColumn("here", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("sid"), "parts")).withColumn("m", F.explode("met"))
    own = own.withColumn("there", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m.parts") - 1), lambda k: F.col("m.near") * (1 << 32) + k)))
    return own.select("comp", F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"), (F.col("here") < F.col("there")).cast("int").alias("side"), "sid", "mult", "rk")


def _joined(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """groups: comp, sid, rk, mult, n. Joins the sets of each group with one another: sid, root (of its links in a block), links."""
    rows = _blocks(groups, percent, BLOCK_MEMBERS, BLOCK_GRAMS).join(_wanted(texts, groups), "rk").select("comp", "i", "j", "side", "sid", "mult", "text")
    rows = rows.repartition(partitions(groups.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return staged(rows.mapInArrow(lean(_join(size, percent)), "sid long, root long, links long"), "links")


def _open_groups(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the keys whose sets, but for the pivot, are of several classes: comp (a name of the group, one for keys of the same sets) and sid."""
    rows = stars.filter("key is not null").select("key", "sid").join(labels, F.col("sid") == labels.v, "left").select("key", "sid", F.coalesce("c", "sid").alias("c"))
    left = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("sid")).alias("comp")).filter("a <> b")
    left = staged(left.withColumn("comp", F.xxhash64("comp", "rows")), "open")
    once = left.groupBy("comp").agg(F.min("key").alias("key"), F.first("rows").alias("rows"))
    return salted_join(stars.filter("key is not null").select("key", "sid"), once.select("key", "comp"), "key", ["sid"]).select("comp", "sid")


def _cheapest(groups: DataFrame) -> DataFrame:
    """groups: comp, sid and more. Groups that overlap, as one, where that takes no more rows in blocks than the groups do; else as they are."""
    least = groups.groupBy("comp").agg(F.min("sid").alias("b"), F.count(F.lit(1)).alias("rows"))
    labels = components(salted_join(groups.select("comp", "sid"), least.select("comp", "b"), "comp", ["sid"], least.select("comp", "rows")).select(F.col("sid").alias("a"), "b"))
    rows = staged(groups.join(labels, groups.sid == labels.v).drop("v"), "overlaps")
    members = labels.groupBy("c").agg(F.count(F.lit(1)).alias("members"))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("rows")).join(members, "c")
    sizes = staged(sizes.withColumn("one", F.col("members") * F.ceil(F.col("members") / SKETCH_MEMBERS) <= F.col("rows")), "overlap_sizes")
    rows = salted_join(rows, sizes.select("c", "one"), "c", ["sid", "comp"], sizes.select("c", "rows"))
    return rows.withColumn("comp", F.when(F.col("one"), F.xxhash64("c", F.lit("one"))).otherwise(F.col("comp"))).drop("c", "one").dropDuplicates(["comp", "sid"])


def similarity_classes(docs: DataFrame, size: int = 4, percent: int = 85, row_key: bool = False, links: bool = True) -> DataFrame:
    """Link documents with 100 * intersection >= percent * union of their sets of size-word n-grams, and close the links.

    docs: doc_id, text; other columns are not read. Words are runs of non-white space with A-Z lower-cased; fewer words than
    size make one n-gram. Returns for each row doc_id, n_shingles (size of its set), component_id (the smallest doc_id
    reached by links, itself included) and n_links (rows it links with directly). Null or wordless texts have no set and
    link with nothing. row_key adds rk, xxhash64 of doc_id as text and text, and root, which tells classes of one component_id
    apart (rows of one doc_id may be of several; null without a set). links: whether n_links is wanted; counting them takes all pairs of a class,
    closing them doesn't. Equal sets always link, so repeated rows do. A null doc_id is never a component's id, unless all are null.
    """
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("rk"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = staged(docs.mapInArrow(lean(_sets(size, percent)), f"doc_id {kind}, rk long, n_shingles long, sid long, sketch binary, keys array<long>"), "members")
    members = staged(made.drop("keys", "sketch"), "members")
    classes = made.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.count(F.lit(1)).alias("mult"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "classes")
    # Keys of one row of each class only, so copies don't crowd them.
    reps = classes.select("rk")
    keys = made.select("rk", "sid", "keys").join(F.broadcast(reps) if reps.count() <= MOST_BROADCAST else reps, "rk", "left_semi").select(F.explode("keys").alias("key"), "sid")
    stars = staged(keys.repartition(n, "key").sortWithinPartitions("key", "sid").mapInArrow(lean(_stars), "sid long, pivot long, key long"), "stars")
    texts = docs.select("rk", "text")
    discard(made)
    pairs = staged(stars.filter("key is null").select("sid", "pivot").distinct(), "pairs")
    near = _may_link(pairs, classes, percent)
    found = staged(_star_links(near, classes, texts, size, percent), "links")
    labels = components(found)
    open_ = staged(_open_groups(stars, labels).join(classes.drop("least", "sketch"), "sid"), "open")
    discard(stars, pairs, near)
    if not open_.isEmpty():
        overlaps = staged(_cheapest(open_), "groups")
        groups = _may_group(overlaps, classes, labels, percent)
        discard(overlaps)
        more = _joined(groups, texts, size, percent)
        labels = components(found.union(more.select("sid", "root")))
        discard(groups, more)
    discard(open_, found)
    sets = staged(classes.join(labels, classes.sid == labels.v, "left").select("sid", "least", "rk", "mult", "n", F.coalesce("c", "sid").alias("comp")), "sets")
    whole = sets.groupBy("comp").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("rows"), F.sum("mult").alias("all"))
    sets = staged(salted_join(sets, whole.select("comp", "component", F.col("rows").alias("kinds"), "all"), "comp", ["sid"], whole.select("comp", "rows")), "labelled")
    if links:
        counted = _joined(sets.filter("kinds > 2").select("comp", "sid", "rk", "mult", "n"), texts, size, percent).groupBy("sid").agg(F.sum("links").alias("links"))
        sets = sets.join(counted, "sid", "left").withColumn("links", F.when(F.col("kinds") > 2, F.coalesce("links", F.lit(0)) + F.col("mult") - 1).otherwise(F.col("all") - 1))
    told = sets.select("sid", "component", F.col("comp").alias("root"), *(["links"] if links else []))
    by_row = salted_join(members.filter("sid is not null"), told, "sid", ["rk"], classes.select("sid", F.col("mult").alias("rows")))
    bare = members.filter("sid is null").select("*", F.col("doc_id").alias("component"), F.lit(None).cast("long").alias("root"), *([F.lit(0).cast("long").alias("links")] if links else []))
    return by_row.unionByName(bare).select(*(["rk", "root"] if row_key else []), "doc_id", "n_shingles", F.col("component").alias("component_id"), *([F.col("links").cast("long").alias("n_links")] if links else []))
