"""SentencePiece encoding by sampled segmentation, and lossless decoding.

The lattice of a text holds every way to write it in pieces of the vocabulary. Forward filtering sums the weights of all
paths to each node; backward sampling draws pieces from the end, each in proportion to the paths it stands for. A draw is a
hash of the row's key and the place in the text, so a row is segmented alike in any partition, batch or retry.

No piece goes on past a word into the next word mark, so the lattice falls into units (word marks and the word after them).
The forward pass is made once for each distinct unit of a chunk, all units in step; the draws of all occurrences are made at once.
A vocabulary of merges has ranks, not probabilities: a piece of rank k weighs (k + 20) ** -power.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import lean, tune
from ._text import U64, chunks, mix

MARK, NO_PIECE = 0x2581, 0x110000
HASH = U64(0x9E3779B97F4A7C15)
TABLE_BITS = 18
#: Bytes of text segmented together; the lattice takes some hundred times as much.
CHUNK = 1 << 19
#: Units of more code points are parted where no piece reaches across; code points looked at to find such a place in a long text.
LONG_UNIT, LOOK = 256, 1 << 16


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces as a trie in an open-addressed table, their log weights and their bytes."""

    weights: np.ndarray  # by piece id
    raw: list[bytes]  # what a piece decodes to
    byte_ids: np.ndarray
    splits: bool  # no piece goes on past a word into a mark
    root: np.ndarray = field(repr=False)  # by code point
    table: np.ndarray = field(repr=False)
    target: np.ndarray = field(repr=False)
    piece: np.ndarray = field(repr=False)  # of each trie node, -1 if none; so is the last entry, of node -1
    inner: np.ndarray = field(repr=False)  # whether a trie node has others below it; False for node -1
    longest: int  # code points of a piece

    @classmethod
    def load(cls, path: str, power: float) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        raw, byte_ids, usable = [], np.full(256, -1), np.zeros(n, bool)
        names = [sp.id_to_piece(i) for i in range(n)]
        for i, name in enumerate(names):
            if sp.is_byte(i):
                byte_ids[int(name[3:-1], 16)] = i
                raw.append(bytes([int(name[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                usable[i] = True
                raw.append(name.replace(chr(MARK), " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some bytes, so it can't be lossless")
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n)
        rank[np.lexsort((np.arange(n), -score))] = np.arange(n)
        weights = -power * np.log(rank + 20)
        weights[~usable] = -power * np.log(n + 20)
        next_: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in np.flatnonzero(usable).tolist():
            at = 0
            for c in map(ord, names[i]):
                if c not in next_[at]:
                    next_[at][c] = len(next_)
                    next_.append({})
                    piece.append(-1)
                at = next_[at][c]
            piece[at] = i
        root = np.full(NO_PIECE + 1, -1, np.int32)
        for c, t in next_[0].items():
            root[c] = t
        keys = np.array([(s << 21) | c for s, m in enumerate(next_) if s for c in m], U64)
        to = np.array([t for s, m in enumerate(next_) if s for t in m.values()], np.int32)
        bits = max(TABLE_BITS, int(len(keys)).bit_length() + 2)
        table, target = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        for k, t in zip(keys.tolist(), to.tolist(), strict=True):
            slot = ((k * int(HASH)) & ((1 << 64) - 1)) >> (64 - bits)
            while table[slot]:
                slot = (slot + 1) & ((1 << bits) - 1)
            table[slot], target[slot] = k, t
        marks = [x for x, u in zip(names, usable, strict=True) if u and chr(MARK) in x.lstrip(chr(MARK))]
        return cls(weights, raw, byte_ids, not marks, root, table, target, np.array([*piece, -1], np.int32), np.array([*map(bool, next_), False]), max((len(x) for x, u in zip(names, usable, strict=True) if u), default=1))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie node that follows, -1 if none."""
        key = (state.astype(U64) << U64(21)) | code.astype(U64)
        size = len(self.table)
        slot = ((key * HASH) >> U64(64 - size.bit_length() + 1)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_: np.ndarray | slice = slice(None)  # all of them; few need a second look
        while len(key):
            seen = self.table[slot]
            hit = seen == key
            found = np.flatnonzero(hit)
            out[found if isinstance(open_, slice) else open_[found]] = self.target[slot[found]]
            more = np.flatnonzero(~hit & (seen != 0))
            open_ = more if isinstance(open_, slice) else open_[more]
            key, slot = key[more], (slot[more] + 1) & (size - 1)
        return out


def uncrossed(v: Vocabulary, code: np.ndarray) -> np.ndarray:
    """Whether no piece reaches across the place before each code point (False for the first): all paths of the lattice meet
    there, so what comes before and after is segmented alike together and apart."""
    n = len(code)
    edge = np.zeros(n + 1, np.int64)
    at, state, j = np.arange(n), v.root[code], 1
    while len(at):
        good = state >= 0
        at, state = at[good], state[good]
        whole = at[v.piece[state] >= 0] if j > 1 else at[:0]
        np.add.at(edge, whole + 1, 1)
        np.add.at(edge, whole + j, -1)
        good = at + j < n
        at, state = at[good], state[good]
        state = v.step(state, code[at + j])
        j += 1
    out = np.cumsum(edge)[:n] == 0
    out[:1] = False
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of texts end to end, and how many each has. before: code points of the same row ahead of a text, which then
    is a later part of it; 0: a first part, which gets a word mark in front."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    lone = code == MARK
    code[code == 0x20] = MARK
    code[lone] = NO_PIECE
    base = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    fresh = (before == 0) & (np.diff(offsets) > 0)
    code = np.insert(code, base[:-1][fresh], MARK)
    base = base + np.append(0, np.cumsum(fresh))
    n = len(code)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(keys), np.int64)
    begins = np.zeros(n, bool)
    if v.splits:
        begins[1:] = (code[1:] == MARK) & (code[:-1] != MARK)
    begins[base[:-1][np.diff(base) > 0]] = True
    unit = np.flatnonzero(begins)
    size = np.diff(unit, append=n)
    for a, b in zip(unit[size > LONG_UNIT].tolist(), (unit + size)[size > LONG_UNIT].tolist(), strict=True):
        begins[a + np.flatnonzero(uncrossed(v, code[a:b]))] = True
    unit = np.flatnonzero(begins)
    size = np.diff(unit, append=n)
    power = np.multiply.accumulate(np.append(U64(1), np.full(n, HASH)))
    inverse = np.multiply.accumulate(np.append(U64(1), np.full(n, pow(int(HASH), -1, 1 << 64), U64)))
    total = np.append(U64(0), np.cumsum((code.astype(U64) + U64(1)) * power[:-1]))
    name = mix((total[unit + size] - total[unit]) * inverse[unit] + size.astype(U64))
    _, pick, kind = np.unique(name, return_index=True, return_inverse=True)
    # Distinct units end to end; a unit of n code points has n + 1 nodes.
    length = size[pick]
    line = code[_ranges(unit[pick], length)]
    owner = np.repeat(np.arange(len(length)), length)
    stop = np.cumsum(length)[owner]
    at = np.arange(len(line))
    own = at + owner  # the node before each code point; the one behind it is the next
    state = v.root[line]
    # Every place has an edge of one code point: its piece, or without one its bytes. Longer ones are listed by their length.
    single = v.piece[state]
    bare = single < 0
    longer: list[tuple[np.ndarray, np.ndarray]] = []
    many = np.ones(len(line), np.int64)  # edges that end behind each code point
    j = 1
    while len(at):
        good = np.flatnonzero(v.inner[state] & (at + j < stop[at]))
        at, state = at[good], state[good]
        state = v.step(state, line[at + j])
        j += 1
        good = np.flatnonzero(state >= 0)
        at, state = at[good], state[good]
        token = v.piece[state]
        whole = np.flatnonzero(token >= 0)
        longer.append((at[whole], token[whole]))
        many[at[whole] + (j - 1)] += 1
    # Edges by the distance of their goal from the unit's start, then by goal, long pieces first, as they are drawn most: dealt to
    # their places, since no two of a length share a goal. Every goal has an edge, so no order is left to chance.
    width = np.arange(1, len(line) + 1) - (np.cumsum(length) - length)[owner]
    turn = np.argsort(width.astype(np.min_scalar_type(int(length.max()))), kind="stable")
    goal, many = own[turn] + 1, many[turn]
    last = np.cumsum(many) - 1
    group = last + 1 - many
    place = np.empty(len(line), np.int64)
    place[turn] = group
    node, token = np.empty(int(last[-1]) + 1, np.int64), np.empty(int(last[-1]) + 1, np.int32)
    while longer:
        at, piece = longer.pop()
        end = at + len(longer) + 1
        spot = place[end]
        place[end] += 1
        node[spot], token[spot] = own[at], piece
    node[place], token[place] = own, np.where(bare, -1 - line.astype(np.int32), single)
    weight = v.weights[np.maximum(token, 0)]
    weight[place[bare]] = 3 * v.weights.min()
    reach = np.zeros(len(line) + len(length))
    share, sums = np.empty(len(node)), np.empty(len(goal))
    level = np.append(0, np.cumsum(np.bincount(width)[1:]))
    for m, to in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        a, b = int(group[m]), int(last[to - 1]) + 1
        g = group[m:to] - a
        w = reach[node[a:b]] + weight[a:b]
        top = np.maximum.reduceat(w, g)
        x = np.exp(w - np.repeat(top, many[m:to]), out=share[a:b])
        sums[m:to] = np.add.reduceat(x, g)
        reach[goal[m:to]] = top + np.log(sums[m:to])
    share /= np.repeat(sums, many)
    # Running sums inside each group, in whole steps of 2 ** -32: the same in any chunk.
    more, still = group, many
    for k in range(1, int(many.max())):
        on = np.flatnonzero(still > k)
        more, still = more[on], still[on]
        share[more + k] += share[more + (k - 1)]
    ladder = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(U64)
    ladder[last] = U64(1) << U64(32)
    rung = np.zeros(len(reach), np.int64)
    rung[goal] = group
    # Draws of all occurrences, from the ends of units backward.
    low = (np.cumsum(length) - length + np.arange(len(length)))[kind]
    here = low + size
    text = np.searchsorted(base, unit, "right") - 1
    salt = keys[text] + (before[text] + (before[text] > 0)).astype(U64) * HASH
    origin = unit - base[text]
    live = np.arange(len(unit))
    found, whose, step = [], [], []
    k = 0
    while len(live):
        place = (origin[live] + here[live] - low[live]).astype(U64)
        u = mix(mix(salt[live] + place * HASH)) >> U64(32)
        e = rung[here[live]]
        on = np.flatnonzero(ladder[e] <= u)
        while len(on):
            e[on] += 1
            on = on[ladder[e[on]] <= u[on]]
        found.append(token[e])
        whose.append(live)
        step.append(np.full(len(live), k))
        here[live] = node[e]
        live = live[here[live] > low[live]]
        k += 1
    found, whose, step = np.concatenate(found), np.concatenate(whose), np.concatenate(step)
    many = np.bincount(whose, minlength=len(unit))
    out = np.empty(len(found), np.int64)
    out[np.cumsum(many)[whose] - 1 - step] = found
    count = np.bincount(text, many, minlength=len(keys)).astype(np.int64)
    odd = np.flatnonzero(out < 0)
    if len(odd):
        lone = -1 - out[odd]
        raw = np.frombuffer(np.where(lone == NO_PIECE, MARK, lone).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        wide = np.ones(len(out), np.int64)
        wide[odd] = np.diff(np.flatnonzero((raw & 0xC0) != 0x80), append=len(raw))
        of = np.repeat(np.arange(len(keys)), count)
        count = np.bincount(of, wide, minlength=len(keys)).astype(np.int64)
        begin = np.cumsum(wide) - wide
        out = np.repeat(out, wide)
        out[_ranges(begin[odd], wide[odd])] = v.byte_ids[raw]
    return out.astype(np.int32), count


def _cuts(v: Vocabulary, raw: np.ndarray, most: int) -> list[int]:
    """Byte places where a long text may be parted: at the first space after a word, so no unit is cut, or where there is none
    in LOOK bytes, at the first place that no piece reaches across. A stretch without either stays in one part."""
    out, at = [0], most
    spaced = v.splits
    while at < len(raw):
        near = raw[at : at + LOOK]
        k = np.flatnonzero((near[1:] == 0x20) & (near[:-1] != 0x20)) + 1 if spaced else near[:0]
        if not len(k):
            lead = np.flatnonzero((near & 0xC0) != 0x80)
            lead = lead[:-1] if at + LOOK < len(raw) else lead  # the last may be cut off
            if len(lead):
                ends = np.append(lead[1:], lead[-1] + 1 + int(np.argmax(np.append((near[lead[-1] + 1 :] & 0xC0) != 0x80, True))))
                code = np.frombuffer(near[lead[0] : ends[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
                lone = code == MARK
                code[code == 0x20] = MARK
                code[lone] = NO_PIECE
                # pieces that begin before the window or end behind it aren't seen: its margins don't count
                k = lead[v.longest : max(v.longest, len(lead) - v.longest)][uncrossed(v, code)[v.longest : max(v.longest, len(lead) - v.longest)]]
        if len(k):
            out.append(at + int(k[0]))
            at = out[-1] + most
        else:
            at += max(1, len(near) - 8 * v.longest)
    return [*out, len(raw)]


def _encoder(vocabulary, carry: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        raw = pa.array(v.raw, pa.large_binary())
        for batch in batches:
            for part, data, offsets in chunks(batch, most=CHUNK):
                keys = part.column(part.num_columns - 1).to_numpy().view(U64)
                if len(data) <= 2 * CHUNK or part.num_rows > 1:
                    ids, count = encode(v, data, offsets, keys, np.zeros(len(keys), np.int64))
                else:
                    edges, found, before = _cuts(v, data, CHUNK), [], 0
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        found.append(encode(v, data[a:b], np.array([0, b - a]), keys, np.array([before]))[0])
                        before += int(((data[a:b] & 0xC0) != 0x80).sum())
                    ids = np.concatenate(found)
                    count = np.array([len(ids)])
                ends = np.append(0, np.cumsum(count)).astype(np.int32)
                more = [_texts(raw, ids, ends)] if decoded else []
                yield pa.record_batch([*part.columns[:carry], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(count), *more], [*part.schema.names[:carry], "ids", "n_tokens", *["decoded"] * decoded])

    return run


def encode_sampled(docs: DataFrame, vocabulary: str | None = None, seed: int = 0, power: float = 1.0, carry: tuple[str, ...] = ("doc_id", "text"), decoded: bool = False) -> DataFrame:
    """Sampled segmentations of every whole text: carry, ids (array of int) and n_tokens.

    docs: doc_id, text and what carry names. The row key is doc_id with seed: equal rows get equal ids, another seed others.
    power: how much common pieces weigh; large values lead to the best segmentation. Characters without a piece, and the
    word mark itself, are written as byte pieces, so decode_pieces() gives back every text. Null and empty texts have no ids.
    decoded: add the column of decode_pieces(), from the ids and in the same Python worker; a task then holds one worker, not two.
    """
    spark = docs.sparkSession
    tune(spark)
    v = spark.sparkContext.broadcast(Vocabulary.load(vocabulary or vocabulary_path(), power))
    text = F.col("text").cast("string")
    rows = docs.select(*(F.col(c) if c != "text" else text.alias("text") for c in carry), *([] if "text" in carry else [text.alias("text")]), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("_key"))
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(lean(_encoder(v, len(carry), decoded)), f"{head}ids array<int>, n_tokens long{', decoded string' if decoded else ''}")


def _texts(raw: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of piece ids; raw: what each piece decodes to (large_binary)."""
    _, ends, data = raw.take(pa.array(ids)).buffers()
    data = np.frombuffer(data or b"", np.uint8)
    ends = np.frombuffer(ends, np.int64)[offsets]
    # the first piece of a text begins with the mark that encoding puts in front
    some = np.diff(ends) > 0
    keep = np.ones(len(data), bool)
    keep[ends[:-1][some]] = False
    ends = ends - np.append(0, np.cumsum(some))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(data[keep])])
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def _decoder(raw, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(raw.value, pa.large_binary())
        for batch in batches:
            column = batch.column(place)
            ends = column.offsets.to_numpy()
            texts = _texts(pieces, column.flatten().to_numpy(), ends - ends[0]) if batch.num_rows else pa.array([], pa.string())
            yield pa.record_batch([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return run


def decode_pieces(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Add decoded, the text of the column ids (array of int). Null and empty ids give an empty text; ids that no text has been
    encoded to may hold broken characters, which are replaced."""
    tune(rows.sparkSession)
    raw = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary or vocabulary_path(), 1.0).raw)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(_decoder(raw, rows.columns.index("ids"))), f"{head}, decoded string")
