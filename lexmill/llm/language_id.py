"""Language identification of whole, possibly mixed, texts.

A word's script leaves the languages that were seen to use it. These are scored by letter pairs, letter triples and the word
itself, hashed into buckets with a log probability for each language. Viterbi decoding over a text's words, with a penalty for
each switch, labels spans; the language with the most letters is the prediction. The model is learned from a bounded sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import lean, tune
from ._text import SHINGLE, U64, chunks, mix

BUCKETS = 1 << 17
#: Bytes of text labelled together.
PART = 1 << 20
#: First and last code points of scripts. Fixed values; what is in none of them is script 0.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul_jamo", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s[0] for s in SCRIPTS))
UNKNOWN = "und"
#: A language uses a script if so large a share of its letters is in it.
SCRIPT_SHARE = 0.005
#: Score of a word for a language that doesn't use its script.
FOREIGN = np.float32(-40)


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters, 2 for marks (part of words that begin with a letter), lower case, script."""
    kind = np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(kind == 1).tolist():
        x = chr(c).lower()
        lower[c] = ord(x[0])
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return kind, lower, script


@dataclass
class Words:
    start: np.ndarray  # in code points of the chunk
    end: np.ndarray
    first: np.ndarray  # first word of each text, one more than texts
    base: np.ndarray  # code point offset of each text
    kind: np.ndarray  # each word's place among the distinct ones
    buckets: np.ndarray  # of all features of distinct words
    feature_starts: np.ndarray
    scripts: np.ndarray  # of distinct words
    sizes: np.ndarray  # letters of distinct words


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    kinds, lower, script = letter_tables()
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    base = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    letter = kinds[code]
    w = np.zeros(len(code) + 2, bool)
    w[1:-1] = letter > 0
    begins, ends = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
    cuts = base[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(code))]
    begins[cuts] |= w[1:-1][cuts]
    ends[cuts - 1] |= w[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    real = letter[start] == 1
    start, end = start[real], end[real]
    small = lower[code].astype(U64)
    power = np.multiply.accumulate(np.append(U64(1), np.full(len(code), 0x9E3779B97F4A7C15, U64)))
    total = np.append(U64(0), np.cumsum((small + U64(1)) * power[:-1]))
    inverse = np.multiply.accumulate(np.append(U64(1), np.full(len(code), pow(0x9E3779B97F4A7C15, -1, 1 << 64), U64)))
    whole = mix((total[end] - total[start]) * inverse[start])
    _, pick, kind = np.unique(whole, return_index=True, return_inverse=True)
    a, n = start[pick], end[pick] - start[pick]
    # Distinct words end to end, with a 1 before and after each.
    room = n + 2
    place = np.cumsum(room) - room
    line = np.ones(int(room.sum()), U64)
    at = np.repeat(place + 1 - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
    line[at] = small[np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))]
    pair, triple = np.zeros(len(line), U64), np.zeros(len(line), U64)
    pair[:-1] = line[:-1] * U64(SHINGLE) + line[1:]
    triple[:-2] = (pair[:-2] * U64(SHINGLE) + line[2:]) ^ U64(3 << 40)
    # A word of n letters has n + 1 pairs, n triples and itself: 2 n + 2 features.
    count = 2 * n + 2
    where = np.cumsum(count) - count
    features = np.empty(int(count.sum()), U64)
    for values, size, shift in ((pair, n + 1, 0), (triple, n, n + 1)):
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        features[np.repeat(where + shift, size) + step] = values[np.repeat(place, size) + step]
    features[where + 2 * n + 1] = whole[pick] ^ U64(7 << 40)
    return Words(start, end, np.searchsorted(start, base), base, kind, (mix(features) >> U64(47)).astype(np.int64), where, script[code[a]], n)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    candidates: np.ndarray  # scripts x languages, bool
    penalty: float

    def scores(self, w: Words) -> np.ndarray:
        """Of distinct words, words x languages."""
        if not len(w.sizes):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.add.reduceat(self.weights[w.buckets], w.feature_starts, axis=0) / 2
        return np.where(self.candidates[w.scripts], out, np.where(self.candidates[w.scripts].any(axis=1, keepdims=True), FOREIGN * w.sizes[:, None], 0)).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; texts, words first[i] to first[i + 1], are walked in step, the longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    back, label = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32), np.zeros(len(scores), np.int64)
    own = np.arange(scores.shape[1])
    most = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(most), "left")  # texts of more than t words
    best = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(most):
        a = active[t]
        row = at[:a] + t
        v = best[:a]
        if t:
            top = v.argmax(axis=1)
            switch = (v[np.arange(a), top] - penalty)[:, None]
            stay = v >= switch
            back[row] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, switch)
        best[:a] = v + scores[row]
    state = best.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        a = active[t]
        row = at[:a] + t
        label[row] = state[:a]
        if t:
            state[:a] = back[row, state[:a]]
    return label


def _counts(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            for part, data, offsets in chunks(batch, most=PART):
                w = words_of(data, offsets)
                lang = np.array([number[x] for x in part.column(1).to_pylist()])
                of = np.repeat(lang, np.diff(w.first))
                sizes = np.diff(w.feature_starts, append=len(w.buckets))
                for k in np.unique(lang).tolist():
                    times = np.bincount(w.kind[of == k], minlength=len(w.sizes))
                    total[k, :BUCKETS] += np.bincount(w.buckets, np.repeat(times, sizes), minlength=BUCKETS).astype(np.int64)
                    total[k, BUCKETS:] += np.bincount(w.scripts, times * w.sizes, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        k, b = np.nonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(b), pa.array(total[k, b])], ["k", "bucket", "n"])

    return count


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text, modulo 5, is 0. False for a null doc_id, which isn't learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, docs_per_language: int = 2000, penalty: float = 8.0, most_languages: int = 500) -> Model:
    """docs: doc_id, text, lang. About docs_per_language of each language are learned from, chosen by hash of doc_id; held-out rows never are.

    Raises ValueError for more than most_languages values of lang, as the model has a column for each.
    """
    spark = docs.sparkSession
    tune(spark)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), penalty)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < share[F.col("lang")])
    rows = sample.select("text", "lang").mapInArrow(lean(_counts(languages)), "k long, bucket long, n long")
    t = rows.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    total[t.column("k").to_numpy(), t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    seen, scripts = total[:, :BUCKETS] + 0.3, total[:, BUCKETS:]
    weights = np.log(seen / seen.sum(axis=1, keepdims=True))
    weights -= weights.mean(axis=0)  # what all languages share says nothing
    return Model(languages, weights.T.astype(np.float32).copy(), (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE).T, penalty)


def _label(model, spans: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.languages)
        for batch in batches:
            for part, data, offsets in chunks(batch, "_text", PART):
                w = words_of(data, offsets)
                n = part.num_rows
                lang, score, parts = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                if k and len(w.start):
                    labels = viterbi(m.scores(w)[w.kind], w.first, m.penalty)
                    text = np.repeat(np.arange(n), np.diff(w.first))
                    letters = np.bincount(text * k + labels, w.sizes[w.kind], minlength=n * k).reshape(n, k)
                    top, all_ = letters.argmax(axis=1), letters.sum(axis=1)
                    score = np.where(all_ > 0, letters[np.arange(n), top] / np.maximum(all_, 1), 0.0)
                    lang = [m.languages[i] if some else UNKNOWN for i, some in zip(top.tolist(), (all_ > 0).tolist(), strict=True)]
                    if spans:
                        new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])))
                        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(labels)], strict=True):
                            d = int(text[i])
                            parts[d].append({"start": int(w.start[i] - w.base[d]), "end": int(w.end[j - 1] - w.base[d]), "lang": m.languages[labels[i]]})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.record_batch([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(parts, kind)], [*part.schema.names[:-1], "lang_pred", "score", "spans"])

    return label


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """Predict the language of every whole text by a learned model.

    Reads carry (which names no column of the result) and text; returns carry, lang_pred, score and spans (code points start to end and the language of each span,
    empty if spans is False). score is the share of the text's letters that are labelled lang_pred; ties go to the first
    language by name. Null texts, texts without letters, and all texts if no language was learned, are "und" with score 0.
    Repeated rows get equal results; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    head = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(lean(_label(spark.sparkContext.broadcast(model), spans)), f"{head}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
