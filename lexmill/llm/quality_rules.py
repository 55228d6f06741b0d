"""Quality rules learned from labelled statistics, as an ordered decision list.

Statistics of a text are counted by numpy kernels. The list is learned by sequential covering: a rule, a conjunction of
thresholds, is grown on two thirds of the labelled rows by information gain and pruned on the others; rows that it covers
leave, and the next rule is learned from the rest. The list becomes one ordered Spark conditional expression, first match wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import lean, staged, tune
from ._text import SPACED_CASED, U64, chunks, mix, prefix_hashes, shingle_hashes, span_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "longest_word")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), list(b"!?.,;:"))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text."""
    _, starts, ends, first = word_spans(data, offsets, SPACED_CASED)
    texts = np.arange(len(offsets) - 1)
    prefix = prefix_hashes(data)
    words = span_hashes(prefix, starts, ends)
    text = np.repeat(texts, np.diff(first))
    salt = mix(texts.astype(U64) + U64(1))
    # words inside 3-word windows that the text has twice or more
    grams = shingle_hashes(words, 3)
    at = np.flatnonzero(text[: len(grams)] == text[2:]) if len(grams) else np.zeros(0, np.int64)
    key = grams[at] ^ salt[text[at]]
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    twice = at[order][same[:-1] | same[1:]]
    again = np.zeros(len(words) + 2, bool)
    for j in range(3):
        again[twice + j] = True
    # lines with a word, equal to an earlier line
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    owner = np.searchsorted(offsets, begin, "right") - 1
    # empty texts share their offset with the next text; a break at the end of a text begins an empty line of no interest
    begin, owner = begin[owner < len(texts)], owner[owner < len(texts)]
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[owner + 1])
    cut = (stop > begin) & (data[np.maximum(stop - 1, 0)] == 10 if len(data) else False)
    stop = stop - cut
    wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, owner = begin[wordy], stop[wordy], owner[wordy]
    lines = span_hashes(prefix, begin, stop) ^ salt[owner]
    _, once = np.unique(lines, return_index=True)
    n_lines = np.bincount(owner, minlength=len(texts))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a word may begin where another ends, in the next text
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lead = (data & 0xC0) != 0x80
    widest = np.zeros(len(texts), np.int64)
    np.maximum.at(widest, text, ends - starts)
    return [
        np.diff(first), _per_text(inside & lead, offsets), _per_text(_SYMBOL[data], offsets), n_lines - np.bincount(owner[once], minlength=len(texts)), _per_text(again[:-2], first),
        n_lines, _per_text(lead, offsets), _per_text(_UPPER[data], offsets), _per_text(_DIGIT[data], offsets), _per_text(_MARK[data], offsets), widest,
    ]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in chunks(batch):
            yield pa.record_batch([part.column(0), *(pa.array(x.astype(np.int64)) for x in text_counts(data, offsets))], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row; null text counts as empty."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(_count), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What rules may ask about, from the counts."""
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": of("word_chars", "n_words"), "symbols_per_word": of("n_symbols", "n_words"), "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_word_share": of("n_repeat_words", "n_words"), "upper_share": of("n_upper", "n_chars"), "digit_share": of("n_digits", "n_chars"), "marks_per_word": of("n_marks", "n_words"),
        "words_per_line": of("n_words", "n_lines"), "longest_word": F.col("longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """All of conditions, (feature, "<=" or ">=", threshold), lead to the verdict."""

    conditions: tuple[tuple[str, str, float], ...]
    keep: bool
    covered: int = 0
    right: int = 0

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] >= t
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (columns[f] <= t if op == "<=" else columns[f] >= t)
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int, aside: set[tuple[str, str]]) -> list[tuple[str, str, float]]:
    """Conditions by information gain, one after the other; the first is none that has been put aside."""
    inside = np.ones(len(bad), bool)
    out: list[tuple[str, str, float]] = []
    while len(out) < most and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        base = np.log2(p / (p + n))
        best = (1e-9, None)
        for f, v in x.items():
            values, b = v[inside], bad[inside]
            order = np.argsort(values, kind="stable")
            values, b = values[order], b[order]
            pos = np.append(0, np.cumsum(b))
            edges = np.flatnonzero(np.diff(values)) + 1  # rows below an edge are under it
            if len(edges) > cuts:
                edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
            for op, k, of in (("<=", edges, lambda e: (pos[e], e)), (">=", edges, lambda e: (pos[-1] - pos[e], len(b) - e))):
                good, all_ = of(k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(good > 0, good * (np.log2(good / all_) - base), -1)
                if len(gain) and gain.max() > best[0] and (out or (f, op) not in aside):
                    i = int(np.argmax(gain))
                    middle = float((values[k[i] - 1] + values[k[i]]) / 2)
                    best = (float(gain[i]), (f, op, middle))
        if best[1] is None:
            break
        out.append(best[1])
        inside &= Rule((best[1],), False).matches(x)
    return out


def _pruned(conditions: list[tuple[str, str, float]], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The rule of the first conditions that do best on the rows given, and the share that it rejects rightly there (0 if it covers none)."""
    best, n = -2.0, 0
    for k in range(1, len(conditions) + 1):
        hit = Rule(tuple(conditions[:k]), False).matches(x)
        p, q = (hit & bad).sum(), (hit & ~bad).sum()
        worth = (p - q) / (p + q) if p + q else -1.0
        if worth > best + 1e-12:
            best, n = worth, k
    tight: dict[tuple[str, str], float] = {}
    for f, op, t in conditions[:n]:
        tight[f, op] = min(t, tight.get((f, op), t)) if op == "<=" else max(t, tight.get((f, op), t))
    return Rule(tuple((f, op, t) for (f, op), t in tight.items()), False), (best + 1) / 2


def learn(x: dict[str, np.ndarray], keep: np.ndarray, most_conditions: int = 4, precision: float = 0.9, support: int = 8, cuts: int = 256) -> list[Rule]:
    """Rules that reject, in order; what none matches is kept.

    Every third row of each kind prunes. A rule must reject rightly in precision of the rows it covers there and in all, and
    cover support rows in all; where a twentieth of the bad rows is less than support, that many, 3 at least. A rule that
    doesn't is dropped, the feature and side of its first condition is put aside as a first condition, and another is grown;
    covering ends when no first condition is left or no bad row. Without rows of both kinds no rule is learned.
    """
    bad = ~np.asarray(keep, bool)
    prune = np.zeros(len(bad), bool)
    for kind in (bad, ~bad):
        prune[np.flatnonzero(kind)[2::3]] = True
    support = min(support, max(3, -(-int(bad.sum()) // 20)))
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    aside: set[tuple[str, str]] = set()
    while True:
        grow, test = left & ~prune, left & prune
        if not (bad & grow).any() or not (~bad & grow).any():
            break
        conditions = _grow({f: v[grow] for f, v in x.items()}, bad[grow], most_conditions, cuts, aside)
        if not conditions:
            break
        rule, share = _pruned(conditions, {f: v[test] for f, v in x.items()}, bad[test])
        hit = rule.matches(x) & left
        right = int((hit & bad).sum())
        if share < precision or hit.sum() < support or right < precision * hit.sum():
            aside.add(conditions[0][:2])
            continue
        rules.append(Rule(rule.conditions, False, int(hit.sum()), right))
        left &= ~hit
        aside.clear()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """One conditional expression over the counts: the first rule that matches decides, else keep."""
    columns = features()
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.column(columns), F.lit(r.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learned_rules(counts: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> list[Rule]:
    """counts: statistics(); labels: doc_id, quality (0 or 1). most_rows: labelled rows that are fitted on, those of least hash of doc_id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.join(known, "doc_id").select(F.xxhash64("doc_id").alias("_h"), "quality", *(c.alias(f) for f, c in features().items()))
    t = rows.orderBy("_h", *features()).limit(most_rows).toArrow()
    x = {f: t.column(f).to_numpy() for f in features()}
    return learn(x, t.column("quality").to_numpy() == 1) if t.num_rows else []


def judged(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of each row of docs (doc_id, text).

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: false if base_failed,
    else what the rules say; rules are learned from labels unless given. Null text has no words and fails. Repeated rows are
    judged alike. If a doc_id has several labels the lowest counts; labels of null are left out. Without labels nothing
    but the base rejects. An empty table gives an empty result. most_rows bounds the labelled rows that rules are learned from;
    learn() says what a rule must do, and that it has four conditions at most, of 256 thresholds tried for each feature.
    """
    counts = staged(statistics(docs), "counts")
    rules = learned_rules(counts, labels, most_rows) if rules is None else rules
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
