"""Numpy kernels over UTF-8 text in Arrow buffers: words as byte spans, polynomial hashes of any span, shingles.

No Python string is made for a word. A chunk is a run of whole texts laid end to end (data) with the
offsets of each text; words and windows never cross an offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Fixed odd constants of the hashes.
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
SHINGLE = 0xD6E8FEB86659FD93
#: Bytes of text handled at a time, but for a single longer text.
CHUNK = 2 << 20


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of one text column, about most bytes each."""
    if not batch.num_rows:
        return
    data, offsets = text_parts(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, made once as far as needed."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                a = np.full(size, base, U64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with span hash (H[e] - H[s]) * BASE**-s; one entry more than bytes."""
    up, _ = Powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = Powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * MIX_1)


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """256 entries: 0 for bytes that part words, else the byte, A-Z lower-cased if asked."""
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0
    if lower:
        table[65:91] = table[97:123]
    return table


#: Words are runs of anything but white space.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]), lower=True)
#: The same, with case kept.
SPACED_CASED = byte_table(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
#: Words are runs of 0-9, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, word starts, word ends, and for each text the index of its first word (one more than texts).

    Byte 0 parts no words unless the table says so: a table's own 0 entries do, found by identity below.
    """
    inside = (table != 0) | (np.arange(256) == 0) & _keeps_zero(table)
    mapped = table[data]
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = inside[data]
    begins = w[1:-1] & ~w[:-2]
    ends = w[1:-1] & ~w[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= w[1:-1][cuts]
    ends[cuts - 1] |= w[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return mapped, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _keeps_zero(table: np.ndarray) -> bool:
    """Tables that part words at white space only take byte 0 as part of a word."""
    return bool(table[1])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by its first word; the last size - 1 entries of words have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * U64(SHINGLE) + words[j : j + n]
    return mix(out)
