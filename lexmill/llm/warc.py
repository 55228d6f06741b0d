"""WARC archives: an index first, then byte ranges.

Archives are series of gzip members, one for each record, so that a record can be read by its place alone. Payloads that
were written before are revisit records: a first pass finds, for each payload digest, the page that holds the payload. Each
task writes its own archives and returns an index row for each record: offset, length, URL, digest and kind. Reading takes
any selection of index rows, deals it by file and stretch of offsets, sorts it by place, joins ranges that lie close together
into one read, across Arrow batches, and parses the records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import lean, open_store, partitions, run_dir, staged, tune
from ._skew import salted_join

#: Bytes of an archive at which the next one is begun; gap and size of reads that are joined.
FILE_BYTES, GAP, READ_BYTES = 128 << 20, 64 << 10, 8 << 20
#: Bytes of an archive that one task reads selected records of, so long as there are more stretches than tasks.
STRETCH = 32 << 20
#: Digests of payloads that several pages have which are broadcast at most, some 60 MB; beyond that pages are shuffled to them.
MOST_BROADCAST = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = ["page_id", "url", "file", "offset", "length", "digest", "record_type", "refers_to", "payload_bytes"]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(x: object) -> str:
    """A header value: control characters and backslashes are escaped."""
    return re.sub(r"[\x00-\x1f\x7f\\]", lambda m: f"\\x{ord(m[0]):02x}", "" if x is None else str(x))


def _unfield(x: str) -> str:
    return re.sub(r"\\x([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), x)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> tuple[bytes, str]:
    """A record, compressed, and its payload's digest. refers_to: the page whose record holds the payload, None for a response."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ([] if page_id is None else [f"X-Page: {page_id}"]) + ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + deflate.flush(), digest


def parse(raw: bytes) -> dict[str, object]:
    """What a compressed record holds. The digest of a response is of the payload that is there; a payload that doesn't fit its headers raises ValueError."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    found = digest_of(payload) if fields["WARC-Type"] == "response" else said
    if found != said or fields["WARC-Type"] == "response" and len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page, refers = (fields.get(x) for x in ("X-Page", "X-Refers-To-Page"))
    return {"page_id": None if page is None else int(page), "url": _unfield(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers), "payload_bytes": size, "payload_digest": found, "payload": payload if fields["WARC-Type"] == "response" else None}


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    raw, digest = record(page, url, payload, refers)
                    out.write(raw)
                    rows.append((page, url, name, at, len(raw), digest, "response" if refers is None else "revisit", refers, len(payload)))
                    at += len(raw)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], INDEX)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write pages (page_id, an integer, url, html) to archives in the shared folder; other columns are not read.

    Returns the folder and the index. Of equal payloads of at least least bytes the one with the largest page_id is the
    response, the others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url an empty
    one. Rows that repeat the largest page_id are all responses; a null page_id revisits where another page has the payload.
    A task that is run again writes new archives; the index names only those of tasks that ended well.
    """
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    # Digests alone are aggregated, in each task first; only pages of which others have the payload need to meet them.
    held = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    held = staged(held, "held")
    if held.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(held.select("sha", "holder")), "sha", "left")
    else:
        # A digest that very many pages have is dealt out.
        alone = rows.join(held.select("sha"), "sha", "left_anti").withColumn("holder", F.lit(None).cast("long"))
        rows = salted_join(rows, held.select("sha", "holder"), "sha", ["page_id", "url"], held.select("sha", "rows")).unionByName(alone)
    refers = F.when(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")) & (F.octet_length("html") >= least), F.col("holder"))
    path = run_dir(spark, "warc")
    index = rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(lean(_writer(path)), "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long, payload_bytes long")
    return path, staged(index, "warc-index")


def ranges(places: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined to reads: (file, begin, end, places in it)."""
    name, begin, end = "", -1, -1
    inside: list[tuple[int, int]] = []
    for file, at, size in places:
        if inside and (file != name or at - end > gap or at + size - begin > most):
            yield name, begin, end, inside
            inside = []
        if not inside:
            name, begin, end = file, at, at
        inside.append((at, size))
        end = max(end, at + size)
    if inside:
        yield name, begin, end, inside


def _reader(path: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        places = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        name, archive = "", None
        try:
            for file, begin, end, inside in ranges(places):
                if file != name:
                    if archive is not None:
                        archive.close()
                    name, archive = file, store.open_input_file(f"{root}/{file}")
                raw = archive.read_at(end - begin, begin)
                found = [parse(raw[at - begin : at - begin + size]) for at, size in inside]
                if not payloads:
                    for x in found:
                        x["payload"] = None
                yield pa.record_batch([pa.array([x[c] for x in found], k) for c, k in kinds.items()], list(kinds))
        finally:
            if archive is not None:
                archive.close()

    return read


def placed(index: DataFrame) -> DataFrame:
    """file, offset, length of a selection of index rows, in whatever order they come, as they are best read: stretches of a file
    in one task each, sorted. A few files are dealt to all tasks by their stretches."""
    n = partitions(index.sparkSession)
    return index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")


def read_archives(path: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of a selection of index rows (file, offset, length): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and payload (null for revisits, or if payloads is False). A null url reads as an empty one. Rows that are
    selected twice are read twice. An empty selection gives an empty result."""
    tune(index.sparkSession)
    return placed(index).mapInArrow(lean(_reader(path, payloads)), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
