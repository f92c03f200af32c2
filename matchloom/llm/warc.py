"""WARC archives: a writer and a splittable reader.

The writer makes one gzip member per record; a task writes files of its own into a shared
folder and reports them, so files of lost attempts are never read. The reader's tasks
take byte ranges. They look for gzip magic, validate a candidate by decoding its WARC
header, length and check sums, and own the records that start inside their range; a
record may end beyond it. After a damaged member the search goes on behind it.

Defined cases: a null payload is empty; a null id gives an empty record name; line breaks
in addresses are percent-encoded; records of any length are read whole; an empty table
gives no files and no records; other columns are ignored.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.scale import BROADCAST_ROWS
from matchloom.storage import materialize, new_table_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_REVISIT_BYTES = 100
FILE_BYTES = 1 << 28
SPLIT_BYTES = 1 << 23
MAGIC = b"\x1f\x8b\x08"
PREFIX = "urn:page:"
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "payload binary, payload_bytes bigint, refers_to string, file string, offset bigint"
)


def with_revisits(
    records: DataFrame, record_id: str, payload: str, min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """``records`` with ``digest`` and ``first_id``, set where an earlier record has the payload.

    Payloads are compared by SHA-256 and only digests travel. Of equal payloads of at
    least ``min_bytes`` that with the smallest id is the first; a null id never refers.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digest = records.withColumn("digest", F.sha2(body, 256))
    firsts = materialize(
        digest.filter(F.octet_length(body) >= min_bytes)
        .groupBy("digest")
        .agg(F.min(record_id).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n"),
        "warc-firsts",
    )
    small = firsts.count() <= BROADCAST_ROWS
    return digest.join(F.broadcast(firsts) if small else firsts, "digest", "left").withColumn(
        "first_id", F.when(F.col(record_id) > F.col("_first"), F.col("_first"))
    ).drop("_first")


def _member(row: dict) -> bytes:
    payload, revisit = row["payload"] or b"", row["first_id"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}".encode() + END
    block = http if revisit else http + payload
    name = "" if row["id"] is None else row["id"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PREFIX}{name}>",
        f"WARC-Target-URI: {quote(row['url'] or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: <{PREFIX}{row['first_id']}>", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + END + block + END) + pack.flush()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(
    pages: DataFrame, folder: str, record_id: str = "page_id", url: str = "url",
    payload: str = "html", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``folder``; returns (file, bytes, records) of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        done, out, size, n, name = [], None, 0, 0, ""

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", size, n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = _member(row)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.record_batch(
                [pa.array(c) for c in zip(*done)], names=["file", "bytes", "records"]
            )

    rows = with_revisits(
        pages.select(
            F.col(record_id).alias("id"), F.col(url).alias("url"),
            F.col(payload).cast("binary").alias("payload"),
        ),
        "id",
        "payload",
    )
    written = rows.mapInArrow(write, "file string, bytes bigint, records bigint")
    return materialize(written, "warc-files")


class _Source:
    """Byte access to one file, a block at a time."""

    def __init__(self, path: str, block: int = 1 << 20) -> None:
        system, name = _open(path)
        self._file, self._block = system.open_input_file(name), block
        self.size, self._at, self._data = self._file.size(), 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from ``at`` on; none at the end of the file."""
        if not self._at <= at < self._at + len(self._data):
            self._at, self._data = at, self._file.read_at(min(self._block, self.size - at), at)
        return self._data[at - self._at :]

    def find(self, start: int, end: int) -> int:
        """Place of the next gzip magic that begins before ``end``, or -1."""
        while start < end:
            data = self.read(start)
            if len(data) < len(MAGIC):  # the magic may straddle two blocks
                data = self._file.read_at(min(self._block, self.size - start), start)
                self._at, self._data = start, data
            found = data.find(MAGIC)
            if found >= 0:
                return start + found if start + found < end else -1
            if start + len(data) >= self.size:
                return -1
            start += len(data) - len(MAGIC) + 1
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content of the gzip member at ``at`` and its end, if it is a whole WARC record."""
        unpack, parts, place = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                data = self.read(place) if place < self.size else b""
                if not data:
                    return None
                parts.append(unpack.decompress(data))
                place += len(data) - len(unpack.unused_data)
                if len(parts) == 1 and parts[0][:5] != b"WARC/"[: len(parts[0])]:
                    return None
        except zlib.error:
            return None
        return b"".join(parts), place


def parse_record(content: bytes) -> dict | None:
    """Headers (lower-case names) and block of one record; None if it is not one."""
    head, found, rest = content.partition(END)
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        return None
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) + len(END) != len(rest):
        return None
    return headers | {"block": rest[: int(length)]}


def split_records(path: str, start: int, end: int) -> Iterator[dict]:
    """The records of a file that start in [start, end)."""
    source, at = _Source(path), start
    while (at := source.find(at, min(end, source.size))) >= 0:
        member = source.member(at)
        record = member and parse_record(member[0])
        if not record:
            at += 1
            continue
        yield record | {"offset": at}
        at = member[1]


def _strip(name: str | None) -> str | None:
    return name and name.strip("<>").removeprefix(PREFIX)


def read_archives(
    spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """All records of ``files`` (columns file and bytes); see ``RECORDS`` for the columns.

    The payload is null for a revisit; its length and digest come from its headers.
    """
    splits = files.filter("bytes > 0").select(
        "file",
        "bytes",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"),
    )
    n = splits.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.binary() if c.endswith("binary") else pa.int64() if c.endswith("bigint") else pa.string() for c in RECORDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, size = [], 0
        for split in (r for b in batches for r in b.to_pylist()):
            for r in split_records(split["file"], split["start"], split["start"] + split_bytes):
                http, _, body = r["block"].partition(END)
                revisit = r.get("warc-type") == "revisit"
                length = len(body)
                if revisit:
                    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
                    length = int(fields.get(b"Content-Length", b"0"))
                rows.append((
                    _strip(r.get("warc-record-id")), r.get("warc-type"),
                    unquote(r.get("warc-target-uri", "")),
                    r.get("warc-payload-digest", "").removeprefix("sha256:"),
                    None if revisit else body, length, _strip(r.get("warc-refers-to")),
                    split["file"], r["offset"],
                ))
                size += len(body)
                if size > 1 << 22:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return splits.repartition(max(1, min(n, 10_000)), "file", "start").mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write every page as a record, read the archives back and describe the records."""
    spark = pages.sparkSession
    files = write_archives(pages, new_table_path(spark, "warc"))
    records = read_archives(spark, files, split_bytes)
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return records.select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        "target_uri",
    )
