"""Web archives: a writer with one gzip member per record and a reader that splits anywhere.

A WARC file is a row of gzip members, one per record. The reader gives each task a range of bytes. A
task looks for the gzip magic in its range and takes a place for the start of a record only if what is
there inflates to a WARC header; it owns the records that start inside its range and reads the last one
to its end beyond it. From a record on, the next one starts where it ends, so only the first start
of a range has to be searched.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.session import temporary_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
FEED_BYTES = 16 << 10
INFLATE_BYTES = 64 << 10  # of a header at once
MIN_REVISIT = 1000  # shorter payloads are always stored
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, "
    "file string, position long"
)


# --- records ------------------------------------------------------------------------------------


def record_urn(page_id: int) -> str:
    return f"urn:page:{page_id}"


def member(headers: dict[str, str], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member of its own; the same record always gives the same bytes."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    record = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def page_record(urn: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    headers = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{urn}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((uri or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = f"<{refers_to}>"
        headers["X-Payload-Length"] = str(size)  # of the payload that is not repeated here
        payload = b""
    return member(headers, payload)


# --- writing ------------------------------------------------------------------------------------


def write_archives(records: DataFrame, path: str) -> None:
    """Write (urn, uri, payload, digest, size, refers_to) as one archive per task below ``path``.

    A task writes under a name of its own and renames the file when it is whole. Another attempt
    at the same task replaces it by the same records.
    """

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        name = posixpath.join(folder, f"part-{task.partitionId():06d}.warc.gz")
        draft = posixpath.join(folder, f".{uuid.uuid4().hex}.tmp")
        n = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(page_record(row[0], row[1], row[2], row[3], row[4], row[5]))
                    n += 1
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    records.select("urn", "uri", "payload", "digest", "size", "refers_to").mapInArrow(run, "n long").agg(
        F.sum("n")
    ).collect()


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit: int = MIN_REVISIT) -> None:
    """One record per row of ``pages``; equal payloads of ``min_revisit`` bytes or more are stored once.

    The record with the largest key stores the payload, the others revisit it. A null html is an
    empty payload, rows without key never store for others, an empty table writes empty archives.
    Rows with equal key and payload: one record each, all of the same type.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = F.col("size") >= min_revisit
    stored = rows.filter(large).groupBy("digest").agg(F.max("key").alias("_stored"), F.count("*").alias("_n"))
    stored = stored.filter("_n > 1").drop("_n")
    joined = rows.join(stored, "digest", "left")
    refers = F.when(large & (F.col("_stored") != F.col("key")), F.format_string("urn:page:%s", F.col("_stored")))
    refers = F.when(large & F.col("key").isNull(), F.format_string("urn:page:%s", F.col("_stored"))).otherwise(refers)
    refers = F.when(F.col("_stored").isNotNull(), refers)
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    write_archives(joined.select(urn.alias("urn"), "uri", "payload", "digest", "size", refers.alias("refers_to")), path)


# --- reading ------------------------------------------------------------------------------------


class Source:
    """Pieces of a file in ascending order, fetched in larger ones."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.first, self.data = handle, size, 0, b""

    def piece(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``, fewer at the end of the file only; what lies before is forgotten."""
        end = min(at + n, self.size)
        if end > self.first + len(self.data):
            self.data = self.data[max(0, at - self.first) :] if at < self.first + len(self.data) else b""
            self.first = at
            self.handle.seek(at + len(self.data))
            self.data += self.handle.read(max(end - at - len(self.data), READ_BYTES))
        return self.data[at - self.first : end - self.first]


def starts_record(data: bytes, more: Callable[[int], bytes] = lambda done: b"") -> bool:
    """Whether a gzip member begins here that inflates to a whole WARC header, of any length.

    ``more`` gives what follows the first ``done`` bytes of the member, nothing at the end of the file.
    """
    unpack, head, named, done, most = zlib.decompressobj(31), b"", False, 0, 1 << 11
    while True:
        try:
            made = unpack.decompress(data, most)
        except zlib.error:
            return False
        head = (head[-3:] if named else head) + made  # the blank line may lie across two pieces
        if not named and len(head) >= len(VERSION):
            if not head.startswith(VERSION):
                return False
            named = True
        if named and b"\r\n\r\n" in head:
            return True
        if unpack.eof:
            return False
        done += len(data) - len(unpack.unconsumed_tail)
        data, most = unpack.unconsumed_tail or more(done), INFLATE_BYTES
        if not data and not made:
            return False


def inflate(source: Source, at: int) -> tuple[bytes, int]:
    """The record whose member begins at ``at``, and where the member ends."""
    unpack = zlib.decompressobj(31)
    out = []
    while not unpack.eof:
        data = source.piece(at, FEED_BYTES)
        if not data:
            raise EOFError("the archive ends inside a record")
        out.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
    return b"".join(out), at


def read_range(handle, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, record) for the records that start in [start, stop)."""
    source, at = Source(handle, size), start
    while at < stop:
        data = source.piece(at, FEED_BYTES)
        place = data.find(MAGIC)
        if place < 0:
            at += max(1, len(data) - len(MAGIC) + 1)  # the magic may begin in the last bytes
            continue
        at += place
        if at >= stop:
            return
        # from its first byte, as the search goes on behind it if it is none; in ever longer pieces
        if not starts_record(source.piece(at, FEED_BYTES), lambda done, at=at: source.piece(at, 2 * done)[done:]):
            at += 1
            continue
        found = at
        record, at = inflate(source, at)
        yield found, record


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", 0))]


def read_archives(spark: SparkSession, path: str, split: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """One row per record of all archives below ``path``: see RECORD, and the payload if asked for.

    Files are listed by Spark and cut into ranges of ``split`` bytes, each a task's piece of work. The
    digest of a stored payload is computed from it, that of a revisit is the recorded one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    ).filter("length > 0")
    schema = T.StructType.fromDDL(RECORD + ", payload binary" * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as handle:
                    rows: list[tuple] = []
                    held = 0
                    for position, record in read_range(handle, size, start, min(size, start + split)):
                        rows.append(_row(name, position, record, payloads))
                        held += len(record) if payloads else 0
                        if len(rows) == 1000 or held > SPLIT_BYTES:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, schema)

    # a range is a short row but much work: without a number, adaptive execution would join them to few tasks
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(max(1, min(ranges.count(), tasks))).mapInArrow(run, schema)


def _row(name: str, position: int, record: bytes, payloads: bool) -> tuple:
    headers, block = parse(record)
    revisit = headers.get("warc-type") == "revisit"
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit:
        digest = hashlib.sha1(block).hexdigest()
    length = headers.get("x-payload-length") if revisit else len(block)
    refers = headers.get("warc-refers-to")
    return (
        headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), headers.get("warc-target-uri"),
        refers and refers.strip("<>"), None if length is None else int(length), digest, name, position,
        *([block] if payloads else []),
    )


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows), schema.fields)], names=schema.names
    )


def page_of(urn: str):
    """The page that a record identifier names, null for none."""
    return F.try_element_at(F.split(F.col(urn), ":"), F.lit(3)).try_cast("long")


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: one row per record."""
    spark = pages.sparkSession
    path = temporary_path(spark, "warc")
    archive_pages(pages, path, key, url, html)
    records = read_archives(spark, path)
    return records.select(
        page_of("record_id").alias(key), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"),
    )
