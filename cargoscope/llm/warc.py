"""WARC archives: one gzip member per record, written through Spark and read back sequentially.

Writing: each row becomes a WARC/1.1 record in a gzip member of its own. Of records with equal payloads the first is
a response and the others are revisits that name it; only payloads of a minimum size are shared so. The members of a
task are written back to back into archive files by Spark's text writer, so task retries and commits are Spark's:
a member always ends in the four bytes of its length, the last of which is zero below 16 MiB, and that zero byte is
the writer's line separator. Longer records are cut into segments (WARC continuation records) that stay below. All
records of a page are one value for the writer, so they lie in one archive. An archive is bounded by bytes: it holds
``ARCHIVE_BYTES`` of members at most, or one page.

Reading: Spark hands over an archive as one value, which that bound keeps small; its bytes are inflated piece by piece,
never whole; a record is framed by its Content-Length, its digest is verified, and continuation segments are put
together.

Defined results: a null payload is empty; equal payloads are decided by their SHA-256; a row without an id is always
a response and stands for nothing else; rows that share an id and a payload are all responses if the id is the
smallest; an empty table gives an archive without records and an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.llm.common import cut, fresh_dir, text_or_empty

MIN_SHARED_BYTES = 100
#: Compressed bytes per archive, unless one page alone is larger.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes handed to the writer at a time, unless one page alone is larger.
BATCH_BYTES = 8 << 20
#: Payload bytes per record; longer payloads are segmented.
SEGMENT_BYTES = 8 << 20
#: Compressed and inflated bytes handled at a time by the reader.
READ_BYTES = 1 << 16
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class DamagedArchive(ValueError):
    """An archive that breaks the format or whose digest doesn't hold."""


def record_id(page_id: int | None, segment: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}{'' if segment == 1 else f':{segment}'}>"


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A gzip member with one record; below 16 MiB its last byte is zero."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head + body + b"\r\n\r\n") + made.flush()


def header_text(value: str) -> str:
    """A header value: line breaks and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def members(row: dict) -> Iterator[bytes]:
    """The records of one row (page_id, url, payload, digest, refers_to)."""
    payload, digest = row["payload"], row["digest"]
    labelled = "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", header_text(row["url"] or "")), ("WARC-Payload-Digest", labelled)]
    if row["refers_to"] is not None:
        yield member([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(row["page_id"])), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["refers_to"])), ("Content-Length", "0")], b"")
        return
    n = max(1, -(-len(payload) // SEGMENT_BYTES))
    for k in range(n):
        part = payload[k * SEGMENT_BYTES : (k + 1) * SEGMENT_BYTES]
        block = "sha256:" + base64.b32encode(hashlib.sha256(part).digest()).decode()
        kind = "response" if k == 0 else "continuation"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"], k + 1)), *common, ("WARC-Block-Digest", block), ("Content-Type", "text/html; charset=utf-8")]
        if n > 1:
            headers.append(("WARC-Segment-Number", str(k + 1)))
        if k:
            headers.append(("WARC-Segment-Origin-ID", record_id(row["page_id"])))
        if k and k == n - 1:
            headers.append(("WARC-Segment-Total-Length", str(len(payload))))
        yield member([*headers, ("Content-Length", str(len(part)))], part)


def _write_members(archive_bytes: int):
    """mapInArrow: rows -> (number of the task's archive, members of the page without their last byte, a zero that the
    text writer adds)."""

    def made(out: list[bytes], numbers: list[int]) -> pa.RecordBatch:
        # Bytes under the string type: the text writer copies them as they are.
        raw = pa.array(out, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())], names=["archive", "value"])

    def run(batches):
        number, filled = 0, 0
        out, numbers, held = [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                parts = []
                for part in members(batch.slice(at, 1).to_pylist()[0]):
                    if part[-1]:
                        raise DamagedArchive("a record must stay below 16 MiB")
                    parts.append(part)
                page = b"".join(parts)
                if filled and filled + len(page) > archive_bytes:
                    number, filled = number + 1, 0
                filled += len(page)
                if out and held + len(page) > BATCH_BYTES:
                    yield made(out, numbers)
                    out, numbers, held = [], [], 0
                out.append(page[:-1])
                numbers.append(number)
                held += len(page)
        if out:
            yield made(out, numbers)

    return run


def decided(pages: DataFrame, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """Rows of ``pages`` (page_id, url, html) with payload, digest and, for revisits, refers_to."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), text_or_empty("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # The smallest id per digest is a partially aggregated group, and only digests that occur twice are joined back,
    # so a payload that a third of all pages share costs its rows once.
    first = rows.where(F.length("payload") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``, a file per task and archive."""
    made = decided(pages).mapInArrow(_write_members(archive_bytes), "archive int, value string")
    made.write.option("lineSep", "\u0000").option("maxRecordsPerFile", 0).partitionBy("archive").text(path)


def inflated(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Inflate concatenated gzip members piece by piece: (bytes, whether a member ended after them)."""
    state = None
    for chunk in chunks:
        while chunk:
            if state is None:
                state = zlib.decompressobj(31)
            out = state.decompress(chunk, READ_BYTES)
            chunk = state.unconsumed_tail or state.unused_data
            ended = state.eof
            if out or ended:
                yield out, ended
            if ended:
                state = None
    while state is not None:
        out = state.decompress(b"", READ_BYTES)
        if state.eof or not out:
            if not state.eof:
                raise DamagedArchive("the archive ends inside a member")
            yield out, True
            state = None
        else:
            yield out, False


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(headers, content length, body pieces) of each record; a body must be read before the next record is."""
    source = inflated(chunks)
    held = bytearray()
    ended = False

    def more() -> None:
        nonlocal ended
        piece = next(source, None)
        if piece is None or ended:
            raise DamagedArchive("the archive ends inside a record")
        held.extend(piece[0])
        ended = piece[1]

    while True:
        piece = next(source, None)
        if piece is None:
            return
        held.extend(piece[0])
        ended = piece[1]
        while (end := held.find(b"\r\n\r\n")) < 0:
            more()
        lines = bytes(held[:end]).split(b"\r\n")
        del held[: end + 4]
        if lines[0] != VERSION:
            raise DamagedArchive(f"not a record: {lines[0][:40]!r}")
        headers = dict(line.decode().split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])

        def body(left: int = length) -> Iterator[bytes]:
            while left:
                if not held:
                    more()
                part = bytes(held[:left])
                del held[: len(part)]
                left -= len(part)
                yield part

        yield headers, length, body()
        while not ended or len(held) < 4:
            more()
        if bytes(held) != b"\r\n\r\n":
            raise DamagedArchive("a record must fill its member")
        held.clear()


def _page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(digits) if digits else None


def summarise(chunks: Iterator[bytes]) -> Iterator[dict]:
    """One row per archived page, digests verified; a revisit's length is that of the response it refers to."""
    open_row, whole = None, None
    for headers, length, body in read_records(chunks):
        kind = headers["WARC-Type"]
        block = hashlib.sha256()
        if kind != "continuation":
            if open_row:
                yield _closed(open_row, whole)
            whole = hashlib.sha256()
            labelled = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            open_row = {"page_id": _page_of(headers["WARC-Record-ID"]), "payload_bytes": 0, "payload_digest": base64.b32decode(labelled).hex(), "record_type": kind, "refers_to": _page_of(headers.get("WARC-Refers-To"))}
        elif not open_row or headers["WARC-Segment-Origin-ID"] != record_id(open_row["page_id"]):
            raise DamagedArchive("a continuation without its origin")
        for part in body:
            block.update(part)
            whole.update(part)
        open_row["payload_bytes"] += length
        if kind != "revisit" and base64.b32encode(block.digest()).decode() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
            raise DamagedArchive(f"block digest of {headers['WARC-Record-ID']}")
    if open_row:
        yield _closed(open_row, whole)


def _closed(row: dict, whole) -> dict:
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": None}
    if whole.hexdigest() != row["payload_digest"]:
        raise DamagedArchive(f"payload digest of page {row['page_id']}")
    return row


def _read_files(batches):
    for batch in batches:
        contents = batch.column(0)
        for i in range(batch.num_rows):
            data = memoryview(contents[i].as_buffer())
            rows = summarise(bytes(data[at : at + READ_BYTES]) for at in range(0, len(data), READ_BYTES))
            yield pa.RecordBatch.from_pylist(list(rows), schema=_RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = cut(files.mapInArrow(_read_files, _RECORD_DDL))
    # A revisit has no body; its length is read from the response that it names.
    named = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("of")).distinct()
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("of"), "payload_bytes")
    sizes = responses.join(named, "of", "left_semi").groupBy("of").agg(F.max("payload_bytes").alias("full"))
    joined = found.join(sizes, F.col("refers_to") == F.col("of"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = fresh_dir(pages.sparkSession, "warc")
    write(pages, path)
    return read_archives(pages.sparkSession, path)
