"""WARC archives: write records in whole-file gzip streams, normalise these to one gzip member per record, read back.

The writer is Spark's own text sink: a record's value is its header and payload, the separator between values is the
blank line that closes a WARC record, and the codec makes one gzip stream of each file. The normaliser inflates such a
file once, in pieces and through all its members, rewrites every record as a member of its own and notes offset and length in a sidecar index. A
reader then seeks to a member and inflates nothing else. A file is written under a name of its own attempt and then
renamed, so a repeated task replaces it and leaves no half-written file.

Defined cases: a null payload is empty; a null url leaves the target out, line breaks in it are escaped; rows with a null
id are records without an id, never referred to while another copy has one; rows that repeat the smallest id of equal
payloads are all responses; records that are no WARC records raise an error; an empty table writes no records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import staged
from marketloom.session import fresh_path

END = "\r\n\r\n"
LEAST_BYTES = 100
#: Records in one archive, at most.
RECORDS = 20_000
PIECE = 1 << 20


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row ``value`` per page: header, blank line, payload; copies of a payload refer to the smallest id and carry none."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    # Only digests that stand more than once are joined; the table is written, so its true size decides how.
    copies = staged(
        page.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first"), "copies")
    joined = page.join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body)), F.lit("\r\n"))
    return joined.select(F.concat(header, body).alias("value"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> None:
    """Archives of at most ``RECORDS`` records, each one gzip stream."""
    (records(pages, **columns).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(folder))


def _parsed(header: bytes) -> dict[str, str]:
    first, *lines = header.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:60]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _split(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of an inflated stream; held in memory is one record and one piece."""
    held = bytearray()
    wanted, header = None, {}
    for piece in pieces:
        held += piece
        while True:
            if wanted is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                header = _parsed(bytes(held[:at]))
                wanted = at + 4 + int(header["content-length"]) + 4
            if len(held) < wanted:
                break
            yield header, bytes(held[:wanted])
            del held[:wanted]
            wanted = None
    if held.strip():
        raise ValueError("truncated archive")


def _inflated(source) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, in pieces; zeros after a member are padding."""
    machine = None
    while piece := source.read(PIECE):
        while piece:
            if machine is None:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
                machine = zlib.decompressobj(31)
            out = machine.decompress(piece, 4 * PIECE)
            if out:
                yield out
            piece = machine.unused_data if machine.eof else machine.unconsumed_tail
            # What is left of a full piece comes out without further input.
            while not piece and not machine.eof and len(out) == 4 * PIECE:
                out = machine.decompress(b"", 4 * PIECE)
                if out:
                    yield out
                piece = machine.unused_data if machine.eof else machine.unconsumed_tail
            if machine.eof:
                machine = None
    if machine is not None:
        raise ValueError("truncated archive: a gzip member without end")


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrites every archive of ``folder`` into ``target``, one member a record; returns the index, written as Parquet.

    Index: archive, offset, length, page_id, record_type, refers_to, url. The rows are in the order of the archive.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield _normalised(path, target)

    # One archive a task: rows are dealt by the place of their path among all, in an exchange that execution leaves as it is.
    ranked = archives.repartitionByRange(max(1, archives.count()), "path")
    return staged(ranked.mapInArrow(
        run, "archive string, offset long, length long, page_id long, record_type string, refers_to long, url string"), "index")


def _number(urn: str | None) -> int | None:
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _normalised(path: str, target: str) -> pa.RecordBatch:
    source_fs, source = _opened(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    target_fs, folder = _opened(target)
    target_fs.create_dir(folder, recursive=True)
    name = source.rsplit("/", 1)[1].replace(".txt.gz", ".warc.gz")
    attempt = f"{folder}/.{name}-{id(source_fs):x}-{_token()}"
    rows: list[tuple] = []
    at = 0
    with source_fs.open_input_stream(source, compression=None) as raw, target_fs.open_output_stream(attempt, compression=None) as out:
        for header, record in _split(_inflated(raw)):
            machine = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = machine.compress(record) + machine.flush()
            out.write(member)
            rows.append((f"{target}/{name}", at, len(member), _number(header.get("warc-record-id")), header["warc-type"],
                         _number(header.get("warc-refers-to")), header.get("warc-target-uri")))
            at += len(member)
    target_fs.move(attempt, f"{folder}/{name}")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = ["archive", "offset", "length", "page_id", "record_type", "refers_to", "url"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _token() -> str:
    from uuid import uuid4

    return uuid4().hex[:12]


def read_archives(index: DataFrame, carry: bool = True) -> DataFrame:
    """The records the index points at: page_id, record_type, refers_to, digest, payload_bytes, url and the payload carried.

    Each member is read by its offset and length alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple] = {}
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive not in opened:
                    for _, file in opened.values():
                        file.close()
                    system, path = _opened(archive)
                    opened = {archive: (system, system.open_input_file(path))}
                member = opened[archive][1].read_at(length, offset)
                text = zlib.decompress(member, 31)
                at = text.find(b"\r\n\r\n")
                head = _parsed(text[:at])
                body = text[at + 4: at + 4 + int(head["content-length"])]
                rows.append((_number(head.get("warc-record-id")), int(head["warc-payload-length"]), head["warc-payload-digest"].split(":")[1],
                             head["warc-type"], _number(head.get("warc-refers-to")), head.get("warc-target-uri"), body if carry else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.select("archive", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes, normalises and reads back; a response's length and digest are taken from the payload that was read."""
    spark = pages.sparkSession
    whole, members = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc")
    write_archives(pages, whole, **columns)
    back = read_archives(normalise(spark, whole, members))
    response = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
