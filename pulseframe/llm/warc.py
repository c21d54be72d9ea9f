"""WARC archives: write, normalise monolithic gzip files, index, read back.

`write_monolithic` writes one gzip stream per file, as archives often come. `normalise` inflates such a file once from
end to end, holding one record at a time, writes every record as a gzip member of its own and a sidecar index with the
offset and length of each member. `read_back` opens the members through that index alone.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response; the others
revisit it and carry no payload. Files are written under a temporary name and moved into place, so that a task that runs
again replaces its own file; what passes between the steps is a table of file names, kept in the shared folder.

Paths are URIs that pyarrow.fs opens (file, s3, gs, hdfs). Any gzip file of WARC records can be normalised, also one of
several members.

Defined cases: a null payload is an empty one; a null url leaves the target out; records with a null page_id are never
larger than others and revisit them (among themselves, they are responses); rows that share the largest page_id are all
responses; repeated rows are written one by one; an empty table gives no files; extra columns are not read.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bitmap, cut, rows_in, shared_dir, small_batches

LEAST = 1000
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "path string, records long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PIECE = 1 << 20


def place(uri: str):
    """The file system and path of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Output:
    """A file that appears under its name when it is closed."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.stream, self.written = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _line(value: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP head, whose Content-Length is that of the full payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisit_of is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit_of is None:
        body += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{revisit_of}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _number(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def inflate(stream, piece: int = _PIECE) -> Iterator[bytes]:
    """What a gzip file holds, member after member, in pieces of at most `piece` bytes."""
    inner = zlib.decompressobj(zlib.MAX_WBITS | 16)
    begun = False
    while data := stream.read(piece):
        while data:
            begun = True
            plain = inner.decompress(data, piece)
            if plain:
                yield plain
            data = inner.unconsumed_tail
            if inner.eof:
                data, inner, begun = inner.unused_data, zlib.decompressobj(zlib.MAX_WBITS | 16), False
    while begun and not inner.eof:
        plain = inner.decompress(inner.unconsumed_tail, piece) or inner.flush()
        if not plain:
            raise EOFError("the gzip stream ends early")
        yield plain


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, one at a time."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise EOFError("the archive ends within a record's head")
                return
        size = at + 4 + int(_fields(bytes(held[:at]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise EOFError("the archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def write_monolithic(typed: DataFrame, directory: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, payload_digest, refers_to) as monolithic gzip files; returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, packer, count, size, done = TaskContext.get().partitionId(), 0, None, None, 0, 0, []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((name, count))

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                if out is None:
                    name = f"{directory}/whole/part-{part:06d}-{number:04d}.warc.gz"
                    out, packer, count, size, number = Output(name), zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS | 16), 0, 0, number + 1
                raw = record(page, url, payload.encode() if isinstance(payload, str) else payload, digest, refers)
                out.write(packer.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return typed.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(write, _FILES)


def normalise_file(source: str, target: str) -> int:
    """Rewrites one monolithic file as a member per record, with target + ".index" beside it; returns the record count."""
    fs, path = place(source)
    out, index, count = Output(target), Output(target + ".index"), 0
    with fs.open_input_stream(path, compression=None) as stream:
        for raw in records(inflate(stream)):
            fields, http, _ = parse(raw)
            member = gzip.compress(raw, mtime=0)
            entry = {"offset": out.written, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest"), "url": fields.get("warc-target-uri")}
            index.write(json.dumps(entry).encode() + b"\n")
            out.write(member)
            count += 1
    out.close()
    index.close()
    return count


def normalise(files: DataFrame, directory: str) -> DataFrame:
    """Normalises each file of (path, records) into directory; returns (path, records) of the new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{directory}/members/{path.rsplit('/', 1)[1]}"
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([normalise_file(path, target)], pa.int64())], names=["path", "records"])

    return files.mapInArrow(run, _FILES)


def members(path: str) -> Iterator[bytes]:
    """The records of a normalised file, each read at the place its index gives."""
    fs, name = place(path)
    with fs.open_input_stream(name + ".index", compression=None) as lines:
        held = b""
        with fs.open_input_file(name) as file:
            while True:
                piece = lines.read(_PIECE)
                *whole, held = (held + piece).split(b"\n")
                for line in whole:
                    entry = json.loads(line)
                    file.seek(entry["offset"])
                    yield gzip.decompress(file.read(entry["length"]))
                if not piece:
                    return


def read_back(files: DataFrame) -> DataFrame:
    """One row per record of normalised files. A response's digest is computed from its payload and must be the stated one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                for raw in members(path):
                    fields, http, payload = parse(raw)
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and (sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{path}: the payload of {fields['warc-record-id']} is not the one stated")
                    out.append((_number(fields["warc-record-id"]), int(http["content-length"]), digest, kind, _number(fields.get("warc-refers-to"))))
                cols = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, _RECORDS)


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to) of pages (page_id, url, html). Ids and digests alone are shuffled to
    find what revisits what; of the payloads, only those of pages that may be revisits are."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    long = full.filter(F.octet_length("payload") >= least).select("page_id", "payload_digest")
    shared = cut(long.groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").drop("n"))
    later = long.join(shared, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    later = cut(later.select(F.col("page_id").alias("later"), F.col("payload_digest").alias("of"), F.col("response").alias("refers_to")))
    bits = bitmap(later.select(F.col("later").alias("id")))
    met = rows_in(full, "page_id", bits).join(later, F.col("page_id").eqNullSafe(F.col("later")) & (F.col("payload_digest") == F.col("of")), "left").drop("later", "of")
    return met.unionByName(rows_in(full, "page_id", bits, inside=False).withColumn("refers_to", F.lit(None).cast("long")))


def op7_warc_normalise(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    directory = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    whole = cut(write_monolithic(typed(pages), directory))
    tasks = max(1, whole.count())
    apart = cut(normalise(whole.repartition(tasks), directory))
    return read_back(apart.repartition(tasks))
