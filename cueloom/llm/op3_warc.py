"""WARC archives written shard by shard, and read back.

Pages are range-sorted by id; each range is one shard, written by one task as a run of
files that roll when their compressed size is reached. Headers and digests are made anew
from the payload. A file is written under a temporary name with the attempt's number and
renamed when complete; a shard's manifest is committed last and readers trust manifests
only, so a retried, speculative or lost attempt leaves nothing behind that is read. All
bytes depend on the rows alone, so a rerun of a shard replaces files by equal ones.

Every record is a gzip member of its own. A response holds an HTTP head and the payload,
a revisit the head only; page ids travel in ``X-Page-Id`` fields.

Defined results: null html is an empty payload. Of equal payloads of at least
``least_bytes`` the one with the smallest id is the response and the others revisit it;
rows that share that smallest id are all responses, as are equal payloads that have no id
at all. Smaller payloads are responses. A null id sorts last and is read back as null; a
null url has no target field. Line breaks in urls are percent-encoded. An empty table
makes no files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.store import stored
from cueloom.session import scratch_dir

ROLL_BYTES = 256 << 20
SHARD_BYTES = 1 << 30
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated digests are broadcast up to this many rows of 40 bytes, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Tasks that read archives, at most; each reads whole files.
MOST_READERS = 20_000

MANIFEST = "path string, shard int, seq int, bytes long, sha256 string, records long"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, path string"
)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path; any that Arrow can write."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                   ("X-Refers-To-Page-Id", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _Roll:
    """One open file of a shard."""

    def __init__(self, store: pafs.FileSystem, folder: str, shard: int, seq: int, attempt: int):
        self.store, self.shard, self.seq, self.bytes, self.records = store, shard, seq, 0, 0
        self.path = f"{folder}/part-{shard:06d}-{seq:05d}.warc.gz"
        self.temporary = f"{folder}/.{shard:06d}-{seq:05d}.{attempt}.tmp"
        self.out, self.sha = store.open_output_stream(self.temporary, compression=None), hashlib.sha256()

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def commit(self) -> dict:
        self.out.close()
        self.store.move(self.temporary, self.path)
        return {"path": self.path, "shard": self.shard, "seq": self.seq, "bytes": self.bytes,
                "sha256": self.sha.hexdigest(), "records": self.records}


def _writer(folder_uri: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, folder = filesystem(folder_uri)
        done: list[dict] = []
        roll: _Roll | None = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*columns):
                if roll is None:
                    if not done:
                        store.create_dir(folder, recursive=True)
                    roll = _Roll(store, folder, shard, len(done), attempt)
                payload = (html.as_py() or "").encode()
                roll.add(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), revisit.as_py()))
                if roll.bytes >= roll_bytes:
                    done.append(roll.commit())
                    roll = None
        if roll is not None:
            done.append(roll.commit())
        if done:
            temporary = f"{folder}/.manifest-{shard:06d}.{attempt}.tmp"
            with store.open_output_stream(temporary) as out:
                out.write("".join(json.dumps(d) + "\n" for d in done).encode())
            store.move(temporary, f"{folder}/manifest-{shard:06d}.jsonl")
            yield pa.RecordBatch.from_pylist(done, pa.schema([
                ("path", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()),
                ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())]))

    return write


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, refers_to and revisit of every page."""
    html = F.coalesce("html", F.lit(""))
    told = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    repeated = stored(
        told.where(F.octet_length("html") >= least_bytes).select("page_id", "digest").groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    revisit = F.col("first").isNotNull() & later
    return told.join(side, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_warc(
    pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write the archives and return the manifest: one row per committed file."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "warc")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    order = [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last()]
    ranges = (
        decided(pages, least_bytes).repartitionByRange(shards, *order)
        .sortWithinPartitions(*order, F.sha2("html", 256))
    )
    return stored(ranges.mapInArrow(_writer(folder, roll_bytes), MANIFEST).withColumn(
        "folder", F.lit(folder)
    ))


def parse(stream) -> Iterator[dict]:
    """Records of an archive, one in memory at a time; wrong digests are errors."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if k in fields else None
        yield {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
               "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"),
               "payload": payload if kind == "response" else None}


def read_warc(manifest: DataFrame, rows: int = 2000) -> DataFrame:
    """One row per record of the committed files; files are dealt to tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("path", pa.string())])
        for batch in batches:
            for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist()):
                store, _ = filesystem(folder)
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.open(raw) as stream:
                    held = []
                    for r in parse(stream):
                        del r["payload"]
                        held.append(r | {"path": path})
                        if len(held) == rows:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    files = max(1, min(manifest.count(), MOST_READERS))
    return manifest.select("folder", "path").repartition(files, "path").mapInArrow(read, RECORD)
