"""Recordings as mono 16-bit PCM files, written and read in ranges of bytes.

A recording is one file or several parts in order. Nothing holds a recording whole: a task
reads its range in blocks, a window that lies over a seam is two partial sums until they are
added, and a digest is fed block by block. Parts are described by rows of ``PARTS``; paths
are opened with ``pyarrow.fs``, so they may be of any file system it knows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.session import materialize
from cueloom.sources.signals import WINDOW_SECONDS

#: ``first`` is the recording's frame the part begins with, ``skip`` the bytes before its samples.
PARTS = "media_id string, path string, first long, frames long, skip long, rate int"
WIDTH = 2
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
HEADER_BYTES = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path inside it; ``file:/x`` is how Spark writes a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _blocks(path: str, skip: int, length: int, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(skip)
        while length > 0:
            block = f.read(min(size, length))
            if not block:
                raise EOFError(f"{path} ends {length} bytes early")
            length -= len(block)
            yield block


def write_pcm(samples: DataFrame, path: str, rate: int) -> DataFrame:
    """Write ``samples(media_id, i, sample)`` as headerless parts; returns their ``PARTS`` rows.

    Samples are range-partitioned by (media_id, i), so a long recording spreads over tasks. A
    part is written under a name of its own attempt and never renamed: only the rows of the
    attempt that counts name it. Samples are clipped to 16 bits; a gap begins a new part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = opened(path)
        system.create_dir(root, recursive=True)
        rows: list[tuple] = []
        out, now = None, None
        for batch in batches:
            media = batch.column("media_id").to_pylist()
            i = batch.column("i").to_numpy()
            data = np.clip(batch.column("sample").to_numpy(), -32768, 32767).astype("<i2")
            cuts = [k for k in range(1, len(i)) if media[k] != media[k - 1] or i[k] != i[k - 1] + 1]
            for a, b in zip([0, *cuts], [*cuts, len(i)]):
                if now is None or now[0] != media[a] or now[1] != i[a]:
                    if out is not None:
                        out.close()
                    name = f"{path.rstrip('/')}/{uuid.uuid4().hex}.pcm"
                    out = system.open_output_stream(opened(name)[1])
                    rows.append([media[a], name, int(i[a]), 0])
                out.write(data[a:b].tobytes())
                rows[-1][3] += int(b - a)
                now = (media[a], i[a] + b - a)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
            ["media_id", "path", "first", "frames"],
        )

    ordered = samples.select(F.col("media_id").cast("string").alias("media_id"), F.col("i").cast("long").alias("i"), F.col("sample").cast("long").alias("sample"))
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = ordered.repartitionByRange(parts, "media_id", "i").sortWithinPartitions("media_id", "i")
    written = sorted_rows.mapInArrow(run, "media_id string, path string, first long, frames long")
    # Kept at once: the files of this attempt are the ones that count.
    return materialize(written).select("*", F.lit(0).cast("long").alias("skip"), F.lit(rate).cast("int").alias("rate")).select(
        *[c.split()[0] for c in PARTS.split(", ")])


def _wav(head: bytes) -> tuple[int, int, int] | None:
    """(bytes before the samples, bytes of samples, rate) of a mono 16-bit RIFF file."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate = 12, None
    while at + 8 <= len(head):
        kind, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            if (form, channels, bits) != (1, 1, 16):
                return None
        if kind == b"data":
            return None if rate is None else (at + 8, size, rate)
        at += 8 + size + size % 2
    return None


def wav_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parts of the mono 16-bit WAV files under ``path``, named by file, and other files.

    The second table (path, reason) lists what is no such file. Only headers are read; files
    of no bytes are in neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                found = _wav(b"".join(_blocks(name, 0, min(length, HEADER_BYTES))))
                skip, size, rate = found or (0, 0, None)
                # A recorder that was cut off leaves a size that is too large.
                rows.append((name, max(0, min(size, length - skip)) // WIDTH, skip, rate))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                ["path", "frames", "skip", "rate"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    heads = materialize(files.mapInArrow(run, "path string, frames long, skip long, rate int"))
    good = heads.where("rate is not null").select(F.col("path").alias("media_id"), "path", F.lit(0).cast("long").alias("first"), "frames", "skip", "rate")
    return good, heads.where("rate is null").select("path", F.lit("not a mono 16-bit WAV file").alias("reason"))


def pcm_levels(
    parts: DataFrame, window_seconds: float = WINDOW_SECONDS, range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(media_id, win, rms) of recordings in files, equal to ``rms_levels`` of their samples."""
    step = max(1, range_bytes // WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                window = max(1, int(row["rate"] * window_seconds))
                at, left = row["first"] + row["begin"], b""
                length = min(step, row["frames"] - row["begin"]) * WIDTH
                for block in _blocks(row["path"], row["skip"] + row["begin"] * WIDTH, length, block_bytes):
                    block = left + block
                    left = block[len(block) // WIDTH * WIDTH :]
                    x = np.frombuffer(block, "<i2", len(block) // WIDTH).astype(np.int64)
                    if not len(x):
                        continue
                    win = np.arange(at // window, (at + len(x) - 1) // window + 1)
                    starts = np.maximum(win * window - at, 0)
                    sums = np.add.reduceat(x * x, starts)
                    sizes = np.diff(np.append(starts, len(x)))
                    at += len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["media_id"]] * len(win), pa.string()), pa.array(win), pa.array(sums), pa.array(sizes)],
                        ["media_id", "win", "squares", "n"])

    ranges = parts.where("frames > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(step).cast("long"))))
    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = ranges.repartition(count, "path", "begin").mapInArrow(run, "media_id string, win long, squares long, n long")
    return sums.groupBy("media_id", "win").agg(F.sqrt(F.sum("squares").cast("double") / F.sum("n")).alias("rms"))


def fingerprints(parts: DataFrame) -> DataFrame:
    """(media_id, sha256, frames, rate, width): content identity of recordings in files.

    The digest is over the samples of all parts in order, so it does not depend on how a
    recording is cut into files. A recording is one chain of hashing and so one task, which
    holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                digest = hashlib.sha256()
                for part in row["parts"]:
                    for block in _blocks(part["path"], part["skip"], part["frames"] * WIDTH):
                        digest.update(block)
                out.append((row["media_id"], digest.hexdigest(), sum(p["frames"] for p in row["parts"]), row["rate"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))],
                ["media_id", "sha256", "frames", "rate"])

    whole = parts.groupBy("media_id").agg(
        F.max("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("first", "path", "skip", "frames"))).alias("parts"))
    return whole.mapInArrow(run, "media_id string, sha256 string, frames long, rate int").withColumn("width", F.lit(WIDTH))
