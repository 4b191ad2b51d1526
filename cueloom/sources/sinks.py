"""Rendering and writing: ASS lines, output modes, canonical form, audit append."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.names import output_suffix
from cueloom.functions.text import ass_name, ass_text, strip
from cueloom.functions.times import ass_time
from cueloom.plans.blocks import Ordered, last_seen, row_number
from cueloom.session import materialize
from cueloom.sources.pcm import opened
from cueloom.sources.subtitles import KEY, SECTION, read_ass

DEFAULT_PLAY_RES = (1920, 1080)
LINE_ENDS = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
MODES = ("source", "translated", "bilingual")


def _metric(value: float, scale: Column) -> Column:
    return F.regexp_replace(F.bround(F.lit(value) * scale, 2).cast("string"), r"\.0$", "")


def header_lines(width: Column, height: Column, generator: str = "cueloom") -> Column:
    """The header as an array of lines; every metric is a fraction of the picture."""
    w0, h0 = DEFAULT_PLAY_RES
    scale = F.least(width / w0, height / h0)
    whole = lambda x: F.rint(x).cast("int").cast("string")
    margin_h, margin_v = whole(F.lit(60) * width / w0), whole(F.lit(40) * height / h0)
    size = F.greatest(F.lit(1), F.rint(F.lit(64) * scale).cast("int")).cast("string")
    # The script header and its one style.
    style = F.concat(
        F.lit("Style: Default,sans-serif,"), size,
        F.lit(",&H00FFFFFF,&H000000FF,&H00000000,&H7F000000,0,0,0,0,100,100,0,0,1,"),
        _metric(3, scale), F.lit(","), _metric(1.5, scale), F.lit(",2,"), margin_h, F.lit(","),
        margin_h, F.lit(","), margin_v, F.lit(",1"),
    )
    return F.array(
        F.lit("[Script Info]"),
        F.lit(f"; Generated by {generator}"),
        F.lit("ScriptType: v4.00+"),
        F.concat(F.lit("PlayResX: "), width.cast("string")),
        F.concat(F.lit("PlayResY: "), height.cast("string")),
        F.lit("WrapStyle: 0"),
        F.lit("ScaledBorderAndShadow: yes"),
        F.lit("YCbCr Matrix: None"),
        F.lit(""),
        F.lit("[V4+ Styles]"),
        F.lit(
            "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, "
            "BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
            "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
        ),
        style,
        F.lit(""),
        F.lit("[Events]"),
        F.lit("Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"),
    )


def fan_out_modes(cues: DataFrame, mode: str = "all") -> DataFrame:
    """One row per written mode, with ``text_lines``; translation first when bilingual."""
    modes = MODES if mode == "all" else (mode,)
    if not set(modes) <= set(MODES):
        raise ValueError(f"unknown output mode {mode!r}")
    source = strip(F.col("source"))
    translated = strip(F.coalesce("translated", F.lit("")))
    has = translated != ""
    fanned = cues.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    blocks = (
        F.when(F.col("mode") == "source", F.array(source))
        .when(F.col("mode") == "translated", F.array(F.when(has, translated).otherwise(source)))
        .when(has, F.array(translated, source))
        .otherwise(F.array(source))
    )
    pieces = F.flatten(F.transform(blocks, lambda b: F.split(b, LINE_ENDS)))
    return fanned.withColumn(
        "text_lines", F.filter(F.transform(pieces, strip), lambda x: x != "")
    )


def cue_events(cues: DataFrame, mode: str = "all") -> DataFrame:
    """Subtitle events (artifact = mode) of cues in (ordinal) order."""
    placed = Ordered.of(cues, ["media_id"], ["ordinal", "id"]).scan(pos=row_number())
    return fan_out_modes(placed.rows, mode).select(
        F.col("mode").alias("artifact"), "media_id", "pos", "start", "end",
        F.coalesce("speaker", F.lit("")).alias("name"), "text_lines",
    )


def event_lines(events: DataFrame) -> DataFrame:
    """(artifact, media_id, line_no, line): dialogue lines only, after the header."""
    text = F.array_join(F.transform("text_lines", ass_text), "\\N")
    line = F.concat(
        F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")),
        F.lit(",Default,"), ass_name(F.col("name")), F.lit(",0,0,0,,"), text,
    )
    return events.select(*KEY, (F.col("pos") + HEADER_SIZE - 1).alias("line_no"), line.alias("line"))


HEADER_SIZE = 15


def render_ass(events: DataFrame, play_res: DataFrame | None = None) -> DataFrame:
    """Subtitle files as numbered lines.

    ``play_res``: media_id, width, height. Lines rather than one text per file, so a long
    recording renders in parallel and is written in order by :func:`write_ass`.
    """
    files = events.select(*KEY).distinct()
    if play_res is not None:
        files = files.join(play_res, "media_id", "left")
    else:
        files = files.withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
    width = F.coalesce("width", F.lit(DEFAULT_PLAY_RES[0]))
    height = F.coalesce("height", F.lit(DEFAULT_PLAY_RES[1]))
    head = files.select(*KEY, F.posexplode(header_lines(width, height)).alias("line_no", "line"))
    return head.select(*KEY, F.col("line_no").cast("long").alias("line_no"), "line").unionByName(
        event_lines(events)
    )


def write_ass(lines: DataFrame, path: str) -> None:
    """Write rendered lines below ``path/artifact=…/media_id=…``, parts in line order."""
    (
        lines.repartitionByRange(*KEY, "line_no")
        .sortWithinPartitions(*KEY, "line_no")
        .select(*KEY, F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy(*KEY)
        .text(path)
    )


PUBLISHED = "artifact string, media_id string, name string, lines long, bytes long, sha256 string"


def publish_ass(
    lines: DataFrame, path: str, base: Column, source_language: Column, target_language: Column
) -> DataFrame:
    """One file per (artifact, media) in ``path``, named ``base`` and the mode's suffix.

    Returns the manifest: what was written, with its digest. Files are range-partitioned by
    name order, so a task writes many small ones in a row; the lines of one stream through
    one task and are never held together. A file is written beside its place and moved onto
    it, and equal content makes a second attempt harmless. A bilingual name needs both
    languages; without them the write fails before any file is touched.
    """
    suffix = output_suffix(F.col("artifact"), source_language, target_language)
    named = lines.withColumn("__name", F.concat(base, suffix)).withColumn(
        "__name", F.when(F.col("__name").isNull(), F.raise_error(F.lit("a file name needs its languages"))).otherwise(F.col("__name"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        system.create_dir(root, recursive=True)
        rows, now, out, digest, spare = [], None, None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                system.move(spare, f"{root}/{now[2]}")
                rows[-1][-1] = digest.hexdigest()

        for batch in batches:
            for artifact, media, name, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (artifact, media, name) != now:
                    close()
                    now, digest, spare = (artifact, media, name), hashlib.sha256(), f"{root}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(spare)
                    rows.append([artifact, media, name, 0, 0, None])
                data = (line + "\n").encode()
                out.write(data)
                digest.update(data)
                rows[-1][3] += 1
                rows[-1][4] += len(data)
        close()
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
            ["artifact", "media_id", "name", "lines", "bytes", "sha256"],
        )

    placed = named.repartitionByRange("__name").sortWithinPartitions("__name", "line_no")
    columns = ["artifact", F.col("media_id").cast("string").alias("media_id"), F.col("__name").alias("name"), "line"]
    return materialize(placed.select(*columns).mapInArrow(run, PUBLISHED))


def canonical_lines(lines: DataFrame, play_res: DataFrame | None = None) -> DataFrame:
    """Canonical form of parsed files: events sorted, header and fields rewritten."""
    events, problems = read_ass(lines)
    return _sorted_lines(events.join(problems.select(*KEY).distinct(), KEY, "left_anti"), play_res)


def _sorted_lines(events: DataFrame, play_res: DataFrame | None) -> DataFrame:
    ranked = Ordered.of(
        events.withColumnRenamed("pos", "__pos"), KEY, ["start", "end", "name", "__pos"]
    ).scan(pos=row_number())
    return render_ass(ranked.rows.drop("__pos"), play_res)


def canonicalize_ass(lines: DataFrame, play_res: DataFrame | None = None) -> DataFrame:
    """Canonical lines of just the files that differ from their canonical form.

    ``lines`` are those of :func:`ass_file_lines`, whose last line is empty when the file
    ends in a line break.
    """
    fixed = canonical_lines(lines, play_res)
    return fixed.join(_differing(fixed, lines), KEY, "left_semi")


def _differing(fixed: DataFrame, lines: DataFrame) -> DataFrame:
    """Keys of the files whose ``lines`` are not the ``fixed`` ones and a last empty line."""
    ends = fixed.groupBy(*KEY).agg((F.max("line_no") + 1).alias("line_no")).withColumn(
        "line", F.lit("")
    )
    whole = fixed.unionByName(ends.select(*KEY, "line_no", "line"))
    left = lines.select(*KEY, F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("old"))
    return (
        whole.join(left, [*KEY, "line_no"], "full")
        .where(~F.col("line").eqNullSafe(F.col("old")))
        .select(*KEY)
        .distinct()
    )


def canonical_play_res(lines: DataFrame) -> DataFrame:
    """(artifact, media_id, width, height) of files already in canonical form."""
    lines = materialize(lines)
    stripped = lines.select(*KEY, "line_no", strip(F.col("line")).alias("__line"))
    section = F.when(
        F.col("__line").rlike(SECTION), F.lower(strip(F.regexp_extract("__line", SECTION, 1)))
    )
    size = r"(?i)^PlayRes([XY])\s*:\s*(\d+)\s*$"
    # Only headings and sizes are placed: no other line opens a section.
    marked = stripped.where(F.col("__line").rlike(SECTION) | F.col("__line").rlike(size)).select(
        *KEY, "line_no", section.alias("__h"),
        F.upper(F.regexp_extract("__line", size, 1)).alias("axis"),
        F.regexp_extract("__line", size, 2).alias("value"),
    )
    placed = Ordered.of(marked, KEY, ["line_no"]).scan(__s=last_seen(F.col("__h")))
    found = placed.rows.where("__s = 'script info' and __h is null")
    axis, value = F.col("axis"), F.col("value").cast("int")
    res = found.groupBy(*KEY).agg(
        F.max_by(F.when(axis == "X", value), F.when(axis == "X", F.col("line_no"))).alias("width"),
        F.max_by(F.when(axis == "Y", value), F.when(axis == "Y", F.col("line_no"))).alias("height"),
    ).where("width is not null and height is not null")
    events, problems = read_ass(lines)
    whole = events.select(*KEY).distinct().join(problems.select(*KEY).distinct(), KEY, "left_anti")
    candidates = materialize(res.join(whole, KEY))

    # Each file is compared at its own resolution, so the artifact joins the key.
    def keyed(df: DataFrame) -> DataFrame:
        return df.join(candidates.select(*KEY), KEY).withColumn("media_id", F.concat_ws("\u0000", *KEY))

    sizes = candidates.select(F.concat_ws("\u0000", *KEY).alias("media_id"), "width", "height").distinct()
    off = _differing(_sorted_lines(keyed(events), sizes), keyed(lines)).select("media_id").distinct()
    return (
        candidates.withColumn("__k", F.concat_ws("\u0000", *KEY))
        .join(off.withColumnRenamed("media_id", "__k"), "__k", "left_anti")
        .select(*KEY, "width", "height")
    )


def append_audit(df: DataFrame, path: str) -> None:
    """Append raw responses or events, with their session base, to the audit table."""
    df.write.mode("append").parquet(path)
