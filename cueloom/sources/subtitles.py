"""ASS subtitle files: lines to events and problems, and events to cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import strip
from cueloom.functions.times import parse_ass_time
from cueloom.plans.blocks import Ordered, last_seen, running_sum
from cueloom.session import materialize

SECTION = r"^\[([^\]]+)\]\s*$"
KEY = ["artifact", "media_id"]


def ass_file_lines(files: DataFrame) -> DataFrame:
    """(artifact, media_id, line_no, line) of ``files(artifact, media_id, content)``."""
    content = F.regexp_replace(F.regexp_replace("content", "^\ufeff+", ""), "\r\n", "\n")
    return files.select(*KEY, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def read_ass(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dialogue events and parse problems of subtitle lines, in file order."""
    # A line's fields do not depend on its neighbours: it is parsed once, before it is placed.
    stripped = lines.select(*KEY, "line_no", strip(F.col("line")).alias("__line"))
    header = F.when(
        F.col("__line").rlike(SECTION), F.lower(strip(F.regexp_extract("__line", SECTION, 1)))
    )
    named = F.lower("__line").startswith("dialogue:")
    fields = F.split(F.substr("__line", F.lit(len("dialogue:") + 1)), ",", 10)
    text = F.filter(
        F.transform(F.split(F.try_element_at("f", F.lit(10)), r"\\[nN]"), strip), lambda x: x != ""
    )
    parsed = stripped.select(
        *KEY, "line_no", header.alias("__header"), F.when(named, fields).alias("f")
    ).select(
        *KEY, "line_no", "__header", F.col("f").isNotNull().alias("__named"),
        (F.size("f") < 10).alias("short"),
        parse_ass_time(F.try_element_at("f", F.lit(2))).alias("start"),
        parse_ass_time(F.try_element_at("f", F.lit(3))).alias("end"),
        F.coalesce(strip(F.try_element_at("f", F.lit(5))), F.lit("")).alias("name"),
        F.try_element_at("f", F.lit(4)).alias("style"),
        text.alias("text_lines"),
    )
    untimed = F.col("start").isNull() | F.col("end").isNull()
    kind = (
        F.when(F.col("short") | untimed, "unparsable")
        .when(F.size("text_lines") == 0, "empty_text")
    )
    placed = Ordered.of(parsed.withColumn("kind", kind), KEY, ["line_no"]).scan(
        __section=last_seen(F.col("__header"))
    )
    event = F.coalesce((F.col("__section") == "events") & F.col("__named"), F.lit(False))
    placed = placed.with_df(
        placed.df.withColumns({
            "__d": event.cast("long"), "__g": (event & F.col("kind").isNull()).cast("long"),
        })
    )
    judged = materialize(
        placed.scan(n=running_sum(F.col("__d")), pos=running_sum(F.col("__g"))).rows.where("__d = 1")
    )
    label = F.concat(F.lit("event "), F.col("n").cast("string"))
    message = (
        F.when(F.col("short"), F.concat(label, F.lit(" has fewer than 10 Dialogue fields")))
        .when(untimed, F.concat(label, F.lit(" has an invalid timestamp")))
        .otherwise(F.concat(label, F.lit(" has no subtitle text")))
    )
    events = judged.where("kind is null").select(
        *KEY, "pos", "start", "end", "name", "style", "text_lines"
    )
    problems = judged.where("kind is not null").select(*KEY, "n", "kind", message.alias("message"))
    return events, problems


def ass_to_cues(events: DataFrame) -> DataFrame:
    """Preview cues: the first of several lines is the translation."""
    many = F.size("text_lines") > 1
    first = F.element_at("text_lines", 1)
    rest = F.array_join(F.slice("text_lines", F.lit(2), F.size("text_lines")), "\n")
    return events.select(
        *KEY, F.col("pos").cast("string").alias("id"), "start", F.greatest("start", "end").alias("end"),
        F.when(many, rest).otherwise(first).alias("source"), F.when(many, first).alias("translated"),
        F.nullif("name", F.lit("")).alias("speaker"),
    )
