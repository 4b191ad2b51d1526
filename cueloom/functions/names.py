"""Published subtitle file names: suffixes out, layout back in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueloom.functions.text import lang_component

LANGUAGE_SIDE = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"


def output_suffix(mode: Column, source: Column, target: Column) -> Column:
    """File suffix of one output mode; NULL when a bilingual name lacks a language."""
    pair = F.concat(F.lit("."), lang_component(source), F.lit("-"), lang_component(target))
    return (
        F.when(mode == "source", F.lit(".source.ass"))
        .when(mode == "translated", F.lit(".translated.ass"))
        .when(mode == "bilingual", F.concat(pair, F.lit(".ass")))
    )


def _hint(language: Column) -> Column:
    return F.nullif(lang_component(language), F.lit("auto"))


def subtitle_layout(name: Column, source: Column, target: Column) -> Column:
    """Struct(mode, base, source_language, target_language), NULL when not a subtitle name.

    A pair of tags may split at several hyphens; the split that agrees with most of the
    given languages wins, and a tie leaves the languages unknown.
    """
    folded = F.lower(name)

    def plain(mode, suffix):
        fits = folded.endswith(suffix) & (F.char_length(name) > len(suffix))
        return fits, _layout(
            F.lit(mode), F.substr(name, F.lit(1), F.char_length(name) - len(suffix))
        )

    is_source, as_source = plain("source", ".source.ass")
    is_translated, as_translated = plain("translated", ".translated.ass")
    stem = F.regexp_replace(name, r"(?is)\.ass$", "")
    base = F.regexp_extract(stem, r"(?s)^(.+)\.([^.]*)$", 1)
    pair = F.lower(F.regexp_extract(stem, r"(?s)^(.+)\.([^.]*)$", 2))
    tags = F.split(pair, "-")
    source_hint, target_hint = _hint(source), _hint(target)

    def at(i):
        left = F.array_join(F.slice(tags, F.lit(1), i), "-")
        right = F.array_join(F.slice(tags, i + 1, F.size(tags)), "-")
        score = F.coalesce((left == source_hint).cast("int"), F.lit(0)) + F.coalesce(
            (right == target_hint).cast("int"), F.lit(0)
        )
        return F.struct(left.alias("l"), right.alias("r"), score.alias("score"))

    cuts = F.when(F.size(tags) > 1, F.sequence(F.lit(1), F.size(tags) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    splits = F.filter(
        F.transform(cuts, at),
        lambda x: x["l"].rlike(LANGUAGE_SIDE) & x["r"].rlike(LANGUAGE_SIDE),
    )
    best = F.array_max(F.transform(splits, lambda x: x["score"]))
    agreeing = F.filter(splits, lambda x: (x["score"] == best) & (best > 0))
    chosen = F.when(F.size(splits) == 1, splits).otherwise(agreeing)
    only = F.when(F.size(chosen) == 1, F.try_element_at(chosen, F.lit(1)))
    as_pair = _layout(
        F.lit("bilingual"),
        base,
        F.when(only["l"] == source_hint, source).otherwise(only["l"]),
        F.when(only["r"] == target_hint, target).otherwise(only["r"]),
    )
    return (
        F.when(is_source, as_source)
        .when(is_translated, as_translated)
        .when(folded.endswith(".ass") & (base != "") & (F.size(splits) > 0), as_pair)
    )


def _layout(mode, base, source=None, target=None) -> Column:
    return F.struct(
        mode.alias("mode"),
        base.alias("base"),
        (F.lit(None).cast("string") if source is None else source).alias("source_language"),
        (F.lit(None).cast("string") if target is None else target).alias("target_language"),
    )
