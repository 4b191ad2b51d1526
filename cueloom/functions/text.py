"""Text functions over columns: width, language tags, labels, sanitizers, dedup keys."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def wide_ranges() -> str:
    """Regex ranges of the East-Asian wide and fullwidth code points."""
    parts, begin = [], None
    for cp in range(0x110001):
        wide = cp < 0x110000 and unicodedata.east_asian_width(chr(cp)) in "WF"
        if wide and begin is None:
            begin = cp
        elif not wide and begin is not None:
            parts.append(f"\\x{{{begin:x}}}-\\x{{{cp - 1:x}}}")
            begin = None
    return "".join(parts)


def text_weight(s: Column) -> Column:
    """Display width: wide characters count two, all others one.

    Everything wide lies above the Latin and other narrow scripts, so one cheap range drops
    nearly all text before the long list of ranges is tried.
    """
    rest = F.regexp_replace(s, "[\\x{0}-\\x{10ff}]+", "")
    wide = F.when(F.length(rest) > 0, F.char_length(F.regexp_replace(rest, f"[^{wide_ranges()}]", "")))
    return F.char_length(s) + F.coalesce(wide, F.lit(0))


# Every character that counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(s: Column) -> Column:
    """Trim every leading and trailing whitespace character."""
    return F.trim(s, F.lit(WHITESPACE))


def word_weight(s: Column) -> Column:
    return F.greatest(F.lit(1), text_weight(strip(s)))


def norm_lang(s: Column) -> Column:
    """Primary language subtag; blank and ``auto`` are unknown."""
    folded = F.lower(F.replace(strip(s), F.lit("_"), F.lit("-")))
    return F.when((folded != "") & (folded != "auto"), F.element_at(F.split(folded, "-"), 1))


def lang_component(s: Column) -> Column:
    """A language as part of a file name; NULL where nothing usable is left."""
    lowered = F.replace(F.lower(strip(s)), F.lit("_"), F.lit("-"))
    cleaned = F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.nullif(cleaned, F.lit(""))


def published_lang(configured: Column, detected: Column) -> Column:
    """The configured language unless it is blank or auto, then the detected one."""
    return F.when(norm_lang(configured).isNotNull(), configured).otherwise(
        F.coalesce(F.nullif(detected, F.lit("")), configured)
    )


def norm_speaker(s: Column) -> Column:
    """Strip the ``speaker_`` prefix; blank labels are unknown."""
    label = strip(s)
    return F.when(label != "", F.regexp_replace(label, "^speaker_", ""))


def ass_text(s: Column) -> Column:
    return F.translate(s, "{}", "｛｝")


def ass_name(s: Column) -> Column:
    return strip(F.translate(s, ",\n\r", "   "))


def is_special_token(s: Column) -> Column:
    return (s.startswith("[_") & s.endswith("]")) | (s.startswith("<|") & s.endswith("|>"))


def is_url(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def cue_id(ordinal: Column) -> Column:
    return (ordinal + 1).cast("string")


def preview_id(position: Column) -> Column:
    return F.concat(F.lit("preview-"), position.cast("string"))


def word_cue_id(first: Column, last: Column) -> Column:
    return F.concat(F.lit("w"), first.cast("string"), F.lit("-"), last.cast("string"))


def is_preview_id(s: Column) -> Column:
    return s.startswith("preview-")


def is_word_cue_id(s: Column) -> Column:
    return s.rlike(r"^w\d+-\d+$")


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _casefold_words(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(x.casefold().split()))


@F.pandas_udf(T.StringType())
def _alnum_key(s: pd.Series) -> pd.Series:
    def key(x):
        if x is None:
            return None
        folded = unicodedata.normalize("NFKC", x).casefold()
        return "".join(c for c in folded if c.isalnum())

    return s.map(key)


def norm_key_a(s: Column) -> Column:
    """Casefold and collapse whitespace; full casefolding has no built-in."""
    return _casefold_words(s)


def norm_key_b(s: Column) -> Column:
    """NFKC, casefold, letters and digits only."""
    return _alnum_key(s)


def norm_key_c(s: Column) -> Column:
    """Strip and casefold."""
    return _casefold(strip(s))
