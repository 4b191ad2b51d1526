"""Agent replies: a lenient JSON object reader, in column expressions only.

Objects come back as canonical JSON text: keys in name order, no spaces. Text that repeats
a key inside one object is not JSON here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(text: Column) -> Column:
    """The text as one JSON value.

    The parser ignores what follows a value. Only a text that is one value and nothing else
    is sound both inside an array and inside an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(listed, "$", "array<variant>")
    return bound(alone, lambda a: F.when((F.size(a) == 1) & named.isNotNull(), F.get(a, F.lit(0))))


def _braced(text: Column) -> Column:
    """From the first opening to the last closing brace, NULL without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _fenced(text: Column) -> Column:
    """The first stretch between two fences that begins and ends with a brace."""
    parts = F.split(text, FENCE)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    bare = F.transform(inner, lambda p: F.trim(F.regexp_replace(p, r"^json\s*|^\s+|\s+$", "")))
    return F.get(F.filter(bare, lambda p: p.startswith("{") & p.endswith("}")), F.lit(0))


def _object(text: Column) -> Column:
    """The variant object that a reply is or contains, NULL when there is none."""

    def read(t: Column) -> Column:
        whole, fenced = _parsed(t), _fenced(t)
        # A reply that is JSON, but no object, holds no answer.
        return F.when(whole.isNotNull(), F.when(F.ltrim(t).startswith("{"), whole)).otherwise(
            F.when(fenced.isNotNull(), _parsed(fenced)).otherwise(_parsed(_braced(t)))
        )

    return bound(F.regexp_replace(text, r"^\s+|\s+$", ""), read)


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; NULL for an absent value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def object_in(text: Column) -> Column:
    """The object of a reply, taken out of any ``result`` texts around it."""

    def inner(t: Column) -> Column:
        result = F.try_variant_get(_object(t), "$.result", "variant")
        return bound(result, lambda r: F.when(kind_of(r) == "STRING", F.try_variant_get(r, "$", "string")))

    # Each wrapper doubles the escapes, so the logarithm of the length bounds the wrappers.
    most = F.ceil(F.log2(F.length(text) + 2)).cast("int")
    last = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(text.alias("text"), F.lit(True).alias("more")),
        lambda at, _: F.when(at["more"], bound(inner(at["text"]), lambda t: F.struct(
            F.coalesce(t, at["text"]).alias("text"), t.isNotNull().alias("more")))).otherwise(at),
    )
    return _object(last["text"])


def _reaching_end(text: Column) -> Column:
    """The object from the earliest brace from which one reaches the last closing brace."""

    def read(t: Column) -> Column:
        braces = F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))
        later = F.when(braces > 1, F.sequence(braces - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        tail = lambda i: F.concat(F.lit("{"), F.call_function("substring_index", t, F.lit("{"), -i))
        return F.coalesce(_parsed(t), F.aggregate(
            later, F.lit(None).cast("variant"), lambda found, i: F.coalesce(found, _parsed(tail(i)))
        ))

    return bound(_braced(text), read)


def extract_json(s: Column, last_resort: bool = False) -> Column:
    """The JSON object inside a reply, as canonical JSON text; NULL when there is none."""
    found = object_in(s)
    return F.to_json(F.coalesce(found, _reaching_end(s)) if last_resort else found)
