"""Text expressions. All of them stay in the JVM except entity decoding."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's ``str`` sees it: Unicode White_Space plus the four
# ASCII separators that Java leaves out.
ANY_SPACE = r"[\s\x1c-\x1f]"

# Line ends as ``str.splitlines`` sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def strip_html(text: Column) -> Column:
    """Tags become one space, white-space runs become one space, ends trimmed."""
    without_tags = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(without_tags, r"\s+", " "))


# Texts of an Arrow batch that are Python strings at once.
SLICE_ROWS = 256


@F.arrow_udf(T.StringType())
def _decode_entities(text: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for at in range(0, len(text), SLICE_ROWS):
        part = text.slice(at, SLICE_ROWS)
        if part.null_count == len(part):
            parts.append(pa.nulls(len(part), pa.string()))
        else:
            found = [None if t is None else html.unescape(t) for t in part.to_pylist()]
            parts.append(pa.array(found, pa.string()))
    return pa.concat_arrays(parts)


def squeeze_space(text: Column) -> Column:
    """One space for every run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){ANY_SPACE}+", " "))


def clean_text(text: Column) -> Column:
    """Decode HTML entities, then squeeze white space; NULL becomes ''.

    Only rows that contain an ampersand carry their text to Python, so clean
    text crosses the Arrow boundary as NULL.
    """
    encoded = F.when(F.contains(text, F.lit("&")), text)
    decoded = F.coalesce(_decode_entities(encoded), text, F.lit(""))
    return squeeze_space(decoded)


def page_title(page: Column) -> Column:
    return F.regexp_extract(page, r"<title>([^<]*)</title>", 1)


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{ANY_SPACE}+|{ANY_SPACE}+$", "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words, split at anything but letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD)
    return F.array_distinct(F.array_remove(words, ""))


def first_words(text: Column, limit: int) -> Column:
    """The first ``limit`` words, followed by ' ...' when any were left out."""
    words = F.array_remove(F.split(clean_text(text), " "), "")
    shortened = F.array_join(F.slice(words, 1, limit), " ")
    return F.when(F.size(words) > limit, F.concat(shortened, F.lit(" ..."))).otherwise(shortened)


def id_from_text(text: Column) -> Column:
    return text.try_cast("bigint")


def score_from_text(text: Column) -> Column:
    """Whole number nearest to a numeric text, 0 for anything else.

    Goes through DOUBLE so that '12.6' and '1e3' count as numbers; the pattern
    keeps out Java's own suffixes such as '1d'.
    """
    trimmed = F.trim(text)
    number = F.when(
        trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed
    ).try_cast("double")
    return F.coalesce(F.round(number).try_cast("int"), F.lit(0))
