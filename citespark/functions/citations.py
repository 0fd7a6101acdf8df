"""Citation measures over answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.text import LINE_END, strip_ends

# Shortest paragraph that counts, and the audit limits.
SHORTEST_PARAGRAPH = 15
REQUIRED_VALIDITY = 1.0
REQUIRED_COVERAGE = 0.5


def paragraphs(answer: Column) -> Column:
    lines = F.transform(F.split(answer, LINE_END), strip_ends)
    return F.filter(lines, lambda line: F.length(line) >= SHORTEST_PARAGRAPH)


def cited_numbers(paragraph: Column) -> Column:
    """Numbers in square brackets; NULL stands for one too long for BIGINT."""
    digits = F.regexp_extract_all(paragraph, F.lit(r"\[([0-9]+)\]"), 1)
    return F.transform(digits, lambda text: text.try_cast("bigint"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def citation_coverage(answer: Column) -> Column:
    """Share of paragraphs with at least one citation."""
    parts = paragraphs(F.coalesce(answer, F.lit("")))
    cited = F.filter(parts, lambda text: text.rlike(r"\[[0-9]+\]"))
    return _share(F.size(cited), F.size(parts))


def citation_validity(answer: Column, source_count: Column) -> Column:
    """Share of citations whose number points at one of the sources."""
    parts = paragraphs(F.coalesce(answer, F.lit("")))
    numbers = F.flatten(F.transform(parts, cited_numbers))
    valid = F.filter(numbers, lambda n: n.between(F.lit(1), source_count))
    return _share(F.size(valid), F.size(numbers))


def needs_fallback(coverage: Column, validity: Column) -> Column:
    return (validity < REQUIRED_VALIDITY) | (coverage < REQUIRED_COVERAGE)
