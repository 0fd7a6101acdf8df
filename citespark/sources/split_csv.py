"""Quoted CSV read by many tasks: byte ranges, told apart by the parity of quotes.

Whether a line end lies inside a quoted field depends on the number of quotes
before it. One pass counts the quotes of each byte range; their running sum
tells every range how it begins. A second pass lets each range parse the
records that start in it, wherever they end.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citespark.sources.matrix import _open, qualified

RANGE_BYTES = 64 << 20
STEP = 8 << 20
QUOTE, COMMA, LINE_FEED, RETURN = b'",\n\r'
BOM = b"\xef\xbb\xbf"
RANGES = "file string, start bigint, stop bigint, size bigint"


def _files(path: str) -> list[tuple[str, int]]:
    """Data files at a qualified path, in name order, with their sizes."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    listed = system.get_file_info(fs.FileSelector(inner))
    return sorted(
        (i.path, i.size)
        for i in listed
        if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))
    )


def record_ends(data: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the line ends outside quotes, and the parity before each byte."""
    quotes = np.cumsum(data == QUOTE, dtype=np.uint8) + np.uint8(odd) & 1
    return np.flatnonzero((data == LINE_FEED) & (quotes == 0)) + 1, quotes


def stray_quote(data: np.ndarray, quotes: np.ndarray) -> bool:
    """Whether a quote opens inside a plain field, or closes before its end."""
    at = np.flatnonzero(data == QUOTE)
    opening = at[quotes[at] == 1]
    closing = at[quotes[at] == 0]
    before = data[opening[opening > 0] - 1]
    behind = data[closing[closing < len(data) - 1] + 1]
    # A doubled quote closes and opens again.
    return bool(
        (~np.isin(before, [COMMA, LINE_FEED, QUOTE])).any()
        or (~np.isin(behind, [COMMA, LINE_FEED, RETURN, QUOTE])).any()
    )


def _read_range(source, start: int, stop: int, size: int, odd: int) -> bytes:
    """The bytes of all records that start in [start, stop)."""
    raw = source.read_at(stop - start, start)
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return b""
    ends, quotes = record_ends(data, odd)
    first = 0
    if start:
        # The byte before tells whether a record starts here; parity does not reach back.
        previous = source.read_at(1, start - 1)
        if not (previous == b"\n" and odd == 0):
            if not len(ends):
                return b""
            first = int(ends[0])
    if first >= len(data):
        return b""
    parts = [raw[first:]]
    whole = len(ends) and int(ends[-1]) == len(data)
    at, odd = stop, int(quotes[-1])
    while not whole and at < size:
        more = source.read_at(min(STEP, size - at), at)
        data = np.frombuffer(more, dtype=np.uint8)
        ends, quotes = record_ends(data, odd)
        whole = bool(len(ends))
        parts.append(more[: int(ends[0])] if whole else more)
        at, odd = at + len(more), int(quotes[-1])
    return b"".join(parts)


def _texts(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        found = [v if v is None else v.decode("utf-8", "replace") for v in column.to_pylist()]
        return pa.array(found, pa.string())


def _parsed(raw: bytes, fields: list[str]) -> pa.RecordBatch | None:
    """Records as text columns; those of the wrong length are left out."""
    try:
        table = csv.read_csv(
            io.BytesIO(raw),
            read_options=csv.ReadOptions(
                column_names=fields, block_size=len(raw) + 1, use_threads=False
            ),
            parse_options=csv.ParseOptions(
                newlines_in_values=True, invalid_row_handler=lambda row: "skip"
            ),
            convert_options=csv.ConvertOptions(
                column_types={f: pa.binary() for f in fields}, check_utf8=False,
                null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True,
            ),
        )
    except pa.ArrowInvalid as error:
        if "Empty CSV" in str(error):
            return None
        raise
    return pa.record_batch([_texts(c) for c in table.columns], names=fields)


def read_split_csv(
    spark: SparkSession, path: str, fields: list[str], range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Read the columns of a CSV file or folder as text; rows of the wrong length are dropped.

    ``fields`` names all columns; the first record of each file is its header.
    Quoted fields may hold commas and line ends, and a doubled quote stands for
    one; an empty field is null, quoted or not. Quotes inside plain fields, or
    text behind a closing quote, would make the parity wrong: the job fails on
    them, and :func:`citespark.sources.raw_csv.read_text_csv` reads such files.
    Records end with a line feed, or a return and a line feed.

    A task reads ``range_bytes`` and what its last record needs beyond them.
    """
    path = qualified(spark, path)
    starts = [
        (name, start, min(start + range_bytes, size), size)
        for name, size in _files(path)
        for start in range(0, size, range_bytes)
    ]
    if not starts:
        return spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields))
    ranges = spark.createDataFrame(starts, RANGES).repartition(len(starts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(path)
        for batch in batches:
            for piece in batch.to_pylist():
                total = 0
                with system.open_input_file(piece["file"]) as source:
                    for at in range(piece["start"], piece["stop"], STEP):
                        step = min(STEP, piece["stop"] - at)
                        total += source.read_at(step, at).count(b'"')
                yield pa.RecordBatch.from_pylist([{**piece, "quotes": total}])

    counted = ranges.mapInArrow(count, f"{RANGES}, quotes bigint")
    # One row per range in this window.
    before = F.sum("quotes").over(
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    known = counted.withColumn("odd", F.pmod(F.coalesce(before, F.lit(0)), F.lit(2)).cast("int"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(path)
        for batch in batches:
            for piece in batch.to_pylist():
                with system.open_input_file(piece["file"]) as source:
                    raw = _read_range(
                        source, piece["start"], piece["stop"], piece["size"], piece["odd"]
                    )
                if not raw:
                    continue
                data = np.frombuffer(raw, dtype=np.uint8)
                if piece["start"] == 0 and raw.startswith(BOM):
                    raw, data = raw[len(BOM) :], data[len(BOM) :]
                ends, quotes = record_ends(data, 0)
                if stray_quote(data, quotes):
                    raise ValueError(f"{piece['file']} has a quote inside a plain field")
                if piece["start"] == 0:
                    # Empty lines before the header do not count as one.
                    header = 0
                    while header < len(raw) and raw[header : header + 1] in (b"\n", b"\r"):
                        header += 1
                    later = ends[ends > header]
                    raw = raw[int(later[0]) :] if len(later) else b""
                found = _parsed(raw, fields) if raw.strip(b"\r\n") else None
                if found is not None:
                    yield found

    schema = ", ".join(f"`{name}` string" for name in fields)
    return known.select("file", "start", "stop", "size", "odd").repartition(
        len(starts), "file", "start"
    ).mapInArrow(parse, schema)
