"""Language identification with bit-sliced Bloom filters of letter n-grams.

One array of slots serves all languages: bit ``l`` of a slot belongs to the
filter of language ``l``, so a look-up returns all languages that have an
n-gram at once. A text is decided by how many of its n-grams each filter
holds, less what a filter of that fill holds by accident.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import stored

UNKNOWN = "und"
GRAM = 3
HASHES = 3
#: An n-gram is a language's own from this share of the language's n-grams on,
LEAST_RATE = 2e-5
#: and from this part of its highest share in any language on.
LEAST_PART = 0.15
#: Labelled documents of each language that the filters are learned from, about.
FIT_DOCUMENTS = 4_000
MAX_LANGUAGES = 64
#: A text whose best filter holds less than this is in none of the languages.
LEAST_HELD = 0.2
ROWS_AT_ONCE = 512
BOUNDARY = 0


class Letters:
    """Letter n-grams of many texts at once, as 64-bit hashes with their text's number."""

    def __init__(self):
        self.is_letter = np.zeros(0x110000, dtype=bool)
        for start, end in ((0, 0x3000), (0xA000, 0x11000)):
            for c in range(start, end):
                self.is_letter[c] = unicodedata.category(chr(c))[0] == "L"
        # Ideographs and Hangul, and beyond the basic plane.
        self.is_letter[0x3000:0xA000] = [chr(c).isalpha() for c in range(0x3000, 0xA000)]
        self.beyond: set[int] = set()

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n\n".join((t or "").lower() for t in texts)
        codes = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "replace"), dtype=np.uint32)
        high = codes >= 0x11000
        if high.any():
            for c in set(np.unique(codes[high]).tolist()) - self.beyond:
                self.is_letter[c] = chr(c).isalpha()
                self.beyond.add(c)
        letters = np.where(self.is_letter[codes], codes, BOUNDARY).astype(np.uint64)
        inside = letters[1:-1] != BOUNDARY
        middle = np.flatnonzero(inside) + 1
        mixed = (
            letters[middle - 1] * np.uint64(0x9E3779B97F4A7C15)
            + letters[middle] * np.uint64(0xC2B2AE3D27D4EB4F)
            + letters[middle + 1] * np.uint64(0x165667B19E3779F9)
        )
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        lengths = np.fromiter((len((t or "").lower()) + 2 for t in texts), np.int64, len(texts))
        owner = np.searchsorted(np.cumsum(lengths), middle - 1, side="right")
        return mixed, owner


def slots_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each n-gram."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return [((hashes + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """Slots of 64-bit language masks; ``accident[l]`` is filter l's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    bits: int

    def __post_init__(self):
        fill = [
            np.count_nonzero((self.slots >> np.uint64(i)) & np.uint64(1)) / len(self.slots)
            for i in range(len(self.languages))
        ]
        self.accident = np.array(fill, dtype=np.float64) ** HASHES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """All languages that have each n-gram, as bits."""
        found = None
        for slots in slots_of(hashes, self.bits):
            here = self.slots[slots]
            found = here if found is None else found & here
        return found

    def held(self, hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple:
        """Corrected share of each text's n-grams in each filter, and its number of n-grams."""
        masks = self.masks(hashes)
        total = np.bincount(owner, minlength=texts)
        shares = np.zeros((texts, len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks >> np.uint64(i)) & np.uint64(1) == 1
            count = np.bincount(owner[hit], minlength=texts)
            by_accident = self.accident[i]
            shares[:, i] = (count / np.maximum(total, 1) - by_accident) / max(1 - by_accident, 1e-9)
        return np.clip(shares, 0, 1), total


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from; a null id is one of them."""
    part = F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(part == 2, F.lit(True))


def fit_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_documents: int = FIT_DOCUMENTS,
) -> LanguageFilters:
    """Learn the filters from labelled documents that are not held out.

    About ``fit_documents`` of each language are drawn by a hash of the id and
    read whole. A filter has at most 1 / LEAST_RATE n-grams, which bounds what
    reaches the driver. Rows with a null text or label teach nothing.
    """
    rows = docs.filter(
        ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros(1, dtype=np.uint64), 0)
    chance = F.element_at(
        F.create_map(
            *[x for lang in languages for x in (F.lit(lang), F.lit(fit_documents / sizes[lang]))]
        ),
        F.col("lang"),
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < chance).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        number = {lang: i for i, lang in enumerate(languages)}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                which = np.array([number[lang] for lang in batch.column(0).to_pylist()])
                grams, owner = letters.grams(batch.column(1).to_pylist())
                for i in np.unique(which):
                    distinct, times = np.unique(grams[which[owner] == i], return_counts=True)
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(distinct), i), pa.int32()),
                            pa.array(distinct.view(np.int64), pa.int64()),
                            pa.array(times, pa.int64()),
                        ],
                        names=["language", "gram", "times"],
                    )

    counted = (
        sample.mapInArrow(count, "language int, gram bigint, times bigint")
        .groupBy("language", "gram").agg(F.sum("times").alias("times"))
    )
    counted = stored(counted, "grams")
    totals = {
        r["language"]: r["n"]
        for r in counted.groupBy("language").agg(F.sum("times").alias("n")).collect()
    }
    if not totals:
        return LanguageFilters(languages, np.zeros(1, dtype=np.uint64), 0)
    total = F.element_at(
        F.create_map(*[x for i, n in totals.items() for x in (F.lit(i), F.lit(float(n)))]),
        F.col("language"),
    )
    common = counted.withColumn("rate", F.col("times") / total).filter(F.col("rate") >= LEAST_RATE)
    own = (
        common.groupBy("gram")
        .agg(F.max("rate").alias("most"), F.collect_list(F.struct("language", "rate")).alias("in"))
        .select(
            "gram",
            F.aggregate(
                F.filter("in", lambda x: x["rate"] >= F.col("most") * LEAST_PART),
                F.lit(0).cast("bigint"),
                lambda mask, x: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["language"])),
            ).alias("mask"),
        )
    )
    table = own.toArrow()
    grams = table["gram"].to_numpy().view(np.uint64)
    masks = table["mask"].to_numpy().view(np.uint64)
    bits = max(6, int(2 * HASHES * max(1, len(grams)) - 1).bit_length())
    slots = np.zeros(1 << bits, dtype=np.uint64)
    for at in slots_of(grams, bits):
        np.bitwise_or.at(slots, at, masks)
    return LanguageFilters(languages, slots, bits)


def identify_languages(
    docs: DataFrame,
    filters: LanguageFilters,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, best_held.

    ``best_held`` is the share of the text's n-grams that its language's filter
    holds, corrected for accidents; ``score`` is that share relative to the sum
    over all languages. Ties go to the first language. A null text, or one
    without a letter, is ``und`` with score 0; so is every text if nothing was
    learned. Texts are read whole. Null and repeated ids are rows like others,
    an empty table gives an empty result, other columns are ignored.
    """
    # The filters travel with the function: at most 64 / LEAST_RATE n-grams.
    names = np.array([*filters.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                n = batch.num_rows
                grams, owner = letters.grams(batch.column(1).to_pylist())
                if filters.languages:
                    shares, total = filters.held(grams, owner, n)
                    best = shares.argmax(axis=1)
                    held = shares[np.arange(n), best]
                    score = held / np.maximum(shares.sum(axis=1), 1e-12)
                    best = np.where(total > 0, best, len(filters.languages))
                    held, score = np.where(total > 0, held, 0.0), np.where(total > 0, score, 0.0)
                else:
                    best, held, score = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(np.clip(score, 0, 1), pa.float64()),
                        pa.array(held, pa.float64()),
                    ],
                    names=["doc_id", "lang_pred", "score", "best_held"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, best_held double")


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled documents and predict all: doc_id, held_out, lang_pred, score, ..."""
    found = identify_languages(docs, fit_languages(docs, **options))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "best_held"
    )


def is_rejected() -> Column:
    """Of no language: no letters, or too few n-grams of any language."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("best_held") < LEAST_HELD)
