"""Importance resampling towards a target: hashed runs of words decide.

Every run of one to three words falls into a bucket by its CRC-32. The gain of
a bucket compares its share in the target with its share in the corpus; the
sum of a document's gains plus seeded Gumbel noise ranks it, and the best are
drawn.

CRC-32 is linear: the sum of a text followed by a word is the text's sum moved
on by the word's length, and the word's own sum. So only words need bytes. The
most frequent words are broadcast with their sums, the most frequent pairs
with theirs; a word outside the list takes its sum from its bytes, and a pair
outside from its two words. The lists only save work: buckets are exact either
way.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.conversation_repair import CRC_TABLE_SQL, crc_sql
from citespark.llm.staging import stored

BUCKETS = 10_000
#: Broadcast lists: words with their sums, pairs of them in twice as many slots.
HEAD_WORDS = 16_384
HEAD_PAIRS = 65_536
SLOTS = 1 << 17
#: Counters of a task while it looks for frequent words and pairs.
COUNTERS = 200_000
#: Lengths with a table of their own; longer words are moved on bit by bit.
SHORT = 64
#: Text bytes handled at a time.
BYTES_AT_ONCE = 2 << 20
RANK_ROWS = 1_000_000

#: Letters (A-Z lower-cased), digits and all bytes above 0x7F are words; the rest parts them.
FOLD = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 0x20
    for b in range(256)
)
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


def _one_byte_on(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    return state >> np.uint32(8) ^ table[state & np.uint32(255)]


class Mover:
    """Moves sums on by a number of zero bytes: four table look-ups per sum."""

    def __init__(self):
        table = _byte_table()
        corner = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        rows = [corner]
        for _ in range(SHORT):
            rows.append(_one_byte_on(rows[-1], table))
        self.short = np.stack(rows)
        # Doubling from the last row on: tables for SHORT, 2 * SHORT, ... bytes.
        self.long = [self.short[SHORT]]

    def _apply(self, tables: np.ndarray, state: np.ndarray) -> np.ndarray:
        moved = tables[0][state & np.uint32(255)]
        for i in range(1, 4):
            moved = moved ^ tables[i][state >> np.uint32(8 * i) & np.uint32(255)]
        return moved

    def move(self, state: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rest = lengths % SHORT
        moved = self.short[rest, 0, state & np.uint32(255)]
        for i in range(1, 4):
            moved = moved ^ self.short[rest, i, state >> np.uint32(8 * i) & np.uint32(255)]
        times = lengths // SHORT
        level = 0
        while (times >> level).any():
            if level == len(self.long):
                last = self.long[-1]
                self.long.append(np.stack([self._apply(last, row) for row in last]))
            hit = np.flatnonzero(times >> level & 1)
            moved[hit] = self._apply(self.long[level], moved[hit])
            level += 1
        return moved


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _slot(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Vocabulary:
    """The broadcast lists; sums of words and runs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.number = {word: i for i, word in enumerate(words)}
        self.sums, self.spaced, self.moves = self._read(words)
        self.mover = Mover()
        self.pair_key = np.full(SLOTS, -1, dtype=np.int64)
        self.pair_sum = np.zeros(SLOTS, dtype=np.uint32)
        known = [(self.number[a], self.number[b]) for a, b in pairs
                 if a in self.number and b in self.number]
        if known:
            a, b = np.array(known[::-1], dtype=np.int64).T
            # Of pairs that share a slot, the more frequent one is written last.
            keys = a * HEAD_WORDS + b
            at = _slot(keys)
            self.pair_key[at] = keys
            self.pair_sum[at] = self._append(self.sums[a], b, self.spaced, self.moves)

    @staticmethod
    def _read(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the words, of the words behind a space, and lengths with the space."""
        n = len(words)
        return (
            np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=n),
            np.fromiter((zlib.crc32(b" " + w) for w in words), dtype=np.uint32, count=n),
            np.fromiter(map(len, words), dtype=np.int64, count=n) + 1,
        )

    def _append(self, sums, words, spaced, moves) -> np.ndarray:
        """Sums of runs followed by a space and a word."""
        return self.mover.move(sums, moves[words]) ^ spaced[words]

    def runs(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all runs of one to three words, and the text of each."""
        flat = [word for words in texts for word in words]
        owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
        found = map(self.number.get, flat, repeat(-1))
        at = np.fromiter(found, dtype=np.int64, count=len(flat))
        tail = np.flatnonzero(at < 0)
        new: dict[bytes, int] = {}
        first = len(self.number)
        for i in tail.tolist():
            at[i] = first + new.setdefault(flat[i], len(new))
        more = self._read(list(new))
        sums, spaced, moves = (
            np.concatenate(both)
            for both in zip((self.sums, self.spaced, self.moves), more, strict=True)
        )
        two = np.flatnonzero(owner[1:] == owner[:-1])
        a, b = at[two], at[two + 1]
        pair = np.zeros(len(two), dtype=np.uint32)
        keys = np.where((a < first) & (b < first), a * HEAD_WORDS + b, -2)
        slots = _slot(keys)
        listed = self.pair_key[slots] == keys
        pair[listed] = self.pair_sum[slots[listed]]
        other = np.flatnonzero(~listed)
        pair[other] = self._append(sums[a[other]], b[other], spaced, moves)
        if len(owner) > 2:
            three = np.flatnonzero(owner[two] == owner[np.minimum(two + 2, len(owner) - 1)])
            three = three[two[three] + 2 < len(owner)]
        else:
            three = np.zeros(0, dtype=np.int64)
        triple = self._append(pair[three], at[two[three] + 2], spaced, moves)
        return (
            np.concatenate([sums[at], pair, triple]),
            np.concatenate([owner, owner[two], owner[two[three]]]),
        )


def _in_parts(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and words of some documents at a time, at most BYTES_AT_ONCE but for one text."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        held_keys: list = []
        held: list[list[bytes]] = []
        size = 0
        for key, text in zip(keys, batch.column(1).cast(pa.large_binary()), strict=True):
            content = text.as_py()
            if held and size + len(content or b"") > BYTES_AT_ONCE:
                yield held_keys, held
                held_keys, held, size = [], [], 0
            held_keys.append(key)
            held.append(words_of(content))
            size += len(content or b"")
        if held:
            yield held_keys, held


def frequent(texts: DataFrame) -> Vocabulary:
    """The most frequent words and pairs of all ``texts`` (row, text).

    A task holds at most COUNTERS counters of each kind. When they overflow,
    all counts are lowered by that of the middle one and the rest forgotten, so
    a word with a larger share than 2 / COUNTERS stays. A task names those with
    a share of at least 1 / HEAD_WORDS (pairs: 1 / HEAD_PAIRS) of its own.
    """

    def lower(counts: Counter) -> Counter:
        least = sorted(counts.values(), reverse=True)[COUNTERS // 2]
        return Counter({k: n - least for k, n in counts.items() if n > least})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, total = Counter(), Counter(), 0
        for _, parts in _in_parts(batches):
            for part in parts:
                words.update(part)
                pairs.update(zip(part, part[1:]))
                total += len(part)
            if len(words) > COUNTERS:
                words = lower(words)
            if len(pairs) > COUNTERS:
                pairs = lower(pairs)
        kept = [(w, None, n) for w, n in words.items() if n * HEAD_WORDS >= total]
        kept += [(a, b, n) for (a, b), n in pairs.items() if n * HEAD_PAIRS >= total and n > 1]
        if kept:
            a, b, n = zip(*kept, strict=True)
            yield pa.record_batch(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                names=["a", "b", "n"],
            )

    counted = stored(
        texts.mapInArrow(count, "a binary, b binary, n bigint")
        .groupBy("a", "b").agg(F.sum("n").alias("n")),
        "frequent",
    )

    def top(rows: DataFrame, most: int) -> list:
        return rows.orderBy(F.desc("n"), "a", "b").limit(most).collect()

    words = [bytes(r["a"]) for r in top(counted.filter("b IS NULL"), HEAD_WORDS)]
    pairs = top(counted.filter("b IS NOT NULL"), HEAD_PAIRS)
    return Vocabulary(words, [(bytes(r["a"]), bytes(r["b"])) for r in pairs])


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary, buckets: int = BUCKETS) -> np.ndarray:
    """Runs of all ``texts`` (row, text) in each bucket."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for _, parts in _in_parts(batches):
            sums, _ = shared.value.runs(parts)
            held += np.bincount(sums.astype(np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    rows = (
        texts.mapInArrow(count, "bucket bigint, n bigint")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    totals = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths of the logarithm of the smoothed shares' ratio."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(seed: int, key: int | None) -> int:
    """Gumbel noise of a document, in thousandths."""
    name = f"{seed}:{'' if key is None else key}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(
    rows: DataFrame, vocabulary: Vocabulary, gains: np.ndarray, seed: int
) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, gains))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, gains = shared.value
        for keys, parts in _in_parts(batches):
            sums, owner = vocabulary.runs(parts)
            n = len(parts)
            features = np.bincount(owner, minlength=n)
            gained = gains[sums.astype(np.int64) % len(gains)]
            # Whole numbers below 2 ** 53 are exact in doubles.
            weight = np.bincount(owner, weights=gained, minlength=n).astype(np.int64)
            noisy = weight + np.array([noise(seed, key) for key in keys], dtype=np.int64)
            yield pa.record_batch(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(words) for words in parts], pa.int64()),
                    pa.array(features.astype(np.int64)),
                    pa.array(weight),
                    pa.array(noisy),
                ],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return rows.mapInArrow(
        score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (stored rows that may be drawn) with ``rank``: null beyond ``percent`` percent.

    Only rows above a quantile that is surely below the cut are sorted, in
    ranges; the ranks add up from the sizes of the ranges before.
    """
    spark = scored.sparkSession
    n, low = scored.agg(
        F.count("*"),
        # Off by at most 1 / accuracy of the rows; the margin is a whole percent.
        F.percentile_approx("score", max(0.0, (99 - percent) / 100), 10_000),
    ).first()
    draw = percent * n // 100
    columns = scored.columns
    none = F.lit(None).cast("bigint")
    if draw == 0:
        return scored.withColumn("rank", none)
    head = scored.filter(F.col("score") >= low)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("tie"), F.asc("uid")]
    ranges = max(1, -(-(percent + 2) * n // 100 // RANK_ROWS))
    placed = stored(
        head.withColumn("tie", F.xxhash64(*columns))
        .withColumn("uid", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select(*columns, F.monotonically_increasing_id().alias("place")),
        "ranked",
    ).withColumn("part", F.shiftright("place", 33))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per range of RANK_ROWS.
    starts = (
        placed.groupBy("part").agg(F.count("*").alias("rows"))
        .select("part", F.coalesce(before, F.lit(0)).alias("first"))
    )
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), "part").withColumn(
        "rank", F.col("first") + inside + 1
    )
    numbered = numbered.select(
        *columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")
    )
    return scored.filter(F.col("score") < low).withColumn("rank", none).unionByName(numbered)


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every document with its weight, and the rank of those drawn towards ``target``.

    Returns doc_id, n_words, n_features, weight, score, rank. Of the N documents
    with at least ``least_words`` words, the ``percent * N // 100`` with the
    highest scores are drawn; ties go to the smaller id, a null id first.

    A null, empty or wordless text has no features and weight 0. Rows that
    repeat an id have the same noise and are ranked one after the other. An
    empty target gives gains against even shares; an empty table no row. Other
    columns are ignored. Whole texts are read three times: for the frequent
    lists, for the totals, for the weights.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = target.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text_col).alias("text")
    )
    vocabulary = frequent(rows)
    gains = bucket_gains(
        bucket_totals(rows, vocabulary, buckets), bucket_totals(wanted, vocabulary, buckets)
    )
    scored = stored(_scored(rows, vocabulary, gains, seed), "scored")
    drawable = scored.filter(F.col("n_words") >= least_words)
    short = scored.filter(F.col("n_words") < least_words)
    return ranked(drawable, percent).unionByName(
        short.withColumn("rank", F.lit(None).cast("bigint"))
    )


def sql() -> str:
    """DuckDB SQL of the query: every distinct run's bytes go through the CRC."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    point = "CAST(unicode(ch) AS BIGINT)"
    more = [f"128 | (({point} >> {shift}) & 63)" for shift in (0, 6, 12)]
    utf8 = (
        f"flatten(list_transform(string_split(feature, ''), lambda ch: CASE "
        f"WHEN {point} < 128 THEN [{point}] "
        f"WHEN {point} < 2048 THEN [192 | ({point} >> 6), {more[0]}] "
        f"WHEN {point} < 65536 THEN [224 | ({point} >> 12), {more[1]}, {more[0]}] "
        f"ELSE [240 | ({point} >> 18), {more[2]}, {more[1]}, {more[0]}] END))"
    )
    return f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
parted AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}',
    '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    AS feature FROM parted),
counted AS (SELECT side, row, feature, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT feature, {crc_sql(utf8, "t")} % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc),
placed AS (SELECT side, row, bucket, n FROM counted JOIN hashed USING (feature)),
totals AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t
  FROM placed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM totals),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1)
    * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1)
    * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM totals, sums),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST(
    '0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS BIGINT) AS DOUBLE) + 0.5)
    / 4294967296))) AS BIGINT) AS score
  FROM parted LEFT JOIN weights USING (row) WHERE side = 0),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC,
    doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM drawn
"""
