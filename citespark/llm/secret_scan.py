"""Secret scan: fixed patterns, and a battery of randomness tests.

Long tokens are read in the smallest alphabet that has all their characters.
The evidence that a token is random is a likelihood ratio: uniform symbols of
its alphabet, weighted by the uniformity of its symbols (chi-squared), its runs
above and below the middle and its lag-one correlation, against a chain with
the letter pairs of the corpus. An ordinary token reaches a ratio of ``r`` with
a probability of at most ``1 / r``. Which findings are kept is decided on these
probabilities for each alphabet and length class, by false-discovery control
over all tokens of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import stored

# The patterns of the three kinds, their least lengths, their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Alphabets from the smallest on; a token has the first that holds it.
ALPHABETS = (
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    LOWER,
    UPPER,
    UPPER + "234567",
    DIGITS + LOWER,
    DIGITS + UPPER,
    LOWER + UPPER,
    DIGITS + LOWER + UPPER,
    DIGITS + LOWER + UPPER + "+/",
    DIGITS + LOWER + UPPER + "-_",
    DIGITS + LOWER + UPPER + "+/-_",
)
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}"
LEAST_TOKEN = 16
#: Upper ends of the length classes; the last one is open.
LENGTHS = (20, 28, 40, 64, 128)
#: A token is not random if the battery's probability is below this.
NOT_RANDOM = 0.01
#: What the chain of ordinary words tells apart: letters of either case, digits, all else.
DIGIT, OTHER, FOLDED = 26, 27, 28
FOLD = np.full(256, OTHER, dtype=np.int64)
for _at, _pair in enumerate(zip(LOWER, UPPER, strict=True)):
    FOLD[[ord(c) for c in _pair]] = _at
FOLD[[ord(c) for c in DIGITS]] = DIGIT
#: Letters that the share of all letters counts for, after each symbol.
PRIOR_LETTERS = 32.0
#: Share of changes between letters, digits and others that the corpus does not explain.
ANY_CHANGE = 0.1
#: Share of false findings that the control allows.
FALSE_SHARE = 0.01
#: Probabilities are counted in this many bins per factor ten, down to 1e-30.
PER_DECADE, DECADES = 10, 30
ROWS_AT_ONCE = 512

SPAN = "struct<start: bigint, kind: int, end: bigint>"
SCANNED = (
    f"doc_id bigint, is_doc boolean, base array<{SPAN}>, "
    "tokens array<struct<start: bigint, end: bigint, stratum: int, bin: int>>, "
    "tests array<struct<stratum: int, bin: int, n: bigint>>"
)


def base_spans(text: str, patterns) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, in order."""
    assign, access, long_hex = patterns
    found = [
        (m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in access.finditer(text)
            if len(m[0]) >= LEAST["access"]
        ]
    # A run of hex digits is matched whole, so short runs can be passed over.
    found += [(m.start(), 2, m.end()) for m in long_hex.finditer(text)]
    return sorted(found)


def base_patterns():
    return (
        re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
        re.compile(ACCESS),
        re.compile(HEX.replace("+", "{%d,}" % LEAST["hex"])),
    )


def upper_tail(statistic: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Probability of a larger chi-squared statistic (cube-root normal approximation)."""
    part = 2 / (9 * freedom)
    z = ((np.maximum(statistic, 0) / freedom) ** (1 / 3) - (1 - part)) / np.sqrt(part)
    return normal_tail(z)


_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2))


def pair_odds(pair_counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """log10 of an ordinary word's probability of each symbol after each, over that of a random one.

    Both are those of tokens in the alphabet of ``codes``. Case is no evidence,
    and neither is which digit or sign it is; so words in capitals, joined
    words and paths count as words.
    """
    uniform = np.bincount(FOLD[codes], minlength=FOLDED) / len(codes)
    used = uniform > 0
    counts = pair_counts.astype(np.float64) * used
    kinds = np.maximum(np.arange(FOLDED) - DIGIT + 1, 0)
    change = np.zeros((3, 3))
    np.add.at(change, (kinds[:, None], kinds[None, :]), counts)
    there = np.bincount(kinds[used], minlength=3) > 0
    change = (change + there) / (change + there).sum(axis=1, keepdims=True)
    change = (1 - ANY_CHANGE) * change + ANY_CHANGE * there / there.sum()
    ordinary = change[kinds][:, kinds]
    letters = np.flatnonzero(used[:DIGIT])
    if len(letters):
        after = counts[:, letters]
        share = after.sum(axis=0) + 1
        after = after + PRIOR_LETTERS * share / share.sum()
        ordinary[:, letters] *= after / after.sum(axis=1, keepdims=True)
    return np.log10(np.where(used, ordinary, 1.0) / np.where(used, uniform, 1.0))


class Battery:
    """The tests, for many tokens at once."""

    def __init__(self, pair_counts: np.ndarray):
        self.place = np.full((len(ALPHABETS), 256), -1, dtype=np.int64)
        self.size = np.array([len(a) for a in ALPHABETS], dtype=np.float64)
        self.odds = np.zeros((len(ALPHABETS), FOLDED, FOLDED))
        for i, alphabet in enumerate(ALPHABETS):
            codes = np.frombuffer(alphabet.encode(), dtype=np.uint8)
            self.place[i, codes] = np.arange(len(codes))
            self.odds[i] = pair_odds(pair_counts, codes)
        self.members = self.place >= 0

    def alphabets(self, codes, owner, n: int) -> np.ndarray:
        """The first alphabet that holds each token."""
        found = np.full(n, -1)
        for i in range(len(ALPHABETS)):
            outside = np.bincount(owner[~self.members[i, codes]], minlength=n)
            found = np.where((found < 0) & (outside == 0), i, found)
        return found

    def test(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Stratum of each token, and its probability of being an ordinary word (1: not random)."""
        n = len(tokens)
        length = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
        codes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        owner = np.repeat(np.arange(n), length)
        kind = self.alphabets(codes, owner, n)
        size, m = self.size[kind], length.astype(np.float64)
        symbols = self.place[kind[owner], codes]
        # Symbols that repeat: ordered pairs of equal ones.
        keys, times = np.unique(owner * 128 + symbols, return_counts=True)
        repeats = np.bincount(keys // 128, weights=times * (times - 1.0), minlength=n)
        # Uniformity. The statistic of all counts, with its moments at this length.
        chi = size / m * (repeats + m) - m
        spread = np.sqrt(2 * (size - 1) * (1 - 1 / m))
        scale = spread**2 / (2 * (size - 1))
        uniform = upper_tail(chi / scale, (size - 1) / scale)
        # Runs above and below the middle of the alphabet.
        high = symbols * 2 >= size[owner]
        above = np.bincount(owner[high], minlength=n).astype(np.float64)
        below = m - above
        change = (owner[1:] == owner[:-1]) & (high[1:] != high[:-1])
        runs = 1 + np.bincount(owner[1:][change], minlength=n)
        expected = 2 * above * below / m + 1
        variance = np.maximum((expected - 1) * (expected - 2) / (m - 1), 1e-9)
        by_runs = np.where(
            (above == 0) | (below == 0),
            2.0 ** (1 - m),
            2 * normal_tail(np.abs(runs - expected) / np.sqrt(variance)),
        )
        # Correlation of neighbours.
        mean = np.bincount(owner, weights=symbols, minlength=n) / m
        centred = symbols - mean[owner]
        square = np.bincount(owner, weights=centred**2, minlength=n)
        pair = owner[1:] == owner[:-1]
        lagged = np.bincount(owner[1:][pair], weights=(centred[1:] * centred[:-1])[pair], minlength=n)
        serial = np.where(square > 0, lagged / np.maximum(square, 1e-9), 1.0)
        by_serial = 2 * normal_tail(np.abs(serial + 1 / m) * np.sqrt(m))
        # All three together.
        each = np.clip(np.stack([uniform, by_runs, by_serial]), 1e-300, 1)
        random = upper_tail(-2 * np.log(each).sum(axis=0), np.full(n, 6.0))
        # Ordinary words have the pairs of the corpus.
        folded = FOLD[codes]
        before = np.concatenate([[OTHER], folded[:-1]])
        before[np.cumsum(length) - length] = OTHER
        odds = np.bincount(owner, weights=self.odds[kind[owner], before, folded], minlength=n)
        # Of random tokens the battery's probability is uniform; twice it is a density.
        passed = random >= NOT_RANDOM
        odds -= np.log10(2 * np.where(passed, random, 0.5))
        ordinary = 10.0 ** np.clip(odds, -300, 0)
        stratum = kind * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, length)
        return stratum, np.where(passed, ordinary, 1.0)


def probability_bins(p: np.ndarray) -> np.ndarray:
    """Bin 0 holds the smallest probabilities; the last one those up to 1."""
    depth = -np.log10(np.clip(p, 10.0**-DECADES, 1.0))
    return (DECADES * PER_DECADE - np.floor(depth * PER_DECADE)).astype(np.int64)


def bin_top(number: int) -> float:
    """The largest probability that a bin can hold."""
    return 10.0 ** ((number - DECADES * PER_DECADE) / PER_DECADE)


def count_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each folded symbol follows each in all texts; texts begin and end with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDED**2, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    folded = FOLD[np.frombuffer(text.as_buffer(), dtype=np.uint8)]
                    folded = np.concatenate([[OTHER], folded, [OTHER]])
                    total += np.bincount(
                        folded[:-1] * FOLDED + folded[1:], minlength=FOLDED**2
                    )
        yield pa.record_batch(
            [pa.array(np.arange(FOLDED**2), pa.int32()), pa.array(total, pa.int64())],
            names=["pair", "times"],
        )

    counted = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(run, "pair int, times bigint")
        .groupBy("pair").agg(F.sum("times").alias("times"))
    )
    counts = np.zeros(FOLDED**2, dtype=np.int64)
    for row in counted.collect():
        counts[row["pair"]] = row["times"]
    return counts.reshape(FOLDED, FOLDED)


def thresholds(tests: list[tuple[int, int, int]], share: float = FALSE_SHARE) -> dict[int, int]:
    """Per stratum the last bin that is kept: findings below it have at most ``share`` false ones.

    ``tests`` has (stratum, bin, number). The rule is Benjamini and Hochberg's,
    with each probability rounded up to the top of its bin.
    """
    kept = {}
    strata: dict[int, list] = {}
    for stratum, number, n in tests:
        strata.setdefault(stratum, []).append((number, n))
    for stratum, bins in strata.items():
        total = sum(n for _, n in bins)
        below = 0
        for number, n in sorted(bins):
            below += n
            if bin_top(number) <= share * below / total:
                kept[stratum] = number
    return kept


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = FALSE_SHARE,
) -> DataFrame:
    """One row per document: doc_id, spans = array of (start, kind, end).

    Kinds are numbers into :data:`KINDS`; positions count code points, ends are
    exclusive. The first three kinds are the fixed patterns; ``random`` are the
    tokens of the battery that reach beyond each of their spans. Texts are read
    whole, twice: for the pair counts and for the scan. A null text is an
    empty one. Null and repeated ids are rows like others, an empty table gives
    an empty result, other columns are ignored.

    The driver sees counts per pair of symbols, and per stratum and bin. What is stored of a text
    are its spans and candidates.
    """
    pairs = count_pairs(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        battery = Battery(pairs)
        patterns = base_patterns()
        token = re.compile(TOKEN % LEAST_TOKEN)
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("is_doc", pa.bool_()),
                ("base", pa.list_(_struct("start kind end"))),
                ("tokens", pa.list_(_struct("start end stratum bin"))),
                ("tests", pa.list_(_struct("stratum bin n"))),
            ]
        )
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows, tests = _scan(batch, patterns, token, battery)
                rows.append(
                    {"doc_id": None, "is_doc": False, "base": [], "tokens": [], "tests": tests}
                )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(rows.mapInArrow(run, SCANNED), "spans")
    tests = (
        found.filter(~F.col("is_doc")).select(F.explode("tests").alias("t")).select("t.*")
        .groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    )
    kept = thresholds([tuple(r) for r in tests.collect()], share)
    last = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair]) if kept else None

    def keep(x):
        inside = F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        return (x["bin"] <= F.try_element_at(last, x["stratum"])) & ~inside

    random = F.transform(
        F.filter("tokens", keep) if kept else F.slice("tokens", 1, 0),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")
        ),
    )
    return found.filter("is_doc").select(
        "doc_id", F.array_sort(F.concat("base", random)).alias("spans")
    )


def _struct(names: str) -> pa.DataType:
    small = {"kind", "stratum", "bin"}
    return pa.struct([(n, pa.int32() if n in small else pa.int64()) for n in names.split()])


def _scan(batch, patterns, token, battery) -> tuple[list[dict], list[dict]]:
    """Rows of the documents of a batch, and its tests by stratum and bin."""
    rows, tokens, places = [], [], []
    for number, (doc_id, text) in enumerate(
        zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    ):
        text = text or ""
        base = base_spans(text, patterns)
        rows.append(
            {
                "doc_id": doc_id,
                "is_doc": True,
                "base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
                "tokens": [],
                "tests": [],
            }
        )
        for m in token.finditer(text):
            tokens.append(m[0].encode())
            places.append((number, m.start(), m.end()))
    if not tokens:
        return rows, []
    strata, p = battery.test(tokens)
    bins = probability_bins(p)
    tested, times = np.unique(np.stack([strata, bins]), axis=1, return_counts=True)
    tests = [
        {"stratum": int(s), "bin": int(b), "n": int(n)}
        for (s, b), n in zip(tested.T, times, strict=True)
    ]
    # The control keeps no probability above the share of false findings it allows.
    for i in np.flatnonzero(bins <= int(probability_bins(np.array([FALSE_SHARE * 10]))[0])):
        number, start, end = places[i]
        rows[number]["tokens"].append(
            {"start": start, "end": end, "stratum": int(strata[i]), "bin": int(bins[i])}
        )
    return rows, tests


def with_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def number(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda x: F.concat_ws(
                    ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]
                ),
            ),
            ",",
        )

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias(
            "base_sha256"
        ),
        listed(F.col("spans")).alias("spans"),
    )
