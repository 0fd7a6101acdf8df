"""Importance resampling against features counted one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from citespark.llm import importance

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % 10_000 for run in runs]


def slow_sample(docs, target):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    features = [(i, *slow_features(text)) for i, text in docs]
    s, t = Counter(), Counter()
    for _, _, buckets in features:
        s.update(buckets)
    for text in target:
        t.update(slow_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
        for b in range(10_000)
    ]
    rows = []
    for i, n_words, buckets in features:
        key = f"42:{'' if i is None else i}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        noisy = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n_words, len(buckets), weight, noisy))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): place + 1 for place, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((r[0], *r[2:], drawn.get(id(r))) for r in rows), key=str)


def found_rows(found):
    return sorted(map(tuple, found.drop("n_words").collect()), key=str)


@pytest.fixture
def prose():
    draw = random.Random(6)
    words = ["the", "cat", "Ünder", "x1", "été", "SAT", "日本", "w" * 70, "z" * 300]
    words += [f"v{i}" for i in range(50)]

    def text(n):
        return "".join(draw.choice(words) + draw.choice([" ", ", ", ".\n", "-"]) for _ in range(n))

    docs = [(i, text(draw.choice([3, 19, 20, 21, 60]))) for i in range(150)]
    return docs, [text(40) for _ in range(20)]


def test_equals_brute_force(spark, prose):
    docs, target = prose
    more = [f"'x' AS {n}" for n in ("n", "score", "rank", "uid", "tie", "n_words", "place")]
    found = importance.importance_sample(
        spark.createDataFrame(docs, DOCS).selectExpr("*", *more),
        spark.createDataFrame([(t,) for t in target], "text string"),
    )
    assert found_rows(found) == slow_sample(docs, target)


def test_odd_rows(spark, odd, odd_rows, none):
    target = spark.createDataFrame([("lorem ipsum",), (None,), ("",)], "text string")
    found = importance.importance_sample(odd, target)
    want = slow_sample([(r[0], r[1]) for r in odd_rows], ["lorem ipsum", None, ""])
    assert found_rows(found) == want
    assert importance.importance_sample(none, target).count() == 0
    without = importance.importance_sample(odd, none)
    assert found_rows(without) == slow_sample([(r[0], r[1]) for r in odd_rows], [])


def test_ties_and_copies_of_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(i, text) for i in range(100)] + [(7, text)] * 100
    found = importance.importance_sample(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "text string")
    )
    assert found_rows(found) == slow_sample(docs, [])


def test_lists_do_not_change_sums(prose):
    docs, _ = prose
    texts = [importance.words_of(text.encode()) for _, text in docs]
    words = sorted({w for t in texts for w in t})
    pairs = sorted({p for t in texts for p in zip(t, t[1:])})
    plain, _ = importance.Vocabulary([], []).runs(texts)
    for vocabulary in (
        importance.Vocabulary(words, pairs),
        importance.Vocabulary(words[::2], pairs[::3]),
    ):
        sums, owner = vocabulary.runs(texts)
        assert (sums == plain).all()
    runs = [
        b" ".join(t[i : i + n]) for n in (1, 2, 3) for t in texts for i in range(len(t) - n + 1)
    ]
    assert sorted(sums.tolist()) == sorted(map(zlib.crc32, runs))
    assert len(owner) == len(sums)


def test_moving_sums_over_any_length():
    mover = importance.Mover()
    for n in (0, 1, 63, 64, 65, 1_000, 70_000):
        state = np.array([zlib.crc32(b"head")], dtype=np.uint32)
        tail = b"t" * n
        moved = mover.move(state, np.array([n])) ^ np.uint32(zlib.crc32(tail))
        assert int(moved[0]) == zlib.crc32(b"head" + tail)


def test_counters_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(importance, "COUNTERS", 50)
    texts = [(None, " ".join(["often"] * 30 + [f"w{k}x{i}" for i in range(40)])) for k in range(60)]
    vocabulary = importance.frequent(spark.createDataFrame(texts, DOCS))
    assert b"often" in vocabulary.number
