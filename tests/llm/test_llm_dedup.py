import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from citespark.llm import exact_dedup, ngram_join


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def by_brute_force(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    found = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, keep, len(ids), sha) for i in ids]
    return sorted(found, key=str)


def test_exact_dedup_of_odd_rows(odd, odd_rows):
    found = exact_dedup.exact_dedup(odd)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = found.collect()
    assert sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str
    ) == by_brute_force(odd_rows)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({normal(t) for _, t, *_ in odd_rows})


def test_repeated_rows_keep_one(spark):
    rows = [(3, "a b"), (3, "a  b"), (4, "a b"), (4, "c"), (4, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect() if r.kept]
    assert sorted(kept) == [(3, 3), (4, 2)]
    left = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((r.doc_id, normal(r.text)) for r in left) == [(3, "a b"), (4, "c")]


def test_texts_under_one_digest_stay_apart(odd, odd_rows):
    for limit in (exact_dedup.BROADCAST_KEYS, 0):
        found = exact_dedup.exact_dedup(
            odd, digest=lambda n: F.lit(b"same"), broadcast_keys=limit
        ).collect()
        assert sorted(
            ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str
        ) == by_brute_force(odd_rows)


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).columns == none.columns


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = {}
    edges = [
        (rows[i][0], rows[j][0])
        for i in range(len(rows))
        for j in range(i)
        if rows[i][0] is not None
        and rows[j][0] is not None
        and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0
    ]
    label = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted(((r[0], len(s), label[r[0]]) for r, s in zip(rows, sets)), key=str)


def test_jaccard_components(spark, prose_rows):
    docs = spark.createDataFrame(prose_rows, "doc_id bigint, text string, l string, s string, n int")
    found = ngram_join.jaccard_components(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == components(prose_rows)


def test_frequent_shingles_change_no_result(spark, prose_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    docs = spark.createDataFrame(prose_rows, "doc_id bigint, text string, l string, s string, n int")
    found = ngram_join.jaccard_components(docs, max_frequent=50).collect()
    assert sorted((tuple(r) for r in found), key=str) == components(prose_rows)


def test_small_blocks_and_boxes_change_no_result(spark, prose_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    docs = spark.createDataFrame(prose_rows, "doc_id bigint, text string, l string, s string, n int")
    found = ngram_join.jaccard_components(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == components(prose_rows)


def near_misses():
    """Texts of one base with edits, so that many pairs lie on both sides of the threshold."""
    draw = random.Random(31)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for number in range(70):
        text = list(base)
        for at in draw.sample(range(200), draw.choice([1, 2, 3, 5])):
            text[at] = f"x{number}_{at}"
        rows.append((number * 3, " ".join(text), "en", "s", 0))
    # Far from the base, alike in pairs.
    for number in range(20):
        text = list(base)
        for at in range(0, 200, 9):
            text[at] = f"y{number // 2}_{at}"
        rows.append((1_000 - number, " ".join([*text, f"z{number}"]), "en", "s", 0))
    return rows


def test_near_misses_of_one_text(spark, monkeypatch):
    rows = near_misses()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, l string, s string, n int")
    expected = components(rows)
    assert len({c for _, _, c in expected}) > 10
    for block, leaf in ((1_024, 16), (20, 4)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "LEAF", leaf)
        found = ngram_join.jaccard_components(docs).collect()
        assert sorted((tuple(r) for r in found), key=str) == expected


def test_repeated_ids_with_other_texts(spark):
    rows = near_misses()
    again = [(rows[0][0], *rows[1][1:])] * 5 + rows
    docs = spark.createDataFrame(again, "doc_id bigint, text string, l string, s string, n int")
    found = ngram_join.jaccard_components(docs).collect()
    assert len(found) == len(again)
    assert {r.component_id for r in found if r.doc_id in (rows[0][0], rows[1][0])} == {0}


def test_tree_finds_all_that_the_bound_allows():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64)) for n in draw.integers(1, 900, 60)]
    for _ in range(140):
        near = sets[draw.integers(0, 60)]
        near = near[draw.random(len(near)) < draw.choice([0.8, 0.9, 1.0])]
        sets.append(near if len(near) else sets[0])
    sizes = np.array([len(x) for x in sets])
    component = draw.integers(0, 30, len(sets))
    points = np.stack([ngram_join.group_counts(x) for x in sets])
    for leaf in (2, 16, 300):
        tree = ngram_join.CountTree(points, sizes, component, leaf)
        q, r = tree.partners(points, sizes, component, 80)
        i, j = np.nonzero(component[:, None] != component[None, :])
        like = 100 * np.minimum(sizes[i], sizes[j]) >= 80 * np.maximum(sizes[i], sizes[j])
        like &= ngram_join.allowed(points[i], sizes[i], points[j], sizes[j], 80)
        assert set(zip(q, r)) == set(zip(i[like], j[like])) and like.sum() > 20


def test_pairs_are_verified_on_their_sets():
    sets = [np.arange(10), np.arange(9), np.arange(5, 15), np.arange(11)]
    n = np.array([len(x) for x in sets])
    flags = np.zeros(15, dtype=np.uint8)
    i, j = ngram_join.verified(
        np.array([3, 0, 0, 1]), np.array([0, 1, 2, 2]), n, sets, flags, 80
    )
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (3, 0)]
    none = np.zeros(0, dtype=np.int64)
    for i, j in ((none, none), (np.array([0]), np.array([2]))):
        i, j = ngram_join.verified(i, j, n, sets, flags, 95)
        assert len(i) == len(j) == 0


def test_a_forest_connects_the_same():
    draw = np.random.default_rng(6)
    for nodes, edges in ((1, 0), (50, 20), (200, 150), (300, 5_000)):
        i, j = draw.integers(0, nodes, (2, edges))
        kept = ngram_join.forest(i, j, nodes)
        def label(pairs):
            name = list(range(nodes))
            for _ in range(nodes):
                before = list(name)
                for a, b in pairs:
                    name[a] = name[b] = min(name[a], name[b])
                if name == before:
                    return name
            return name

        every = label(list(zip(i.tolist(), j.tolist())))
        assert label(list(zip(i[kept].tolist(), j[kept].tolist()))) == every
        assert len(kept) == nodes - len(set(every))


def test_jaccard_of_odd_rows(odd, odd_rows):
    found = ngram_join.jaccard_components(odd).collect()
    assert sorted((tuple(r) for r in found), key=str) == components(odd_rows)


def test_jaccard_of_nothing(none):
    assert ngram_join.jaccard_components(none).count() == 0
