import heapq
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.llm import embedding_dedup, sharding, source_mix, staging, url_filter


def test_sainte_lague_takes_the_highest_quotients():
    draw = np.random.default_rng(1)
    for _ in range(60):
        n = int(draw.integers(1, 8))
        weights = [float(w) for w in draw.integers(0, 50, n)]
        caps = [int(c) for c in draw.integers(0, 30, n)]
        seats = int(draw.integers(0, 120))
        given, heap = [0] * n, []
        for i, (w, c) in enumerate(zip(weights, caps, strict=True)):
            if w > 0 and c > 0:
                heapq.heappush(heap, (-w, i))
        for _ in range(seats):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            given[i] += 1
            if given[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
        assert source_mix.sainte_lague(weights, caps, seats) == given


def test_water_fill():
    assert source_mix.water_fill([10, 100], [5, 2]) == [30.0, 80.0]
    assert source_mix.water_fill([50, 50], [1, 1]) == [50.0, 50.0]
    assert source_mix.water_fill([0, 0], [5, 2]) == [0.0, 0.0]
    assert source_mix.water_fill([], []) == []


def test_mix_comes_near_its_targets(documents):
    rows = source_mix.mix_sources(documents).collect()
    assert sorted(tuple(r) for r in source_mix.mix_sources(documents).collect()) == sorted(
        tuple(r) for r in rows
    )
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    taken, target = {}, {}
    sources = {r.doc_id: r.source for r in documents.collect()}
    for r in rows:
        s = sources[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2 * source_mix.BLOCK_WORDS, 0.02 * target[s]), s
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))


def test_mix_of_odd_rows(odd, odd_rows, none):
    rows = source_mix.mix_sources(odd).collect()
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").split())) for i, t, *_ in odd_rows if i is not None
    )
    assert all(r.taken <= 3 * r.size for r in rows)
    repeated = source_mix.mixed_documents(odd)
    assert repeated.columns == odd.columns
    assert repeated.filter("text IS NULL").count() == 0
    assert source_mix.mix_sources(none).count() == 0
    assert source_mix.mixed_documents(none).count() == 0


def test_shards_are_even_and_keep_copies_together(spark, prose_rows):
    rows = [(i, t) for i, t, *_ in prose_rows]
    rows += [(1000 + i, f"own text {i} " * (i % 7)) for i in range(800)]
    rows += [(5000 + i, "a copy of many") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sharding.shard_documents(docs, shards=8).collect()
    assert len(found) == len(rows)
    texts, sizes, slots, homes = dict(rows), [0] * 8, {}, {}
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes")
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(raw, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) <= 1.05 * sum(sizes) / 8
    # The group of a quarter of all bytes is larger than a shard, so it is split.
    assert [k for k, v in homes.items() if len(v) > 1] in ([], [b"a copy of many"])


def test_shards_of_odd_rows(odd, odd_rows, none):
    found = sharding.shard_documents(odd, shards=4).collect()
    assert len(found) == len(odd_rows)
    assert {r.size for r in found if r.doc_id in (1, 2)} == {16}
    assert all(r.grown_shard is None for r in found)
    assert sharding.shard_documents(none).count() == 0


def brute_links(rows, least=0.93):
    units = {}
    for i, (_, vector, label) in enumerate(rows):
        if label is None or vector is None or not vector or any(x is None for x in vector):
            continue
        v = np.array(vector, dtype=np.float64)
        if np.isfinite(v).all() and np.abs(v).max() > 0:
            units[i] = v / np.linalg.norm(v)
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in units:
        for j in units:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] >= least:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((r[0], links[i], rows[find(i)][0]) for i, r in enumerate(rows))


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(3)
    rows = []
    for group in range(30):
        centre = draw.standard_normal(24)
        for _ in range(int(draw.choice([1, 2, 5, 40]))):
            near = centre + draw.standard_normal(24) * draw.choice([0.0, 0.02, 0.05])
            rows.append([float(x) for x in near.astype(np.float32)])
    rows = [(i, v, int(i % 2)) for i, v in enumerate(rows)]
    rows += [(10_000 + i, v, k) for i, (v, k) in enumerate([
        (None, 1), ([0.0] * 24, 1), ([float("nan")] * 24, 1), ([float("inf")] * 24, 1),
        (rows[0][1], None), ([1.0, None], 1), ([], 1), ([1.0, 0.0], 1), ([2.0, 0.0], 1),
        ([1e30] * 24, 0), ([1e-30] * 24, 0),
    ])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = embedding_dedup.near_duplicates(docs.withColumn("n", F.lit(1))).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    wanted = brute_links(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in found)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert all(g[1] <= w[1] for g, w in zip(got, wanted, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in wanted)
    assert sum(g[2] == w[2] for g, w in zip(got, wanted, strict=True)) >= 0.97 * len(wanted)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


URLS = [
    ("http://A.Example.com/en/1?x=/fr/", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("x://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://example.com", "example.com", "", None, None),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/de/1?a://b", "x.net", "/de/1", None, None),
    ("no scheme", "", "", None, None),
    ("http://É.net/fr/\n2", "É.net", "/fr/\n2", "net/fr/", "block"),
    (None, "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u[0]) for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://y.net/shop/{i}/item{i}/view") for i in range(40)]
    rows += [(200 + i, f"http://y.net/fr/{i}/" + "a/" * 12) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages.selectExpr("*", "1 AS host", "2 AS n")).collect()}
    assert len(found) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert len({found[100 + i].template for i in range(40)}) == 1
    assert all(found[200 + i].template.endswith("/**") for i in range(10))


def test_a_template_of_blocked_pages_is_rejected(spark):
    """Pages that no rule covers share a template with blocked ones."""
    rows = [(i, f"http://h.org/p{chr(97 + i % 26)}{i}x{i}/k") for i in range(60)]
    rules = [("h.org", f"/p{chr(97 + i % 26)}{i}x", "block") for i in range(50)]
    rows += [(1000 + i, f"http://g.org/p{i}") for i in range(60)]
    rules += [("g.org", "/", "allow")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, rules=tuple(rules)).collect()}
    assert all(found[i].rule is None and found[i].verdict == "block" for i in range(50, 60))
    assert all(found[1000 + i].verdict == "allow" for i in range(60))


def slow_purity(urls, rules, table):
    """Purity of every url, walking down one host's tree at a time in plain Python."""
    import re
    from collections import defaultdict

    def label(host, path):
        fits = [
            (len(h + p), verdict) for h, p, verdict in rules
            if (host == h or host.endswith(f".{h}")) and path.startswith(p)
        ]
        return max(fits)[1] if fits else None

    pages = []
    for url in urls:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        pages.append((host, [x for x in path.split("/") if x], label(host, path), url))
    labels = [x for _, _, x, _ in pages if x]
    found = {}

    def grow(node, level, above):
        labelled = [x for _, _, x, _ in node if x]
        here = (labelled.count("block") + 4.0 * above) / (len(labelled) + 4.0)
        branches = defaultdict(list)
        for page in node:
            if 0 < len(labelled) < len(node) and len(page[1]) > level:
                branches[re.sub("[0-9]+", "{n}", page[1][level])].append(page)
            else:
                found[page[3]] = here
        inner = [x for b in branches.values() for _, _, x, _ in b if x]
        rate = (inner.count("block") + 1.0) / (len(inner) + 2.0)
        n_pages = sum(map(len, branches.values()))
        kinds = defaultdict(list)
        for name, branch in branches.items():
            own = [x for _, _, x, _ in branch if x]
            usual = len(own) * rate
            off = own.count("block") - usual
            if len(branches) > url_filter.MANY and len(branches) > n_pages * url_filter.PER_PAGE:
                kind = "*"
            elif not own:
                kind = "unlabelled"
            elif off * off <= url_filter.DIFFERS * usual * (1 - rate):
                kind = "usual"
            else:
                kind = "blocked" if off > 0 else "allowed"
            kinds[kind] += branch
        for branch in kinds.values():
            grow(branch, level + 1, here)

    hosts = defaultdict(list)
    for page in pages:
        hosts[page[0]].append(page)
    for node in hosts.values():
        grow(node, 0, (labels.count("block") + 1.0) / (len(labels) + 2.0))
    return found


def test_purity_equals_a_walk_in_python(spark):
    import random

    draw = random.Random(8)
    urls, rules = set(), [("b.org", "/s1/", "block"), ("b.org", "/s2/t1/", "allow")]
    rules += [("d.org", f"/x{i}y/", draw.choice(["allow", "block"])) for i in range(30)]
    for _ in range(600):
        host = draw.choice(["a.org", "b.org", "www.b.org", "c.net", "d.org"])
        first = f"x{draw.randrange(60)}y" if host == "d.org" else f"s{draw.randrange(4)}"
        deep = [f"t{draw.choice('abc')}{draw.randrange(3)}" for _ in range(draw.randrange(9))]
        urls.add(f"http://{host}/" + "/".join([first, *deep]) + draw.choice(["", "/", "?q=1"]))
    rules += [("b.org", "/s3/ta1/tb", "block")]
    rows = list(enumerate(sorted(urls)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = url_filter.filter_urls(pages, rules=tuple(rules)).collect()
    want = slow_purity(sorted(urls), rules, rows)
    assert len(found) == len(rows)
    assert {r.page_id: round(r.purity, 9) for r in found} == {
        i: round(want[u], 9) for i, u in rows
    }


def test_the_contract_rules_tell_unruled_pages_apart(spark):
    """Pages without a rule take the purity of their host where that has ruled pages."""
    urls = [f"http://n.net/es/{i}" for i in range(30)] + [f"http://n.net/en/{i}" for i in range(5)]
    urls += [f"http://c.com/{i}" for i in range(20)] + ["http://o.org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert all(found[30 + i].rule is None and found[30 + i].verdict == "block" for i in range(5))
    assert found[55].verdict == "allow" and found[55].purity < found[30].purity


def test_paths_differ_beyond_six_segments(spark):
    deep = "/a/b/c/d/e/f/g"
    urls = [f"http://h.org{deep}/bad/{i}" for i in range(40)]
    urls += [f"http://h.org{deep}/good/{i}" for i in range(40)]
    rules = [("h.org", f"{deep}/bad/{i}", "block") for i in range(10, 40)]
    rules += [("h.org", f"{deep}/good/{i}", "allow") for i in range(10, 40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, rules=tuple(rules)).collect()}
    assert all(found[i].verdict == "block" and found[i].rule is None for i in range(1))
    assert all(found[40 + i].verdict == "allow" and found[40 + i].rule is None for i in range(1))


def test_no_urls(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = staging.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    wanted = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert {r.node: r.component for r in found.collect()} == wanted


def test_a_shard_of_as_many_blocks_as_the_factor_meets_its_quota(spark):
    """Blocks of one word: the first source has one shard of 48,271 blocks."""
    rows = [(1, source_mix.FACTOR, "a"), (2, 10 * source_mix.FACTOR, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, n int, source string")
    docs = docs.selectExpr("doc_id", "repeat('w ', n) AS text", "source")
    # Of 11 parts, "a" is to have 11 / 7.5.
    found = {r.doc_id: r for r in source_mix.mix_sources(docs, weights=(1.0, 6.5), block_words=1).collect()}
    assert abs(found[1].taken - found[1].target) <= 1
    assert abs(found[2].taken - found[2].target) <= 1
