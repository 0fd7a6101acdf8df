"""Jaccard self-join of documents on word shingles, by count vectors.

Shingles are hashed, and the hashes of a document are counted in groups. The
counts are a point; two documents share at most the sum of the coordinate-wise
minima of their points. The bound is used at three resolutions:

* Finest, a group per hash value. Points with a common part of the required
  size meet in one of their first coordinates (rarest first), so documents are
  routed to those and compared nowhere else.
* Coarse, 256 groups. Inside a route a tree of boxes over these points (its
  nodes keep the largest counts below them) finds the partners that the bound
  allows. Of these pairs only a spanning forest leaves the task: it tells which
  documents belong to one cluster of candidates.
* Middle, about a group per four shingles. Each cluster meets once with its full
  sets, in blocks; a tree over these points finds the pairs, which are verified
  there, and again only a spanning forest of the links leaves the task.

So no table holds more pairs than there are documents in routes, however many
pairs a group of near copies has. Documents that are linked already, or have
equal sets, are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import (
    components,
    group_bounds,
    join_counted,
    stored,
    whole_groups,
)

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
GROUPS = 256
GROUP_BITS = 8
#: Counts are kept up to this one, which stands for any larger.
MOST = 65_535
#: Bytes hashed at once; a longer document is hashed alone.
CHUNK = 1 << 20
#: Shingles that are counted together to find frequent ones, and the count that makes one.
COUNTED, FREQUENT = 4_000_000, 4
#: Frequent shingles that documents are routed by last. Their choice changes no result.
MAX_FREQUENT = 1 << 18
#: Documents of a route that one group holds; more are compared in pairs of blocks.
BLOCK = 1_024
LEAF = 16
#: Pairs and sets whose ids may be broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Partners of a document that are compared with one copy of its set.
PARTNERS = 256
#: Shingles of a cluster that one block holds, on average; and the most bits of a group's number.
BLOCK_SHINGLES = 1 << 21
MOST_BITS = 14

U = np.uint64


class Shingles:
    """Distinct shingle hashes of texts, sorted."""

    def __init__(self, words: int = WORDS):
        draw = np.random.default_rng(20_250_101)
        self.words = words
        self.letters = draw.integers(0, 1 << 64, 256, dtype=np.uint64)
        # A-Z as a-z; other bytes of UTF-8 are never in that range.
        self.letters[65:91] = self.letters[97:123]
        self.factors = draw.integers(0, 1 << 63, 8 * words, dtype=np.uint64) | U(1)
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = U(0x5851F42D4C957F2D)  # 5 modulo 8
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self._grow(CHUNK)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(
                np.concatenate([[U(1)], np.full(size, self.base, dtype=np.uint64)])
            )
            self.inverses = np.multiply.accumulate(
                np.concatenate([[U(1)], np.full(size, self.inverse, dtype=np.uint64)])
            )

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """One sorted set per text, in order; a null text has an empty one."""
        n = len(column)
        if n == 0:
            return
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        offsets = offsets[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
            end = min(max(end, at + 1), n)
            bounds = offsets[at : end + 1] - offsets[at]
            yield from self._chunk(data[offsets[at] : offsets[end]], bounds)
            at = end

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        docs = len(bounds) - 1
        if len(data) >= len(self.powers):
            self._grow(len(data))
        letter = ~self.space[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = letter[:-1]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        starts = np.flatnonzero(letter & (~before | edge[:-1]))
        ends = np.flatnonzero(before & (~letter | edge[:-1]))
        if len(data) and letter[-1]:
            ends = np.append(ends, len(data))
        with np.errstate(over="ignore"):
            summed = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.letters[data] * self.powers[: len(data)], out=summed[1:])
            word = (summed[ends] - summed[starts]) * self.inverses[starts]
            word = mixed(word + (ends - starts).astype(np.uint64))
            first = np.searchsorted(starts, bounds)
            count = np.diff(first)
            shingle = np.zeros(max(0, len(word) - self.words + 1), dtype=np.uint64)
            for i in range(self.words):
                shingle += word[i : i + len(shingle)] * self.factors[i]
            shingle = mixed(shingle)
        for doc in range(docs):
            a, b = int(first[doc]), int(first[doc + 1])
            if b - a >= self.words:
                found = np.sort(shingle[a : b - self.words + 1])
                keep = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                # Fewer words are one shingle of their own kind.
                with np.errstate(over="ignore"):
                    short = (word[a:b] * self.factors[self.words : self.words + b - a]).sum()
                    short = np.array([short + U(b - a)], dtype=np.uint64)
                yield mixed(short)
            else:
                yield np.zeros(0, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def needed(n, percent: int = PERCENT):
    """Shingles that a document of n must share with any partner."""
    return (percent * n + 99) // 100


def group_counts(shingles: np.ndarray, bits: int = GROUP_BITS) -> np.ndarray:
    counts = np.bincount((shingles >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, MOST).astype("<u2")


def points_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Stored points, one row each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u2").reshape(-1, GROUPS)


class Rare:
    """Orders a set for routing: ascending, frequent shingles last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.frequent >> U(44)).astype(np.int64)] = True

    def first(self, shingles: np.ndarray, count: int) -> np.ndarray:
        suspects = np.flatnonzero(self.maybe[(shingles >> U(44)).astype(np.int64)])
        if not len(suspects):
            return shingles[:count]
        at = np.searchsorted(self.frequent, shingles[suspects])
        at = np.minimum(at, len(self.frequent) - 1)
        suspects = suspects[self.frequent[at] == shingles[suspects]]
        if not len(suspects):
            return shingles[:count]
        often = np.zeros(len(shingles), dtype=bool)
        often[suspects] = True
        return np.concatenate([shingles[~often], shingles[often]])[:count]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its number of shingles, set digest and point; and frequent shingles."""
    shingles = Shingles()
    held, size = [], 0
    names = ["doc_id", "n", "high", "low", "point", "shingle", "times"]

    def frequent() -> pa.RecordBatch:
        every = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
        starts, ends = group_bounds([every])
        some = ends - starts >= FREQUENT
        values, times = every[starts[some]], (ends - starts)[some]
        n = len(values)
        return pa.record_batch(
            [
                *[pa.nulls(n, pa.int64())] * 4,
                pa.nulls(n, pa.binary()),
                pa.array(values.view(np.int64), pa.int64()),
                pa.array(times, pa.int64()),
            ],
            names=names,
        )

    for batch in batches:
        counts, high, low, points = [], [], [], []
        for found in shingles.of_column(batch.column(1)):
            counts.append(len(found))
            with np.errstate(over="ignore"):
                high.append(int(mixed(found + U(1)).sum(dtype=np.uint64).view(np.int64)))
                low.append(int(mixed(found ^ U(0x5A5A5A5A5A5A5A5A)).sum(dtype=np.uint64).view(np.int64)))
            points.append(group_counts(found).tobytes())
            held.append(found)
            size += len(found)
            if size >= COUNTED:
                yield frequent()
                held, size = [], 0
        n = batch.num_rows
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array(low, pa.int64()),
                pa.array(points, pa.binary()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
            ],
            names=names,
        )
    yield frequent()


def _routes(frequent: np.ndarray, percent: int):
    """Rows (shingle, doc_id, n) of the coordinates that a document is routed to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rare = Shingles(), Rare(frequent)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, docs, sizes = [], [], []
            for doc_id, found in zip(
                batch.column(0).to_pylist(), shingles.of_column(batch.column(1)), strict=True
            ):
                n = len(found)
                if n == 0 or doc_id is None:
                    continue
                # A copy in the same task adds nothing: it is found by its digest.
                same = found[:: max(1, n // 4)].tobytes() + mixed(found).sum().tobytes()
                if same in seen:
                    continue
                seen.add(same)
                part = rare.first(found, n - needed(n, percent) + 1)
                tokens.append(part)
                docs.append(np.full(len(part), doc_id, dtype=np.int64))
                sizes.append(np.full(len(part), n, dtype=np.int64))
            if tokens:
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(docs)),
                        pa.array(np.concatenate(sizes).astype(np.int32)),
                    ],
                    names=["shingle", "doc_id", "n"],
                )

    return run


def _stars(percent: int):
    """From rows sorted by (shingle, n, doc_id): pairs with the first document of a route.

    Routes of three and more are passed on too (``a`` null, ``shingle`` set);
    their other pairs are looked at when it is known what these pairs link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def pairs() -> pa.RecordBatch:
            every = np.concatenate(held, axis=1) if held else np.zeros((2, 0), dtype=np.int64)
            every = every[:, np.lexsort(every)]
            starts, _ = group_bounds([every[0], every[1]])
            n = len(starts)
            return pa.record_batch(
                [
                    pa.array(every[0][starts], pa.int64()),
                    pa.array(every[1][starts], pa.int64()),
                    pa.nulls(n, pa.int64()),
                ],
                names=["a", "b", "shingle"],
            )

        for table in whole_groups(batches, ["shingle"]):
            shingle = table["shingle"].to_numpy()
            doc, n = table["doc_id"].to_numpy(), table["n"].to_numpy().astype(np.int64)
            starts, ends = group_bounds([shingle])
            sizes = ends - starts
            first = np.repeat(starts, sizes)
            near = (doc != doc[first]) & (100 * n[first] >= percent * n)
            held.append(
                np.stack([np.minimum(doc, doc[first])[near], np.maximum(doc, doc[first])[near]])
            )
            size += int(near.sum())
            if size >= 1_000_000:
                yield pairs()
                held, size = [], 0
            many = np.repeat(sizes >= 3, sizes)
            if many.any():
                yield pa.record_batch(
                    [
                        pa.nulls(int(many.sum()), pa.int64()),
                        pa.array(doc[many], pa.int64()),
                        pa.array(shingle[many], pa.int64()),
                    ],
                    names=["a", "b", "shingle"],
                )
        yield pairs()

    return run


class CountTree:
    """Points in boxes and boxes of boxes: each has the largest counts and the sizes below it.

    Rows of the same ``component`` are no partners; a box knows whether all its
    rows are of one.
    """

    def __init__(
        self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, leaf: int | None = None
    ):
        # Slabs of similar size, in a slab by the coordinate that varies most.
        widest = int(points.var(axis=0).argmax()) if len(points) else 0
        slab = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.12)).astype(np.int64)
        self.order = np.lexsort((points[:, widest], slab))
        self.leaf = leaf or LEAF
        part = self.order
        # From the rows up: largest counts, smallest and largest size, lowest and highest component.
        self.levels = [(points[part], sizes[part], sizes[part], component[part], component[part])]
        while len(self.levels[-1][0]) > self.leaf:
            most, least, largest, low, high = self.levels[-1]
            cuts = np.arange(0, len(most), self.leaf)
            self.levels.append((
                np.maximum.reduceat(most, cuts, axis=0),
                np.minimum.reduceat(least, cuts),
                np.maximum.reduceat(largest, cuts),
                np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts),
            ))

    def partners(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int):
        """Pairs (query, row) that the bound allows, sizes, minima and components considered."""
        found_q, found_r = [], []
        for at in range(0, len(points), 1_024):
            n = min(1_024, len(points) - at)
            nodes = len(self.levels[-1][0])
            query, node = np.repeat(np.arange(at, at + n), nodes), np.tile(np.arange(nodes), n)
            for depth in range(len(self.levels) - 1, -1, -1):
                query, node = self._kept(depth, query, node, points, sizes, component, percent)
                if depth:
                    below = len(self.levels[depth - 1][0])
                    node = (node[:, None] * self.leaf + np.arange(self.leaf)[None, :]).ravel()
                    query = np.repeat(query, self.leaf)
                    query, node = query[node < below], node[node < below]
            found_q.append(query)
            found_r.append(self.order[node])
        return np.concatenate(found_q), np.concatenate(found_r)

    def _kept(self, depth, query, node, points, sizes, component, percent):
        most, least, largest, low, high = self.levels[depth]
        n = sizes[query]
        keep = (low[node] != component[query]) | (high[node] != component[query])
        keep &= 100 * np.minimum(n, largest[node]) >= percent * np.maximum(n, least[node])
        query, node = query[keep], node[keep]
        step = max(1, (1 << 23) // max(1, points.shape[1]))
        kept = [np.zeros(0, dtype=bool)]
        for at in range(0, len(query), step):
            q, r = query[at : at + step], node[at : at + step]
            kept.append(allowed(points[q], sizes[q], most[r], least[r], percent))
        keep = np.concatenate(kept)
        return query[keep], node[keep]


def allowed(p, n, q, m, percent: int) -> np.ndarray:
    return (100 + percent) * shared_most(p, q) >= percent * (n + m)


def shared_most(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The most that two sets can share: the summed minima of their points."""
    least = np.minimum(p, q)
    total = least.sum(axis=-1, dtype=np.int64)
    return np.where((least == MOST).any(axis=-1), np.iinfo(np.int32).max, total)


def _bounded(percent: int):
    """Of pairs with sizes and points of both: those that the bound allows, and how alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
                shared = shared_most(points_of(batch["p"]), points_of(batch["q"]))
                keep = pa.array((100 + percent) * shared >= percent * (n + m))
                yield pa.record_batch(
                    [batch["a"].filter(keep), batch["b"].filter(keep),
                     pa.array(shared / (n + m), pa.float64()).filter(keep)],
                    names=["a", "b", "likeness"],
                )

    return run


def forest(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """Which pairs connect of ``nodes`` nodes all that the pairs (i, j) connect: less than ``nodes``."""
    label = np.arange(nodes)
    pair, kept = np.arange(len(i)), [np.zeros(0, dtype=np.int64)]
    while True:
        a, b = label[i[pair]], label[j[pair]]
        apart = a != b
        pair, a, b = pair[apart], a[apart], b[apart]
        if not len(pair):
            return np.concatenate(kept)
        # Each tree with a neighbour of a smaller name joins the smallest of these.
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        chosen = order[group_bounds([high[order]])[0]]
        kept.append(pair[chosen])
        above = np.arange(nodes)
        above[high[chosen]] = low[chosen]
        while True:
            further = above[above]
            if (further == above).all():
                break
            above = further
        label = above[label]


def _pairs_of(rep: np.ndarray, left: list, right: list) -> pa.RecordBatch:
    """A spanning forest of the pairs of rows, as pairs of ids."""
    i = np.concatenate([np.zeros(0, dtype=np.int64), *left])
    j = np.concatenate([np.zeros(0, dtype=np.int64), *right])
    ids, node = np.unique(rep, return_inverse=True)
    kept = forest(node[i], node[j], len(ids))
    x, y = rep[i[kept]], rep[j[kept]]
    return pa.record_batch(
        [pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())],
        names=["a", "b"],
    )


def _in_small(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the groups of at most :data:`LEAF` rows, by their distance."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[group] <= LEAF
    for apart in range(1, LEAF):
        i = np.flatnonzero(small[:-apart] & (group[:-apart] == group[apart:]))
        if not len(i):
            return
        yield i, i + apart


def _candidates(percent: int):
    """What the pairs of different components that the bound allows connect, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"]):
            table = table.combine_chunks()
            rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
            component, block = table["component"].to_numpy(), table["block"].to_numpy()
            same = table["same"].to_numpy()
            points = points_of(table["point"])
            starts, ends = group_bounds([table["task"].to_numpy()])
            sizes = ends - starts
            left, right = [], []
            for i, j in _in_small(sizes):
                i, j = _open(i, j, component, block, same)
                keep = allowed(points[i], n[i], points[j], n[j], percent)
                left.append(i[keep])
                right.append(j[keep])
            for a, b in zip(starts[sizes > LEAF].tolist(), ends[sizes > LEAF].tolist(), strict=True):
                at = slice(a, b)
                tree = CountTree(points[at], n[at], component[at])
                i, j = tree.partners(points[at], n[at], component[at], percent)
                i, j = _open(i[i < j] + a, j[i < j] + a, component, block, same)
                kept = forest(i - a, j - a, b - a)
                left.append(i[kept])
                right.append(j[kept])
            yield _pairs_of(rep, left, right)

    return run


def _linked(percent: int):
    """What the links between different components of each group connect, as a forest.

    Rows hold full sets and are sorted by task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"]):
            table = table.combine_chunks()
            rep, component = table["rep"].to_numpy(), table["component"].to_numpy()
            block, same = table["block"].to_numpy(), table["same"].to_numpy()
            raw = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["set"]]
            n = np.array([len(x) for x in raw], dtype=np.int64)
            # Small numbers stand for the shingles of these rows.
            names, number = np.unique(np.concatenate(raw), return_inverse=True)
            numbers = np.split(number, np.cumsum(n)[:-1])
            flags = np.zeros(len(names), dtype=np.uint8)
            starts, ends = group_bounds([table["task"].to_numpy()])
            sizes = ends - starts
            left, right = [], []
            for i, j in _in_small(sizes):
                i, j = _open(i, j, component, block, same)
                i, j = verified(i, j, n, numbers, flags, percent)
                left.append(i)
                right.append(j)
            for a, b in zip(starts[sizes > LEAF].tolist(), ends[sizes > LEAF].tolist(), strict=True):
                at = slice(a, b)
                bits = int(np.clip(np.ceil(np.log2(n[at].max() / 4)), GROUP_BITS, MOST_BITS))
                points = np.stack([group_counts(x, bits) for x in raw[at]])
                tree = CountTree(points, n[at], component[at])
                i, j = tree.partners(points, n[at], component[at], percent)
                i, j = _open(i[i < j] + a, j[i < j] + a, component, block, same)
                i, j = verified(i, j, n, numbers, flags, percent)
                kept = forest(i - a, j - a, b - a)
                left.append(i[kept])
                right.append(j[kept])
            yield _pairs_of(rep, left, right)

    return run


def verified(i, j, n, numbers: list[np.ndarray], flags: np.ndarray, percent: int):
    """The pairs of rows (i, j) whose sets are alike enough."""
    keep = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    if not keep.any():
        return i[keep], j[keep]
    i, j = i[keep], j[keep]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    alike = np.zeros(len(i), dtype=bool)
    for a, b in zip(*(x.tolist() for x in group_bounds([i])), strict=True):
        own = numbers[i[a]]
        flags[own] = 1
        partners = j[a:b]
        hits = flags[np.concatenate([numbers[x] for x in partners.tolist()])]
        ends = np.cumsum(n[partners])
        shared = np.add.reduceat(hits, ends - n[partners], dtype=np.int64)
        alike[a:b] = (100 + percent) * shared >= percent * (n[partners] + len(own))
        flags[own] = 0
    return i[alike], j[alike]


def _open(i, j, component, block, same):
    keep = (component[i] != component[j]) & (same[i] | (block[i] != block[j]))
    return i[keep], j[keep]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the set in the place of the text, their last column."""
    shingles = Shingles()
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            found = [s.tobytes() for s in shingles.of_column(batch.column(batch.num_columns - 1))]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(found, pa.binary())],
                names=[*batch.schema.names[:-1], "set"],
            )


def _sets_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_sets`; a row that repeats id (first column) and set in its task is left out."""
    seen: set[tuple[int, int]] = set()
    for batch in _sets(batches):
        keep = []
        for rep, raw in zip(batch.column(0).to_pylist(), batch["set"], strict=True):
            row = rep, int(np.frombuffer(raw.as_buffer(), dtype=np.uint64).sum())
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verify(percent: int):
    """Rows sorted by (a, salt, b), the set of ``a`` itself first with ``b`` null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            kept_a, kept_b = [], []
            for a, b, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, values = a.as_py(), np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if not b.is_valid:
                    centre, held = a, values
                    continue
                if a != centre:
                    raise ValueError("a pair came without the set of its first document")
                shared = np.searchsorted(held, values)
                shared = np.minimum(shared, len(held) - 1)
                common = int((held[shared] == values).sum())
                if (100 + percent) * common >= percent * (len(held) + len(values)):
                    kept_a.append(a)
                    kept_b.append(b.as_py())
            yield pa.record_batch(
                [pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["a", "b"]
            )

    return run


def _links(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets.

    Sets are made where the texts are read and shuffled once, to the first
    document of their pair. One with many pairs is copied, so that a task never
    holds more than a batch of its partners.
    """
    degrees = stored(pairs.groupBy("a").agg(F.count("*").alias("partners")), "degrees")
    salted = join_counted(pairs, degrees, "a", "partners", pairs.count(), "inner").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / PARTNERS)).alias("salt")
    )
    members = salted.select(F.col("b").alias("doc_id"), "a", "b", "salt")
    centres = salted.select("a", "salt").distinct().select(
        F.col("a").alias("doc_id"), "a", F.lit(None).cast("bigint").alias("b"), "salt"
    )
    wanted = stored(members.unionByName(centres), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id")
    sets = texts.select("a", "b", "salt", "text").mapInArrow(
        _sets, "a bigint, b bigint, salt bigint, set binary"
    )
    return stored(
        sets.repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .select("a", "b", "set")
        .mapInArrow(_verify(percent), "a bigint, b bigint"),
        "links",
    )


def _open_cells(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the routes that several components share: shingle, rep, component, in_cell."""
    labelled = stored(
        cells.join(known, "rep", "left")
        .select("shingle", "rep", F.coalesce("component", "rep").alias("component")),
        "labelled",
    )
    several = stored(
        labelled.groupBy("shingle")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("in_cell"),
        )
        .filter("low <> high").select("shingle", "in_cell"),
        "open",
    )
    return join_counted(labelled, several, "shingle", "in_cell", labelled.count(), "inner")


def _dealt(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of a ``key`` in tasks: one, or one for each pair of its ``blocks`` blocks."""
    number = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    return rows.withColumn("block", number).select(
        key,
        "block",
        *columns,
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
                lambda other: F.struct(
                    F.least("block", other).alias("a"), F.greatest("block", other).alias("b")
                ),
            )
        ).alias("pair"),
    ).select(
        F.xxhash64(key, "pair.a", "pair.b").alias("task"),
        "block",
        (F.col("pair.a") == F.col("pair.b")).alias("same"),
        *columns,
    )


def _connected(inside: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect what the bound allows in any route, large routes in blocks."""
    dealt = _dealt(
        inside.withColumn("blocks", F.ceil(F.col("in_cell") / BLOCK)), "shingle", "rep", "component"
    )
    return (
        dealt.join(points, "rep")
        .select("task", "rep", "component", "block", "same", "n", "point")
        .repartition("task").sortWithinPartitions("task", "n", "rep")
        .mapInArrow(_candidates(percent), "a bigint, b bigint")
        .distinct()
    )


def _links_in_clusters(
    rows: DataFrame, candidates: DataFrame, known: DataFrame, points: DataFrame, percent: int
) -> DataFrame:
    """Pairs (a, b) that connect all links inside the clusters that candidates form.

    Any pair that may be a link and is not known lies in one cluster, so each
    set travels to that cluster only; to one task, or to one per other block.
    """
    clusters = components(candidates, "a", "b").select(
        F.col("node").alias("rep"), F.col("component").alias("cluster")
    )
    members = stored(
        clusters.join(points.select("rep", "n"), "rep").join(known, "rep", "left")
        .select("rep", "cluster", "n", F.coalesce("component", "rep").alias("component")),
        "clusters",
    )
    sizes = members.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.ceil(
            F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
        ).alias("blocks"),
    )
    total = members.count()
    members = stored(
        join_counted(members, stored(sizes, "sizes"), "cluster", "members", total, "inner")
        .select(F.col("rep").alias("doc_id"), "rep", "cluster", "component", "blocks"),
        "members",
    )
    texts = rows.join(F.broadcast(members) if total <= BROADCAST_IDS else members, "doc_id")
    sets = texts.select("rep", "cluster", "component", "blocks", "text").mapInArrow(
        _sets_once, "rep bigint, cluster bigint, component bigint, blocks bigint, set binary"
    )
    return stored(
        _dealt(sets, "cluster", "rep", "component", "set")
        .repartition("task").sortWithinPartitions("task", "rep")
        .mapInArrow(_linked(percent), "a bigint, b bigint"),
        "linked",
    )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z in lower case. A set holds
    the distinct shingles of five words; fewer words are one shingle; no words
    give an empty set that links with nothing. Documents link at a Jaccard
    similarity of ``percent`` / 100 and more; ``component_id`` is the smallest
    id reachable. No link is lost: every pair that could reach the similarity
    is verified, or is in one component already. Sets are compared as 64-bit
    hashes of their shingles.

    Ids are integers. Rows that repeat an id are one document and should have
    one text; if they differ, the id gets the smallest component of its texts. A row with a null id links with nothing. An empty table gives an
    empty result, other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    profiled = stored(
        rows.mapInArrow(
            _profile,
            "doc_id bigint, n bigint, high bigint, low bigint, point binary, "
            "shingle bigint, times bigint",
        ),
        "profiles",
    )
    frequent = (
        profiled.filter(F.col("shingle").isNotNull())
        .groupBy("shingle").agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "shingle").limit(max_frequent)
        .select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64)
    )
    profiles = profiled.filter(F.col("shingle").isNull()).drop("shingle", "times")
    total = profiles.count()

    # Equal sets are one class, named by its smallest id.
    digest = F.struct("n", "high", "low")
    linkable = profiles.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = linkable.groupBy(digest.alias("digest")).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")
    )
    classes = stored(classes, "classes")
    named = stored(
        join_counted(
            linkable.select("doc_id", digest.alias("digest")), classes, "digest", "copies", total
        ).select("doc_id", "rep").distinct(),
        "named",
    )
    points = linkable.select("doc_id", "n", "point").join(
        named.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi"
    )
    points = stored(points.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "points")

    routed = rows.mapInArrow(_routes(frequent, percent), "shingle bigint, doc_id bigint, n int")
    routed = routed.repartition("shingle").sortWithinPartitions("shingle", "n", "doc_id")
    met = stored(routed.mapInArrow(_stars(percent), "a bigint, b bigint, shingle bigint"), "met")

    pairs = met.filter(F.col("a").isNotNull()).select("a", "b").distinct()
    pairs = _by_class(pairs, named, points).select("a", "b", "n", "m", "p", "q")
    pairs = stored(
        pairs.mapInArrow(_bounded(percent), "a bigint, b bigint, likeness double"), "pairs"
    )
    # First each document with its likeliest partner: that joins most groups at little cost.
    best = F.max(F.struct("likeness", (-F.col("a")).alias("a")))["a"]
    first = stored(pairs.groupBy("b").agg((-best).alias("a")).select("a", "b"), "first")
    links = _links(rows, first, percent)
    known = stored(
        components(links, "a", "b").select(F.col("node").alias("rep"), "component"), "known"
    )

    cells = stored(
        met.filter(F.col("shingle").isNotNull())
        .select("shingle", F.col("b").alias("doc_id"))
        .join(named, "doc_id").select("shingle", "rep").distinct(),
        "cells",
    )
    # What is open now is compared in full, in the clusters that it forms.
    open_pairs = (
        pairs.join(known.select(F.col("rep").alias("a"), F.col("component").alias("of_a")), "a", "left")
        .join(known.select(F.col("rep").alias("b"), F.col("component").alias("of_b")), "b", "left")
        .filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        .select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    connected = _connected(_open_cells(cells, known), points, percent)
    candidates = stored(connected.unionByName(open_pairs), "candidates")
    if not candidates.isEmpty():
        again = _links_in_clusters(rows, candidates, known, points, percent)
        links = known.filter("rep <> component").select(
            F.col("rep").alias("a"), F.col("component").alias("b")
        )
        known = stored(
            components(links.unionByName(again), "a", "b")
            .select(F.col("node").alias("rep"), "component"),
            "known",
        )
    reach = known.join(named.groupBy("rep").agg(F.count("*").alias("copies")), "rep")
    by_doc = (
        join_counted(named, reach, "rep", "copies", total)
        .groupBy(F.col("doc_id").alias("linked_id"))
        .agg(F.min(F.coalesce("component", "rep")).alias("component"))
    )
    return (
        profiles.select("doc_id", F.col("n").alias("n_shingles"))
        .join(by_doc, F.col("doc_id") == F.col("linked_id"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def _by_class(pairs: DataFrame, named: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of documents as pairs of class ids, with the sizes and points of both."""
    left = named.select(F.col("doc_id").alias("a"), F.col("rep").alias("rep_a"))
    right = named.select(F.col("doc_id").alias("b"), F.col("rep").alias("rep_b"))
    by_rep = (
        pairs.join(left, "a").join(right, "b")
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
        .filter("a <> b").distinct()
    )
    first = points.select(F.col("rep").alias("a"), "n", F.col("point").alias("p"))
    second = points.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("point").alias("q"))
    return by_rep.join(first, "a").join(second, "b")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(
           CASE WHEN len(ws) >= 5
                THEN list_transform(range(1, len(ws) - 3),
                                    lambda i: array_to_string(ws[i:i + 4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
                ELSE [] END) AS gram
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared
  JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y
  WHERE 100 * common >= 80 * (nx.n + ny.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, CASE WHEN reach.b = links.x THEN links.y ELSE links.x END
  FROM reach JOIN links ON reach.b = links.x OR reach.b = links.y
)
SELECT reach.a AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles,
       min(reach.b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a
GROUP BY reach.a
"""
