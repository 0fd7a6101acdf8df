"""Token-id shards with a minimal perfect hash index.

A shard file holds the ids of its documents end to end, in ascending document
order, and behind them what finds a document in constant time:

    ids        uint16 or uint32, little-endian, ``n_ids`` of them
    ends       uint64 per document: ids up to its end
    keys       int64 per document (0 for a null key)
    first_doc  uint32 per slot: first document of the key
    docs       uint32 per slot: documents of the key (rows may repeat a key)
    prints     uint32 per slot: fingerprint of the key
    levels     bit arrays of the hash, 64-bit words
    header     magic, id width, n_ids, n_docs, n_keys, null documents, level sizes
    uint32 length of the header, then a line feed

The hash is a cascade of bit arrays: a key is resolved on the first level
where no other key shares its bit, and its slot is the number of bits set
before. A key that is not in the shard is refused by its fingerprint and its
stored key.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citespark.llm.bpe import spread
from citespark.llm.staging import per_worker

MAGIC = b"TOKSHRD1"
HEAD = "<8sBQQQQI"
#: Text bytes of a shard; its file holds about as many.
SHARD_BYTES = 16 << 20
#: Bits per unresolved key on each level.
ROOM = 2
CACHED_PIECES = 500_000
ROWS_AT_ONCE = 256
#: Words that the library gets as one text.
TOGETHER = 64
NULL_KEY = (0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D)
MAX_SHARDS = 1 << 22
PUNCTUATION = string.punctuation
#: Words whose letter classes are the same in all libraries.
LATIN = re.compile("[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Fixed value: the word pattern of the byte-level pre-tokenizer.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of the keys for each seed."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and a 32-bit fingerprint per key."""
    raw = keys.astype(np.int64).view(np.uint64)
    first = np.where(missing, np.uint64(NULL_KEY[0]), mix(raw, 1))
    second = np.where(missing, np.uint64(NULL_KEY[1]), mix(raw, 2))
    return first, (second >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit hashes to the slots 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(level).astype(np.int64) for level in levels]
        self.before = []
        total = 0
        for count in counts:
            self.before.append(total + np.cumsum(count) - count)
            total += int(count.sum())

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(hashes):
            words = max(1, -(-ROOM * len(hashes) // 64))
            at = mix(hashes, 3 + len(levels)) % np.uint64(64 * words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            hashes = hashes[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for one that no level knows."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for number, (level, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = mix(hashes[open_], 3 + number) % np.uint64(64 * len(level))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = level[word]
            hit = (here >> bit) & np.uint64(1) == 1
            below = here & ((np.uint64(1) << bit) - np.uint64(1))
            rank = before[word] + np.bitwise_count(below).astype(np.int64)
            found[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return found


def pack_shard(ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, missing: np.ndarray) -> bytes:
    """The file of one shard, without the closing line feed; equal keys are neighbours."""
    hashes, prints = key_hashes(keys, missing)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (missing[1:] != missing[:-1])
    first = np.flatnonzero(new)
    index = PerfectHash.build(hashes[first])
    slots = index.slots(hashes[first])
    by_slot = np.empty(len(first), dtype=np.int64)
    by_slot[slots] = np.arange(len(first))
    docs = np.diff(np.append(first, len(keys)))
    header = struct.pack(
        HEAD,
        MAGIC,
        ids.dtype.itemsize,
        len(ids),
        len(keys),
        len(first),
        int(missing.sum()),
        len(index.levels),
    ) + b"".join(struct.pack("<Q", len(level)) for level in index.levels)
    return b"".join(
        [
            ids.tobytes(),
            np.cumsum(counts).astype("<u8").tobytes(),
            np.where(missing, 0, keys).astype("<i8").tobytes(),
            first[by_slot].astype("<u4").tobytes(),
            docs[by_slot].astype("<u4").tobytes(),
            prints[first][by_slot].astype("<u4").tobytes(),
            *[level.astype("<u8").tobytes() for level in index.levels],
            header,
            struct.pack("<I", len(header)),
        ]
    )


class Shard:
    """A shard file in memory."""

    def __init__(self, content: bytes):
        end = len(content) - 1
        (length,) = struct.unpack("<I", content[end - 4 : end])
        head = content[end - 4 - length : end - 4]
        magic, width, n_ids, n_docs, n_keys, n_null, n_levels = struct.unpack(
            HEAD, head[: struct.calcsize(HEAD)]
        )
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(content, dtype=kind, count=count, offset=at)
            at += values.nbytes
            return values

        self.ids = take(f"<u{width}", n_ids)
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.keys = take("<i8", n_docs)
        # Null keys sort first.
        self.missing = np.arange(n_docs) < n_null
        self.first_doc = take("<u4", n_keys).astype(np.int64)
        self.docs = take("<u4", n_keys).astype(np.int64)
        self.prints = take("<u4", n_keys)
        sizes = struct.unpack(f"<{n_levels}Q", head[struct.calcsize(HEAD) :])
        self.index = PerfectHash([take("<u8", size) for size in sizes])

    def find(self, keys: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if it isn't here."""
        hashes, prints = key_hashes(keys, missing)
        slots = self.index.slots(hashes)
        known = slots >= 0
        first = np.zeros(len(keys), dtype=np.int64)
        docs = np.zeros(len(keys), dtype=np.int64)
        slots = slots[known]
        first[known], docs[known] = self.first_doc[slots], self.docs[slots]
        right = np.zeros(len(keys), dtype=bool)
        right[known] = self.prints[slots] == prints[known]
        right[right] = (self.missing[first[right]] == missing[right]) & (
            missing[right] | (self.keys[first[right]] == keys[right])
        )
        return first, np.where(right, docs, 0)

    def document(self, number: int) -> tuple[int, np.ndarray]:
        """Offset and ids of a document."""
        start = int(self.ends[number - 1]) if number else 0
        return start, self.ids[start : int(self.ends[number])]


def rank_merger(path: str) -> object | None:
    """A faster merger with the ranks of a tokenizer file, or none if they don't fit it.

    It takes a vocabulary numbered in the order of the merges, which are then
    ranks, and the byte-level alphabet without settings of its own.
    """
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model = parts["model"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    names = sorted(model["vocab"], key=model["vocab"].get)
    letters = len(pre_tokenizers.ByteLevel.alphabet())
    if (
        parts["normalizer"] is not None
        or not plain.items() <= (parts["pre_tokenizer"] or {}).items()
        or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        or model.get("end_of_word_suffix")
        or [a + b for a, b in pairs] != names[letters : letters + len(pairs)]
        or [model["vocab"][n] for n in names] != list(range(len(names)))
    ):
        return None
    # The alphabet: printable Latin-1 bytes stand for themselves, others follow in order.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in n): r for r, n in enumerate(names[: letters + len(pairs)])}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Growing:
    """An array that is extended in place, with room for what comes."""

    def __init__(self, kind: type, values: np.ndarray | None = None):
        self.held = np.zeros(1 << 12, dtype=kind)
        self.size = 0
        if values is not None:
            self.extend(values)

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            wider = np.zeros(max(end, 2 * len(self.held)), dtype=self.held.dtype)
            wider[: self.size] = self.held[: self.size]
            self.held = wider
        self.held[self.size : end] = values
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class LibraryEncoder:
    """Texts through a tokenizer file, each piece between single spaces once while cached.

    A byte-level pre-tokenizer starts a new word at a space between two other
    characters, so the pieces can be encoded apart. A text with other white
    space next to a space is encoded whole. Words of basic and extended Latin
    letters and digits go to :func:`rank_merger`, which gives the same ids in a
    quarter of the time; everything else goes to the tokenizer library.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = rank_merger(path)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        for name, number in vocabulary.items():
            self.spaced[number] = name.startswith(space)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cached = cached
        self.number: dict[str, int] = {}
        self.tokens = Growing(np.int32)
        self.first = Growing(np.int64)
        self.count = Growing(np.int64)
        self.uses = Growing(np.int64)

    def _forget(self) -> None:
        """Keep the pieces used most, at most half of what is cached."""
        uses = self.uses.values
        least = 2
        while (uses >= least).sum() > self.cached // 2:
            least *= 2
        keep = np.flatnonzero(uses >= least)
        names = list(self.number)
        self.number = {names[i]: at for at, i in enumerate(keep.tolist())}
        count = self.count.values[keep]
        ids = np.maximum(count, 0)
        tokens = self.tokens.values[spread(self.first.values[keep], ids)]
        self.tokens = Growing(np.int32, tokens)
        self.first = Growing(np.int64, np.cumsum(ids) - ids)
        self.count = Growing(np.int64, count)
        self.uses = Growing(np.int64, uses[keep] // 2)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str], latin: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, end to end, and the number of ids of each."""
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.merger is not None and latin:
            flat = np.array(self.merger.encode_ordinary(f" {' '.join(words)}"), dtype=np.int64)
        else:
            joined = [
                f" {' '.join(words[at : at + TOGETHER])}" for at in range(0, len(words), TOGETHER)
            ]
            flat = self._flat(self._library(joined))
        # Only the first token of a word starts with its space.
        first = np.flatnonzero(self.spaced[flat])
        if len(first) == len(words):
            return flat, np.diff(np.append(first, len(flat)))
        found = self._library([f" {w}" for w in words])
        return self._flat(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    @staticmethod
    def _flat(found: list[list[int]]) -> np.ndarray:
        parts = [np.array(ids, dtype=np.int64) for ids in found]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces in front of a text have a space before them here and none there."""
        bare = [piece.rstrip(PUNCTUATION) for piece in pieces]
        # Marks behind letters and digits are words of their own.
        plain = [
            word.isalnum() and (len(word) == len(piece) or "<|" not in piece)
            for word, piece in zip(bare, pieces, strict=True)
        ]
        distinct = {w for w, p in zip(bare, plain, strict=True) if p}
        latin = list(filter(LATIN.fullmatch, distinct))
        foreign = list(distinct.difference(latin))
        words = {w: i for i, w in enumerate(latin + foreign)}
        others: dict[str, int] = {}
        parts, sizes, mixed = [], [], []
        other_number = others.setdefault
        for i, (piece, word, is_plain) in enumerate(zip(pieces, bare, plain, strict=True)):
            if not is_plain:
                mixed.append(i)
                whole = piece[1:] if piece[:1] == " " else f" {piece}"
                parts.append(-1 - other_number(whole or " ", len(others)))
                sizes.append(1)
            elif len(word) == len(piece):
                parts.append(words[word])
                sizes.append(1)
            else:
                parts.append(words[word])
                parts.append(-1 - other_number(piece[len(word) :], len(others)))
                sizes.append(2)
        found = self._library(list(others))
        last = self._flat(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        encoded = [self._encode_words(latin, True), self._encode_words(foreign, False), last]
        flat = np.concatenate([ids for ids, _ in encoded])
        count = np.concatenate([n for _, n in encoded])
        first = np.cumsum(count) - count
        at = np.array(parts, dtype=np.int64)
        at = np.where(at < 0, len(words) - 1 - at, at)
        tokens = flat[spread(first[at], count[at])]
        bounds = np.concatenate([[0], np.cumsum(count[at])])
        edges = bounds[np.concatenate([[0], np.cumsum(sizes)])]
        counts = np.diff(edges)
        for i in mixed:
            body = pieces[i].removeprefix(" ")
            if not body or body[0].isspace() or body[-1].isspace():
                counts[i] = -1
        self.first.extend(edges[:-1] + self.tokens.size)
        self.tokens.extend(tokens)
        self.count.extend(counts)
        self.uses.extend(np.zeros(len(counts), dtype=np.int64))
        self.number.update(zip(pieces, range(len(self.number), self.count.size), strict=True))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        pieces: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                here = text.split(" ")
                here[0] = f" {here[0]}"
                pieces += here
            ends[i] = len(pieces)
        def look_up(wanted: list[str]) -> np.ndarray:
            found = map(self.number.get, wanted, repeat(-1))
            return np.fromiter(found, dtype=np.int64, count=len(wanted))

        at = look_up(pieces)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = {pieces[i] for i in unknown}
            if len(self.number) + len(missing) > self.cached:
                self._forget()
                self._learn(list(set(pieces).difference(self.number)))
                at = look_up(pieces)
            else:
                self._learn(list(missing))
                at[unknown] = look_up([pieces[i] for i in unknown])
        self.uses.values[:] += np.bincount(at, minlength=self.uses.size)
        count = self.count.values[at]
        tokens = self.tokens.values[spread(self.first.values[at], np.maximum(count, 0))]
        held = np.concatenate([[0], np.cumsum(np.maximum(count, 0))])
        starts = np.append(0, ends[:-1])
        sizes = held[ends] - held[starts]
        unsafe = np.concatenate([[0], np.cumsum(count < 0)])
        whole = np.flatnonzero(unsafe[ends] > unsafe[starts])
        if len(whole):
            # Texts with other white space next to a space.
            parts = np.split(tokens, held[ends[:-1]])
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                parts[i] = np.array(ids, dtype=np.int32)
                sizes[i] = len(ids)
            tokens = np.concatenate(parts)
        return tokens, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        tokens, sizes = self.encode_flat(texts)
        return np.split(tokens, np.cumsum(sizes)[:-1]) if len(sizes) else []


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write the ids of all documents under ``path``, one file per ``shard=N`` folder.

    Shards are ranges of ids in ascending order, null ids first; rows that
    repeat an id are ordered by their text. A null or empty text has the end id
    only. Other columns are ignored; an empty table writes no shard. One task
    holds one shard, about ``shard_bytes`` of text. Spark's text writer writes
    the files, so they can be anywhere that Spark can write.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("LibraryEncoder", tokenizer), lambda: LibraryEncoder(tokenizer))
        kind = f"<u{encoder.width}"
        parts, counts, keys, missing = [], [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                for ids in encoder.encode(batch.column(1).to_pylist()):
                    parts.append(np.append(ids, end_id).astype(kind))
                    counts.append(len(parts[-1]))
                missing.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                keys.append(batch.column(0).fill_null(0).to_numpy())
        if parts:
            content = pack_shard(
                np.concatenate(parts), np.array(counts), np.concatenate(keys),
                np.concatenate(missing),
            )
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([content])],
                names=["shard", "content"],
            )

    # A string column carries any bytes to the text writer; it adds the line feed.
    ranged.mapInArrow(run, "shard int, content binary").select(
        "shard", F.col("content").cast("string").alias("value")
    ).write.partitionBy("shard").option("lineSep", "\n").text(path)


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # Without a shard there is no folder to name one.
    shard = F.col("shard").cast("int") if "shard" in files.columns else F.lit(0)
    return files.select(shard.alias("shard"), "content")


FOUND = "shard int, doc_id bigint, offset bigint, n_tokens bigint, ids binary"


def _rows(shard: int, found: list[tuple]) -> pa.RecordBatch:
    keys, offsets, ids = zip(*found, strict=True)
    return pa.record_batch(
        [
            pa.array([shard] * len(found), pa.int32()),
            pa.array(keys, pa.int64()),
            pa.array(offsets, pa.int64()),
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
        ],
        names=["shard", "doc_id", "offset", "n_tokens", "ids"],
    )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards under ``path``: shard, doc_id, offset, n_tokens, ids.

    Each key stored in a shard is looked up through the index. ``offset``
    counts ids in the shard; ``ids`` are little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                held = Shard(content.as_py())
                new = np.ones(len(held.keys), dtype=bool)
                new[1:] = (held.keys[1:] != held.keys[:-1]) | (held.missing[1:] != held.missing[:-1])
                keys, missing = held.keys[new], held.missing[new]
                first, docs = held.find(keys, missing)
                if int(docs.sum()) != len(held.keys):
                    raise ValueError("the index does not find every key")
                for at in range(0, len(keys), ROWS_AT_ONCE):
                    found = [
                        (None if missing[k] else int(keys[k]), *held.document(first[k] + d))
                        for k in range(at, min(at + ROWS_AT_ONCE, len(keys)))
                        for d in range(docs[k])
                    ]
                    yield _rows(shard.as_py(), found)

    return _shard_files(spark, path).mapInArrow(run, FOUND)


def lookup_tokens(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """The documents with the given keys: shard, doc_id, offset, n_tokens, ids.

    Keys go to the shards whose range holds them, by a broadcast list of each
    shard's first and last key (at most :data:`MAX_SHARDS`, else an error), and
    are found there in constant time. Keys that no shard has give no row.
    """
    spark = keys.sparkSession

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                held = Shard(content.as_py())
                real = held.keys[~held.missing]
                ends = [int(real[0]), int(real[-1])] if len(real) else [None, None]
                yield pa.record_batch(
                    [
                        pa.array([shard.as_py()], pa.int32()),
                        *[pa.array([e], pa.int64()) for e in ends],
                        pa.array([bool(held.missing.any())]),
                    ],
                    names=["shard", "low", "high", "nulls"],
                )

    files = _shard_files(spark, path)
    ranges = files.mapInArrow(bounds, "shard int, low bigint, high bigint, nulls boolean")
    listed = ranges.limit(MAX_SHARDS + 1).collect()
    if len(listed) > MAX_SHARDS:
        raise ValueError("too many shards to list")
    listed = sorted(r for r in listed)
    filled = [r for r in listed if r["low"] is not None]
    low = np.array([r["low"] for r in filled], dtype=np.int64)
    high = np.array([r["high"] for r in filled], dtype=np.int64)
    number = [r["shard"] for r in filled]
    nulls = [r["shard"] for r in listed if r["nulls"]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, shards = [], []
            for key in batch.column(0).to_pylist():
                if key is None:
                    homes = nulls
                else:
                    homes = number[np.searchsorted(high, key) : np.searchsorted(low, key, "right")]
                wanted += [key] * len(homes)
                shards += homes
            yield pa.record_batch(
                [pa.array(shards, pa.int32()), pa.array(wanted, pa.int64())],
                names=["shard", "key"],
            )

    placed = (
        keys.select(F.col(key_col).cast("bigint").alias("key")).distinct()
        .mapInArrow(place, "shard int, key bigint")
    )
    # The keys of a shard are few next to its file: one row per shard.
    asked = placed.groupBy("shard").agg(
        F.collect_list("key").alias("keys"), F.max(F.col("key").isNull()).alias("null_too")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = Shard(row["content"])
                wanted = np.array([*row["keys"], *[0] * row["null_too"]], dtype=np.int64)
                missing = np.zeros(len(wanted), dtype=bool)
                missing[len(row["keys"]) :] = True
                first, docs = held.find(wanted, missing)
                found = [
                    (None if missing[k] else int(wanted[k]), *held.document(first[k] + d))
                    for k in range(len(wanted))
                    for d in range(docs[k])
                ]
                if found:
                    yield _rows(row["shard"], found)

    return files.join(asked, "shard").mapInArrow(fetch, FOUND)


def document_starts(found: DataFrame) -> DataFrame:
    """``found`` with ``start``: ids of all documents before it, over all shards."""
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("shard_ids"))
    # One row per shard, of about SHARD_BYTES each, in this window.
    before = F.sum("shard_ids").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    return found.join(F.broadcast(totals), "shard").withColumn(
        "start", F.col("shard_start") + F.col("offset")
    )
