"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of each word. A proposal is the BPE
result when every token is what its own letters merge to and no adjacent pair
lets a merge cross its border earlier; both are tested for all words of a batch
at once. Only words that fail are merged pair by pair.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citespark.llm.staging import per_worker

WORD_END = 256
CACHED_PIECES = 400_000
ROWS_AT_ONCE = 1_024
#: Words up to this many bytes are merged as rows of one array, longer ones with a heap.
ROW_WORD = 32
NO_RANK = np.iinfo(np.int64).max
#: White space of Python's split that is not white space to the tokenizer's pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class KeyTable:
    """Numbers by 64-bit keys, looked up for whole arrays: open addressing, low load."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of several the last one stays
            won = free[self.keys[slots[free]] == keys[free]]
            self.values[slots[won]] = values[won]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none; keys are not negative."""
        slots = self._slots(keys)
        here = self.keys[slots]
        found = np.where(here == keys, self.values[slots], -1)
        open_ = np.flatnonzero((here != keys) & (here >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slots[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return found


class WordBpe:
    """A byte-level BPE vocabulary with a word-end mark, on batches of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.words = regex.compile(_split_pattern(spec["pre_tokenizer"]))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.specials.values()) + 1
        self.names = [""] * size
        for name, number in [*vocab.items(), *self.specials.items()]:
            self.names[number] = name
        letters = byte_letters()
        self.base = np.array(
            [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters], dtype=np.int64
        )
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = size
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pairs = KeyTable(left * size + right, np.arange(len(pairs)))
        self.made = np.append(made, -1)
        self.ranks = np.append(np.arange(len(pairs)), NO_RANK)
        self.by_pair = {
            (int(a), int(b)): (rank, int(m))
            for rank, (a, b, m) in enumerate(zip(left, right, made, strict=True))
        }
        # How a token came about: its rank (-1 for a single byte) and its two parts.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.rank[made] = np.arange(len(made))
        self.left[made] = left
        self.right[made] = right
        sound = self._sound_tokens(left, right, made)
        self._build_tree(vocab, suffix, letters, sound)

    def _sound_tokens(self, left, right, made) -> np.ndarray:
        """Tokens that their own letters merge to."""
        alone = self._compatible(left, right, joined=True)
        sound = np.zeros(self.size, dtype=bool)
        sound[self.base] = True
        times = np.bincount(made, minlength=self.size)
        for a, b, m, good in zip(left, right, made, alone, strict=True):
            sound[m] = good and sound[a] and sound[b] and times[m] == 1
        return sound

    def _build_tree(self, vocab, suffix, letters, sound) -> None:
        code = {c: b for b, c in enumerate(letters)}
        child: dict[int, int] = {}
        accept = [-1]
        for name, number in vocab.items():
            if not sound[number]:
                continue
            ends = bool(suffix) and name.endswith(suffix)
            symbols = [code[c] for c in (name[: -len(suffix)] if ends else name)]
            if ends:
                symbols[-1] += WORD_END
            node = 0
            for symbol in symbols:
                key = node * 2 * WORD_END + symbol
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(accept)
                    accept.append(-1)
            accept[node] = number
        self.tree = KeyTable(
            np.fromiter(child.keys(), dtype=np.int64, count=len(child)),
            np.fromiter(child.values(), dtype=np.int64, count=len(child)),
        )
        self.accept = np.array(accept, dtype=np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging pairs; :data:`NO_RANK` where there is none."""
        at = self.pairs.get(np.where((a >= 0) & (b >= 0), a * self.size + b, 0))
        at = np.where((a >= 0) & (b >= 0), at, -1)
        return self.ranks[at], self.made[at]

    def _compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of each pair before both tokens stand.

        Merges are undone from the last one back. The two tokens at the border
        stood side by side until the undone merge; a merge of theirs with a
        lower rank would have come first. Of equal merges the left one does.
        ``joined`` asks about the time before the pair itself is merged.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        if not joined:
            good = self._merge(a, b)[0] == NO_RANK
        open_ = np.flatnonzero(good)
        while len(open_):
            x, y = a[open_], b[open_]
            rank_x, rank_y = self.rank[x], self.rank[y]
            split_x = rank_x > rank_y
            limit = np.where(split_x, rank_x, rank_y + 1)
            going = np.maximum(rank_x, rank_y) >= 0
            x = np.where(split_x, self.right[x], x)
            y = np.where(split_x, y, self.left[y])
            bad = going & (self._merge(x, y)[0] < limit)
            good[open_[bad]] = False
            keep = going & ~bad
            open_ = open_[keep]
            a[open_], b[open_] = x[keep], y[keep]
        return good

    def _speculate(self, symbols, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in step: word numbers and tokens, in order."""
        n = len(starts)
        word = np.arange(n)
        at, node = starts.copy(), np.zeros(n, dtype=np.int64)
        best_at, best = starts.copy(), np.full(n, -1, dtype=np.int64)
        words, tokens = [], []
        end = ends
        while len(word):
            inside = at < end
            keys = node * 2 * WORD_END + symbols[np.where(inside, at, 0)]
            child = self.tree.get(keys)
            step = inside & (child >= 0)
            node = np.where(step, child, node)
            at = at + step
            token = self.accept[node]
            better = step & (token >= 0)
            best = np.where(better, token, best)
            best_at = np.where(better, at, best_at)
            stop = ~step
            if stop.any():
                words.append(word[stop])
                tokens.append(best[stop])
                at = np.where(stop, best_at, at)
                node = np.where(stop, 0, node)
                best = np.where(stop, -1, best)
                going = ~(stop & (at >= end))
                word, at, node = word[going], at[going], node[going]
                best_at, best, end = best_at[going], best[going], end[going]
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Exact merging of all rows (tokens, -1 behind the last), one merge a row and round."""
        width = rows.shape[1]
        columns = np.arange(width - 1)
        rows = rows.copy()
        ranks, made = self._merge(rows[:, :-1].ravel(), rows[:, 1:].ravel())
        ranks, made = ranks.reshape(len(rows), -1), made.reshape(len(rows), -1)
        todo, now = np.arange(len(rows)), rows
        while True:
            every = np.arange(len(now))
            at = ranks.argmin(axis=1)
            some = ranks[every, at] != NO_RANK
            rows[todo[~some]] = now[~some]
            todo, now, at = todo[some], now[some], at[some]
            ranks, made = ranks[some], made[some]
            every = np.arange(len(now))
            if not len(now):
                return rows
            behind = columns[None, :] > at[:, None]
            token = made[every, at]
            now[:, :-1] = np.where(behind, now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            now[every, at] = token
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            made[:, :-1] = np.where(behind[:, :-1], made[:, 1:], made[:, :-1])
            ranks[:, -1], made[:, -1] = NO_RANK, -1
            # Only the pairs on both sides of the new token have changed.
            inner = at < width - 1
            ranks[every[inner], at[inner]], made[every[inner], at[inner]] = self._merge(
                token[inner], now[every[inner], at[inner] + 1]
            )
            inner = at > 0
            ranks[every[inner], at[inner] - 1], made[every[inner], at[inner] - 1] = self._merge(
                now[every[inner], at[inner] - 1], token[inner]
            )

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """Exact merging of one long word with a heap of pairs."""
        after = [*range(1, len(tokens)), -1]
        before = [*range(-1, len(tokens) - 1)]
        alive = [True] * len(tokens)
        heap: list[tuple] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                j = after[i]
                found = self.by_pair.get((tokens[i], tokens[j]))
                if found:
                    heapq.heappush(heap, (found[0], i, tokens[i], j, tokens[j], found[1]))

        for i in range(len(tokens)):
            push(i)
        while heap:
            _, i, a, j, b, made = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and tokens[i] == a and tokens[j] == b):
                continue
            tokens[i] = made
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [t for t, here in zip(tokens, alive, strict=True) if here]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and the number of tokens up to each word."""
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols[ends - 1] += WORD_END
        owner, tokens = self._speculate(symbols, starts, ends)
        failed = np.zeros(len(words), dtype=bool)
        failed[owner[tokens < 0]] = True
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        pair = pair[~failed[owner[pair]]]
        keys = tokens[pair] * self.size + tokens[pair + 1]
        distinct, which = np.unique(keys, return_inverse=True)
        good = self._compatible(distinct // self.size, distinct % self.size)[which]
        failed[owner[pair[~good]]] = True
        if failed.any():
            owner, tokens = self._merge_failed(
                np.flatnonzero(failed), symbols, starts, lengths, owner, tokens, failed
            )
        counts = np.bincount(owner, minlength=len(words))
        return tokens, np.cumsum(counts)

    def _merge_failed(self, which, symbols, starts, lengths, owner, tokens, failed):
        keep = ~failed[owner]
        owners, found = [owner[keep]], [tokens[keep]]
        base = self.base[symbols]
        short = which[lengths[which] <= ROW_WORD]
        widths = np.maximum(4, -(-lengths[short] // 4) * 4)
        for width in np.unique(widths):
            part = short[widths == width]
            at = np.arange(width)[None, :]
            inside = at < lengths[part][:, None]
            rows = np.where(
                inside, base[np.where(inside, starts[part][:, None] + at, 0)], -1
            )
            rows = self._merge_rows(rows)
            filled = rows >= 0
            owners.append(np.repeat(part, filled.sum(axis=1)))
            found.append(rows[filled])
        for word in which[lengths[which] > ROW_WORD]:
            merged = self._merge_long(
                base[starts[word] : starts[word] + lengths[word]].tolist()
            )
            owners.append(np.full(len(merged), word))
            found.append(np.array(merged, dtype=np.int64))
        owner, tokens = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return owner[order], tokens[order]


def _split_pattern(spec: dict) -> str:
    for part in spec.get("pretokenizers", [spec]):
        if part["type"] == "Split":
            return part["pattern"]["Regex"]
    raise ValueError("the tokenizer has no splitting pattern")


#: The settings that this module implements; fixed values of the file format.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLITTERS = [
    {"type": "Split", "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def check_settings(spec: dict) -> None:
    """Refuse a tokenizer whose texts are not normalised, split and decoded as here."""
    found = (spec["normalizer"] or {}).get("normalizers")
    if found != NORMALIZERS:
        raise ValueError(f"the tokenizer has another normaliser: {spec['normalizer']}")
    found = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    found = [{k: v for k, v in part.items() if k != "pattern"} for part in found]
    if found != SPLITTERS:
        raise ValueError(f"the tokenizer splits otherwise: {spec['pre_tokenizer']}")
    if spec["decoder"] is not None:
        raise ValueError(f"the tokenizer has a decoder: {spec['decoder']}")


def unlike(library: Tokenizer) -> re.Pattern:
    """A character that Python's Unicode tables may treat unlike the library's.

    Those that Python does not know, and marks and composed letters that the
    library, of another Unicode version, orders or composes otherwise.
    """
    other = np.zeros(sys.maxunicode + 1, dtype=bool)
    for code in range(len(other)):
        c = chr(code)
        if unicodedata.category(c) == "Cn":
            other[code] = True
        elif unicodedata.combining(c) or unicodedata.decomposition(c):
            # Between marks of the lowest and the highest class, and taken apart.
            probes = f"a{c}\u0334", f"a\u0345{c}", f"a\u0301{c}", unicodedata.normalize("NFD", c)
            other[code] = any(
                library.normalizer.normalize_str(probe)
                != re.sub(r"\s+", " ", unicodedata.normalize("NFC", probe)).lower()
                for probe in probes
            )
    edges = np.flatnonzero(np.diff(np.concatenate([[False], other, [False]]).astype(np.int8)))
    ranges = zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class TextBpe:
    """Whole texts by way of their white-space pieces, each encoded once while cached.

    Texts with characters of :func:`unlike` are normalised, and their pieces
    split, by the library: its tables decide about case, letters and marks.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        with open(path, encoding="utf-8") as file:
            check_settings(json.load(file))
        self.library = per_worker(("library", path), lambda: Tokenizer.from_file(path))
        self.unlike = per_worker(("unlike", path), lambda: unlike(self.library))
        self.model = WordBpe(path)
        self.cached = cached
        self._forget()
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, self.model.specials)) + ")"
        ) if self.model.specials else None
        # White space of the pattern, without the four separators that Python also splits at.
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")

    def _pieces(self, text: str) -> list[str]:
        """Normalised pieces; special tokens come as they are."""
        if self.special is not None and "<" in text and self.special.search(text):
            found = []
            for part in self.special.split(text):
                found += [part] if part in self.model.specials else self._plain(part)
            return found
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.unlike.search(text):
                return [p for p in self.library.normalizer.normalize_str(text).split(" ") if p]
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # Letter by letter: no final form of sigma.
            text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in SEPARATORS):
            return [p for p in self.space.split(text) if p]
        return text.split()

    def _forget(self) -> None:
        """Piece number by piece; per piece the first of its tokens and their count."""
        self.number = {name: at for at, name in enumerate(self.model.specials)}
        self.tokens = np.array(list(self.model.specials.values()), dtype=np.int64)
        self.first = np.arange(len(self.tokens))
        self.count = np.ones(len(self.tokens), dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        numbers: dict[str, int] = {}
        words, sizes = [], []
        for piece in pieces:
            if piece.isalpha():
                words.append(numbers.setdefault(piece, len(numbers)))
                sizes.append(1)
            else:
                if piece.isascii() or not self.unlike.search(piece):
                    found = self.model.words.findall(piece)
                else:
                    split = self.library.pre_tokenizer.pre_tokenize_str(piece)
                    found = [piece[a:b] for _, (a, b) in split]
                words += [numbers.setdefault(w, len(numbers)) for w in found]
                sizes.append(len(found))
        tokens, ends = self.model.encode_words([w.encode() for w in numbers])
        counts = np.diff(ends, prepend=0)
        words = np.array(words)
        flat = tokens[spread(ends[words] - counts[words], counts[words])]
        bounds = np.concatenate([[0], np.cumsum(counts[words])])
        edges = bounds[np.concatenate([[0], np.cumsum(sizes)])]
        self.first = np.append(self.first, edges[:-1] + len(self.tokens))
        self.count = np.append(self.count, np.diff(edges))
        self.tokens = np.append(self.tokens, flat)
        self.number.update(zip(pieces, range(len(self.number), len(self.count)), strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self._pieces(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.number)
        if missing and len(self.number) + len(missing) > self.cached:
            self._forget()
            missing = set().union(*split).difference(self.number)
        if missing:
            self._learn(list(missing))
        number, names = self.number.__getitem__, self.model.names.__getitem__
        found = []
        for pieces in split:
            at = np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces))
            ids = self.tokens[spread(self.first[at], self.count[at])]
            found.append((ids.astype("<u4").tobytes(), " ".join(map(names, ids.tolist()))))
        return found


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of every run, end to end."""
    total = np.cumsum(count)
    if not len(total):
        return np.zeros(0, dtype=np.int64)
    return np.arange(total[-1]) + np.repeat(first - (total - count), count)


def bpe_round_trip(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded.

    ``ids`` are little-endian unsigned 32-bit integers, the same as the
    tokenizer library's without added special tokens; special tokens written in
    a text are found as such. ``decoded`` is the library's decoding: token
    names joined by a space. A null or empty text has no tokens and decodes to
    an empty string. A file with other settings than those implemented here
    (:func:`check_settings`) is refused. Null and repeated ids are rows like others, an empty table
    gives an empty result, other columns are ignored.

    ``tokenizer`` is the path of a tokenizer file on the executors. Rows stay
    where they are read; a task holds a batch and a bounded cache of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextBpe(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = encoder.encode(batch.column(1).to_pylist())
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                        pa.array([ids for ids, _ in found], pa.binary()),
                        pa.array([text for _, text in found], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def with_digests(encoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Digests of ids and decoded text, and the columns in ``keep``."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        *(keep or []),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
