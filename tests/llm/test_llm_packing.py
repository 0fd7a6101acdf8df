"""Packing along the Hilbert curve against the tokenizer library and brute force."""

import itertools

import numpy as np
import pytest

from citespark.llm import packing
from citespark.llm.queries import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    return [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, docs, length):
    """Every id lies in one piece, sequences are gapless, none is padded."""
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append(row)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        sizes = [r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *itertools.accumulate(sizes)][:-1]
        filled = sum(sizes)
        assert filled == length or (filled < length and filled & (filled - 1) == 0)
    assert sum(sum(r.length for r in p) < length for p in sequences.values()) < length.bit_length()
    assert sorted(sequences) == list(range(len(sequences)))
    # Rows that repeat an id are told apart by their pieces' place in the order.
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    found, open_ids = [], []
    for row in rows:
        ids = np.frombuffer(row.ids, dtype="<u4").tolist()
        assert len(ids) == row.length > 0 and row.start == len(open_ids)
        open_ids += ids
        if len(open_ids) == row.doc_tokens:
            found.append((row.doc_id, open_ids))
            open_ids = []
    assert not open_ids
    want = zip((i for i, _ in docs), library_ids([t or "" for _, t in docs]))
    assert sorted(found, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("length", [2_048, 8])
def test_odd_rows(spark, odd, odd_rows, length):
    rows = packing.pack_documents(odd, FILE, length=length).collect()
    check_pieces(rows, [(r[0], r[1]) for r in odd_rows], length)


def test_no_rows(spark, none):
    assert packing.pack_documents(none, FILE).count() == 0


def test_documents_in_many_ranges(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "SORT_ROWS", 30)
    rows = packing.pack_documents(documents, FILE).collect()
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    check_pieces(rows, docs, 2_048)


def test_neighbours_are_alike(spark):
    from random import Random

    draw = Random(2)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(4)]
    docs = [(i, " ".join(draw.choices(topics[i % 4], k=80))) for i in range(400)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), FILE)
    order = {}
    for row in sorted(rows.collect(), key=lambda r: (r.sequence_id, r.offset)):
        order.setdefault(row.doc_id, None)
    topic = [i % 4 for i in order]
    # By chance a quarter would be; four coordinates keep three quarters here.
    assert sum(a == b for a, b in zip(topic, topic[1:])) > 0.5 * len(topic)


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_cuts_equal_a_walk_over_all_ids():
    draw = np.random.default_rng(3)
    for _ in range(200):
        length = int(draw.choice([1, 2, 8, 13]))
        sizes = draw.integers(1, 20, size=draw.integers(1, 6))
        total = int(sizes.sum())
        tail = packing.tail_ends(total, length).tolist()
        bounds = [*range(length, total + 1, length), *tail]
        rows = []
        for owner, (start, size) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            for at in range(start, start + size):
                sequence = sum(b <= at for b in bounds)
                first = bounds[sequence - 1] if sequence else 0
                if at > start and rows[-1][3] == sequence:
                    rows[-1][2] += 1
                else:
                    rows.append([owner, at - start, 1, sequence, at - first])
        found = packing.cut_pieces(np.cumsum(sizes) - sizes, sizes, total, length)
        assert [list(map(int, r)) for r in zip(*found)] == rows


def test_merger_gives_the_ids_of_the_library():
    """All code points that the faster merger may see, in words and next to digits."""
    from citespark.llm.token_shards import LATIN, LibraryEncoder

    encoder = LibraryEncoder(FILE)
    points = [c for c in map(chr, range(0x250)) if LATIN.fullmatch(c)]
    words = [*points, *(f"a{c}9{c}z" for c in points), *(f"{c}{c}" for c in points)]
    assert encoder.merger is not None
    assert all(w.isalnum() for w in words)
    found = [encoder.merger.encode_ordinary(f" {w}") for w in words]
    want = [ids[:-1] for ids in library_ids([f" {w}" for w in words])]
    assert found == want
