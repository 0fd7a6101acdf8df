import hashlib
import json
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.llm import bpe, token_shards

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    return tokenizers.Tokenizer.from_file(public.path(name))


def strange_texts():
    draw = random.Random(2)
    texts = [
        "", " ", "<|endoftext|>Hello<|startoftext|> wOrld", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "İstanbul I'll we've",
        "a\x1cb\x85c　d", "e\u0301a\u0300", "x" * 3000, "aaaa aaaaa aaaaaaa" * 20, "日本語 🎉🎉 ñ",
        "<|endoftext|", "two  spaces \n and lines ", " lead", "trail ", "tab\t tab", "\n\n\n x",
    ]
    letters = "abcdefghij ABC'stlvem.,!?-_1234567890éüßñçЖжΣ中\n\t🎉"
    return texts + [
        "".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for _ in range(150)
    ]


def test_words_as_the_library_encodes_them():
    known, encoder = library(WORD), bpe.TextBpe(public.path(WORD), cached=200)
    texts = strange_texts()
    found = []
    for at in range(0, len(texts), 40):
        found += encoder.encode(texts[at : at + 40])
    for text, (ids, decoded) in zip(texts, found, strict=True):
        wanted = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert decoded == known.decode(wanted, skip_special_tokens=False)


def test_all_kinds_of_characters_as_the_library_encodes_them():
    # Marks, letters with another case or form, and code points without a character.
    points = [
        c for c in range(0x20000)
        if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))
        or chr(c).lower() != chr(c)
        or unicodedata.category(chr(c)) == "Cn" and (c % 256 < 4 or c < 0x3000)
    ]
    texts = [f"aB{chr(c)}b e{chr(c)}\u0301 {chr(c)}" for c in points]
    known, encoder = library(WORD), bpe.TextBpe(public.path(WORD))
    found = encoder.encode(texts)
    wanted = known.encode_batch(texts, add_special_tokens=False)
    unlike = [
        hex(c) for c, (ids, _), own in zip(points, found, wanted, strict=True)
        if np.frombuffer(ids, "<u4").tolist() != own.ids
    ]
    assert len(points) > 7_000 and not unlike


def test_other_settings_are_refused():
    with open(public.path(WORD), encoding="utf-8") as file:
        spec = json.load(file)
    bpe.check_settings(spec)
    for key, value in (
        ("normalizer", None),
        ("normalizer", {"type": "Sequence", "normalizers": bpe.NORMALIZERS[:2]}),
        ("pre_tokenizer", {"type": "Sequence", "pretokenizers": []}),
        ("decoder", {"type": "BPEDecoder", "suffix": "</w>"}),
    ):
        with pytest.raises(ValueError):
            bpe.check_settings({**spec, key: value})


def test_both_ways_of_merging_agree():
    model = bpe.WordBpe(public.path(WORD))
    draw = random.Random(5)
    words = ["".join(draw.choice("aeiouthnrsl") for _ in range(n)) for n in range(1, 80)]
    tokens, ends = model.encode_words([w.encode() for w in words])
    starts = [0, *ends[:-1]]
    for word, a, b in zip(words, starts, ends, strict=True):
        symbols = list(word.encode())
        symbols[-1] += bpe.WORD_END
        assert tokens[a:b].tolist() == model._merge_long(model.base[symbols].tolist())


def test_bpe_query_columns(odd, odd_rows, none):
    encoded = bpe.bpe_round_trip(odd, public.path(WORD))
    known = library(WORD)
    wanted = []
    for doc_id, text, *_ in odd_rows:
        ids = known.encode(text or "", add_special_tokens=False).ids
        decoded = known.decode(ids, skip_special_tokens=False)
        wanted.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )
        )
    found = [tuple(r) for r in bpe.with_digests(encoded).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert bpe.with_digests(bpe.bpe_round_trip(none, public.path(WORD))).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        hashes = token_shards.mix(np.arange(n), 9)
        index = token_shards.PerfectHash.build(hashes)
        assert sorted(index.slots(hashes).tolist()) == list(range(n))


def shards(tmp_path, docs, **options):
    path = str(tmp_path / "tokens")
    token_shards.write_token_shards(docs, path, public.path(BYTE), **options)
    return path


def expected(rows):
    known = library(BYTE)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found, start = {}, 0
    for doc_id, text, *_ in order:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        found.setdefault(doc_id, []).append((start, len(ids), crc))
        start += len(ids)
    return found


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_shards_round_trip(spark, tmp_path, odd, odd_rows, size):
    path = shards(tmp_path, odd, shard_bytes=size)
    found = token_shards.document_starts(token_shards.read_token_shards(spark, path))
    rows = found.withColumn("crc", F.crc32("ids")).collect()
    assert len(rows) == len(odd_rows)
    wanted = expected(odd_rows)
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.crc))
    for doc_id, parts in wanted.items():
        # Rows of one id may come in any order of their texts.
        assert sorted(p[1:] for p in got[doc_id]) == sorted(p[1:] for p in parts)
        assert min(got[doc_id])[0] == min(parts)[0]


def test_keyed_access(spark, tmp_path, documents):
    docs = documents.select("doc_id", "text")
    path = shards(tmp_path, docs, shard_bytes=60_000)
    wanted = expected([tuple(r) for r in docs.collect()])
    keys = spark.createDataFrame([(0,), (17,), (17,), (10**9,), (-1,), (None,)], "doc_id bigint")
    found = token_shards.lookup_tokens(keys, path).withColumn("crc", F.crc32("ids")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.crc) for r in found) == sorted(
        (k, *wanted[k][0][1:]) for k in (0, 17)
    )


def test_no_shards(spark, tmp_path, none):
    path = shards(tmp_path, none)
    assert token_shards.read_token_shards(spark, path).count() == 0
