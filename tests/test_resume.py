"""Runs that take up where others ended: changed texts, and generators that fail."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.operators.encode import HashedWordEncoder
from citespark.plans import answer_store, encode_changes
from citespark.sources.snapshot import current

ENCODER = partial(HashedWordEncoder, 16)
ROWS = "doc_id bigint, text string"


def counted(folder):
    """Makes encoders that note each text in a folder; local, so that tasks get it by value."""

    def make():
        import os
        import uuid

        encoder = HashedWordEncoder(16)

        def encode_noted(texts):
            for text in texts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                    file.write(text)
            return encoder(texts)

        return encode_noted

    return make


def encode(spark, rows, path, make=ENCODER, **settings):
    df = spark.createDataFrame(rows, ROWS)
    found = encode_changes.encode_changes(df, path, make, "hashed", 16, **settings)
    return {r.doc_id: np.array(r.embedding) for r in found.collect()}


def check(found, rows):
    assert set(found) == {i for i, _ in rows}
    want = HashedWordEncoder(16)([t or "" for _, t in rows])
    for (i, _), vector in zip(rows, want):
        assert np.allclose(found[i], vector, atol=1e-6)


def test_changed_added_and_removed_texts(spark, tmp_path):
    path = str(tmp_path / "v")
    notes = tmp_path / "notes"
    first = [(i, f"text {i}") for i in range(20)] + [(20, None), (21, "")]
    check(encode(spark, first, path), first)
    assert encode_changes.last_run(spark, path) == {
        "added": 22, "changed": 0, "removed": 0, "kept": 0,
    }
    second = [(i, f"text {i}" if i % 5 else f"other {i}") for i in range(15)]
    second += [(20, ""), (30, "new")]
    notes.mkdir()
    check(encode(spark, second, path, counted(str(notes))), second)
    assert encode_changes.last_run(spark, path) == {
        "added": 1, "changed": 3, "removed": 6, "kept": 13,
    }
    asked = sorted(f.read_text() for f in notes.iterdir())
    assert asked == sorted(["other 0", "other 5", "other 10", "new"])
    # A text that comes back, and one that changes again.
    third = [(0, "text 0"), (5, "third"), (19, "text 19")]
    check(encode(spark, third, path), third)
    encode_changes.compact(spark, path)
    found = encode_changes.read_encoded(spark, path).collect()
    check({r.doc_id: np.array(r.embedding) for r in found}, third)
    assert len(current(spark, path)[1]["runs"]) == 1
    check(encode(spark, third, path), third)
    assert encode_changes.last_run(spark, path)["kept"] == 3


def test_many_stale_ids_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(encode_changes, "BROADCAST_IDS", 0)
    path = str(tmp_path / "v")
    encode(spark, [(i, f"a {i}") for i in range(10)], path)
    second = [(i, f"b {i}") for i in range(5)]
    check(encode(spark, second, path), second)


def test_a_failed_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    first = [(1, "a"), (2, "b")]
    encode(spark, first, path)

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        encode(spark, [(1, "c")], path, broken)
    found = encode_changes.read_encoded(spark, path).collect()
    check({r.doc_id: np.array(r.embedding) for r in found}, first)


def test_bad_inputs_of_a_changing_table(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(ValueError, match="more than once"):
        encode(spark, [(1, "a"), (1, "b")], path)
    with pytest.raises(ValueError, match="null"):
        encode(spark, [(None, "a")], path)
    encode(spark, [], path)
    assert encode_changes.read_encoded(spark, path).count() == 0
    df = spark.createDataFrame([(1, "a")], ROWS)
    with pytest.raises(ValueError, match="settings"):
        encode_changes.encode_changes(df, path, ENCODER, "other", 16)


def answering(folder, fails):
    """Makes generators that upper-case prompts, note them, and fail at a marked one if told to."""

    def make():
        import os
        import uuid

        def answer(prompts):
            for _, user in prompts:
                if fails and "bad" in user:
                    raise RuntimeError(f"cannot answer {user}")
            for _, user in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                    file.write(user)
            return [user.upper() for _, user in prompts]

        return answer

    return make


def asked_prompts(spark, users, model="m"):
    rows = spark.createDataFrame([(u,) for u in users], "user string")
    rows = rows.select(F.lit("be brief").alias("system"), "user")
    return rows.withColumn(
        "digest", answer_store.prompt_digest(model, F.col("system"), F.col("user"))
    )


@pytest.mark.parametrize("rows_per_write", [1_000, 7])
def test_a_prompt_is_answered_once_over_a_failed_and_a_second_run(spark, tmp_path, rows_per_write):
    notes = tmp_path / "notes"
    notes.mkdir()
    users = [f"q{i}" for i in range(40)] + ["bad 1", "bad 2"] + ["q3"] * 5
    path = str(tmp_path / "store")
    run = partial(
        answer_store.answers_from_store, asked_prompts(spark, users), path, model_name="m",
        batch_size=2, rows_per_write=rows_per_write,
    )
    with pytest.raises(RuntimeError, match="cannot answer bad"):
        run(make_generator=answering(str(notes), True))
    before = len(list(notes.iterdir()))
    assert 0 < before < 42
    found = run(make_generator=answering(str(notes), False))
    assert sorted(r.answer for r in found.collect()) == sorted(u.upper() for u in set(users))
    asked = sorted(f.read_text() for f in notes.iterdir())
    assert asked == sorted(set(users))
    # Nothing is left to ask.
    again = run(make_generator=answering(str(tmp_path / "none"), True))
    assert again.count() == 42


def test_models_and_prompts_have_digests_of_their_own(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    path = str(tmp_path / "store")
    make = answering(str(notes), False)
    for model in ("a", "b", "a"):
        prompts = asked_prompts(spark, ["x", "y"], model)
        found = answer_store.answers_from_store(prompts, path, make, model)
        assert sorted(r.answer for r in found.collect()) == ["X", "Y"]
    assert len(list(notes.iterdir())) == 4
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc")], "system string, user string")
    digest = answer_store.prompt_digest("m", F.col("system"), F.col("user"))
    assert shifted.select(digest).distinct().count() == 2
