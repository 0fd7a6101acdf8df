"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import zlib

import pytest

from citespark.llm import conversation_repair as repair

ROWS = "conv_id bigint, turn bigint, role string, text string"


def slow_edits(turns):
    """Cheapest (cost, letters) by trying sequences in order of cost and letters."""
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        entry = heapq.heappop(heap)
        cost, letters, at, state = entry
        if at == len(turns) and state in (0, 3):
            return cost, letters
        if entry in seen or cost > 3 * len(turns):
            continue
        seen.add(entry)
        turned = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 2, letters + "I", at, turned))
        if at == len(turns):
            continue
        initial, fault = turns[at]
        heapq.heappush(heap, (cost + 3, letters + "D", at + 1, state))
        if fault in ("blank", "duplicate"):
            continue
        more = int(fault == "truncated")
        if (state, initial) in follows:
            heapq.heappush(heap, (cost + more, letters + "K", at + 1, follows[state, initial]))
        heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, turned))
    raise AssertionError("deleting all is always possible")


def slow_result(rows):
    """What the query returns for the rows of one conversation after damage."""
    order = sorted(
        rows,
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()),
    )
    seen, turns = set(), []
    for _, role, text in order:
        body = text.strip(" \t\n\v\f\r")
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        turns.append((role[:1], fault))
    cost, audit = slow_edits(turns)
    lines, at = [], 0
    has_s = False
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        expected = "assistant" if (len(lines) - has_s) % 2 else "user"
        role, text = (expected, "") if letter == "I" else order[at][1:]
        at += letter != "I"
        if letter == "R":
            role = expected
        has_s |= not lines and role[0] == "s"
        lines.append(f"{role}:{text}")
    numbers = {t for t, _, _ in order if t is not None}
    initials = [t[0] for t in turns]
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *[sum(f == kind for _, f in turns) for kind in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(rows):
    def shown(value):
        return " " if value is None else str(value)

    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def conversations(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "Why", "", " \n", None, "Été?", "a b. "])
            rows.append((conv, draw.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


def by_id(found):
    return {row[0]: tuple(row)[1:] for row in found.collect()}


def expected(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in damaged(rows):
        groups[conv].append(tuple(row))
    return {conv: slow_result(group) for conv, group in groups.items()}


def query(spark, rows, tmp_path, more=()):
    from citespark.llm.queries import op11_conversation_repair

    spark.createDataFrame(rows, ROWS).selectExpr("*", *more).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    found = op11_conversation_repair(spark, str(tmp_path))
    assert found.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    return by_id(found)


def test_edits_equal_a_search_over_all_sequences():
    draw = random.Random(1)
    for _ in range(300):
        turns = [
            (draw.choice("suax "), draw.choice([None, None, "blank", "duplicate", "truncated"]))
            for _ in range(draw.randrange(7))
        ]
        want = slow_edits(turns)
        assert repair.cheapest_edits(turns) == want
        a, b = sorted(draw.choices(range(len(turns) + 1), k=2))
        parts = (turns[:a], turns[a:b], turns[b:])
        assert repair.cheapest([repair.block_table(p) for p in parts]) == want


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations(3, 60, 8)
    more = [f"'x' AS {n}" for n in ("digest", "conv", "copy", "block", "uid", "piece", "audit")]
    assert query(spark, rows, tmp_path, more) == expected(rows)


def test_dealt_conversations_are_repaired_alike(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 2)
    rows = conversations(4, 25, 8)
    turns = spark.createDataFrame(damaged(rows), ROWS)
    found = by_id(repair.with_digests(repair.repair_conversations(turns, hot_turns=3)))
    want = {c: r for c, r in expected(rows).items() if any(d[0] == c for d in damaged(rows))}
    assert found == want


def test_long_conversation_by_blocks():
    draw = random.Random(5)
    turns = [(draw.choice("sua"), draw.choice([None, None, "blank"])) for _ in range(1_300)]
    whole = 3 * len(turns) + 2
    ends = [repair.weight(2 * len(e), e, whole) for e in repair.ENDING]
    direct = repair.letters_of(repair.least_weights(turns, ends, whole)[0], whole)
    assert repair.cheapest_edits(turns) == direct


def test_all_rows_dropped_and_empty_table(spark, tmp_path):
    gone = next(
        c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0
    )
    found = query(spark, [(gone, 0, "user", "Hi.")], tmp_path)
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_very_long_text(spark):
    text = "word " * 400_000 + "."
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], ROWS)
    (row,) = repair.with_digests(repair.repair_conversations(turns)).collect()
    lines = f"user:{text}\nassistant:{text}"
    assert row.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    (dealt,) = repair.with_digests(repair.repair_conversations(turns, hot_bytes=1_000)).collect()
    assert dealt == row


def test_order_of_letters():
    assert repair.cheapest_edits([("u", None), ("u", None)]) == (2, "KR")
    # Two insertions cost as much as two other roles; the letters decide.
    assert repair.cheapest_edits([("a", None), ("u", None)]) == (4, "IKKI")
    assert repair.cheapest_edits([("s", None)]) == (3, "D")
    assert repair.cheapest_edits([]) == (0, "")
    with pytest.raises(ValueError):
        repair.weight(1, "X", 3)
