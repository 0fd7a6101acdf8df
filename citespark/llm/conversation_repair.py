"""Cheapest repair of conversations whose roles must alternate.

A conversation is right when its role initials read ``(s?(ua)+)?``. Turns are
kept, given another role, deleted, or empty ones inserted. All ways to do so
form a DAG whose nodes are (turns handled, state), and the weight of a way is
one integer: the cost in the high digits, then one three-bit digit per edit,
the first edit in the highest place and zeros behind the last. The smallest
integer is the cheapest repair, and of equally cheap ones that whose letters
come first in ASCII.

Long conversations are divided into blocks. The weights from each state to each
state over a block are a small table, and tables are joined like matrices. That
is exact: two ways over the same turns at one cost differ in a letter before
either ends, because what one has more could only be insertions, which cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import stored, whole_groups

#: Costs of the edits; a kept or reroled truncated turn costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Digits of the edits, in ASCII order of their letters.
LETTERS = "\0DIKR"
D, I, K, R = 1, 2, 3, 4
DIGIT = 3
#: States: nothing yet, after s, after u, after a. What may follow each.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: Edits that end a conversation from each state.
ENDING = ("", "II", "I", "")
SPACE = " \t\n\v\f\r"
FAULTS = ("blank", "duplicate", "truncated")

#: Turns of a block.
BLOCK = 512
#: Longer conversations than this, or than a HOT_SHARE of all turns, are dealt over tasks.
HOT_TURNS = 4_096
HOT_BYTES = 16 << 20
HOT_SHARE = 1 << 18

Turn = tuple[str, str | None]  # initial of the role, fault


def moved(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    if state == START and initial == "s":
        return AFTER_S
    return NEXT[state] if initial == ("a" if state == AFTER_U else "u") else None


def weight(cost: int, letters: str, slots: int) -> int:
    """A cost and letters as one integer with room for ``slots`` letters."""
    digits = 0
    for letter in letters:
        digits = digits << DIGIT | LETTERS.index(letter)
    return cost << DIGIT * slots | digits << DIGIT * (slots - len(letters))


def letters_of(value: int, slots: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    digits = value & (1 << DIGIT * slots) - 1
    text = oct(digits | 1 << DIGIT * slots)[3:]
    return value >> DIGIT * slots, text.rstrip("0").translate(str.maketrans("1234", LETTERS[1:]))


def least_weights(turns: list[Turn], ends: list[int | None], slots: int) -> list[int | None]:
    """Least weight from each state before ``turns`` to the ``ends`` behind them.

    ``ends`` has the weights of what follows, by state, with as many slots.
    At most two insertions stand before a turn: three would return to a state.
    """
    high, mask = DIGIT * slots, (1 << DIGIT * slots) - 1

    def before(value: int | None, cost: int, digit: int) -> int | None:
        if value is None:
            return None
        return (value >> high) + cost << high | digit << high - DIGIT | (value & mask) >> DIGIT

    def least(values: list[int | None]) -> int | None:
        return min((v for v in values if v is not None), default=None)

    for initial, fault in reversed(turns):
        more = TRUNCATED if fault == "truncated" else 0
        direct = []
        for state in range(4):
            ways = [before(ends[state], DELETE, D)]
            if fault not in ("blank", "duplicate"):
                after = moved(state, initial)
                if after is not None:
                    ways.append(before(ends[after], more, K))
                ways.append(before(ends[NEXT[state]], REROLE + more, R))
            direct.append(least(ways))
        once = [least([direct[s], before(direct[NEXT[s]], INSERT, I)]) for s in range(4)]
        ends = [least([direct[s], before(once[NEXT[s]], INSERT, I)]) for s in range(4)]
    return ends


def block_table(turns: list[Turn]) -> tuple[int, list[int | None]]:
    """Slots, and the least weights from state p to state q at place 4 * p + q."""
    slots = 3 * len(turns)
    columns = [
        least_weights(turns, [0 if state == q else None for state in range(4)], slots)
        for q in range(4)
    ]
    return slots, [columns[q][p] for p in range(4) for q in range(4)]


END_TABLE = (
    2,
    [
        weight(INSERT * len(ENDING[p]), ENDING[p], 2) if q == START else None
        for p in range(4)
        for q in range(4)
    ],
)


def joined_tables(left: tuple, right: tuple) -> tuple[int, list[int | None]]:
    """Least weights over one stretch and the next."""
    (n, a), (m, b) = left, right

    def end_to_end(x: int | None, y: int | None) -> int | None:
        if x is None or y is None:
            return None
        digits = x & (1 << DIGIT * n) - 1
        # Slots left free behind the letters of x, whose digits aren't zero.
        free = ((digits & -digits).bit_length() - 1) // DIGIT if digits else n
        tail = (y & (1 << DIGIT * m) - 1) << DIGIT * free
        cost = (x >> DIGIT * n) + (y >> DIGIT * m)
        return cost << DIGIT * (n + m) | digits << DIGIT * m | tail

    table = []
    for p in range(4):
        for q in range(4):
            ways = [end_to_end(a[4 * p + r], b[4 * r + q]) for r in range(4)]
            table.append(min((w for w in ways if w is not None), default=None))
    return n + m, table


def cheapest(tables: list[tuple]) -> tuple[int, str]:
    """Cost and letters over all stretches, joined in pairs."""
    tables = [*tables, END_TABLE]
    while len(tables) > 1:
        paired = [joined_tables(*tables[i : i + 2]) for i in range(0, len(tables) - 1, 2)]
        tables = paired + tables[2 * len(paired) :]
    slots, table = tables[0]
    return letters_of(table[4 * START + START], slots)


def cheapest_edits(turns: list[Turn]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of a conversation."""
    if len(turns) <= BLOCK:
        slots = 3 * len(turns) + 2
        ends = [weight(INSERT * len(e), e, slots) for e in ENDING]
        return letters_of(least_weights(turns, ends, slots)[START], slots)
    return cheapest([block_table(turns[i : i + BLOCK]) for i in range(0, len(turns), BLOCK)])


def repaired(
    rows: list[tuple[str, str]], letters: str, state: int
) -> tuple[list[tuple[str, str]], int]:
    """The turns that the edits leave from ``state`` on, and the state behind them."""
    kept = []
    at = 0
    for letter in letters:
        role, text = (NEXT_ROLE[state], "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "R":
            role = NEXT_ROLE[state]
        state = moved(state, role[:1])
        kept.append((role, text))
    return kept, state


def fault_of(text: str, seen: bool) -> str | None:
    body = text.rstrip(SPACE)
    if not body:
        return "blank"
    if seen:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
PIECE = (
    f"conv_id bigint, piece int, pieces int, {COUNTS}, audit string, "
    "turns array<struct<role: string, text: string>>"
)
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _as_turns(kept: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in kept]


def _in_order(rows: DataFrame) -> list:
    """Turn by turn, null turns first; ties by role and the digest of the text."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _whole(rows: DataFrame) -> DataFrame:
    """Pieces of conversations that a task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["missing", "conv"]):
            held: dict[tuple, list] = {}
            keys = zip(table.column("missing").to_pylist(), table.column("conv").to_pylist())
            values = zip(
                *(table.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True
            )
            for key, row in zip(keys, values, strict=True):
                held.setdefault(key, []).append(row)
            out = []
            for (missing, conv), conversation in held.items():
                seen: set[tuple[str, str]] = set()
                turns = []
                for _, role, text in conversation:
                    turns.append((role[:1], fault_of(text, (role, text) in seen)))
                    seen.add((role, text))
                cost, audit = cheapest_edits(turns)
                kept, _ = repaired([(role, text) for _, role, text in conversation], audit, START)
                numbers = {turn for turn, _, _ in conversation if turn is not None}
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                faults = [sum(f == fault for _, f in turns) for fault in FAULTS]
                illegal = illegal_pairs([initial for initial, _ in turns])
                out.append(
                    (None if missing else conv, 0, 1, gaps, *faults, illegal, cost, audit,
                     _as_turns(kept))
                )
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), TURNS]
            names = [part.split()[0] for part in f"conv_id x, piece x, pieces x, {COUNTS}".split(", ")]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[*names, "audit", "turns"],
            )

    sorted_rows = (
        rows.select(
            F.col("conv_id").isNull().cast("int").alias("missing"),
            F.coalesce("conv_id", F.lit(0)).alias("conv"),
            "turn", "role", "text", "digest",
        )
        .repartition("missing", "conv")
        .sortWithinPartitions("missing", "conv", *_in_order(rows))
        .drop("digest")
    )
    return sorted_rows.mapInArrow(run, PIECE)


def _ints(values: list[int | None]) -> list[bytes | None]:
    return [None if v is None else v.to_bytes(v.bit_length() // 8 + 1, "little") for v in values]


def _dealt(rows: DataFrame) -> DataFrame:
    """Pieces of conversations that are dealt over tasks in blocks of turns.

    ``rows`` has ``conv``, a number of its own for each conversation. Turns are
    range-sorted and numbered; a block is BLOCK neighbours of a range. One task
    per conversation sees the tables of its blocks, no texts.
    """
    spark = rows.sparkSession
    order = ["conv", *_in_order(rows), "copy"]
    placed = stored(
        rows.withColumn("copy", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", "digest",
                F.monotonically_increasing_id().alias("uid")),
        "long-conversations",
    ).withColumn("block", F.floor(F.col("uid") / BLOCK).cast("bigint"))
    first = placed.groupBy("conv", "role", "digest").agg(F.min("uid").alias("uid"))
    first = first.select("uid", F.lit(True).alias("first"))
    body = F.rtrim(F.translate("text", "\t\n\u000b\u000c\r", "     "))
    own = placed.select(
        "conv", "block", "uid", F.substring("role", 1, 1).alias("initial"),
        F.when(body == "", "blank")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated").alias("own"),
    )
    # Each turn number is unique: no key of this join is hot.
    marked = own.join(first, "uid", "left").select(
        "conv", "block", "uid", "initial",
        F.when(F.col("first") | (F.col("own") == "blank"), F.col("own"))
        .otherwise("duplicate").alias("fault"),
    )

    def tabulate(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        initials = table.column("initial").to_pylist()
        faults = table.column("fault").to_pylist()
        slots, weights = block_table(list(zip(initials, faults, strict=True)))
        return pa.table(
            {
                "conv": pa.array([key[0].as_py()], pa.int64()),
                "block": pa.array([key[1].as_py()], pa.int64()),
                "initials": pa.array([initials], pa.list_(pa.string())),
                "faults": pa.array([[sum(f == x for f in faults) for x in FAULTS]],
                                   pa.list_(pa.int64())),
                "slots": pa.array([slots], pa.int32()),
                "weights": pa.array([_ints(weights)], pa.list_(pa.binary())),
            }
        )

    tables = marked.groupBy("conv", "block").applyInArrow(
        tabulate,
        "conv bigint, block bigint, initials array<string>, faults array<bigint>, slots int, "
        "weights array<binary>",
    )

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.sort_by("block").to_pylist()
        cost, audit = cheapest(
            [
                (b["slots"], [w if w is None else int.from_bytes(w, "little") for w in b["weights"]])
                for b in blocks
            ]
        )
        initials = [i for b in blocks for i in b["initials"]]
        pieces, states, at, state = [], [], 0, START
        for number, block in enumerate(blocks):
            start, left = at, len(block["initials"])
            while left:
                left -= audit[at] != "I"
                at += 1
            if number == len(blocks) - 1:
                at = len(audit)
            pieces.append(audit[start:at])
            states.append(state)
            rows = [(i, "") for i in block["initials"]]
            _, state = repaired(rows, pieces[-1], state)
        n = len(blocks)
        totals = [sum(b["faults"][f] for b in blocks) for f in range(len(FAULTS))]
        return pa.table(
            {
                "conv": pa.array([key[0].as_py()] * n, pa.int64()),
                "block": pa.array([b["block"] for b in blocks], pa.int64()),
                "piece": pa.array(range(n), pa.int32()),
                "pieces": pa.array([n] * n, pa.int32()),
                **{
                    name: pa.array([total] * n, pa.int64())
                    for name, total in zip(FAULTS, totals, strict=True)
                },
                "illegal": pa.array([illegal_pairs(initials)] * n, pa.int64()),
                "cost": pa.array([cost] * n, pa.int64()),
                "audit": pa.array(pieces, pa.string()),
                "state": pa.array(states, pa.int32()),
            }
        )

    edits = tables.groupBy("conv").applyInArrow(
        compose,
        "conv bigint, block bigint, piece int, pieces int, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint, cost bigint, audit string, state int",
    )

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        turns = left.sort_by("uid")
        rows = list(zip(turns.column("role").to_pylist(), turns.column("text").to_pylist(),
                        strict=True))
        edit = right.to_pylist()[0]
        kept, _ = repaired(rows, edit["audit"], edit["state"])
        return right.drop_columns(["state", "block"]).append_column(
            "turns", pa.array([_as_turns(kept)], TURNS)
        )

    turns = placed.select("conv", "block", "uid", "role", "text")
    done = (
        turns.groupBy("conv", "block")
        .cogroup(edits.groupBy("conv", "block"))
        .applyInArrow(
            apply,
            "conv bigint, piece int, pieces int, blank bigint, duplicate bigint, truncated bigint, "
            "illegal bigint, cost bigint, audit string, "
            "turns array<struct<role: string, text: string>>",
        )
    )
    spans = placed.groupBy("conv").agg(
        F.coalesce(
            F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)
        ).alias("gaps")
    )
    return done.join(F.broadcast(spans), "conv")


def repair_conversations(
    turns: DataFrame, hot_turns: int = HOT_TURNS, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Cheapest repair of every conversation in ``turns`` (conv_id, turn, role, text).

    Returns conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal,
    cost, audit, turns. An ordinary conversation is one piece. One with more
    than ``hot_turns`` turns or ``hot_bytes`` of text (and 1 / HOT_SHARE of all)
    is dealt over tasks and comes in pieces, whose audits and turns follow each
    other; the counts and the cost are the conversation's in each.

    A null role or text is one space. A null conv_id is one conversation; null
    turn numbers come first. Ties of a turn number are ordered by role and by
    the SHA-256 of the text, so copies stay adjacent. An empty role has no
    initial and may not be kept. Other columns are ignored; an empty table gives
    no row.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    sizes = stored(
        rows.groupBy("conv_id").agg(
            F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")
        ),
        "conversations",
    )
    all_turns, all_bytes = sizes.agg(F.sum("n"), F.sum("size")).first()
    # At most two times HOT_SHARE conversations exceed their share.
    hot = sizes.filter(
        (F.col("n") > max(hot_turns, (all_turns or 0) // HOT_SHARE))
        | (F.col("size") > max(hot_bytes, (all_bytes or 0) // HOT_SHARE))
    ).select(F.col("conv_id").alias("hot_id"))
    hot = stored(hot.withColumn("conv", F.monotonically_increasing_id()), "long")
    if hot.isEmpty():
        return _whole(rows)
    same = F.col("conv_id").eqNullSafe(F.col("hot_id"))
    cold = rows.join(F.broadcast(hot), same, "left_anti")
    dealt = _dealt(rows.join(F.broadcast(hot), same).drop("hot_id", "conv_id"))
    pieces = _whole(cold)
    named = dealt.join(F.broadcast(hot), "conv").withColumnRenamed("hot_id", "conv_id")
    return pieces.unionByName(named.select(*pieces.columns))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults: the CRC-32 of ``conv_id:turn`` modulo 20 chooses.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4
    makes it the user's. Nulls are one space, in the key too.
    """
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return (
        conversations.withColumn("_code", code)
        .filter(F.col("_code") != 0)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_code") == 4, "user")
            .otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("_code") == 1, "")
            .when(F.col("_code") == 2, F.translate(text, ".!?", ""))
            .otherwise(text).alias("text"),
            F.when(F.col("_code") == 3, F.array(F.lit(1), F.lit(2)))
            .otherwise(F.array(F.lit(1))).alias("_copies"),
        )
        .select("conv_id", "turn", "role", "text", F.explode("_copies").alias("_copy"))
        .drop("_copy")
    )


def with_digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, repaired_sha256.

    The digest is that of the lines ``role:text``. Conversations in pieces are
    read piece by piece, so a task holds the letters of one and a piece of its text.
    """
    names = ["conv_id", *[part.split()[0] for part in COUNTS.split(", ")], "audit"]
    lines = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"
    )
    whole = pieces.filter("pieces = 1").select(*names, F.sha2(lines, 256).alias("repaired_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, letters, empty = None, None, [], True

        def done() -> pa.RecordBatch:
            found = {**row, "audit": "".join(letters), "repaired_sha256": state.hexdigest()}
            return pa.RecordBatch.from_pylist([found], schema=out)

        out = pa.schema(
            [(n, pa.int64()) for n in names[:-1]]
            + [("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["piece"] == 0:
                    if row is not None:
                        yield done()
                    row = {n: piece[n] for n in names[:-1]}
                    state, letters, empty = hashlib.sha256(), [], True
                letters.append(piece["audit"])
                if piece["n_turns"]:
                    state.update(("" if empty else "\n").encode() + piece["lines"].encode())
                    empty = False
        if row is not None:
            yield done()

    parts = (
        pieces.filter("pieces > 1")
        .select(*names, "piece", F.size("turns").alias("n_turns"), lines.alias("lines"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "piece")
        .mapInArrow(digest, f"conv_id bigint, {COUNTS}, audit string, repaired_sha256 string")
    )
    return whole.unionByName(parts)


def crc_sql(text: str, table: str) -> str:
    """CRC-32 of a list of bytes in SQL, from the list ``table``."""
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {text}), lambda c, b: {step}), 4294967295)"


CRC_TABLE_SQL = (
    "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
    "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)


def sql() -> str:
    """DuckDB SQL of the query: the same repair as least strings of cost and letters."""

    def edit(value: str, cost: str, letter: str) -> str:
        return (
            f"CASE WHEN {value} = '~' THEN '~' ELSE "
            f"lpad(CAST(CAST({value}[:9] AS INT) + {cost} AS VARCHAR), 9, '0') "
            f"|| {value}[10:] || '{letter}' END"
        )

    def inserted(a: str) -> str:
        to_u = ", ".join(edit(f"{a}[{i}]", "2", "I") for i in (1, 2, 4))
        return f"[{a}[1], {a}[2], least({a}[3], {to_u}), least({a}[4], {edit(f'{a}[3]', '2', 'I')})]"

    def both(name: str, inner: str) -> str:
        """``inner`` with the list ``name`` after none, one or two insertions."""
        return (
            f"list_transform([a], lambda a0: list_transform([{inserted('a0')}], lambda a1: "
            f"list_transform([{inserted('a1')}], lambda {name}: {inner})[1])[1])[1]"
        )

    def onto(sources: tuple[int, ...], initial: str, reroled: bool) -> str:
        more = "CASE WHEN x[2] = 'truncated' THEN 1 ELSE 0 END"
        ways = []
        for i in sources:
            ways.append(f"CASE WHEN x[1] = '{initial}' THEN {edit(f'b[{i}]', more, 'K')} ELSE '~' END")
            if reroled:
                ways.append(edit(f"b[{i}]", f"2 + {more}", "R"))
        fixed = "x[2] IN ('blank', 'duplicate')"
        return f"CASE WHEN {fixed} THEN '~' ELSE least({', '.join([*ways, repr('~')])}) END"

    after = (
        f"[{edit('b[1]', '3', 'D')}, "
        f"least({edit('b[2]', '3', 'D')}, {onto((1,), 's', False)}), "
        f"least({edit('b[3]', '3', 'D')}, {onto((1, 2, 4), 'u', True)}), "
        f"least({edit('b[4]', '3', 'D')}, {onto((3,), 'a', True)})]"
    )
    step = both("b", after)
    end = both("b", "least(b[1], b[4])")
    return f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS t),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT))", "t")} % 20 AS code
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
body AS (
  SELECT *, rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM body),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_prepend(['000000000', '~', '~', '~'], list([role[1], fault] ORDER BY pos)),
      lambda a, x: {step}) AS a
  FROM marked GROUP BY conv_id),
solved AS (SELECT *, {end} AS best FROM grouped),
letters AS (
  SELECT conv_id, unnest(range(1, len(best) - 8)) AS i, best[9 + i] AS letter FROM solved),
numbered AS (
  SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER w AS pos, sum(CAST(letter <> 'D' AS INT)) OVER w AS e
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
joined AS (
  SELECT n.*, m.role, m.text, max(CAST(e = 1 AND letter = 'K' AND m.role[1] = 's' AS INT))
    OVER (PARTITION BY n.conv_id) AS has_s
  FROM numbered n LEFT JOIN marked m ON n.conv_id IS NOT DISTINCT FROM m.conv_id
    AND n.pos = m.pos AND letter <> 'I'
  WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (e + has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS digest
  FROM joined GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(best[:9] AS BIGINT), 0) AS cost,
  coalesce(best[10:], '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""
