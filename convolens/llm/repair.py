"""Repair the turn structure of conversations by divide and conquer in linear space.

The repaired roles must begin ``(s?(ua)+)?``: an optional system turn, then user and assistant by turns.
An automaton of four states reads that: nothing yet, after the system turn, after a user, after an
assistant. Rows are kept (0), given the role that is due (1) or deleted (2, which blank and repeated rows
must be); a turn with empty text can be inserted anywhere (5); a truncated row that stays costs 5 more.

The cheapest edits are found without a table of all rows: costs from the front and from the back, four
numbers each, meet in the middle; of the states with the least sum the one is crossed whose edits up to
there spell the least, and both halves go on in the same way. To know what spells least, the forward
vector also carries the order of the four spellings, which is enough since two of them never are
beginnings of one another: each ends with the last row before the middle.

A conversation may be longer than a task should hold. Rows are sorted over all tasks and cut into blocks of
at most ``block_rows``; a block's four by four costs and orders are an item of the same search, first over
the blocks of a conversation and then within each block. Only rows' keys and digests take part in this;
texts move once, to meet the edits in order. The SHA-256 of a whole conversation is sequential: one task
reads it as a stream, whatever its length, and holds a batch of it.

Defined cases: a null role or text is one space; a null id is a conversation, a null turn comes first.
Rows of one turn go by role and then by the SHA-256 of role and text; repeated rows are next to each
other, and the first counts. An empty role, and one with another initial, fits nowhere as it is. A
conversation that no row is left of has zeros, no edits and the hash of the empty text. Extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from convolens.llm.text import bounded_batches
from convolens.scale import keep

BLANKS = " \t\n\x0b\f\r"
BLOCK_ROWS = 16_384
DUE = "uuau"                 # by state: the initial of the next turn
AFTER = (2, 2, 3, 2)         # by state: the state after that turn
NAMES = {"u": "user", "a": "assistant"}
INSERTED, DELETED, REROLED, TRUNCATED = 5, 2, 1, 5
LEGAL = {"su", "ua", "au"}
FORCED = 8                   # symbols: place in "uas" or 3, plus 4 if truncated; or this, which must go
ORDER = ["conv_id", "turn", "role", "dig"]


def _inserts(state: int, times: int) -> int:
    for _ in range(times):
        state = AFTER[state]
    return state


def _moves(symbol: int) -> list[list[tuple[int, int, str]]]:
    """By state: (next state, cost, edits) of the cheapest, and of these the least, way over a row."""
    initial, extra = "uas-"[symbol % 4], TRUNCATED * (symbol // 4)
    out = []
    for start in range(4):
        ways: dict[int, tuple[int, str]] = {}

        def offer(state, cost, edits):
            ways[state] = min(ways.get(state, (cost, edits)), (cost, edits))

        for times in range(3):
            state, cost, edits = _inserts(start, times), INSERTED * times, "I" * times
            offer(state, cost + DELETED, edits + "D")
            if symbol == FORCED:
                continue
            offer(AFTER[state], cost + REROLED + extra, edits + "R")
            if initial == DUE[state]:
                offer(AFTER[state], cost + extra, edits + "K")
            if initial == "s" and state == 0:
                offer(1, cost + extra, edits + "K")
        out.append([(state, *way) for state, way in sorted(ways.items())])
    return out


MOVES = [_moves(symbol) for symbol in range(FORCED + 1)]
# By state: what the end of a conversation still needs.
ENDS = ((0, ""), (2 * INSERTED, "II"), (INSERTED, "I"), (0, ""))


def forward(items: list, low: int, high: int, vector: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(cost, order, state) after the items from ``low`` to ``high``; an item: by state, (next, cost, order of the edits)."""
    for at in range(low, high):
        moves, best = items[at], {}
        for cost, order, state in vector:
            for after, more, edits in moves[state]:
                way = (cost + more, order, edits)
                if after not in best or way < best[after]:
                    best[after] = way
        ordered = sorted(best, key=lambda state: best[state][1:])
        vector = [(best[state][0], order, state) for order, state in enumerate(ordered)]
    return vector


def backward(items: list, low: int, high: int, costs: dict[int, int]) -> dict[int, int]:
    """By state before the items: the least cost to the given costs after them."""
    for at in range(high - 1, low - 1, -1):
        before = {}
        for state, moves in enumerate(items[at]):
            ways = [more + costs[after] for after, more, _ in moves if after in costs]
            if ways:
                before[state] = min(ways)
        costs = before
    return costs


def crossings(items: list, entry: int, leave: int) -> list[int]:
    """The state before each item and after the last on the cheapest, least way."""
    states = [entry] + [0] * (len(items) - 1) + [leave] if items else [entry]
    parts = [(0, len(items))]
    while parts:
        low, high = parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        rest = backward(items, middle, high, {states[high]: 0})
        states[middle] = min((cost + rest[state], order, state)
                             for cost, order, state in forward(items, low, middle, [(0, 0, states[low])]) if state in rest)[2]
        parts += [(low, middle), (middle, high)]
    return states


def summary(items: list) -> list[list[tuple[int, int, int]]]:
    """Many items as one: by state, (next state, cost, order)."""
    return [[(state, cost, order) for cost, order, state in forward(items, 0, len(items), [(0, 0, start)])]
            for start in range(4)]


def _space(column: Column | str) -> Column:
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(" "))


def damage(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given the user's role by a checksum of conversation and turn."""
    key = F.concat(_space(conv_column), F.lit(":"), _space(turn_column))
    code = F.crc32(key.cast("binary")) % 20
    coded = rows.select(
        F.col(conv_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        _space(role_column).alias("role"), _space(text_column).alias("text"), code.alias("code")).where("code <> 0")
    return coded.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def named(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dig, which tells rows of a conversation apart by role and text."""
    role, text = _space("role"), _space("text")
    dig = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dig.alias("dig"))


def faults(rows: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text) with its copies: symbol of the first, and what is wrong."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    units = keep(
        rows.select(*ORDER, (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open"))
        .groupBy(*ORDER, "blank", "open").agg(F.count("*").alias("copies")))
    # Of equal texts at several turns: where the first is.
    again = (
        units.groupBy("conv_id", "dig").agg(F.count("*").alias("turns"), F.min("turn").alias("least"),
                                            F.max(F.col("turn").isNull().cast("int")).alias("unnumbered"))
        .where("turns > 1").withColumnsRenamed({"conv_id": "c", "dig": "d"}))
    joined = units.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("dig") == F.col("d")), "left")
    first = F.col("turns").isNull() | F.when(F.col("unnumbered") == 1, F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    return joined.select(
        *ORDER, "copies", initial.alias("initial"),
        F.when(F.col("blank") | ~first, FORCED).otherwise(place + F.when(F.col("open"), 4).otherwise(0)).alias("symbol"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("copies") - first.cast("int")).alias("duplicate"),
        F.when(~F.col("blank") & first & F.col("open"), 1).otherwise(0).alias("truncated"))


BLOCK_NAMES = ["conv_id", "part", "number", "first", "last", "illegal", "extra", "moves", "symbols", "copies", "turns", "roles", "digs"]


def _blocks(block_rows: int):
    """Rows in order as blocks of one conversation each, with what a block is as one item."""
    def run(batches):
        part, number, rows, blocks, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            conv, turns, roles, digs, copies, initials, symbols = zip(*rows)
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(copies) - len(rows)
            return (conv[0], part, number, initials[0], initials[-1], illegal, 2 * (sum(copies) - len(rows)),
                    [[list(way) for way in ways] for ways in summary([MOVES[symbol] for symbol in symbols])],
                    bytes(symbols), copies, turns, roles, digs)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*blocks), types)], names=BLOCK_NAMES)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                     pa.list_(pa.list_(pa.list_(pa.int64()))), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.string()), pa.list_(pa.binary())]
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and (row[0] != rows[0][0] or len(rows) >= block_rows):
                    blocks.append(block())
                    number, size, rows = number + 1, size + len(rows), []
                    if size >= block_rows or len(blocks) >= 1000:
                        yield out()
                        blocks, size = [], 0
                rows.append(row)
        if rows:
            blocks.append(block())
            yield out()
    return run


def _solve(batches):
    """Blocks in order: the state before and after each, the edits after the last, and sums of the conversation."""
    blocks: list = []
    names = ["conv_id", "part", "number", "entry", "leave", "tail", "cost", "illegal"]

    def done():
        items = [[[tuple(way) for way in ways] for ways in block[7]] for block in blocks]
        cost, _, leave = min((cost + ENDS[state][0], order, state)
                             for cost, order, state in forward(items, 0, len(items), [(0, 0, 0)]))
        states = crossings(items, 0, leave)
        cost += sum(block[6] for block in blocks)
        illegal = sum(block[5] for block in blocks) + sum(a[4] + b[3] not in LEGAL for a, b in zip(blocks, blocks[1:]))
        last = len(blocks) - 1
        return [(block[0], block[1], block[2], states[i], states[i + 1], *(
            (ENDS[leave][1], cost, illegal) if i == last else ("", None, None))) for i, block in enumerate(blocks)]

    def out(rows, kind):
        types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    found, kind = [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for block in zip(*(column.to_pylist() for column in batch.columns)):
            if blocks and block[0] != blocks[0][0]:
                found += done()
                blocks = []
                if len(found) > 1000:
                    yield out(found, kind)
                    found = []
            blocks.append(block)
    if blocks:
        found += done()
    if found:
        yield out(found, kind)


def _rebuild(batches):
    """Per block its audit, and the rows that stay or have turns inserted before them."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for conv, part, number, entry, leave, tail, symbols, copies, turns, roles, digs in zip(
                *(column.to_pylist() for column in batch.columns)):
            items = [MOVES[symbol] for symbol in symbols]
            states, audit, plan = crossings(items, entry, leave), [], []
            for i, moves in enumerate(items):
                state = states[i]
                edits = next(edits for after, _, edits in moves[state] if after == states[i + 1])
                before, kept = "", None
                for edit in edits:
                    if edit == "I":
                        before += DUE[state]
                    elif edit != "D":
                        kept = NAMES[DUE[state]] if edit == "R" else roles[i]
                    state = AFTER[state] if edit == "I" else state
                audit.append(edits + "D" * (copies[i] - 1))
                if before or kept is not None:
                    plan.append((turns[i], roles[i], digs[i], False, before, kept))
            if tail:
                state, before = leave, ""
                for _ in tail:
                    before, state = before + DUE[state], AFTER[state]
                plan.append((None, None, None, True, before, None))
            for column, value in zip(out, (conv, part, number, "".join(audit) + tail, plan)):
                column.append(value)
        entry_type = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("dig", pa.binary()), ("ending", pa.bool_()),
                                ("before", pa.string()), ("kept", pa.string())])
        types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.list_(entry_type)]
        yield pa.RecordBatch.from_arrays([
            pa.array([[dict(zip([f.name for f in entry_type], p)) for p in v] for v in column] if i == 4 else column, t)
            for i, (column, t) in enumerate(zip(out, types))], names=["conv_id", "part", "number", "audit", "plan"])


def plans(units: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Per conversation cost and illegal, at its last block; per block audit and plan."""
    kind = units.schema["conv_id"].dataType.simpleString()
    blocks = keep(
        units.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*ORDER, "copies", "initial", "symbol")
        .mapInArrow(_blocks(block_rows), f"conv_id {kind}, part int, number int, first string, last string, illegal long, "
                    "extra long, moves array<array<array<bigint>>>, symbols binary, copies array<long>, turns array<long>, "
                    "roles array<string>, digs array<binary>"))
    solved = keep(
        blocks.select("conv_id", "part", "number", "first", "last", "illegal", "extra", "moves")
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
        .mapInArrow(_solve, f"conv_id {kind}, part int, number int, entry int, leave int, tail string, cost long, illegal long"))
    at = solved.select("part", "number", "entry", "leave", "tail")     # a block's numbers name it
    pieces = keep(
        blocks.select("conv_id", "part", "number", "symbols", "copies", "turns", "roles", "digs").join(at, ["part", "number"])
        .select("conv_id", "part", "number", "entry", "leave", "tail", "symbols", "copies", "turns", "roles", "digs")
        .mapInArrow(_rebuild, f"conv_id {kind}, part int, number int, audit string, plan array<struct<turn: bigint, "
                    "role: string, dig: binary, ending: boolean, before: string, kept: string>>"))
    return solved.where("cost IS NOT NULL").select("conv_id", "cost", "illegal"), pieces


def _meeting(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Edits and texts under one order: an edit comes just before the rows it is about."""
    planned = pieces.select("conv_id", F.explode("plan").alias("p")).select(
        "conv_id", "p.ending", "p.turn", "p.role", "p.dig", F.lit(0).alias("kind"), "p.before", "p.kept", F.lit(None).cast("string").alias("text"))
    texts = rows.select(
        "conv_id", F.lit(False).alias("ending"), "turn", "role", "dig", F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("kept"), "text")
    return planned.union(texts)


MEETING = ["conv_id", "ending", "turn", "role", "dig"]


def _turns(batches):
    """(conv_id, turn, role, text) of the repaired turns, in order; (conv_id, None, None, None) where a conversation begins."""
    conv, begun, waiting = None, False, None
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if not begun or row[0] != conv:
                conv, begun, waiting = row[0], True, None
                yield conv, None, None, None
            key, kind, before, kept, text = row[:5], *row[5:]
            if kind == 0:
                for initial in before:
                    yield conv, None, NAMES[initial], ""
                waiting = (key, kept) if kept is not None else None
            elif waiting and waiting[0] == key:
                yield conv, row[2], waiting[1], text
                waiting = None


def _written(batches):
    part, kind = TaskContext.get().partitionId(), None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [
            kind, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()])],
            names=["conv_id", "part", "place", "turn", "role", "text"])

    rows, place, size = [], 0, 0
    for conv, turn, role, text in _turns(typed()):
        if role is None:
            continue
        place, size = place + 1, size + len(text)
        rows.append((conv, part, place, turn, role, text))
        if len(rows) >= 1000 or size > 4 << 20:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def repaired_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, part, place, turn, role, text of the turns after repair, in order of part and place; no turn if inserted."""
    bounded_batches(rows.sparkSession)
    rows = named(rows)
    _, pieces = plans(faults(rows), block_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    met = _meeting(rows, pieces).repartitionByRange(*MEETING).sortWithinPartitions(*MEETING, "kind")
    return met.mapInArrow(_written, f"conv_id {kind}, part int, place long, turn long, role string, text string")


def _hashed(batches):
    """The SHA-256 of each conversation, read as a stream."""
    kind, rows = None, []

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1].hexdigest() for r in rows])],
                                          names=["conv_id", "repaired_sha256"])

    for conv, _, role, text in _turns(typed()):
        if role is None:
            if len(rows) > 1000:
                yield out()
                rows = []
            rows.append((conv, hashlib.sha256()))
            empty = True
            continue
        rows[-1][1].update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False
    if rows:
        yield out()


def audit(original: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``original``: what is wrong with its ``rows``, the edits and what they lead to."""
    bounded_batches(rows.sparkSession)
    rows = named(rows)
    units = keep(faults(rows))
    sums, pieces = plans(units, block_rows)
    counts = units.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")))
    audits = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "number", "audit"))).alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = (_meeting(rows, pieces).repartition("conv_id").sortWithinPartitions(*MEETING, "kind")
              .mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string"))
    out = original.select("conv_id").distinct()
    for found in (counts, sums, audits, hashes):
        found = found.withColumnRenamed("conv_id", "c")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
