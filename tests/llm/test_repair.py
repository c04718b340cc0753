import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from convolens.llm import repair
from convolens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
WORDS = "[^\x20\x09-\x0D]"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def slow(original, rows):
    """The cheapest edits by remembering, for every row and every beginning of roles, the whole rest."""
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        kinds, seen = [], set()
        for turn, role, text in mine:
            kinds.append("blank" if not re.search(WORDS, text) else "duplicate" if (role, text) in seen
                         else "truncated" if re.findall(WORDS, text)[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(at, state, inserted):
            """(cost, edits, turns) from here; states: what the roles so far end with."""
            due = "assistant" if state == "u" else "user"
            ways = [(0, "", ())] if at == len(mine) and state in ("", "a") else []
            if inserted < 3:
                cost, edits, turns = best(at, due[0], inserted + 1)
                ways.append((cost + 5, "I" + edits, ((due, ""),) + turns))
            if at < len(mine):
                _, role, text = mine[at]
                cost, edits, turns = best(at + 1, state, 0)
                ways.append((cost + 2, "D" + edits, turns))
                if kinds[at] not in ("blank", "duplicate"):
                    more = 5 if kinds[at] == "truncated" else 0
                    cost, edits, turns = best(at + 1, due[0], 0)
                    ways.append((cost + 1 + more, "R" + edits, ((due, text),) + turns))
                    if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                        cost, edits, turns = best(at + 1, role[:1], 0)
                        ways.append((cost + more, "K" + edits, ((role, text),) + turns))
            return min(ways, default=(10 ** 6, "", ()))

        for at in range(len(mine), 0, -1):      # from the back, so that no call goes deep
            for state in "sua":
                best(at, state, 0)
        cost, edits, turns = best(0, "", 0)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
        numbers = [t for t, _, _ in mine if t is not None]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
                     *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
                     cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn + (r.random() < 0.1), r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "Utah"]),
                         r.choice(["Yes.", "No!", "Why?", "so", "and then", " ", "", None, "Good. \n", "Ünd 日本.", f"t{turn}."])))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA).repartition(parts)


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


ODD = [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (None, None, None, None), (9000, None, "user", "a."),
       (9001, 3, "", "a."), (9001, 3, "", "a."), (9001, 3, "user", "b."), (9001, 3, "user", "a."), (9002, 5, "system", "x."),
       (9003, 1, "user", "word " * 100_000 + "."), (9003, 2, "assistant", " " * 200_000)]


@pytest.mark.parametrize("block_rows", [16_384, 2])
def test_equals_brute_force(spark, block_rows):
    rows = conversations(1) + ODD
    df = frame(spark, rows)
    got = found(repair.audit(df, df, block_rows))
    expected = slow(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert got == expected
    damaged = slow_damage(rows)
    got = found(repair.audit(df, repair.damage(df), block_rows))
    assert got == slow(rows, damaged) and set(got) == {r[0] for r in rows}


def test_long_conversation_in_many_blocks(spark):
    r = random.Random(4)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), f"{r.choice('abcdefgh')}{r.randrange(60)}{r.choice('.! ')}") for i in range(400)]
    rows += [(1, 500, "user", "same.")] * 40
    df = frame(spark, rows, 8)
    expected = slow(rows, rows)
    for block_rows in (7, 64):
        assert found(repair.audit(df, df, block_rows)) == expected


def test_turns_agree_with_the_hash(spark):
    rows = conversations(2, 30) + ODD
    df = frame(spark, rows)
    turns: dict = {}
    for r in repair.repaired_turns(df, 3).orderBy("part", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, (*_, digest) in found(repair.audit(df, df)).items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == digest


def test_crossing_equals_whole_table():
    """Halving finds the way that all remembered spellings give, for any entry and exit."""
    r = random.Random(3)
    for _ in range(300):
        symbols = [r.randrange(9) for _ in range(r.randrange(1, 12))]
        items = [repair.MOVES[s] for s in symbols]
        ways = {0: (0, "")}
        for moves in items:
            after: dict = {}
            for state, (cost, edits) in ways.items():
                for to, more, letters in moves[state]:
                    after[to] = min(after.get(to, (10 ** 9, "")), (cost + more, edits + letters))
            ways = after
        for leave, (cost, edits) in ways.items():
            states = repair.crossings(items, 0, leave)
            steps = [next(w for w in m[a] if w[0] == b) for m, a, b in zip(items, states, states[1:])]
            assert (sum(w[1] for w in steps), "".join(w[2] for w in steps)) == (cost, edits)


def test_empty_and_dropped(spark):
    df = frame(spark, [(7, 1, "user", "a.")], 1)
    assert repair.audit(df.limit(0), df.limit(0)).count() == 0
    assert found(repair.audit(df, df.limit(0))) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert found(QUERIES["op11_conversation_repair"][0](spark, folder)) == slow(rows, slow_damage(rows))
