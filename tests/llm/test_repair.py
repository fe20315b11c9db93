"""Repair of conversations against a plain table of least (cost, audit) over rows, one by one."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tallyloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, times string"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def legal(roles):
    """Whether role initials can still become a legal conversation, and whether they are one."""
    rest = roles[1:] if roles[:1] == "s" else roles
    pairs = rest == "ua" * (len(rest) // 2) + "u" * (len(rest) % 2)
    return pairs, roles == "" or pairs and len(rest) >= 2 and len(rest) % 2 == 0


def state_of(roles):
    return (roles[:1] == "s" and len(roles) == 1, roles[-1:])


def plain_repair(rows):
    """rows: (turn, role, text) in order; (blank, duplicate, truncated, illegal, cost, audit, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] or " " for r in rows]
    states = {(False, ""): (0, "", (), "")}  # state of the roles so far -> cost, audit, rows, roles (only their end matters)
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts before row i, or at the end
            for cost, audit, out, roles in list(states.values()):
                for role in ("user", "assistant"):
                    put(states, cost + 5, audit + "I", (*out, f"{role}:"), roles + role[0])
        if i == len(rows):
            break
        new = {}
        for cost, audit, out, roles in states.values():
            put(new, cost + 2, audit + "D", out, roles)
            if faults[i] not in ("blank", "duplicate"):
                more = cost + 5 * (faults[i] == "truncated")
                put(new, more, audit + "K", (*out, f"{rows[i][1]}:{rows[i][2]}"), roles + initials[i])
                for role in ("user", "assistant"):
                    put(new, more + 1, audit + "R", (*out, f"{role}:{rows[i][2]}"), roles + role[0])
        states = new
    cost, audit, out, _ = min(x for x in states.values() if legal(x[3])[1])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(out))


def put(states, cost, audit, out, roles):
    if legal(roles)[0]:
        key = state_of(roles)
        short = roles if len(roles) < 2 else ("sua" if roles[-1] == "a" else "suau")  # enough to go on with
        new = (cost, audit, out, short)
        states[key] = min(states.get(key, new), new)


def plain(table, hurt=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        *counts, text = plain_repair(rows)
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, hashlib.sha256(text.encode()).hexdigest())


def table():
    rnd = random.Random(4)
    words = ["yes.", "no", "more!", "é?", "", " \t", "so\n", "the end.\n", "x" * 9, ".", None]
    roles = ["user", "user", "user", "assistant", "assistant", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(90):
        for i in range(rnd.choice([1, 2, 3, 5, 8, 14])):
            turn = rnd.choice([i, i, i, i + 1, None, 2 * i])
            rows.append((conv if conv else None, turn, rnd.choice(roles[: rnd.choice([6, 11])]), rnd.choice(words) if rnd.random() < 0.5 else f"t{rnd.randrange(9999)}."))
    long = [(500, i, ("user", "assistant")[i % 2] if rnd.random() < 0.9 else rnd.choice(roles), rnd.choice(words) if rnd.random() < 0.2 else f"t{i}.") for i in range(900)]
    same = [(501, 3, "user", "again.")] * 400 + [(501, 4, "assistant", "well.")] + [(501, i, "user", "again.") for i in range(5, 9)]
    return rows + rows[:7] + long + same + [(600, 2, "user", "y" * 70_000 + "."), (600, 3, "assistant", "z.")]


def result(df):
    return Counter(map(tuple, df.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()))


@pytest.fixture(scope="module")
def given(spark):
    rows = table()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize(("block", "chars"), [(repair.BLOCK, repair.CHARS), (1, 1), (3, 1000)])
def test_against_a_plain_table(spark, given, monkeypatch, block, chars):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHARS", chars)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(block > 1).lower())
    try:
        rows = repair.rows_of(given)
        assert result(repair.repair(repair.damaged(rows)).digests()) == Counter(plain(table()))
        assert result(repair.repair(rows).digests()) == Counter(plain(table(), hurt=False))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_search_opens_few_nodes():
    """The heuristic is met exactly where only mandatory deletions are left to do."""
    units = [("user", "", repair.BLANK, 1)] * 50 + [("user", "a.", repair.FINE, 1), ("assistant", "b.", repair.FINE, 1)]
    assert repair.search(units, repair.START, True) == {repair.ASSISTANT: (100, "D" * 50 + "KK")}


def test_texts_come_back(given):
    """Pieces and whole conversations hold the texts that the digests are of."""
    out = repair.repair(repair.rows_of(given))
    texts = {r["conv"]: [r["text"]] for r in out.whole.collect()}
    for r in sorted(out.pieces.collect(), key=lambda r: (r["part"], r["seq"])):
        texts.setdefault(r["conv"], []).extend([] if r["text"] is None else [r["text"]])
    want = {r[0]: r[-1] for r in plain(table(), hurt=False)}
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()} == want


def test_empty_and_given_tables(spark, given):
    assert repair.repair(repair.rows_of(given.limit(0))).digests().count() == 0
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = repair.op12_conversation_repair(spark, "/root/testdata/sf0.01").withColumnRenamed("conv_id", "conv")
    assert result(got) == Counter(plain(map(tuple, rows)))
