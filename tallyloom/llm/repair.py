"""Repair of the structure of conversations: the cheapest edits that lead to roles (system? (user assistant)+)?.

A conversation's rows go by turn (null first), then role and text.  A row is blank (no character but blanks), a duplicate (role
and text seen before) or truncated (the last character that isn't blank is none of . ! ?); the first that holds counts.  Keep
costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant row 5; blank rows and duplicates must be
deleted, a truncated row that stays costs 5 more.  Of edits of equal cost the audit (their initials in order) of least ASCII
order wins.

The edits are a path in a lattice of (rows consumed, state of the role grammar).  A* walks it by (cost + heuristic, audit); the
heuristic is the suffix sum of mandatory deletions and of the 2 that a truncated row costs at least.  It is consistent, so a
node's first visit has its least cost and, of those, its least audit.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any size spreads over tasks.  One that lies
inside a range and has at most BLOCK rows is finished there.  Others are cut into blocks; a block's searches from each state to
each state give its least costs and audits, and a fold over the conversation's blocks composes them.  An audit up to a block's
last row ends with that row's edit, so audits to different states are never prefixes of one another: the fold carries costs and
the order of the four audits, not the audits.  Rows that are equal in all columns are one with a number, and texts cross the
network once (twice in conversations that are cut).

Null roles and texts count as one space; an empty role has a space for its initial.  Null conversations are one, null turns a
turn.  An empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, scratch, small, stash, table

#: Rows and characters of a block.
BLOCK, CHARS = 128, 2 << 20
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Of the role grammar: nothing yet, after system, after user, after assistant.  The last two numbers: end with so many inserts.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WANTED = ("u", "u", "a", "u")
MISSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}

MOVE = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
UNIT = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("times", pa.int64())])
COUNTS = ("blank", "duplicate", "truncated", "illegal")
EDGES = ("first_turn", "last_turn", "turns")
CUT = [("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *((c, pa.int64()) for c in (*EDGES, *COUNTS, "cost")), ("first", pa.string()), ("last", pa.string()), ("audit", pa.string()), ("text", pa.string()), ("moves", pa.list_(MOVE)), ("units", pa.list_(UNIT))]


def initial(role: str) -> str:
    return role[:1] or " "


def search(units: list[tuple], start: int, final: bool) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit) of the cheapest edits of all units (role, text, fault, times) from a state; a letter for each unit.

    final: of those that end in a legal conversation only the best, with inserts behind the last row."""
    n = len(units)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, _, fault, times = units[i]
        rest[i] = rest[i + 1] + (DELETE * times if fault else 0)  # a truncated row: deleted, which costs less than to stay
    heap, done, goals = [(rest[0], "", 0, start, 0)], set(), {}
    while heap:
        _, audit, i, state, cost = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not final or not MISSING[state]):
            goals[state] = (cost, audit)
            if final or len(goals) == 4:
                break
            continue
        wanted = WANTED[state]
        steps = [("I", i, NEXT[state, wanted], cost + INSERT)]
        if i < n:
            role, _, fault, times = units[i]
            steps.append(("D", i + 1, state, cost + DELETE * times))
            if fault in (FINE, TRUNCATED):
                more = cost + (CUT_OFF if fault else 0)
                steps.append(("R", i + 1, NEXT[state, wanted], more + REROLE))
                if (kept := NEXT.get((state, initial(role)))) is not None:
                    steps.append(("K", i + 1, kept, more))
        for letter, j, to, g in steps:
            if (j, to) not in done:
                heappush(heap, (g + rest[j], audit + letter, j, to, g))
    return goals


def rebuilt(units: list[tuple], state: int, audit: str) -> list[str]:
    """The rows role:text that an audit (a letter for each unit, inserts between) leaves."""
    out, i = [], 0
    for letter in audit:
        if letter != "D":
            role = units[i][0] if letter == "K" else {"u": "user", "a": "assistant"}[WANTED[state]]
            out.append(f"{role}:{units[i][1] if letter != 'I' else ''}")
            state = NEXT[state, initial(role)]
        i += letter != "I"
    return out


def spelled(units: list[tuple], audit: str) -> str:
    """An audit with a letter for each row."""
    out, i = [], 0
    for letter in audit:
        out.append(letter if letter == "I" else letter * units[i][3])
        i += letter != "I"
    return "".join(out)


class Run:
    """Rows of one conversation as they come, at most a block of them."""

    def __init__(self) -> None:
        self.units, self.counts, self.chars = [], dict.fromkeys(COUNTS, 0), 0
        self.first, self.last = "", ""
        self.first_turn, self.last_turn, self.turns = None, None, 0

    def add(self, turn: int | None, role: str, text: str, times: int, again: bool) -> None:
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        bare = text.rstrip(BLANKS)
        fault = BLANK if not bare else DUPLICATE if again else TRUNCATED if bare[-1] not in ".!?" else FINE
        new = [(role, text, fault, times)] if fault in (BLANK, DUPLICATE) or times == 1 else [(role, text, fault, 1), (role, "", DUPLICATE, times - 1)]
        for _, _, f, n in new:
            if f:
                self.counts[COUNTS[f - 1]] += n
        self.units += new
        self.chars += len(text)
        letter = initial(role)
        self.counts["illegal"] += times - 1 + (self.last != "" and self.last + letter not in LEGAL)
        self.first, self.last = self.first or letter, letter

    def full(self) -> bool:
        return len(self.units) >= BLOCK or self.chars >= CHARS

    def row(self, part: int, seq: int, whole: bool) -> tuple:
        cost = audit = text = None
        moves, units = [], []
        if whole:
            (cost, letters), = search(self.units, START, True).values()
            audit, text = spelled(self.units, letters), "\n".join(rebuilt(self.units, START, letters))
        else:
            moves = [dict(s=s, t=t, cost=c, audit=a) for s in range(4) for t, (c, a) in search(self.units, s, False).items()]
            units = [dict(zip(("role", "text", "fault", "times"), u, strict=True)) for u in self.units]
        return (part, seq, whole, self.first_turn, self.last_turn, self.turns, *self.counts.values(), cost, self.first, self.last, audit, text, moves, units)


def spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def fields(own: list[tuple]) -> list[T.StructField]:
    return [T.StructField(n, spark_type(k)) for n, k in own]


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times, again) of (conv, turn, role, text, times): equal rows once, again: role and text stand in
    an earlier turn.  Rows of times 0 only name their conversation."""
    named = F.when(F.col("times") > 0, F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumns({"h1": F.xxhash64("conv", F.lit(7), "role", "text"), "h2": F.xxhash64(named, "text", "role", F.lit(9), "conv")})
    turns = rows.where("times > 0").groupBy("h1", "h2", "turn").agg(F.sum("times").alias("c"), F.count(F.lit(1)).alias("n"))
    told = turns.groupBy("h1", "h2").agg(F.sum("c").alias("c"), F.max("n").alias("most"), F.min(F.struct(F.col("turn").isNotNull().alias("n"), "turn")).alias("one"))
    told = stash(told.where("c > 1").select("h1", "h2", "most", F.col("one.turn").alias("one")), "repair-again")
    state = rows.join(small(told), ["h1", "h2"], "left")
    again = (F.col("most").isNotNull() & ~F.col("turn").eqNullSafe(F.col("one"))).alias("again")
    columns = ["conv", "turn", "role", "text", "times"]
    out = state.where("coalesce(most, 1) = 1").select(*columns, again)
    if not told.where("most > 1").limit(1).count():
        return out
    one = [F.min(c).alias(c) for c in ("conv", "role", "text")]
    equal = state.where("most > 1").groupBy("h1", "h2", "turn").agg(*one, F.sum("times").alias("times"), F.max(again).alias("again"))
    return out.unionByName(equal.select(*columns, "again"))


def cut(rows: DataFrame) -> DataFrame:
    """Whole conversations, finished, and blocks of the others (CUT), of what `marked` gives."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32).asc()).sortWithinPartitions(*order, F.col("text").asc())
    schema = T.StructType([rows.schema["conv"], *fields(CUT)])
    kind = dealt.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        part, now, held, seq, firsts, out = TaskContext.get().partitionId(), None, None, 0, True, []

        def send(whole: bool) -> None:
            out.append((now, *held.row(part, seq, whole)))  # noqa: B023

        def batch_of() -> pa.RecordBatch:
            named = [("conv", to_arrow_type(kind)), *CUT]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), named, strict=True)], names=[n for n, _ in named])
            out.clear()
            return done

        for batch in batches:
            for conv, turn, role, text, times, again in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "times", "again")), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        send(not firsts and not seq)  # what lies inside this range is whole
                        firsts = False
                    now, held, seq = conv, Run(), 0
                elif held.full():
                    send(False)
                    held, seq = Run(), seq + 1
                if times:
                    held.add(turn, role, text, times, again)
            if out:
                yield batch_of()
        if held is not None:
            send(False)
            yield batch_of()

    return dealt.select("conv", "turn", "role", "text", "times", "again").mapInArrow(run, schema)


def chosen(blocks: DataFrame) -> DataFrame:
    """(conv, part, seq, s, audit, totals...) of every block: the state it is entered in, its edits, and with a conversation's first
    block the counts and cost of the conversation (else 0)."""
    totals = ["gaps", *COUNTS, "cost"]
    schema = T.StructType([blocks.schema["conv"], *(T.StructField(c, T.IntegerType()) for c in ("part", "seq", "s", "t", "tail")), *(T.StructField(c, T.LongType()) for c in totals)])
    read = ["part", "seq", *EDGES, *COUNTS, "first", "last"]
    slim = blocks.select("conv", *read, "moves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", *read, "moves")]
            out = []
            for conv, part, seq, *own, moves in zip(*columns, strict=True):
                if fold is None or conv != now:
                    if fold is not None:
                        out += [(now, *x) for x in fold.end()]
                    now, fold = conv, Fold()
                fold.add(part, seq, own, moves)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (batch.schema.field("conv").type, *[pa.int32()] * 5, *[pa.int64()] * 6), strict=True)], names=schema.names)
            last = batch.schema.field("conv").type
        if fold is not None:
            out = [(now, *x) for x in fold.end()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (last, *[pa.int32()] * 5, *[pa.int64()] * 6), strict=True)], names=schema.names)

    order = [F.col("conv").asc_nulls_first(), "part", "seq"]
    return slim.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


class Fold:
    """Composes the blocks of one conversation: of each state the least cost, the rank of its audit, and where it came from."""

    def __init__(self) -> None:
        self.best = {START: (0, 0)}
        self.places, self.back = [], []  # a few small numbers for each block
        self.counts, self.turns, self.first_turn, self.last_turn, self.last = [0] * 4, 0, None, None, ""

    def add(self, part: int, seq: int, own: list, moves: list[dict]) -> None:
        first_turn, last_turn, turns, *counts, first, last = own
        options: dict[int, tuple] = {}
        for m in moves:
            if m["s"] in self.best:
                cost, rank = self.best[m["s"]]
                new = (cost + m["cost"], rank, m["audit"], m["s"])
                options[m["t"]] = min(new, options.get(m["t"], new))
        ranks = {t: i for i, t in enumerate(sorted(options, key=lambda t: options[t][1:3]))}
        self.best = {t: (o[0], ranks[t]) for t, o in options.items()}
        self.back.append(tuple(options[t][3] if t in options else None for t in range(4)))
        self.places.append((part, seq))
        if first_turn is not None:
            self.turns += turns - (first_turn == self.last_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        if first:
            counts[3] += self.last != "" and self.last + first not in LEGAL
            self.last = last
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def end(self) -> list[tuple]:
        cost, _, state = min((c + INSERT * MISSING[t], rank, t) for t, (c, rank) in self.best.items())
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        out, tail = [], MISSING[state]
        for (part, seq), back in zip(reversed(self.places), reversed(self.back), strict=True):
            out.append((part, seq, back[state], state, tail, *[0] * 6))
            state, tail = back[state], 0
        out[-1] = (*out[-1][:5], gaps, *self.counts, cost)
        return out


def pieces_of(blocks: DataFrame, choices: DataFrame) -> DataFrame:
    """(conv, part, seq, totals..., audit, text) of every block with its edits done; text is null where no row is left."""
    totals = ["gaps", *COUNTS, "cost"]
    own = [F.col(c).alias(f"to_{c}") for c in choices.columns]
    same = F.col("conv").eqNullSafe(F.col("to_conv")) & (F.col("part") == F.col("to_part")) & (F.col("seq") == F.col("to_seq"))
    both = blocks.select("conv", "part", "seq", "moves", "units").join(choices.select(*own), same).select("conv", "part", "seq", "moves", "units", *(f"to_{c}" for c in ("s", "t", "tail", *totals)))
    schema = T.StructType([blocks.schema["conv"], *(T.StructField(c, T.IntegerType()) for c in ("part", "seq")), *(T.StructField(c, T.LongType()) for c in totals), *(T.StructField(c, T.StringType()) for c in ("audit", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, texts = [], []
            for moves, units, s, t, tail in zip(*(batch.column(c).to_pylist() for c in ("moves", "units", "to_s", "to_t", "to_tail")), strict=True):
                rows = [(u["role"], u["text"], u["fault"], u["times"]) for u in units]
                letters = next(m["audit"] for m in moves if m["s"] == s and m["t"] == t) + "I" * tail
                audits.append(spelled(rows, letters))
                left = rebuilt(rows, s, letters)
                texts.append("\n".join(left) if left else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq", *(f"to_{c}" for c in totals))), pa.array(audits, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return both.mapInArrow(run, schema)


@dataclass
class Repaired:
    """whole: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, text) of conversations repaired in one piece;
    pieces: (conv, part, seq, the same counts, audit, text) of the others, in the order of part and seq, the counts with the first
    piece (else 0); a text is null where nothing of it is left, others are joined by newlines."""

    whole: DataFrame
    pieces: DataFrame

    def digests(self) -> DataFrame:
        """(conv, gaps, ..., cost, audit, repaired_sha256), a row for each conversation."""
        totals = ["gaps", *COUNTS, "cost"]
        whole = self.whole.select("conv", *totals, "audit", F.sha2("text", 256).alias("repaired_sha256"))
        schema = whole.schema
        order = [F.col("conv").asc_nulls_first(), "part", "seq"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums, audit, sha, some, kind = None, None, [], None, False, None

            def done() -> pa.RecordBatch:
                row = (now, *sums, "".join(audit), sha.hexdigest())
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (kind, *[pa.int64()] * 6, pa.string(), pa.string()), strict=True)], names=schema.names)

            for batch in batches:
                kind = batch.schema.field("conv").type
                for conv, *own, letters, text in zip(*(batch.column(c).to_pylist() for c in ("conv", *totals, "audit", "text")), strict=True):
                    if sums is None or conv != now:
                        if sums is not None:
                            yield done()
                        now, sums, audit, sha, some = conv, [0] * 6, [], hashlib.sha256(), False
                    sums = [a + b for a, b in zip(sums, own, strict=True)]
                    audit.append(letters)
                    if text is not None:
                        sha.update(b"\n" * some + text.encode())
                        some = True
            if sums is not None:
                yield done()

        ordered = self.pieces.repartition("conv").sortWithinPartitions(*order)
        return whole.unionByName(ordered.mapInArrow(run, schema))


def repair(rows: DataFrame) -> Repaired:
    """Repairs the conversations of (conv, turn: whole number, role, text, times); times 0 names a conversation without rows."""
    with scratch():
        done = stash(cut(marked(rows)), "repair-cut", keep=True)
        blocks = done.where("NOT whole")
        choices = stash(chosen(blocks), "repair-chosen", keep=True)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = done.where("whole").select("conv", gaps, *COUNTS, "cost", "audit", "text")
    return Repaired(whole, pieces_of(blocks, small(choices)))


def rows_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of a table as `repair` takes them."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("times"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by the checksum of conversation and turn: one in 20 each is dropped, emptied, loses its ends of
    sentences, is repeated, or becomes the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("times"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest edits and the digest of what they leave."""
    return repair(damaged(rows_of(table(spark, sf_dir, "conversations")))).digests().withColumnRenamed("conv", "conv_id")


QUERIES = {"op12_conversation_repair": (op12_conversation_repair, None)}
