"""Folds over sessions that a plain window can't express, and pipelines put together from the other operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import relational as R


def folded(rows: DataFrame, key: str, order: str, value: str, fold: Callable[[], Callable], out: T.StructField | None) -> DataFrame:
    """rows with what a fold gives for each value, in the order of each key (ties by value); with no column for it, the rows that
    it keeps.

    A task reads its sorted rows as they come and holds the fold's state alone, whatever a key's size."""
    schema = T.StructType([*rows.schema.fields, out]) if out else rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            got = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if step is None or k != now:
                    now, step = k, fold()
                got.append(step(v))
            if out is None:
                yield batch.filter(pa.array(got, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, to_arrow_type(out.dataType))], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, order, value).mapInArrow(run, schema)


def chunk_turns(turns: DataFrame, key: str, order: str, size: str, most: int = 16_000) -> DataFrame:
    """(key, order, chunk): turns packed in order into chunks of at most `most` bytes; a larger turn has one of its own."""

    def pack() -> Callable[[int], int]:
        chunk = held = 0

        def step(n: int) -> int:
            nonlocal chunk, held
            if held and held + n > most:
                chunk, held = chunk + 1, 0
            held += n
            return chunk

        return step

    return folded(turns.select(key, order, size), key, order, size, pack, T.StructField("chunk", T.IntegerType())).drop(size)


def ring_dedupe(rows: DataFrame, key: str, order: str, value: str, size: int = 32) -> DataFrame:
    """Rows whose value isn't among the last `size` different ones of their key."""

    def ring() -> Callable:
        held: deque = deque(maxlen=size)

        def step(v) -> bool:
            new = v not in held
            if new:
                held.append(v)
            return new

        return step

    return folded(rows, key, order, value, ring, None)


def balanced(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """(key, half): the largest first (then by key), each to the smaller half, the first one if they are even.

    Only the different sizes (at most twice the square root of their sum) are walked through: a run of equal sizes first goes to the
    smaller half until the halves' order turns, then to each in turn, so that what its k-th key gets is a formula of k."""
    runs = sizes.groupBy(F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("n").desc())
    a = b = 0
    rules = []
    for r in runs.collect():
        size, count = r["n"] or 0, r["c"]
        side = int(b < a)  # the smaller half takes keys until it is not
        low, high = (b, a) if side else (a, b)
        if size == 0:
            lead = count
        elif side:
            lead = min(count, -(-(high - low) // size))
        else:
            lead = min(count, (high - low) // size + 1)
        rest = count - lead
        rules.append((r["n"], side, lead))
        gain = [0, 0]
        gain[side] += size * lead
        a, b = a + gain[0], b + gain[1]
        for i in range(min(rest, 2)):  # which half the next two take; from then on they alternate
            to = int(b < a)
            rules[-1] = (*rules[-1], to)
            a, b = (a + size, b) if to == 0 else (a, b + size)
        if rest > 2:
            pairs, odd = divmod(rest - 2, 2)
            a, b = a + pairs * size, b + pairs * size
            if odd:
                a, b = (a + size, b) if rules[-1][3] == 0 else (a, b + size)
        rules[-1] = (*rules[-1], *[None] * (5 - len(rules[-1])))
    plan = sizes.sparkSession.createDataFrame(rules, "n long, side int, lead long, third int, fourth int")
    order = sizes.withColumn("i", F.row_number().over(W.partitionBy(n).orderBy(key)) - 1).withColumnRenamed(n, "n")
    turn = F.when((F.col("i") - F.col("lead")) % 2 == 0, F.col("third")).otherwise(F.col("fourth"))
    return order.join(plan, order["n"].eqNullSafe(plan["n"])).select(key, F.when(F.col("i") < F.col("lead"), F.col("side")).otherwise(turn).cast("int").alias("half"))


def shrink(sections: dict[str, list[str]], order: list[str], most: int, floor: int = 10) -> dict[str, list[str]]:
    """Makes rendered sections fit a budget of bytes: halves the first one down to `floor` entries, then drops from the others in order."""
    size = lambda: sum(len(x.encode()) for s in sections.values() for x in s)
    sections = {k: list(v) for k, v in sections.items()}
    while size() > most and len(sections[order[0]]) > floor:
        sections[order[0]] = sections[order[0]][: max(floor, len(sections[order[0]]) // 2)]
    for name in [*order[1:], order[0]]:
        while size() > most and sections[name]:
            sections[name].pop()
    return sections


def fitted(fixed: Column, observations: Column, sessions: Column, turns: int, most: int, floor: int = 10) -> Column:
    """struct(observations, turns, sessions, bytes): how much of a context fits into `most` bytes.

    fixed: bytes of what always stands; observations: bytes of each; sessions: array of struct(head, turns: bytes of each).  The cuts
    come in one order, each smaller than the one before: observations are halved until there are no more than `floor`, then each
    session loses turns down to one, then sessions go down to one, then the observations.  The first that fits is taken, or
    the last; sizes come from sums of prefixes, so no text is put together for the cuts that don't fit."""
    n, m = F.size(observations), F.size(sessions)
    halved = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.floor(n / F.pow(F.lit(2), i)).cast("int").alias("o"), F.when(i > 0, F.floor(n / F.pow(F.lit(2), i - 1))).otherwise(n + floor + 1).alias("before"))), lambda x: x["before"] > floor)
    step = lambda o, t, k: F.struct(o.cast("int").alias("observations"), t.cast("int").alias("turns"), k.cast("int").alias("sessions"))
    few = F.element_at(halved, -1)["o"]
    down = lambda top: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: top - i), lambda i: i >= 1)
    cuts = F.concat(F.transform(halved, lambda x: step(x["o"], F.lit(turns), m)), F.transform(down(F.lit(turns)), lambda t: step(few, t, m)), F.transform(down(m), lambda k: step(few, F.lit(min(turns, 1)), k)), F.array(step(F.lit(0), F.lit(min(turns, 1)), F.least(m, F.lit(1)))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def size(c: Column) -> Column:
        own = F.transform(F.slice(sessions, F.lit(1), c["sessions"]), lambda s: s["head"] + total(F.slice(s["turns"], F.lit(1), c["turns"])))
        return fixed + total(F.slice(observations, F.lit(1), c["observations"])) + total(own)

    sized = F.transform(cuts, lambda c: F.struct(c["observations"].alias("observations"), c["turns"].alias("turns"), c["sessions"].alias("sessions"), size(c).alias("bytes")))
    return F.coalesce(F.get(F.filter(sized, lambda c: c["bytes"] <= most), F.lit(0)), F.element_at(sized, -1))


def weight_tier(title: Column, type: Column, kind: Column) -> Column:
    """How much a memory weighs in an answer: 0 for what shipped, then features, fixes and decisions, summaries, changes, the rest."""
    shipped = title.ilike("%shipped%") | title.ilike("%released%") | title.ilike("%merged%") | title.rlike(r"v[0-9]\.[0-9]")
    undone = title.ilike("%not %") | title.ilike("%unreleased%")
    return F.when(shipped & ~undone, 0).when(type.isin("feature", "bugfix", "decision"), 1).when(kind == "summary", 2).when(type.isin("change", "refactor"), 3).otherwise(4)


def rank_mode(mode: str, words: DataFrame, meaning: DataFrame, limit: int, relevance: float = 0.45, fill: float = 0.55) -> DataFrame:
    """(q, id, rank) by keyword, vector, hybrid (fused, half weight) or fill (keyword order, gated, then filled).

    words: (q, id, rank); meaning: (q, id, cosine, rank)."""
    from . import ranking

    if mode == "keyword":
        return words.where(F.col("rank") <= limit).select("q", "id", "rank")
    if mode == "vector":
        return meaning.where(F.col("rank") <= limit).select("q", "id", "rank")
    if mode == "hybrid":
        pool = 6 * limit
        return ranking.fuse((words.where(F.col("rank") <= pool), 1.0), (meaning.where(F.col("rank") <= pool), 0.5)).where(F.col("rank") <= limit).select("q", "id", "rank")
    if mode == "fill":
        return ranking.gate_and_fill(words, meaning, relevance, fill, limit).select("q", "id", "rank")
    raise ValueError(f"no such mode: {mode}")


def window_memories(memories: DataFrame, start: int, end: int, total: int = 120, whole: int = 24) -> DataFrame:
    """Memories of a time window: a fair share for each project (lowest tier, then newest first), `full` for the best `whole`."""
    inside = memories.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    shares = R.fair_share(inside.groupBy(F.col("project").alias("g")).agg(F.count(F.lit(1)).alias("n")), total)
    ranked = inside.withColumn("_n", F.row_number().over(W.partitionBy("project").orderBy("tier", F.col("created_at").desc(), "id")))
    kept = ranked.join(F.broadcast(shares), F.col("project") == F.col("g")).where(F.col("_n") <= F.col("take")).drop("_n", "g", "n", "take")
    return kept.withColumn("full", F.row_number().over(W.orderBy("tier", F.col("created_at").desc(), "id")) <= whole)  # `total` rows


def trace(lines: DataFrame) -> DataFrame:
    """(path, trace): JSON of the line ranges each session wrote, from (path, line, session_id); unattributed lines are null."""
    named = lines.where("session_id IS NOT NULL")
    spans = R.islands(named, ["path", "session_id"], "line")
    ranges = spans.groupBy("path", "session_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    return ranges.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("session_id", "ranges")))).alias("trace"))


def apply_replies(replies: DataFrame, most: int = 8) -> DataFrame:
    """Memories from a model's replies (session_id, reply: JSON): the first `most` observations, unknown types as discovery, ids by order.

    A reply that isn't JSON gives none."""
    known = ("bugfix", "feature", "refactor", "change", "discovery", "decision", "security_alert", "security_note", "sensitive")
    schema = "observations array<struct<type string, title string, narrative string, facts array<string>, evidence array<string>>>"
    rows = replies.withColumn("o", F.from_json("reply", schema)).select("session_id", F.posexplode(F.slice("o.observations", 1, most)).alias("n", "o")).where("coalesce(o.title, '') <> ''")
    kind = F.when(F.col("o.type").isin(*known), F.col("o.type")).otherwise("discovery")
    return rows.select("session_id", "n", kind.alias("type"), F.col("o.title").alias("title"), F.coalesce("o.narrative", F.lit("")).alias("narrative"), F.coalesce("o.facts", F.array().cast("array<string>")).alias("facts"), F.coalesce("o.evidence", F.array().cast("array<string>")).alias("evidence"))


def distil(chunks: DataFrame, replies: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """What a model's replies to chunks of sessions come to: memories, each with its evidence, and how far each session is done.

    chunks: (session_id, chunk, first_id, last_id); replies: (session_id, chunk, reply: JSON).  memories: (session_id, chunk, n, type,
    title, narrative, facts, first_id, last_id), the first `most` observations of a reply.  marks: (session_id, through): the last
    event of the last chunk before which no chunk lacks a reply that is JSON with observations, so that the rest is asked again."""
    said = chunks.join(replies, ["session_id", "chunk"], "left").withColumn("good", F.coalesce(F.from_json("reply", "observations array<string>")["observations"].isNotNull(), F.lit(False)))
    by = W.partitionBy("session_id").orderBy("chunk")
    done = said.withColumn("done", F.min(F.col("good").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) == 1)
    marks = done.where("done").groupBy("session_id").agg(F.max("last_id").alias("through"))
    one = said.where("good").select(F.struct("session_id", "chunk", "first_id", "last_id").alias("session_id"), "reply")
    found = apply_replies(one, most).select("session_id.*", "n", "type", "title", "narrative", "facts")
    return found, marks


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables and their manifest; a reader trusts the folder only with its manifest, which comes last."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    found = R.manifest(**{n: spark.read.parquet(f"{folder}/{n}") for n in tables})
    found.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_snapshot(spark, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; raises if counts or checksums differ from the manifest."""
    rows = spark.read.parquet(f"{folder}/manifest").collect()  # one for each table
    tables = {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in rows}
    for r in R.manifest(**tables).collect():
        if (r["name"], r["n"], r["check"]) not in {(x["name"], x["n"], x["check"]) for x in rows}:
            raise ValueError(f"table {r['name']} differs from its manifest")
    return tables
