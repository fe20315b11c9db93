"""How the record lives: marks of progress, budgets, pins, forgetting, re-redaction, imports, merges, snapshots, settings."""

from __future__ import annotations

import time

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.transcripts import uri
from . import relational as O
from . import sessions as S

DAY = 86_400_000


def numbered(df: DataFrame, key: str, first: int, name: str, width: int = 1 << 20) -> DataFrame:
    """df with numbers from `first` on in the order of an integer key: counts by ranges of the key give each range its start, so no
    task has to hold all rows."""
    at = F.floor(F.col(key) / width)
    ranges = df.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    start = ranges.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    rows = df.withColumn("_b", at).join(start.drop("_n"), "_b")
    return rows.withColumn(name, F.lit(first) + F.col("_s") + F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_s")


def undistilled(events: DataFrame, marks: DataFrame, scripted: DataFrame) -> DataFrame:
    """(session_id) with events of the main thread after what has been distilled or settled (marks: session_id, through, settled)."""
    e = events.where("thread IS NULL") if "thread" in events.columns else events
    newest = e.groupBy("session_id").agg(F.max("id").alias("last"))
    open_ = newest.join(marks, "session_id", "left").where(F.col("last") > F.greatest(F.coalesce("through", F.lit(0)), F.coalesce("settled", F.lit(0))))
    return open_.join(scripted.select("session_id").distinct(), "session_id", "left_anti").select("session_id")


def mark_scripted(prompts: DataFrame, patterns: tuple[str, ...], known: DataFrame | None = None, position: int = 0) -> DataFrame:
    """(session_id) of sessions that a script drives: known ones and those with a prompt (id, session_id, text) past the position that
    a pattern finds.  With other patterns than before, begin again with neither."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("text").rlike(p)
    found = prompts.where((F.col("id") > position) & hit).select("session_id")
    return (found if known is None else found.union(known.select("session_id"))).distinct()


def backlog(sessions: DataFrame, calls: DataFrame, now: int, limit: int, keep: int = 14 * DAY, warn: int = 12 * DAY, since: int = 0) -> DataFrame:
    """One row: pending, at_risk, expired and before_backfill sessions (last_event_at, waiting), calls of the last day, whether they are
    within the limit, and good calls of the last hour (calls: at, requests, ok)."""
    age = F.lit(now) - F.col("last_event_at")
    w = F.col("waiting")
    s = sessions.agg(F.count_if(w & (age <= warn) & (F.col("last_event_at") >= since)).alias("pending"), F.count_if(w & (age > warn) & (age <= keep) & (F.col("last_event_at") >= since)).alias("at_risk"), F.count_if(w & (age > keep) & (F.col("last_event_at") >= since)).alias("expired"), F.count_if(w & (F.col("last_event_at") < since)).alias("before_backfill"))
    c = calls.agg(F.coalesce(F.sum(F.when(F.col("at") > now - DAY, F.col("requests"))), F.lit(0)).alias("requests"), F.count_if((F.col("at") > now - 3_600_000) & F.col("ok")).alias("good"))
    return s.join(F.broadcast(c), F.lit(True)).withColumn("may_call", F.col("requests") < limit)  # one row each


def within_budget(calls: DataFrame, key: str, limit: int, span: int = DAY) -> DataFrame:
    """calls (key, at, requests) with `used`, the requests of the span before each, and whether it may go on."""
    w = W.partitionBy(key).orderBy("at").rangeBetween(-span, -1)
    return calls.withColumn("used", F.coalesce(F.sum("requests").over(w), F.lit(0))).withColumn("allowed", F.col("used") < limit)


def advance(marks: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Progress marks (keys, through) moved to the greatest of both; they never go back."""
    return marks.select(*keys, "through").unionByName(seen.select(*keys, "through")).groupBy(*keys).agg(F.max("through").alias("through"))


def settled(events: DataFrame, marks: DataFrame, now: int, idle: int = DAY, least: int = 300) -> DataFrame:
    """(session_id, settled): sessions idle for over a day whose rest since the mark is too small to distil."""
    rest = events.join(marks.select("session_id", "through"), "session_id", "left").where(F.col("id") > F.coalesce("through", F.lit(0)))
    g = rest.groupBy("session_id").agg(F.max("id").alias("settled"), F.max("ts").alias("ts"), F.sum(F.octet_length("text")).alias("bytes"))
    return g.where((F.col("ts") < now - idle) & (F.col("bytes") < least)).select("session_id", "settled")


def pin(pins: DataFrame, new: DataFrame) -> DataFrame:
    """Pins (key, project, text, created_at) with new ones (project, text, created_at): a fact that is there already is touched."""
    keyed = new.withColumn("key", F.concat(F.lit("pin:"), "project", F.lit(":"), X.short_hash(F.trim("text"))))
    return pins.unionByName(keyed).groupBy("key").agg(F.min_by("project", "created_at").alias("project"), F.min_by("text", "created_at").alias("text"), F.max("created_at").alias("created_at"))


def pin_list(pins: DataFrame, project: str, most: int = 20) -> DataFrame:
    rows = pins.where(F.col("project").isin(project, "*"))
    order = [F.col("project") == "*", F.col("created_at").desc(), F.col("key")]
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # `most` rows


def forget_cascade(tombstones: DataFrame, sessions: DataFrame, events: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """The tables without what tombstones (kind: memory, event, session, project; key) name and what hangs on it: a project's sessions,
    a session's events and memories.  Applied to what comes in later, it keeps it out, too."""
    s = O.forget(O.forget(sessions, tombstones, "project", "project"), tombstones, "session", "session_id")
    dead = sessions.join(s.select("session_id"), "session_id", "left_anti").select("session_id")
    e = O.forget(events, tombstones, "event", "id").join(dead, "session_id", "left_anti")
    m = O.forget(O.forget(memories, tombstones, "memory", "id"), tombstones, "project", "project").join(dead, "session_id", "left_anti")
    return {"sessions": s, "events": O.forget(e, tombstones, "session", "session_id"), "memories": O.forget(m, tombstones, "session", "session_id")}


def reredact(rows: DataFrame, key: str, columns: list[str], version: int) -> DataFrame:
    """(key, columns, redaction) of rows below a redaction version whose texts today's rules change; done rows are left alone, so the
    pass can be taken up again."""
    old = rows.where(F.coalesce("redaction", F.lit(0)) < version)
    new = old.select(key, *(F.col(c).alias(f"_{c}") for c in columns), *(X.redact(F.col(c)).alias(c) for c in columns))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.where(changed).select(key, *columns, F.lit(version).alias("redaction"))


def import_foreign(mine: DataFrame, observations: DataFrame, summaries: DataFrame, prompts: DataFrame, my_events: DataFrame, base: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(memories, events) to add from another record: observations keep their ids unless taken, summaries get ids from `base` (above
    mine and theirs, if that is taken), prompts come only for sessions that have none; what was imported before (origin) doesn't come again.

    mine: (id, origin); observations, summaries: (id, session_id, project, title); prompts: (id, session_id, text).  A session's project
    is the one most of its observations name, ties by name."""
    vote = observations.groupBy("session_id", "project").agg(F.count(F.lit(1)).alias("n"))
    winner = O.first_per_key(vote, ["session_id"], F.col("n").desc(), "project").select("session_id", F.col("project").alias("_p"))
    tagged = lambda rows, kind: rows.withColumn("origin", F.concat(F.lit(f"import:{kind}:"), F.col("id"))).join(mine.select("origin"), "origin", "left_anti").join(winner, "session_id", "left").withColumn("project", F.coalesce("_p", "project")).drop("_p").withColumn("kind", F.lit(kind))
    o = tagged(observations, "observation")
    taken = o.join(mine.select("id"), "id", "left_semi")
    top = max(base, (mine.select("id").union(observations.select("id")).agg(F.max("id")).first()[0] or 0) + 1)
    free = o.join(mine.select("id"), "id", "left_anti")
    moved = numbered(taken.withColumn("_a", F.lit(0)).unionByName(tagged(summaries, "summary").withColumn("_a", F.lit(1))).withColumn("_k", F.col("id") * 2 + F.col("_a")), "_k", top, "_id").drop("_k", "_a")
    cols = ["id", "origin", "kind", "session_id", "project", "title"]
    memories = free.select(*cols).unionByName(moved.withColumn("id", F.col("_id")).select(*cols))
    heard = my_events.where("kind = 'prompt'").select("session_id").distinct()
    p = prompts.join(heard, "session_id", "left_anti").withColumn("_h", X.short_hash(F.col("text")))
    events = O.collapse_repeats(p, ["session_id"], "id", "_h").select("session_id", F.concat(F.lit("cm:"), F.col("id")).alias("record_key"), F.lit("prompt").alias("kind"), "text")
    return memories, events


def merge_record(mine: dict[str, DataFrame], theirs: dict[str, DataFrame], prefix: str, tombstones: DataFrame) -> dict[str, DataFrame]:
    """What to add from another record (sessions, events, memories, evidence): sessions that are neither here nor forgotten, with their
    events and memories under new ids above mine; projects that both have get the prefix.

    A memory's origin session@from-through#n names the new ids of the range's ends, or of the nearest events inside; evidence is mapped
    through both ids."""
    s = theirs["sessions"].join(mine["sessions"].select("session_id"), "session_id", "left_anti")
    s = O.forget(O.forget(s, tombstones, "session", "session_id"), tombstones, "project", "project")
    shared = mine["sessions"].select("project").distinct().intersect(theirs["sessions"].select("project").distinct()).select(F.col("project").alias("_p"))
    named = lambda rows: rows.join(shared, F.col("project") == F.col("_p"), "left").withColumn("project", F.when(F.col("_p").isNotNull(), F.concat(F.lit(prefix + "/"), F.col("project"))).otherwise(F.col("project"))).drop("_p")
    top = lambda t: (mine[t].agg(F.max("id")).first()[0] or 0) + 1
    fresh = lambda t: numbered(theirs[t].join(s.select("session_id"), "session_id", "left_semi").withColumn("old_id", F.col("id")), "old_id", top(t), "_new").withColumn("id", F.col("_new")).drop("_new")
    events, memories = fresh("events"), named(fresh("memories"))
    at = lambda i: F.regexp_extract("origin_id", r"^(.*)@(\d+)-(\d+)(#\d+)?$", i)
    m = memories.withColumns({"_s": at(1), "_a": F.when(at(2) != "", at(2)).cast("long"), "_z": F.when(at(3) != "", at(3)).cast("long"), "_n": at(4)})
    e = events.select(F.col("session_id").alias("_s"), "old_id", F.col("id").alias("_e")).withColumnRenamed("old_id", "_o")
    ends = m.select("old_id", "_s", "_a", "_z").join(e, "_s").where("_o BETWEEN _a AND _z").groupBy("old_id").agg(F.min("_e").alias("_from"), F.max("_e").alias("_to"))
    m = m.join(ends, "old_id", "left").withColumn("origin_id", F.when(F.col("_from").isNotNull(), F.concat("_s", F.lit("@"), "_from", F.lit("-"), "_to", "_n")).otherwise(F.col("origin_id"))).drop("_s", "_a", "_z", "_n", "_from", "_to")
    ev = theirs["evidence"].join(memories.select(F.col("old_id").alias("memory_id"), F.col("id").alias("_m")), "memory_id").join(events.select(F.col("old_id").alias("event_id"), F.col("id").alias("_e")), "event_id")
    return {"sessions": named(s), "events": events, "memories": m, "evidence": ev.select(F.col("_m").alias("memory_id"), F.col("_e").alias("event_id"))}


def merge_plan(theirs: dict[str, DataFrame], accepted: DataFrame) -> DataFrame:
    """(project, sessions, events): what a merge would add, from accepted sessions (session_id)."""
    s = theirs["sessions"].join(accepted.select("session_id").distinct(), "session_id", "left_semi")
    n = theirs["events"].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "session_id", "left").groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def export_record(sessions: DataFrame, events: DataFrame, memories: DataFrame, evidence: DataFrame, project: str | None, at: int, version: int = 1) -> DataFrame:
    """(record, line): JSON lines of a record, or of one project and the memories of all projects (*), with a first row that says what it is."""
    if project is not None:
        sessions = O.in_project(sessions, project)
        events = events.join(sessions.select("session_id"), "session_id", "left_semi")
        memories = memories.where((F.col("project") == project) | F.col("project").startswith(project + "#") | (F.col("project") == "*"))
        evidence = evidence.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    meta = sessions.sparkSession.range(1).select(F.lit(version).alias("version"), F.lit(at).alias("exported_at"), F.lit(project).alias("project"))
    return O.export_lines(meta=meta, session=sessions, event=events, memory=memories, evidence=evidence)


# ---- snapshots


def snapshot(tables: dict[str, DataFrame], folder: str, keep: int = 7, stamp: str | None = None) -> str:
    """Writes a verified snapshot below a folder and removes all but the newest `keep`; its path."""
    stamp = stamp or time.strftime("%Y%m%dT%H%M%S", time.gmtime())
    path = f"{folder}/snapshot-{stamp}"
    S.write_snapshot(tables, path)
    store, base = fs.FileSystem.from_uri(uri(folder))
    found = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.startswith("snapshot-"))
    for old in found[:-keep]:
        store.delete_dir(old)
    return path


def current(spark: SparkSession, home: str) -> dict[str, DataFrame]:
    """The tables that the pointer file CURRENT names."""
    store, base = fs.FileSystem.from_uri(uri(home))
    with store.open_input_stream(f"{base}/CURRENT") as f:
        return S.read_snapshot(spark, f"{home}/{f.read().decode().strip()}")


def restore(spark: SparkSession, path: str, home: str, probe) -> str:
    """Puts a snapshot in use: copies it to a staged folder, compares it with its manifest, lets probe(tables) look at it (an error or
    False stops), and moves the pointer file as the last step; the folder's name."""
    tables = S.read_snapshot(spark, path)
    name = "staged-" + time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + f"-{time.monotonic_ns()}"
    S.write_snapshot(tables, f"{home}/{name}")
    staged = S.read_snapshot(spark, f"{home}/{name}")
    if probe(staged) is False:
        raise ValueError("the probe doesn't accept the snapshot")
    store, base = fs.FileSystem.from_uri(uri(home))
    with store.open_output_stream(f"{base}/CURRENT.new") as f:
        f.write(name.encode())
    store.move(f"{base}/CURRENT.new", f"{base}/CURRENT")
    return name


# ---- settings

#: Parts of settings' names whose values aren't shown.
SENSITIVE = ("key", "token", "secret", "password", "credential")


def flatten(df: DataFrame, json: str) -> DataFrame:
    """(path, value): the leaves of JSON objects by dotted path, of any depth; arrays are leaves."""
    left, out = df.select(F.lit("").alias("path"), F.col(json).alias("value")), None
    while True:
        inner = left.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("k", "value"))
        level = inner.select(F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "value")
        deep = F.coalesce(F.ltrim("value").startswith("{") & (F.ltrim("value") != "{}"), F.lit(False))
        leaves = level.where(~deep)
        out = leaves if out is None else out.unionByName(leaves)
        left = level.where(deep)
        if not left.limit(1).count():  # one step for each level of nesting
            return out


def settings_diff(a: DataFrame, b: DataFrame, json: str) -> DataFrame:
    """(path, a, b, sensitive) of settings that differ; values of sensitive ones are masked."""
    x, y = flatten(a, json).withColumnRenamed("value", "a"), flatten(b, json).withColumnRenamed("value", "b")
    d = x.join(y, "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    hidden: Column = F.lit(False)
    for part in SENSITIVE:
        hidden = hidden | F.lower("path").contains(part)
    mask = lambda c: F.when(hidden & F.col(c).isNotNull(), X.MASK).otherwise(F.col(c)).alias(c)
    return d.select("path", mask("a"), mask("b"), hidden.alias("sensitive"))
