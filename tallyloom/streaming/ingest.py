"""Continuous ingest of transcripts that agents append to: each record once, the latest content wins.

A sweep lists the files, compares them with the cursors of the last commit, reads the new complete lines of those that changed,
and commits events, quarantine, sessions and cursors together.  Each is a keyed table of runs (operators/keyed.py) under names that
nobody else has; a commit is one file that is made once under its number (sources/commits.py).  So a sweep that dies has done
nothing, and of two sweeps at once one finds its number taken and gives up.  A file goes on from its cursor if it provably still
holds what was read (same first line, not shorter, same 4 KB before the cursor); else it is read again from its start as a new
generation, and the keys of records keep those that are known from counting twice.

`stream` does the same from a streaming source of lines (source.py) whose checkpoint has the places in files; `run` is a turn of the
watch loop with all its steps.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import relational as O
from ..operators.keyed import KeyedTable
from ..sources import transcripts as T
from ..sources.commits import Commits, opened, remove

CURSOR = "source_path string, generation int, offset long, size long, mtime long, fingerprint string, checkpoint string, sid0 string, turn0 long, missing_since long"
EVENTS = "session_id string, record_key string, ts long, kind string, tool string, path string, text string, is_error boolean, label string, thread string, source_path string, line_no long, batch int"
BLOCK = 4096


class Stale(RuntimeError):
    """Another sweep has committed since this one began."""


def _hash(data: bytes) -> str | None:
    return hashlib.sha256(data).hexdigest()[:16] if data else None


def probe(files: DataFrame) -> DataFrame:
    """(source_path, fingerprint, checkpoint) of files (source_path, offset): first line and the block before the offset."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, offset in zip(pdf["source_path"], pdf["offset"], strict=True):
                store, base = fs.FileSystem.from_uri(T.uri(path))
                with store.open_input_file(base) as f:
                    size = f.size()
                    first = f.read_at(min(BLOCK, size), 0).partition(b"\n")[0]
                    at = max(0, int(offset) - BLOCK)
                    out.append((path, _hash(first), _hash(f.read_at(int(offset) - at, at)) if 0 < offset <= size else None))
            yield pd.DataFrame(out, columns=["source_path", "fingerprint", "checkpoint"])

    return files.select("source_path", "offset").mapInPandas(run, "source_path string, fingerprint string, checkpoint string")


class Log:
    """The event log in a folder: four keyed tables and the commits that name their runs."""

    TABLES = {
        "events": (["session_id", "record_key"], EVENTS),
        "sessions": (["id"], "id string, started_at long, last_event_at long, title string"),
        "cursors": (["source_path"], CURSOR),
        "quarantine": (["source_path", "line_no"], "source_path string, line_no long, reason string, line string"),
        "health": (["at"], "at long, files_behind long, bytes_behind long, missing long, quarantined long, events long, backup_age long"),
    }

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.commits = Commits(spark, T.uri(self.out))

    def last(self) -> int:
        """Number of the last commit; -1 for none."""
        return self.commits.number()

    def table(self, name: str, state: dict | None = None) -> KeyedTable:
        """A table at a commit, or at the last one."""
        state = (self.commits.last()[1] or {}) if state is None else state
        keys, schema = self.TABLES[name]
        return KeyedTable(self.spark, f"{T.uri(self.out)}/{name}", keys, schema, state.get(name))

    def cursors(self) -> DataFrame:
        return self.table("cursors").rows()

    def sessions(self) -> DataFrame:
        return self.table("sessions").rows()

    def events(self, excluded: tuple[str, ...] = (), tombstones: DataFrame | None = None) -> DataFrame:
        """One row for each record, from the latest commit that has it; not those under excluded paths nor of forgotten sessions."""
        rows = self.table("events").rows()
        for part in excluded:
            rows = rows.where(~F.col("source_path").contains(part))
        return rows if tombstones is None else O.forget(rows, tombstones, "session", "session_id")

    def quarantine(self) -> DataFrame:
        return self.table("quarantine").rows()

    def lag(self, root: str, now: int, older: int = 300_000) -> DataFrame:
        """(files, bytes) with complete lines unread, that have changed over five minutes ago."""
        files = T.listing(self.spark, T.find_files(root)[0])
        behind = files.join(self.cursors().select("source_path", "offset"), "source_path", "left").where(F.col("mtime") < now - older).withColumn("offset", F.coalesce("offset", F.lit(0))).where("size > offset")
        unread = complete(behind).withColumn("unread", F.col("end") - F.col("offset")).where("unread > 0")
        return unread.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("unread"), F.lit(0)).alias("bytes"))

    def _batch(self, state: dict, number: int, lines: DataFrame, known: dict[str, str] | None) -> dict:
        """The state with the records of new lines (LINES) in its tables; nothing of it counts until it is committed."""
        texts = lines.where("line IS NULL OR trim(line) <> ''")
        newest = F.row_number().over(W.partitionBy("session_id", "record_key").orderBy("source_path", F.col("line_no").desc()))  # of one batch
        agents = [r[0] for r in lines.select(T.agent_of(F.col("source_path"), known)).distinct().collect()]  # three at most
        parsed = T.parse(texts.where("line IS NOT NULL"), known, agents).withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("batch", F.lit(number))
        events = self.table("events", state).put(parsed)
        fresh = session_rows(events._run(events.state[-1])) if events.state != state.get("events", []) else None
        sessions = self.table("sessions", state)
        if fresh is not None:
            sessions = sessions.put(O.upsert_sessions(sessions.like(fresh), fresh))
        bad = self.table("quarantine", state).put(T.quarantine(texts))
        return {**state, "events": events.state, "sessions": sessions.state, "quarantine": bad.state}

    def sweep(self, root: str, now: int | None = None, most_bytes: int | None = None, latest_first: bool = False, known: dict[str, str] | None = None) -> int:
        """Reads what is new below a root and commits it; the batch's number, or the last one's if nothing is new.

        most_bytes: unread bytes that a sweep takes on at most (at least one file), oldest or latest files first; the rest waits."""
        now = int(time.time() * 1000) if now is None else now
        at, state = self.commits.last()
        state = state or {}
        cursors = self.table("cursors", state)
        old = cursors.rows().persist()
        files = T.listing(self.spark, T.find_files(root)[0])
        both = files.join(old.withColumnsRenamed({"size": "old_size", "mtime": "old_mtime"}), "source_path", "left").persist()
        dirty = both.where("size > 0 AND (offset IS NULL OR size <> old_size OR mtime <> old_mtime)").withColumn("offset", F.coalesce("offset", F.lit(0)))
        if most_bytes is not None:
            order = [F.col("mtime").desc() if latest_first else F.col("mtime"), F.col("source_path")]
            dirty = dirty.withColumn("_u", F.greatest(F.col("size") - F.col("offset"), F.lit(0)))
            before = F.coalesce(F.sum("_u").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each file
            dirty = dirty.withColumn("_b", before).where(F.col("_b") + F.col("_u") <= F.greatest(F.lit(most_bytes), F.col("_u") * (F.col("_b") == 0).cast("long"))).drop("_u", "_b")
        lines = todo = None
        try:
            gone = missing(old, files, now).persist()
            if not gone.limit(1).count() and not dirty.limit(1).count():
                return at
            seen = probe(dirty).withColumnsRenamed({"fingerprint": "fp", "checkpoint": "cp"})
            dirty = dirty.join(seen, "source_path")
            same = F.col("generation").isNotNull() & F.col("fingerprint").eqNullSafe(F.col("fp")) & (F.col("size") >= F.col("offset")) & F.col("checkpoint").eqNullSafe(F.col("cp"))
            todo = dirty.select("source_path", "size", "mtime", "fp", same.alias("same"), F.when(same, F.col("generation")).otherwise(F.coalesce(F.col("generation") + 1, F.lit(0))).alias("generation"), F.when(same, F.col("offset")).otherwise(0).cast("long").alias("start"), F.when(same, F.col("sid0")).alias("sid0"), F.when(same, F.col("turn0")).otherwise(0).cast("long").alias("turn0")).persist()
            lines = T.read_ranges(todo).persist()
            new = self._batch(state, at + 1, lines, known)
            ends = lines.groupBy("source_path").agg(F.max(F.col("line_no") + F.col("n_bytes")).alias("end"))
            moved = todo.join(ends, "source_path", "left").withColumn("offset", F.coalesce("end", "start"))
            moved = moved.join(T.state_after(lines.where("line IS NOT NULL")).withColumnsRenamed({"sid0": "sid1", "turn0": "turn1"}), "source_path", "left")
            checked = probe(moved).select("source_path", "checkpoint")
            moved = moved.join(checked, "source_path").select("source_path", "generation", "offset", "size", "mtime", F.col("fp").alias("fingerprint"), "checkpoint", F.coalesce("sid1", "sid0").alias("sid0"), F.coalesce("turn1", "turn0").alias("turn0"), F.lit(None).cast("long").alias("missing_since"))
            changed = moved.unionByName(gone.join(moved.select("source_path"), "source_path", "left_anti"))
            new["cursors"] = cursors.put(changed).state
            if not self.commits.put(at + 1, new):
                raise Stale(f"commit {at + 1} has been made by another sweep")
        finally:
            for df in (lines, todo, both, old):
                if df is not None:
                    df.unpersist()
        return at + 1

    def catch_up(self, root: str, attempts: int = 5, **options) -> int:
        """Sweeps until nothing is new; a sweep that lost to another is repeated, up to `attempts` times."""
        for _ in range(attempts):
            try:
                before = self.last()
                if self.sweep(root, **options) == before:
                    return before
            except Stale:
                continue
        return self.last()

    def change(self, make: Callable[[dict, int], dict], attempts: int = 8) -> int:
        """Commits what `make` makes of the last state, again if another writer came first; the commit's number."""
        for _ in range(attempts):
            at, state = self.commits.last()
            new = make(state or {}, at + 1)
            if new == state:
                return at
            if self.commits.put(at + 1, new):
                return at + 1
        raise Stale(f"{attempts} commits of others came first")

    def compact(self) -> int:
        """Merges the runs of every table that has many of like size; can go on beside sweeps."""
        return self.change(lambda state, _: {**state, **{n: self.table(n, state).merge().state for n in self.TABLES if state.get(n)}})

    # ---- steps that go with a stream of lines

    def take(self, lines: DataFrame, stream: str, batch: int, known: dict[str, str] | None = None) -> None:
        """Commits a stream's batch of lines once: a batch that has been committed is let pass."""
        lines = lines.persist()

        def make(state: dict, number: int) -> dict:
            done = state.get("streams", {})
            if done.get(stream, -1) >= batch:
                return state
            new = self._batch(state, number, lines, known)
            cursors = self.table("cursors", state)
            ends = lines.groupBy("source_path").agg(F.max(F.col("line_no") + F.col("n_bytes")).alias("offset"))
            rows = ends.select("source_path", F.lit(0).alias("generation"), "offset", F.col("offset").alias("size"), *(F.lit(None).cast(t).alias(c) for c, t in (("mtime", "long"), ("fingerprint", "string"), ("checkpoint", "string"), ("sid0", "string"), ("turn0", "long"), ("missing_since", "long"))))
            return {**new, "cursors": cursors.put(rows).state, "streams": {**done, stream: batch}}

        try:
            self.change(make)
        finally:
            lines.unpersist()

    def note_missing(self, root: str, now: int) -> int:
        """Marks the cursors of files that are gone, and unmarks those of files that are back."""
        files = T.listing(self.spark, T.find_files(root)[0])

        def make(state: dict, _: int) -> dict:
            cursors = self.table("cursors", state)
            return {**state, "cursors": cursors.put(missing(cursors.rows(), files, now)).state}

        return self.change(make)

    def check_health(self, root: str, now: int) -> int:
        """Adds a row to the health table: what is behind, missing or in quarantine, and how old the last backup is."""

        def make(state: dict, _: int) -> dict:
            lag, count = self.lag(root, now), lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
            gone = count(self.table("cursors", state).rows().where("missing_since IS NOT NULL"), "missing")
            bad, known = count(self.table("quarantine", state).rows(), "quarantined"), count(self.table("events", state).rows(), "events")
            last = state.get("backup")
            row = lag.join(gone).join(bad).join(known)  # a row each
            row = row.select(F.lit(now).alias("at"), F.col("files").alias("files_behind"), F.col("bytes").alias("bytes_behind"), "missing", "quarantined", "events", F.lit(None if last is None else now - last).cast("long").alias("backup_age"))
            return {**state, "health": self.table("health", state).put(row).state}

        return self.change(make)

    def backup(self, folder: str, now: int, keep: int = 7) -> int:
        """Writes all tables to a folder of their own below `folder`, the latest `keep` of which stay."""
        at, state = self.commits.last()
        for name in self.TABLES:
            self.table(name, state or {}).rows().write.parquet(f"{T.uri(folder)}/{now:015d}/{name}")
        store, root = opened(self.spark, T.uri(folder))
        names = sorted(s.getPath().getName() for s in store.listStatus(root))
        for old in names[:-keep]:
            remove(self.spark, f"{T.uri(folder)}/{old}")
        return self.change(lambda s, _: {**s, "backup": now})

    def stream(self, root: str, checkpoint: str, name: str = "watch", known: dict[str, str] | None = None, seconds: int | None = None, most_bytes: int | None = None) -> StreamingQuery:
        """Reads new lines as a stream (source.py), with each file's parser state, and commits batch by batch, every so many seconds or
        as soon as there is something."""
        from .source import lines_of

        write = lines_of(self.spark, root, f"{checkpoint.rstrip('/')}/places.json", most_bytes).writeStream.foreachBatch(lambda df, batch: self.take(df, name, batch, known)).option("checkpointLocation", checkpoint)
        return write.trigger(processingTime=f"{seconds or 0} seconds").start()

    def run(self, root: str, checkpoint: str, backups: str, now: int | None = None, health_every: int = 900_000, backup_every: int = 86_400_000, **options) -> dict[str, int]:
        """One turn of the watch loop: all that is new is read, missing files are noted, runs are merged, and health and backup are
        done if they are due.  What ran, with the commit it made."""
        now = int(time.time() * 1000) if now is None else now
        query = self.stream(root, checkpoint, **options)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        done = {"read": self.last(), "missing": self.note_missing(root, now), "merged": self.compact()}
        state = self.commits.last()[1] or {}
        last = self.table("health", state).rows().agg(F.max("at")).first()[0]
        if last is None or now - last >= health_every:
            done["health"] = self.check_health(root, now)
        if state.get("backup") is None or now - state["backup"] >= backup_every:
            done["backup"] = self.backup(backups, now)
        return done


def missing(cursors: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Cursors whose files have gone since, or are back: as they are now to be."""
    rows = cursors.join(files.select("source_path", F.lit(True).alias("here")), "source_path", "left")
    rows = rows.where("(here IS NULL) = (missing_since IS NULL)")
    return rows.withColumn("missing_since", F.when(F.col("here").isNull(), F.lit(now)).cast("long")).drop("here")


def complete(files: DataFrame) -> DataFrame:
    """files (source_path, size, offset, ...) with `end`, where their last complete line ends."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ends = []
            for path, size in zip(pdf["source_path"], pdf["size"], strict=True):
                store, base = fs.FileSystem.from_uri(T.uri(path))
                with store.open_input_file(base) as f:
                    ends.append(T.last_line_end(f, min(int(size), f.size())))
            yield pd.DataFrame({"source_path": pdf["source_path"], "end": ends})

    found = files.select("source_path", "size").mapInPandas(run, "source_path string, end long")
    return files.join(found, "source_path")


def session_rows(events: DataFrame) -> DataFrame:
    title = F.when(F.col("kind") == "title", F.col("text"))
    return events.groupBy(F.col("session_id").alias("id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.max_by(title, F.when(title.isNotNull(), F.col("line_no"))).alias("title"))


def human_prompts(events: DataFrame) -> DataFrame:
    """Prompts that a person typed in the main thread."""
    return events.where("kind = 'prompt' AND label IS NULL AND thread IS NULL")
