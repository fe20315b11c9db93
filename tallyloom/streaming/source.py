"""A streaming source of transcript lines whose offsets are places in files, and the state that each file's parser carries on.

An offset names every file below the root with the byte behind its last complete line, a hash of its first line and one of the 4 KB
before that byte.  A batch reads the ranges between two offsets; a file that no longer holds what the earlier offset says is read
from its start.  Line 0 tells the parser's state to begin anew.  An offset has an entry for each file, so a root should hold the files
of one host or user, not all of a fleet's: several roots are several streams into one log.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import transcripts as T

BLOCK = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "source_path string, line_no long, n_bytes long, line string"


def _hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def _before(f, at: int) -> str:
    begin = max(0, at - BLOCK)
    return _hash(f.read_at(at - begin, begin))


class Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class LineReader(DataSourceStreamReader):
    """most: bytes that an offset goes on from the last one at most (at least one line of a file).  Spark doesn't tell a source where
    it goes on from; places: a file in which the end of the last planned batch is kept, which has been done or is done again first."""

    def __init__(self, root: str, most: int | None, places: str | None):
        self.root, self.most, self.places = root, most, places
        self.at: dict[str, list] | None = None  # the last offset, where it is known
        self.stats: dict[str, tuple] = {}

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None and self.places:
            store, base = fs.FileSystem.from_uri(T.uri(self.places))
            self.at = json.loads(store.open_input_stream(base).read()) if store.get_file_info(base).type == fs.FileType.File else {}
        left = self.most if self.at is not None else None
        out = dict(self.at or {})
        for path, size, mtime in T.find_files(self.root)[0]:
            if (known := self.stats.get(path)) and known == (size, mtime) and path in out:
                continue
            store, base = fs.FileSystem.from_uri(T.uri(path))
            with store.open_input_file(base) as f:
                size = min(size, f.size())
                end, start = T.last_line_end(f, size), self._start(f, path)
                whole = True
                if left is not None and end - start > left:
                    end, whole = max(T.last_line_end(f, start + left), start), False
                    if end == start and left == self.most:  # a line that is longer than all that may be read
                        end = self._next_line(f, start, size)
                if left is not None:
                    left -= min(left, end - start)
                if end > 0:
                    out[path] = [end, _hash(f.read_at(min(BLOCK, size), 0).partition(b"\n")[0]), _before(f, end)]
                if whole:
                    self.stats[path] = (size, mtime)
        self.at = out
        return out

    def _start(self, f, path: str) -> int:
        """Where a file goes on from the last offset; 0 if it isn't the file that it was."""
        end, first, block = (self.at or {}).get(path, [0, "", ""])
        if not 0 < end <= f.size() or _hash(f.read_at(min(BLOCK, f.size()), 0).partition(b"\n")[0]) != first or _before(f, end) != block:
            return 0
        return end

    @staticmethod
    def _next_line(f, at: int, size: int) -> int:
        while at < size:
            data = f.read_at(min(1 << 20, size - at), at)
            if (cut := data.find(b"\n")) >= 0:
                return at + cut + 1
            at += len(data)
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (to, *_) in end.items():
            if start.get(path) == end[path]:
                continue
            store, base = fs.FileSystem.from_uri(T.uri(path))
            if store.get_file_info(base).type != fs.FileType.File:
                continue  # gone since
            with store.open_input_file(base) as f:
                begin = LineReader._start(Known(start), f, path)
                to = min(to, f.size())
            out += [Range(path, begin, at, to) for at in range(begin, to, T.RANGE)]
        self.at = dict(end)
        if self.places:
            store, base = fs.FileSystem.from_uri(T.uri(self.places))
            store.create_dir(base.rpartition("/")[0], recursive=True)
            with store.open_output_stream(base + ".new") as f:
                f.write(json.dumps(end).encode())
            store.move(base + ".new", base)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(T.uri(partition.path))
        with store.open_input_file(base) as f:
            r = {"source_path": partition.path, "generation": 0, "first": partition.first, "start": partition.start, "size": partition.end, "sid0": None, "turn0": 0}
            for found in T._lines_of(f, r):
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("source_path", "line_no", "n_bytes", "line")} for x in found], pa.schema([("source_path", pa.string()), ("line_no", pa.int64()), ("n_bytes", pa.int64()), ("line", pa.string())]))


class Known:
    def __init__(self, at: dict):
        self.at = at


class TranscriptLines(DataSource):
    """Format `transcript_lines`; options: root, most (the bytes of a batch) and places (see LineReader)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> LineReader:  # noqa: N802
        return LineReader(self.options["root"], int(self.options["most"]) if "most" in self.options else None, self.options.get("places"))


class FileState(StatefulProcessor):
    """Adds to a file's lines the session and turn that the file was in before this batch, and keeps those it leaves it in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("parser", "sid string, turn long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = list(rows)  # what a batch has of one file; `most` bounds it
        pdf = pd.concat(parts).sort_values("line_no")
        sid, turn = self.held.get() if self.held.exists() and pdf["line_no"].iloc[0] != 0 else (None, 0)
        named = pdf["sid"].dropna()
        self.held.update((named.iloc[-1] if len(named) else sid, int(turn + pdf["turns"].sum())))
        yield pd.DataFrame({"source_path": key[0], "generation": 0, "line_no": pdf["line_no"], "n_bytes": pdf["n_bytes"], "line": pdf["line"], "sid0": sid, "turn0": turn})

    def close(self) -> None:
        pass


def lines_of(spark: SparkSession, root: str, places: str, most: int | None = None) -> DataFrame:
    """A stream of LINES below a root; every batch's sid0 and turn0 are those in which the batch finds the file."""
    spark.dataSource.register(TranscriptLines)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.format("transcript_lines").option("root", root).option("places", places)
    rows = (source if most is None else source.option("most", str(most))).load()
    j = F.from_json("line", "type string, id string, payload struct<type string, id string>")
    sid = F.when(F.col("j.type") == "session_meta", F.col("j.payload.id")).when(F.col("j.type") == "session", F.col("j.id"))
    turns = F.coalesce((F.col("j.payload.type") == "task_started").cast("int"), F.lit(0))
    ready = rows.withColumn("j", F.when(T.is_record(F.col("line")), j)).select("source_path", "line_no", "n_bytes", "line", sid.alias("sid"), turns.alias("turns"))
    return ready.groupBy("source_path").transformWithStateInPandas(FileState(), T.LINES, "Append", "None")
