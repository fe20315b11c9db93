"""Transcript lines of three coding agents to rows of one event log.

Each adapter is one projection: from_json with a permissive schema, explode of content parts, and CASE.  Lines that aren't JSON
objects go to quarantine, redacted and shortened.  Columns: EVENT.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X

EVENT = ("session_id", "record_key", "ts", "kind", "tool", "path", "text", "is_error", "label", "thread", "source_path", "line_no")
LONGEST = 64 << 20

CLAUDE = """type string, uuid string, sessionId string, cwd string, gitBranch string, timestamp string, isMeta boolean, isSidechain boolean, isCompactSummary boolean,
 isApiErrorMessage boolean, aiTitle string, subtype string, content string, message struct<role string, content string>"""
PART = "array<struct<type string, text string, id string, name string, input string, tool_use_id string, is_error boolean, content string>>"
CODEX = """timestamp string, ordinal long, type string, payload struct<type string, id string, cwd string, turn_id string, message string, last_agent_message string,
 git struct<repository_url string, branch string>, item struct<type string, text string, content string, command array<string>, exit_code int, aggregated_output string,
 changes map<string, string>, status string, server string, tool string, arguments string>>"""
PI = "type string, id string, parentId string, timestamp string, cwd string, summary string, message struct<role string, content string, toolCallId string, toolName string, isError boolean, command string, exitCode int, output string>"
PI_PART = "array<struct<type string, text string, id string, name string, arguments string>>"


#: Bytes of a file that one task reads.
RANGE = 64 << 20
LINES = "source_path string, generation int, line_no long, n_bytes long, line string, sid0 string, turn0 long"
#: Folders below a home in which the agents keep their transcripts; a name that ends with - stands for all profiles.
HOMES = {"claude": (".claude", ".claude-"), "codex": (".codex",), "pi": (".pi",)}


def uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path if "://" in path else "file://" + os.path.abspath(path)


def find_files(root: str, deadline: float | None = None) -> tuple[list[tuple[str, int, int]], bool]:
    """((path, bytes, ms of the last change) of all *.jsonl below a root, whether the deadline (time.monotonic) cut it short).

    Folders whose names begin with a dot are read, too; links aren't followed.  A root that isn't there has none."""
    store, base = fs.FileSystem.from_uri(uri(root))
    left, out = [base], []
    while left:
        if deadline is not None and time.monotonic() > deadline:
            return sorted(out), True
        for info in store.get_file_info(fs.FileSelector(left.pop(), allow_not_found=True)):
            if isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory:
                left.append(info.path)
            elif info.path.endswith(".jsonl"):
                out.append((info.path if isinstance(store, fs.LocalFileSystem) else uri(root).split("://")[0] + "://" + info.path, info.size, (info.mtime_ns or 0) // 1_000_000))
    return sorted(out), False


def roots(home: str) -> dict[str, str]:
    """Transcript folders of a home -> agent: the agents' own and those of their profiles."""
    store, base = fs.FileSystem.from_uri(uri(home))
    names = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory]
    return {f"{base.rstrip('/')}/{n}": agent for agent, own in HOMES.items() for n in sorted(names) if any(n == o or o.endswith("-") and n.startswith(o) for o in own)}


def listing(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(files, "source_path string, size long, mtime long")


def read_ranges(files: DataFrame) -> DataFrame:
    """LINES of files (source_path, generation, start, size, sid0, turn0): complete lines from start on, each with its offset.

    A file is cut into ranges of RANGE bytes; a line belongs to the range that it begins in.  The last line waits for its
    end.  Bytes that aren't UTF-8 become replacement marks.  Of a line of over LONGEST bytes only the size is kept (line is null)."""
    starts = F.when(F.col("size") > F.col("start"), F.sequence("start", F.greatest(F.col("size") - 1, F.col("start")), F.lit(RANGE)))
    cut = files.select("source_path", "generation", F.col("start").alias("first"), F.explode(starts).alias("start"), "size", "sid0", "turn0")
    cut = cut.repartition(F.col("source_path"), F.col("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(uri(r["source_path"]))
                with store.open_input_file(base) as f:
                    for found in _lines_of(f, r):
                        yield pa.RecordBatch.from_pylist(found, _LINES)

    return cut.mapInArrow(run, LINES)


_LINES = pa.schema([("source_path", pa.string()), ("generation", pa.int32()), ("line_no", pa.int64()), ("n_bytes", pa.int64()), ("line", pa.string()), ("sid0", pa.string()), ("turn0", pa.int64())])


def _lines_of(f, r: dict) -> Iterator[list[dict]]:
    end, size = min(r["start"] + RANGE, r["size"]), r["size"]
    at = r["start"] - (r["start"] > r["first"])  # the byte before tells whether a line begins here
    skip = at < r["start"]
    f.seek(at)
    held, begin, long, out, weight = [], at, 0, [], 0
    while at < size and begin < end:
        data = f.read(min(1 << 20, size - at))
        if not data:
            break
        at += len(data)
        pieces = data.split(b"\n")
        for piece in pieces[:-1]:
            n = long + sum(map(len, held)) + len(piece) + 1
            if skip:
                skip = False
            elif begin < end:
                line = None if n > LONGEST else (b"".join(held) + piece).decode("utf-8", "replace")
                out.append({"source_path": r["source_path"], "generation": r["generation"], "line_no": begin, "n_bytes": n, "line": line, "sid0": r["sid0"], "turn0": r["turn0"]})
                weight += n
            begin, held, long = begin + n, [], 0
        held.append(pieces[-1])
        if sum(map(len, held)) > LONGEST:  # only its size matters now
            long, held = long + sum(map(len, held)), []
        if weight > 4 << 20:
            yield out
            out, weight = [], 0
    if out:
        yield out


def last_line_end(f, size: int) -> int:
    """The byte behind the last newline before `size`; 0 if there is none."""
    at = size
    while at > 0:
        begin = max(0, at - (1 << 16))
        cut = f.read_at(at - begin, begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """LINES of all transcripts below a root; line_no is the offset in bytes."""
    files = listing(spark, find_files(root)[0]).where("size > 0")
    none = files.select("source_path", F.lit(0).alias("generation"), F.lit(0).cast("long").alias("start"), "size", F.lit(None).cast("string").alias("sid0"), F.lit(0).cast("long").alias("turn0"))
    return read_ranges(none).where("line IS NULL OR trim(line) <> ''")


def line_at(spark: SparkSession, path: str, offset: int, most: int = 4 << 20) -> str | None:
    """The record at an offset, if it ends within `most` bytes."""
    store, base = fs.FileSystem.from_uri(uri(path))
    with store.open_input_file(base) as f:
        data = f.read_at(min(most, max(0, f.size() - offset)), offset)
    line, end, _ = data.partition(b"\n")
    return line.decode("utf-8", "replace") if end else None


def agent_of(path: Column, known: dict[str, str] | None = None) -> Column:
    """The agent whose folder (see roots) a path lies in, the deepest one first; without roots, by the folder's name; null for others."""
    if known is not None:
        out = F.lit(None).cast("string")
        for root, agent in sorted(known.items()):  # deeper ones come later and win
            out = F.when(path.startswith(root.rstrip("/") + "/"), agent).otherwise(out)
        return out
    return F.when(path.rlike(r"/\.?claude[^/]*/"), "claude").when(path.rlike(r"/\.?codex/"), "codex").when(path.rlike(r"/\.?pi/"), "pi")


def thread_of(path: Column) -> Column:
    """A side thread's name: the stem of a file below a folder of sub-agents."""
    got = F.regexp_extract(path, r"/subagents/(?:.*/)?([^/]+)\.jsonl$", 1)
    return F.when(got != "", got)


def is_record(line: Column) -> Column:
    return F.coalesce(F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{"), F.lit(False)) & (F.octet_length(line) <= LONGEST)


def quarantine(lines: DataFrame) -> DataFrame:
    bad = lines.where("line IS NULL").unionByName(lines.where(~is_record(F.col("line"))))
    reason = F.when(F.col("line").isNull() | (F.octet_length("line") > LONGEST), "too long").otherwise("not a JSON object")
    return bad.select("source_path", "line_no", reason.alias("reason"), F.substring(X.redact(F.col("line")), 1, 2000).alias("line")).dropDuplicates(["source_path", "line_no"])


def classify_prompt(raw: Column, harness: tuple[str, ...] = ()) -> Column:
    """struct(text, label) of a prompt worth keeping, else null: empty texts, interruptions and plain wrappers aren't.

    The label is `harness` for what a program wrote: a configured pattern, an invisible separator, a file or a handed-over history.
    A slash command becomes its name and arguments."""
    t = F.trim(R.strip_pasted(F.trim(raw)))
    tag = lambda n: F.trim(F.regexp_extract(t, rf"(?s)<{n}>(.*?)</{n}>", 1))
    mark = "\u2063"
    made = F.lit(False)
    for pattern in harness:
        made = made | t.rlike(pattern)
    keep = lambda text, label: F.struct(text.alias("text"), F.lit(label).cast("string").alias("label"))
    return (
        F.when((t == "") | t.startswith("[Request interrupted"), F.lit(None).cast("struct<text:string,label:string>"))
        .when(made, keep(t, "harness"))
        .when(t.contains(mark), keep(F.trim(F.replace(t, F.lit(mark), F.lit(""))), "harness"))
        .when(t.startswith("<file name=") | t.startswith("The following is the Codex agent history"), keep(t, "harness"))
        .when(~t.startswith("<"), keep(t, None))
        .when(t.rlike("(?s)<command-name>.*?</command-name>"), keep(F.trim(F.concat_ws(" ", tag("command-name"), tag("command-args"))), None))
    )


def _texts(content: Column, parts: Column) -> Column:
    """A message's text: a plain string, or its text parts by lines."""
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.when(F.ltrim(content).startswith("["), joined).otherwise(content)


def _events(rows: DataFrame, found: Column, session: Column) -> DataFrame:
    """Explodes an array of events, drops nulls and empty texts, redacts."""
    out = rows.select(session.alias("session_id"), "ts", "source_path", "line_no", F.posexplode(F.filter(found, lambda e: e.isNotNull() & (F.coalesce(e["text"], F.lit("")) != ""))).alias("n", "e"))
    is_prompt = F.col("e.kind") == "prompt"
    out = out.withColumn("p", F.when(is_prompt, classify_prompt(F.col("e.text")))).where(~is_prompt | F.col("p").isNotNull())
    key = F.coalesce(F.col("e.key"), F.concat_ws(":", "line_no", "n"))
    cols = {"record_key": key, "ts": F.col("ts"), "kind": F.col("e.kind"), "tool": X.canonical_tool(F.col("e.tool")), "path": F.col("e.path"), "text": X.redact(F.trim(F.when(is_prompt, F.col("p.text")).otherwise(F.col("e.text")))), "is_error": F.col("e.is_error"), "label": F.col("p.label"), "thread": thread_of(F.col("source_path"))}
    return out.select("session_id", *(v.alias(k) for k, v in cols.items()), "source_path", "line_no").select(*EVENT)


def event(kind, text: Column, tool: Column | None = None, path: Column | None = None, is_error: bool = False, key: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), (tool if tool is not None else none).alias("tool"), (path if path is not None else none).alias("path"), F.lit(is_error).alias("is_error"), (key if key is not None else none).alias("key"))


def claude(lines: DataFrame) -> DataFrame:
    r = lines.where(is_record(F.col("line"))).withColumn("j", F.from_json("line", CLAUDE)).withColumn("parts", F.from_json("j.message.content", PART)).withColumn("ts", X.parse_ts(F.col("j.timestamp")))
    j = lambda c: F.col(f"j.{c}")
    own = ~F.coalesce(j("isMeta"), F.lit(False)) & ~F.coalesce(j("isSidechain"), F.lit(False))
    text = _texts(j("message.content"), F.col("parts"))

    def tool(p: Column) -> Column:
        get = lambda k: F.get_json_object(p["input"], f"$.{k}")
        kind = F.when(X.canonical_tool(p["name"]) == "shell", "command").when(X.canonical_tool(p["name"]).isin("edit", "write"), "file_edit").when(X.canonical_tool(p["name"]) == "read", "file_read").otherwise("tool")
        return event(kind, F.coalesce(get("command"), get("file_path"), p["input"]), p["name"], get("file_path"), key=p["id"])

    tools = F.transform(F.filter(F.col("parts"), lambda p: (p["type"] == "tool_use") & ~F.lower(p["name"]).isin(*X.QUIET_TOOLS)), tool)
    errors = F.transform(F.filter(F.col("parts"), lambda p: (p["type"] == "tool_result") & F.coalesce(p["is_error"], F.lit(False)) & X.error_class(p["content"]).isNotNull()), lambda p: event("error", p["content"], is_error=True, key=F.concat(p["tool_use_id"], F.lit(":error"))))
    none = F.lit(None).cast("array<struct<kind:string,text:string,tool:string,path:string,is_error:boolean,key:string>>")
    found = (
        F.when(j("type") == "ai-title", F.array(event("title", j("aiTitle"))))
        .when((j("type") == "system") & (j("subtype") == "away_summary"), F.array(event("recap", j("content"), key=j("uuid"))))
        .when((j("type") == "user") & F.coalesce(j("isCompactSummary"), F.lit(False)), F.array(event("compaction", text, key=j("uuid"))))
        .when((j("type") == "user") & own, F.concat(F.array(event("prompt", text, key=j("uuid"))), F.coalesce(errors, F.array().cast(none_type))))
        .when((j("type") == "assistant") & own & ~F.coalesce(j("isApiErrorMessage"), F.lit(False)), F.concat(F.coalesce(tools, F.array().cast(none_type)), F.array(event("assistant", text, key=j("uuid")))))
        .otherwise(none)
    )
    return _events(r, found, F.concat(F.lit("claude:"), j("sessionId")))


none_type = "array<struct<kind:string,text:string,tool:string,path:string,is_error:boolean,key:string>>"


def _state(lines: DataFrame, name: str, kind: str) -> Column:
    """What an earlier read of the file left behind."""
    return F.col(name) if name in lines.columns else F.lit(None).cast(kind)


def state_after(lines: DataFrame) -> DataFrame:
    """(source_path, sid0, turn0): session and turn that a file's next lines continue."""
    j = F.from_json("line", "type string, id string, payload struct<type string, id string>")
    r = lines.where(is_record(F.col("line"))).select("source_path", "line_no", "sid0", "turn0", j.alias("j"))
    sid = F.when(F.col("j.type") == "session_meta", F.col("j.payload.id")).when(F.col("j.type") == "session", F.col("j.id"))
    turns = F.count_if(F.col("j.payload.type") == "task_started")
    got = r.groupBy("source_path").agg(F.max_by(sid, F.when(sid.isNotNull(), F.col("line_no"))).alias("sid"), F.first("sid0").alias("old"), (turns + F.coalesce(F.first("turn0"), F.lit(0))).alias("turn0"))
    return got.select("source_path", F.coalesce("sid", "old").alias("sid0"), "turn0")


def codex(lines: DataFrame) -> DataFrame:
    """Envelopes that repeat a message collapse by a key of turn and text."""
    from pyspark.sql import Window as W

    r = lines.where(is_record(F.col("line"))).withColumn("j", F.from_json("line", CODEX)).withColumn("ts", X.parse_ts(F.col("j.timestamp")))
    by = W.partitionBy("source_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    sid = F.coalesce(F.last(F.when(F.col("j.type") == "session_meta", F.col("j.payload.id")), ignorenulls=True).over(by), _state(r, "sid0", "string"))
    turn = F.sum(F.when(F.col("j.payload.type") == "task_started", 1).otherwise(0)).over(by) + F.coalesce(_state(r, "turn0", "long"), F.lit(0))
    r = r.withColumn("sid", sid).withColumn("turn", turn)
    p = lambda c: F.col(f"j.payload.{c}")
    i = lambda c: F.col(f"j.payload.item.{c}")
    said = lambda who, text: F.concat(F.lit(who + ":"), F.col("turn").cast("string"), F.lit(":"), X.short_hash(F.trim(text)))
    body = F.coalesce(i("text"), _texts(i("content"), F.from_json(i("content"), PI_PART)))
    command = F.array_join(i("command"), " ")
    kind = p("type")
    found = (
        F.when(F.col("j.type") != "event_msg", F.lit(None).cast(none_type))
        .when(kind == "user_message", F.array(event("prompt", p("message"), key=said("u", p("message")))))
        .when(kind == "agent_message", F.array(event("assistant", p("message"), key=said("a", p("message")))))
        .when(kind == "task_complete", F.array(event("assistant", p("last_agent_message"), key=said("a", p("last_agent_message")))))
        .when((kind == "item_completed") & (i("type") == "UserMessage"), F.array(event("prompt", body, key=said("u", body))))
        .when((kind == "item_completed") & (i("type") == "AgentMessage"), F.array(event("assistant", body, key=said("a", body))))
        .when((kind == "item_completed") & (i("type") == "CommandExecution"), F.array(event("command", command, F.lit("shell")), F.when(F.coalesce(i("exit_code"), F.lit(0)) != 0, event("error", F.coalesce(i("aggregated_output"), command), is_error=True))))
        .when((kind == "item_completed") & (i("type") == "FileChange"), F.transform(F.map_keys(i("changes")), lambda k: event("file_edit", k, F.lit("edit"), k)))
        .when((kind == "item_completed") & (i("type") == "McpToolCall"), F.array(event("tool", F.concat_ws(" ", i("server"), i("tool"), i("arguments")), i("tool"))))
    )
    events = _events(r, found, F.concat(F.lit("codex:"), F.col("sid")))
    first = F.row_number().over(W.partitionBy("session_id", "record_key").orderBy("source_path", "line_no"))
    return events.withColumn("_n", first).where("_n = 1").drop("_n")


def pi(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    r = lines.where(is_record(F.col("line"))).withColumn("j", F.from_json("line", PI)).withColumn("parts", F.from_json("j.message.content", PI_PART)).withColumn("ts", X.parse_ts(F.col("j.timestamp")))
    by = W.partitionBy("source_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("sid", F.coalesce(F.last(F.when(F.col("j.type") == "session", F.col("j.id")), ignorenulls=True).over(by), _state(r, "sid0", "string")))
    m = lambda c: F.col(f"j.message.{c}")
    text = _texts(m("content"), F.col("parts"))

    def tool(x: Column) -> Column:
        get = lambda k: F.get_json_object(x["arguments"], f"$.{k}")
        kind = F.when(X.canonical_tool(x["name"]) == "shell", "command").when(X.canonical_tool(x["name"]).isin("edit", "write"), "file_edit").when(X.canonical_tool(x["name"]) == "read", "file_read").otherwise("tool")
        return event(kind, F.coalesce(get("command"), get("path"), x["arguments"]), x["name"], get("path"), key=x["id"])

    tools = F.coalesce(F.transform(F.filter(F.col("parts"), lambda x: (x["type"] == "toolCall") & ~F.lower(x["name"]).isin(*X.QUIET_TOOLS)), tool), F.array().cast(none_type))
    found = (
        F.when(F.col("j.type") == "compaction", F.array(event("compaction", F.col("j.summary"), key=F.col("j.id"))))
        .when((F.col("j.type") == "message") & (m("role") == "user"), F.array(event("prompt", text, key=F.col("j.id"))))
        .when((F.col("j.type") == "message") & (m("role") == "assistant"), F.concat(tools, F.array(event("assistant", text, key=F.col("j.id")))))
        .when((F.col("j.type") == "message") & (m("role") == "toolResult") & F.coalesce(m("isError"), F.lit(False)), F.array(event("error", text, m("toolName"), is_error=True, key=F.col("j.id"))))
        .when((F.col("j.type") == "message") & (m("role") == "bashExecution"), F.array(event("command", m("command"), F.lit("shell"), key=F.col("j.id")), F.when(F.coalesce(m("exitCode"), F.lit(0)) != 0, event("error", F.coalesce(m("output"), m("command")), is_error=True))))
    )
    return _events(r, found, F.concat(F.lit("pi:"), F.col("sid")))


ADAPTERS = {"claude": claude, "codex": codex, "pi": pi}


def parse(lines: DataFrame, known: dict[str, str] | None = None, agents: list[str] | None = None) -> DataFrame:
    """Events of all lines, by the agent of their path (known: folders of the agents, see roots; agents: those that have lines)."""
    of, out = agent_of(F.col("source_path"), known), None
    for name in ADAPTERS if not agents else [a for a in ADAPTERS if a in agents]:
        one = ADAPTERS[name](lines.where(of == name))
        out = one if out is None else out.unionByName(one)
    return out
