"""Adapters and continuous ingest on sessions written for these tests: several tools at once, side files, bad lines, growth."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import transcripts as T
from tallyloom.streaming import ingest


def stamp(minute):
    return f"2025-02-11T08:{minute:02d}:30Z"


def say(who, minute, content, session="blue", **more):
    return {"type": who, "uuid": f"{session}-{minute}", "sessionId": session, "timestamp": stamp(minute), "message": {"role": who, "content": content}, **more}


def call(name, id, **given):
    return {"type": "tool_use", "id": id, "name": name, "input": given}


GARDEN = [
    say("user", 1, "plan the garden beds"),
    say("assistant", 2, [call("Write", "w-1", file_path="/g/plan.md"), call("NotebookEdit", "n-1", file_path="/g/beds.ipynb"), call("Grep", "q-1", pattern="x"), call("Bash", "b-1", command="make plots"), {"type": "text", "text": "drew two beds"}]),
    say("user", 3, [{"type": "tool_result", "tool_use_id": "b-1", "is_error": True, "content": "make: *** Traceback in plots"}, {"type": "tool_result", "tool_use_id": "w-1", "is_error": True, "content": "The user denied this"}]),
    say("user", 4, "<command-name>/water</command-name> <command-args>north bed</command-args>"),
    say("user", 5, "<system-reminder>only a wrapper</system-reminder>"),
    say("user", 6, "[Request interrupted by user]"),
    say("user", 7, "\u2063run the nightly task"),
    say("assistant", 8, "secret = tulips-and-roses", isApiErrorMessage=True),
    say("mystery", 9, "a kind that nobody knows"),
    "no json at all",
    "[1, 2]",
]


def write(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\n".join(x if isinstance(x, bytes) else (x if isinstance(x, str) else json.dumps(x)).encode() for x in lines) + end.encode())


def kept(df):
    return sorted(str((r["kind"], r["tool"], r["text"], r["label"])) for r in df.collect())


def test_one_garden_session(spark, tmp_path):
    path = str(tmp_path / ".claude-work/projects/g/blue.jsonl")
    write(path, GARDEN)
    lines = T.read_lines(spark, str(tmp_path)).cache()
    want = [
        ("prompt", None, "plan the garden beds", None), ("file_edit", "write", "/g/plan.md", None), ("file_edit", "edit", "/g/beds.ipynb", None), ("command", "shell", "make plots", None),
        ("assistant", None, "drew two beds", None), ("error", None, "make: *** Traceback in plots", None), ("prompt", None, "/water north bed", None), ("prompt", None, "run the nightly task", "harness"),
    ]
    assert kept(T.parse(lines)) == sorted(map(str, want))
    assert sorted(r["line"] for r in T.quarantine(lines).collect()) == ["[1, 2]", "no json at all"]
    assert T.roots(str(tmp_path)) == {str(tmp_path / ".claude-work"): "claude"}
    last = lines.orderBy(F.col("line_no").desc()).first()
    assert T.line_at(spark, path, last["line_no"]) == "[1, 2]"
    assert T.find_files(str(tmp_path), deadline=0.0) == ([], True)


def test_ranges_cut_anywhere_give_the_same_lines(spark, tmp_path, monkeypatch):
    rows = [b"x" * n + b"\xff\xc3\xa9" for n in (0, 1, 5, 40, 3, 200, 7)] + [b"", b"last"]
    write(str(tmp_path / "a.jsonl"), rows, end="\nunfinished")
    size = os.path.getsize(tmp_path / "a.jsonl")
    for width in (1, 7, 64, 1000):
        monkeypatch.setattr(T, "RANGE", width)
        got = []
        with open(tmp_path / "a.jsonl", "rb") as f:
            for start in range(0, size, width):
                for part in T._lines_of(f, {"source_path": "a", "generation": 0, "first": 0, "start": start, "size": size, "sid0": None, "turn0": 0}):
                    got += part
        assert [g["line"] for g in got] == [r.decode("utf-8", "replace") for r in rows]
        assert [g["line_no"] for g in got] == [sum(len(r) + 1 for r in rows[:i]) for i in range(len(rows))]


def said(n, text):
    return {"timestamp": stamp(n), "type": "event_msg", "payload": {"type": "user_message", "message": text}}


def test_files_grow_and_change(spark, tmp_path):
    """Appended lines, an unfinished tail, state that goes on, a rewritten file, one that goes away and comes back, equal to a batch read."""
    root, log = str(tmp_path / "home"), ingest.Log(spark, str(tmp_path / "log"))
    path = f"{root}/codex/s/r.jsonl"
    begin = [{"timestamp": stamp(0), "type": "session_meta", "payload": {"id": "tide"}}, {"timestamp": stamp(1), "type": "event_msg", "payload": {"type": "task_started", "turn_id": "a"}}, said(2, "first wave")]
    write(path, begin)
    assert log.catch_up(root, now=1000) == 0
    with open(path, "ab") as f:
        f.write((json.dumps(said(3, "second wave")) + "\n" + json.dumps(said(4, "third wave"))).encode())
    assert log.catch_up(root, now=2000) == 1
    rows = log.events().collect()
    assert sorted(r["text"] for r in rows) == ["first wave", "second wave"] and {r["session_id"] for r in rows} == {"codex:tide"}  # the session goes on, the tail waits
    cursor = log.cursors().first()
    assert cursor["generation"] == 0 and cursor["offset"] < os.path.getsize(path) and cursor["turn0"] == 1
    assert log.lag(root, now=10**14).first()["files"] == 0  # its last line isn't complete
    with open(path, "ab") as f:
        f.write(b"\n")
    assert tuple(log.lag(root, now=10**14).first()) == (1, os.path.getsize(path) - cursor["offset"])
    log.catch_up(root, now=3000)
    batch = T.parse(T.read_lines(spark, root))
    assert sorted((r["session_id"], r["record_key"], r["text"]) for r in log.events().collect()) == sorted((r["session_id"], r["record_key"], r["text"]) for r in batch.collect())
    at = log.last()
    assert log.catch_up(root) == at  # nothing new, nothing written
    body = open(path, "rb").read().replace(b"second", b"shared")  # same length, same first line
    open(path, "wb").write(body)
    os.utime(path, (2_000_000_000, 2_000_000_000))
    log.catch_up(root, now=4000)
    assert log.cursors().first()["generation"] == 1
    assert sorted(r["text"] for r in log.events().collect()) == ["first wave", "second wave", "shared wave", "third wave"]  # what was said stays known
    os.rename(path, path + ".away")
    log.catch_up(root, now=5000)
    assert log.cursors().first()["missing_since"] == 5000
    os.rename(path + ".away", path)
    log.catch_up(root, now=6000)
    assert log.cursors().first()["missing_since"] is None
    assert log.events(excluded=("/codex/",)).count() == 0
    gone = spark.createDataFrame([("session", "codex:tide")], "kind string, key string")
    assert log.events(tombstones=gone).count() == 0
    assert {(r["id"], r["started_at"] is not None) for r in log.sessions().collect()} == {("codex:tide", True)}


def test_sweeps_that_lose_and_sweeps_that_die(spark, tmp_path, monkeypatch):
    root, log = str(tmp_path / "home"), ingest.Log(spark, str(tmp_path / "log"))
    write(f"{root}/claude/p/blue.jsonl", [say("user", 1, "hello there garden"), b"\xff broken \xfe"])
    real = T.state_after

    def dies(lines):
        raise OSError("no more")

    monkeypatch.setattr(T, "state_after", dies)
    with pytest.raises(OSError):
        log.sweep(root)
    assert log.last() == -1  # events were written, nothing was committed
    monkeypatch.setattr(T, "state_after", real)
    assert log.catch_up(root) == 0 and log.events().count() == 1
    assert [(r["reason"], "broken" in r["line"]) for r in log.quarantine().collect()] == [("not a JSON object", True)]
    write(f"{root}/claude/p/red.jsonl", [say("user", 2, "one more", session="red")])
    real_parse = T.parse

    def slow(lines, *a):  # another sweep commits between this one's begin and its end
        monkeypatch.setattr(T, "parse", real_parse)
        assert ingest.Log(spark, log.out).sweep(root) == 1
        return real_parse(lines, *a)

    monkeypatch.setattr(T, "parse", slow)
    with pytest.raises(ingest.Stale):
        log.sweep(root)
    assert log.last() == 1 and log.events().count() == 2


def test_a_budget_of_bytes(spark, tmp_path):
    root, log = str(tmp_path / "home"), ingest.Log(spark, str(tmp_path / "log"))
    for i in range(3):
        p = f"{root}/claude/p/s{i}.jsonl"
        write(p, [say("user", 1, "x" * 300, session=f"s{i}")])
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    log.sweep(root, most_bytes=500, latest_first=True)
    assert {r["session_id"] for r in log.events().collect()} == {"claude:s2"}
    log.catch_up(root, most_bytes=500)
    assert log.events().count() == 3


def test_two_sweeps_at_once(spark, tmp_path):
    """Of sweeps that start from the same commit one wins; all records are there once."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "home")
    write(f"{root}/claude/p/blue.jsonl", [say("user", i, f"said {i}") for i in range(5)])

    def sweep(_):
        try:
            return ingest.Log(spark, str(tmp_path / "log")).sweep(root)
        except ingest.Stale:
            return None

    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(sweep, range(3)))
    log = ingest.Log(spark, str(tmp_path / "log"))
    assert numbers.count(0) == 1 and log.last() == 0 and log.events().count() == 5


def test_runs_are_merged(spark, tmp_path):
    root, log = str(tmp_path / "home"), ingest.Log(spark, str(tmp_path / "log"))
    path = f"{root}/claude/p/blue.jsonl"
    for i in range(5):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "ab") as f:
            f.write((json.dumps(say("user", i, f"said {i}")) + "\n").encode())
        log.sweep(root, now=i)
    state = log.commits.last()[1]
    assert len(state["events"]) == 5 and [r["rows"] for r in state["sessions"]] == [1] and [r["rows"] for r in state["cursors"]] == [1]  # what is superseded is out of the way
    before = sorted(map(tuple, log.events().collect()))
    log.compact()
    assert len(log.commits.last()[1]["events"]) == 1 and sorted(map(tuple, log.events().collect())) == before
    assert log.compact() == log.last()


def brief(rows):
    """All but the line: of a record that stands twice a batch read has the first, a log the latest."""
    return sorted((r["session_id"] or "", r["record_key"], r["kind"], r["text"], r["source_path"]) for r in rows.collect())


def test_stream(spark, tmp_path, monkeypatch):
    """Small batches, killed before and after a commit, growth, a rewritten and a missing file: the rows are those of a batch read."""
    root, out, checkpoint = str(tmp_path / "home"), str(tmp_path / "log"), str(tmp_path / "cp")
    log, codex = ingest.Log(spark, out), f"{root}/codex/s/r.jsonl"
    task = {"timestamp": stamp(1), "type": "event_msg", "payload": {"type": "task_started", "turn_id": "a"}}
    write(codex, [{"timestamp": stamp(0), "type": "session_meta", "payload": {"id": "tide"}}, task, said(2, "wave 2"), said(3, "wave 2"), task, said(4, "wave 2"), *[said(n, f"wave {n}") for n in range(5, 12)]])
    for i in range(3):
        write(f"{root}/claude/p/s{i}.jsonl", [say("user", n, f"text {n}", session=f"s{i}") for n in range(4)] + [b"\xff broken"])
    real = ingest.Log._batch
    calls = []

    def dies(self, *a):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("killed before its commit")
        return real(self, *a)

    monkeypatch.setattr(ingest.Log, "_batch", dies)
    put = log.commits.put
    kills = iter([False, True, *[False] * 50])

    def after(number, state):
        made = put(number, state)
        if next(kills):
            raise OSError("killed after its commit")
        return made

    monkeypatch.setattr(log.commits, "put", after)
    ended = 0
    for _ in range(8):
        query = log.stream(root, checkpoint, most_bytes=1200)
        try:
            query.processAllAvailable()
            ended += 1
            break
        except Exception:
            continue
        finally:
            query.stop()
    assert ended == 1 and len(calls) > 3 and log.last() > 1
    monkeypatch.undo()
    batch = lambda: brief(T.parse(T.read_lines(spark, root)))
    assert brief(log.events()) == batch()
    assert log.quarantine().count() == 3
    with open(codex, "ab") as f:
        f.write((json.dumps(said(20, "wave 2")) + "\n" + json.dumps(said(21, "not yet"))).encode())
    turn = log.run(root, checkpoint, str(tmp_path / "backups"), now=10**14)
    assert brief(log.events()) == batch() and {"read", "missing", "merged", "health", "backup"} == set(turn)
    health = log.table("health").rows().first()
    assert (health["files_behind"], health["missing"], health["quarantined"], health["backup_age"]) == (0, 0, 3, None)  # the tail isn't a line yet
    os.remove(f"{root}/claude/p/s0.jsonl")
    body = open(f"{root}/claude/p/s1.jsonl", "rb").read().replace(b"text 3", b"next 3")
    open(f"{root}/claude/p/s1.jsonl", "wb").write(body)
    os.utime(f"{root}/claude/p/s1.jsonl", (2_000_000_000, 2_000_000_000))
    turn = log.run(root, checkpoint, str(tmp_path / "backups"), now=10**14 + 1000)
    assert "health" not in turn and "backup" not in turn
    texts = {(r["session_id"], r["text"]) for r in log.events().collect()}
    assert ("claude:s1", "next 3") in texts and ("claude:s1", "text 3") not in texts and ("claude:s0", "text 3") in texts
    assert [r["source_path"][-8:] for r in log.cursors().where("missing_since IS NOT NULL").collect()] == ["s0.jsonl"]
    assert spark.read.parquet(f"{tmp_path}/backups/{10**14:015d}/events").count() == len(batch()) + 4
