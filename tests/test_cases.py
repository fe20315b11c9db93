"""Functions on stated cases: what goes in and what must come out."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import records as P
from tallyloom.functions import text as X
from tallyloom.functions import when
from tallyloom.operators import asking as A
from tallyloom.operators import relational as O
from tallyloom.sources import transcripts as T

NOW = 1_710_500_000_000  # Friday, 15 March 2024, 10:53:20 UTC
CASES, ASKED = {}, {}


def case(name, fn, rows, kind="string"):
    CASES[name] = (fn, rows, kind)


def asked(name, fn, rows):
    ASKED[name] = (fn, rows)


D = 86_400_000
MAR1, MAR14, MAR15 = 1_709_251_200_000, 1_710_374_400_000, 1_710_460_800_000

case("clean_texts", lambda c: X.clean(c, 30), [("  hello there  ", "hello there"), ("a token = 0123456789abcdef", "a token = [redacted]"), ("x" * 40, "x" * 30 + "…"), ("w " * 40_000 + "<private>p</private>", "w " * 15 + "…"), ("w " * 40_000, "w " * 15 + "…"), (None, None)])
case("error_digests", lambda c: X.error_digest(c, 1, 2, 40), [("a\n\nb\nc\nd\ne", "a\n…\nd\ne"), ("one\ntwo", "one\ntwo"), ("l" * 300, "l" * 40 + "…"), ("", "")])
case("tails", lambda c: X.tail_lines(c, 2, 10), [("a\nb\nc", "b\nc"), ("only", "only"), ("x\n" + "y" * 20, "…" + "y" * 10)])
case("pasted_blocks", P.strip_pasted, [("a <pasted_content id=1>xé</pasted_content> b", "a [pasted 3 chars] b"), ("<pasted_content>no end", "[pasted 6+ chars]"), ("plain", "plain")])
case("times_read", X.parse_ts, [("2024-03-15T00:00:00Z", MAR15), ("2024-03-15T02:00:00+02:00", MAR15), ("2024-03-15 00:00:00.123456", MAR15 + 123), ("2024-03-15", None), ("not a time, surely not", None), (None, None)], "long")
case("excerpts_cut", lambda c: P.excerpt(c, 20), [("short", "short"), ("One two three. Four five six", "One two three.…"), ("alpha beta gamma delta epsilon", "alpha beta gamma…"), ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrst…")])
case("prompts_classified", lambda c: F.concat_ws("|", T.classify_prompt(c, ("^auto:",))["text"], F.coalesce(T.classify_prompt(c, ("^auto:",))["label"], F.when(T.classify_prompt(c, ("^auto:",)).isNotNull(), F.lit("-")))), [
    ("fix the gate", "fix the gate|-"), ("  ", ""), ("[Request interrupted by user]", ""), ("<reminder>only wrapped</reminder>", ""), ("<command-name>/go</command-name><command-args> now </command-args>", "/go now|-"), ("<command-name>/go</command-name>", "/go|-"),
    ("⁣from afar", "from afar|harness"), ("<file name=x>", "<file name=x>|harness"), ("auto: nightly", "auto: nightly|harness"), ("<pasted_content>zz</pasted_content>", "[pasted 2 chars]|-"),
])
case("errors_classified", X.error_class, [
    ("The user doesn't want to proceed with this tool use", None), ("String to replace not found in file", "edit_mismatch"), ("2 tests FAILED", "test_fail"), ("2 tests failed to compile", "test_fail"), ("an assertion", "nonzero_exit"), ("AssertionError: 1", "test_fail"), ("bash: x: command not found", "not_found"),
    ("file not found", "nonzero_exit"), ("Timed out after 5 s", "timeout"), ("Error: no", "error"), ("exit 2", "nonzero_exit"), ("Patch failed: timeout", "edit_mismatch"),
])
case("inputs_in_brief", P.brief, [('{"a": "x", "n": 3, "o": {"p": 1}, "l": [1]}', "a=x n=3"), ('"' + "q" * 210 + '"', "q" * 200 + "…"), ("[1]", ""), ("{}", "")])
case("remotes", X.remote_id, [("git@h.org:T/Repo.git", "h.org/t/repo"), ("https://u:p@h.org/t/repo/", "h.org/t/repo"), ("ssh://git@h.org:22/t/r.git", "h.org:22/t/r"), ("h.org/t/r", "h.org/t/r")])
case("paths_cleaned", lambda c: F.array_join(X.clean_parts(c), "/"), [("/a/./b/../c\\d", "a/c/d"), ("~/x//y", "x/y"), ("../z", "z"), ("", "")])
case("tools_named", X.canonical_tool, [("Bash", "shell"), ("exec_command", "shell"), ("NotebookEdit", "edit"), ("MultiEdit", "edit"), ("create", "write"), ("View", "read"), ("WebFetch", "webfetch")])
case("side_threads", T.thread_of, [("/r/p/subagents/one.jsonl", "one"), ("/r/p/subagents/wf/deep/two.jsonl", "two"), ("/r/p/main.jsonl", None)])
case("agents_of_paths", lambda c: T.agent_of(c, {"/h/.claude": "claude", "/h/.claude/odd": "pi", "/h/.codex": "codex"}), [("/h/.claude/p/x.jsonl", "claude"), ("/h/.claude/odd/x.jsonl", "pi"), ("/h/.codex/x.jsonl", "codex"), ("/h/.claudex/x.jsonl", None)])
case("go_ahead_texts", O.go_ahead, [("B", "true"), ("A please", "true"), ("ok let's do AGPL", "true"), ("yes because it is small", "false"), ("go?", "false"), ("", "false"), ("rename all of the old modules", "false")], "boolean")
asked("window_starts", lambda q: (w := when.window(q, NOW)) and w.start, [("what did I do today", MAR15), ("yesterday", MAR14), ("on 2024-03-01", MAR1), ("1 march", MAR1), ("last week", MAR15 - 11 * D), ("this week", MAR15 - 4 * D), ("last month", MAR1 - 29 * D), ("past 3 days", NOW - 3 * D), ("20 december", 1_703_030_400_000), ("how", None)])
asked("window_ends", lambda q: (w := when.window(q, NOW)) and w.end, [("today", NOW), ("yesterday", MAR15), ("since 2024-03-01", NOW), ("on 2024-03-01", MAR1 + D), ("last week", MAR15 - 4 * D), ("last month", MAR1), ("how", None)])
asked("months", when.month, [("sep", 9), ("agu", 8), ("maret", 3), ("ma", None), ("xyz", None), ("mei", 5)])
asked("reports_on_days", lambda t: A.reports_on(t, NOW), [("Update for yesterday, 13 march", MAR14 - D), ("recap of yesterday", MAR14), ("done 1 march", MAR1), ("yesterday", None), ("all is well", None)])


@pytest.mark.parametrize("name", sorted(CASES))
def test_columns(spark, name):
    fn, rows, kind = CASES[name]
    d = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "id int, x string")
    got = [r["result"] for r in d.select("id", fn(F.col("x")).cast(kind).alias("result")).orderBy("id").collect()]
    assert [None if v is None else str(v).lower() if kind == "boolean" else v for v in got] == [w for _, w in rows]


@pytest.mark.parametrize("name", sorted(ASKED))
def test_questions(name):
    fn, rows = ASKED[name]
    assert [fn(x) for x, _ in rows] == [w for _, w in rows]


def test_columns_are_as_the_functions_of_one_question(spark):
    texts = [x for _, rows in ASKED.values() for x, _ in rows] + ["31 feb", "done 1 march 2023", "may 5, 2022 and 3 june", "2024-13-01 or 2 april", "since 3 jan", "LAST 10 WEEKS", "march 45", "1 marzipan", "99 days since 4 dec 1999"]
    d = spark.createDataFrame([(i, x, o) for i, x in enumerate(texts) for o in (-300, 0, 420)], "id int, x string, off int")
    w = when.windows(F.col("x"), F.lit(NOW), F.col("off"))
    for r in d.select("x", "off", w.alias("w"), A.days_reported(F.col("x"), F.lit(NOW), F.col("off")).alias("d"), when.month_of(F.col("x")).alias("m")).collect():
        want = when.window(r["x"], NOW, r["off"])
        assert (r["w"] and tuple(r["w"])) == (want and (want.start, want.end, want.label)), r["x"]
        assert r["d"] == A.reports_on(r["x"], NOW, r["off"]) and r["m"] == when.month(r["x"])
