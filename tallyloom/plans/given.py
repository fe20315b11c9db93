"""Functions of single values over the given tables: a row makes the input, and the SQL says what it must come to.

`templated` puts each row's own text or id into one of several forms of input; the SQL puts the same into what the form must come
to, and knows nothing of the function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import records as P
from ..functions import text as X
from ..functions import when
from ..operators import asking as A
from ..operators import files as L
from ..operators import lifecycle
from ..operators import relational as O
from ..sources import transcripts as T
from .record import _KEYS, _masked
from .views import sql, table

QUERIES: dict = {}
NOW = 1_710_500_000_000  # Friday, 15 March 2024, 10:53:20 UTC
DAY = 86_400_000


def query(name: str, text: str, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(text, *names))
        return fn

    return keep


def _lit(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


#: Tables whose rows make inputs: id, what {x} stands for, and the same in DuckDB.
PAGES = ("pages", "page_id", "string(page_id)", "page_id::VARCHAR")
EVENTS = ("events", "event_id", "string(event_id)", "event_id::VARCHAR")
TURNS = ("conversations", "conv_id * 100 + turn", "trim(substr(text, 1, 300))", "trim(substr(text, 1, 300))")


def templated(name: str, source: tuple, fn, forms: list[tuple], kind: str = "string") -> None:
    """A query of (id, result): form number id % n of the inputs, with {x} put in; the SQL puts {x} and its bytes {n} into the wanted."""
    tab, id, x, x_sql = source
    cast = {"string": "VARCHAR", "boolean": "BOOLEAN"}[kind]

    def run(s, sf):
        d = table(s, sf, tab).select(F.expr(id).alias("id"), F.expr(x).alias("x"))
        form = F.element_at(F.array(*(F.lit(i) for i, _ in forms)), (F.col("id") % len(forms) + 1).cast("int"))
        return d.select("id", fn(F.replace(form, F.lit("{x}"), F.col("x"))).cast(kind).alias("result"))

    wanted = "[" + ", ".join(_lit(w) for _, w in forms) + "]"
    QUERIES[name] = (run, f"SELECT id, CAST(replace(replace(({wanted})[id % {len(forms)} + 1], '{{n}}', octet_length(encode(x))::VARCHAR), '{{x}}', x) AS {cast}) AS result FROM (SELECT {id} AS id, {x_sql} AS x FROM {tab})")


templated("pasted_blocks", TURNS, P.strip_pasted, [("a <pasted_content id=1>{x}</pasted_content> b", "a [pasted {n} chars] b"), ("<pasted_content>{x}", "[pasted {n}+ chars]"), ("{x}", "{x}"), ("{x} <pasted_content>{x}</pasted_content>.<pasted_content k=2>{x}", "{x} [pasted {n} chars].[pasted {n}+ chars]")])
_prompt = lambda c: (lambda p: F.when(p.isNotNull(), F.concat(p["text"], F.lit("|"), F.coalesce(p["label"], F.lit("-")))))(T.classify_prompt(c, ("^auto:",)))
templated("prompts_classified", TURNS, _prompt, [
    ("  {x} ", "{x}|-"), ("[Request interrupted by user]{x}", None), ("<reminder>{x}</reminder>", None), ("<command-name>/go</command-name><command-args> {x} </command-args>", "/go {x}|-"), ("<command-name>/{x}</command-name>", "/{x}|-"),
    ("⁣{x}", "{x}|harness"), ("<file name=x>{x}", "<file name=x>{x}|harness"), ("auto: {x}", "auto: {x}|harness"), ("The following is the Codex agent history {x}", "The following is the Codex agent history {x}|harness"), ("   ", None),
])
templated("errors_classified", TURNS, X.error_class, [
    ("The user doesn't want to proceed with this tool use: {x}", None), ("{x} String to replace not found in file", "edit_mismatch"), ("2 tests FAILED {x}", "test_fail"), ("{x}\nAssertionError: 1", "test_fail"), ("bash: {x}: command not found", "not_found"),
    ("{x}", "nonzero_exit"), ("Timed out after 5 s {x}", "timeout"), ("{x} Error: no", "error"), ("exit 2 {x}", "nonzero_exit"), ("Patch failed: timeout {x}", "edit_mismatch"), ("npm ERR! Test failed. {x}", "test_fail"), ("{x} Traceback (most recent call last)", "error"),
])
templated("go_ahead_texts", EVENTS, O.go_ahead, [("B", "true"), ("A please", "true"), ("ok let's do AGPL", "true"), ("yes because {x} is small", "false"), ("go {x}?", "false"), ("", "false"), ("rename all of the old {x} modules", "false"), ("option 3, go ahead", "true"), ("use {x}", "true"), ("yes " * 20, "false")], "boolean")
templated("remotes", PAGES, X.remote_id, [("git@h.org:T{x}/Repo.git", "h.org/t{x}/repo"), ("https://u:p@h.org/t/R{x}/", "h.org/t/r{x}"), ("ssh://git@h.org:22/t/r{x}.git", "h.org:22/t/r{x}"), ("H.org/t/r{x}", "h.org/t/r{x}"), ("git://h{x}.org/a/b.git/", "h{x}.org/a/b")])
templated("paths_cleaned", PAGES, lambda c: F.array_join(X.clean_parts(c), "/"), [("/a/./{x}/../c\\d{x}", "a/c/d{x}"), ("~/x//{x}", "x/{x}"), ("../{x}", "{x}"), ("{x}/..", ""), ("/{x}/a/b/../../c", "{x}/c")])
templated("tools_named", EVENTS, X.canonical_tool, [("Bash", "shell"), ("exec_command", "shell"), ("NotebookEdit", "edit"), ("MultiEdit", "edit"), ("create", "write"), ("View", "read"), ("WebFetch", "webfetch"), ("MCP_{x}", "mcp_{x}")])
templated("side_threads", PAGES, T.thread_of, [("/r/p/subagents/a{x}.jsonl", "a{x}"), ("/r/p/subagents/wf/deep/a{x}.jsonl", "a{x}"), ("/r/p/{x}.jsonl", None), ("/r/subagents/{x}.txt", None)])
templated("agents_of_paths", PAGES, lambda c: T.agent_of(c, {"/h/.claude": "claude", "/h/.claude/odd": "pi", "/h/.codex": "codex"}), [("/h/.claude/p/{x}.jsonl", "claude"), ("/h/.claude/odd/{x}.jsonl", "pi"), ("/h/.codex/{x}.jsonl", "codex"), ("/h/.claudex/{x}.jsonl", None)])
templated("model_ids", EVENTS, P.model_id, [("claude-{x}", "anthropic/claude-{x}"), ("router/anthropic/claude-{x}", "anthropic/claude-{x}"), ("gpt-{x}", "openai/gpt-{x}"), ("o3-{x}", "openai/o3-{x}"), ("x/gemini-{x}", "google/gemini-{x}"), ("house/llama-{x}", "house/llama-{x}"), ("codex-{x}", "openai/codex-{x}")])
_failed = lambda c: F.concat_ws("|", P.failure(c)["action"], P.failure(c)["wait_min"].cast("string"))
templated("failure_actions", TURNS, _failed, [("Not logged in {x}", "sign_in"), ("Rate limit hit: {x}", "next_model|30"), ("HTTP 429 {x}", "next_model|30"), ("model {x} does not exist", "next_model|360"), ("socket closed", "next_model|5"), ("{x} please /login", "sign_in"), ("no quota for this model {x}", "next_model|30"), ("unauthorized: quota {x}", "sign_in")])
_prefixes = lambda c: F.concat_ws("|", F.coalesce(P.merge_prefix(c), F.lit("-")), P.default_prefix(c))
templated("merge_prefixes", PAGES, _prefixes, [("team-{x}", "team-{x}|team-{x}"), (" /x.y{x}/ ", "x.y{x}|x.y{x}"), ("no spaces {x}", "-|nospaces{x}"), ("//", "-|team"), ("a" * 40 + "{x}", "-|" + "a" * 40), ("é{x}", "-|{x}")])


def _placed(c: Column) -> Column:
    part = lambda i: F.get(F.split(c, ";"), F.lit(i))
    return L.placement(part(0), F.nullif(part(1), F.lit("")), F.lit("/w/app"), part(2), F.array(F.lit("app")))


templated("path_placement", PAGES, _placed, [
    ("/w/app/src/{x}.py;;src/{x}.py", "exact"), ("/w/app/lib/{x}.py;;src/{x}.py", "no"), ("/home/z/App/src/{x}.py;;src/{x}.py", "exact"), ("/home/z/other/src/{x}.py;;src/{x}.py", "no"), ("{x}.py;/w/app/src;src/{x}.py", "exact"), ("x/src/{x}.py;;p/x/src/{x}.py", "ending"),
    ("{x}.py;;src/{x}.py", "no"), (";;src/{x}.py", "no"), ("p/x/src/{x}.py;;p/x/src/{x}.py", "exact"), ("q/p/x/src/{x}.py;;p/x/src/{x}.py", "no"), ("../src/./{x}.py;/w/app/lib;src/{x}.py", "exact"),
])


def _project(c: Column) -> Column:
    part = lambda i: F.nullif(F.get(F.split(c, ";"), F.lit(i)), F.lit(""))
    return L.project_of(part(0), part(1), part(2))


templated("projects_resolved", PAGES, _project, [("git@h.org:t/App{x}.git;/w/app{x}/;/w/app{x}", "h.org/t/app{x}"), ("https://u@h.org/t/app;/w/app{x};/w/app{x}/src", "h.org/t/app#app{x}"), (";/w/{x};/w/{x}/y", "/w/{x}"), (";;/w/y{x}", "/w/y{x}")])


# ---- whole texts


@query("clean_texts", f"SELECT doc_id, CASE WHEN length(m) > 80 THEN substr(m, 1, 80) || '…' ELSE m END AS clean FROM (SELECT doc_id, {_masked('trim(text)')} AS m FROM documents)")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", X.clean(F.col("text"), 80).alias("clean"))


@query("redaction_shapes", f"SELECT doc_id, {_masked('raw')} AS clean FROM (SELECT doc_id, substr(text, 1, 40) || ' ' || ([{', '.join(_lit(k) for k in _KEYS)}])[doc_id % {len(_KEYS)} + 1] AS raw FROM documents)")
def _(s, sf):
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % len(_KEYS) + 1).cast("int"))
    return table(s, sf, "documents").select("doc_id", X.redact(F.concat(F.substring("text", 1, 40), F.lit(" "), key)).alias("clean"))


@query("error_digests", "SELECT doc_id, CASE WHEN length(d) > 400 THEN substr(d, 1, 400) || '…' ELSE d END AS digest FROM (SELECT doc_id, array_to_string(CASE WHEN len(l) > 3 THEN list_concat(list_concat(l[1:1], ['…']), l[len(l) - 1:]) ELSE l END, chr(10)) AS d FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: substr(x, 1, 200)) AS l FROM documents))")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", X.error_digest(F.col("text"), 1, 2, 400).alias("digest"))


@query("tails", "SELECT doc_id, CASE WHEN length(k) > 100 THEN '…' || right(k, 100) ELSE k END AS tail FROM (SELECT doc_id, array_to_string(l[greatest(len(l) - 1, 1):], chr(10)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", X.tail_lines(F.col("text"), 2, 100).alias("tail"))


@query("excerpts_cut", r"WITH c AS (SELECT doc_id, text, substr(text, 1, 200) AS c FROM documents), b AS (SELECT doc_id, text, c, list_max(list_filter(range(100, length(c)), lambda i: c[i] IN ('.', '!', '?', ';') AND regexp_full_match(c[i + 1], '\s'))) AS e, list_max(list_filter(range(101, length(c) + 1), lambda i: regexp_full_match(c[i], '\s'))) AS w FROM c) SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(CASE WHEN e IS NOT NULL THEN substr(c, 1, e) WHEN w IS NOT NULL THEN substr(c, 1, w - 1) ELSE c END) || '…' END AS excerpt FROM b")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", P.excerpt(F.col("text"), 200).alias("excerpt"))


@query("inputs_in_brief", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'command=' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END || ' n=' || turn WHEN 1 THEN CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END ELSE '' END AS brief FROM conversations")
def _(s, sf):
    whole = F.to_json(F.struct(F.col("text").alias("command"), F.col("turn").alias("n"), F.struct("role").alias("o"), F.array("turn").alias("l")))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("s"))), r'(?s)^\{"s":(.*)\}$', "$1")
    json = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, quoted).otherwise(F.to_json(F.array("turn")))
    return table(s, sf, "conversations").select("conv_id", "turn", P.brief(json).alias("brief"))


@query("times_read", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN ms WHEN 1 THEN ms - 7200000 WHEN 2 THEN ms + 19800000 WHEN 3 THEN ms END AS ms FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)")
def _(s, sf):
    zone = lambda shape, tail: F.concat(F.date_format("ts", shape), F.lit(tail))
    shape, k = "yyyy-MM-dd'T'HH:mm:ss.SSS", F.col("event_id") % 5
    said = F.when(k == 0, zone(shape, "Z")).when(k == 1, zone(shape, "+02:00")).when(k == 2, zone(shape, "-05:30")).when(k == 3, zone("yyyy-MM-dd HH:mm:ss.SSSSSS", "")).otherwise(zone("yyyy-MM-dd", ""))
    return table(s, sf, "events").select("event_id", X.parse_ts(said).alias("ms"))


@query("settings_diff", "WITH r AS (SELECT conv_id, turn, length(text) AS n, role FROM conversations), k AS (SELECT DISTINCT * FROM r) SELECT 'c' || conv_id || '.t' || turn || '.size' AS path, n::VARCHAR AS a, CASE WHEN turn % 4 <> 0 THEN (n + 1)::VARCHAR END AS b, false AS sensitive FROM k WHERE turn % 3 = 0 OR turn % 4 = 0 UNION ALL SELECT 'c' || conv_id || '.t' || turn || '.role', role, NULL, false FROM k WHERE turn % 4 = 0 UNION ALL SELECT 'c' || conv_id || '.t' || turn || '.api_key', '[redacted]', CASE WHEN turn % 4 <> 0 THEN '[redacted]' END, true FROM k WHERE turn % 5 = 0 OR turn % 4 = 0")
def _(s, sf):
    c = table(s, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"), "role").distinct()

    def settings(size: Column, key: Column) -> Column:
        leaf = F.to_json(F.struct(size.alias("size"), "role", key.alias("api_key")))
        return F.concat(F.lit('{"c'), "conv_id", F.lit('": {"t'), "turn", F.lit('": '), leaf, F.lit("}}"))

    a = c.select(settings(F.col("n"), F.lit("k1")).alias("j"))
    b = c.where("turn % 4 <> 0").select(settings(F.when(F.col("turn") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")), F.when(F.col("turn") % 5 == 0, "k2").otherwise("k1")).alias("j"))
    return lifecycle.settings_diff(a, b, "j")


# ---- times that questions name

_SAID = f"""WITH q AS (SELECT doc_id, doc_id % 12 AS k, ((doc_id % 3) - 1) * 300 AS off, DATE '2023-06-01' + (doc_id % 400)::INTEGER AS dt FROM documents),
b AS (SELECT *, ({NOW} + off * 60000) // {DAY} AS today, dt - DATE '1970-01-01' AS dd FROM q),
t AS (SELECT *, DATE '1970-01-01' + today::INTEGER AS td, today - (today + 3) % 7 AS monday FROM b),
y AS (SELECT *, date_trunc('month', td)::DATE - DATE '1970-01-01' AS first, (date_trunc('month', td) - INTERVAL 1 MONTH)::DATE - DATE '1970-01-01' AS before, make_date(year(td), month(dt), 1) - DATE '1970-01-01' + day(dt) - 1 AS this, make_date(year(td) - 1, month(dt), 1) - DATE '1970-01-01' + day(dt) - 1 AS last FROM t),
d AS (SELECT *, CASE WHEN this * {DAY} - off * 60000 > {NOW} THEN last ELSE this END AS own FROM y),
w AS (SELECT doc_id, k, off, CASE k WHEN 0 THEN today WHEN 1 THEN today - 1 WHEN 2 THEN dd WHEN 3 THEN dd WHEN 4 THEN dd WHEN 5 THEN monday - 7 WHEN 6 THEN monday WHEN 7 THEN before WHEN 10 THEN own END * {DAY} - off * 60000 AS s,
  CASE k WHEN 0 THEN today + 1 WHEN 1 THEN today WHEN 3 THEN dd + 1 WHEN 4 THEN dd + 1 WHEN 5 THEN monday WHEN 6 THEN monday + 7 WHEN 7 THEN first WHEN 10 THEN own + 1 END * {DAY} - off * 60000 AS e FROM d)"""


def _questions(s, sf):
    """Documents' ids with a question in one of twelve forms, after some of the text's letters, and an offset from UTC."""
    d = table(s, sf, "documents").select("doc_id", F.concat(F.substring(F.regexp_replace("text", "[^a-z ]", ""), 1, 20), F.lit(" ")).alias("x"), ((F.col("doc_id") % 3 - 1) * 300).alias("off"), F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("dt"))
    month, day, iso = F.date_format("dt", "MMMM"), F.date_format("dt", "d"), F.date_format("dt", "yyyy-MM-dd")
    forms = [["what did I do today"], ["Yesterday, please"], ["all since ", iso], ["on ", iso, " then"], ["the ", day, " ", month, " ", F.date_format("dt", "yyyy")], ["last week?"], ["This week"], ["last month"], ["the past ", F.col("doc_id") % 300, " days"], ["last ", F.col("doc_id") % 50, " weeks"], [month, " ", day], ["nothing named ", F.col("doc_id") % 90]]
    said = [F.concat("x", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in f)) for f in forms]
    return d.select("doc_id", "off", F.element_at(F.array(*said), (F.col("doc_id") % 12 + 1).cast("int")).alias("question"))


_START = f"CASE WHEN k = 8 THEN {NOW} - doc_id % 300 * {DAY} WHEN k = 9 THEN {NOW} - doc_id % 50 * {7 * DAY} ELSE s END"
_END = f"CASE WHEN k IN (2, 8, 9) THEN {NOW} ELSE CASE WHEN e < {NOW} THEN e WHEN e IS NOT NULL THEN {NOW} END END"


@query("window_starts", f"{_SAID} SELECT doc_id, {_START} AS s FROM w")
def _(s, sf):
    return _questions(s, sf).select("doc_id", when.windows(F.col("question"), F.lit(NOW), F.col("off"))["start"].alias("s"))


@query("window_ends", f"{_SAID} SELECT doc_id, {_END} AS e FROM w")
def _(s, sf):
    return _questions(s, sf).select("doc_id", when.windows(F.col("question"), F.lit(NOW), F.col("off"))["end"].alias("e"))


@query("months", "SELECT event_id, CASE WHEN event_id % 5 >= 2 THEN month(ts) END AS month FROM events")
def _(s, sf):
    word = F.substring(F.date_format("ts", "MMMM"), F.lit(1), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, sf, "events").select("event_id", when.month_of(word).cast("long").alias("month"))


@query("reports_on_days", f"{_SAID} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN dd * {DAY} - off * 60000 WHEN 1 THEN (today - 1) * {DAY} - off * 60000 WHEN 5 THEN dd * {DAY} - off * 60000 END AS day FROM d")
def _(s, sf):
    q = _questions(s, sf).withColumn("dt", F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 400).cast("int")))
    date = F.concat(F.date_format("dt", "d"), F.lit(" "), F.date_format("dt", "MMMM yyyy"))
    forms = [F.concat(F.lit("Recap for "), date), F.lit("Update: yesterday was fine"), F.concat(F.lit("nothing but "), date), F.lit("progress of last week"), F.lit("yesterday"), F.concat(F.lit("Update for yesterday, "), date)]
    text = F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int"))
    return q.select("doc_id", A.days_reported(text, F.lit(NOW), F.col("off")).alias("day"))
