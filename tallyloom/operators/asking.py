"""What an answer is made from: scope of a question, its sources, session context, digests of turns, the reply read back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import when
from . import ranking as R
from . import relational as O

DAY = 86_400_000


@dataclass(frozen=True)
class Scope:
    """project None: all; window None: any time; before: what was known then."""

    project: str | None = None
    window: when.Span | None = None
    before: int | None = None


def _time(given: str, what: str, offset_min: int) -> int:
    from datetime import datetime, timedelta, timezone

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}.*)?", given):
        raise ValueError(f"{what}: expected YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS, got {given}")
    at = datetime.fromisoformat(given if len(given) > 10 else given + "T00:00:00")
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone(timedelta(minutes=offset_min)))
    return int(at.timestamp() * 1000)


#: Last parts of paths that name no project.
COMMON = ("code", "tmp", "home", "src", "app", "apps")


def named_project(question: str, projects: list[str]) -> str | None:
    """The one known project whose last path part is a word of the question; a checkout, a common or a shared name gives none."""
    words = {w.strip(".") for w in re.split(r"[^\w.-]+", question.lower()) if len(w.strip(".")) >= 3}
    name = lambda p: p.split("#")[0].rstrip("/").rsplit("/", 1)[-1].lower()
    hits = [p for p in dict.fromkeys(projects) if "#" not in p and name(p) in words and name(p) not in COMMON]
    return hits[0] if len(hits) == 1 else None


def named_projects(questions: DataFrame, projects: DataFrame) -> DataFrame:
    """named_project for a column of questions (q, text) and known projects (project): (q, project)."""
    words = F.transform(F.split(F.lower("text"), r"[^\p{L}\p{N}_.-]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    w = questions.select("q", F.explode(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 3))).alias("name"))
    name = F.lower(F.element_at(F.split(F.regexp_replace("project", "/+$", ""), "/"), -1))
    p = projects.where(~F.col("project").contains("#")).select("project", name.alias("name")).distinct().where(~F.col("name").isin(*COMMON))
    return w.join(p, "name").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("project").alias("project")).where("n = 1").drop("n")


def resolve(question: str, now: int, projects: list[str], here: str | None = None, project: str | None = None, everywhere: bool = False, since: str | None = None, until: str | None = None, as_of: str | None = None, offset_min: int = 0) -> Scope:
    """Flags come first, then a project that the question names; a question about a time looks at all projects, others at the one
    here.  A bare date as `until` includes its day; as_of hides what came later."""
    before = None if as_of is None else _time(as_of, "as of", offset_min)
    now = now if before is None else before
    if since is None and until is None:
        window = when.window(question, now, offset_min)
    else:
        start = 0 if since is None else _time(since, "since", offset_min)
        end = now if until is None else _time(until, "until", offset_min) + (DAY if len(until) == 10 else 0)
        if start >= end:
            raise ValueError("since must be before until")
        window = when.Span(start, end, f"{since or 'the beginning'} to {until or 'now'}")
    where = None if everywhere else project or named_project(question, projects) or (None if window else here)
    return Scope(where, window, before)


def in_scope(rows: DataFrame, scope: Scope, at: str) -> DataFrame:
    if scope.project is not None:
        rows = O.in_project(rows, scope.project)
    if scope.window is not None:
        rows = rows.where((F.col(at) >= scope.window.start) & (F.col(at) < scope.window.end))
    return rows if scope.before is None else rows.where(F.col(at) < scope.before)


def window_prompts(events: DataFrame, scope: Scope, scripted: DataFrame | None = None, most: int = 12, least: int = 12) -> DataFrame:
    """(id, ts, title, text): the newest prompts of the scope with something in them, oldest first; rank from 1."""
    rows = in_scope(events, scope, "ts").where((F.col("kind") == "prompt") & (F.length("text") >= least))
    for c in ("label", "thread"):
        if c in rows.columns:
            rows = rows.where(F.col(c).isNull())
    if "record_key" in rows.columns:
        rows = rows.where(~F.col("record_key").startswith("cm:"))
    if scripted is not None:
        rows = rows.join(scripted.select("session_id").distinct(), "session_id", "left_anti")
    new = rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(most)
    t = F.trim("text")
    return new.select("id", "ts", X.head(t, 100).alias("title"), X.head(t, 400).alias("text"), F.row_number().over(W.orderBy("ts", "id")).alias("rank"))  # `most` rows


def happened(memories: DataFrame, events: DataFrame) -> DataFrame:
    """memories with happened_at: the time of the event that ends the range its origin names (session@from-through#n), else created_at."""
    end = F.regexp_extract("origin_id", r"@\d+-(\d+)(?:#\d+)?$", 1)
    m = memories.withColumn("_end", F.when(end != "", end).cast("long"))
    return m.join(events.select(F.col("id").alias("_end"), F.col("ts").alias("_ts")), "_end", "left").withColumn("happened_at", F.coalesce("_ts", "created_at")).drop("_end", "_ts")


def memory_sources(memories: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(id, text, asked, go_ahead): title, subtitle, narrative and facts; the first two human prompts among the evidence; whether
    one of them only gave a go-ahead."""
    parts = F.concat_ws(" — ", "title", F.when(F.coalesce("subtitle", F.lit("")) != "", F.col("subtitle")))
    facts = F.when(F.size("facts") > 0, F.concat(F.lit(" Facts: "), F.array_join("facts", "; "))).otherwise("")
    said = evidence.join(events.where("kind = 'prompt'").select(F.col("id").alias("event_id"), "text"), "event_id")
    first = O.top_per_key(said, ["id"], 2, "event_id", name="n").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"]).alias("asked"))
    rows = memories.join(first, "id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<string>")))
    return rows.select("id", F.concat(parts, F.lit(" — "), F.coalesce("narrative", F.lit("")), facts).alias("text"), F.transform("asked", lambda x: X.head(x, 400)).alias("asked"), F.exists("asked", O.go_ahead).alias("go_ahead"))


def pinned_sources(memories: DataFrame, terms: DataFrame, scope: Scope, most: int = 3) -> DataFrame:
    """(q, id, rank): pinned facts of the project and of all projects that share two topic words with a question (q, term)."""
    m = memories.where("kind = 'pinned'")
    if scope.project is not None:
        m = m.where((F.col("project") == "*") | (F.col("project") == scope.project) | F.col("project").startswith(scope.project + "#"))
    if scope.before is not None:
        m = m.where(F.col("created_at") < scope.before)
    few = R.ranked(terms.withColumn("n", F.octet_length("term")), "n", "term", k=8).select("q", "term")
    return R.top_scores(m, "id", "text", few, most, least=2, pairs=True).select("q", F.col("doc").alias("id"), "rank")


def sources(*sections: DataFrame) -> DataFrame:
    """(q, kind, id, place): sections (q, kind, id, rank) one after the other; what came before doesn't come again."""
    every = None
    for i, part in enumerate(sections):
        one = part.select("q", "kind", "id", F.lit(i).alias("section"), "rank")
        every = one if every is None else every.unionByName(one)
    kept = O.first_per_key(every, ["q", "kind", "id"], "section", "rank")
    return kept.select("q", "kind", "id", F.row_number().over(W.partitionBy("q").orderBy("section", "rank", "kind", "id")).alias("place"))


#: Words that introduce an account of work done.
REPORT_WORDS = ("update", "recap", "summary", "report", "standup", "stand-up", "done", "shipped", "progress")


def reports_on(text: str, at: int, offset_min: int = 0) -> int | None:
    """Start of the day that a message written at `at` reports on: a named date, else yesterday, after a word of report near its beginning."""
    low = text[:240].lower()
    found = [i for w in REPORT_WORDS if (i := low.find(w)) >= 0]
    if not found:
        return None
    tail = low[min(found) :]
    named = when.window(tail.replace("yesterday", ""), at, offset_min)
    if named and re.search(r"\d", named.label) and not named.label.startswith(("last", "past")):
        return named.start
    day = when.window(tail, at, offset_min)
    return day.start if day and day.label == "yesterday" else None


def days_reported(text: Column, at: Column, offset_min: Column | None = None) -> Column:
    """`reports_on` as a column."""
    low = F.lower(F.substring(text, 1, 240))
    places = F.filter(F.array(*(F.instr(low, w) for w in REPORT_WORDS)), lambda i: i > 0)
    dated = lambda w: F.when(w["label"].rlike("[0-9]") & ~w["label"].startswith("last") & ~w["label"].startswith("past"), w["start"])
    yesterday = lambda w: F.when(w["label"] == "yesterday", w["start"])

    def read(tail: Column) -> Column:
        named = when.windows(F.replace(tail, F.lit("yesterday"), F.lit("")), at, offset_min)
        return F.coalesce(when.bound(named, dated), when.bound(when.windows(tail, at, offset_min), yesterday))

    return F.when(F.size(places) > 0, when.bound(F.substring(low, F.array_min(places), F.lit(240)), read))


def overlaps(day: Column, start: int, end: int) -> Column:
    return (day + DAY > start) & (day < end)


def read_answers(replies: DataFrame) -> DataFrame:
    """(q, text, cited) of replies (q, reply: JSON with answer and cited; shown: array of references like #12 and E7).

    Only references that were shown are kept, listed ones first, then those in the text; marks of others leave the text."""
    ref = lambda s: F.when(F.upper(F.trim(F.regexp_replace(s, r"[\[\]]", ""))).startswith("E"), F.concat(F.lit("E"), F.regexp_extract(s, r"(\d+)", 1))).otherwise(F.concat(F.lit("#"), F.regexp_extract(s, r"(\d+)", 1)))
    r = replies.withColumn("j", F.from_json("reply", "answer string, cited array<string>")).withColumn("raw", F.trim(F.coalesce("j.answer", F.lit(""))))
    marks = F.regexp_extract_all("raw", F.lit(r"\s?\[(?:#\d+|E\s?\d+)\]"), 0)
    r = r.withColumn("marks", marks)
    drop = F.filter("marks", lambda m: ~F.array_contains("shown", ref(m)))
    text = F.aggregate(drop, F.col("raw"), lambda t, m: F.replace(t, m, F.lit("")))
    listed = F.transform(F.filter(F.coalesce("j.cited", F.array().cast("array<string>")), lambda s: s.rlike(r"\d")), ref)
    cited = F.array_distinct(F.filter(F.concat(listed, F.transform("marks", ref)), lambda c: F.array_contains("shown", c)))
    return r.select("q", text.alias("text"), cited.alias("cited"))


def turn_digest(events: DataFrame) -> DataFrame:
    """One row for each (session, turn) of the main thread: first prompt, last answer (a recap or compaction only where there is
    none), edited paths in order, first 8 commands, first 4 errors."""
    e = events.where(F.col("thread").isNull()) if "thread" in events.columns else events
    none = F.lit(None).cast("string")
    label = F.coalesce("label", F.lit("")) if "label" in e.columns else F.lit("")
    path = F.col("path") if "path" in e.columns else none
    of = lambda *k: F.col("kind").isin(*k)
    only = lambda value, *k: F.when(of(*k), value)
    listed = lambda value, *k: F.array_sort(F.collect_list(F.when(of(*k), F.struct("id", value.alias("v")))))
    stand_in = F.struct(F.lit(0).alias("p"), F.when(of("compaction", "recap"), -F.col("id")).otherwise(F.col("id")).alias("i"))
    answer = F.max_by(only(F.col("text"), "assistant", "compaction", "recap"), F.when(of("assistant"), F.struct(F.lit(1).alias("p"), F.col("id").alias("i"))).when(of("compaction", "recap"), stand_in))
    paths = distinct_values(listed(path, "file_edit"))
    g = e.groupBy("session_id", "turn").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("ts").alias("ts"),
        F.min_by(only(X.head(F.col("text"), 600), "prompt"), only(F.col("id"), "prompt")).alias("prompt"), answer.alias("answer"), paths.alias("edited"),
        F.slice(F.transform(listed(X.head(X.squash(F.col("text")), 140), "command"), lambda x: x["v"]), 1, 8).alias("commands"),
        F.slice(F.transform(listed(F.concat(label, F.lit(": "), X.head(X.first_line(F.col("text")), 160)), "error"), lambda x: x["v"]), 1, 4).alias("errors"),
    )
    return g


def distinct_values(found: Column) -> Column:
    """Distinct values of (id, v) structs in the order of their first ids."""
    return F.array_distinct(F.transform(found, lambda x: x["v"]))


def session_views(sessions: DataFrame, events: DataFrame, project: str, current: str | None, n: int, scripted: DataFrame | None = None) -> DataFrame:
    """(session_id, rank, title, last_event_at, last_error, edited): the sessions that open a new one's context.

    Of the newest 6 n with a prompt: those a person talked to first, others fill up; equal openings (40 characters) once."""
    s = sessions.where(F.col("project") == project)
    if current is not None:
        s = s.where(F.col("session_id") != current)
    if scripted is not None:
        s = s.join(scripted.select("session_id").distinct(), "session_id", "left_anti")
    e = events.where("thread IS NULL") if "thread" in events.columns else events
    own = F.lit(True) if "label" not in e.columns else F.col("label").isNull()
    p = e.where("kind = 'prompt'").groupBy("session_id").agg(F.count_if(own).alias("human"), F.min_by("text", "id").alias("first"))
    c = s.join(p, "session_id").orderBy(F.col("last_event_at").desc(), "session_id").limit(6 * n)
    c = c.withColumn("opening", F.lower(F.substring("first", 1, 40)))
    c = O.first_per_key(c, ["opening"], (F.col("human") == 0), F.col("last_event_at").desc(), "session_id")
    c = c.orderBy((F.col("human") == 0), F.col("last_event_at").desc(), "session_id").limit(n)
    ends = e.groupBy("session_id").agg(F.max_by(F.struct("kind", F.concat_ws(": ", *(["label"] if "label" in e.columns else []), X.first_line(F.col("text"))).alias("t")), "id").alias("z"))
    edits = events.where("kind = 'file_edit'").groupBy("session_id", "path").agg(F.max("id").alias("id")) if "path" in events.columns else None
    out = c.join(ends, "session_id", "left").withColumn("last_error", F.when(F.col("z.kind") == "error", F.col("z.t")))
    if edits is not None:
        top = O.top_per_key(edits, ["session_id"], 8, F.col("id").desc(), name="n").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("edited"))
        out = out.join(top, "session_id", "left")
    keep = ["title", "last_event_at", "last_error"] + (["edited"] if edits is not None else [])
    return out.select("session_id", *keep, F.row_number().over(W.orderBy(F.col("last_event_at").desc(), "session_id")).alias("rank"))  # n rows


def session_turns(events: DataFrame, views: DataFrame, turns: int) -> DataFrame:
    """(session_id, turn, prompt, answer) of the shown sessions: their latest prompts, a person's first, in order of turns."""
    e = events.where("thread IS NULL") if "thread" in events.columns else events
    e = e.join(views.select("session_id"), "session_id", "left_semi")
    human = F.lit(True) if "label" not in e.columns else F.col("label").isNull()
    p = O.top_per_key(e.where("kind = 'prompt'"), ["session_id"], turns, human.desc(), F.col("id").desc(), name="n").select("session_id", "turn", F.col("text").alias("prompt"))
    a = e.where("kind = 'assistant'").groupBy("session_id", "turn").agg(F.max_by("text", "id").alias("answer"))
    return p.join(a, ["session_id", "turn"], "left")


def open_memories(memories: DataFrame, project: str, n: int, scripted: DataFrame | None = None) -> DataFrame:
    """(kind, id, rank): the project's latest observations, not sensitive, its latest summary, and its pins before global ones."""
    m = memories if scripted is None else memories.join(scripted.select("session_id").distinct(), "session_id", "left_anti")
    newest = lambda rows, kind, k: rows.orderBy(F.col("created_at").desc(), "id").limit(k).select(F.lit(kind).alias("kind"), "id", F.row_number().over(W.orderBy(F.col("created_at").desc(), "id")).alias("rank"))
    own = m.where(F.col("project") == project)
    pins = m.where((F.col("kind") == "pinned") & F.col("project").isin(project, "*")).orderBy(F.col("project") == "*", F.col("created_at").desc(), "id").limit(20)
    pins = pins.select(F.lit("pinned").alias("kind"), "id", F.row_number().over(W.orderBy(F.col("project") == "*", F.col("created_at").desc(), "id")).alias("rank"))
    return newest(O.without_sensitive(own.where("kind = 'observation'")), "observation", n).unionByName(newest(own.where("kind = 'summary'"), "summary", 1)).unionByName(pins)


def session_delta(events: DataFrame, sessions: DataFrame, seen: DataFrame, me: str, project: str, now: int, floor: int, span: int = 21_600_000, most: int = 3, budget: int = 1600) -> DataFrame:
    """(session_id, rank, asked, answered, error, edited, used): what other sessions of the project did since this one last looked.

    seen: (session_id, through): the last event shown of each; floor: the last event there was when this session began.
    Productive sessions first, then the latest; the first is always shown, others while the budget of bytes lasts."""
    e = events.join(sessions.where((F.col("project") == project) & (F.col("session_id") != me)).select("session_id"), "session_id")
    e = e.join(seen.select("session_id", "through"), "session_id", "left").where((F.col("id") > F.greatest(F.lit(floor), F.coalesce("through", F.lit(0)))) & (F.col("ts") > now - span))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("id")))
    path = F.col("path") if "path" in e.columns else F.lit(None).cast("string")
    files = distinct_values(F.array_sort(F.collect_list(F.when(F.col("kind") == "file_edit", F.struct("id", path.alias("v"))))))
    g = e.groupBy("session_id").agg(last("prompt").alias("asked"), last("assistant").alias("answered"), last("error").alias("error"), files.alias("edited"), F.max("ts").alias("latest"), F.max("id").alias("through"))
    order = [(F.col("answered").isNull() & (F.size("edited") == 0)), F.col("latest").desc(), F.col("session_id")]
    top = g.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # `most` rows
    size = F.octet_length(F.concat_ws(" ", "asked", "answered", "error", F.array_join("edited", " ")))
    run = top.withColumn("used", F.sum(size).over(W.orderBy("rank")))
    return run.where((F.col("rank") == 1) | (F.col("used") <= budget)).drop("latest")
