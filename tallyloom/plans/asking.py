"""Queries that gather what an answer, a session's start or a digest is made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import when
from ..operators import asking as A
from ..operators import ranking as R
from ..operators import relational as O
from ..operators import sessions as S
from .recalling import _TERMS, few
from .search import TOK
from .views import T0, sql, table, view

QUERIES: dict = {}


def query(name: str, sql_text: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(sql_text, *names) if sql_text else None)
        return fn

    return keep


# events with kinds, paths, labels and threads that the conversations don't have
_EV2 = """e2 AS (SELECT id, session_id, turn // 3 AS turn, ts, project, CASE id % 7 WHEN 0 THEN 'prompt' WHEN 1 THEN 'assistant' WHEN 2 THEN 'file_edit' WHEN 3 THEN 'command' WHEN 4 THEN 'error' WHEN 5 THEN 'recap' ELSE kind END AS kind,
  CASE WHEN id % 7 = 2 THEN 'src/' || (id % 3) || '.py' END AS path, CASE WHEN id % 7 = 4 THEN 'timeout' WHEN id % 21 = 0 THEN 'harness' END AS label, CASE WHEN id % 13 = 5 THEN 'side' END AS thread, text FROM ev)"""


def ev2(s, sf):
    m = F.col("id") % 7
    kind = F.when(m == 0, "prompt").when(m == 1, "assistant").when(m == 2, "file_edit").when(m == 3, "command").when(m == 4, "error").when(m == 5, "recap").otherwise(F.col("kind"))
    e = view(s, sf, "ev")
    return e.select("id", "session_id", F.floor(F.col("turn") / 3).alias("turn"), "ts", "project", kind.alias("kind"), F.when(m == 2, F.concat(F.lit("src/"), F.col("id") % 3, F.lit(".py"))).alias("path"), F.when(m == 4, "timeout").when(F.col("id") % 21 == 0, "harness").alias("label"), F.when(F.col("id") % 13 == 5, "side").alias("thread"), "text")


_HEAD = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || '…' ELSE {0} END"
_SQ = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"


@query(
    "turn_digests",
    f"""WITH {_EV2}, m AS (SELECT * FROM e2 WHERE thread IS NULL), f AS (SELECT session_id, turn, path, min(id) AS id FROM m WHERE kind = 'file_edit' GROUP BY ALL)
SELECT session_id, turn, min(id) AS first_id, max(id) AS last_id, max(ts) AS ts, {_HEAD.format("arg_min(text, id) FILTER (WHERE kind = 'prompt')", 600)} AS prompt,
  coalesce(arg_max(text, id) FILTER (WHERE kind = 'assistant'), arg_min(text, id) FILTER (WHERE kind IN ('compaction', 'recap'))) AS answer,
  coalesce((SELECT string_agg(path, ',' ORDER BY id) FROM f WHERE f.session_id = m.session_id AND f.turn = m.turn), '') AS edited,
  coalesce(array_to_string((list({_HEAD.format(_SQ, 140)} ORDER BY id) FILTER (WHERE kind = 'command'))[1:8], chr(1)), '') AS commands,
  coalesce(array_to_string((list(label || ': ' || {_HEAD.format("regexp_extract(text, '^\\s*([^\\n]*)', 1)", 160)} ORDER BY id) FILTER (WHERE kind = 'error'))[1:4], chr(1)), '') AS errors
FROM m GROUP BY session_id, turn""",
    "ev",
)
def _(s, sf):
    g = A.turn_digest(ev2(s, sf))
    return g.withColumn("edited", F.array_join("edited", ",")).withColumn("commands", F.array_join("commands", "\x01")).withColumn("errors", F.array_join("errors", "\x01"))


_NOW = T0 + 500_000 * 60_000


@query(
    "session_delta",
    f"""WITH {_EV2}, se AS (SELECT session_id, max(id) AS through FROM e2 WHERE id % 5 = 0 GROUP BY session_id),
x AS (SELECT e2.* FROM e2 LEFT JOIN se USING (session_id) WHERE project = 'p3' AND session_id <> 'conv:3' AND id > greatest(2, coalesce(through, 0)) AND ts > {T0}),
g AS (SELECT session_id, arg_max(text, id) FILTER (WHERE kind = 'prompt') AS asked, arg_max(text, id) FILTER (WHERE kind = 'assistant') AS answered, arg_max(text, id) FILTER (WHERE kind = 'error') AS error, max(ts) AS latest, max(id) AS through, count_if(kind = 'file_edit') AS edits FROM x GROUP BY session_id),
f AS (SELECT session_id, string_agg(path, ' ' ORDER BY i) AS edited FROM (SELECT session_id, path, min(id) AS i FROM x WHERE kind = 'file_edit' GROUP BY ALL) GROUP BY session_id),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN answered IS NULL AND edits = 0 THEN 1 ELSE 0 END, latest DESC, session_id) AS rank FROM g LEFT JOIN f USING (session_id)),
u AS (SELECT *, sum(octet_length(encode(concat_ws(' ', asked, answered, error, coalesce(edited, ''))))) OVER (ORDER BY rank) AS used FROM r WHERE rank <= 3)
SELECT session_id, rank, asked, answered, error, coalesce(edited, '') AS edited, through, used::BIGINT AS used FROM u WHERE rank = 1 OR used <= 1600""",
    "ev",
)
def _(s, sf):
    e = ev2(s, sf)
    seen = e.where("id % 5 = 0").groupBy("session_id").agg(F.max("id").alias("through"))
    d = A.session_delta(e.drop("project"), e.select("session_id", "project").distinct(), seen, "conv:3", "p3", T0 + 21_600_000, 2)
    return d.withColumn("edited", F.array_join("edited", " "))


@query("window_prompts", f"WITH {_EV2}, n AS (SELECT id, ts, trim(text) AS t FROM e2 WHERE kind = 'prompt' AND label IS NULL AND thread IS NULL AND length(text) >= 12 AND (project = 'p1' OR starts_with(project, 'p1#')) AND ts >= {T0} AND ts < {_NOW} AND session_id NOT IN (SELECT session_id FROM e2 WHERE id % 41 = 0) ORDER BY ts DESC, id DESC LIMIT 12) SELECT id, ts, {_HEAD.format('t', 100)} AS title, {_HEAD.format('t', 400)} AS text, row_number() OVER (ORDER BY ts, id) AS rank FROM n", "ev")
def _(s, sf):
    e = ev2(s, sf)
    return A.window_prompts(e, A.Scope("p1", when.Span(T0, _NOW, "")), e.where("id % 41 = 0"))


@query(
    "said_matching",
    rf"""WITH {_TERMS}, fw AS (SELECT item_id AS q, t FROM r WHERE n <= 2), sx AS (SELECT id, {TOK.format('text')} AS t FROM ev WHERE kind IN ('prompt', 'assistant') AND length(text) BETWEEN 40 AND 2000 AND ts >= {T0 + 3_600_000} AND session_id NOT IN (SELECT session_id FROM ev WHERE kind = 'compaction')),
sn AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM sx), x AS (SELECT id, t, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS t FROM sx) GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM x GROUP BY t),
sc AS (SELECT q, id, round(sum(CASE WHEN ln((sn.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((sn.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / sn.mean))), 6) AS score FROM fw JOIN x USING (t) JOIN d USING (t), sn GROUP BY q, id)
SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 6""",
    "ev",
)
def _(s, sf):
    e = view(s, sf, "ev")
    rows = e.where(F.col("kind").isin("prompt", "assistant") & F.length("text").between(40, 2000) & (F.col("ts") >= T0 + 3_600_000)).join(e.where("kind = 'compaction'").select("session_id").distinct(), "session_id", "left_anti")
    return R.top_scores(rows, "id", "text", few(s, sf), 6).select("q", F.col("doc").alias("id"), "rank")


@query("named_project", r"WITH pr AS (SELECT unnest(['/w/garden', 'team/alpha', '/x/alpha', '/home/code', 'b/of', 'b/the#2', 'z/the']) AS project), n AS (SELECT project, lower(regexp_extract(project, '([^/]+)/*$', 1)) AS name FROM pr WHERE NOT contains(project, '#')), qw AS (SELECT DISTINCT item_id AS q, unnest(list_transform(string_split_regex(lower(text), '[^\p{L}\p{N}_.-]+'), lambda x: trim(x, '.'))) AS name FROM benchmark) SELECT q, min(project) AS project FROM qw JOIN n USING (name) WHERE octet_length(encode(name)) >= 3 AND name NOT IN ('code', 'tmp', 'home', 'src', 'app', 'apps') GROUP BY q HAVING count(*) = 1")
def _(s, sf):
    p = s.createDataFrame([(x,) for x in ("/w/garden", "team/alpha", "/x/alpha", "/home/code", "b/of", "b/the#2", "z/the")], "project string")
    return A.named_projects(table(s, sf, "benchmark").select(F.col("item_id").alias("q"), "text"), p)


_M2 = "m2 AS (SELECT id, project, CASE id % 10 WHEN 0 THEN 'pinned' WHEN 1 THEN 'summary' ELSE 'observation' END AS kind, CASE WHEN id % 20 = 0 THEN '*' ELSE project END AS place, type, title, narrative, text, created_at, session_id, 'conv:1@1-' || (id % 300 * 100) || '#' || (id % 4) AS origin_id FROM mem)"


def m2(s, sf):
    m, k = view(s, sf, "mem"), F.col("id") % 10
    kind = F.when(k == 0, "pinned").when(k == 1, "summary").otherwise("observation")
    return m.withColumn("kind", kind).withColumn("project", F.when(F.col("id") % 20 == 0, "*").otherwise(F.col("project"))).withColumn("origin_id", F.concat(F.lit("conv:1@1-"), F.col("id") % 300 * 100, F.lit("#"), F.col("id") % 4))


@query("happened_at", f"WITH {_M2} SELECT m2.id, coalesce(ev.ts, created_at) AS happened_at FROM m2 LEFT JOIN ev ON ev.id = regexp_extract(origin_id, '-([0-9]+)#', 1)::BIGINT", "mem", "ev")
def _(s, sf):
    return A.happened(m2(s, sf), view(s, sf, "ev")).select("id", "happened_at")


_SAYS = "CASE WHEN turn % 4 = 0 THEN 'ok do it' ELSE concat('why? ', text) END"


@query("memory_sources", f"WITH v AS (SELECT m.id, e.id AS event_id, {_SAYS.replace('text', 'e.text')} AS said, row_number() OVER (PARTITION BY m.id ORDER BY e.id) AS n FROM mem m JOIN ev e ON e.session_id = m.session_id AND e.kind = 'prompt'), a AS (SELECT id, string_agg({_HEAD.format('said', 400)}, chr(1) ORDER BY n) AS asked, max(CASE WHEN said = 'ok do it' THEN 1 ELSE 0 END) = 1 AS go_ahead FROM v WHERE n <= 2 GROUP BY id) SELECT m.id, title || ' — ' || type || ' — ' || narrative || ' Facts: f; g' AS text, coalesce(asked, '') AS asked, coalesce(go_ahead, false) AS go_ahead FROM mem m LEFT JOIN a USING (id)", "mem", "ev")
def _(s, sf):
    e = view(s, sf, "ev").withColumn("text", F.expr(_SAYS))
    m = view(s, sf, "mem").withColumn("subtitle", F.col("type")).withColumn("facts", F.array(F.lit("f"), F.lit("g")))
    out = A.memory_sources(m, m.select("id", "session_id").join(e.select("session_id", F.col("id").alias("event_id")), "session_id").select("id", "event_id"), e)
    return out.withColumn("asked", F.array_join("asked", "\x01"))


@query("opening_memories", f"WITH {_M2}, o AS (SELECT 'observation' AS kind, id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m2 WHERE place = 'src1' AND kind = 'observation' AND type <> 'sensitive'), u AS (SELECT 'summary' AS kind, id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m2 WHERE place = 'src1' AND kind = 'summary'), p AS (SELECT 'pinned' AS kind, id, row_number() OVER (ORDER BY CASE WHEN place = '*' THEN 1 ELSE 0 END, created_at DESC, id) AS rank FROM m2 WHERE kind = 'pinned' AND place IN ('src1', '*')) SELECT * FROM o WHERE rank <= 25 UNION ALL SELECT * FROM u WHERE rank = 1 UNION ALL SELECT * FROM p WHERE rank <= 20", "mem")
def _(s, sf):
    return A.open_memories(m2(s, sf), "src1", 25)


@query(
    "context_sessions",
    f"""WITH {_EV2}, s AS (SELECT session_id, any_value(project) AS project, min(text) AS title, max(ts) AS last_event_at FROM ev GROUP BY session_id), m AS (SELECT * FROM e2 WHERE thread IS NULL),
p AS (SELECT session_id, count_if(label IS NULL) AS human, arg_min(text, id) AS first FROM m WHERE kind = 'prompt' GROUP BY session_id),
c AS (SELECT * FROM s JOIN p USING (session_id) WHERE project = 'p2' AND session_id <> 'conv:2' ORDER BY last_event_at DESC, session_id LIMIT 24),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(substr(first, 1, 40)) ORDER BY CASE WHEN human = 0 THEN 1 ELSE 0 END, last_event_at DESC, session_id) AS n FROM c),
k AS (SELECT * FROM d WHERE n = 1 ORDER BY CASE WHEN human = 0 THEN 1 ELSE 0 END, last_event_at DESC, session_id LIMIT 4),
z AS (SELECT session_id, arg_max(kind, id) AS kind, arg_max(concat_ws(': ', label, regexp_extract(text, '^\\s*([^\\n]*)', 1)), id) AS t FROM m GROUP BY session_id),
f AS (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY max(id) DESC) AS n FROM e2 WHERE kind = 'file_edit' GROUP BY session_id, path),
l AS (SELECT session_id, string_agg(path, ' ' ORDER BY n) AS edited FROM f WHERE n <= 8 GROUP BY session_id)
SELECT session_id, title, last_event_at, CASE WHEN z.kind = 'error' THEN z.t END AS last_error, edited, row_number() OVER (ORDER BY last_event_at DESC, session_id) AS rank FROM k LEFT JOIN z USING (session_id) LEFT JOIN l USING (session_id)""",
    "ev",
)
def _(s, sf):
    e = view(s, sf, "ev")
    sessions = e.groupBy("session_id").agg(F.first("project").alias("project"), F.min("text").alias("title"), F.max("ts").alias("last_event_at"))
    return A.session_views(sessions, ev2(s, sf), "p2", "conv:2", 4).withColumn("edited", F.array_join("edited", " "))


@query("context_turns", f"WITH {_EV2}, m AS (SELECT * FROM e2 WHERE thread IS NULL), p AS (SELECT session_id, turn, text AS prompt, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN label IS NULL THEN 0 ELSE 1 END, id DESC) AS n FROM m WHERE kind = 'prompt'), a AS (SELECT session_id, turn, arg_max(text, id) AS answer FROM m WHERE kind = 'assistant' GROUP BY ALL) SELECT session_id, turn, prompt, answer FROM p LEFT JOIN a USING (session_id, turn) WHERE n <= 3 AND session_id IN ('conv:1', 'conv:2', 'conv:3')", "ev")
def _(s, sf):
    return A.session_turns(ev2(s, sf), s.createDataFrame([("conv:1",), ("conv:2",), ("conv:3",)], "session_id string"), 3)


@query("recent_files", f"WITH {_EV2}, g AS (SELECT session_id, path, max(id) AS latest FROM e2 WHERE kind = 'file_edit' GROUP BY ALL) SELECT session_id, path, latest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY latest DESC, path) AS r FROM g) WHERE r <= 2", "ev")
def _(s, sf):
    g = ev2(s, sf).where("kind = 'file_edit'").groupBy("session_id", "path").agg(F.max("id").alias("latest"))
    return O.top_per_key(g, ["session_id"], 2, F.col("latest").desc(), "path").select("session_id", "path", "latest")


@query("answers_read", "SELECT id AS q, 'see [#' || id || '] but not and [E 7]' AS text, '#' || id || ' E7' AS cited FROM ev", "ev")
def _(s, sf):
    e = view(s, sf, "ev").select("id")
    answer = F.concat(F.lit("see [#"), "id", F.lit("] but not [#999999999] and [E 7]"))
    r = e.select(F.col("id").alias("q"), F.to_json(F.struct(answer.alias("answer"), F.array(F.concat(F.lit("["), F.lit("#"), "id", F.lit("]")), F.lit("E12345678")).alias("cited"))).alias("reply"), F.array(F.concat(F.lit("#"), "id"), F.lit("E7")).alias("shown"))
    return A.read_answers(r).select("q", "text", F.array_join("cited", " ").alias("cited"))


_TIERS = "CASE WHEN (title ILIKE '%shipped%' OR title ILIKE '%released%' OR title ILIKE '%merged%' OR regexp_matches(title, 'v[0-9]\\.[0-9]')) AND NOT (title ILIKE '%not %' OR title ILIKE '%unreleased%') THEN 0 WHEN type IN ('feature', 'bugfix', 'decision') THEN 1 WHEN type IN ('change', 'refactor') THEN 3 ELSE 4 END"


@query(
    "window_memories",
    f"""WITH RECURSIVE i AS (SELECT id, project, created_at, {_TIERS} AS tier FROM mem WHERE created_at >= {T0 + 20 * 3_600_000} AND created_at < {T0 + 400 * 3_600_000}),
g AS (SELECT project, n, row_number() OVER (ORDER BY n, project) AS k, count(*) OVER () AS all_ FROM (SELECT project, count(*) AS n FROM i GROUP BY project)),
t AS (SELECT 0::BIGINT AS k, 120::BIGINT AS rest, NULL::VARCHAR AS project, 0::BIGINT AS take UNION ALL SELECT g.k, t.rest - least(g.n, t.rest // (g.all_ - g.k + 1)), g.project, least(g.n, t.rest // (g.all_ - g.k + 1)) FROM t JOIN g ON g.k = t.k + 1),
x AS (SELECT i.*, row_number() OVER (PARTITION BY i.project ORDER BY tier, created_at DESC, id) AS n FROM i), y AS (SELECT x.id, x.project, x.created_at, x.tier FROM x JOIN t ON t.project = x.project WHERE x.n <= t.take)
SELECT *, row_number() OVER (ORDER BY tier, created_at DESC, id) <= 24 AS "full" FROM y""",
    "mem",
)
def _(s, sf):
    m = view(s, sf, "mem").withColumn("tier", S.weight_tier(F.col("title"), F.col("type"), F.lit("observation")))
    return S.window_memories(m.select("id", "project", "created_at", "tier"), T0 + 20 * 3_600_000, T0 + 400 * 3_600_000)


@query("answer_sources", f"WITH {_EV2}, {_M2}, u AS (SELECT id % 5 AS q, 'pinned' AS kind, id, 0 AS section, row_number() OVER (PARTITION BY id % 5 ORDER BY id) AS rank FROM m2 WHERE kind = 'pinned' UNION ALL SELECT id % 5, 'pinned', id, 1, row_number() OVER (PARTITION BY id % 5 ORDER BY id DESC) FROM m2 WHERE id % 4 = 0 UNION ALL SELECT id % 5, 'prompt', id, 2, row_number() OVER (PARTITION BY id % 5 ORDER BY id) FROM e2 WHERE kind = 'prompt'), f AS (SELECT *, row_number() OVER (PARTITION BY q, kind, id ORDER BY section, rank) AS n FROM u) SELECT q, kind, id, row_number() OVER (PARTITION BY q ORDER BY section, rank, kind, id) AS place FROM f WHERE n = 1", "mem", "ev")
def _(s, sf):
    m, e = m2(s, sf).withColumn("q", F.col("id") % 5), ev2(s, sf).withColumn("q", F.col("id") % 5)
    number = lambda rows, kind, *o: O.top_per_key(rows, ["q"], 1 << 30, *o).select("q", F.lit(kind).alias("kind"), "id", "rank")
    return A.sources(number(m.where("kind = 'pinned'"), "pinned", "id"), number(m.where("id % 4 = 0"), "pinned", F.col("id").desc()), number(e.where("kind = 'prompt'"), "prompt", "id"))
