"""Queries of pages, feeds, details, and of what became of offered memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as X
from ..operators import feeds as P
from ..operators import ranking as R
from .asking import _EV2, ev2
from .recalling import _FEW, few
from .search import TOK
from .views import T0, sql, table, view

QUERIES: dict = {}


def query(name: str, sql_text: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(sql_text, *names) if sql_text else None)
        return fn

    return keep


_SESS = "s AS (SELECT session_id, substr(session_id, 6)::BIGINT AS row, any_value(project) AS project, max(ts) AS last_event_at FROM ev GROUP BY session_id)"


def sess(s, sf):
    return view(s, sf, "ev").groupBy("session_id").agg(F.first("project").alias("project"), F.max("ts").alias("last_event_at")).withColumn("row", F.substring("session_id", 6, 20).cast("long"))


@query("sessions_page", f"WITH {_SESS}, p AS (SELECT *, row_number() OVER (ORDER BY row DESC) AS n FROM s WHERE row < 90 AND project ILIKE '%p1%' AND starts_with(session_id, 'conv:') AND last_event_at >= {T0 + 600_000}) SELECT session_id, project, last_event_at, row, CASE WHEN (SELECT max(n) FROM p) > 7 THEN (SELECT min(row) FROM p WHERE n <= 7) END AS next FROM p WHERE n <= 7", "ev")
def _(s, sf):
    return P.sessions_page(sess(s, sf), 7, 90, "P1", "conv", T0 + 600_000)


@query("session_details", f"WITH {_EV2}, e AS (SELECT session_id, count(*) AS events, count(CASE WHEN kind = 'prompt' THEN 1 END) AS prompts, count(DISTINCT CASE WHEN kind = 'file_edit' THEN path END) AS files FROM e2 GROUP BY ALL), m AS (SELECT session_id, count(*) AS memories FROM mem GROUP BY ALL) SELECT session_id, events, prompts, files, coalesce(memories, 0) AS memories FROM e LEFT JOIN m USING (session_id)", "ev", "mem")
def _(s, sf):
    return P.session_details(view(s, sf, "ev").select("session_id").distinct(), ev2(s, sf), view(s, sf, "mem")).select("session_id", "events", "prompts", "files", "memories")


@query("memory_detail", "WITH x AS (SELECT m.id, string_agg(e.id::VARCHAR, ',' ORDER BY e.id) AS evidence, max(e.ts) AS newest FROM mem m JOIN ev e ON e.session_id = m.session_id AND e.turn < 3 GROUP BY m.id) SELECT m.id, m.type, m.title, coalesce(evidence, '') AS evidence, newest, CASE WHEN m.id % 7 = 0 THEN 'gone' END AS \"left\" FROM mem m LEFT JOIN x USING (id)", "mem", "ev")
def _(s, sf):
    m, e = view(s, sf, "mem"), view(s, sf, "ev")
    evidence = m.select("id", "session_id").join(e.where("turn < 3").select("session_id", F.col("id").alias("event_id")), "session_id").select("id", "event_id")
    out = P.memory_details(m, evidence, e, m.where("id % 7 = 0").select(F.col("id").alias("key"), F.lit("gone").alias("left")))
    return out.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


def _sides(s, sf):
    m = view(s, sf, "mem").select(F.lit("memory").alias("kind"), "id", F.col("created_at").alias("at"))
    return m, view(s, sf, "ev").where("kind = 'prompt'").select(F.lit("prompt").alias("kind"), "id", F.col("ts").alias("at"))


_BOTH = "b AS (SELECT 'memory' AS kind, id, created_at AS tm FROM mem UNION ALL SELECT 'prompt', id, ts FROM ev WHERE kind = 'prompt')"


@query("feed_before", f"WITH {_BOTH} SELECT kind, id, tm AS at, row_number() OVER (ORDER BY tm DESC, kind, id) AS place FROM (SELECT * FROM b WHERE tm <= {T0 + 90 * 3_600_000} ORDER BY tm DESC, kind, id LIMIT 15)".replace(" AS at,", ' AS "at",'), "mem", "ev")
def _(s, sf):
    return P.feed(*_sides(s, sf), 15, before=T0 + 90 * 3_600_000)


@query("feed_after", f"WITH {_BOTH} SELECT kind, id, tm AS \"at\", row_number() OVER (ORDER BY tm DESC, kind, id) AS place FROM (SELECT * FROM b WHERE tm > {T0 + 20 * 3_600_000} ORDER BY tm, kind, id LIMIT 15)", "mem", "ev")
def _(s, sf):
    return P.feed(*_sides(s, sf), 15, after=T0 + 20 * 3_600_000)


@query("summary_fields", "SELECT id, CASE WHEN id % 3 = 0 THEN 'from data' WHEN id % 3 = 1 THEN type END AS asked, CASE WHEN id % 3 <> 2 THEN 'n' || id END AS learned FROM mem", "mem")
def _(s, sf):
    m = view(s, sf, "mem")
    text = F.when(F.col("id") % 3 == 2, "plain text").otherwise(F.concat(F.lit("Request: "), "type", F.lit("\nLearned: n"), "id", F.lit("\nmore")))
    data = F.when(F.col("id") % 3 == 0, F.lit('{"asked": "from data"}'))
    f = P.summary_fields(text, data, {"asked": "Request", "learned": "Learned"})
    return m.select("id", f.alias("f")).select("id", "f.asked", "f.learned")


@query("topic_elsewhere", rf"SELECT project, count(*) AS n FROM mem WHERE project <> 'src1' AND list_contains({TOK.format('text')}, 'the') AND list_contains({TOK.format('text')}, 'of') GROUP BY project HAVING count(*) >= 3 ORDER BY n DESC, project LIMIT 5", "mem")
def _(s, sf):
    m = view(s, sf, "mem")
    t = R.tokens(F.col("text"))
    return P.topic_elsewhere(m.where(F.array_contains(t, "the") & F.array_contains(t, "of")), m, "src1")


@query("document_frequency_as_of", rf"WITH {_FEW}, d AS (SELECT id, unnest(list_distinct({TOK.format('text')})) AS t FROM mem WHERE created_at < {T0 + 120 * 3_600_000}), f AS (SELECT t, count(*) AS df FROM d GROUP BY t) SELECT DISTINCT fw.t AS term, coalesce(df, 0) AS df, (SELECT count(*) FROM mem WHERE created_at < {T0 + 120 * 3_600_000}) AS total FROM fw LEFT JOIN f USING (t)", "mem")
def _(s, sf):
    return P.document_frequency_as_of(view(s, sf, "mem"), "id", "text", "created_at", few(s, sf), T0 + 120 * 3_600_000)


_OFFERS = "o AS (SELECT id AS offer, memory AS id, CASE session % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'a#x' ELSE 'b' END AS project, at_ms AS tm, CASE id % 2 WHEN 0 THEN 'prompt' ELSE 'start' END AS source, 'conv:' || session % 40 AS session_id FROM logs WHERE what = 'offer' AND memory IS NOT NULL), f AS (SELECT memory AS id, CASE session % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a/sub' ELSE 'b#y' END AS project, at_ms AS tm FROM logs WHERE what = 'fetch' AND memory IS NOT NULL)"
_HIT = "SELECT DISTINCT o.offer, o.id FROM o JOIN f ON o.id = f.id AND f.tm BETWEEN o.tm AND o.tm + 86400000 AND (f.project IS NULL OR starts_with(f.project, regexp_replace(coalesce(o.project, ''), '#.*$', '')))"


def _offers(s, sf):
    x = view(s, sf, "logs").where("memory IS NOT NULL")
    k = F.col("session") % 4
    o = x.where("what = 'offer'").select(F.col("id").alias("offer"), F.col("memory").alias("id"), F.when(k == 1, "a").when(k == 2, "a#x").when(k == 3, "b").alias("project"), F.col("at_ms").alias("at"), F.when(F.col("id") % 2 == 0, "prompt").otherwise("start").alias("source"), F.concat(F.lit("conv:"), F.col("session") % 40).alias("session_id"))
    j = F.col("session") % 3
    f = x.where("what = 'fetch'").select(F.col("memory").alias("id"), F.when(j == 1, "a/sub").when(j == 2, "b#y").alias("project"), F.col("at_ms").alias("at"))
    return o, f


@query("interval_join_fetch", f"WITH {_OFFERS} {_HIT}", "logs")
def _(s, sf):
    return P.fetched_offers(*_offers(s, sf))


_SAID = "('as #' || (id % 60) || ' and #' || (turn + 3) || 'x')"
_CITED = f"c AS (SELECT session_id, ts, unnest(list_transform(regexp_extract_all({_SAID}, '#([0-9]+)', 1), lambda x: x::BIGINT)) AS id FROM ev WHERE kind = 'assistant')"


def _replies(s, sf):
    said = F.concat(F.lit("as #"), F.col("id") % 60, F.lit(" and #"), F.col("turn") + 3, F.lit("x"))
    return view(s, sf, "ev").where("kind = 'assistant'").select("session_id", "ts", said.alias("text"))


@query("cited_in_reply", f"WITH {_OFFERS}, {_CITED} SELECT DISTINCT o.offer, o.id FROM o JOIN c ON o.session_id = c.session_id AND o.id = c.id AND c.ts >= o.tm", "logs", "ev")
def _(s, sf):
    return P.cited_offers(_offers(s, sf)[0], _replies(s, sf))


@query("uptake_report", f"WITH {_OFFERS}, {_CITED}, h AS ({_HIT}), g AS (SELECT DISTINCT o.offer, o.id FROM o JOIN c ON o.session_id = c.session_id AND o.id = c.id AND c.ts >= o.tm) SELECT source, count(*) AS offers, count(DISTINCT session_id) AS sessions, count(h.offer) AS fetched, count(g.offer) AS cited, min(tm) AS since FROM o LEFT JOIN h ON h.offer = o.offer AND h.id = o.id LEFT JOIN g ON g.offer = o.offer AND g.id = o.id GROUP BY source", "logs", "ev")
def _(s, sf):
    o, f = _offers(s, sf)
    return P.uptake(o, P.fetched_offers(o, f), P.cited_offers(o, _replies(s, sf)))


@query("tool_calls", f"SELECT what AS tool, count(*) AS calls, min(at_ms) AS since FROM logs WHERE what IN ('fetch', 'cite') GROUP BY what", "logs")
def _(s, sf):
    return view(s, sf, "logs").where(F.col("what").isin("fetch", "cite")).groupBy(F.col("what").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.min("at_ms").alias("since"))


@query("folded_stems", r"SELECT item_id, count(*) AS n FROM (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS t FROM benchmark) WHERE regexp_full_match(t, '[0-9]+|[^a-z]*|..?')) GROUP BY item_id")
def _(s, sf):
    w = table(s, sf, "benchmark").select("item_id", F.explode(R.tokens(X.unaccented(F.col("text")))).alias("w")).withColumn("t", stem.stems(F.col("w")))
    return w.where("t RLIKE '^([0-9]+|[^a-z]*|..?)$' AND w RLIKE '^([0-9]+|[^a-z]*|..?)$'").select("item_id", "t").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("days", f"SELECT id, strftime(to_timestamp((ts + 7200000) / 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, strftime(to_timestamp((ts + 7200000) / 1000) AT TIME ZONE 'UTC', '%A %-d %B %Y') AS long_day FROM ev", "ev")
def _(s, sf):
    return view(s, sf, "ev").select("id", X.day(F.col("ts"), 120).alias("day"), X.long_day(F.col("ts"), 120).alias("long_day"))


@query("leading_ids", r"SELECT id, '[' || id || ', ' || (id + 1) || ']' AS ids FROM ev", "ev")
def _(s, sf):
    t = F.concat(F.lit("#"), "id", F.lit(" first\nsee #9 here\n#"), F.col("id") + 1, F.lit(" second\n#7x"))
    return view(s, sf, "ev").select("id", F.concat(F.lit("["), F.array_join(X.leading_ids(t).cast("array<string>"), ", "), F.lit("]")).alias("ids"))
