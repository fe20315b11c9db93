"""Queries that put operators together: recall modes, sources of an answer, deltas, traces, distilled replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import relational as O
from ..operators import sessions as S
from ..operators import vectors as V
from .search import KNN
from .views import sql, table, view

QUERIES: dict = {}


def query(name: str, sql_text: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(sql_text, *names) if sql_text else None)
        return fn

    return keep


def _lists(s, sf):
    v = table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = V.nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 60)
    words = R.ranked(near.where("id % 3 = 0").withColumn("w", (F.col("id") * 7919) % 101), "w", "id", k=30).select("q", "id", "rank")
    return words, near


_A = f"a AS ({KNN.replace('rank <= 5', 'rank <= 60')}), w AS (SELECT q, id, rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY (id * 7919) % 101 DESC, id) AS rank FROM a WHERE id % 3 = 0) WHERE rank <= 30)"


@query("recall_keyword", f"WITH {_A} SELECT * FROM w WHERE rank <= 5")
def _(s, sf):
    return S.rank_mode("keyword", *_lists(s, sf), 5)


@query("recall_vector", f"WITH {_A} SELECT q, id, rank FROM a WHERE rank <= 5")
def _(s, sf):
    return S.rank_mode("vector", *_lists(s, sf), 5)


@query("recall_hybrid", f"WITH {_A}, u AS (SELECT q, id, 1.0::DOUBLE / (60 + rank) AS s, rank AS seen FROM w WHERE rank <= 30 UNION ALL SELECT q, id, 0.5::DOUBLE / (60 + rank), 1000000 + rank FROM a WHERE rank <= 30), f AS (SELECT q, id, sum(s) AS score, min(seen) AS seen FROM u GROUP BY q, id) SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 5")
def _(s, sf):
    return S.rank_mode("hybrid", *_lists(s, sf), 5)


_TIER = "CASE WHEN (title ILIKE '%shipped%' OR title ILIKE '%released%' OR title ILIKE '%merged%' OR regexp_matches(title, 'v[0-9]\\.[0-9]')) AND NOT (title ILIKE '%not %' OR title ILIKE '%unreleased%') THEN 0 WHEN type IN ('feature', 'bugfix', 'decision') THEN 1 WHEN type IN ('change', 'refactor') THEN 3 ELSE 4 END"


@query("weight_tiers", f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM mem) GROUP BY tier", "mem")
def _(s, sf):
    return view(s, sf, "mem").select(S.weight_tier(F.col("title"), F.col("type"), F.lit("observation")).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("turn_chunks", "WITH RECURSIVE t AS (SELECT session_id, id, octet_length(encode(text)) AS b, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM ev), r AS (SELECT session_id, id, n, 0 AS chunk, b AS held FROM t WHERE n = 1 UNION ALL SELECT t.session_id, t.id, t.n, CASE WHEN held > 0 AND held + b > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN held > 0 AND held + b > 2000 THEN b ELSE held + b END FROM r JOIN t ON t.session_id = r.session_id AND t.n = r.n + 1) SELECT session_id, id, chunk FROM r", "ev")
def _(s, sf):
    e = view(s, sf, "ev").withColumn("bytes", F.octet_length("text"))
    return S.chunk_turns(e, "session_id", "id", "bytes", 2000)


@query("ring_dedupe", "WITH RECURSIVE t AS (SELECT session, id, what, row_number() OVER (PARTITION BY session ORDER BY id) AS n FROM logs), r AS (SELECT session, id, what, n, true AS keep, [what] AS ring FROM t WHERE n = 1 UNION ALL SELECT t.session, t.id, t.what, t.n, NOT list_contains(ring, t.what), CASE WHEN list_contains(ring, t.what) THEN ring ELSE list_append(ring, t.what)[-2:] END FROM r JOIN t ON t.session = r.session AND t.n = r.n + 1) SELECT session, id, what FROM r WHERE keep", "logs")
def _(s, sf):
    return S.ring_dedupe(view(s, sf, "logs").select("session", "id", "what"), "session", "id", "what", 2)


@query("distilled_replies", "SELECT session_id, count(*) AS n, count_if(turn % 4 = 1) AS features FROM ev WHERE turn < 8 AND text <> '' GROUP BY session_id", "ev")
def _(s, sf):
    o = F.struct(F.when(F.col("turn") % 4 == 1, "feature").otherwise("odd").alias("type"), F.col("text").alias("title"))
    r = view(s, sf, "ev").where("turn < 8").groupBy("session_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", o.alias("o")))).getField("o").alias("observations"))).alias("reply"))
    return S.apply_replies(r).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "feature").alias("features"))


_SAY = "CASE turn % 4 WHEN 0 THEN 'Yes, B it is' WHEN 1 THEN 'ok since it fits' WHEN 2 THEN 'please do it for all files here' ELSE substr(text, 1, 40) END"


@query("go_ahead_prompts", f"WITH t AS (SELECT id, lower(trim({_SAY})) AS t FROM ev), w AS (SELECT id, t, list_filter(string_split_regex(t, '[^\\p{{L}}\\p{{N}}'']+'), lambda x: x <> '') AS w FROM t) SELECT id FROM w WHERE length(t) <= 60 AND NOT contains(t, '?') AND NOT regexp_matches(t, 'because|since|so that|so we|karena|supaya|biar|to avoid|reason|why') AND len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('ok', 'okay', 'yes', 'yep', 'sure', 'go', 'ahead', 'do', 'it', 'let''s', 'lets', 'with', 'option', 'please', 'that', 'use', 'pick', 'agree', 'approved', 'approve', 'ya', 'lanjut') AND NOT regexp_full_match(x, '[a-z0-9]'))) <= 2", "ev")
def _(s, sf):
    return view(s, sf, "ev").withColumn("t", F.expr(_SAY)).where(O.go_ahead(F.col("t"))).select("id")


_FIT = """WITH RECURSIVE tn AS (SELECT session_id, project, conv, turn, octet_length(encode(text)) AS b FROM (SELECT *, id // 100 AS conv FROM ev)),
one AS (SELECT session_id, any_value(project) AS project, any_value(conv) AS conv, sum(b) AS whole FROM tn GROUP BY session_id),
ob AS (SELECT session_id, octet_length(encode(title)) AS b, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) AS n FROM mem WHERE type <> 'sensitive'),
ps AS (SELECT a.session_id, b.session_id AS other, row_number() OVER (PARTITION BY a.session_id ORDER BY b.conv DESC) AS k FROM one a JOIN one b ON a.project = b.project AND b.conv < a.conv),
pt AS (SELECT ps.session_id, k, b, row_number() OVER (PARTITION BY ps.session_id, k ORDER BY turn DESC) AS t FROM ps JOIN tn ON tn.session_id = ps.other WHERE k <= 6),
ct AS (SELECT session_id, (SELECT least(count(*), 40) FROM ob WHERE ob.session_id = one.session_id) AS o, 3 AS t, (SELECT least(count(*), 6) FROM ps WHERE ps.session_id = one.session_id) AS k FROM one),
sz AS (SELECT session_id, o, t, k, 200 + coalesce((SELECT sum(b) FROM ob WHERE ob.session_id = ct.session_id AND n <= o), 0) + 60 * k + coalesce((SELECT sum(b) FROM pt WHERE pt.session_id = ct.session_id AND pt.k <= ct.k AND pt.t <= ct.t), 0) AS bytes FROM ct),
go AS (SELECT session_id, o, t, k, bytes, bytes <= 2000 OR (o = 0 AND t <= 1 AND k <= 1) AS done FROM sz
 UNION ALL SELECT session_id, o2, t2, k2, bytes2, bytes2 <= 2000 OR (o2 = 0 AND t2 <= 1 AND k2 <= 1) FROM (SELECT session_id, o2, t2, k2, 200 + coalesce((SELECT sum(b) FROM ob WHERE ob.session_id = nx.session_id AND n <= o2), 0) + 60 * k2 + coalesce((SELECT sum(b) FROM pt WHERE pt.session_id = nx.session_id AND pt.k <= k2 AND pt.t <= t2), 0) AS bytes2
  FROM (SELECT session_id, CASE WHEN o > 10 THEN o // 2 WHEN t > 1 OR k > 1 THEN o ELSE 0 END AS o2, CASE WHEN o <= 10 AND t > 1 THEN t - 1 ELSE t END AS t2, CASE WHEN o <= 10 AND t <= 1 AND k > 1 THEN k - 1 ELSE k END AS k2 FROM go WHERE NOT done) nx))
SELECT session_id, o::INTEGER AS observations, t::INTEGER AS turns, k::INTEGER AS sessions, bytes::BIGINT AS bytes FROM go WHERE done"""


@query("contexts_fitted", _FIT, "ev", "mem")
def _(s, sf):
    """For each session the context of at most 2000 bytes: titles of its memories, and the six sessions of its project before it."""
    from pyspark.sql import Window as W

    e = view(s, sf, "ev").withColumn("b", F.octet_length("text").cast("long"))
    latest = F.transform(F.sort_array(F.collect_list(F.struct("turn", "b")), asc=False), lambda x: x["b"])
    one = e.groupBy("session_id").agg(F.first("project").alias("project"), F.min(F.floor(F.col("id") / 100)).alias("conv"), F.slice(latest, 1, 3).alias("turns"))
    before = W.partitionBy("project").orderBy(F.col("conv")).rowsBetween(-6, -1)
    own = F.reverse(F.collect_list(F.struct(F.lit(60).cast("long").alias("head"), "turns")).over(before))  # six sessions
    m = view(s, sf, "mem").where("type <> 'sensitive'").withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("created_at").desc(), "id"))).where("n <= 40")
    o = m.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.octet_length("title").cast("long").alias("b")))), lambda x: x["b"]).alias("o"))
    rows = one.withColumn("s", own).join(o, "session_id", "left").withColumn("o", F.coalesce("o", F.array().cast("array<bigint>")))
    return rows.withColumn("c", S.fitted(F.lit(200).cast("long"), F.col("o"), F.col("s"), 3, 2000)).select("session_id", "c.observations", "c.turns", "c.sessions", "c.bytes")


_CHUNKS = QUERIES["turn_chunks"][1]
_DISTIL = f"WITH tc AS ({_CHUNKS}), e AS (SELECT conv_id * 100 + turn AS id, conv_id, turn FROM conversations), c AS (SELECT tc.session_id, chunk, e.conv_id, e.id, e.turn, row_number() OVER (PARTITION BY tc.session_id, chunk ORDER BY e.id) - 1 AS n, min(e.id) OVER (PARTITION BY tc.session_id, chunk) AS first_id, max(e.id) OVER (PARTITION BY tc.session_id, chunk) AS last_id, (conv_id * 7 + chunk) % 5 = 0 AS bad FROM tc JOIN e USING (id))"


def _distilled(s, sf):
    """Sessions in chunks, and for each a reply with an observation for each turn; one in five isn't JSON."""
    e = view(s, sf, "ev").withColumn("bytes", F.octet_length("text"))
    turns = S.chunk_turns(e, "session_id", "id", "bytes", 2000)
    o = F.struct(F.when(F.col("id") % 4 == 1, "feature").otherwise("odd").alias("type"), F.concat(F.lit("turn "), F.col("id") % 100).alias("title"))
    g = turns.groupBy("session_id", "chunk").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("id", o.alias("o")))), lambda x: x["o"]).alias("observations"))).alias("reply"))
    bad = (F.floor(F.col("first_id") / 100) * 7 + F.col("chunk")) % 5 == 0
    g = g.withColumn("reply", F.when(bad, "sorry, no").otherwise(F.col("reply")))
    return S.distil(g.drop("reply"), g.select("session_id", "chunk", "reply"))


@query("distilled_chunks", f"{_DISTIL} SELECT session_id, chunk, n::INTEGER AS n, CASE WHEN id % 4 = 1 THEN 'feature' ELSE 'discovery' END AS type, 'turn ' || turn AS title, first_id, last_id FROM c WHERE NOT bad AND n < 8")
def _(s, sf):
    return _distilled(s, sf)[0].select("session_id", "chunk", "n", "type", "title", "first_id", "last_id")


@query("distil_marks", f"{_DISTIL}, g AS (SELECT DISTINCT session_id, chunk, last_id, bad FROM c), d AS (SELECT *, count(CASE WHEN bad THEN 1 END) OVER (PARTITION BY session_id ORDER BY chunk) AS b FROM g) SELECT session_id, max(last_id) AS through FROM d WHERE b = 0 GROUP BY session_id")
def _(s, sf):
    return _distilled(s, sf)[1]
