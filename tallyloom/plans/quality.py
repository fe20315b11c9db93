"""Queries on retrieval quality, usage and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .views import sql, table, view

QUERIES: dict = {}


def query(name: str, sql_text: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(sql_text, *names) if sql_text else None)
        return fn

    return keep


_CASES = "SELECT doc_id AS q, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 9 + 1 END AS rank FROM documents"


@query("recall_metrics", f"SELECT count(*) AS cases, round(avg(CASE WHEN coalesce(rank, 999) <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN coalesce(rank, 999) <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ({_CASES})")
def _(s, sf):
    d = table(s, sf, "documents").select(F.col("doc_id").alias("q"), F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 9 + 1).alias("rank"))
    return E.recall_metrics(d)


def _scored(s, sf):
    d = table(s, sf, "documents").select("doc_id", (F.col("n_chars") % 997).alias("score"), (F.col("n_chars") % 101).alias("other"))
    return d.join(table(s, sf, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")


_SCORED = "SELECT doc_id, n_chars % 997 AS score, quality = 1 AS good FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"


@query("auc", f"WITH x AS ({_SCORED}), p AS (SELECT score FROM x WHERE good), m AS (SELECT score FROM x WHERE NOT good) SELECT (SELECT count(*) FROM p) AS pos, (SELECT count(*) FROM m) AS neg, (SELECT round(avg(CASE WHEN p.score > m.score THEN 1.0::DOUBLE WHEN p.score = m.score THEN 0.5 ELSE 0 END), 6) FROM p, m) AS auc")
def _(s, sf):
    return E.auc(_scored(s, sf), "score", "good")


_ROUND = lambda score: f"(WITH n AS (SELECT round, {score} AS s, sum(CASE WHEN good THEN w ELSE 0 END) AS p, sum(CASE WHEN good THEN 0 ELSE w END) AS m FROM rw GROUP BY ALL), c AS (SELECT round, p, m, p * (coalesce(sum(m) OVER (PARTITION BY round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + m / 2.0::DOUBLE) AS x FROM n) SELECT round, sum(x)::DOUBLE / (sum(p)::DOUBLE * sum(m)::DOUBLE) AS auc FROM c GROUP BY round HAVING sum(p) > 0 AND sum(m) > 0)"


@query(
    "auc_bootstrap",
    f"""WITH x AS (SELECT doc_id, n_chars % 997 AS score, n_chars % 101 AS other, quality = 1 AS good FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS g FROM (SELECT DISTINCT doc_id FROM x)), k AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r.round, ('0x' || substr(md5('7:' || r.round || ':' || i.i), 1, 12))::BIGINT % n AS g FROM (SELECT unnest(range(1000)) AS round) r, (SELECT unnest(range(n)) AS i, n FROM k) i),
pk AS (SELECT round, g, count(*) AS w FROM dr GROUP BY ALL), rw AS (SELECT round, w, score, other, good FROM pk JOIN g USING (g) JOIN x USING (doc_id)),
d AS (SELECT round(a.auc - b.auc, 9) AS d FROM {_ROUND("score")} a JOIN {_ROUND("other")} b USING (round)), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT round(avg(d), 6) AS mean, round(max(CASE WHEN i = floor((n - 1) * 0.025::DOUBLE) THEN d END), 6) AS low, round(max(CASE WHEN i = floor((n - 1) * 0.975::DOUBLE) THEN d END), 6) AS high, round(avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM o""",
)
def _(s, sf):
    return E.bootstrap_auc(_scored(s, sf), "doc_id", "score", "other", "good")


@query("wilson_interval", "SELECT source, k, n, round(CASE WHEN n = 0 THEN 0 ELSE (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) END, 6) AS low, round(CASE WHEN n = 0 THEN 0 ELSE (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) END, 6) AS high FROM (SELECT source, count_if(lang = 'en') AS k, count(*) AS n, count_if(lang = 'en')::DOUBLE / count(*) AS p FROM documents GROUP BY source)")
def _(s, sf):
    g = table(s, sf, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", E.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "w.low", "w.high")


@query("kappa", "WITH j AS (SELECT (quality = 1)::INTEGER::DOUBLE AS a, (doc_id % 3 <> 0)::INTEGER::DOUBLE AS b FROM labels WHERE quality IS NOT NULL), m AS (SELECT count(*) AS shared, count_if(a = b) AS agreed, avg(a) AS pa, avg(b) AS pb FROM j) SELECT shared, agreed, round((agreed / shared - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM m")
def _(s, sf):
    x = table(s, sf, "labels").where("quality IS NOT NULL")
    return E.kappa(x.select("doc_id", (F.col("quality") == 1).alias("v")), x.select("doc_id", (F.col("doc_id") % 3 != 0).alias("v")), "doc_id", "v")


_CAND = "SELECT doc_id // 10 AS q, doc_id % 10 AS rank, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars % 100 / 100.0::DOUBLE END AS score, n_chars % 3 = 0 AS helpful FROM documents"


@query("threshold_sweep", f"WITH c AS ({_CAND}), t AS (SELECT round(i * 0.05::DOUBLE, 2) AS t FROM (SELECT unnest(range(20)) AS i)), k AS (SELECT t, q, helpful, row_number() OVER (PARTITION BY t, q ORDER BY rank) AS n FROM c, t WHERE score IS NULL OR score >= t) SELECT t, count_if(helpful) AS helpful, count_if(NOT helpful) AS unhelpful, count(DISTINCT CASE WHEN helpful THEN q END) AS prompts FROM k WHERE n <= 5 GROUP BY t")
def _(s, sf):
    c = table(s, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("q"), (F.col("doc_id") % 10).alias("rank"), F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 100 / 100.0).alias("score"), (F.col("n_chars") % 3 == 0).alias("helpful"))
    return E.sweep(c)


@query("cosine_targets", "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS q, b.label = a.label AS own, round(list_dot_product(a.v, b.v), 6) AS c FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id) SELECT q, max(c) FILTER (WHERE own) AS target, max(c) FILTER (WHERE NOT own) AS wrong FROM s GROUP BY q")
def _(s, sf):
    from ..operators.vectors import nearest_by_label

    v = table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    x = nearest_by_label(v, v.where("id % 50 = 0").withColumnRenamed("id", "q"))
    return x.groupBy("q").agg(F.max(F.when(F.col("own"), F.col("cosine"))).alias("target"), F.max(F.when(~F.col("own"), F.col("cosine"))).alias("wrong"))


@query("agent_comparison", "SELECT m.project, count(DISTINCT m.session_id) AS sessions, count(DISTINCT e.session_id) AS captured FROM mem m LEFT JOIN ev e USING (session_id) GROUP BY m.project", "mem", "ev")
def _(s, sf):
    e = view(s, sf, "ev").select("session_id").distinct().withColumn("c", F.col("session_id"))
    return view(s, sf, "mem").select("project", "session_id").distinct().join(e, "session_id", "left").groupBy("project").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("c").alias("captured"))


_MODELS = ("gpt-5", "claude-haiku", "gemini-flash", "gemini-pro", "tts-one", "house/mini.2", "minimal", "claude-opus", "gpt-image", "nano-x", "o3-small", "whisper-lite")
_OFFERS = f"SELECT event_id % 997 AS user_id, event_id, ({list(_MODELS)})[event_id % 12 + 1] || CASE WHEN event_id % 5 = 0 THEN '' ELSE '-' || (event_id % 40) END AS model, CASE WHEN event_id % 12 IN (0, 1, 3) THEN event_id % 12 END AS place, event_id % 7 <> 0 AS available, CASE WHEN event_id % 11 = 0 THEN event_id % 2 END AS cooling FROM events"


@query("model_order", f"""WITH o AS ({_OFFERS}), k AS (SELECT *, NOT regexp_matches(lower(model), '(^|[^a-z0-9])(lite|flash|haiku|luna|mini|nano|small)($|[^a-z0-9])') AS dear FROM o WHERE available AND coalesce(cooling, 0) <= 0 AND (place IS NOT NULL OR NOT regexp_matches(lower(model), 'image|embedding|tts|whisper|review|realtime|audio')))
SELECT user_id, event_id, model, row_number() OVER (PARTITION BY user_id ORDER BY place IS NULL, place, CASE WHEN place IS NULL THEN dear END, event_id) AS rank FROM k""")
def _(s, sf):
    e, k = table(s, sf, "events"), F.col("event_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, _MODELS)), (k % 12 + 1).cast("int")), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (k % 40).cast("string"))))
    rows = e.select((k % 997).alias("user_id"), "event_id", name.alias("model"), F.when((k % 12).isin(0, 1, 3), k % 12).alias("place"), (k % 7 != 0).alias("available"), F.when(k % 11 == 0, k % 2).alias("until"))
    return E.model_order(rows, "user_id", "event_id", F.lit(0)).select("user_id", "event_id", "model", "rank")


@query("http_failures", "SELECT event_id, code, CASE WHEN code = 401 THEN 'endpoint' ELSE 'next_model' END AS action, CASE WHEN code IN (402, 429) THEN 30 WHEN code IN (403, 404) THEN 360 WHEN code <> 401 THEN 5 END AS wait_min FROM (SELECT event_id, (400 + event_id % 130)::INTEGER AS code FROM events)")
def _(s, sf):
    rows = table(s, sf, "events").select("event_id", (400 + F.col("event_id") % 130).cast("int").alias("code"))
    return rows.withColumn("f", E.http_failure(F.col("code"))).select("event_id", "code", "f.action", "f.wait_min")
