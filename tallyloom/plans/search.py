"""Ranking, fusion and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import vectors as V
from .views import AS_OF, T0, index_of, neighbours_of, sql, table, view

STOP = ("the", "and", "for", "that", "with", "this", "from")
D30, D100, D300 = 2.592e9, 8.64e9, 2.592e10

TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
SCORES = rf"""
d AS (SELECT doc_id AS doc, {TOK.format("text")} AS t FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id AS q, unnest({TOK.format("text")}) AS term FROM benchmark),
sc AS (SELECT q, doc, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s
  FROM tf JOIN df USING (term) JOIN asked USING (term), st)"""


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.explode(R.tokens(F.col("text"))).alias("term")).distinct()


def scores(spark, sf):
    return R.term_scores(table(spark, sf, "documents"), "doc_id", "text", asked(spark, sf))


def bm25_top5(spark, sf):
    return index_of(spark, sf, "documents").top(asked(spark, sf), 5)


BM25 = f"WITH {SCORES}, r AS (SELECT q, doc, round(sum(s), 6) AS score, count(*) AS words FROM sc GROUP BY q, doc) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 5"


def recency(per):
    def run(spark, sf):
        return index_of(spark, sf, "documents").top(asked(spark, sf), 10, age=(AS_OF, per)).drop("words")

    return run, f"WITH {SCORES}, r AS (SELECT q, doc, round(sum(s) - ({AS_OF} - ({T0} + doc * 3600000)) / {per}::DOUBLE, 6) AS score FROM sc GROUP BY q, doc) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 10"


def two_of(spark, sf):
    few = asked(spark, sf)
    few = R.ranked(few.withColumn("n", F.octet_length("term")), "n", "term", k=8).select("q", "term")
    return index_of(spark, sf, "documents").top(few, 5, least=2, pairs=True)


TWO_OF = f"""WITH {SCORES}, few AS (SELECT q, term FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY octet_length(encode(term)) DESC, term) AS n FROM asked) WHERE n <= 8),
r AS (SELECT q, doc, round(sum(s) * (count(*) - 1), 6) AS score, count(*) AS words FROM sc JOIN few USING (q, term) GROUP BY q, doc HAVING count(*) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 5"""


def every_word(spark, sf):
    few = asked(spark, sf)
    few = R.ranked(few.withColumn("n", -F.octet_length("term")), "n", "term", k=2).select("q", "term")
    s = R.every_word(R.term_scores(table(spark, sf, "documents"), "doc_id", "text", few), few)
    return s.groupBy("q").agg(F.count(F.lit(1)).alias("docs"), F.round(F.max("score"), 6).alias("best"))


EVERY = f"""WITH {SCORES}, few AS (SELECT q, term FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY octet_length(encode(term)), term) AS n FROM asked) WHERE n <= 2),
need AS (SELECT q, count(*) AS need FROM few GROUP BY q),
r AS (SELECT q, doc, sum(s) AS score, count(*) AS words FROM sc JOIN few USING (q, term) GROUP BY q, doc)
SELECT q, count(*) AS docs, round(max(score), 6) AS best FROM r JOIN need USING (q) WHERE words = need GROUP BY q"""


def document_frequency(spark, sf):
    return index_of(spark, sf, "documents").frequencies(asked(spark, sf))


DF = f"WITH {SCORES} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(len) AS longest FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term"


def phrases(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.posexplode(F.slice(R.tokens(F.col("text")), 1, 3)).alias("i", "term"))
    return index_of(spark, sf, "documents").phrases(items)


PHRASES = rf"""WITH d AS (SELECT doc_id AS doc, {TOK.format("text")} AS t FROM documents), w AS (SELECT doc, t, unnest(range(1, len(t) + 1)) AS i FROM d),
g AS (SELECT doc, t[i] AS a, t[i + 1] AS b, t[i + 2] AS c FROM w), q AS (SELECT item_id AS q, {TOK.format("text")} AS t FROM benchmark)
SELECT q, doc, count(*) AS tf FROM g JOIN q ON a = t[1] AND b = t[2] AND c = t[3] GROUP BY q, doc"""


def recall_terms(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(R.recall_terms(F.col("text"), STOP), " ").alias("terms"))


RECALL = rf"""WITH w AS (SELECT item_id, string_split_regex(lower(text), '[\s,;:!?()\[\]{{}}"''`]+') AS l FROM benchmark),
p AS (SELECT item_id, flatten(list_transform(l, lambda x: string_split_regex(string_split(x, '/')[-1], '[^\p{{L}}\p{{N}}_]+'))) AS l FROM w),
e AS (SELECT item_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM p),
k AS (SELECT item_id, t, min(i) AS i FROM e WHERE octet_length(encode(t)) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {STOP} GROUP BY item_id, t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY octet_length(encode(t)) DESC, i) AS n FROM k)
SELECT item_id, string_agg(t, ' ' ORDER BY n) AS terms FROM r WHERE n <= 12 GROUP BY item_id"""


def stemmed_frequency(spark, sf):
    from ..functions.stem import stems

    words = table(spark, sf, "benchmark").select("item_id", F.explode(R.tokens(F.col("text"))).alias("w"))
    return words.withColumn("stem", stems(F.col("w"))).groupBy("stem").agg(F.count_distinct("item_id").alias("df"))


def _units(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def knn(spark, sf):
    v = _units(spark, sf)
    return V.nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 5)


KNN = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS q, b.id, round(list_dot_product(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.id % 50 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM s) WHERE rank <= 5"


def knn_filtered(spark, sf):
    v = _units(spark, sf)
    return V.nearest(v.where("label % 2 = 0"), v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 5)


def pooled_vectors(spark, sf):
    """Documents' vectors from those of their tokens; a token's vector is that of the row of `embeddings` that its hash names."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    n = e.count()
    own = lambda term: F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(n)
    p = V.pooled(d, "doc_id", "text", e.select(F.col("vec_id").alias("term"), F.col("embedding").alias("v")), 64, key=own)
    at = lambda i: F.round(F.get("v", F.lit(i)), 5) + 0.0
    return p.select(F.col("id").alias("doc_id"), "known", at(0).alias("v0"), at(17).alias("v17"), at(63).alias("v63"))


POOLED = f"""WITH t AS (SELECT doc_id, unnest({TOK.format("text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM embeddings), j AS (SELECT doc_id, tf, embedding::DOUBLE[] AS v FROM tf, n JOIN embeddings ON vec_id = ('0x' || substr(md5(term), 1, 8))::BIGINT % n),
s AS (SELECT doc_id, i, sum(tf * v[i]) AS x FROM j, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), z AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM s GROUP BY doc_id), k AS (SELECT doc_id, sum(tf)::BIGINT AS known FROM j GROUP BY doc_id),
o AS (SELECT doc_id, max(CASE WHEN i = 1 THEN x / z END) AS v0, max(CASE WHEN i = 18 THEN x / z END) AS v17, max(CASE WHEN i = 64 THEN x / z END) AS v63 FROM s JOIN z USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(known, 0) AS known, round(coalesce(v0, 0), 5) + 0.0::DOUBLE AS v0, round(coalesce(v17, 0), 5) + 0.0::DOUBLE AS v17, round(coalesce(v63, 0), 5) + 0.0::DOUBLE AS v63 FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN k USING (doc_id) LEFT JOIN o USING (doc_id)"""


def knn_by_cells(spark, sf):
    """knn_exact from a stored index of cells and blocks."""
    v = _units(spark, sf)
    index = neighbours_of(spark, sf, v.select("id", "v"))
    return index.find(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 5)


KNN_F = KNN.replace("ON a.id % 50 = 0)", "ON a.id % 50 = 0 AND b.l % 2 = 0)").replace("AS v FROM embeddings", "AS v, label AS l FROM embeddings")


def quantised(spark, sf):
    v = _units(spark, sf).withColumn("z", V.quantise(F.col("v")))
    return v.select("id", F.round("z.scale", 8).alias("scale"), F.aggregate("z.q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("z.q").cast("int").alias("top"), F.round(V.quantised_dot(F.col("v"), F.col("z.q"), F.col("z.scale")), 5).alias("self"))


QUANT = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-12) / 127 AS scale FROM v),
q AS (SELECT *, list_transform(v, lambda x: least(greatest(round(x / scale), -127), 127)) AS q FROM s)
SELECT id, round(scale, 8) AS scale, list_sum(q)::BIGINT AS total, list_max(q)::INTEGER AS top, round(list_dot_product(v, q::DOUBLE[]) * scale, 5) AS self FROM q"""


def fused(spark, sf):
    """Word ranks and vector ranks of the same ids, fused: items' documents by BM25, and neighbours of the vector of the item's number."""
    words = index_of(spark, sf, "documents").top(asked(spark, sf), 20).select("q", F.col("doc").alias("id"), "rank")
    v = _units(spark, sf)
    near = V.nearest(v, v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("q"), "v"), 20)
    return R.fuse((words, 1.0), (near, 0.2)).where("rank <= 10").select("q", "id", F.round("score", 8).alias("score"), "rank")


FUSED = f"""WITH {SCORES}, r AS (SELECT q, doc AS id, round(sum(s), 6) AS score FROM sc GROUP BY q, doc),
w AS (SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT a.id AS q, b.id, round(list_dot_product(a.v, b.v), 6) AS cosine FROM v a, v b WHERE a.id IN (SELECT item_id FROM benchmark)),
m AS (SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM n) WHERE rank <= 20),
u AS (SELECT q, id, 1.0::DOUBLE / (60 + rank) AS s, rank AS seen FROM w UNION ALL SELECT q, id, 0.2::DOUBLE / (60 + rank), 1000000 + rank FROM m),
f AS (SELECT q, id, sum(s) AS score, min(seen) AS seen FROM u GROUP BY q, id)
SELECT q, id, round(score, 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 10"""


def gated(spark, sf):
    v = _units(spark, sf)
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), "v")
    near = V.nearest(v, q, 60).select("q", "id", "cosine")
    words = R.ranked(near.where("id % 3 = 0").withColumn("w", (F.col("id") * 7919) % 101), "w", "id", k=6).select("q", "id", "rank")
    return R.gate_and_fill(words, near, 0.2, 0.3, 5)


GATED = f"""WITH a AS ({KNN.replace("rank <= 5", "rank <= 60")}), w AS (SELECT q, id, rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY (id * 7919) % 101 DESC, id) AS rank FROM a WHERE id % 3 = 0) WHERE rank <= 6),
k AS (SELECT w.q, w.id, 0 AS part, w.rank::DOUBLE AS o FROM w LEFT JOIN a USING (q, id) WHERE coalesce(cosine >= 0.2, true)),
m AS (SELECT q, id, 1 AS part, -cosine AS o FROM a WHERE cosine >= 0.3 AND NOT EXISTS (SELECT 1 FROM k WHERE k.q = a.q AND k.id = a.id))
SELECT q, id, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY part, o, id) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM m)) WHERE rank <= 5"""


def passages(spark, sf):
    d = table(spark, sf, "documents").withColumn("p", V.passages(F.regexp_replace("text", "\n", " ")))
    return d.select("doc_id", F.size("p").alias("n"), F.length(F.array_join("p", "")).alias("chars"))


def memory_search_by_date(spark, sf):
    m = view(spark, sf, "mem").where(F.lower("text").contains("the") & F.lower("text").contains("of"))
    return m.orderBy(F.col("created_at").desc(), "id").limit(20).select("id", "created_at", "type")


BY_DATE = sql("SELECT id, created_at, type FROM mem WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') ORDER BY created_at DESC, id LIMIT 20", "mem")


def embed_backlog(spark, sf):
    from ..functions.text import short_hash

    m = view(spark, sf, "mem").select("id", short_hash(F.col("text")).alias("text_hash"))
    have = m.where("id % 3 <> 0").withColumn("text_hash", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.col("text_hash")))
    return V.stale(m, have)


BACKLOG = sql("SELECT id, substr(sha256(text), 1, 16) AS text_hash FROM mem WHERE id % 3 = 0 OR id % 7 = 0", "mem")

QUERIES = {
    "bm25_top5": (bm25_top5, BM25), "bm25_recency_30d": recency(D30), "bm25_recency_100d": recency(D100), "bm25_recency_300d": recency(D300),
    "two_of_query": (two_of, TWO_OF), "every_word_query": (every_word, EVERY), "document_frequency": (document_frequency, DF), "phrase_match": (phrases, PHRASES),
    "recall_terms": (recall_terms, RECALL), "stemmed_frequency": (stemmed_frequency, None), "knn_exact": (knn, KNN), "knn_filtered": (knn_filtered, KNN_F), "knn_by_cells": (knn_by_cells, KNN), "pooled_vectors": (pooled_vectors, POOLED), "vector_quantise": (quantised, QUANT),
    "rank_fusion": (fused, FUSED), "gate_and_fill": (gated, GATED), "passages": (passages, None), "search_by_date": (memory_search_by_date, BY_DATE), "embed_backlog": (embed_backlog, BACKLOG),
}
