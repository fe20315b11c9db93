"""Records by place in a file, lookups in order, halves of like size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from .views import sql, table, view

QUERIES: dict = {}

def _raw(s, sf):
    c = table(s, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('{"t":"'), "turn", F.lit('"}'), F.coalesce("text", F.lit(""))).alias("line"))
    from pyspark.sql import Window as W

    return c.withColumn("at", F.coalesce(F.sum(F.octet_length("line") + 1).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def random_access(s, sf):
    """Records at (file, byte offset), none of over 4 MB."""
    raw = _raw(s, sf)
    want = raw.where("turn % 3 = 1").select("conv_id", F.col("at")).union(raw.where("turn % 3 = 2").select("conv_id", F.col("at") + 1))
    return want.join(raw, ["conv_id", "at"]).where(F.octet_length("line") <= 4 << 20).select("conv_id", "turn", F.md5("line").alias("line"))


QUERIES["random_access"] = (random_access, "SELECT conv_id, turn, md5('{\"t\":\"' || turn || '\"}' || coalesce(text, '')) AS line FROM conversations WHERE turn % 3 = 1")


def lookup_in_order(s, sf):
    """Rows of ranked ids, in the order of the ranks."""
    from pyspark.sql import Window as W

    ids = view(s, sf, "mem").where("id % 9 = 2").select("id", F.row_number().over(W.orderBy(F.col("id").desc())).alias("rank")).where("rank <= 20")
    return ids.join(view(s, sf, "mem"), "id").select("rank", "id", "type", "title")


QUERIES["lookup_in_order"] = (lookup_in_order, sql("SELECT rank, id, type, title FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS rank FROM mem WHERE id % 9 = 2) WHERE rank <= 20", "mem"))


def balanced_split(s, sf):
    """Sessions in two halves, the largest first, each to the smaller half."""
    return S.balanced(view(s, sf, "ev").groupBy("session_id").agg(F.sum("turn").alias("n")), "session_id", "n")


QUERIES["balanced_split"] = (balanced_split, sql("WITH RECURSIVE c AS (SELECT session_id, sum(turn)::BIGINT AS n FROM ev GROUP BY session_id), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, session_id) AS i FROM c), t AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, NULL::VARCHAR AS session_id, 0 AS half UNION ALL SELECT k.i, CASE WHEN b < a THEN a ELSE a + n END, CASE WHEN b < a THEN b + n ELSE b END, k.session_id, CASE WHEN b < a THEN 1 ELSE 0 END FROM t JOIN k ON k.i = t.i + 1) SELECT session_id, half FROM t WHERE i > 0", "ev"))
