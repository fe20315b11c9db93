"""Record functions over literals and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as P
from .views import sql, table, view

QUERIES: dict = {}


def query(name: str, sql_text: str | None, *names: str):
    def keep(fn):
        QUERIES[name] = (fn, sql(sql_text, *names) if sql_text else None)
        return fn

    return keep


def _values(items) -> str:
    return "(SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]) AS x)"


_MODELS = ("claude-x", "proxy/gpt-9", "o3-mini", "opus", "team/gemini-1", "codex-2", "other/thing")


@query("record_ids", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9' WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, sha256('tallyloom-record:' || doc_id) AS h FROM documents)")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", P.record_id(F.col("doc_id").cast("string")).alias("id"))


_FAILED = ("Not logged in", "Rate limit hit", "HTTP 429", "model x does not exist", "socket closed", "please /login")


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")"


_NAMES = ("team-a", " /x.y/ ", "no spaces here", "", "a" * 41)


@query("survival_phrases", "SELECT doc_id, CASE WHEN k * 5 >= o * 4 THEN 'intact' WHEN k * 5 >= o THEN k || ' of ' || o ELSE 'gone' END AS left_over FROM (SELECT doc_id, n_chars % 10 AS k, 10 AS o FROM documents)")
def _(s, sf):
    return table(s, sf, "documents").select("doc_id", P.survival(F.col("n_chars") % 10, F.lit(10)).alias("left_over"))


@query("shown_citations", "SELECT id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all('E' || (id % 7) || ', E' || turn || ' E99x', '\\bE(\\d{1,18})\\b', 1), lambda c: c::BIGINT), lambda c: c IN (1, 2, 3, 5))))::VARCHAR AS cited FROM ev", "ev")
def _(s, sf):
    said = F.concat(F.lit("E"), F.col("id") % 7, F.lit(", E"), "turn", F.lit(" E99x"))
    shown = F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 5)))
    return view(s, sf, "ev").select("id", F.concat(F.lit("["), F.array_join(P.shown_citations(said, shown).cast("array<string>"), ", "), F.lit("]")).alias("cited"))


@query("excerpts", r"WITH c AS (SELECT id, text, substr(text, 1, 120) AS c, regexp_extract(substr(text, 1, 120), '(?s)^(.{59,}[.!?;])\s', 1) AS a, regexp_extract(substr(text, 1, 120), '(?s)^(.{60,})\s', 1) AS b FROM ev) SELECT id, CASE WHEN length(text) > 120 THEN rtrim(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END, ' ') || '…' ELSE text END AS excerpt FROM c", "ev")
def _(s, sf):
    return view(s, sf, "ev").select("id", P.excerpt(F.col("text"), 120).alias("excerpt"))
