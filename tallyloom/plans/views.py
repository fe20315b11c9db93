"""The record's logical tables, as views over the test tables; the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import TextIndex, kept_folder, stored
from ..operators.neighbours import VectorIndex

T0 = 1_704_067_200_000  # 2024-01-01, in ms
AS_OF = T0 + 200_000 * 3_600_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


EVENTS = f"""SELECT conv_id * 100 + turn AS id, 'conv:' || CAST(conv_id AS {{s}}) AS session_id, CAST(turn AS BIGINT) AS turn,
  CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'assistant' ELSE 'compaction' END AS kind, text,
  'p' || CAST(conv_id % 5 AS {{s}}) AS project, {T0} + (conv_id * 100 + turn) * 60000 AS ts FROM conversations"""
MEMORIES = f"""SELECT doc_id AS id, source AS project, 'conv:' || CAST(doc_id % 100 AS {{s}}) AS session_id,
  CASE doc_id % 9 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' WHEN 2 THEN 'refactor' WHEN 3 THEN 'change' WHEN 4 THEN 'discovery'
    WHEN 5 THEN 'decision' WHEN 6 THEN 'security_alert' WHEN 7 THEN 'security_note' ELSE 'sensitive' END AS type,
  substr(text, 1, 80) AS title, substr(text, 81) AS narrative, text, {T0} + doc_id * 3600000 AS created_at FROM documents"""
LOGS = f"""SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'offer' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'cite' WHEN 'error' THEN 'failure' ELSE 'start' END AS what,
  user_id AS session, {{ms}} AS at_ms, value AS ms, CAST({{k}} AS BIGINT) AS memory FROM events"""

_SPARK = {"ev": EVENTS.format(s="STRING"), "mem": MEMORIES.format(s="STRING"), "logs": LOGS.format(ms="timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", k="get_json_object(props, '$.k')")}
_DUCK = {"ev": EVENTS.format(s="VARCHAR"), "mem": MEMORIES.format(s="VARCHAR"), "logs": LOGS.format(ms="(epoch_us(ts) // 1000)", k="json_extract_string(props, '$.k')")}
_BASE = {"ev": "conversations", "mem": "documents", "logs": "events"}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(_SPARK[name].replace(f"FROM {_BASE[name]}", "FROM {t}"), t=table(spark, sf, _BASE[name]))


def index_of(spark: SparkSession, sf: str, name: str) -> TextIndex:
    """The stored full-text index of documents, or of memories' titles and narratives."""

    def docs() -> tuple[DataFrame, str, list[str], str]:
        if name == "mem":
            return view(spark, sf, "mem"), "id", ["title", "narrative"], "created_at"
        return table(spark, sf, name).withColumn("at", F.lit(T0) + F.col("doc_id") * 3_600_000), "doc_id", ["text"], "at"

    return stored(spark, name, f"{sf.rstrip('/')}/{_BASE.get(name, name)}.parquet", docs)


def neighbours_of(spark: SparkSession, sf: str, vectors: DataFrame) -> VectorIndex:
    """The stored index of a table's vectors (id, v)."""
    folder = kept_folder(spark, "vectors", f"{sf.rstrip('/')}/embeddings.parquet")
    index = VectorIndex(spark, folder)
    return index if index.state else VectorIndex.build(spark, folder, vectors)


def _plain_counts(body: str) -> str:
    """count_if(x) as a count of a CASE, which is a long in DuckDB too."""
    out, at = "", 0
    while (i := body.find("count_if(", at)) >= 0:
        start, depth = i + len("count_if("), 1
        end = start
        while depth:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            end += 1
        out += body[at:i] + f"count(CASE WHEN {body[start : end - 1]} THEN 1 END)"
        at = end
    return out + body[at:]


def sql(body: str, *names: str) -> str:
    """DuckDB SQL with the views it names."""
    body = _plain_counts(body)
    if not names:
        return body
    own = ", ".join(f"{n} AS ({_DUCK[n]})" for n in names)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {own}, {body[15:]}"
    return f"WITH {own}, {body[5:]}" if body.startswith("WITH ") else f"WITH {own} {body}"
