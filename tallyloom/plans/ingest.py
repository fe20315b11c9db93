"""Transcript parsing over lines made from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import transcripts
from .views import table

_AT = "2024-01-01T00:00:00Z"


def _lines(s, sf):
    """Each turn as a transcript line of one agent's shape."""
    c = table(s, sf, "conversations")
    payload = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.lit(_AT).alias("timestamp"), (F.col("role") == "system").alias("isMeta"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return c.select(F.concat(F.lit("/home/.claude/x/"), "conv_id", F.lit(".jsonl")).alias("source_path"), F.col("turn").cast("int").alias("line_no"), payload.alias("line"))


def transcript_events(s, sf):
    return transcripts.claude(_lines(s, sf)).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


EVENTS = "SELECT 'claude:' || conv_id AS session_id, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'prompt' END AS kind, count(*) AS n, sum(turn)::BIGINT AS lines FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY ALL"


def quarantined(s, sf):
    bad = _lines(s, sf).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.substring("line", 1, 40)).otherwise(F.col("line")))
    return transcripts.quarantine(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


BAD = "SELECT 'not a JSON object' AS reason, count(*) AS n FROM conversations WHERE turn % 3 = 0"

QUERIES = {"transcript_events": (transcript_events, EVENTS), "transcript_quarantine": (quarantined, BAD)}
