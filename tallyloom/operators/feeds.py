"""Pages, feeds and details as an interface shows them, and what became of the memories that were offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranking as R
from . import relational as O


def sessions_page(sessions: DataFrame, limit: int, cursor: int | None = None, project: str | None = None, agent: str | None = None, since: int | None = None) -> DataFrame:
    """Sessions (row, session_id, project, last_event_at, ...) from the newest row down, below the cursor; `next` is the next page's
    cursor, null on the last one.  limit is held within 1 and 1000."""
    limit = max(1, min(1000, limit))
    s = sessions if cursor is None else sessions.where(F.col("row") < cursor)
    s = O.filtered(s, project=project, agent=agent)
    if since is not None:
        s = s.where(F.col("last_event_at") >= since)
    page = s.orderBy(F.col("row").desc()).limit(limit + 1).withColumn("_n", F.row_number().over(W.orderBy(F.col("row").desc())))  # a page's rows
    more = F.max("_n").over(W.partitionBy()) > limit
    last = F.min(F.when(F.col("_n") <= limit, F.col("row"))).over(W.partitionBy())
    return page.withColumn("next", F.when(more, last)).where(F.col("_n") <= limit).drop("_n")


def session_details(sessions: DataFrame, events: DataFrame, memories: DataFrame) -> DataFrame:
    """sessions with their numbers of events, prompts, edited files and memories."""
    path = F.col("path") if "path" in events.columns else F.lit(None).cast("string")
    e = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "prompt").alias("prompts"), F.count_distinct(F.when(F.col("kind") == "file_edit", path)).alias("files"))
    m = memories.groupBy("session_id").agg(F.count(F.lit(1)).alias("memories"))
    return sessions.join(e, "session_id", "left").join(m, "session_id", "left").fillna(0, ["events", "prompts", "files", "memories"])


def memory_details(memories: DataFrame, evidence: DataFrame, events: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, type, title, evidence, newest, left): a memory with its evidence in order, the time of its newest piece, and how much of its
    edits is left (kept: key, left; see files.edits_kept)."""
    e = evidence.join(events.select(F.col("id").alias("event_id"), "ts"), "event_id").groupBy("id").agg(F.array_sort(F.collect_list("event_id")).alias("evidence"), F.max("ts").alias("newest"))
    rows = memories.select("id", "type", "title").join(e, "id", "left").join(kept.select(F.col("key").alias("id"), "left"), "id", "left")
    return rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))


def feed(memories: DataFrame, prompts: DataFrame, limit: int, before: int | None = None, after: int | None = None, by_project: bool = False) -> DataFrame:
    """(kind, id, at, place): the newest `limit` of both (kind, id, at), newest first; `before` includes its own time.  With `after`, the
    oldest `limit` that are newer, shown newest first, so that a reader who goes on from the newest one misses none.  Ties go by
    kind, then by id, downwards where one project is shown."""
    up = after is not None
    tie = F.col("id").desc() if by_project else F.col("id").asc()

    def side(df: DataFrame) -> DataFrame:
        if up:
            return df.where(F.col("at") > after).orderBy("at", "id").limit(limit)
        df = df if before is None else df.where(F.col("at") <= before)
        return df.orderBy(F.col("at").desc(), tie).limit(limit)

    both = side(memories).unionByName(side(prompts))
    cut = both.orderBy("at", "kind", "id").limit(limit) if up else both.orderBy(F.col("at").desc(), "kind", tie).limit(limit)
    return cut.withColumn("place", F.row_number().over(W.orderBy(F.col("at").desc(), "kind", tie)))  # `limit` rows


def summary_fields(narrative: Column, data: Column, labels: dict[str, str]) -> Column:
    """struct of fields: from structured data (JSON) where there is some, else from lines `Label: text` of the narrative."""
    own = lambda name, label: F.coalesce(F.get_json_object(data, f"$.{name}"), F.when(narrative.rlike(f"(?m)^{label}: "), F.regexp_extract(narrative, f"(?m)^{label}: (.*)$", 1)))
    return F.struct(*(own(n, l).alias(n) for n, l in labels.items()))


def topic_elsewhere(hits: DataFrame, memories: DataFrame, project: str, least: int = 3, most: int = 5) -> DataFrame:
    """(project, n): other projects with at least `least` of the matching memories (id), the richest first."""
    m = hits.select("id").distinct().join(memories.select("id", "project"), "id").where(F.col("project") != project)
    return m.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "project").limit(most)


def document_frequency_as_of(docs: DataFrame, id: str, text: str, at: str, terms: DataFrame, before: int) -> DataFrame:
    """(term, df, total): how many documents made before then have each asked term, and how many there were."""
    d = docs.where(F.col(at) < before)
    asked = terms.select("term").distinct()
    has = d.select(F.explode(F.array_distinct(R.tokens(F.col(text)))).alias("term")).join(F.broadcast(asked), "term")  # words of a stated set of questions
    df = has.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return asked.join(df, "term", "left").fillna(0, ["df"]).join(F.broadcast(total), F.lit(True))  # one row


def fetched_offers(offers: DataFrame, fetches: DataFrame, span: int = 86_400_000) -> DataFrame:
    """(offer, id) of offered memories that were fetched within a day, in the same project: offers (offer, id, project, at), fetches
    (id, project, at).

    A project is compared without its checkout (#name), as a prefix; none on either side fits any.  The next fetch of an id after
    the offer is found by one sort of the union for each kind of project, so a memory that is fetched often costs no pairs."""
    base = F.regexp_replace(F.coalesce("project", F.lit("")), "#.*$", "")
    o = offers.withColumn("_p", base)
    f = fetches.withColumn("_p", F.coalesce("project", F.lit("")))
    heads = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.substring(c, F.lit(1), i)))
    names = o.select("_p").distinct().where("_p <> ''")
    known = f.select("_p").distinct().select("_p", F.explode(heads(F.col("_p"))).alias("key")).join(names.withColumnRenamed("_p", "key"), "key")  # project names only
    some = f.join(known, "_p").select("id", "key", "at")
    blank = f.where("_p = ''").join(o.select("id", F.col("_p").alias("key")).distinct(), "id").select("id", "key", "at")
    every = f.select("id", F.lit("").alias("key"), "at")
    events = some.unionByName(blank).unionByName(every).select("id", "key", F.col("at").alias("_next"), (-F.col("at")).alias("_t"))
    rows = o.select("offer", "id", F.col("_p").alias("key"), "at", (-F.col("at") + 1).alias("_t")).withColumn("_k", F.concat_ws("\x00", "id", "key"))
    got = O.as_of(rows, events.withColumn("_k", F.concat_ws("\x00", "id", "key")), "_k", "_t", "_next", "_next")
    return got.where(F.col("_next").between(F.col("at"), F.col("at") + span)).select("offer", "id").distinct()


def cited_offers(offers: DataFrame, replies: DataFrame) -> DataFrame:
    """(offer, id) of offered memories that a later reply of the session cites as #id: offers (offer, id, session_id, at), replies
    (session_id, ts, text)."""
    c = replies.select("session_id", "ts", F.explode(X.cited_ids(F.col("text"))).alias("id")).groupBy("session_id", "id").agg(F.max("ts").alias("_last"))
    return offers.join(c, ["session_id", "id"]).where(F.col("_last") >= F.col("at")).select("offer", "id").distinct()


def uptake(offers: DataFrame, fetched: DataFrame, cited: DataFrame) -> DataFrame:
    """(source, offers, sessions, fetched, cited, since) of offers (offer, id, source, session_id, at): memories counted one by one."""
    o = offers.join(fetched.withColumn("_f", F.lit(1)), ["offer", "id"], "left").join(cited.withColumn("_c", F.lit(1)), ["offer", "id"], "left")
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("session_id").alias("sessions"), F.count("_f").alias("fetched"), F.count("_c").alias("cited"), F.min("at").alias("since"))


def others_since(events: DataFrame, viewers: DataFrame, seen: DataFrame, span_ms: int = 21_600_000, scripted: DataFrame | None = None) -> DataFrame:
    """(viewer, other, id): what other sessions of a viewer's project have done within the last `span_ms` that the viewer hasn't seen.

    viewers: (viewer, project, floor, at: its time); seen: (viewer, other, through), or (other, project, through) where all viewers of a
    project have seen the same, which needs no row for each pair.  An event counts if its id is over both the
    viewer's floor and what it has seen of that session.  Events of the main thread: replies, edits, errors, a person's prompts.
    Times are dealt into spans, so a viewer meets the events of its project in two spans, not all of them."""
    e = events.where("kind IN ('assistant', 'file_edit', 'error') OR kind = 'prompt'" + (" AND label IS NULL" if "label" in events.columns else ""))
    e = e.where("thread IS NULL") if "thread" in e.columns else e
    e = e.select(F.col("session_id").alias("other"), "project", "id", "ts", F.floor(F.col("ts") / span_ms).alias("_b"))
    e = e if scripted is None else e.join(scripted.select(F.col("session_id").alias("other")).distinct(), "other", "left_anti")
    now = F.floor(F.col("at") / span_ms)
    v = viewers.withColumn("_b", F.explode(F.array(now - 1, now)))
    met = v.join(e, ["project", "_b"]).where((F.col("other") != F.col("viewer")) & (F.col("ts") > F.col("at") - span_ms) & (F.col("ts") <= F.col("at")) & (F.col("id") > F.col("floor")))
    met = met.join(seen, ["viewer", "other"] if "viewer" in seen.columns else ["other", "project"], "left").where(F.col("id") > F.coalesce("through", F.lit(0)))
    return met.select("viewer", "other", "id")
