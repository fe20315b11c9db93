"""Recall of memories for prompts, search over memories and events, and what surrounds a hit.

A set of questions is answered at once; every operator takes (q, ...) tables and ranks per question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranking as R
from . import relational as O
from .index import TextIndex, bounded, cut


@dataclass(frozen=True)
class Limits:
    """What counts as close, by the model that made the vectors; top: memories shown; rare: the share of memories that a word
    of a prompt must be below; weights of title, narrative and facts."""

    relevance: float = 0.45
    fill: float = 0.55
    search: float = 0.35
    top: int = 5
    rare: float = 0.10
    budget: int = 600
    opening: int = 48


#: Measured thresholds of the two models that vectors may come from.
MODELS = {"potion": Limits(), "minilm": Limits(relevance=0.30, fill=0.50)}


def limits(model: str, **own) -> Limits:
    """The model's limits, those given replaced; an unknown name has the first model's."""
    base = next((v for k, v in MODELS.items() if k in model.lower()), MODELS["potion"])
    return Limits(**{**base.__dict__, **{k: v for k, v in own.items() if v is not None}})


def every_phrase(text: Column, query: str) -> Column:
    """Whether a text has each blank-separated part of a query, a part of several words as a phrase; no parts: no match."""
    import re

    said = F.concat(F.lit(" "), F.array_join(R.tokens(text), " "), F.lit(" "))
    out = None
    for part in query.split():
        words = re.findall(r"[^\W_]+", part.lower())
        if words:
            hit = said.contains(f" {' '.join(words)} ")
            out = hit if out is None else out & hit
    return F.lit(False) if out is None else out


#: Words of questions that name a time and no topic.
TIME_WORDS = ("week", "month", "last", "since", "minggu", "bulan", "lalu", "hari", "today", "yesterday", "kemarin")


def topic_terms(text: Column, stop_words: tuple[str, ...], most: int = 12) -> Column:
    """recall_terms without words of time and names of months."""
    from ..functions.when import MONTHS

    months = [m for names in MONTHS for m in names]
    return F.filter(R.recall_terms(text, stop_words, most), lambda w: ~w.isin(*TIME_WORDS) & ~F.exists(F.array(*map(F.lit, months)), lambda m: m.startswith(w)))


def asked_terms(prompts: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """(q, term) of prompts (q, text, label?) that carry a question: at least four words and two terms, not written by a harness."""
    if "label" in prompts.columns:
        prompts = prompts.where("label IS NULL")
    long = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 4
    t = prompts.where(long).select("q", R.recall_terms(F.col("text"), stop_words).alias("terms")).where(F.size("terms") >= 2)
    return t.select("q", F.explode("terms").alias("term"))


def in_scope(memories: DataFrame, seen: DataFrame | None = None, session: str | None = None, before: int | None = None, scripted: DataFrame | None = None) -> DataFrame:
    """Memories that may be offered unasked: not pinned, not sensitive, not seen, not the session's own, made before, not scripted."""
    m = O.without_sensitive(memories)
    if "kind" in m.columns:
        m = m.where("kind <> 'pinned'")
    if session is not None:
        m = m.where(F.coalesce("session_id", F.lit("")) != session)
    if before is not None:
        m = m.where(F.coalesce("created_at", F.lit(0)) < before)
    if seen is not None:
        m = m.join(seen.select("id").distinct(), "id", "left_anti")
    return m if scripted is None else m.join(scripted.select("session_id").distinct(), "session_id", "left_anti")


def keyword_rank(memories: DataFrame, scope: DataFrame, prompts: DataFrame, stop_words: tuple[str, ...], limit: int, now: int, weights: dict[str, float], rare: float = 0.10, before: int | None = None, index: TextIndex | None = None) -> DataFrame:
    """(q, id, rank): the memories in scope that match a prompt best.

    A prompt needs a term that under `rare` of all memories have (as of `before`); a memory needs two of its terms as
    substrings.  Order is by BM25 with column weights, less a point for each 300 days of age.  index: a stored index of all
    memories' columns (their times with it); it saves reading the texts, but for what is shown, and knows no `before`."""
    if index is not None and before is None:
        terms = cut(asked_terms(prompts, stop_words))
        df = cut(index.frequencies(terms))
        rare_ones = terms.join(df, "term", "left").where(F.coalesce("df", F.lit(0)) < F.lit(rare * max(index.size()[0], 1)))
        open_ = cut(terms.join(rare_ones.select("q").distinct(), "q", "left_semi"))
        best = cut(index.top(open_, limit * 4, age=(now, 2.592e10), weights=weights, within=scope.select("id"), df=df))
    else:
        known = memories if before is None else memories.where(F.coalesce("created_at", F.lit(0)) < before)
        terms = cut(asked_terms(prompts, stop_words))
        n, mean, df = R.statistics(known, "id", weights, terms)
        few = [t for t, d in df.items() if d < rare * max(n, 1)]
        asks = terms.where(F.col("term").isin(few) if few else F.lit(False)).select("q").distinct()
        open_ = terms.join(asks, "q", "left_semi")
        age = (F.lit(now) - F.col("created_at")) / F.lit(2.592e10)
        best = R.top_scores(scope, "id", weights, open_, limit * 4, age=age, known=(n, mean, df))
    body = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in weights)))
    # the best are in scope; they meet the texts where these are read, and no text is shuffled
    told = bounded(best.withColumnRenamed("doc", "id").join(open_.groupBy("q").agg(F.collect_list("term").alias("terms")), "q")).join(memories.select("id", body.alias("body")), "id")
    two = F.size(F.filter("terms", lambda t: F.contains(F.col("body"), t))) >= 2
    told = cut(told.where(two).select("q", "id", "rank"))  # a report reads it more than once
    kept = told.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("rank"))).where(F.col("n") <= limit)
    return kept.select("q", "id", F.col("n").alias("rank"))


def shown(ranked: DataFrame, memories: DataFrame, now: int, limit: Limits = MODELS["potion"]) -> DataFrame:
    """(q, id, n, line): lines for a prompt, near-equal openings once, until the budget of bytes would be passed."""
    line = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.col("type"), F.lit(" · "), X.ago_in_hours(F.lit(now) - F.col("created_at")), F.lit(" ago · "), X.head(F.col("title"), 110), F.lit("\n"))
    rows = ranked.where(F.col("rank") <= limit.top).join(memories.select("id", "type", "title", "created_at"), "id").withColumn("line", line).withColumn("opening", F.substring(F.lower("title"), 1, limit.opening))
    first = O.first_per_key(rows, ["q", "opening"], "rank")
    return O.budget_prefix(first, ["q"], "rank", "line", limit.budget).select("q", "id", F.row_number().over(W.partitionBy("q").orderBy("rank")).alias("n"), "line")


def search(every: DataFrame, some: DataFrame, meaning: DataFrame, limit: Limits = MODELS["potion"], pool: int = 1000, weight: float = 0.2) -> DataFrame:
    """(q, id, label, rank): matches of every word, then of some words if not known to be far in meaning, fused with close ones.

    every, some: (q, id, rank); meaning: (q, id, cosine, rank).  label: words, meaning or both."""
    cos = meaning.select("q", "id", "cosine")
    more = some.join(every.select("q", "id"), ["q", "id"], "left_anti").join(cos, ["q", "id"], "left").where(F.coalesce(F.col("cosine") >= limit.search, F.lit(True)))
    both = every.select("q", "id", F.lit(0).alias("part"), "rank").unionByName(more.select("q", "id", F.lit(1).alias("part"), "rank"))
    words = both.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("part", "rank"))).where(F.col("rank") <= pool).select("q", "id", "rank")
    close = meaning.where(F.col("cosine") >= limit.fill).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("cosine").desc(), "id"))).select("q", "id", "rank")
    out = R.fuse((words, 1.0), (close, weight))
    out = out.join(words.select("q", "id", F.lit(True).alias("w")), ["q", "id"], "left").join(close.select("q", "id", F.lit(True).alias("m")), ["q", "id"], "left")
    label = F.when(F.col("w") & F.col("m"), "both").when(F.col("w"), "words").otherwise("meaning")
    return out.select("q", "id", label.alias("label"), "rank")


def search_events(events: DataFrame, terms: DataFrame, k: int, now: int, kinds: tuple[str, ...] = (), project: str | None = None, order: str = "relevance", main_only: bool = True) -> DataFrame:
    """(q, id, rank): events by words, of some kinds, of the main thread and not made by a harness; by relevance or by date."""
    if kinds:
        events = events.where(F.col("kind").isin(*kinds))
    if main_only and "thread" in events.columns:
        events = events.where("thread IS NULL")
    if "label" in events.columns:
        events = events.where("label IS NULL OR kind <> 'prompt'")
    if project is not None:
        events = O.filtered(events, project=project)
    if order == "relevance":
        age = (F.lit(now) - F.col("ts")) / F.lit(2.592e9)
        return R.top_scores(events, "id", "text", terms, k, age=age).select("q", F.col("doc").alias("id"), "rank")
    asked = terms.select("q", "term").distinct()
    need = asked.groupBy("q").agg(F.count(F.lit(1)).alias("need"))
    words = events.select("id", "ts", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    hits = words.join(asked, "term").groupBy("q", "id", "ts").agg(F.count(F.lit(1)).alias("n")).join(need, "q").where("n = need")
    rows = hits.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("ts").desc(), "id")))
    return rows.where(F.col("rank") <= k).select("q", "id", "rank")


def merged_hits(memories: DataFrame, events: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """(q, kind, id, place): one list of both, memories first by relevance, or all by time; a page of it.

    memories, events: (q, id, rank, at)."""
    both = memories.select("q", F.lit("memory").alias("kind"), "id", "rank", "at").unionByName(events.select("q", F.lit("event").alias("kind"), "id", "rank", "at"))
    by = [F.col("kind").desc(), F.col("rank")] if order == "relevance" else [F.col("at").desc(), F.col("kind").desc(), F.col("id")]
    rows = both.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*by)))
    return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("q", "kind", "id", "place")


def around(rows: DataFrame, anchors: DataFrame, keys: list[str], order: list[str], depth: int = 3, keep: Column | None = None) -> DataFrame:
    """(anchor, id, place): anchors and their neighbours in the order of a group, -depth to depth, the anchor at 0.

    Only neighbours for which `keep` holds have places; an anchor always has one.  depth is held within 0 and 50."""
    depth = max(0, min(50, depth))
    rows = rows.withColumn("_k", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).join(anchors.select("id", F.lit(True).alias("_a")), "id", "left").where("_k OR _a")
    w = W.partitionBy(*keys).orderBy(*order)
    # the anchor's own place among the rows that count: those before it, whether or not it counts itself
    rows = rows.withColumn("_n", F.coalesce(F.sum(F.col("_k").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    a = rows.where("_a").select(*keys, F.col("id").alias("anchor"), F.col("_n").alias("_at"), F.col("_k").cast("int").alias("_own"))
    near = rows.where("_k").join(a, keys).where((F.col("_n") >= F.col("_at") - depth) & (F.col("_n") < F.col("_at") + F.col("_own") + depth))
    near = near.where("id <> anchor").select("anchor", "id", F.when(F.col("_n") < F.col("_at"), F.col("_n") - F.col("_at")).otherwise(F.col("_n") - F.col("_at") - F.col("_own") + 1).alias("place"))
    return near.unionByName(a.select("anchor", F.col("anchor").alias("id"), F.lit(0).cast("long").alias("place")))


def snippets(rows: DataFrame, id: str, text: str, hits: DataFrame, terms: DataFrame, width: int = 16) -> DataFrame:
    """(q, id, snippet) of hits (q, id): `width` words from the first match on, matches in brackets, cuts as ellipses."""
    words = terms.groupBy("q").agg(F.collect_set("term").alias("terms"))
    got = hits.select("q", "id").join(rows.select(F.col(id).alias("id"), F.split(F.trim(text), r"\s+").alias("w")), "id").join(words, "q")
    marked = F.transform("w", lambda w: F.arrays_overlap(R.tokens(w), F.col("terms")))
    first = F.greatest(F.array_position(marked, F.lit(True)).cast("int"), F.lit(1))
    got = got.withColumn("first", first)
    cut = F.transform(F.slice("w", F.col("first"), F.lit(width)), lambda w: F.when(F.arrays_overlap(R.tokens(w), F.col("terms")), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return got.select("q", "id", F.concat(F.when(F.col("first") > 1, "…").otherwise(""), F.array_join(cut, " "), F.when(F.size("w") >= F.col("first") + width, "…").otherwise("")).alias("snippet"))


def vector_text(title: Column, subtitle: Column, narrative: Column, facts: Column) -> Column:
    """What a memory's vector is made of: title, subtitle, the head of the narrative, facts."""
    return F.concat_ws(" ", F.concat_ws(". ", title, F.when(subtitle != "", subtitle), X.head(narrative, 1200)), F.array_join(facts, " "))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A stand-in for a model where there is none: signed counts of hashed words, of length 1 (a text without words: zeros).

    Any column of vectors can take its place; see vectors.py for what is done with them."""
    places = F.transform(R.tokens(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(places, lambda p: p["i"] == k), F.lit(0.0), lambda a, p: a + p["s"]))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(norm, dim).alias("n")), lambda z: F.when(z["n"] > 0, z["v"] / z["n"]).otherwise(0.0))


def cosines(queries: DataFrame, ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, id, cosine) for given pairs (q, id): only vectors of the query's model and size.  queries: (q, v, model); vectors: (id, v, model)."""
    from .vectors import dot

    v = vectors.select("id", F.col("v").alias("_v"), F.col("model").alias("_m"))
    rows = ids.select("q", "id").join(v, "id").join(queries, "q").where((F.col("model") == F.col("_m")) & (F.size("v") == F.size("_v")))
    return rows.select("q", "id", F.round(dot(F.col("v"), F.col("_v")), 6).alias("cosine"))


def usable_vectors(given: DataFrame, memories: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors (id, model, dim, scale, q, text_hash) that can be taken in: of the model and size, a finite scale above 0, made of the
    memory's present text.  Vectors of other models go."""
    ok = (F.col("model") == model) & (F.col("dim") == dim) & (F.size("q") == dim) & (F.col("scale") > 0) & (F.col("scale") < float("inf")) & ~F.isnan("scale")
    return given.where(ok).join(memories.select("id", "text_hash"), ["id", "text_hash"], "left_semi")


def rescored(hits: DataFrame, scores: Column) -> DataFrame:
    """hits (q, id, rank, ...) in the order of a cross-encoder's scores through a sigmoid; ties keep their order."""
    s = hits.withColumn("score", F.round(1 / (1 + F.exp(-scores)), 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "rank", "id")))


def trial_top(session: Column, trial: int | None, top: int = 5) -> Column:
    """How many memories a session is shown: the trial's number for sessions of its half, at most `top`."""
    arm = F.conv(F.substring(F.sha2(session, 256), 2, 1), 16, 10).cast("int") % 2 == 1
    return F.lit(top) if trial is None else F.when(arm, F.lit(max(1, min(top, trial)))).otherwise(F.lit(top))


def ranked_feed(memories: DataFrame, prompts: DataFrame, offset: int, limit: int) -> DataFrame:
    """(kind, id, place): memories (id, rank) in order, then prompts (id, ts), newest first; a page that may span both."""
    a = memories.select(F.lit("memory").alias("kind"), "id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("by"))
    b = prompts.select(F.lit("prompt").alias("kind"), "id", F.lit(1).alias("part"), (-F.col("ts")).alias("by"))
    page = a.unionByName(b).orderBy("part", "by", "id").limit(offset + limit)
    return page.withColumn("place", F.row_number().over(W.orderBy("part", "by", "id"))).where(F.col("place") > offset).select("kind", "id", "place")  # a page's rows



def typed_id(text: Column) -> Column:
    """struct(kind, id) of a name like 12, #12 or E12: a memory or an event; null for other texts."""
    plain = F.regexp_replace(F.trim(text), "^#+", "")
    number = F.regexp_extract(plain, r"^[Ee]?([+-]?[0-9]{1,19})$", 1).try_cast("long")
    return F.when(number.isNotNull(), F.struct(F.when(plain.rlike("^[Ee]"), "event").otherwise("memory").alias("kind"), number.alias("id")))


def looked_up(keys: DataFrame, memories: DataFrame, events: DataFrame) -> DataFrame:
    """keys (key, ...) with kind (memory, event, or null for what is no id), id, and found: whether there is such a one."""
    k = keys.withColumn("_t", typed_id(F.col("key"))).withColumns({"kind": F.col("_t.kind"), "id": F.col("_t.id")}).drop("_t")
    there = memories.select(F.lit("memory").alias("kind"), "id").unionByName(events.select(F.lit("event").alias("kind"), "id")).distinct().withColumn("_f", F.lit(True))
    return k.join(there, ["kind", "id"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def passage_gate(sources: DataFrame, query: DataFrame, least: float) -> DataFrame:
    """(q, id, best): sources (id, passages: array of vectors) of which any passage is as close to the query (q, v) as `least`; the
    queries are a stated set, so each source meets each of them once, in blocks and by products of matrices."""
    from . import vectors as V

    out = None
    for block in V.in_blocks(query.select("q", F.col("v").alias("qv"))):
        best = V.close_passages(sources, block, least).groupBy("q", "id").agg(F.round(F.max("c"), 6).alias("best"))
        out = best if out is None else out.unionByName(best)
    return out.where(F.col("best") >= least)
