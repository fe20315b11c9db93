"""Filters, joins, aggregations, ordered operators, paging, sets and life cycles over sessions, events and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- filters


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Predicates only for parameters that are given: project (substring), agent (prefix of the session id), start and end (ms)."""
    if wanted.get("project") is not None:
        df = df.where(F.col("project").ilike(f"%{wanted['project']}%"))
    if wanted.get("agent") is not None:
        df = df.where(F.col("session_id").startswith(f"{wanted['agent']}:"))
    if wanted.get("start") is not None:
        df = df.where(F.col("ts") >= wanted["start"])
    if wanted.get("end") is not None:
        df = df.where(F.col("ts") < wanted["end"] + 86_400_000)
    return df


def in_project(df: DataFrame, project: str) -> DataFrame:
    """The project and its checkouts (project#name)."""
    return df.where((F.col("project") == project) | F.col("project").startswith(project + "#"))


def without_sensitive(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(F.coalesce("type", F.lit("")) != "sensitive")


#: Words that give a reason (anywhere in the text), and words of assent.
REASONS = ("because", "since", "so that", "so we", "karena", "supaya", "biar", "to avoid", "reason", "why")
ASSENT = ("ok", "okay", "yes", "yep", "sure", "go", "ahead", "do", "it", "let's", "lets", "with", "option", "please", "that", "use", "pick", "agree", "approved", "approve", "ya", "lanjut")


def go_ahead(text: Column) -> Column:
    """A short assent or choice, by letter or number, that gives no reason of its own and has at most two other words."""
    low = F.lower(F.trim(text))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}']+"), lambda w: w != "")
    reason = F.lit(False)
    for r in REASONS:
        reason = reason | low.contains(r)
    rest = F.filter(words, lambda w: ~w.isin(*ASSENT) & ~w.rlike("^[a-z0-9]$"))
    return (F.length(low) <= 60) & ~low.contains("?") & ~reason & (F.size(words) > 0) & (F.size(rest) <= 2)


# ---- joins


def last_reply(prompts: DataFrame, replies: DataFrame, least: int = 40) -> DataFrame:
    """Each prompt with the last reply after it in its session and turn group (`g`), of at least `least` characters."""
    r = replies.where(F.length("text") >= least).select("session_id", "g", F.col("id").alias("reply_id"))
    return prompts.join(r, ["session_id", "g"]).where("reply_id > id").groupBy("session_id", "id").agg(F.max("reply_id").alias("reply_id"))


def as_of(rows: DataFrame, events: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Each row with the latest earlier event's value of its key: one sort of the union, no range join."""
    both = rows.withColumn("_v", F.lit(None).cast(events.schema[value].dataType)).withColumn("_r", F.lit(1)).unionByName(events.select(key, order, F.col(value).alias("_v")).withColumn("_r", F.lit(0)), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy(key).orderBy(order, F.col("_r").desc()).rowsBetween(W.unboundedPreceding, -1))
    return both.withColumn(name, seen).where("_r = 1").drop("_v", "_r")


def count_before(rows: DataFrame, events: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Number of events of the key strictly before each row."""
    both = rows.withColumn("_e", F.lit(0)).unionByName(events.select(key, at).withColumn("_e", F.lit(1)), allowMissingColumns=True)
    n = F.coalesce(F.sum("_e").over(W.partitionBy(key).orderBy(at).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return both.withColumn(name, n).where("_e = 0").drop("_e")


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, then: str, span: int) -> DataFrame:
    """Left rows with a right row of the same keys at [at, at + span]: an equi-join with a residual range, kept as a semi-join."""
    r = right.select(*keys, F.col(then).alias("_then")).alias("r")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("r._then").between(F.col(f"l.{at}"), F.col(f"l.{at}") + span)]
    return left.alias("l").join(r, cond, "left_semi")


# ---- aggregates


def last_by(df: DataFrame, keys: list[str], order: str, **values: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(k) for k, v in values.items()))


# ---- ordered operators


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, start, end, n): runs of consecutive numbers."""
    g = df.select(*keys, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    return g.groupBy(*keys, "_g").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def fill_between(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """A null takes the value that both of its nearest neighbours have, within a run of consecutive places."""
    df = df.withColumn("_g", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    w = W.partitionBy(*keys, "_g").orderBy(at)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(value, F.when(before == after, before))).drop("_g")


def collapse_repeats(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Drops a row whose value equals the one just before."""
    return df.withColumn("_b", F.lag(value).over(W.partitionBy(*keys).orderBy(order))).where(~F.col(value).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def budget_prefix(df: DataFrame, keys: list[str], order: str, text: str, most: int) -> DataFrame:
    """Rows in order until the next would pass the budget of bytes."""
    used = F.sum(F.octet_length(text)).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("used", used).where(F.col("used") <= most)


def capped(df: DataFrame, order: list, caps: list[tuple[str, int]]) -> DataFrame:
    """Running caps per key, one after the other."""
    for key, most in caps:
        df = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return df


# ---- paging and sampling


def page_after(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """Rows after a key, and `next`: the last one's key if there are more."""
    got = df.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    numbered = got.withColumn("_n", F.row_number().over(W.orderBy(key)))  # limit + 1 rows
    more = F.max("_n").over(W.partitionBy()) > limit
    last = F.max(F.when(F.col("_n") == limit, F.col(key))).over(W.partitionBy())
    return numbered.withColumn("next", F.when(more, last)).where(F.col("_n") <= limit).drop("_n")


def sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of a hash; reruns agree."""
    return df.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def hash_half(key: Column) -> Column:
    """dev or test by the parity of the last hex digit of the first 8 bytes of SHA-256."""
    return F.when(F.substring(F.sha2(F.trim(key), 256), 16, 1).isin(*"02468ace"), F.lit("dev")).otherwise(F.lit("test"))


def fair_share(sizes: DataFrame, total: int) -> DataFrame:
    """(g, n, take): at most `total` over all groups, smallest first, each up to an equal share of what is left.

    Group sizes are few: they are brought to the driver, the rows aren't."""
    left, out = total, []
    rows = sorted(((r["n"], r["g"]) for r in sizes.collect()))
    for i, (n, g) in enumerate(rows):
        take = min(n, left // (len(rows) - i))
        left -= take
        out.append((g, n, take))
    return sizes.sparkSession.createDataFrame(out, f"g {sizes.schema['g'].dataType.simpleString()}, n long, take long")


def spread(df: DataFrame, tier: str, order: list[str], room: int) -> DataFrame:
    """The lowest tiers whole; of the tier that doesn't fit, rows floor(i * len / left) for i below what is left."""
    sizes = df.groupBy(tier).agg(F.count(F.lit(1)).alias("_len"))
    run = sizes.withColumn("_left", F.lit(room) - F.coalesce(F.sum("_len").over(W.orderBy(tier).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = df.withColumn("_r", F.row_number().over(W.partitionBy(tier).orderBy(*order)) - 1).join(F.broadcast(run), tier)
    i = F.ceil(F.col("_r") * F.col("_left") / F.col("_len"))
    chosen = (F.col("_left") >= F.col("_len")) | ((F.col("_left") > 0) & (i < F.col("_left")) & (F.floor(i * F.col("_len") / F.col("_left")) == F.col("_r")))
    return rows.where(chosen).drop("_r", "_len", "_left")


# ---- sets and life cycles


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known values of the new row first; started_at the least, last_event_at the greatest."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    rest = [c for c in old.columns if c not in ("id", "started_at", "last_event_at")]
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(pick("id"), *map(pick, rest), F.least("a.started_at", "b.started_at").alias("started_at"), F.greatest("a.last_event_at", "b.last_event_at").alias("last_event_at"))


def upsert_changes(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change) of the new rows: added, changed or same; nulls are equal."""
    a, b = old.select(key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_old")), new
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return b.join(a, key, "left").select(key, F.when(F.col("_old").isNull(), "added").when(same, "same").otherwise("changed").alias("change"))


def forget(df: DataFrame, tombstones: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows that no tombstone (kind, key) names."""
    dead = tombstones.where(F.col("kind") == kind).select(F.col("key").alias("_dead"))
    return df.join(dead, F.col(key).cast("string") == F.col("_dead"), "left_anti")


def export_lines(**tables: DataFrame) -> DataFrame:
    """One JSON object per row, tagged with its record kind."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("record"), F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def manifest(**tables: DataFrame) -> DataFrame:
    """(name, n, check): row counts and an order-free checksum of each table of a snapshot."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("check")).select(F.lit(name).alias("name"), "n", "check")
        out = part if out is None else out.unionByName(part)
    return out
