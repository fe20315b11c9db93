"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

Each document of a source is owed target / source size copies.  Whole copies are certain; the rest r gives each document an
inclusion probability that grows with its size, p = least(r * 2 size / (size + mean size), (1 + r) / 2): a document of mean
size is in with r, a fragment with less, a long one with up to twice as much.  Documents are ranked by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first ones that fill the source's remaining words are taken once more.
u is a hash of the id and a seed, for a null id of the text's hash, so reruns agree.

The ranks of a source are never sorted in one task: sums over two levels of rank buckets find the one small bucket that
holds the cut, and only its rows are ordered.

Null texts have size 0.  A null source is a source of its own, the last one.  Documents without words take nothing.
Repeated rows share a rank; ties are ordered by size and text hash, and equal rows are interchangeable.  A table without
words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, small, stash, table

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat over sources by code point, null last.

    The share of a capped source is dealt again by weight until none is above its cap.  With sources ordered by cap over
    weight, the capped ones are a prefix, so running sums give the result at once.  One row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    given = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    given = given.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = by.rowsBetween(W.unboundedPreceding, -1)
    given = given.withColumns({
        "left": F.lit(float(total)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    given = given.withColumn("level", F.when(F.col("cap") * F.col("open") >= F.col("w") * F.col("left"), F.col("left") / F.col("open")))
    given = given.withColumn("level", F.max("level").over(every))  # of the first that is not capped; later ones are lower
    kept = [c for c in sizes.columns if c not in ("source", "source_size")]
    return given.select("source", "source_size", *kept, F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def draw(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds `copies` to rows (id, source, size, tie, source_size, n_docs, target): how often the mix takes each."""
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.col("tie").cast("string")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = rows.withColumns({"whole": F.floor(owed + 1e-9), "u": u})
    left, mean = F.greatest(owed - F.col("whole"), F.lit(0.0)), F.col("source_size") / F.col("n_docs")
    p = F.least(left * 2 * F.col("size") / (F.col("size") + mean), 0.5 + left / 2)
    rows = rows.withColumn("p", F.when((left > 1e-9) & (F.col("size") > 0), p).otherwise(0.0))
    odds = F.col("u") / (1 - F.col("u"))
    rank = F.when(F.col("p") > 0, odds * (1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("rank", rank).withColumn("place", F.col("rank") / (1 + F.col("rank")))
    rows = rows.withColumn("b1", F.floor(F.col("place") * BUCKETS).cast("int"))
    rows = rows.withColumn("b2", F.floor((F.col("place") * BUCKETS - F.col("b1")) * BUCKETS).cast("int"))

    def cut(level: DataFrame, keys: list[str], bucket: str, need: str) -> DataFrame:
        """The bucket in which the running sum reaches what is needed, and what is needed inside it."""
        run = F.coalesce(F.sum("s").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return level.withColumn("run", run).where((F.col("run") < F.col(need)) & (F.col("run") + F.col("s") >= F.col(need))).withColumn("inside", F.col(need) - F.col("run"))

    # a source may be null; its hash is not, and the id of a source for joins and windows
    rows = rows.withColumn("sid", F.coalesce(F.sha2("source", 256), F.lit("")))
    need = F.max(F.col("target") - F.col("whole") * F.col("source_size")).alias("need")
    ranked = rows.where("rank IS NOT NULL")
    sums = stash(ranked.groupBy("sid", "b1", "b2").agg(F.sum("size").alias("s"), need), "mix-sums")
    first = cut(sums.groupBy("sid", "b1").agg(F.sum("s").alias("s"), F.max("need").alias("need")), ["sid"], "b1", "need")
    first = first.select("sid", F.col("b1").alias("c1"), F.col("inside").alias("need1"))
    second = cut(sums.join(first, "sid").where("b1 = c1"), ["sid"], "b2", "need1")
    cuts = small(stash(second.select("sid", "c1", F.col("b2").alias("c2"), F.col("inside").alias("need2")), "mix-cuts"))
    rows = rows.join(cuts, "sid", "left")
    here = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    edge = rows.where(here).withColumn("key", F.struct("rank", "id", "size", "tie"))
    run = F.sum("size").over(W.partitionBy("sid").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    edge = edge.withColumn("run", F.coalesce(run, F.lit(0)))
    # the row at the cut is taken if that brings the source nearer to its target
    edge = edge.withColumn("more", (F.col("run") + F.col("size") / 2.0 < F.col("need2")).cast("int")).drop("key", "run")
    below = (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2")))
    rest = rows.where(~F.coalesce(here, F.lit(False))).withColumn("more", F.coalesce(below, F.lit(False)).cast("int"))
    both = edge.unionByName(rest)
    return both.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0).cast("int")).drop("rank", "place", "b1", "b2", "c1", "c2", "need2", "sid", "more", "u", "p", "whole", "n_docs")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, tie, source_size, target, copies) for every row of docs; tie is the hash of the text."""
    rows = stash(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    targets = small(stash(source_targets(sizes), "mix-targets")).withColumnRenamed("source", "s")
    return draw(rows.join(targets, rows.source.eqNullSafe(targets.s), "left").drop("s"))


def take(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, with all their columns, that the mix takes, and `copies` (1 or more; a column of that name is replaced).

    Rows with the same id and text get the same number of copies."""
    drawn = mix(docs, id, text, source).where("copies > 0").groupBy(F.xxhash64("id").alias("__mix_1"), F.col("tie").alias("__mix_2")).agg(F.max("copies").alias("__mix_n"))
    rows = docs.withColumns({"__mix_1": F.xxhash64(id), "__mix_2": F.xxhash64(text)}).join(stash(drawn, "mix-drawn"), ["__mix_1", "__mix_2"])
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != "copies"), F.col("__mix_n").alias("copies"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(CASE WHEN size > 0 THEN 1 END) AS n_docs, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source
), c AS (
  SELECT *, {MOST}::DOUBLE * source_size AS cap,
    {TOTAL}::DOUBLE * sum(source_size) OVER () - coalesce(sum({MOST}::DOUBLE * source_size) OVER (ORDER BY {MOST}::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY {MOST}::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM s
), l AS (SELECT max(rest / o) FILTER (WHERE cap * o >= w * rest) AS level FROM c
), t AS (
  SELECT source, source_size, n_docs, least(cap, coalesce(w * level, cap)) AS target FROM c, l
), r AS (
  SELECT d.*, source_size, n_docs, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS owed,
    (('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CASE WHEN rest > 1e-9 AND size > 0 THEN least(rest * 2 * size / (size + source_size::DOUBLE / n_docs), 0.5::DOUBLE + rest / 2) END AS p
  FROM (SELECT *, floor(owed + 1e-9) AS whole, greatest(owed - floor(owed + 1e-9), 0) AS rest FROM r)
), k AS (
  SELECT *, u / (1 - u) * (1 - p) / p AS rank FROM p
), x AS (
  SELECT *, coalesce(sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
    target - whole * source_size AS need
  FROM k
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (size * (whole + CASE WHEN rank IS NOT NULL AND run + size / 2.0::DOUBLE < need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""

QUERIES = {"op4_mix_sources": (op4_mix_sources, OP4_SQL)}
