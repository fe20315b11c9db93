"""Nearest neighbours from the stored index against brute force, and how many blocks are read."""

import random

import pytest

from tallyloom.operators import neighbours as N
from tallyloom.operators import vectors as V


def unit(x):
    n = sum(a * a for a in x) ** 0.5
    return [a / n for a in x]


@pytest.mark.parametrize(("spread", "size"), [(0.05, 6), (1.0, 6), (0.3, 24)])
def test_as_brute_force(spark, tmp_path, monkeypatch, spread, size):
    rnd = random.Random(5)
    centres = [unit([rnd.gauss(0, 1) for _ in range(size)]) for _ in range(12)]
    rows = [(i, unit([c + rnd.gauss(0, spread) for c in centres[i % 12]])) for i in range(900)] + [(2000 + i, centres[0]) for i in range(9)]  # ties, too
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    monkeypatch.setattr(N, "QUERIES", 8)
    index = N.VectorIndex.build(spark, str(tmp_path), v, block=15, pivots=30)
    asked = v.where("id % 40 = 0").selectExpr("concat('q', id) AS q", "v")
    want = sorted(map(tuple, V.nearest(v, asked, 7).select("q", "id", "cosine", "rank").collect()))
    assert sorted(map(tuple, index.find(v, asked, 7).select("q", "id", "cosine", "rank").collect())) == want
    read, every = sum(x.count() for x in index.tried), index.blocks().count() * asked.count()
    assert read < every / 3 or spread > 0.1


def test_small_tables(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    index = N.VectorIndex.build(spark, f"{tmp_path}/a", v)
    asked = v.selectExpr("id AS q", "v")
    assert index.find(v, asked, 5).count() == 4 and index.find(v, asked.limit(0), 5).count() == 0
    none = N.VectorIndex.build(spark, f"{tmp_path}/b", v.limit(0))
    assert none.find(v.limit(0), asked, 3).count() == 0


def plain(v, q, k):
    """nearest by the plain join."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    pairs = v.join(q.withColumnRenamed("v", "qv"), F.size("v") == F.size("qv")).select("q", "id", F.round(V.dot(F.col("qv"), F.col("v")), 6).alias("cosine"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("cosine").desc(), "id"))).where(F.col("rank") <= k)


def table_of(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_odd_vectors_and_copies(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, unit([rnd.gauss(0, 1) for _ in range(5)])) for i in range(300)] + [(1000 + i, unit([1.0, 2.0, 3.0, 4.0, 5.0])) for i in range(200)]
    rows += [(2000, [0.0] * 5), (2001, [1.0, 0.0]), (2002, None), (2003, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (2004, [0.6, 0.8]), (2005, []), (-1, unit([1.0, 2, 3, 4, 5.000001]))]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = v.where("id % 7 = 0 OR id >= 2000").selectExpr("concat('q', id) AS q", "v")
    for slab, rows_ in ((2048, 1024), (16, 4)):
        monkeypatch.setattr(V, "SLAB", slab), monkeypatch.setattr(V, "ROWS", rows_)
        for k in (1, 6, 400):
            assert table_of(V.nearest(v, q, k)) == table_of(plain(v, q, k))


def test_tasks_give_the_best_only(spark):
    rows = [(i, unit([1.0, (i % 50) / 50, 0.5])) for i in range(3000)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    asked = v.where("id % 50 = 0").selectExpr("id AS q", "v AS qv")
    assert V.close(v, asked, 5).count() <= 2 * 5 * 60  # 180,000 pairs, of which a task keeps the best


def test_labels_and_passages(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import recall as C

    rnd = random.Random(3)
    v = spark.createDataFrame([(i, i % 4 if i % 9 else None, unit([rnd.gauss(0, 1) for _ in range(4)]) if i % 11 else [0.0] * 4) for i in range(80)], "id long, label int, v array<double>").repartition(3)
    q = v.where("id % 5 = 0").withColumnRenamed("id", "q")
    x = v.join(q.select("q", F.col("label").alias("ql"), F.col("v").alias("qv")), F.col("id") != F.col("q")).select("q", (F.col("label") == F.col("ql")).alias("own"), F.round(V.dot(F.col("qv"), F.col("v")), 6).alias("c"))
    assert table_of(V.nearest_by_label(v, q)) == table_of(x.groupBy("q", "own").agg(F.max("c").alias("cosine")))
    s = v.groupBy((F.col("id") % 30).alias("id")).agg(F.collect_list("v").alias("passages")).union(spark.createDataFrame([(90, []), (91, None)], "id long, passages array<array<double>>"))
    for least in (0.3, 0.0, -1.0):
        p = s.select("id", F.explode("passages").alias("p")).join(q.select("q", "v"), F.size("v") == F.size("p"))
        want = p.groupBy("q", "id").agg(F.round(F.max(V.cosine(F.col("v"), F.col("p"))), 6).alias("best")).where(F.col("best") >= least)
        assert table_of(C.passage_gate(s, q.select("q", "v"), least)) == table_of(want)


def test_seen_by_all_viewers(spark):
    from tallyloom.operators.feeds import others_since

    e = spark.createDataFrame([(i, f"s{i % 4}", "p" if i % 4 < 3 else "r", "prompt", i * 10) for i in range(40)], "id long, session_id string, project string, kind string, ts long")
    v = spark.createDataFrame([(f"s{i}", "p", 5, 395) for i in range(3)], "viewer string, project string, floor long, at long")
    seen = spark.createDataFrame([("s1", "p", 21), ("s2", "p", 14)], "other string, project string, through long")
    pairs = seen.crossJoin(v.select("viewer")).select("viewer", "other", "through")
    got = table_of(others_since(e, v, seen, 300))
    assert got == table_of(others_since(e, v, pairs, 300)) and len(got) > 20
