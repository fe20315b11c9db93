"""What the stored index, recall and pooled vectors shuffle, against the size of the texts; results as without them."""

import random
from collections import Counter

import pytest
from conftest import moved
from pyspark.sql import functions as F

from tallyloom.operators import index as I
from tallyloom.operators import ranking as R
from tallyloom.operators import recall as C
from tallyloom.operators import vectors as V


def bag(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Some common words among many rare ones; read from files, as tables are."""
    rnd = random.Random(3)
    rows = [(i, f"title {i}", " ".join(rnd.choice(("red", "blue", "green")) if rnd.random() < 0.3 else f"{rnd.getrandbits(40):x}" for _ in range(600)), 1_000_000 + i) for i in range(500)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "id long, title string, narrative string, created_at long").repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def size(docs):
    return docs.agg(F.sum(F.octet_length("narrative"))).first()[0]


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    return moved(spark, lambda: I.TextIndex(spark, str(tmp_path_factory.mktemp("index"))).add(docs, "id", ["title", "narrative"], "created_at", 50))


def test_texts_are_shuffled_once(built, size):
    assert built[1] < 1.1 * size


def test_only_asked_postings_are_shuffled(spark, docs, built, size):
    asked = spark.createDataFrame([(q, t) for q in range(60) for t in ("red", "blue")], "q int, term string")
    weights = {"title": 5.0, "narrative": 1.0}
    got, bytes_ = moved(spark, lambda: bag(built[0].top(asked, 3, weights=weights)))
    assert got == bag(R.top_scores(docs, "id", weights, asked, 3)) and bytes_ < 0.1 * size


def test_a_phrase_that_many_ask_is_shuffled_once(spark, docs, built, size):
    asked = spark.createDataFrame([(q, i, t) for q in range(20) for i, t in enumerate(("red", "blue", "red"))], "q int, i int, term string")
    got, bytes_ = moved(spark, lambda: bag(built[0].phrases(asked)))
    assert got == bag(R.phrase_hits(docs, "id", "narrative", asked)) and bytes_ < 0.5 * size


def test_phrases_of_a_document_that_was_replaced(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "id long, body string")
    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "q int, i int, term string")
    index = I.TextIndex(spark, str(tmp_path)).add(rows((1, "a b"), (2, "a b a b")), "id", ["body"]).add(rows((1, "b a b")), "id", ["body"])
    assert bag(index.phrases(asked)) == Counter({(1, 1, 1): 1, (2, 1, 2): 1})


def test_postings_are_packed_whole():
    import numpy as np

    slots = [[0, 1, 2, 70_000], [5], [3, 300, 20_000_000]]
    tfs = [[1, 300, 70_000, 20_000_000], [1], [2, 1, 1]]
    n = np.array([len(x) for x in slots])
    begin = np.cumsum(n) - n
    held = I.pack(np.concatenate(slots), np.concatenate(tfs), begin, n)
    for b, m, s, t in zip(begin, n, slots, tfs, strict=True):
        slot, tf = I.unpacked(held[8 * b : 8 * (b + m)])
        assert slot.tolist() == s and tf.tolist() == t


def test_recall_shuffles_no_texts(spark, docs, built, size):
    prompts = spark.createDataFrame([(q, f"title red of the blue {q}") for q in range(20)], "q long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as the sides of larger tables are
    try:
        run = lambda index: C.keyword_rank(docs, docs.where("id % 7 <> 0").join(docs.where("id % 5 = 0").select("id"), "id", "left_anti"), prompts, ("of", "the"), 5, 2_000_000, {"title": 5.0, "narrative": 1.0}, rare=2.0, index=index)
        got, bytes_ = moved(spark, lambda: bag(run(built[0])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == bag(run(None)) and len(got) > 50 and bytes_ < 0.3 * size


def test_pooled_by_hashed_tokens_shuffles_sums_only(spark, docs, size, monkeypatch):
    table = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(40)], "term long, v array<double>")
    key = lambda t: F.pmod(F.xxhash64(t), F.lit(40))
    terms = docs.select(F.explode(R.tokens(F.col("narrative"))).alias("w")).distinct().withColumn("term", key(F.col("w")))
    plain = terms.join(table, "term").select(F.col("w").alias("term"), "v")
    rounded = lambda df: bag(df.select("id", "known", F.array_join(F.transform("v", lambda x: F.round(x, 9).cast("string")), " ").alias("v")))
    got, bytes_ = moved(spark, lambda: rounded(V.pooled(docs, "id", "narrative", table, 2, key=key)))
    assert bytes_ < 0.2 * size
    monkeypatch.setattr(I, "ROWS", 15)  # three parts
    assert got == rounded(V.pooled(docs, "id", "narrative", table, 2, key=key))
    monkeypatch.setattr(I, "ROWS", 1)  # more than there are passes
    assert got == rounded(V.pooled(docs, "id", "narrative", plain, 2))
