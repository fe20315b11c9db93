"""The stored index: scores as without it, few blocks tried, segments added, replaced, deleted and merged, two writers."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import index as I
from tallyloom.operators import ranking as R
from tallyloom.sources.commits import Commits

SCHEMA = "id long, title string, body string, at long"
WEIGHTS = {"title": 5.0, "body": 1.0}


def made(rnd, i):
    words = [f"w{min(int(rnd.expovariate(0.2)), 40)}" for _ in range(rnd.choice([0, 3, 30, 80]))]
    return (i, rnd.choice([None, "", "W1 w2", f"w{rnd.randrange(40)}"]), None if rnd.random() < 0.05 else " ".join(words), 1_000_000 + rnd.randrange(500_000))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    return [made(rnd, i) for i in range(400)]


@pytest.fixture(scope="module")
def terms(spark):
    rnd = random.Random(9)
    return spark.createDataFrame(sorted({(q, f"w{rnd.randrange(44)}") for q in range(40) for _ in range(4)}), "q int, term string")


def bag(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def flat(docs):
    return docs.select("id", F.concat_ws(" ", "title", "body").alias("text"))


def same(index, docs, terms):
    """All reads of the index give what the texts give."""
    age = (F.lit(2_000_000) - F.col("at")) / F.lit(1e5)
    assert bag(index.top(terms, 5, weights=WEIGHTS)) == bag(R.top_scores(docs, "id", WEIGHTS, terms, 5))
    assert bag(index.top(terms, 3, age=(2_000_000, 1e5), weights=WEIGHTS)) == bag(R.top_scores(docs, "id", WEIGHTS, terms, 3, age=age))
    assert bag(index.top(terms, 4, least=2, pairs=True, weights=WEIGHTS)) == bag(R.top_scores(docs, "id", WEIGHTS, terms, 4, least=2, pairs=True))
    each = docs.select("id", F.array_distinct(R.tokens(F.concat_ws(" ", "title", "body"))).alias("t")).select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert bag(index.frequencies(terms).select("term", "df")) == bag(each.join(terms.select("term").distinct(), "term"))


@pytest.mark.parametrize("block", [30, I.BLOCK])
def test_scores(spark, rows, terms, tmp_path, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = I.TextIndex(spark, str(tmp_path)).add(docs, "id", ["title", "body"], "at", block)
    same(index, docs, terms)
    within = docs.where("id % 3 = 0")
    known = R.statistics(docs, "id", WEIGHTS, terms)
    assert bag(index.top(terms, 5, weights=WEIGHTS, within=within)) == bag(R.top_scores(within, "id", WEIGHTS, terms, 5, known=known))
    both = index.top(terms, 5, weights=WEIGHTS, every=True)
    assert bag(R.ranked(both.drop("need"), "score", "doc", k=5)) == bag(R.top_scores(docs, "id", WEIGHTS, terms, 5))
    every = R.ranked(both.where("words = need"), "score", "doc", k=5).drop("need")
    whole = R.top_scores(docs, "id", WEIGHTS, terms, 400).join(terms.groupBy("q").agg(F.count(F.lit(1)).alias("need")), "q").where("words = need").drop("need", "rank")
    assert bag(every) == bag(R.ranked(whole, "score", "doc", k=5))


def test_few_blocks_are_tried(spark, terms, tmp_path):
    """A rare word that stands in few blocks leaves the others alone."""
    docs = spark.createDataFrame([(i, None, "common " * 20 + ("rare " * (1 + i % 5) if i % 90 == 0 else ""), 0) for i in range(2000)], SCHEMA)
    index = I.TextIndex(spark, str(tmp_path)).add(docs, "id", ["title", "body"], "at", 20)
    asked = spark.createDataFrame([(1, "rare"), (1, "common")], "q int, term string")
    assert bag(index.top(asked, 3)) == bag(R.top_scores(docs, "id", {"title": 1.0, "body": 1.0}, asked, 3))
    first, rest = (x.count() for x in index.tried)
    assert first == I.PROBES and rest < 25 < 100


def test_phrases(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    index = I.TextIndex(spark, str(tmp_path)).add(docs, "id", ["body"], "at", 60)
    asked = spark.createDataFrame([(q, i, t) for q, p in enumerate(("w0 w1", "w0 w0", "w2 w0 w1", "w0", "w1 w1 w1", "w99 w0")) for i, t in enumerate(p.split())], "q int, i int, term string")
    assert bag(index.phrases(asked)) == bag(R.phrase_hits(docs, "id", "body", asked))
    less = index.delete(docs.where("id % 2 = 0"))
    assert bag(less.phrases(asked)) == bag(R.phrase_hits(docs.where("id % 2 = 1"), "id", "body", asked))


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_segments(spark, rows, terms, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    index = I.TextIndex(spark, str(tmp_path)).add(docs, "id", ["title", "body"], "at", 40)
    before = files(tmp_path)
    rnd = random.Random(1)
    new = spark.createDataFrame([made(rnd, i) for i in (3, 4, 1000, 1001)], SCHEMA)  # one in a hundred: two new texts of old ids, two new ids
    index = index.add(new, "id", ["title", "body"], "at", 40)
    now = docs.join(new.select("id"), "id", "left_anti").unionByName(new)
    assert before <= files(tmp_path) and [s.docs for s in index.segments] == [398, 4]
    assert bag(index.top(terms, 5, weights=WEIGHTS)) == bag(R.top_scores(now, "id", WEIGHTS, terms, 5))
    gone = now.where("id % 5 = 1").select("id")
    index = index.delete(gone)
    now = now.where("id % 5 <> 1")
    same(index, now, terms)
    whole = index.merge(all=True, block=40)
    assert len(whole.segments) == 1 and not whole.segments[0].dead and whole.segments[0].docs == now.count()
    assert bag(whole.top(terms, 5, weights=WEIGHTS)) == bag(R.top_scores(now, "id", WEIGHTS, terms, 5))
    assert I.TextIndex(spark, str(tmp_path)).number == whole.number
    assert bag(index.top(terms, 5, weights=WEIGHTS)) == bag(whole.top(terms, 5, weights=WEIGHTS))  # a reader of the older commit goes on


def test_merge_takes_segments_of_like_size(spark, rows, tmp_path):
    index = I.TextIndex(spark, str(tmp_path))
    for i in range(5):
        part = spark.createDataFrame(rows[300:] if i == 0 else rows[i * 2 : i * 2 + 2], SCHEMA)
        index = index.add(part, "id", ["title", "body"], "at")
    index = index.merge()
    assert sorted(s.docs for s in index.segments) == [8, 100]
    assert index.merge().number == index.number


def test_two_writers(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows[:20], SCHEMA)
    one, two = I.TextIndex(spark, str(tmp_path)), I.TextIndex(spark, str(tmp_path))
    one.add(docs, "id", ["body"], "at")
    with pytest.raises(I.Lost):
        two.add(docs, "id", ["body"], "at")
    assert I.TextIndex(spark, str(tmp_path)).size()[0] == 20


def test_commits_are_made_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    commits = Commits(spark, str(tmp_path))
    assert commits.last() == (-1, None)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: commits.put(0, {"by": i}), range(8)))
    assert sum(won) == 1 and commits.last() == (0, {"by": won.index(True)})


def test_empty_tables_and_text_ids(spark, tmp_path):
    none = spark.createDataFrame([], "id string, body string")
    asked = spark.createDataFrame([(1, "a")], "q int, term string")
    index = I.TextIndex(spark, f"{tmp_path}/a")
    assert index.top(asked, 3).count() == 0
    index = index.add(none, "id", ["body"])
    assert index.top(asked, 3).count() == 0
    named = spark.createDataFrame([("x", "a b"), ("y", "a"), ("z", None)], "id string, body string")
    index = I.TextIndex(spark, f"{tmp_path}/b").add(named, "id", ["body"])
    assert bag(index.top(asked, 3)) == bag(R.top_scores(named, "id", "body", asked, 3))
    assert bag(index.delete(named.where("id = 'y'")).top(asked, 3)) == bag(R.top_scores(named.where("id <> 'y'"), "id", "body", asked, 3))
