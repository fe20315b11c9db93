"""Full-text ranking, rank fusion and gating.

All questions are answered at once: a query table (q, term) meets the postings in one join.  Only the postings of asked terms
are aggregated; document frequencies, lengths and their mean are those of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, term, tf, len); len counts all tokens of a document."""
    t = docs.select(F.col(id).alias("doc"), tokens(F.col(text)).alias("t"))
    return t.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def term_scores(docs: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """(q, doc, term, s): BM25 of each asked term (q, term) in each document that has it."""
    sized = docs.select(F.col(id).alias("doc"), tokens(F.col(text)).alias("t"))
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    asked = terms.select("q", "term").distinct()
    wanted = asked.select("term").distinct()
    found = sized.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, "term")
    tf = found.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = total.first()  # two numbers
    n, mean = F.lit(float(one["n"])), F.lit(float(one["mean"] or 1))
    s = idf(n, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return tf.join(df, "term").withColumn("s", s).join(asked, "term").select("q", "doc", "term", "s")


#: Questions that a pass over the documents answers at once.
QUESTIONS = 256


def words_in(docs: DataFrame, column: str) -> Column:
    """A column's words: tokens of a text, or the array that stemmed() made of one."""
    return F.col(column) if isinstance(docs.schema[column].dataType, T.ArrayType) else tokens(F.col(column))


def stemmed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with arrays of stems in place of texts: lower case, without marks, by Porter's rules; each different word of a batch is
    stemmed once."""
    from ..functions.stem import stem
    from ..functions.text import unaccented

    rows = docs.withColumns({c: tokens(unaccented(F.coalesce(F.col(c), F.lit("")))) for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for name, col in zip(batch.schema.names, batch.columns, strict=True):
                if name in columns:
                    words = col.flatten().dictionary_encode()
                    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
                    col = pa.ListArray.from_arrays(pa.array(col.offsets.to_numpy() - (col.offsets[0].as_py() if len(col) else 0), pa.int32()), stems.take(words.indices))
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def columns_of(text: str | dict[str, float]) -> dict[str, float]:
    """Text columns and their weights."""
    return text if isinstance(text, dict) else {text: 1.0}


def statistics(docs: DataFrame, id: str, text: str | dict[str, float], terms: DataFrame) -> tuple[int, float, dict[str, int]]:
    """Number of documents, their mean length, and document frequencies of the asked terms (q, term)."""
    sized = docs.select(F.concat(*(words_in(docs, c) for c in columns_of(text))).alias("t"))
    asked = [r["term"] for r in terms.select("term").distinct().collect()]  # words of a stated set of questions
    own = F.broadcast(terms.select("term").distinct())
    one = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean")).first()
    df = sized.select(F.explode(F.array_distinct("t")).alias("term")).join(own, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = {r["term"]: r["df"] for r in df.collect()}
    return one["n"], float(one["mean"] or 1), {t: found.get(t, 0) for t in asked}


def top_scores(docs: DataFrame, id: str, text: str | dict[str, float], terms: DataFrame, k: int, least: int = 1, pairs: bool = False, age: Column | None = None, known: tuple | None = None) -> DataFrame:
    """(q, doc, score, words, rank): the k best documents by BM25 for each question of a stated set (q, term).

    Scores of a batch of documents are one product of matrices, and only its k best of each question leave it, so no pair of
    question and document is shuffled; ties go by id.  least: matched words; pairs: a word counts once for each pair it is
    matched in; age: taken from the score; known: statistics() of the documents, if they are at hand.  text: a column, or
    columns with the weight that a word's occurrence has in each."""
    n, mean, df = known or statistics(docs, id, text, terms)
    asked: dict = {}
    for r in terms.select("q", "term").distinct().collect():
        asked.setdefault(r["q"], []).append(r["term"])
    questions = sorted(asked)
    idf_of = {t: max(math.log((n - d + 0.5) / (d + 0.5)), 0) or 1e-6 for t, d in df.items()}
    blocks = []
    for at in range(0, len(questions), QUESTIONS):
        qs = questions[at : at + QUESTIONS]
        words = sorted({t for q in qs for t in asked[q]})
        number = {t: i for i, t in enumerate(words)}
        grid = np.zeros((len(words), len(qs)))
        for j, q in enumerate(qs):
            grid[[number[t] for t in asked[q]], j] = 1
        blocks.append((qs, number, np.array([idf_of[t] for t in words]), grid))
    model = docs.sparkSession.sparkContext.broadcast(blocks)
    weights = list(columns_of(text).values())
    parts = [words_in(docs, c) for c in columns_of(text)]
    sizes = F.array(*map(F.size, parts))  # where one column's words end and the next one's begin
    rows = docs.select(F.col(id).alias("doc"), F.concat(*parts).alias("t"), sizes.alias("sizes"), (F.lit(0.0) if age is None else age.cast("double")).alias("age"))
    schema = T.StructType([terms.schema["q"], T.StructField("doc", docs.schema[id].dataType), T.StructField("score", T.DoubleType()), T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                col, ids, age_ = batch.column("t"), batch.column("doc").to_pylist(), batch.column("age").to_numpy()
                size = np.diff(col.offsets.to_numpy())
                flat = col.flatten().dictionary_encode()
                owner = np.repeat(np.arange(len(size)), size)
                heavy = np.repeat(np.tile(weights, len(size)), batch.column("sizes").flatten().to_numpy())
                out: list[list] = [[], [], [], []]
                for qs, number, weight, grid in model.value:
                    code = np.array([number.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1])[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, int)
                    tf = np.zeros((len(size), len(number)))
                    some = code >= 0
                    np.add.at(tf, (owner[some], code[some]), heavy[some])
                    s = weight * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / mean))[:, None])
                    score, matched = s @ grid, (tf > 0).astype(float) @ grid
                    if pairs:
                        score = score * (matched - 1)
                    score = np.round(score - age_[:, None], 6)
                    score[matched < least] = -np.inf
                    cut = np.partition(score, max(0, len(size) - k), axis=0)[max(0, len(size) - k)]
                    for j, i in zip(*np.nonzero((score >= cut).T & np.isfinite(score).T), strict=True):
                        for held, x in zip(out, (qs[j], ids[i], float(score[i, j]), int(matched[i, j])), strict=True):
                            held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], to_arrow_type(schema[0].dataType)), pa.array(out[1], to_arrow_type(schema[1].dataType)), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], names=["q", "doc", "score", "words"])

    return ranked(rows.mapInArrow(run, schema), "score", "doc", k=k)


def any_word(scores: DataFrame) -> DataFrame:
    """(q, doc, score, words): the sum over matched words."""
    return scores.groupBy("q", "doc").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("words"))


def two_of(scores: DataFrame) -> DataFrame:
    """At least two words; each counts once for each pair it is matched in, as a disjunction of all pairs scores it."""
    return any_word(scores).where("words >= 2").withColumn("score", F.col("score") * (F.col("words") - 1))


def every_word(scores: DataFrame, terms: DataFrame) -> DataFrame:
    need = terms.groupBy("q").agg(F.count_distinct("term").alias("need"))
    return any_word(scores).join(need, "q").where("words = need").drop("need")


def recency(score: Column, age_ms: Column, per_point_ms: float) -> Column:
    """Higher is better: a point is lost for each per_point_ms of age."""
    return score - age_ms / F.lit(float(per_point_ms))


def ranked(rows: DataFrame, by: str, *ties: str, group: str = "q", k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds a rank from 1, by descending `by`, then ascending ties; the first k."""
    rows = rows.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(F.col(by).desc(), *ties)))
    return rows if k is None else rows.where(F.col(name) <= k)


def fuse(*lists: tuple[DataFrame, float], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (q, id, rank from 1): sum of weight / (constant + rank); ties keep the earlier list, then rank."""
    every = None
    for i, (df, weight) in enumerate(lists):
        part = df.select("q", "id", (F.lit(float(weight)) / (constant + F.col("rank"))).alias("s"), (F.lit(i) * 1_000_000 + F.col("rank")).alias("seen"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("q", "id").agg(F.sum("s").alias("score"), F.min("seen").alias("seen"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "seen", "id")))


def gate_and_fill(words: DataFrame, meaning: DataFrame, relevance: float, fill: float, limit: int) -> DataFrame:
    """Keyword hits (q, id, rank) in order, less those of cosine below `relevance` (none known: they pass), then hits by meaning
    (q, id, cosine) of `fill` or more, best first, until there are `limit`."""
    cos = meaning.select("q", "id", "cosine")
    kept = words.join(cos, ["q", "id"], "left").where(F.coalesce(F.col("cosine") >= relevance, F.lit(True))).select("q", "id", F.lit(0).alias("part"), F.col("rank").cast("double").alias("by"))
    more = cos.where(F.col("cosine") >= fill).join(kept.select("q", "id"), ["q", "id"], "left_anti").select("q", "id", F.lit(1).alias("part"), (-F.col("cosine")).alias("by"))
    out = kept.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("part", "by", "id")))
    return out.where(F.col("rank") <= limit).select("q", "id", "part", "rank")


def _gram(n: int):
    return lambda i: F.array_join(F.slice("t", i, F.lit(n)), " ")


def phrase_hits(docs: DataFrame, id: str, text: str, phrase: DataFrame) -> DataFrame:
    """(q, doc, tf): places where the words of (q, i, term; i from 0) stand side by side.

    Runs of words as long as the phrases meet them in a hash join inside the scan; only hits are shuffled."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"])
    asked = phrase.groupBy("q").agg(words.alias("w")).select("q", F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).cache()
    t = docs.select(F.col(id).alias("doc"), tokens(F.col(text)).alias("t"))
    out = None
    for n in sorted(r["n"] for r in asked.select("n").distinct().collect()):
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), _gram(n))
        one = t.where(F.size("t") >= n).select("doc", F.explode(grams).alias("gram")).join(F.broadcast(asked.where(F.col("n") == n).select("q", "gram")), "gram")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("q", "doc").agg(F.count(F.lit(1)).alias("tf"))


def recall_terms(text: Column, stop_words: tuple[str, ...], most: int = 12) -> Column:
    """Words worth asking for: last part of a path, split at what is not a letter, digit or underscore, lower case, at least
    three bytes, no stop word, not all digits, each once; longest (in bytes) first, at most `most`."""
    raw = F.split(F.lower(text), r"[\s,;:!?()\[\]{}\"'`]+")
    last = F.transform(raw, lambda w: F.element_at(F.split(w, "/"), -1))
    words = F.flatten(F.transform(last, lambda w: F.split(w, r"[^\p{L}\p{N}_]+")))
    words = F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.rlike(r"^[0-9]+$") & ~w.isin(*stop_words)))
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.octet_length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda x: x["w"]), 1, most)
