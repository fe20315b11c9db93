"""Quantised vectors and exact search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def quantise(v: Column) -> Column:
    """struct(scale, q): int8 by the greatest magnitude over 127, rounded half away from zero."""
    scale = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1e-12)) / 127
    return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: F.least(F.greatest(F.round(x.cast("double") / s), F.lit(-127.0)), F.lit(127.0)).cast("byte")).alias("q")))[0]


def quantised_dot(query: Column, q: Column, scale: Column) -> Column:
    """Unequal lengths give -1."""
    return F.when(F.size(query) == F.size(q), dot(query, q) * scale).otherwise(-1.0)


#: Queries that are compared with all vectors at once, and queries and vectors of one product of matrices.
QUERIES, ROWS, SLAB = 10_000, 1024, 2048
#: What rounding of cosines and sums in another order may add.
SLACK = 2e-6


def by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Size -> (places, matrix) of a column of vectors; null ones and those with a null have no cosine and are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten()
        bad = np.asarray(flat.is_null()).reshape(len(at), size).any(1) if flat.null_count else np.zeros(len(at), bool)
        rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
        out[size] = (at[~bad], rows[~bad])
    return out


def in_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of a and j of b, added up as `dot` does, to the last bit."""
    out = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[i] * y[j]
    return out


class Best:
    """The k best of each query so far; of equal products those of least id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.held, self.size = k, np.full(queries, -np.inf), [], 0
        self.most = max(1 << 21, 2 * queries * k)

    def add(self, q: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        self.held.append((q, ids, products))
        self.size += len(q)
        if self.size > self.most:
            self.shrink()

    def shrink(self) -> None:
        if not self.held:
            return
        q, ids, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        key = np.where(np.isnan(c), -np.inf, -c)  # NaN is the greatest, as in Spark
        order = np.lexsort((ids, key, q))
        q, ids, c, key = q[order], ids[order], c[order], key[order]
        n = np.arange(len(q))
        start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], n, 0))
        kth = n - start == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], -key[kth])
        run = np.maximum.accumulate(np.where(np.r_[True, (q[1:] != q[:-1]) | (key[1:] != key[:-1])], n, 0))
        keep = (n - run < self.k) & ~(-key < self.floor[q] - SLACK)
        self.held, self.size = [(q[keep], ids[keep], c[keep])], int(keep.sum())


def close(vectors: DataFrame, block: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(q, id, c) of a block of queries (q, qv): what may be among the k nearest of (id, v), with unrounded products.

    Products of matrices leave out what is surely farther than a task's k best so far, so a task holds and gives no more than those;
    the rest are added up in `dot`'s order.  others: both tables have a label; a vector doesn't meet the query of its own id, and the
    k nearest are those of each `own`: of the query's label, of another, or null where either isn't known."""
    asked = block.toArrow()  # QUERIES or so
    column = lambda name: asked.column(name).combine_chunks()
    own = column("label") if others else None
    model = block.sparkSession.sparkContext.broadcast((column("q"), by_size(column("qv")), own))
    cores = block.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.select("id", "v", *(["label"] if others else []))
    vectors = vectors.coalesce(cores)
    fields = [block.schema["q"], vectors.schema["id"], T.StructField("c", T.DoubleType()), T.StructField("own", T.BooleanType())]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(("q", "id", "c", "own"), fields, strict=True)])
    id_type = to_arrow_type(schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sized, labels = model.value
        best = [Best(len(names), k) for _ in range(3 if others else 1)]
        for whole in batches:
            for start in range(0, whole.num_rows, SLAB):
                batch = whole.slice(start, SLAB)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for size, (at, v) in by_size(batch.column("v")).items():
                    for i in range(0, len(sized[size][0]) if size in sized else 0, ROWS):
                        rows, q = (x[i : i + ROWS] for x in sized[size])
                        product = q @ v.T
                        for face, open_ in enumerate(faces(names, labels, rows, batch, at) if others else [None]):
                            keep_best(best[face], product, open_, rows, q, ids[at], v)
        for face, b in enumerate(best):
            b.shrink()
            for q, ids, c in b.held:
                for i in range(0, len(q), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    mine = pa.array([None if not others or face == 2 else face == 0] * len(q[part]), pa.bool_())
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q[part])), pa.array(ids[part], id_type), pa.array(c[part]), mine], names=schema.names)

    return vectors.mapInArrow(run, schema)


def faces(names: pa.Array, labels: pa.Array, rows: np.ndarray, batch: pa.RecordBatch, at: np.ndarray) -> list[np.ndarray]:
    """Which pairs of queries and vectors have the same label, another one, or one that isn't known; none has a vector's own id."""
    take = lambda x, i: x.take(pa.array(i))
    code = lambda x: pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
    ql, l = take(labels, rows), take(batch.column("label"), at)
    known = np.asarray(ql.is_valid())[:, None] & np.asarray(l.is_valid())[None, :]
    same = code(ql)[:, None] == code(l)[None, :]
    other = take(names, rows).to_numpy(zero_copy_only=False)[:, None] != take(batch.column("id"), at).to_numpy(zero_copy_only=False)[None, :]
    return [other & known & same, other & known & ~same, other & ~known]


def keep_best(best: Best, product: np.ndarray, open_: np.ndarray | None, rows: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
    """Puts the pairs that may be among the k best into `best`: product has rows of queries and columns of vectors."""
    may = lambda: ~(product < best.floor[rows, None] - SLACK) if open_ is None else open_ & ~(product < best.floor[rows, None] - SLACK)
    i, j = np.nonzero(may())
    last = product.shape[1] - best.k
    if last > 0 and len(i) > 2 * best.k * len(rows):
        seen = product if open_ is None else np.where(open_, product, -np.inf)
        kth = np.partition(seen, last, axis=1)[:, last]
        best.floor[rows] = np.fmax(best.floor[rows], np.where(np.isnan(kth), np.inf, kth))
        i, j = np.nonzero(may())
    if len(i):
        best.add(rows[i], ids[j], in_order(q, v, i, j))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, cosine, rank): the k nearest of (id, v) for each query (q, v), exact; v of unit length.

    Queries are a stated set, taken in blocks of about QUERIES that each meet all vectors; filters on vectors belong before the call, so
    that rows which don't qualify take no places."""
    out = None
    for block in in_blocks(queries.select("q", F.col("v").alias("qv"))):
        scored = close(vectors, block, k).select("q", "id", F.round("c", 6).alias("cosine"))
        top = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("cosine").desc(), "id"))).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def in_blocks(asked: DataFrame) -> Iterator[DataFrame]:
    """Queries (q, ...) in blocks of about QUERIES."""
    blocks = max(1, -(-asked.count() // QUERIES))
    for b in range(blocks):
        yield asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)


def nearest_by_label(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, own, cosine): the nearest vector (id, v, label) of each query's (q, v, label) own label and of another, itself left out;
    own is null where a label isn't known."""
    out = None
    for block in in_blocks(queries.select("q", F.col("v").alias("qv"), "label")):
        top = close(vectors, block, 1, others=True).groupBy("q", "own").agg(F.round(F.max("c"), 6).alias("cosine"))
        out = top if out is None else out.unionByName(top)
    return out


def close_passages(sources: DataFrame, block: DataFrame, least: float) -> DataFrame:
    """(q, id, c): for a block of queries (q, qv) the unrounded cosine of a source's nearest passage, where it may reach `least`."""
    asked = block.toArrow()  # QUERIES or so
    sized = {n: (at, v, np.sqrt(in_order(v, v, np.arange(len(v)), np.arange(len(v))))) for n, (at, v) in by_size(asked.column("qv").combine_chunks()).items()}
    model = block.sparkSession.sparkContext.broadcast((asked.column("q").combine_chunks(), sized))
    schema = T.StructType([T.StructField("q", block.schema["q"].dataType), T.StructField("id", sources.schema["id"].dataType), T.StructField("c", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sized = model.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLAB // 4):
                batch = whole.slice(start, SLAB // 4)
                column = batch.column("passages")
                source = pc.list_parent_indices(column).to_numpy()  # null lists have none
                for size, (at, v) in by_size(column.flatten()).items():
                    own, n = source[at], np.arange(len(v))
                    long = np.sqrt(in_order(v, v, n, n))
                    for i in range(0, len(sized[size][0]) if size in sized else 0, ROWS):
                        rows, q, wide = (x[i : i + ROWS] for x in sized[size])
                        both = wide[:, None] * long[None, :]
                        a, b = np.nonzero(~(np.where(both > 0, (q @ v.T) / np.where(both > 0, both, 1), 0) < least - SLACK))
                        norm = both[a, b]
                        c = np.where(norm > 0, in_order(q, v, a, b) / np.where(norm > 0, norm, 1), 0.0)
                        key = rows[a] * np.int64(batch.num_rows) + own[b]
                        order = np.lexsort((c, key))  # a source's nearest comes last; NaN is the greatest
                        key, c = key[order], c[order]
                        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.zeros(0, int)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(key[last] // batch.num_rows)), batch.column("id").take(pa.array(key[last] % batch.num_rows)), pa.array(c[last])], names=schema.names)

    return sources.select("id", "passages").mapInArrow(run, schema)


#: Passes over the texts, one for each part of the token vectors that may be broadcast, before they are joined by term.
PASSES = 16


def counted(docs: DataFrame, id: str, words: Column) -> DataFrame:
    """(id, term, tf): the words of each row, counted where it is read; rows of one id are not summed."""
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                said = batch.column("t").flatten().dictionary_encode()
                if not len(said):
                    continue
                size = np.diff(batch.column("t").offsets.to_numpy())
                pair = np.repeat(np.arange(len(size)), size) * len(said.dictionary) + said.indices.to_numpy()
                pair, tf = np.unique(pair, return_counts=True)
                row, code = np.divmod(pair, len(said.dictionary))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), said.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(tf.astype(np.int64))], names=schema.names)

    return docs.select(F.col(id).alias("id"), words.alias("t")).mapInArrow(run, schema)


def pooled(docs: DataFrame, id: str, text: str, tokens: DataFrame, dim: int, most: int | None = None, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, known, v): the mean of a text's token vectors, of length 1, as static models embed a text; zeros where no token is known.

    tokens: (term, v: `dim` numbers); known: how many of the text's tokens it has; most: how many tokens a model reads of a text.
    key: of a term, by which tokens share a vector, as hashed tables have it; `term` of tokens then has the key.
    A token that occurs often in a text is met once with its number and vector where the text is read, and only sums of all
    dimensions are shuffled.  Token vectors beyond what may be broadcast are taken in parts, with a pass over the texts for each;
    more than PASSES parts are joined by term, where frequent terms are split."""
    from . import ranking
    from .index import ROWS

    said = ranking.words_in(docs, text) if most is None else F.slice(ranking.words_in(docs, text), 1, most)
    tf = counted(docs, id, said)
    tf = tf if key is None else tf.withColumn("term", key(F.col("term")))
    own = tokens.select("term", F.col("v").alias("tv"))
    parts = -(-own.count() // ROWS)
    if parts <= 1:
        met = tf.join(F.broadcast(own), "term")
    elif parts <= PASSES:
        part = F.pmod(F.xxhash64("term"), F.lit(parts))
        met = None
        for i in range(parts):
            one = tf.where(part == i).join(F.broadcast(own.where(part == i)), "term")
            met = one if met is None else met.unionByName(one)
    else:
        met = tf.join(own, "term")
    sums = met.groupBy("id").agg(F.sum("tf").alias("known"), *(F.sum(F.col("tf") * F.get("tv", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)))
    size = F.sqrt(sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0)))
    unit = sums.withColumn("size", size).select("id", "known", F.array(*(F.when(F.col("size") > 0, F.col(f"s{i}") / F.col("size")).otherwise(0.0) for i in range(dim))).alias("v"))
    every = docs.select(F.col(id).alias("id")).distinct().join(unit, "id", "left")
    return every.select("id", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("v", F.array_repeat(F.lit(0.0), dim)).alias("v"))


def passages(text: Column, least: int = 20, width: int = 3, step: int = 2, most: int = 6) -> Column:
    """Sentences of over `least` bytes in overlapping windows; the whole text if it has no more than `width`."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.octet_length(s) > least)
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size(sentences) - width + 1, F.lit(1)), F.lit(step)), 1, most)
    return F.when(F.size(sentences) <= width, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(sentences, i, F.lit(width)), " ")))


def stale(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Memories (id, text_hash) without a vector (id, text_hash) of their present text."""
    return memories.join(vectors.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
