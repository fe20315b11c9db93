"""Exact nearest neighbours from a stored index that lets most vectors alone.

Vectors (of unit length) belong to the cell of their nearest pivot; a cell's vectors, ordered by their angle to the pivot, are cut into
blocks.  A block keeps the least and greatest of these angles and its vectors as int8 with their rounding errors.  By the triangle
inequality no vector of a block is nearer to a query than the query's angle to the pivot lies outside the block's range.  A query
tries the few blocks of best bound first; of the rest only those whose bound reaches its k-th lower bound so far are read.  What
may be among the k best for all that rounding left open is compared exactly.

Pivots are PIVOTS vectors of least hash, a sample that serves as landmarks only; every vector is in a block.  Queries meet blocks
in groups of QUERIES; no more than a group is ever held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.commits import Commits
from . import vectors as V
from .index import bounded, cut

PIVOTS, BLOCK, QUERIES, PROBES = 256, 512, 256, 4
#: What rounding of cosines and of sums of doubles may add.
SLACK = 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class VectorIndex:
    """The index in a folder; `find` has what brute force has."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = Commits(spark, self.folder).last()[1]

    @classmethod
    def build(cls, spark: SparkSession, folder: str, vectors: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> VectorIndex:
        """vectors: (id, v), v of unit length and of one size."""
        name = uuid.uuid4().hex
        path = f"{folder.rstrip('/')}/{name}"
        marks = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow().column("v").combine_chunks()  # PIVOTS at most
        points = matrix(marks) if len(marks) else np.zeros((0, 1))
        held = spark.sparkContext.broadcast(points)
        kind = to_arrow_type(vectors.schema["id"].dataType)
        schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("q", T.BinaryType())])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column("v"))
                far = angles(v, held.value)
                cell = far.argmin(1)
                scale = np.maximum(np.abs(v).max(1), 1e-12) / 127
                q = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
                error = np.linalg.norm(v - q * scale[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(v)), cell]), pa.array(scale), pa.array(error), pa.array([x.tobytes() for x in q], pa.binary())], names=schema.names)

        placed = vectors.select("id", "v").mapInArrow(near, schema)
        placed.write.parquet(f"{path}/placed")
        placed = spark.read.schema(schema).parquet(f"{path}/placed")
        # blocks by quantiles of each cell's angles: ranges of (cell, angle) that Spark deals over tasks
        ordered = placed.repartitionByRange(F.col("cell"), F.col("angle"), F.col("id")).sortWithinPartitions("cell", "angle", "id")
        out = [("cell", pa.int32(), T.IntegerType()), ("low", pa.float64(), T.DoubleType()), ("high", pa.float64(), T.DoubleType()), ("ids", pa.list_(kind), T.ArrayType(vectors.schema["id"].dataType)), ("scales", pa.list_(pa.float64()), T.ArrayType(T.DoubleType())), ("errors", pa.list_(pa.float64()), T.ArrayType(T.DoubleType())), ("q", pa.binary(), T.BinaryType())]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rows = None, []

            def done() -> pa.RecordBatch:
                one = [now, rows[0][1], rows[-1][1], [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], b"".join(r[4] for r in rows)]
                return pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k, _) in zip(one, out, strict=True)], names=[n for n, _, _ in out])

            for batch in batches:
                for i, cell, angle, scale, error, q in zip(*(batch.column(c).to_pylist() for c in ("id", "cell", "angle", "scale", "error", "q")), strict=True):
                    if rows and (cell != now or len(rows) == block):
                        yield done()
                        rows = []
                    now = cell
                    rows.append((i, angle, scale, error, q))
            if rows:
                yield done()

        blocks = ordered.mapInArrow(pack, T.StructType([T.StructField(n, t) for n, _, t in out]))
        blocks.withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{path}/blocks")
        Commits(spark, folder).put(Commits(spark, folder).number() + 1, {"name": name, "pivots": points.tolist()})
        return cls(spark, folder)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.state['name']}/blocks")

    def find(self, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(q, id, cosine, rank): the k nearest of the index's vectors for each query (q, v); vectors: (id, v), for the exact comparison."""
        asked = cut(queries.select("q", F.col("v").alias("qv")))
        groups = max(1, -(-asked.count() // QUERIES))
        asked = asked.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
        points = np.array(self.state["pivots"])
        kind = asked.schema["q"].dataType

        def to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = angles(matrix(batch.column("qv")), points)
                    at = np.repeat(np.arange(len(far)), len(points))
                    yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(at)), pa.array(np.tile(np.arange(len(points), dtype=np.int32), len(far))), pa.array(far.ravel())], names=["q", "cell", "far"])

        far = asked.select("q", "qv").mapInArrow(to_pivots, T.StructType([T.StructField("q", kind), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))
        outside = F.greatest(F.lit(0.0), F.col("far") - F.col("high"), F.col("low") - F.col("far"))
        bound = far.join(bounded(self.blocks().select("block", "cell", "low", "high")), "cell").select("q", "block", F.cos(outside).alias("best"))
        bound = cut(bound.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.col("best").desc(), "block"))))
        first = cut(self._scored(asked, bound.where(F.col("n") <= PROBES), k))
        order = W.partitionBy("q").orderBy(F.col("least").desc())
        floor = lambda rows: rows.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("q", F.col("least").alias("floor"))
        open_ = lambda rows, c, by: rows.join(by, "q", "left").where(F.col("floor").isNull() | (F.col(c) + SLACK >= F.col("floor"))).drop("floor")
        rest = open_(bound.where(F.col("n") > PROBES), "best", floor(first))
        self.tried = (bound.where(F.col("n") <= PROBES), rest)
        every = cut(first.unionByName(self._scored(asked, rest, k)))
        few = open_(every, "most", floor(every)).select("q", "id")
        exact = vectors.select("id", "v").join(bounded(few), "id").join(bounded(asked.select("q", "qv")), "q")
        scored = exact.select("q", "id", F.round(V.dot(F.col("qv"), F.col("v")), 6).alias("cosine"))
        return scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("cosine").desc(), "id"))).where(F.col("rank") <= k)

    def _scored(self, asked: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
        """(q, id, least, most): bounds on the cosines of those of each chosen block (q, block) that may be among its k best."""
        work = chosen.select("q", "block").join(asked, "q").groupBy("g", "block").agg(F.collect_list(F.struct("q", "qv")).alias("qs"))  # a group's queries
        rows = self.blocks().select("block", "ids", "scales", "errors", F.col("q").alias("v8")).join(work, "block").select("ids", "scales", "errors", "v8", "qs")
        schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("id", rows.schema["ids"].dataType.elementType), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())])
        arrow = [to_arrow_type(f.dataType) for f in schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, asks = batch.column("ids")[i].values, batch.column("qs")[i].as_py()
                    scale, error = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("scales", "errors"))
                    v = np.frombuffer(batch.column("v8")[i].as_py(), np.int8).reshape(len(ids), -1).astype(np.float64) * scale[:, None]
                    want = np.array([x["qv"] for x in asks], float)
                    near, open_ = want @ v.T, np.linalg.norm(want, axis=1)[:, None] * error
                    least, most = near - open_, near + open_
                    last = max(0, len(ids) - k)
                    a, b = np.nonzero(most + SLACK >= np.partition(least, last, axis=1)[:, last : last + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([asks[x]["q"] for x in a], arrow[0]), ids.take(pa.array(b)), pa.array(least[a, b]), pa.array(most[a, b])], names=schema.names)

        return rows.mapInArrow(run, schema)
