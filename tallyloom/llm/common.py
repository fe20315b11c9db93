"""What the training-data operators share: words, row keys, stored tables, components.

Words are maximal runs of characters other than space and 0x09-0x0D.  Python sees
texts as UTF-8 bytes (``bytes.split()`` cuts at exactly these characters).
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, and the class for Java and RE2 patterns.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Rows, and bytes on disk, that a stored table may have at most to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests, local master)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            own = tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, own, True)
            _OWN.append(f"file://{own}")
        found = _OWN[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most so many rows for what is run inside: rows that carry much would make large ones."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Stored tables made inside are deleted at the end, but for those made with keep."""
    held: list[DataFrame] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.pop()
        for df in held:
            drop_stash(df)


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so a lost executor costs a file read."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, label), df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffles of this write are of no use after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out._tallyloom_path = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def folder_of(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_stash(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = getattr(df, "_tallyloom_path", None)
    if path:
        store, at = folder_of(df.sparkSession, path)
        store.delete(at, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows and, where it is a stored table, few bytes; else as it is (Spark then
    shuffles both sides)."""
    path = getattr(df, "_tallyloom_path", None)
    if path:
        store, at = folder_of(df.sparkSession, path)
        if store.getContentSummary(at).getLength() > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def text_key(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a text; null and empty texts are one."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(own).alias("k1"), F.xxhash64(F.lit(1), own).alias("k2")


@dataclass
class Texts:
    """rows: (id, k1, k2) of every row; bodies: (k1, k2, m, ids, id, r, text), each distinct text once: the numbers of its rows
    and of their distinct ids, the least id (null last) and its hash."""

    rows: DataFrame
    bodies: DataFrame

    def with_lists(self, lists: DataFrame, how: str = "inner") -> DataFrame:
        return self.bodies.join(lists.hint("merge"), ["k1", "k2"], how)  # the same plan at every size


def distinct_texts(docs: DataFrame, id: str, text: str) -> Texts:
    k1, k2 = text_key(text)
    rows = docs.select(F.col(id).alias("id"), k1, k2)
    each = rows.withColumn("h", F.xxhash64("id")).groupBy("k1", "k2", "h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h", "c")).alias("r")
    each = each.groupBy("k1", "k2").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("ids"), least)
    stored = stash(each.select("k1", "k2", "m", "ids", "r.id", F.col("r.h").alias("r"), (F.col("r.c") > 1).alias("again")), "distinct-texts")
    # the row of least id stands for its text; no equality of columns, so that texts stay dealt by (k1, k2)
    found = docs.select(k1, k2, F.xxhash64(id).alias("h"), F.col(text).alias("text")).join(small(stored), ["k1", "k2"]).where(F.col("h").bitwiseXOR(F.col("r")) == 0)
    bodies = found.where("NOT again")
    if stored.where("again").limit(1).count():
        bodies = bodies.unionByName(found.where("again").dropDuplicates(["k1", "k2"]))
    return Texts(rows, bodies.select("k1", "k2", "m", "ids", "id", "r", "text"))


def words_of(text: Column) -> Column:
    """Array of words; null and blank texts give an empty array."""
    cut = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), BLANK_RUN)
    return F.filter(cut, lambda w: w != "")


def count_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """A text column as bytes; nulls become empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text, or a single row: memory follows the longest text, not the batch."""
    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()] if batch.nbytes > most else []
        if not sizes:
            if batch.num_rows:
                yield batch
            continue
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def connected_components(edges: DataFrame, label: str = "components", most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (u, v: long) is linked to.

    Alternates large-star and small-star (Kiveris et al., 2014).  Every step aggregates a minimum per node and joins it
    back, so a hub is a skewed join that adaptive execution splits, never a list in one task.  Each round is stored in
    the shared folder.  Raises if `most` rounds don't suffice (rounds grow as the logarithm of the longest chain).
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        fresh = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, stash(fresh, label)
        drop_stash(before)
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
