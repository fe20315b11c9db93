"""Line dedup by content-defined chunks of lines, extended to the whole runs that texts share.

A rolling hash runs over the hashes of each two neighbouring lines with words; of every two neighbours the smaller ends a chunk of
these two lines (and the blank ones between).  So boundaries depend on what stands around them alone: lines put in elsewhere
don't shift them, and three lines with words that stand in a row in two texts have a chunk in common.  Of a chunk that occurs more
than once, the occurrence of smallest (id, text hash, place) stays, null ids last; the others go, together with the lines before and
behind them that are as those around the one that stays, up to REACH on each side (the next chunk of a longer run begins sooner).
A chunk's occurrences are compared byte by byte (least against greatest, which partial aggregation finds for a chunk of any
frequency); those that share a hash but not their bytes are grouped anew by their bytes, and only they themselves go.  Lines
around a chunk are told apart by 128 bits.

No line is lost altogether: one goes only if the same line stands at a smaller place.  Each distinct text is cut once, however many
rows have it: the row of least id keeps what is its text's, rows of other ids lose all their lines if the text has a chunk.  Null
texts stay null and empty ones empty; a text that loses all its lines becomes empty, its row stays.  Rows with the same id and the
same text are one row repeated: they get the same result and aren't copies of each other.  An empty table gives an empty result.
All other columns are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_texts, scratch, slices, small, stash, table, text_key

#: Lines on each side of a chunk that may go with it.
REACH = 12
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line behind the last) of each chunk; chunks may share a line."""
    worded = [i for i, x in enumerate(lines) if x.strip()]
    own = [xxhash.xxh3_64_intdigest(lines[i]) for i in worded]
    rolled = []
    for x, y in zip(own, own[1:], strict=False):
        h = (x * _STEP + y) & _ALL
        rolled.append(((h ^ h >> 29) * _STEP & _ALL) >> 16)
    chosen = {0} if len(rolled) == 1 else {j if x < y else j + 1 for j, (x, y) in enumerate(zip(rolled, rolled[1:], strict=False))}
    return [(worded[j], worded[j + 1] + 1) for j in sorted(chosen)]


KEYS = ["k1", "k2"]


def chunk_rows(bodies: DataFrame) -> DataFrame:
    """(k1, k2, ids, id, r, a, b, h) of the chunks of (k1, k2, ids, id, r, text)."""
    keep = [*KEYS, "ids", "id", "r"]
    schema = T.StructType([bodies.schema[k] for k in keep] + [T.StructField(k, T.IntegerType()) for k in ("a", "b")] + [T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, a, b, h = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                if len(lines) < 2:
                    continue
                for x, y in chunks(lines):
                    digest = xxhash.xxh3_64_intdigest(b"\n".join(lines[x:y]))
                    at.append(i)
                    a.append(x)
                    b.append(y)
                    h.append(digest - (1 << 64) if digest >> 63 else digest)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keep), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(h, pa.int64())], names=[*keep, "a", "b", "h"])

    return bodies.select(*keep, "text").mapInArrow(run, schema)


def chunk_bytes(listed: DataFrame) -> DataFrame:
    """(k1, k2, id, r, h, a, b, first, chunk, before, behind) of the listed chunks of (k1, k2, id, r, text, runs): their bytes, and the
    hashes of the lines on both sides, nearest first."""
    keep, more = [*KEYS, "id", "r"], [("h", pa.int64(), T.LongType()), ("a", pa.int32(), T.IntegerType()), ("b", pa.int32(), T.IntegerType()), ("first", pa.bool_(), T.BooleanType())]
    sides = ["chunk", "before", "behind"]
    schema = T.StructType([listed.schema[k] for k in keep] + [T.StructField(n, t) for n, _, t in more] + [T.StructField(n, T.BinaryType()) for n in sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            rows = []
            for i, (text, runs) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                lines, known = text.split(b"\n"), {}

                def named(at: range) -> bytes:
                    for j in at:
                        if j not in known:  # noqa: B023
                            known[j] = xxhash.xxh3_128_digest(lines[j])  # noqa: B023
                    return b"".join(known[j] for j in at)  # noqa: B023

                for r in runs:
                    a, b = r["a"], r["b"]
                    rows.append((i, r["h"], a, b, r["first"], b"\n".join(lines[a:b]), named(range(a - 1, max(a - 1 - REACH, -1), -1)), named(range(b, min(b + REACH, len(lines))))))
            at, *columns = zip(*rows, strict=True) if rows else ((),) * 8
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keep), *(pa.array(c, t) for c, (_, t, _) in zip(columns, more, strict=False)), *(pa.array(c, pa.binary()) for c in columns[4:])], names=schema.names)

    return listed.select(*keep, "text", "runs").mapInArrow(run, schema)


def extended(pairs: DataFrame) -> DataFrame:
    """(k1, k2, r, a, b): chunks of (k1, k2, r, a, b, before, behind, one_before, one_behind) with the lines around them that are as
    those around the occurrence that stays."""
    schema = T.StructType([pairs.schema[k] for k in (*KEYS, "r", "a", "b")])

    def alike(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y)) // 16
        if not n or x[:16] != y[:16]:
            return 0
        same = (np.frombuffer(x, np.uint64, 2 * n) == np.frombuffer(y, np.uint64, 2 * n)).reshape(n, 2).all(1)
        return n if same.all() else int(same.argmin())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("before", "one_before", "behind", "one_behind")]
            up = np.array([alike(x, y) for x, y in zip(sides[0], sides[1], strict=True)], np.int32)
            down = np.array([alike(x, y) for x, y in zip(sides[2], sides[3], strict=True)], np.int32)
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*KEYS, "r")), pa.array((a - up).astype(np.int32)), pa.array((b + down).astype(np.int32))], names=schema.names)

    return pairs.select(*schema.names, "before", "behind", "one_before", "one_behind").mapInArrow(run, schema)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """docs, with all their columns, without the repeated runs; counts: also __line_all and __line_gone, numbers of lines."""
    place = F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2", "a")
    with scratch():
        texts = distinct_texts(docs, id, text)
        found = stash(chunk_rows(texts.bodies), "line-chunks")
        again = found.groupBy("h").agg(F.sum("ids").alias("times"), F.min(place).alias("p")).where("times > 1").select("h", "p")
        told = found.join(small(stash(again, "line-again")), "h").withColumn("first", place == F.col("p"))
        lists = told.groupBy(*KEYS).agg(F.collect_list(F.struct("h", "a", "b", "first")).alias("runs"))  # a text's own chunks
        lists = stash(lists, "line-lists")
        cut = stash(chunk_bytes(texts.bodies.join(lists.hint("merge"), KEYS)), "line-told")  # the same plan at every size
        odd = stash(cut.groupBy("h").agg(F.min("chunk").alias("x"), F.max("chunk").alias("y")).where("x <> y").select("h"), "line-odd")
        plain, spans = cut, None
        if odd.limit(1).count():  # hash collisions: what is the first of its bytes stays too
            same = cut.join(odd, "h")
            firsts = same.groupBy("h", "chunk").agg(F.min(place).alias("p"))
            spans = same.join(firsts, ["h", "chunk"]).select(*KEYS, "r", "a", "b", (place != F.col("p")).alias("gone"))
            plain = cut.join(odd, "h", "left_anti")
        ones = plain.where("first").select("h", F.col("before").alias("one_before"), F.col("behind").alias("one_behind"))
        pairs = plain.where("NOT first").join(small(stash(ones, "line-ones")), "h")
        every = extended(pairs).withColumn("gone", F.lit(True)).unionByName(plain.where("first").select(*KEYS, "r", "a", "b", F.lit(False).alias("gone")))
        every = every if spans is None else every.unionByName(spans)
        decided = every.groupBy(*KEYS).agg(F.min("r").alias("r"), F.collect_set(F.struct("a", "b", "gone")).alias("runs"))  # a text's own
        decided = stash(decided, "line-decided", keep=True)
    own = lambda c: f"__line_{c}"
    k1, k2 = text_key(text)
    named = decided.select(*(F.col(c).alias(own(c)) for c in decided.columns)).hint("merge")
    state = docs.withColumns({own("k1"): k1, own("k2"): k2, own("own"): F.xxhash64(id)}).join(named, [own("k1"), own("k2")], "left")
    keep = docs.columns
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(own(c), T.LongType()) for c in ("all", "gone")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, n, gone = [], [], []
            for x, runs, mine in zip(batch.column(text).cast(pa.binary()).to_pylist(), *(batch.column(own(c)).to_pylist() for c in ("runs", "mine")), strict=True):
                lines = x.split(b"\n") if x is not None else []
                out = bytearray(len(lines))
                for r in runs or ():
                    if not mine:
                        out[:] = b"\x01" * len(lines)
                    elif r["gone"]:
                        out[r["a"] : r["b"]] = b"\x01" * (r["b"] - r["a"])
                n.append(len(lines))
                gone.append(sum(out))
                texts.append(b"\n".join(line for line, o in zip(lines, out, strict=True) if not o) if gone[-1] else x)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(new if c == text else batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, own("all"), own("gone")])

    mine = (F.col(own("own")) == F.col(own("r"))).alias(own("mine"))
    out = state.select(*(F.col(f"`{c}`") for c in keep), own("runs"), mine).mapInArrow(run, schema)
    return out if counts else out.drop(own("all"), own("gone"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, lines removed, and the SHA-256 of what stays."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", F.col("__line_all").alias("n_lines"), F.col("__line_gone").alias("n_removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": (op1_line_dedup, None)}
