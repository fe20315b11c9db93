"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two word-bigram models with the same vocabulary, order and smoothing: the target from documents labelled good and not toxic,
the background from all documents.  Tokens are words with A-Z lower-cased.  The shared vocabulary holds the most frequent words of all
documents, whole classes of frequency (16 to a doubling) as long as they are VOCABULARY words at most, a class for all other
words, and a mark of the start.

    p1(w) = (n(w) + 1) / (n + V + 1);   p2(w|v) = (n(vw) + m p1(w)) / (n(v.) + m)

A document's score is the mean over its words of -ln p2 by the target, less that by the background: negative for text nearer
the target.  Only the vocabulary, of documented size, is broadcast.  The bigram table grows with the corpus and is never
in one place: documents are worked on in slices, a slice's distinct bigrams go to the part of the table that they hash to,
and the totals of those that other slices have, too, come back.  A part holds about ENTRIES of them, for any corpus.

Null and blank texts have no tokens and score 0.  Labels of unknown documents and null labels have no effect; a document
labelled more than once is target if any of its labels makes it so.  Repeated rows count, and are scored, one by one.
Without target rows the target model is uniform.  Words are told apart by hashes of 64 bits.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, slices, small, stash, table

VOCABULARY, MASS = 1 << 18, 4.0
SLICE, ENTRIES = 16 << 20, 4 << 20
WIDTH = 19  # bits of a word's number
CODES = (1 << 2 * WIDTH) - 1
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def texts_in(batch: pa.RecordBatch, text: str, flag: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, words of each text, and whether each text is target."""
    found = [word_hashes(x or b"") for x in batch.column(text).cast(pa.binary()).to_pylist()]
    flags = np.array([bool(x) for x in batch.column(flag).to_pylist()])
    return np.concatenate(found), np.array([len(x) for x in found], np.int64), flags


def word_counts(docs: DataFrame, text: str, flag: str, most: int) -> DataFrame:
    """(w, n, t, cn, ct): occurrences of a word in all and in target documents, and those that another word follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            words, size, flags = texts_in(batch, text, flag)
            found, at = np.unique(words, return_inverse=True)
            target = np.repeat(flags, size)
            follows = np.ones(len(words), bool)
            follows[np.cumsum(size)[size > 0] - 1] = False
            cols = [np.bincount(at[m], minlength=len(found)) for m in (slice(None), target, follows, follows & target)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, cols)], names=["w", "n", "t", "cn", "ct"])

    each = docs.select(text, flag).mapInArrow(run, "w long, n long, t long, cn long, ct long")
    return each.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n", "t", "cn", "ct")))


def frequency_class(n):
    return F.floor(F.log2(n.cast("double")) * 16).cast("int")


class Vocabulary:
    """Sorted hashes of the words, and their counts, the other words' after them; log probabilities of words."""

    def __init__(self, words: np.ndarray, counts: dict[str, np.ndarray], totals: dict[str, int], starts: tuple[int, int]):
        order = np.argsort(words)
        self.words = words[order]
        self.other, self.start = len(words), len(words) + 1
        rest = {k: np.append(counts[k][order], totals[k] - counts[k].sum()).astype(np.float64) for k in counts}
        self.p = [(rest[k] + 1) / (totals[k] + len(words) + 1) for k in ("n", "t")]
        self.before = [np.append(rest[k], s) for k, s in zip(("cn", "ct"), starts, strict=True)]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, self.other)

    def bigrams(self, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A word and the one before it in one number, spread evenly over CODES."""
        before = np.concatenate(([self.start], numbers[:-1])) if len(numbers) else numbers
        before[(np.cumsum(size) - size)[size > 0]] = self.start
        return (before.astype(np.uint64) << np.uint64(WIDTH) | numbers.astype(np.uint64)) * np.uint64(_ODD) & np.uint64(CODES)

    def losses(self, codes: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """-ln p2 of bigrams by background and target, from their counts."""
        pair = codes * np.uint64(_BACK) & np.uint64(CODES)
        v, w = (pair >> np.uint64(WIDTH)).astype(np.int64), (pair & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        return [-np.log((c + MASS * p[w]) / (b[v] + MASS)) for c, p, b in zip(counts, self.p, self.before, strict=True)]


def pack(codes: np.ndarray, *counts: np.ndarray) -> bytes:
    """Ascending codes as differences, and counts, compressed."""
    raw = b"".join([np.diff(codes, prepend=np.uint64(0)).tobytes(), *(c.astype(np.int64).tobytes() for c in counts)])
    return struct.pack("<qq", len(raw), len(codes)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    size, n = struct.unpack_from("<qq", blob)
    raw = pa.decompress(blob[16:], size, codec="zstd", asbytes=True)
    codes, *counts = np.frombuffer(raw, np.int64).reshape(-1, n)
    return [np.cumsum(codes.view(np.uint64), dtype=np.uint64), *counts]


def own_counts(codes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the place of each code among them, and their counts in all and in target documents."""
    found, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    return found, at, n, np.bincount(at[target], minlength=len(found))


PARTS = "slice long, part int, blob binary"


def sliced(docs: DataFrame, id: str, text: str, flag: str, model, bits: int, most: int) -> DataFrame:
    """PARTS: each slice's documents as word numbers (part -1), and its bigrams by part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            words, size, flags = texts_in(batch, text, flag)
            numbers = model.value.numbers(words)
            codes, _, n, t = own_counts(model.value.bigrams(numbers, size), np.repeat(flags, size))
            rows = pa.RecordBatch.from_arrays([batch.column(id), pa.array(size), pa.array(flags)], names=["id", "size", "target"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            head, raw = sink.getvalue().to_pybytes(), numbers.astype(np.int32).tobytes()
            blobs = [struct.pack("<qq", len(head), len(raw)) + head + pa.compress(raw, codec="zstd", asbytes=True)]
            edge = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(2 * WIDTH - bits))
            parts = [(k, a, b) for k, (a, b) in enumerate(zip(edge, [*edge[1:], len(codes)], strict=True)) if b > a]
            blobs += [pack(codes[a:b], n[a:b], t[a:b]) for _, a, b in parts]
            named = pa.array([uuid.uuid4().int >> 65] * len(blobs), pa.int64())  # only stored slices are ever read, so a repeated task does no harm
            yield pa.RecordBatch.from_arrays([named, pa.array([-1, *(k for k, _, _ in parts)], pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "part", "blob"])

    return docs.select(id, text, flag).mapInArrow(run, PARTS)


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[tuple]]:
    """Rows (slice, part, blob), in order of `by`, one group at a time."""
    held: list[tuple] = []
    k = 0 if by == "slice" else 1
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "blob")), strict=True):
            if held and held[-1][k] != row[k]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def totals(parts: DataFrame, bits: int) -> DataFrame:
    """PARTS: for each slice the totals of its bigrams that have other occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "part"):
            own = [unpack(blob) for _, _, blob in rows]
            found, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
            sums = []
            for k in (1, 2):
                total = np.zeros(len(found), np.int64)
                np.add.at(total, at, np.concatenate([x[k] for x in own]))
                sums.append(total[at])
            start = 0
            for (name, part, _), (codes, n, t) in zip(rows, own, strict=True):
                alln, allt = (s[start : start + len(codes)] for s in sums)
                start += len(codes)
                more = (alln != n) | (allt != t)
                if more.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([part], pa.int32()), pa.array([pack(codes[more], alln[more], allt[more])], pa.binary())], names=["slice", "part", "blob"])

    return parts.where("part >= 0").repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(run, PARTS)


def target_flag(docs: DataFrame, labels: DataFrame, id: str, flag: str) -> DataFrame:
    """docs and whether any label makes a document target.  Ids are broadcast only if they are few; else both sides are shuffled."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) <> 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__lm_id")).distinct().withColumn(flag, F.lit(True))
    return docs.join(small(good), F.col(id) == F.col("__lm_id"), "left").drop("__lm_id")


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, slice_bytes: int = SLICE) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score); losses are means over a document's words, in nats."""
    spark = docs.sparkSession
    if vocabulary > (1 << WIDTH) - 2:
        raise ValueError(f"at most {(1 << WIDTH) - 2} words")
    flag = "__lm_target"
    schema = T.StructType([docs.schema[id]] + [T.StructField(k, T.LongType() if k == "n_tokens" else T.DoubleType()) for k in ("n_tokens", "target_loss", "background_loss", "score")])
    with scratch():
        flagged = target_flag(docs.select(id, text), labels, id, flag)
        words = stash(word_counts(flagged, text, flag, slice_bytes), "lm-words")
        names = ("n", "t", "cn", "ct")
        sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first().asDict()
        level = words.withColumn("level", frequency_class(F.col("n")))
        kept, least = 0, None
        for r in level.groupBy("level").count().orderBy(F.desc("level")).collect():  # 16 x 64 rows at most
            if kept + r["count"] > vocabulary:
                break
            kept, least = kept + r["count"], r["level"]
        most = level.where(F.lit(False) if least is None else F.col("level") >= least).toPandas()  # VOCABULARY rows at most
        starts = tuple(sums[a] - sums[b] for a, b in (("n", "cn"), ("t", "ct")))  # each text with words has one last word
        model = spark.sparkContext.broadcast(Vocabulary(most["w"].to_numpy(np.int64).view(np.uint64), {k: most[k].to_numpy(np.int64) for k in names}, sums, starts))
        bits = max(4, (-(-sums["n"] // ENTRIES) - 1).bit_length())
        parts = stash(sliced(flagged, id, text, flag, model, bits, slice_bytes), "lm-slices")
        back = stash(totals(parts, bits), "lm-totals")
        count = parts.where("part < 0").count()
        both = parts.where("part < 0").union(back).repartition(max(1, count), "slice").sortWithinPartitions("slice", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in grouped(batches, "slice"):
                of, blob = model.value, rows[0][2]
                head, raw = struct.unpack_from("<qq", blob)
                docs_ = next(iter(pa.ipc.open_stream(blob[16 : 16 + head])))
                numbers = np.frombuffer(pa.decompress(blob[16 + head :], raw, codec="zstd", asbytes=True), np.int32).astype(np.int64)
                size = docs_.column("size").to_numpy()
                codes, at, n, t = own_counts(of.bigrams(numbers, size), np.repeat(np.array(docs_.column("target").to_pylist(), bool), size))
                for _, _, more in rows[1:]:
                    some, alln, allt = unpack(more)
                    where = np.searchsorted(codes, some)
                    n[where], t[where] = alln, allt
                doc = np.repeat(np.arange(len(size)), size)
                b, g = (np.bincount(doc, x[at], len(size)) / np.maximum(size, 1) for x in of.losses(codes, (n, t)))
                yield pa.RecordBatch.from_arrays([docs_.column("id"), pa.array(size), pa.array(g), pa.array(b), pa.array(g - b)], names=schema.names)

        return stash(both.mapInArrow(run, schema), "lm-scores", keep=True)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *(F.round(c, 5).alias(c) for c in ("target_loss", "background_loss", "score")))


QUERIES = {"op5_lm_score": (op5_lm_score, None)}
