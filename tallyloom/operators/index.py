"""A stored full-text index: positional postings in blocks, kept in segments that only grow by commits.

A segment is written once.  Its documents are dealt over blocks of about BLOCK: their texts are shuffled once, and a task makes all
postings of a block.  A row of `postings` has a term, a column, a block and, in order of the documents' ids, what the block's documents
have of the term: occurrences, length, places.  Beside them stand the bounds that ranking needs (most occurrences, shortest and longest
document) and `packed`, the documents' places in the block and their occurrences as bytes that compress well: what ranking shuffles.
`docs` has a row for each block: ids, lengths and times; `postings` has it, too, as a row without term.
Parquet keeps the sorted whole numbers as deltas; rows go by block, then by term.

Adding documents writes one new segment; ids that the index already has are put on the delete list of the segments that hold
them.  Segments of like size are merged from their postings, without reading any text.  A commit names the segments and delete
lists; readers see one commit, and of two writers one loses and tries again.

Ranking is lossless: a question's blocks are bounded by their terms' bounds, the few best are scored first, and of the rest only
those whose bound reaches the k-th score so far.  Scores are those of `ranking.top_scores`.  No term, question or posting passes
through the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.commits import Commits, opened, shared_dir
from . import ranking as R

#: Documents of a block, questions that are scored together, blocks that a question tries first, and segments of one size.
BLOCK, QUESTIONS, PROBES, FANOUT = 4096, 256, 4, 4
#: Bytes of text that a block has at most, about: a task holds the postings of one.
BYTES = 48 << 20
#: Rows of a table that may be broadcast: terms of questions, blocks, units of work.
ROWS = 200_000


class Lost(RuntimeError):
    """Another writer has committed since this one began."""


def per_document(docs: DataFrame, id: str, columns: list[str], at: str | None, blocks: int, tasks: int) -> DataFrame:
    """The rows of `postings` of documents, whose texts are dealt by block."""
    when = (F.col(at) if at else F.lit(None)).cast("long").alias("at")
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id)), F.lit(blocks)).cast("int").alias("block"), F.col(id).alias("id"), when, *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    dealt = by_block(dealt, blocks, tasks)
    parts = [R.words_in(dealt, f"c{i}") for i in range(len(columns))]
    rows = dealt.select("block", "id", "at", F.array(*map(F.size, parts)).alias("sizes"), F.concat(*parts).alias("t"))
    names = ["block", "id", "len", "at", "col", "term", "tf", "first", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, id, len, at, col, term, tf, first, places): each term of each column of each document once; a document without any
        term has one row without term.  first: no earlier column has the term."""
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                n, words = batch.num_rows, batch.column("t").flatten().dictionary_encode()
                sizes = np.array(batch.column("sizes").flatten().to_numpy(zero_copy_only=False)).reshape(n, len(columns))
                length = sizes.sum(1)
                column = np.repeat(np.tile(np.arange(len(columns)), n), sizes.ravel())
                owner = np.repeat(np.arange(n), length)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes.ravel()) - sizes.ravel(), sizes.ravel())
                code = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
                order = np.lexsort((place, column, code, owner))
                owner, code, column, place = owner[order], code[order], column[order], place[order]
                new = np.ones(len(order), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]) | (column[1:] != column[:-1])
                begin = np.flatnonzero(new)
                ends = np.append(begin, len(order)).astype(np.int32)
                first = np.ones(len(begin), bool)
                first[1:] = (owner[begin[1:]] != owner[begin[:-1]]) | (code[begin[1:]] != code[begin[:-1]])
                bare = np.flatnonzero(length == 0)  # they count as documents, too
                row = np.concatenate((owner[begin], bare))
                blank = len(bare)
                by = np.argsort(row, kind="stable")  # blocks follow one another
                row = row[by]
                take, sort = pa.array(row), pa.array(by)
                terms = pa.concat_arrays([words.dictionary.take(pa.array(code[begin])).cast(pa.string()), pa.nulls(blank, pa.string())])
                places = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))), pa.array([[]] * blank, pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").take(take), batch.column("id").take(take), pa.array(length[row].astype(np.int32)), batch.column("at").take(take), pa.array(np.concatenate((column[begin], np.zeros(blank))).astype(np.int32)[by]),
                     terms.take(sort), pa.array(np.concatenate((np.diff(ends), np.zeros(blank))).astype(np.int32)[by]), pa.array(np.concatenate((first, np.zeros(blank, bool)))[by]), places.take(sort)],
                    names=names,
                )

    schema = posting_schema(docs.schema[id].dataType)
    return rows.mapInArrow(lambda batches: in_blocks(run(batches), schema), schema)


def by_block(rows: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """rows (block, ...), those of a block side by side in one task."""
    return rows.repartition(max(4 * tasks, blocks), "block").sortWithinPartitions("block")


def posting_schema(kind: T.DataType) -> T.StructType:
    """Of `postings`, for ids of a type.  A row without term has a block's documents."""
    array = lambda t: T.ArrayType(t)
    fields = {"term": T.StringType(), "col": T.IntegerType(), "block": T.IntegerType(), "n": T.LongType(), "fresh": T.LongType(), "cf": T.LongType(), "most": T.IntegerType(), "shortest": T.IntegerType(), "longest": T.IntegerType()}
    fields |= {"ids": array(kind), "lens": array(T.IntegerType()), "tfs": array(T.IntegerType()), "firsts": array(T.BooleanType()), "places": array(array(T.IntegerType())), "packed": T.BinaryType(), "ats": array(T.LongType())}
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def posting_rows(each: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """The rows of `postings`, of (block, id, len, at, col, term, tf, first, places)."""
    schema = posting_schema(each.schema["id"].dataType)
    return by_block(each, blocks, tasks).mapInArrow(lambda batches: in_blocks(batches, schema), schema)


def in_blocks(each: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The postings of rows by block; a block's rows are held."""
    held, now = [], None
    for batch in each:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            if held and block[a] != now:
                yield block_postings(held, schema)
                held = []
            now = block[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield block_postings(held, schema)


def block_postings(pieces: list[pa.RecordBatch], schema: T.StructType) -> pa.RecordBatch:
    t = pa.Table.from_batches(pieces).combine_chunks()
    flat = lambda c: t.column(c).combine_chunks()
    whole = lambda c: flat(c).to_numpy(zero_copy_only=False)
    known = flat("id").dictionary_encode(null_encoding="encode")
    by_id = pc.sort_indices(known.dictionary)
    slot_of = np.empty(len(by_id), np.int64)
    slot_of[by_id.to_numpy()] = np.arange(len(by_id))
    slot, ids = slot_of[known.indices.to_numpy()], known.dictionary.take(by_id)
    lens, ats, timed = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    lens[slot] = whole("len")
    dated = np.flatnonzero(flat("at").is_valid().to_numpy(zero_copy_only=False))
    ats[slot[dated]], timed[slot[dated]] = flat("at").take(pa.array(dated)).to_numpy(), True
    some = np.flatnonzero(flat("term").is_valid().to_numpy(zero_copy_only=False))
    words = flat("term").take(pa.array(some)).dictionary_encode()
    by_word = pc.sort_indices(words.dictionary)
    rank = np.empty(len(by_word), np.int64)
    rank[by_word.to_numpy()] = np.arange(len(by_word))
    word = rank[words.indices.to_numpy()] if len(some) else np.zeros(0, np.int64)
    col = whole("col")[some]
    order = np.lexsort((slot[some], col, word))
    word, col, some = word[order], col[order], some[order]
    slot, tf, length, first = slot[some], whole("tf")[some], lens[slot[some]], whole("first")[some]
    new = np.ones(len(some), bool)
    new[1:] = (word[1:] != word[:-1]) | (col[1:] != col[:-1])
    begin = np.flatnonzero(new)
    ends = np.append(begin, len(some))
    n, m = np.diff(ends), len(begin)
    reduced = lambda how, x: how.reduceat(x, begin) if m else np.zeros(0, np.int64)
    offsets = pa.array(ends.astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(pack(slot, tf, begin, n))])
    held = {
        "term": words.dictionary.take(by_word).take(pa.array(word[begin])).cast(pa.string()), "col": col[begin], "block": np.full(m, whole("block")[0]), "n": n, "fresh": reduced(np.add, first.astype(np.int64)), "cf": reduced(np.add, tf.astype(np.int64)),
        "most": reduced(np.maximum, tf), "shortest": reduced(np.minimum, length), "longest": reduced(np.maximum, length), "ids": pa.ListArray.from_arrays(offsets, ids.take(pa.array(slot))), "lens": pa.ListArray.from_arrays(offsets, pa.array(length)),
        "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))), "firsts": pa.ListArray.from_arrays(offsets, pa.array(first.astype(bool))), "places": pa.ListArray.from_arrays(offsets, flat("places").take(pa.array(some))), "packed": packed,
    }
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x)
    own = {"block": pa.array([int(whole("block")[0])]), "ids": one(ids), "lens": one(pa.array(lens)), "ats": one(pa.array(ats, mask=~timed))}
    arrays = []
    for f in schema:
        kind = to_arrow_type(f.dataType)
        a, b = own.get(f.name, pa.nulls(1, kind)), held.get(f.name, pa.nulls(m, kind))
        arrays.append(pa.concat_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(kind) for x in (a, b)]))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def pack(slot: np.ndarray, tf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> bytes:
    """Of groups of numbers (begin, n): the steps of `slot`, then `tf`, each as four rows of bytes, low ones first; most are 0 or 1."""
    step = np.diff(slot, prepend=0)
    step[begin] = slot[begin]
    many = np.repeat(n, n)
    at = np.repeat(begin, n) * 8 + np.arange(len(slot)) - np.repeat(begin, n)
    out = np.zeros(len(slot) * 8, np.uint8)
    for k, x in enumerate((step, tf)):
        for i in range(4):
            out[at + (4 * k + i) * many] = (x >> 8 * i) & 255
    return out.tobytes()


def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """slot and tf of one group that `pack` made."""
    rows = np.frombuffer(held, np.uint8).reshape(8, -1).astype(np.int64)
    step, tf = (rows[k] | rows[k + 1] << 8 | rows[k + 2] << 16 | rows[k + 3] << 24 for k in (0, 4))
    return np.cumsum(step), tf


@dataclass
class Segment:
    name: str
    docs: int
    words: int
    dead: list[str]


class TextIndex:
    """The index in a folder, at its last commit when opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Commits(spark, self.folder)
        self.number, state = self.commits.last()
        state = state or {"columns": [], "segments": []}
        self.columns: list[str] = state["columns"]
        self.segments = [Segment(**s) for s in state["segments"]]

    # ---- writing

    def add(self, docs: DataFrame, id: str, columns: list[str], at: str | None = None, block: int = BLOCK) -> TextIndex:
        """The index with these documents (ids once each) in a new segment, in place of those it had under their ids."""
        if self.columns and self.columns != columns:
            raise ValueError(f"the index has the columns {self.columns}")
        dead = self._dead(docs.select(F.col(id).alias("id"))) if self.segments else {}
        long = [F.size(c) * 8 if isinstance(docs.schema[c].dataType, T.ArrayType) else F.octet_length(c) for c in columns]
        many, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in long), F.lit(0))), F.lit(0))).first()
        rows = per_document(docs, id, columns, at, max(1, math.ceil(many / block), math.ceil(size / BYTES)), self.spark.sparkContext.defaultParallelism)
        return self._commit(columns, self._alive(dead) + [self._write(rows)])

    def delete(self, ids: DataFrame) -> TextIndex:
        """The index without the documents of some ids (id)."""
        return self._commit(self.columns, self._alive(self._dead(ids.select("id"))))

    def merge(self, all: bool = False, block: int = BLOCK) -> TextIndex:
        """The index with FANOUT or more segments of like size made one, without what is deleted in them; all: every one."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            tiers.setdefault(0 if all else int(math.log(max(s.docs, 1), FANOUT)), []).append(s)
        for _, own in sorted(tiers.items()):
            if len(own) >= (1 if all else FANOUT):
                each = self._each(own)
                blocks = max(1, math.ceil(sum(s.docs for s in own) / block), math.ceil(sum(s.words for s in own) * 8 / BYTES))
                dealt = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
                new = self._write(posting_rows(dealt, blocks, self.spark.sparkContext.defaultParallelism))
                names = {s.name for s in own}
                return self._commit(self.columns, [s for s in self.segments if s.name not in names] + [new])
        return self

    def _write(self, rows: DataFrame) -> Segment:
        name = uuid.uuid4().hex
        path = f"{self.folder}/{name}"
        keep = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
        rows.write.options(**keep).parquet(f"{path}/postings")
        held = self.spark.read.schema(rows.schema).parquet(f"{path}/postings").where("term IS NULL")
        held.select("block", "ids", "lens", "ats", F.array_max("ats").alias("newest")).write.options(**keep).parquet(f"{path}/docs")
        total = self.spark.read.parquet(f"{path}/docs").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("w")).first()
        return Segment(name, total["n"] or 0, total["w"] or 0, [])

    def _each(self, segments: list[Segment]) -> DataFrame:
        """What `per_document` gave for the living documents of segments, from their postings."""
        out = None
        for s in segments:
            zipped = self._read(s, "postings").where("term IS NOT NULL").select("block", "term", "col", F.explode(F.arrays_zip("ids", "lens", "tfs", "firsts", "places")).alias("z"))
            some = zipped.select("block", F.col("z.ids").alias("id"), F.col("z.lens").alias("len"), "col", "term", F.col("z.tfs").alias("tf"), F.col("z.firsts").alias("first"), F.col("z.places").alias("places"))
            docs = self._read(s, "docs").select("block", F.explode(F.arrays_zip("ids", "lens", "ats")).alias("z")).select("block", F.col("z.ids").alias("id"), F.col("z.lens").alias("len"), F.col("z.ats").alias("at"))
            if s.dead:
                dead = self._dead_rows(s).select("block", "id")
                some, docs = (x.join(dead, ["block", "id"], "left_anti") for x in (some, docs))
            held = docs.select("block", "id", "len", "at", F.lit(0).alias("col"), F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), F.lit(False).alias("first"), F.array().cast("array<int>").alias("places"))
            both = held.unionByName(some.withColumn("at", F.lit(None).cast("long")))
            out = both if out is None else out.unionByName(both)
        return out

    def _dead(self, ids: DataFrame) -> dict[str, tuple[str, int, int]]:
        """Delete lists for these ids: segment -> (name, documents, words)."""
        out = {}
        for s in self.segments:
            rows = self._read(s, "docs").select("block", F.explode(F.arrays_zip("ids", "lens")).alias("z")).select("block", F.col("z.ids").alias("id"), F.col("z.lens").alias("len"))
            gone = rows.join(ids.distinct(), "id", "left_semi")
            if s.dead:
                gone = gone.join(self._dead_rows(s).select("id"), "id", "left_anti")
            name = f"dead-{uuid.uuid4().hex}"
            gone.write.parquet(f"{self.folder}/{s.name}/{name}")
            n, words = self.spark.read.schema(gone.schema).parquet(f"{self.folder}/{s.name}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            if n:
                out[s.name] = (name, n, words)
        return out

    def _alive(self, dead: dict[str, tuple[str, int, int]]) -> list[Segment]:
        out = []
        for s in self.segments:
            name, n, words = dead.get(s.name, (None, 0, 0))
            out.append(Segment(s.name, s.docs - n, s.words - words, s.dead + ([name] if name else [])))
        return [s for s in out if s.docs]

    def _commit(self, columns: list[str], segments: list[Segment]) -> TextIndex:
        if not self.commits.put(self.number + 1, {"columns": columns, "segments": [s.__dict__ for s in segments]}):
            raise Lost(f"commit {self.number + 1} has been made by another writer")
        return TextIndex(self.spark, self.folder)

    # ---- reading

    def _read(self, s: Segment, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{s.name}/{name}")

    def _dead_rows(self, s: Segment) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{s.name}/{d}" for d in s.dead))

    def _all(self, name: str, *columns: str) -> DataFrame:
        """A table of all segments, with `seg`."""
        parts = [self._read(s, name).select(F.lit(s.name).alias("seg"), *columns) for s in self.segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _deleted(self) -> DataFrame | None:
        """(seg, block, id) of all delete lists."""
        out = None
        for s in self.segments:
            if s.dead:
                one = self._dead_rows(s).select(F.lit(s.name).alias("seg"), "block", "id")
                out = one if out is None else out.unionByName(one)
        return out

    def size(self) -> tuple[int, float]:
        """Documents and their mean length."""
        n = sum(s.docs for s in self.segments)
        return n, sum(s.words for s in self.segments) / n if n else 0.0

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df, cf, longest) of the asked terms (term) that living documents have."""
        wanted = bounded(terms.select("term").distinct())
        meta = self._all("postings", "term", "block", "fresh", "cf", "longest").join(wanted, "term")
        dead = self._deleted()
        if dead is not None:  # blocks with deleted documents are counted document by document
            hurt = dead.select("seg", "block").distinct()
            rows = self._all("postings", "term", "block", "ids", "lens", "tfs", "firsts").join(bounded(hurt), ["seg", "block"]).join(wanted, "term")
            rows = rows.select("seg", "block", "term", F.explode(F.arrays_zip("ids", "lens", "tfs", "firsts")).alias("z")).select("seg", "block", "term", F.col("z.ids").alias("id"), F.col("z.firsts").cast("long").alias("fresh"), F.col("z.tfs").cast("long").alias("cf"), F.col("z.lens").alias("longest"))
            live = rows.join(dead, ["seg", "block", "id"], "left_anti").select("term", "fresh", "cf", "longest")
            meta = meta.join(hurt, ["seg", "block"], "left_anti").select("term", "fresh", "cf", "longest").unionByName(live)
        return meta.groupBy("term").agg(F.sum("fresh").alias("df"), F.sum("cf").alias("cf"), F.max("longest").alias("longest")).where("df > 0")

    def top(self, terms: DataFrame, k: int, least: int = 1, pairs: bool = False, age: tuple[int, float] | None = None, weights: dict[str, float] | None = None, every: bool = False, within: DataFrame | None = None, corpus: tuple[int, float] | None = None, df: DataFrame | None = None) -> DataFrame:
        """(q, doc, score, words, rank) as `ranking.top_scores` has them, for questions (q, term).

        age: (now, per): a point less for each `per` of time since a document's.  every: also (needs a word of each question's terms)
        the k best documents with all its words; then the rows have `need`, the number of its terms, and no rank.  within: only these
        documents (id) are ranked; corpus, df: other numbers than the index's own for documents, mean length and frequencies."""
        if not self.segments:
            kind, last = terms.schema["q"].dataType.simpleString(), "need long" if every else "rank int"
            return self.spark.createDataFrame([], f"q {kind}, doc long, score double, words long, {last}")
        n, mean = corpus or self.size()
        raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = terms.select("q", "term").distinct()
        need = asked.groupBy("q").agg(F.count(F.lit(1)).alias("need"))
        known = self.frequencies(asked) if df is None else df
        asked = cut(asked.join(known.select("term", "df"), "term").join(need, "q").withColumn("idf", F.when(raw > 0, raw).otherwise(F.lit(1e-6))).drop("df"))
        groups = max(1, math.ceil(asked.select("q").distinct().count() / QUESTIONS))
        asked = asked.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
        heavy = F.lit(1.0) if weights is None else F.element_at(F.array(*(F.lit(float(weights[c])) for c in self.columns)), F.col("col") + 1)
        score = lambda chosen: self._scored(asked, groups, chosen, k, least, pairs, age, heavy, mean, every, within)
        if self._all("docs", "block").count() <= PROBES:
            found = score(None)
        else:
            sat = F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("shortest") / F.lit(mean or 1.0)))
            meta = self._all("postings", "term", "col", "block", "most", "shortest").join(bounded(asked.select("term").distinct()), "term")
            meta = meta.groupBy("seg", "block", "term").agg(F.sum(F.col("most") * heavy).alias("tf"), F.min("shortest").alias("shortest"))
            bound = meta.join(bounded(asked), "term").groupBy("q", "seg", "block").agg(F.sum(F.col("idf") * sat).alias("s"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
            bound = bound.withColumn("s", F.col("s") * (F.col("m") - 1)) if pairs else bound
            if age is not None:
                bound = bound.join(self._all("docs", "block", "newest"), ["seg", "block"]).withColumn("s", F.col("s") - (F.lit(age[0]) - F.col("newest")) / F.lit(float(age[1])))
            order = W.partitionBy("q").orderBy(F.col("s").desc(), "seg", "block")
            bound = cut(bound.withColumn("n", F.row_number().over(order)))
            first = cut(score(bound.where(F.col("n") <= PROBES).select("q", "seg", "block")))
            reached = first.where(F.col("words") >= F.col("need")) if every else first  # the list that has fewer decides
            by = W.partitionBy("q").orderBy(F.col("score").desc(), "doc")
            floor = reached.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("q", F.col("score").alias("floor"))
            rest = bound.where(F.col("n") > PROBES).join(floor, "q", "left").where(F.col("floor").isNull() | (F.col("s") + 2e-6 >= F.col("floor")))
            self.tried = (bound.where(F.col("n") <= PROBES), rest)
            found = first.unionByName(score(rest.select("q", "seg", "block")))
        return found if every else R.ranked(found.drop("need"), "score", "doc", k=k)

    def _scored(self, asked: DataFrame, groups: int, chosen: DataFrame | None, k: int, least: int, pairs: bool, age: tuple | None, heavy: Column, mean: float, every: bool, within: DataFrame | None) -> DataFrame:
        """(q, doc, score, words, need): the k best of each question and block; chosen: the blocks (q, seg, block), else all.

        A group of questions meets a block in one place: rows of 0 the block's documents, 1 those within, 2 the deleted, 3 the chosen
        questions, 4 postings.  Of these only those of asked terms in chosen blocks are shuffled, packed."""
        own = self._all("postings", "term", "col", "block", "packed").withColumn("w", heavy)
        say = F.collect_list(F.struct("q", "need")).alias("qs")  # the questions of a group that ask for a term
        work = own.join(bounded(asked.groupBy("g", "term", "idf").agg(say)), "term")
        if chosen is None:
            to_units = lambda rows: rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        else:
            picked = chosen.join(asked.select("q", "g", "need").distinct(), "q").groupBy("g", "seg", "block").agg(say)
            units = bounded(picked.select("g", "seg", "block"))
            work = work.join(units, ["g", "seg", "block"], "left_semi")
            to_units = lambda rows: rows.join(units, ["seg", "block"])
        kind, qs = self._read(self.segments[0], "docs").schema["ids"].dataType, work.schema["qs"].dataType
        columns = {"term": "string", "w": "double", "idf": "double", "qs": qs, "ids": kind, "nums": "array<int>", "ats": "array<bigint>", "packed": "binary"}
        shaped = lambda rows, part: rows.select("g", "seg", "block", F.lit(part).alias("part"), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
        rows = shaped(work, 4).unionByName(shaped(to_units(self._all("docs", "block", "ids", "lens", "ats").withColumnRenamed("lens", "nums")), 0))
        if chosen is not None:
            rows = rows.unionByName(shaped(picked, 3))
        listed = lambda df: to_units(df.groupBy("seg", "block").agg(F.collect_list("id").cast(kind).alias("ids")))  # noqa: E731 - a block's documents
        if within is not None:
            every_id = self._all("docs", "block", "ids").select("seg", "block", F.explode("ids").alias("id"))
            rows = rows.unionByName(shaped(listed(every_id.join(within.select("id").distinct(), "id", "left_semi")), 1))
        dead = self._deleted()
        if dead is not None:
            rows = rows.unionByName(shaped(listed(dead), 2))
        limited = within is not None
        schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("doc", kind.elementType), T.StructField("score", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("need", T.LongType())])
        arrow = [to_arrow_type(f.dataType) for f in schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, unit = None, None
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "seg", "block")), strict=True))
                part, term, w, idf, asks, packed = (batch.column(c).to_pylist() for c in ("part", "term", "w", "idf", "qs", "packed"))
                cell = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                for i, key in enumerate(keys):
                    if key != now:
                        if unit is not None:
                            yield unit.best(k, least, pairs, every, arrow, schema.names)
                        now, unit = key, None
                    if part[i] == 0:
                        unit = Unit(cell("ids", i), cell("nums", i), batch.column("ats")[i].values.to_numpy(zero_copy_only=False), mean, age, not limited)
                    elif part[i] < 3:
                        unit.open(cell("ids", i), part[i] == 1)
                    elif part[i] == 3:
                        unit.only = {x["q"] for x in asks[i]}
                    else:
                        unit.add(term[i], w[i], idf[i], asks[i], *unpacked(packed[i]))
            if unit is not None:
                yield unit.best(k, least, pairs, every, arrow, schema.names)

        return rows.repartition("g", "seg", "block").sortWithinPartitions("g", "seg", "block", "part", "term").mapInArrow(run, schema)

    def phrases(self, phrase: DataFrame) -> DataFrame:
        """(q, doc, tf): places where the words of (q, i, term; i from 0) stand side by side in one column."""
        if not self.segments:
            return self.spark.createDataFrame([], T.StructType([phrase.schema["q"], T.StructField("doc", T.LongType()), T.StructField("tf", T.LongType())]))
        size = phrase.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
        asked = phrase.select("q", F.col("i").cast("int").alias("i"), "term").join(size, "q").groupBy("term").agg(F.collect_list(F.struct("q", "i", "n")).alias("qs"))
        # a block's rows meet in one place: 0 its documents, 1 the deleted, 2 postings of asked words, each once
        work = self._all("postings", "term", "col", "block", "packed", F.flatten("places").alias("places")).join(bounded(asked), "term")
        held = self._all("docs", "block", "ids")
        kind, qs = held.schema["ids"].dataType, work.schema["qs"].dataType
        columns = {"term": "string", "col": "int", "qs": qs, "ids": kind, "places": "array<int>", "packed": "binary"}
        shaped = lambda rows, part: rows.select("seg", "block", F.lit(part).alias("part"), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
        rows = shaped(work, 2).unionByName(shaped(held, 0))
        dead = self._deleted()
        if dead is not None:
            rows = rows.unionByName(shaped(dead.groupBy("seg", "block").agg(F.collect_list("id").cast(kind).alias("ids")), 1))  # a block's documents
        schema = T.StructType([phrase.schema["q"], T.StructField("doc", kind.elementType), T.StructField("tf", T.LongType())])
        arrow = [to_arrow_type(f.dataType) for f in schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, gone, spots, asks = None, None, set(), {}, {}

            def best() -> pa.RecordBatch:
                out = [[], [], []]
                for q, tfs in together(spots, asks):
                    own = ids.take(pa.array(np.fromiter(tfs, np.int64, len(tfs)))).to_pylist()
                    some = [(d, tf) for d, tf in zip(own, tfs.values(), strict=True) if d not in gone]
                    out[0] += [q] * len(some)
                    out[1] += [d for d, _ in some]
                    out[2] += [tf for _, tf in some]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names=schema.names)

            for batch in batches:
                seg, block, part, term, col, said, packed = (batch.column(c).to_pylist() for c in ("seg", "block", "part", "term", "col", "qs", "packed"))
                for i, key in enumerate(zip(seg, block, strict=True)):
                    if key != now:
                        if now is not None:
                            yield best()
                        now, ids, gone, spots, asks = key, None, set(), {}, {}
                    if part[i] == 0:
                        ids = batch.column("ids")[i].values
                    elif part[i] == 1:
                        gone = set(batch.column("ids")[i].as_py())
                    else:
                        slots, tfs = unpacked(packed[i])
                        spots[term[i], col[i]] = (np.repeat(slots, tfs) << 32) + batch.column("places")[i].values.to_numpy(zero_copy_only=False)
                        for x in said[i]:
                            asks.setdefault((x["q"], x["n"]), {})[x["i"]] = term[i]
            if now is not None:
                yield best()

        return rows.repartition("seg", "block").sortWithinPartitions("seg", "block", "part", "term", "col").mapInArrow(run, schema)


def together(spots: dict[tuple[str, int], np.ndarray], asks: dict[tuple, dict[int, str]]) -> Iterator[tuple]:
    """(q, {slot: places}) of phrases (q, n): {i: term} whose words stand side by side; spots: of (term, column), slot << 32 | place, in order."""
    for (q, n), words in asks.items():
        found: dict[int, int] = {}
        for col in {c for t, c in spots if t == words.get(0)} if len(words) == n else ():  # a block that lacks a word has none
            every = sorted(((spots.get((t, col), np.zeros(0, np.int64)), i) for i, t in words.items()), key=lambda x: len(x[0]))
            left = every[0][0] - every[0][1]
            for own, i in every[1:]:
                at = np.searchsorted(own, left + i)
                left = left[own[np.minimum(at, len(own) - 1)] == left + i] if len(own) else left[:0]
            slots, many = np.unique(left >> 32, return_counts=True)
            for d, tf in zip(slots.tolist(), many.tolist(), strict=True):
                found[d] = found.get(d, 0) + tf
        if found:
            yield q, found


class Unit:
    """Scores of a group of questions in one block of documents; of the postings only one term's are held."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, ats: np.ndarray, mean: float, age: tuple | None, open_: bool):
        self.ids, self.numbers = ids, ids.dtype.kind in "iu"
        self.place = None if self.numbers else {d: i for i, d in enumerate(ids)}
        self.norm = R.K1 * (1 - R.B + R.B * lens / (mean or 1.0))
        self.age = None if age is None else (age[0] - ats.astype(float)) / age[1]
        self.living = np.full(len(ids), open_)
        self.only: set | None = None
        self.questions: list = []
        self.row: dict = {}
        self.needs: list[int] = []
        self.score, self.words = np.zeros((8, len(ids))), np.zeros((8, len(ids)), np.int32)
        self.term, self.held = None, None

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids) if self.numbers else np.fromiter((self.place[d] for d in ids), np.int64, len(ids))

    def open(self, ids: np.ndarray, living: bool) -> None:
        self.living[self.at(ids)] = living

    def add(self, term: str, weight: float, idf: float, asks: list[dict], slots: np.ndarray, tfs: np.ndarray) -> None:
        """A column's postings of a term; those of a term follow one another."""
        if term != self.term:
            self.flush()
            self.term, self.idf, self.held = term, idf, np.zeros(len(self.ids))
            self.rows = []
            for x in asks:
                if self.only is not None and x["q"] not in self.only:
                    continue
                if x["q"] not in self.row:
                    self.row[x["q"]] = len(self.questions)
                    self.questions.append(x["q"])
                    self.needs.append(x["need"])
                self.rows.append(self.row[x["q"]])
            while len(self.questions) > len(self.score):
                self.score, self.words = np.concatenate((self.score, np.zeros_like(self.score))), np.concatenate((self.words, np.zeros_like(self.words)))
        self.held[slots] += weight * tfs

    def flush(self) -> None:
        if self.held is not None and self.rows:
            some = np.flatnonzero(self.held)
            tf = self.held[some]
            where = np.ix_(self.rows, some)
            self.score[where] += self.idf * tf * (R.K1 + 1) / (tf + self.norm[some])
            self.words[where] += 1
        self.held = None

    def best(self, k: int, least: int, pairs: bool, every: bool, kinds: list, names: list[str]) -> pa.RecordBatch:
        self.flush()
        n = len(self.questions)
        score, words, needs = self.score[:n], self.words[:n], np.array(self.needs, np.int64)
        if pairs:
            score = score * (words - 1)
        score = np.round(score if self.age is None else score - self.age, 6)
        score[(words < least) | ~self.living] = -np.inf
        chosen, last = np.zeros(score.shape, bool), max(0, len(self.ids) - k)
        for x in [score, np.where(words >= needs[:, None], score, -np.inf)] if every else [score]:
            chosen |= (x >= np.partition(x, last, axis=1)[:, last : last + 1]) & np.isfinite(x)
        j, i = np.nonzero(chosen)
        out = [[self.questions[x] for x in j], self.ids[i].tolist(), score[j, i], words[j, i].astype(np.int64), needs[j] if n else np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(ROWS + 1).count() <= ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """df, worked out and kept in the checkpoint folder: it is read more than once."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept_folder(spark: SparkSession, name: str, path: str) -> str:
    """The folder, below the shared one, for what is made of a table's files as they are now."""
    store, at = opened(spark, path)
    files = store.listFiles(at, True)
    said = [name, path]
    while files.hasNext():
        f = files.next()
        said += [f.getPath().toString(), str(f.getLen()), str(f.getModificationTime())]
    return f"{shared_dir(spark)}/index-{name}-{hashlib.sha256(chr(10).join(said).encode()).hexdigest()[:16]}"


def stored(spark: SparkSession, name: str, path: str, docs: Callable[[], tuple[DataFrame, str, list[str], str | None]]) -> TextIndex:
    """The index of a table's texts, kept in the shared folder and built where there is none for its files as they are now.

    docs: what `add` takes."""
    index = TextIndex(spark, kept_folder(spark, f"{name}-packed", path))
    if index.number >= 0:
        return index
    try:
        return index.add(*docs())
    except Lost:
        return TextIndex(spark, index.folder)
