"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

Items are the index's documents, passages its queries.  A passage is a window of twice the longest item's words, moved by
that length, so each occurrence of an item lies inside one.  A term's weight in an item is its BM25 share of the item's
score for itself: an item that a passage holds completely scores 1.  All items of at least `least` are retrieved (no top-k).
Items of similar length share a shelf, with lists and passages of their own, so that bounds are near.

Posting lists are cut into blocks with their greatest weight.  WAND moves the lists' pivot by the terms' greatest weights,
then by those of the blocks, and only scores items that can reach the threshold.  Before, running sums of the terms'
greatest weights, each term once in each half of a passage, rule out passages in which no item could reach it.

A retrieved item is verified on its words in the whole text: question (all but the last sentence) and answer (the last
sentence) must both overlap by `overlap` of their shingles of five words (fewer words: the whole).

Items are a stated query set: they are taken in blocks of ITEMS, each its own broadcast index with statistics of all
items, so memory is bounded whatever their number.  Words are compared lower-cased and without outer punctuation.
Null and blank texts and items match nothing.  Repeated rows are judged one by one; repeated item ids keep one row each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stash, table

K1, B = 1.2, 0.75
LEAST, OVERLAP, SHINGLE = 0.6, 0.8, 5
ITEMS, SHELVES, POSTINGS = 20_000, 12, 8
_OUTER = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_SENTENCE = regex.compile(r"(?<=[.!?…])\s+")


class _Terms(dict):
    """Normal form of a word; kept while they are few."""

    def __missing__(self, word: str) -> str:
        out = _OUTER.sub("", word.lower())
        if len(self) > 200_000:
            self.clear()
        self[word] = out
        return out


_TERMS = _Terms()


def terms(text: str) -> list[str]:
    return [t for t in map(_TERMS.__getitem__, text.split()) if t]


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the last sentence with words is the answer."""
    said = [s for s in map(terms, _SENTENCE.split(text)) if s]
    return [w for s in said[:-1] for w in s], said[-1] if said else []


class Shelf:
    """Posting lists of items of similar length: item numbers, weights, greatest weight, greatest weight and last item of each block."""

    def __init__(self, entries: list[tuple[int, dict[int, float]]], longest: int, size: int):
        self.items, self.longest, self.lists = [i for i, _ in entries], longest, {}
        raw: dict[int, tuple[list, list]] = {}
        for number, (_, own) in enumerate(entries):
            for t, w in own.items():
                at = raw.setdefault(t, ([], []))
                at[0].append(number)
                at[1].append(w)
        self.bound = np.zeros(size)
        for t, (docs, weights) in raw.items():
            blocks = [(max(weights[i : i + POSTINGS]), docs[min(i + POSTINGS, len(docs)) - 1]) for i in range(0, len(docs), POSTINGS)]
            self.lists[t] = (docs, weights, max(weights), blocks)
            self.bound[t] = max(weights)

    def search(self, query: set[int], least: float) -> list[tuple[int, float]]:
        """All items whose weights of the query's terms sum to `least` or more."""
        cursors = [[0, self.lists[t]] for t in query]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][0][c[0]])
            total, pivot = 0.0, None
            for k, (_, x) in enumerate(cursors):
                total += x[2]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][1][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            # bounds by block, of the block in which each list could hold the item
            total, until = 0.0, 1 << 60
            for at, (_, _, _, blocks) in cursors[: pivot + 1]:
                b = at // POSTINGS
                while b < len(blocks) and blocks[b][1] < item:
                    b += 1
                if b < len(blocks):
                    total += blocks[b][0]
                    until = min(until, blocks[b][1])
            if total < least:  # no item up to the nearest end of a block can reach it
                target = until + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][1][0][cursors[pivot + 1][0]])
                target = max(target, item + 1)
            elif cursors[0][1][0][cursors[0][0]] == item:
                score = sum(x[1][at] for at, x in cursors[: pivot + 1])
                if score >= least:
                    out.append((self.items[item], score))
                target = item + 1
            else:
                target = item
            moved = []
            for k, c in enumerate(cursors):
                if k <= pivot:
                    docs, at = c[1][0], c[0]
                    while at < len(docs) and docs[at] < target:
                        at += 1
                    if at == len(docs):
                        continue
                    c[0] = at
                moved.append(c)
            cursors = moved
        return out


class _Numbers(dict):
    """Number of a word's normal form: 0 for one that no item has, -1 for none; kept while they are few."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        t = word.lower()
        if not t.isalnum():
            t = _OUTER.sub("", t)
        n = self.number.get(t, 0) if t else -1
        if len(self) > 200_000:
            self.clear()
        self[word] = n
        return n


class Index:
    """Items on SHELVES shelves by length; each shelf has passages of twice its longest item's words."""

    def __init__(self, items: list[tuple[int, str]], n: int, df: dict[str, int], mean: float):
        self.ids, self.parts, entries = [], [], []
        number: dict[str, int] = {}
        for id, text in sorted(items, key=lambda x: (len(terms(x[1])), x[0])):
            words = terms(text)
            if not words:
                continue
            tf = Counter(words)
            own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for t, f in tf.items()}
            whole = sum(own.values())
            entries.append((len(self.ids), {number.setdefault(t, len(number) + 1): w / whole for t, w in own.items()}, len(words)))
            self.ids.append(id)
            self.parts.append(parts(text))
        self.numbers = _Numbers(number)
        each = max(1, -(-len(entries) // SHELVES))
        self.shelves = [Shelf([e[:2] for e in part], part[-1][2], len(number) + 1) for part in (entries[i : i + each] for i in range(0, len(entries), each))]
        self.bounds = np.stack([s.bound for s in self.shelves]) if self.shelves else np.zeros((0, 1))
        self.steps = np.array([[s.longest] for s in self.shelves])  # passages begin at multiples of it and are two steps long

    def hits(self, text: str, least: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the items verified in a text."""
        said = text.split()
        if not said or not self.shelves:
            return []
        numbers = np.fromiter(map(self.numbers.__getitem__, said), np.int32, len(said))
        if (numbers < 0).any():
            numbers = numbers[numbers >= 0]
        best: dict[int, float] = {}
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        again = numbers[order[1:]] == numbers[order[:-1]]
        before = np.full(n, -1)  # where a word stood last
        before[order[1:][again]] = order[:-1][again]
        weights = self.bounds[:, numbers]
        weights[before >= np.arange(n) // self.steps * self.steps] = 0  # a word counts once in each step of a shelf
        sums = np.zeros((len(self.shelves), n + 1))
        np.cumsum(weights, axis=1, out=sums[:, 1:])
        for shelf, own in zip(self.shelves, sums, strict=True):
            starts = np.arange(0, max(1, n - shelf.longest), shelf.longest)
            ends = np.minimum(starts + 2 * shelf.longest, n)
            for i in np.flatnonzero(own[ends] - own[starts] >= least - 1e-9).tolist():
                query = set(numbers[starts[i] : ends[i]].tolist()) & shelf.lists.keys()
                if sum(shelf.lists[t][2] for t in query) < least - 1e-9:  # each term once
                    continue
                for item, score in shelf.search(query, least - 1e-9):
                    best[item] = max(score, best.get(item, 0.0))
        if not best:
            return []
        words, have, out = terms(text), {}, []
        for item, score in sorted(best.items()):
            shares = []
            for part in self.parts[item]:
                width = min(SHINGLE, len(part))
                if not part:
                    shares.append(1.0)
                    continue
                if width not in have:
                    have[width] = shingles(words, width) if len(words) >= width else set()
                own = shingles(part, width)
                shares.append(len(own & have[width]) / len(own))
            if min(shares) >= overlap:
                out.append((self.ids[item], min(1.0, score), *shares))
        return sorted(out)


def find(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """One row for each item verified in a document: docs' columns but the text, item_id, score, question_overlap, answer_overlap.

    items: (item_id, text), ids whole numbers.  Columns of docs with one of the four new names are left out."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = items.count()
    keep = [c for c in docs.columns if c not in (text, "item_id", "score", "question_overlap", "answer_overlap")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("item_id", T.LongType())] + [T.StructField(k, T.DoubleType()) for k in ("score", "question_overlap", "answer_overlap")])
    blocks = max(1, -(-rows // ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    n, mean, df = statistics(items)
    out = None
    for k in range(blocks):
        taken = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).collect()]  # about ITEMS rows
        own = {t for _, x in taken for t in terms(x)}
        few = df if isinstance(df, dict) else {r["t"]: r["df"] for r in df.where(F.col("block") == k).select("t", "df").collect()}
        index = spark.sparkContext.broadcast((taken, n, {t: few[t] for t in own}, mean))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            of = Index(*index.value)
            for batch in slices(batches, text):
                at, found = [], []
                for i, x in enumerate(batch.column(text).to_pylist()):
                    for hit in of.hits(x or "", least, overlap):
                        at.append(i)
                        found.append(hit)
                cols = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in keep), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))], names=[*keep, "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def statistics(items: DataFrame) -> tuple[int, float, dict | DataFrame]:
    """Number of items with words, their mean length, and document frequencies (by block, as a stored table if there are several)."""
    schema = "block long, t string, n int, len int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, x in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms(x)
                out += [{"block": block, "t": t, "n": int(i == 0), "len": len(words)} for i, t in enumerate(dict.fromkeys(words))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("t", pa.string()), ("n", pa.int32()), ("len", pa.int32())]))

    seen = stash(items.select("block", "text").mapInArrow(run, schema), "bm25-terms")
    n, total = seen.agg(F.sum("n"), F.sum(F.col("n") * F.col("len"))).first()
    counts = seen.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    if items.sparkSession is not None and seen.select("block").distinct().count() <= 1:
        return n or 0, (total or 0) / (n or 1), {r["t"]: r["df"] for r in counts.collect()}  # terms of one block of items
    return n, total / n, stash(seen.select("block", "t").distinct().join(counts, "t"), "bm25-df")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row for each document and item."""
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *(F.round(c, 4).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with all their columns, in which no item is found."""
    keys = docs.select(F.xxhash64(id).alias("__leak_1"), F.xxhash64(text).alias("__leak_2"), F.col(text).alias("text"))
    leaks = stash(find(keys, items).select("__leak_1", "__leak_2").distinct(), "leaks")
    if leaks.count() <= 1_000_000:
        leaks = F.broadcast(leaks)
    rows = docs.withColumns({"__leak_1": F.xxhash64(id), "__leak_2": F.xxhash64(text)})
    return rows.join(leaks, ["__leak_1", "__leak_2"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


QUERIES = {"op6_decontaminate": (op6_decontaminate, None)}
