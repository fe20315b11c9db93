"""Repeated-phrase removal by sharded Aho-Corasick automata over words.

1. Passages are proposed: a run of windows that as a whole occurs again, and windows that occur again elsewhere than in such
   a run (windows.py).  Neighbouring windows that stand in the same runs make one passage: all windows of an anchor are
   aligned by it, so each of their runs has the passage as a whole.  Of a passage only the words are kept, cut from one of
   its texts, and not where else it stands.
2. A passage belongs to the shard that its anchor's hash names.  Each shard's distinct passages are compiled into one
   automaton (pyahocorasick, words as numbers), and every document's parts with an anchor of the shard are streamed
   through it.  That filter loses nothing: all windows of a passage have its anchor, and so has each of its occurrences.
   Anchors with more than HOT occurrences are dealt over several shards, each with the passages.
3. A passage is confirmed if the automata locate it at two places or more, compared word by word; every word inside an
   occurrence of a confirmed passage goes.

Null and blank texts have no words.  Equal texts, repeated rows too, of WINDOW words or more lose everything; each is worked
on once.  Null and repeated ids are kept row by row; other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, distinct_texts, drop_stash, scratch, slices, small, stash, table
from .windows import anchor_rows, compared_windows, finished, run_groups

WINDOW, GRAM = 35, 8
#: Words of passages in an automaton before they are merged, places of an anchor in a shard, and the least number of shards.
SHARD, HOT, SHARDS = 1 << 20, 20_000, 16


def cut_parts(listed: DataFrame) -> DataFrame:
    """(kind, fp, copies, k1, k2, m, i1, part): the words i1..i2-1 of each text's listed parts (k1, k2, m, text, parts: kind, i1, i2, fp, copies, tag).

    Passages with the same anchor and tag whose starts follow one another are one; parts without a tag stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            col = batch.column("parts")
            ends, field = col.offsets.to_numpy(), lambda n: col.values.field(n).to_numpy(zero_copy_only=False)  # noqa: B023
            kind, i1, i2, fp, copies, tag = map(field, ("kind", "i1", "i2", "fp", "copies", "tag"))
            held, part = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                data, place = b" ".join(words), np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                at = np.arange(ends[i], ends[i + 1])
                at = at[np.lexsort((i1[at], fp[at], tag[at]))]
                first = np.ones(len(at), bool)
                same = (tag[at[1:]] != 0) & (tag[at[1:]] == tag[at[:-1]]) & (fp[at[1:]] == fp[at[:-1]]) & (i1[at[1:]] == i1[at[:-1]] + 1)
                first[1:] = ~same
                begin = np.flatnonzero(first)
                last = np.append(begin[1:], len(at)) - 1
                a, b = i1[at[begin]], i2[at[last]]
                part += [data[x:y] for x, y in zip(place[a].tolist(), (place[b] - 1).tolist(), strict=True)]
                held.append((np.full(len(begin), i), at[begin]))
            row, at = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.array(row)
            own = [pa.array(kind[at]), pa.array(fp[at]), pa.array(copies[at]), *(batch.column(k).take(row) for k in ("k1", "k2", "m")), pa.array(i1[at]), pa.array(part, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["kind", "fp", "copies", "k1", "k2", "m", "i1", "part"])

    return listed.select("k1", "k2", "m", "text", "parts").mapInArrow(run, "kind int, fp long, copies int, k1 long, k2 long, m long, i1 int, part binary")


def places_of(texts: Texts, found: DataFrame, window: int) -> DataFrame:
    """(kind, k1, k2, i1, i2, fp, copies, tag): where to cut passages that seem to recur (0), and all parts to search (1)."""
    groups = stash(run_groups(found), "phrase-groups")
    none = F.lit(0).cast("long").alias("tag")
    whole = groups.where("times > 1").select(F.lit(0).alias("kind"), "r.k1", "r.k2", "r.i1", (F.col("r.i1") + F.col("n") + window).alias("i2"), "fp", "copies", none)
    windows = compared_windows(texts, groups, window, True)
    runs = F.bit_xor(F.xxhash64("k1", "k2", "i1"))  # with their number: which runs a window stands in
    again = windows.groupBy("fp", "wh").agg(F.count(F.lit(1)).alias("c"), F.max("copies").alias("copies"), runs.alias("x"), F.min(F.struct("k1", "k2", "i")).alias("r")).where("c > 1")
    single = again.select(F.lit(0).alias("kind"), "r.k1", "r.k2", F.col("r.i").alias("i1"), (F.col("r.i") + window).alias("i2"), "fp", "copies", F.xxhash64("c", "x").alias("tag"))
    parts = found.select(F.lit(1).alias("kind"), "k1", "k2", "i1", (F.col("i2") + window).alias("i2"), "fp", "copies", none)
    every = whole.unionByName(single).unionByName(parts)
    return stash(every.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "i1", "i2", "fp", "copies", "tag")).alias("parts")), "phrase-places")  # a text's own


class Shard:
    """One automaton over the words of passages."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pid, passage in set(passages):
            words = passage.split(b" ")
            self.automaton.add_word(tuple([self.number.setdefault(w, len(self.number)) for w in words]), (pid, len(words)))
        if passages:
            self.automaton.make_automaton()
        self.some = bool(passages)
        self.seen: dict[bytes, list[tuple[int, int, int]]] = {}

    def locate(self, part: bytes) -> list[tuple[int, int, int]]:
        """(first word, words, passage) of every occurrence in a part; equal parts are searched once."""
        found = self.seen.get(part)
        if found is None:
            get = self.number.get
            hits = self.automaton.iter(tuple([get(w, 0xFFFFFFFF) for w in part.split(b" ")])) if self.some else ()
            found = self.seen[part] = [(end + 1 - n, n, pid) for end, (pid, n) in hits]
        return found


def located(parts: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, m, i1, i2, pid): occurrences of passages (kind 0) in parts (kind 1), word by word, shard by shard.

    parts: (kind, fp, copies, k1, k2, m, i1, part)."""
    own = F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int")
    salt = F.pmod(F.xxhash64("k1", "i1"), F.col("copies")).cast("int")
    some = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(salt))  # passages to all shards of their anchor
    dealt = parts.withColumn("shard", F.explode(F.transform(some, lambda c: F.pmod(own + c, F.lit(shards)).cast("int"))))
    dealt = dealt.select("shard", "kind", F.when(F.col("kind") == 0, F.xxhash64("fp", "part")).alias("pid"), "k1", "k2", "m", "i1", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, listed, compiled = None, [], None
        for batch in slices(batches, "part", 4 << 20):
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            rows, hits = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if shard[a] != now:
                    now, listed, compiled = shard[a], [], None
                k = a + int(np.count_nonzero(kind[a:z] == 0))  # passages come first
                listed += zip(batch.column("pid").slice(a, k - a).to_pylist(), batch.column("part").slice(a, k - a).to_pylist(), strict=True)
                if k == z:
                    continue
                if compiled is None:
                    compiled, listed = Shard(listed), []
                each = batch.column("part").slice(k, z - k).dictionary_encode()  # equal parts are looked at once
                own = [compiled.locate(part) for part in each.dictionary.to_pylist()]
                many, code = np.fromiter(map(len, own), np.int64, len(own)), each.indices.to_numpy()
                n = many[code]
                at = np.repeat((np.cumsum(many) - many)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append(np.repeat(np.arange(k, z), n))
                hits.append(np.array([h for o in own for h in o], np.int64).reshape(-1, 3)[at])
            row, (first, n, pid) = pa.array(np.concatenate(rows)), np.concatenate(hits).T
            start = (first + batch.column("i1").take(row).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in ("k1", "k2", "m")), pa.array(start), pa.array(start + n.astype(np.int32)), pa.array(np.ascontiguousarray(pid))], names=["k1", "k2", "m", "i1", "i2", "pid"])

    both = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, "k1 long, k2 long, m long, i1 int, i2 int, pid long")


def finish(texts: list[bytes], spans: list[np.ndarray]) -> list[tuple]:
    out = []
    for text, own in zip(texts, spans, strict=True):
        words = text.split()
        kept, at = [], 0
        for a, b in own.tolist():
            kept += words[at:a]
            at = b
        kept += words[at:]
        rest = b" ".join(kept)
        out.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest))
    return out


def digest_only(texts: list[bytes], spans: list[np.ndarray]) -> list[tuple]:
    return [x[:3] for x in finish(texts, spans)]


RESULT = [("n_words", pa.int64(), T.LongType()), ("n_removed", pa.int64(), T.LongType()), ("kept_sha256", pa.string(), T.StringType()), ("kept", pa.binary(), T.BinaryType())]


def remove_phrases(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, kept: bool = True, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): every row's words without those that a repeated window covers."""
    with scratch():
        texts = distinct_texts(docs, id, text)
        rows = stash(anchor_rows(texts.bodies, window, gram, True), "windows-runs")
        places = F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("copies")  # an anchor of many places has several shards
        known = stash(rows.groupBy("fp").agg(F.sum("m").alias("all"), places).where("all > 1").drop("all"), "windows-known")
        found = stash(rows.join(known.hint("merge"), "fp").withColumn("n", F.col("i2") - F.col("i1")), "windows-found")
        drop_stash(rows)
        lists = places_of(texts, found, window)
        size = lists.select(F.explode("parts").alias("p")).where("p.kind = 0").agg(F.sum(F.col("p.i2") - F.col("p.i1"))).first()[0] or 0
        drop_stash(found)
        shards = max(SHARDS, -(-size // SHARD))
        places = stash(located(cut_parts(texts.with_lists(lists)), shards), "phrase-located")
        drop_stash(lists)
        confirmed = stash(places.groupBy("pid").agg(F.sum("m").alias("c")).where("c > 1").select("pid"), "phrase-confirmed")
        spans = places.join(small(confirmed), "pid").groupBy("k1", "k2").agg(F.collect_list(F.struct("i1", (F.col("i2") - window).alias("i2"))).alias("spans"))
        n = 4 if kept else 3
        return finished(texts, stash(spans, "phrase-spans"), docs.schema[id].dataType, window, finish if kept else digest_only, RESULT[:n])


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(table(spark, sf_dir, "documents"), kept=False).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_phrase_dedup": (op10_phrase_dedup, None)}
