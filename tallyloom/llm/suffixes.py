"""Exact long repeats by a logarithmic family of sparse suffix arrays.

Every window of WINDOW bytes names one suffix of its text, the one that begins at its anchor (see windows.py), so any two
equal windows name suffixes that share GRAM bytes.  A batch's suffix array holds its named suffixes in the order of their
first HEAD bytes, then of a hash of the first GRAM bytes.  A new batch is merge-scanned against every level of the family: a
suffix that both hold is a match, compared byte by byte over HEAD bytes and by hash over GRAM bytes.  Then it becomes a level
itself, and levels of equal rank merge, so a suffix is rewritten once for each doubling of the corpus.  A family is a folder, so later batches can be added by another session.

What the scans find decides which suffixes are extended: the windows on both sides of them, to the left and to the right,
are told apart by hashes of 64 bits beside the 64 of their suffix.  Only named suffixes are in the arrays, about one
byte in 100; arrays over all bytes need 5 bytes each and don't fit the limit of disk (README).

Null and empty texts have no bytes to remove.  Texts are compared as UTF-8 and a removed span may begin or end within a
character.  Equal texts, repeated rows too, of WINDOW bytes or more lose everything; each is worked on once.  Null and
repeated ids are kept row by row; other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_texts, drop_stash, folder_of, new_path, scratch, small, stash, table
from .windows import anchor_rows, compared_windows, finished, run_groups

WINDOW, GRAM, HEAD = 400, 200, 48
#: Bytes of named suffixes in a batch, and the least number of batches.
BATCH_BYTES, BATCHES = 64 << 30, 4


class IndexFamily:
    """Suffix arrays of growing rank in a folder: <rank>-<name>, each a table (suffix, fp) in the order of suffixes.

    A merged level is written whole before the two that it replaces go, so a broken run leaves a suffix twice at worst,
    and a scan finds it all the same."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def levels(self) -> list[tuple[int, str]]:
        store, at = folder_of(self.spark, self.folder)
        names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
        done = [n for n in names if store.exists(folder_of(self.spark, f"{self.folder}/{n}/_SUCCESS")[1])]
        return sorted((int(n.split("-")[0]), f"{self.folder}/{n}") for n in done)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema("suffix binary, fp long").parquet(path)

    def _write(self, rows: DataFrame, rank: int) -> str:
        path = f"{self.folder}/{rank:04d}-{uuid.uuid4().hex}"
        array = rows.select("suffix", "fp").distinct().sortWithinPartitions("suffix", "fp")
        array.write.option("compression", "zstd").parquet(path)
        return path

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch (suffix, fp, m: how often it counts); (fp) of the suffixes that it repeats, itself or a level's."""
        counted = stash(batch.groupBy("suffix", "fp").agg(F.sum("m").alias("m")), "suffix-batch")
        seen = counted.where("m > 1").select("fp")
        for _, path in self.levels():
            seen = seen.union(counted.select("suffix", "fp").join(self.read(path).hint("merge"), ["suffix", "fp"]).select("fp"))
        seen = stash(seen.distinct(), "suffix-seen")
        rank, own = 0, self._write(counted, 0)
        while other := next((p for r, p in self.levels() if r == rank and p != own), None):
            merged = self._write(self.read(own).union(self.read(other)), rank + 1)
            for path in (own, other):
                store, at = folder_of(self.spark, path)
                store.delete(at, True)
            rank, own = rank + 1, merged
        return seen

    def drop(self) -> None:
        store, at = folder_of(self.spark, self.folder)
        store.delete(at, True)


def family_prints(family: IndexFamily, rows: DataFrame, batches: int) -> DataFrame:
    """Hashes (fp) of suffixes that occur more than once in rows, or in the family, found batch by batch.

    A batch holds the suffixes of its texts, so that a repetition within a batch is found by the batch's own array."""
    out = None
    for b in range(batches):
        seen = family.add(rows.where(F.pmod("k1", F.lit(batches)) == b).select("suffix", "fp", "m"))
        out = seen if out is None else out.union(seen)
    return out.distinct()


def finish(texts: list[bytes], spans: list[np.ndarray]) -> list[tuple]:
    out = []
    for text, own in zip(texts, spans, strict=True):
        kept, at = [], 0
        for a, b in own.tolist():
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        rest = b"".join(kept)
        out.append((len(text), len(text) - len(rest), len(own), hashlib.sha256(rest).hexdigest(), rest))
    return out


RESULT = [("n_bytes", pa.int64(), T.LongType()), ("n_removed", pa.int64(), T.LongType()), ("n_spans", pa.int64(), T.LongType()), ("kept_sha256", pa.string(), T.StringType()), ("kept", pa.binary(), T.BinaryType())]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int | None = None, kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): every row's text without the bytes that a repeated window covers.

    Most repeated windows stand in a run of windows that as a whole occurs again.  The windows of the other runs of a
    repeated suffix are hashed one by one, with one run of each kind that occurs again for comparison."""
    with scratch():
        texts = distinct_texts(docs, id, text)
        rows = stash(anchor_rows(texts.bodies, window, gram, False, suffix=min(HEAD, gram)), "windows-runs")
        if batches is None:
            batches = max(BATCHES, -(-rows.count() * HEAD // BATCH_BYTES))
        family = IndexFamily(docs.sparkSession, new_path(docs.sparkSession, "suffix-family"))
        known = stash(family_prints(family, rows, batches), "windows-known")
        family.drop()
        found = stash(rows.drop("suffix").join(known.hint("merge"), "fp").withColumns({"n": F.col("i2") - F.col("i1"), "copies": F.lit(1)}), "windows-found")
        drop_stash(rows)
        groups = run_groups(found)
        windows = compared_windows(texts, groups, window, False)
        twice = small(stash(windows.groupBy("fp", "wh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "windows-twice"))
        hits = windows.where("lone").join(twice, ["fp", "wh"]).select("k1", "k2", F.col("i").alias("i1"), F.col("i").alias("i2"))
        sure = found.join(stash(groups.where("times > 1").select("fp", "ctx", "n"), "windows-again").hint("merge"), ["fp", "ctx", "n"]).select("k1", "k2", "i1", "i2")
        spans = sure.union(hits).groupBy("k1", "k2").agg(F.collect_list(F.struct("i1", "i2")).alias("spans"))  # a text's own
        spans = stash(spans, "windows-spans")
        n = 5 if kept else 4
        return finished(texts, spans, docs.schema[id].dataType, window, finish if kept else digest_only, RESULT[:n])


def digest_only(texts: list[bytes], spans: list[np.ndarray]) -> list[tuple]:
    return [x[:4] for x in finish(texts, spans)]


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), kept=False).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_suffix_dedup": (op7_suffix_dedup, None)}
