"""Windows of units (bytes or words) that occur more than once, found by content-defined anchors.

A window of W units holds W - k + 1 grams of k units.  Its anchor is the gram of least hash, the leftmost of equals: it
depends on the window's content only, so equal windows have equal anchors at the same distance.  Neighbouring windows
mostly share an anchor; such a run of windows is one row, and only one in about (W - k) / 2 grams becomes an anchor.
A window can only be repeated if its anchor is.

Equal texts are one here: each distinct text is worked on once and counts as often as it has rows, so neither copies nor
repeated rows cost more than their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, slices, small, stash

#: Windows that are worked on at once, so that memory doesn't follow a text's length.
PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size][0][:n], _powers[size][1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive units (uint64)."""
    up, down = powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[:-1], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(units) - k + 1])


def sliding_least(v: np.ndarray, m: int) -> np.ndarray:
    """The least of every m consecutive values."""
    if m == 1:
        return v
    n = -(-len(v) // m) * m
    p = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    p[: len(v)] = v
    p = p.reshape(-1, m)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(v) - m + 1], ahead[m - 1 : len(v)])


def runs(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place of the anchor, its gram's hash) of each run of windows with one anchor."""
    firsts, lasts, places, prints = [], [], [], []
    total = len(units) - window + 1
    for s in range(0, max(total, 0), PIECE):
        part = units[s : min(s + PIECE, total) + window - 1]
        g = grams(part, k)
        at = (sliding_least((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), window - k + 1) & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        firsts.append(first + s)
        lasts.append(np.concatenate((first[1:] - 1, [len(at) - 1])) + s)
        places.append(at[first] + s)
        prints.append(g[at[first]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places), np.concatenate(prints)


#: Hashes that stand for bytes.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


# ---- over a table


def parts_of(text: bytes, words: bool) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Units' hashes, the bytes they stand in, and the place of each unit there (one more than there are units).

    Words are joined by single spaces; a word's place is that of its first byte, and the last place lies one behind the end."""
    if not words:
        return BYTES[np.frombuffer(text, np.uint8)], text, np.arange(len(text) + 1)
    found = text.split()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, found), np.uint64, len(found))
    return hashes, b" ".join(found), np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)))


def digests(data: bytes, place: np.ndarray, first: np.ndarray, last: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of units first..last-1 of each pair; gap: bytes between units."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[a:b]) for a, b in zip(place[first].tolist(), (place[last] - gap).tolist(), strict=True)], np.uint64)


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def anchor_rows(bodies: DataFrame, window: int, k: int, words: bool, suffix: int = 0) -> DataFrame:
    """(k1, k2, m, i1, i2, fp, ctx): a run of windows, its anchor's hash, and the hash of all that the run's windows hold.

    suffix: also that many units' bytes from the anchor on."""
    names = ["k1", "k2", "m", "i1", "i2", "fp", "ctx"] + ["suffix"] * bool(suffix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            out: list[list] = [[], [], [], [], []]
            tails: list[bytes] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                units, data, place = parts_of(text or b"", words)
                if len(units) < window:
                    continue
                i1, i2, at, fp = runs(units, window, k)
                for held, x in zip(out, (np.full(len(i1), i), i1, i2, fp, digests(data, place, i1, i2 + window, int(words))), strict=True):
                    held.append(x)
                if suffix:
                    tails += [data[a:b] for a, b in zip(place[at].tolist(), (place[at + suffix] - int(words)).tolist(), strict=True)]
            if out[0]:
                at, i1, i2, fp, ctx = map(np.concatenate, out)
                at = pa.array(at)
                own = [batch.column("k1").take(at), batch.column("k2").take(at), batch.column("m").take(at), pa.array(i1.astype(np.int32)), pa.array(i2.astype(np.int32)), signed(fp), signed(ctx)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(tails, pa.binary())] * bool(suffix), names=names)

    return bodies.mapInArrow(run, "k1 long, k2 long, m long, i1 int, i2 int, fp long, ctx long" + ", suffix binary" * bool(suffix))


def flat(a: list[np.ndarray]) -> bytes:
    return np.concatenate(a).astype(np.int64).tobytes() if a else b""


def merged(i1: np.ndarray, i2: np.ndarray, window: int) -> np.ndarray:
    """Maximal spans (start, end) of units that windows i1..i2 cover."""
    if not len(i1):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(i1, kind="stable")
    start, end = i1[order].astype(np.int64), np.maximum.accumulate(i2[order].astype(np.int64) + window)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return np.stack([start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]], axis=1)


def window_rows(listed: DataFrame, window: int, words: bool) -> DataFrame:
    """(k1, k2, i1, i, fp, copies, wh, lone): every window i of the listed runs (k1, k2, text, runs: i1, i2, fp, copies, lone), with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            cols: list[list] = [[], [], [], [], [], [], []]
            for row, (text, own) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                i1, i2, fp, copies, lone = (np.array([r[k] for r in own], np.int64) for k in ("i1", "i2", "fp", "copies", "lone"))
                _, data, place = parts_of(text or b"", words)
                size = i2 - i1 + 1
                at = np.repeat(i1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                for held, x in zip(cols, (np.full(len(at), row), np.repeat(i1, size), at, np.repeat(fp, size), np.repeat(copies, size), digests(data, place, at, at + window, int(words)), np.repeat(lone, size)), strict=True):
                    held.append(x)
            row, i1, at, fp, copies, wh, lone = map(np.concatenate, cols)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(row), batch.column("k2").take(row), pa.array(i1.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(fp), pa.array(copies.astype(np.int32)), signed(wh), pa.array(lone > 0)], names=["k1", "k2", "i1", "i", "fp", "copies", "wh", "lone"])

    return listed.select("k1", "k2", "text", "runs").mapInArrow(run, "k1 long, k2 long, i1 int, i int, fp long, copies int, wh long, lone boolean")


def run_groups(found: DataFrame) -> DataFrame:
    """(fp, ctx, n, times, copies, r, lone): runs of the same content, how often they occur, the least of them, and whether its
    anchor also stands in a run that occurs once."""
    groups = stash(found.groupBy("fp", "ctx", "n").agg(F.sum("m").alias("times"), F.max("copies").alias("copies"), F.min(F.struct("k1", "k2", "i1")).alias("r")), "windows-groups")
    alone = small(stash(groups.where("times = 1").select("fp").distinct().withColumn("lone", F.lit(True)), "windows-lone"))
    return groups.join(alone, "fp", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))


def compared_windows(texts: Texts, groups: DataFrame, window: int, words: bool) -> DataFrame:
    """window_rows of all runs that occur once and of one run of each kind that occurs again beside such a run."""
    mine = groups.where("lone").select(F.col("r.k1").alias("k1"), F.col("r.k2").alias("k2"), F.struct(F.col("r.i1").alias("i1"), (F.col("r.i1") + F.col("n")).alias("i2"), "fp", "copies", (F.col("times") == 1).alias("lone")).alias("run"))
    lists = stash(mine.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")), "windows-open")  # a text's own runs
    return window_rows(texts.with_lists(lists), window, words)


Finish = Callable[[list[bytes], list[np.ndarray]], list[tuple]]
Result = list[tuple[str, pa.DataType, T.DataType]]


def finished(texts: Texts, spans: DataFrame, id_type: T.DataType, window: int, finish: Finish, result: Result) -> DataFrame:
    """(id, result columns) for every row; spans: (k1, k2, spans: array of (i1, i2)), the windows i1..i2 of a text that go."""
    arrow = [pa.field(n, t) for n, t, _ in result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            col = batch.column("spans")
            ends, i1, i2 = col.offsets.to_numpy(), *(col.values.field(n).to_numpy(zero_copy_only=False) for n in ("i1", "i2"))
            own = [merged(i1[a:b], i2[a:b], window) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            cols = zip(*finish([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], own), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *(pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True))], names=["k1", "k2", *(f.name for f in arrow)])

    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("k1", "k2")] + [T.StructField(n, t) for n, _, t in result])
    done = stash(texts.with_lists(spans, "left").select("k1", "k2", "text", "spans").mapInArrow(run, schema), "windows-done")
    return stash(texts.rows.join(small(done), ["k1", "k2"]).select("id", *(n for n, _, _ in result)), "windows-result", keep=True)
