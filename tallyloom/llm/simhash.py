"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

Each of the 64 bits gets a nonzero vector of r + 1 bits.  A mask for each nonzero v keeps the bits whose vector has an
odd inner product with v: 2^(r+1) - 1 masks.  The vectors of up to r differing bits leave some v orthogonal to all of
them, so fingerprints within radius r agree under that mask: every such pair collides in some table, for certain.

Only distinct fingerprints are compared, so groups of copies count once.  Inside a bucket no pairs are listed.  For
radius 2, each member names itself with at most one of the bits that the mask leaves out flipped: two members share
such a name just if they differ in at most 2 bits, and at most 65 distinct fingerprints can share one.

Null and blank texts have fingerprint zero and are linked like any other.  Repeated rows and repeated or null ids are
kept row by row; a component's id is its smallest non-null doc_id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, connected_components, distinct_texts, drop_stash, scratch, slices, small, stash, table, text_key

SEED, STEP = 42, 1 << 14


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: A-Z only, and just the blanks that end words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + STEP], stops[i : i + STEP], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """docs without the text and with its fingerprint as a long."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [signed(fingerprint(x or b"", width)) for x in batch.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.int64())], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """The covering masks of 64 bits, as signed longs."""
    n = (1 << radius + 1) - 1
    vectors = [i * (n // 2 + 2 if n > 3 else 1) % n + 1 for i in range(64)] if n > 7 else [i % n + 1 for i in range(64)]
    return [signed(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)) for v in range(1, n + 1)]


def buckets(prints: DataFrame, radius: int) -> DataFrame:
    """(t, key, fp) of distinct fingerprints that share a bucket of table t with another."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks(radius))))
    rows = prints.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), F.col("x.mask").alias("mask"), "fp")
    full = rows.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("t", "key")
    return rows.join(full, ["t", "key"])


def links(prints: DataFrame) -> DataFrame:
    """(u, v) for fingerprints within 2 bits: enough links to connect all of them, and none between others."""
    found = buckets(prints, 2)
    spare = F.filter(F.array(*(F.lit(signed(1 << i)) for i in range(64))), lambda b: F.col("mask").bitwiseAND(b) == 0)
    names = F.concat(F.array(F.lit(0).cast("long")), spare)
    named = found.select("fp", F.explode(F.transform(names, lambda b: F.col("fp").bitwiseXOR(b))).alias("name"))
    groups = named.groupBy("name").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def components(rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """rows (id, fp, ...) with component: the smallest id that each is linked to."""
    classes = stash(rows.groupBy("fp").agg(F.min(id).alias("least")), "simhash-classes")
    groups = connected_components(links(classes.select("fp")), "simhash-links").withColumnRenamed("node", "fp")
    named = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    labels = stash(named.join(least, "component").select("fp", F.col("first").alias("component")), "simhash-components")
    return rows.join(labels, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stash(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    out = components(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---- the pipeline's stage: one document of each group of near copies stays

SHINGLE, SIMILAR = 5, 0.8  # SIMILAR is 4/5, which the bounds below use as whole numbers
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 16, 4, 1 << 20
PARTS, PAIRS = 4, 256  # parts of the comparison, and pairs with their sets in a batch
#: Classes of a sketch, and shingles below which a text is not judged by it.
SKETCH, SURE = 128, 256


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of word shingles (fewer words: the whole sequence)."""
    words = text.lower().split()
    joined = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in joined], np.uint64))


def similar(a: bytes, b: bytes) -> float:
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def hot_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts in every HOT_SAMPLEth text.

    They steer the order of shingles only: any order gives the same pairs, a good one compares fewer.  So the sample and the
    bound on what reaches the driver lose nothing."""
    some = texts.where(F.pmod("u", F.lit(HOT_SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    n = some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST)
    found = n.orderBy(F.desc("n"), "s").limit(HOT_MOST).toPandas()
    s, n = found["s"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def ordered(shingles: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A text's shingles in the order of all texts: frequent ones last, else by hash."""
    s, n = hot
    if not len(s):
        return shingles
    at = np.minimum(np.searchsorted(s, shingles), len(s) - 1)
    return shingles[np.argsort(np.where(s[at] == shingles, n[at], 0), kind="stable")]


def prefixes(texts: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(s, u, n, i): of the n shingles of text u, the first n - ceil(0.8 n) + 1 in the common order, each with its place i.

    Texts of Jaccard 0.8 or more share at least 0.8 of either's shingles, so the first shingle that they share is among these of both."""
    model = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            s, sizes = [], []
            for x in batch.column("text").cast(pa.binary()).to_pylist():
                own = ordered(shingle_set(x or b""), model.value)
                s.append(own[: len(own) - (4 * len(own) + 4) // 5 + 1])
                sizes.append(len(own))
            held = np.array([len(x) for x in s])
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in held])
            u = np.repeat(batch.column("u").to_numpy(), held)
            n = np.repeat(np.array(sizes, np.int32), held)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)), pa.array(u), pa.array(n), pa.array(place)], names=["s", "u", "n", "i"])

    return texts.mapInArrow(run, "s long, u long, n int, i int")


def rest_of(n: str) -> str:
    """Shingles behind a prefix."""
    return f"((4L * {n} + 4L) DIV 5L - 1L)"


def within(a: str, b: str) -> str:
    """Whether texts that share their first shingle at places a.i and b.i can have Jaccard 0.8, 9 x shared >= 4 x (a.n + b.n).

    They share at most what is behind these places, and at most what other texts' prefixes have of either's prefix (c) and
    what is behind the prefix that ends first in the common order."""
    bound = f"least({a}n - {a}i, {b}n - {b}i, least({a}c, {b}c) + greatest({rest_of(a + 'n')}, {rest_of(b + 'n')}))"
    return f"9L * {bound} >= 4L * ({a}n + {b}n)"


def print_pairs(texts: DataFrame) -> DataFrame:
    """(u, v), u > v: texts (u, text) whose fingerprints link, those of one fingerprint by their least text."""
    rows = stash(fingerprints(texts.select("u", "text"), width=SHINGLE), "near-prints")
    classes = stash(rows.groupBy("fp").agg(F.min("u").alias("v")), "near-classes")
    same = rows.join(classes, "fp").where("u <> v").select("u", "v")
    ends = [classes.select(F.col("fp").alias(e), F.col("v").alias(f"{e}_text")) for e in ("u", "v")]
    between = links(classes.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.greatest("u_text", "v_text").alias("u"), F.least("u_text", "v_text").alias("v"))
    out = stash(same.union(between).distinct(), "near-alike")
    drop_stash(rows)
    drop_stash(classes)
    return out


def near_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): enough of the pairs of similar texts (u, text) to connect all of them, and no others.

    Fingerprints come first: texts whose fingerprints link by the covering masks are compared whole.  A fingerprint misses a part of
    the similar pairs, which a join on shingles adds; its candidates are complete: all pairs that share a shingle of their prefixes and can be similar by the bounds of within().
    There each text first meets one other, the commonest among two of each of its shingles' texts: the one with the fewest shingles of
    its own, near copies' likely original, and the longest.  Then the pairs that these leave unconnected are compared, all of
    them.  A shingle whose texts are connected already has nothing left to list."""
    alike = compared(print_pairs(texts), texts)
    found = stash(prefixes(texts, hot_shingles(texts)), "near-prefixes")
    lists = found.repartition("s")  # one shuffle for both sides of the join
    many = lists.groupBy("s").agg(F.min("u").alias("x"), F.max("u").alias("y")).where("x <> y").select("s")
    known = stash(lists.join(many, "s"), "near-known")
    drop_stash(found)
    counts = known.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    shared = stash(known.join(counts.hint("merge"), "u").withColumn("q", F.expr(f"n - {rest_of('n')} - c")), "near-shared")
    drop_stash(known)
    ends = shared.groupBy("s").agg(F.min(F.struct("q", "n", "u", "i", "c")).alias("lo"), F.max(F.struct("n", "u", "i", "c")).alias("hi"))
    met = shared.join(ends.hint("merge"), "s")
    both = F.array(*(F.struct(F.col(f"{e}.u").alias("u"), F.col(f"{e}.n").alias("n"), F.col(f"{e}.i").alias("i"), F.col(f"{e}.c").alias("c")) for e in ("lo", "hi")))
    pairs = met.select("u", "n", "i", "c", F.explode(both).alias("e")).where(f"u <> e.u AND {within('', 'e.')}").select("u", F.col("e.u").alias("v"))
    best = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("u").agg(F.max(F.struct("k", "v")).alias("b"))
    first = best.select(F.greatest("u", "b.v").alias("u"), F.least("u", "b.v").alias("v")).distinct().join(alike, ["u", "v"], "left_anti")
    close = alike.union(compared(stash(first, "near-ends"), texts))
    first = stash(connected_components(close, "near-links"), "near-first")
    marked = shared.select("s", "u", "n", "i", "c").join(first.withColumnRenamed("node", "u"), "u", "left").withColumn("g", F.coalesce("component", "u")).drop("component")
    split = marked.groupBy("s").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("s")
    left = stash(marked.join(split, "s", "left_semi"), "near-left")
    drop_stash(shared)
    a, b = left.alias("a"), left.alias("b")
    rest = a.join(b, F.expr(f"a.s = b.s AND a.u > b.u AND a.g <> b.g AND {within('a.', 'b.')}")).select(F.col("a.u").alias("u"), F.col("b.u").alias("v")).distinct()
    rest = stash(rest, "near-rest")
    drop_stash(left)
    return close.union(compared(rest, texts))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each of SKETCH classes of a set, half of each hash; the greatest number for an empty class."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, (shingles & np.uint64(SKETCH - 1)).astype(np.int64), (shingles >> np.uint64(32)).astype(np.uint32))
    return out


def sketches(body: DataFrame) -> DataFrame:
    """(u, n, k): number of shingles and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array([len(x) for x in found], pa.int32()), pa.array([sketch(x).tobytes() for x in found], pa.binary())], names=["u", "n", "k"])

    return body.mapInArrow(run, "u long, n int, k binary")


def plausible(pairs: DataFrame) -> DataFrame:
    """(u, v) of pairs (u, v, n, o, a, b) that their sketches don't rule out.

    Of the classes that either text has, a share equal to the similarity agrees, but for chance.  A pair goes if under half of them
    agree; for texts of 0.8 or more that is over eight standard deviations away.  Texts of few shingles are always kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a", 2 << 20):
            n, o = (batch.column(c).to_numpy() for c in ("n", "o"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SKETCH) for c in ("a", "b"))
            some = (a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)
            keep = (np.minimum(n, o) < SURE) | (2 * ((a == b) & some).sum(1) >= some.sum(1))
            keep &= 5 * np.minimum(n, o).astype(np.int64) >= 4 * np.maximum(n, o).astype(np.int64)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "n", "o", "a", "b").mapInArrow(run, "u long, v long")


def bodies_in(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    need = small(stash(pairs.select("u").union(pairs.select("v")).distinct(), label))
    return texts.join(need, "u", "left_semi")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose texts are similar: sketches rule most others out, whole sets decide."""
    own = stash(sketches(bodies_in(pairs, texts, "near-need")), "near-sketches")
    left, right = own.select("u", "n", F.col("k").alias("a")), own.select(F.col("u").alias("v"), F.col("n").alias("o"), F.col("k").alias("b"))
    likely = stash(plausible(pairs.join(left, "u").join(right, "v")), "near-likely")
    drop_stash(own)
    drop_stash(pairs)
    shingled = stash(sets(bodies_in(likely, texts, "near-need")), "near-sets")
    left, right = shingled.withColumnRenamed("s", "a"), shingled.select(F.col("u").alias("v"), F.col("s").alias("b"))
    out = None
    for k in range(PARTS):  # one part's sets are on disk at a time
        mine = F.pmod("u", F.lit(PARTS)) == k
        with arrow_rows(texts.sparkSession, PAIRS):
            part = stash(near(likely.where(mine).join(left.where(mine), "u").join(right, "v")), "near-close")
        out = part if out is None else out.union(part)
    drop_stash(shingled)
    return out


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, r) of the rows that stay: hashes of text and id.

    Fingerprints propose pairs, a join on shingles those they miss.  A pair links if its five-word shingles have a Jaccard similarity of SIMILAR or more, on whole texts; every such pair
    is found (near_pairs).  Equal texts are one from the start.  In a group the row of least id, then least hashes, stays."""
    with scratch():
        texts = distinct_texts(docs, id, text)
        rows = texts.bodies.select(F.col("k1").alias("u"), "text")
        groups = connected_components(near_pairs(rows), "near-links")
        named = stash(texts.bodies.select("k1", "k2", "id", "r"), "near-rows")
        named = named.join(groups, named.k1 == groups.node, "left").withColumn("g", F.coalesce("component", "k1"))
        stay = named.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "r", "k1", "k2")).alias("m")).select("m.k1", "m.k2", "m.r")
        return stash(stay, "near-stay", keep=True)


def sets(body: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [shingle_set(x or b"").tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(out, pa.binary())], names=["u", "s"])

    return body.mapInArrow(run, "u long, s binary")


def near(pairs: DataFrame) -> DataFrame:
    """(u, v) of pairs (u, v, a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a", 2 << 20):
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                few, many = min(len(x), len(y)), max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if few >= SIMILAR * many else 0
                keep.append(both >= SIMILAR * (few + many - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each group one row stays, with all its columns."""
    stay = near_groups(docs, id, text)
    k1, k2 = text_key(text)
    own = {"__near_1": k1, "__near_2": k2, "__near_3": F.xxhash64(id)}
    named = stay.select(F.col("k1").alias("__near_1"), F.col("k2").alias("__near_2"), F.col("r").alias("__near_3"))
    out = docs.withColumns(own).join(named, list(own), "left_semi")
    return out.dropDuplicates(list(own)).select(*(F.col(f"`{c}`") for c in docs.columns))


QUERIES = {"op8_simhash": (op8_simhash, None)}
