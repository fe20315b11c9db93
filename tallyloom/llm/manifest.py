"""Merkle manifest of a dataset: one tree for each group of rows, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of a group ascend by id (null first; equal ids by
leaf, equal leaves are alike); every two consecutive nodes become the hash of their hex digests, a last one alone its own
hash, until one is left.  The groups' roots, null first and then by bytes, go up the same way.

Rows get their numbers in a group from a sort by ranges of keys and counts of the ranges, so no group is in one task.  Blocks
of 2**BITS aligned leaves are walked in postorder: each subtree hands its digest up and, while the recursion unwinds, its
sibling's digest is appended to the paths of the leaves below it.  The blocks' roots are nodes of the next such traversal, until
every group has one root.  A block is a row with its leaves, so what the later traversals find joins to blocks, not to leaves.

Null fields are told apart from empty ones.  Rows with a null id come first in their group; repeated rows are leaves of their
own, each with its own path.  A null group is a group.  Other columns aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small, stash, table

#: Levels of a block: it holds so many doublings of leaves.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = T.StructType([T.StructField("side", T.StringType()), T.StructField("digest", T.StringType())])
_STEP = pa.struct([("side", pa.string()), ("digest", pa.string())])


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 length, a colon and its value, or - where it is null."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told(c.cast("string")) for c in fields)), 256)


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def postorder(nodes: list[str], height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of the subtree of that height over the nodes, and each node's path: (side of the sibling, its digest) level by
    level, ("", "") where a node is alone."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def walk(start: int, height: int) -> str:
        if not height:
            return nodes[start]
        half = 1 << (height - 1)
        left, middle, end = walk(start, height - 1), start + half, min(start + 2 * half, len(nodes))
        if middle >= len(nodes):
            for p in paths[start:end]:
                p.append(("", ""))
            return joined(left)
        right = walk(middle, height - 1)
        for p in paths[start:middle]:
            p.append(("right", right))
        for p in paths[middle:end]:
            p.append(("left", left))
        return joined(left, right)

    return walk(0, height), paths


def height_of(block_nodes: int, group_nodes: int, bits: int) -> int:
    """Levels to climb in a block: all of them if its group has more blocks, else until one node is left."""
    return bits if group_nodes > 1 << bits else (block_nodes - 1).bit_length()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `pos`, their number from 0 within `g` in that order (ascending, null first); `salt` parts equal rows."""
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "salt")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("i", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            at = []
            for g in batch.column("g").to_pylist():
                now, n = g, n + 1 if g == now else 0
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "part", "i"])

    placed = stash(dealt.mapInArrow(run, schema), "manifest-placed")
    counts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and group
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = stash(counts.select("g", "part", before.alias("start")), "manifest-starts")
    return placed.join(small(starts), ["g", "part"]).withColumn("pos", F.col("i") + F.col("start")).drop("part", "i", "start", "salt")


def blocks_of(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, b, n, members): the nodes (g, pos, digest, ...) in aligned blocks of 2**bits; n: nodes of the group."""
    own = F.struct("pos", *(c for c in nodes.columns if c not in ("g", "pos")))
    grouped = nodes.groupBy("g", F.shiftright("pos", bits).alias("b")).agg(F.array_sort(F.collect_list(own)).alias("members"))  # 2**bits at most
    held = stash(grouped, "manifest-blocks")
    sizes = stash(held.groupBy("g").agg(F.sum(F.size("members")).alias("n")), "manifest-sizes")
    return held.join(small(sizes), "g")


def above(blocks: DataFrame, bits: int) -> DataFrame:
    """(g, b, subroot, path): the group's root and the path to it from each block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, digests = ("g", "b", "n"), []
            for n, members in zip(batch.column("n").to_pylist(), batch.column("members").to_pylist(), strict=True):
                nodes = [m["digest"] for m in members]
                digests.append(postorder(nodes, height_of(len(nodes), n, bits))[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(digests, pa.string())], names=[*names, "digest"])

    slim = blocks.select("g", "b", "n", F.transform("members", lambda m: F.struct(m["digest"].alias("digest"))).alias("members"))
    roots = stash(slim.mapInArrow(run, "g string, b long, n long, digest string"), "manifest-roots")
    none = F.array().cast(T.ArrayType(STEP))
    several = F.col("n") > 1 << bits
    out = roots.where(~several).select("g", "b", F.col("digest").alias("subroot"), none.alias("path"))
    upper = roots.where(several).select("g", F.col("b").alias("pos"), "digest")
    if not upper.limit(1).count():
        return out
    next_up = blocks_of(upper, bits)
    return out.unionByName(with_paths(next_up, stash(above(next_up, bits), "manifest-tops"), bits).select("g", F.col("pos").alias("b"), "subroot", "path"))


def with_paths(blocks: DataFrame, tops: DataFrame, bits: int) -> DataFrame:
    """Every member of the blocks with g, its group's `subroot` and its whole `path` to it."""
    both = blocks.join(small(tops), ["g", "b"])
    member = blocks.schema["members"].dataType.elementType
    names = member.fieldNames()
    schema = T.StructType([T.StructField("g", T.StringType()), *member.fields, T.StructField("subroot", T.StringType()), T.StructField("path", T.ArrayType(STEP))])
    steps = pa.list_(_STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, n, subroot, path = (batch.column(c)[i].as_py() for c in ("g", "n", "subroot", "path"))
                members = batch.column("members")[i].values
                digests = members.field("digest").to_pylist()
                up = [(s["side"], s["digest"]) for s in path]
                own = [[{"side": s, "digest": d} for s, d in p + up] for p in postorder(digests, height_of(len(digests), n, bits))[1]]
                m = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([g] * m, pa.string()), *(members.field(c) for c in names), pa.array([subroot] * m, pa.string()), pa.array(own, steps)], names=["g", *names, "subroot", "path"])

    return both.mapInArrow(run, schema)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(acc: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.when(step["side"] == "left", step["digest"]).otherwise(F.lit("")), acc, F.when(step["side"] == "right", step["digest"]).otherwise(F.lit(""))), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple = FIELDS, bits: int = BITS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, path) of every row; path: struct(side, digest) of the siblings from the leaf to the root,
    both empty where a node has none.  extra: further columns, worked out where the leaves are."""
    extra = extra or {}
    with scratch():
        named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others
        own = [c.alias(f"x_{k}") for k, c in extra.items()]
        first = docs.select(named.alias("g"), F.col(id).alias("id"), leaf_of([F.col(c) for c in fields]).alias("digest"), *own)
        leaves = stash(first.withColumn("salt", F.monotonically_increasing_id()), "manifest-leaves")
        blocks = blocks_of(numbered(leaves, ["id", "digest"]), bits)
        tops = stash(above(blocks, bits), "manifest-above", keep=True)
        subroots = tops.where("b = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("subroot").alias("digest"), F.lit(0).cast("long").alias("salt"))
        over = blocks_of(numbered(subroots, ["id"]), bits)
        roots = with_paths(over, stash(above(over, bits), "manifest-tops"), bits).select(F.col("id").alias("g"), F.col("subroot").alias("root"), F.col("path").alias("up"))
        roots = stash(roots, "manifest-top", keep=True)
        blocks = stash(blocks, "manifest-leaf-blocks", keep=True)
    rows = with_paths(blocks, tops, bits).join(small(roots), "g")
    named = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    path = F.concat("path", "up").alias("path")
    return rows.select("id", named.alias("group"), F.col("digest").alias("leaf"), "subroot", "root", path, *(F.col(f"x_{k}").alias(k) for k in extra))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the proof holds after some rows were tampered with."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = manifest(docs, extra={"tampered": F.when(hit, changed)})
    proof = F.sha2(F.array_join("path.digest", ""), 256)
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_merkle_manifest": (op13_merkle_manifest, None)}
