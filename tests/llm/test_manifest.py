"""The Merkle manifest against plain trees: nulls, ties, repeated rows, groups of one, several traversals."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and each node's path: (side, digest) of the sibling or ("", "")."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        pairs = [(nodes[i : i + 2], own[i : i + 2]) for i in range(0, len(nodes), 2)]
        for pair, below in pairs:
            for k in below[0]:
                paths[k].append(("right", pair[1]) if len(pair) == 2 else ("", ""))
            for k in below[1] if len(pair) == 2 else ():
                paths[k].append(("left", pair[0]))
        nodes, own = [digest(*p) for p, _ in pairs], [sum(b, []) for _, b in pairs]
    return nodes[0], paths


def plain_rows(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: digest(*(told(x) for x in (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order]
    root, ups = plain_tree([t[0] for t in trees])
    for k, (sub, paths), up in zip(order, trees, ups, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[k], key=lambda x: x[:3]), paths, strict=True):
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for side, d in path + up:
                now = digest(d, now) if side == "left" else digest(now, d) if side else digest(now)
            yield r[0], own, sub, root, digest(*(d for _, d in path + up)), now, now == root


ROWS = [(i, "é" * (i % 5) + "x", ["en", "de", "zz", None][i % 4 if i < 60 else 0], "s" if i % 3 else None, i if i % 6 else None) for i in range(120)]
ROWS += [(7, "", "", "", 0), (8, None, "", None, None), *[(3, "same", "en", "s", 1)] * 9, (None, "n", "en", None, 2), (None, None, None, None, None), (500, "x" * 300_000, "Zz", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = ROWS[:]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)


def result(docs, bits):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = manifest.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in manifest.FIELDS])
    rows = manifest.manifest(docs, bits=bits, extra={"tampered": F.when(hit, changed)})
    end = manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select("id", "leaf", "subroot", "root", F.sha2(F.array_join("path.digest", ""), 256), end.alias("end"), end == F.col("root"))


@pytest.mark.parametrize("bits", [1, 2, 3, manifest.BITS])
def test_against_plain_trees(docs, bits):
    want = Counter(plain_rows(ROWS))
    assert Counter(map(tuple, result(docs, bits).collect())) == want
    assert 0 < sum(not k[-1] for k in want.elements()) < len(ROWS) / 3


def test_every_change_of_a_field_shows(spark):
    """A changed field, and lengths moved from one field to the next, give another leaf."""
    rows = [(1, "ab", "en", "s", 2), (1, "a", "en", "sb", 2), (1, "ab", None, "s", 2), (1, "ab", "", "s", 2), (1, "ab", "en", "s", None), (2, "ab", "en", "s", 2), (1, "ab", "-", "s", 2)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert docs.select(manifest.leaf_of([F.col(c) for c in manifest.FIELDS])).distinct().count() == len(rows)


def test_small_tables(spark, docs):
    assert manifest.manifest(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(*ROWS[0], "", "")], SCHEMA)
    row = manifest.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == []


def test_query_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert Counter(map(tuple, manifest.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect())) == Counter(plain_rows(map(tuple, rows)))
