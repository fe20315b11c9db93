"""Tables with one row for each key, kept in runs that are never changed: what is new supersedes what is old.

A run is a folder of Parquet, dealt into BUCKETS by its first key.  New rows become a run of their own; the keys they share with
older runs go to delete lists of those, found in the touched buckets alone.  So a read is a union without a window or a sort, and
each key is read once.  Merging writes runs of like size as one.  A table here is a value: `state` says what it consists of, and
it is the commit that names it that counts.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, FANOUT = 16, 4


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str | T.StructType, state: list[dict] | None = None):
        self.spark, self.folder, self.keys, self.state = spark, folder.rstrip("/"), keys, state or []
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _key(self) -> Column:
        """Keys as one text; nulls count as keys."""
        return F.md5(F.to_json(F.struct(*self.keys)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(BUCKETS)).cast("int")

    def _run(self, run: dict) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField("_k", T.StringType()), T.StructField("_b", T.IntegerType())])
        return self.spark.read.schema(kept).parquet(f"{self.folder}/{run['name']}")

    def _living(self, run: dict, buckets: list[int] | None = None) -> DataFrame:
        rows = self._run(run)
        rows = rows if buckets is None else rows.where(F.col("_b").isin(buckets))
        for name in run["dead"]:
            rows = rows.join(self.spark.read.schema("_k string").parquet(f"{self.folder}/{name}/_r={run['name']}"), "_k", "left_anti")
        return rows

    def _union(self, runs: list[dict], buckets: list[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_k", T.StringType()), T.StructField("_b", T.IntegerType())]))
        for i, run in enumerate(runs):
            out = self._living(run, buckets) if i == 0 else out.unionByName(self._living(run, buckets))
        return out

    def rows(self) -> DataFrame:
        return self._union(self.state).select(*self.schema.names)

    def like(self, rows: DataFrame) -> DataFrame:
        """The table's rows whose keys occur in `rows`, from the buckets that these touch."""
        keys = rows.select(self._key().alias("_k"), self._bucket().alias("_b")).distinct()
        buckets = [r["_b"] for r in keys.select("_b").distinct().collect()]  # BUCKETS at most
        return self._union(self.state, buckets).join(keys.select("_k"), "_k", "left_semi").select(*self.schema.names)

    def put(self, fresh: DataFrame) -> KeyedTable:
        """The table with these rows (keys once each) in place of what it had under their keys."""
        name, dead = f"run-{uuid.uuid4().hex}", f"dead-{uuid.uuid4().hex}"
        shaped = fresh.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).withColumns({"_k": self._key(), "_b": self._bucket()})
        shaped.repartition("_b").sortWithinPartitions("_b", *self.keys).write.partitionBy("_b").parquet(f"{self.folder}/{name}")
        new = {"name": name, "rows": 0, "dead": []}
        written = self._run(new)
        sizes = {r["_b"]: r["n"] for r in written.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS at most
        new["rows"] = sum(sizes.values())
        if not new["rows"]:
            return self
        old, hit = self.state, {}
        if old:
            parts = [self._living(r, list(sizes)).select("_k", F.lit(r["name"]).alias("_r")) for r in old]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            path = f"{self.folder}/{dead}"
            every.join(written.select("_k"), "_k", "left_semi").write.partitionBy("_r").parquet(path)
            hit = {r["_r"]: r["n"] for r in self.spark.read.schema("_k string, _r string").parquet(path).groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each run
        kept = [{**r, "rows": r["rows"] - hit.get(r["name"], 0), "dead": r["dead"] + [dead] * (r["name"] in hit)} for r in old]
        return self._with([r for r in kept if r["rows"]] + [new])

    def merge(self) -> KeyedTable:
        """The table with FANOUT or more runs of like size, and what is deleted in them, as one run."""
        tiers: dict[int, list[dict]] = {}
        for r in self.state:
            tiers.setdefault(int(math.log(max(r["rows"], 1), FANOUT)), []).append(r)
        for _, own in sorted(tiers.items()):
            if len(own) >= FANOUT:
                alone = KeyedTable(self.spark, self.folder, self.keys, self.schema).put(self._union(own).select(*self.schema.names))
                return self._with([r for r in self.state if r not in own] + alone.state).merge()
        return self

    def _with(self, state: list[dict]) -> KeyedTable:
        return KeyedTable(self.spark, self.folder, self.keys, self.schema, state)
