import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value that compares alike from both engines."""
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool) or str(type(v)).endswith("bool'>"):
        return bool(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def moved(spark, work):
    """What work() gives, and the bytes that it shuffled and spilled."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        kind = spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        stages, out = spark.sparkContext._jsc.sc().statusStore().store().view(kind).iterator(), {}
        while stages.hasNext():
            x = stages.next().info()
            out[x.stageId(), x.attemptId()] = x.shuffleWriteBytes() + x.diskBytesSpilled()
        return out

    before = total()
    got = work()
    return got, sum(v - before.get(k, 0) for k, v in total().items() if k in before or not before or k[0] > min(before)[0])
