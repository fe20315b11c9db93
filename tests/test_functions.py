"""Column functions, time windows and the stemmer on known cases."""

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.stem import stem, stems
from tallyloom.functions.when import DAY, month, window

NOW = 1_710_500_000_000  # 2024-03-15, a Friday


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "abcdef", lambda c: X.head(c, 3)) == "abc…"
    assert one(spark, None, lambda c: X.head(c, 3)) is None
    assert one(spark, "a\nb\nc", lambda c: X.tail_lines(c, 2, 10)) == "b\nc"
    assert one(spark, "a\n\nb\nc\nd\ne", lambda c: X.error_digest(c, 1, 2, 100)) == "a\n…\nd\ne"
    assert one(spark, "2024-01-01T00:00:00.250+02:00", X.parse_ts) == 1_704_060_000_250
    assert one(spark, "2024-01-01", X.parse_ts) is None
    assert one(spark, "git@host.org:team/Repo.git", X.remote_id) == "host.org/team/repo"
    assert one(spark, "https://u:p@host.org/team/repo/", X.remote_id) == "host.org/team/repo"
    assert one(spark, "/a/./b/../c\\d", X.clean_parts) == ["a", "c", "d"]
    assert one(spark, "see #12, #3x and #12", X.cited_ids) == [3, 12]
    assert one(spark, "MultiEdit", X.canonical_tool) == "edit"
    assert one(spark, "tests FAILED", X.error_class) == "test_fail"
    assert "redacted" in one(spark, "password = hunter2hunter2", X.redact)
    assert one(spark, "nothing here", X.redact) == "nothing here"


def test_window():
    assert month("sep") == 9 and month("agu") == 8 and month("xx") is None
    w = window("what happened yesterday?", NOW)
    assert w.end - w.start == DAY and w.end % DAY == 0
    w = window("on 2024-03-01", NOW)
    assert w.label == "2024-03-01" and w.end - w.start == DAY
    assert window("since 2024-03-01", NOW).end == NOW
    assert window("31 feb", NOW).start == window("2 march", NOW).start  # days run on
    assert window("20 december", NOW).start < NOW  # no future without a year
    assert window("today", NOW).end == NOW
    assert window("last week", NOW).start == 1_709_510_400_000  # a Monday
    assert window("the past 3 days", NOW).start == NOW - 3 * DAY
    assert window("nothing", NOW) is None


def test_stem(spark):
    cases = {"caresses": "caress", "ponies": "poni", "retries": "retri", "happily": "happili", "relational": "relat", "hopping": "hop", "agreed": "agre", "vietnamization": "vietnam", "controll": "control", "rate": "rate", "sky": "sky"}
    assert {w: stem(w) for w in cases} == cases
    df = spark.createDataFrame([("hopping",), (None,)], "w string")
    assert [r["s"] for r in df.select(stems(F.col("w")).alias("s")).collect()] == ["hop", None]


def test_records(spark):
    from tallyloom.functions import records as P

    assert one(spark, "a <pasted_content id=1>xé</pasted_content> b <pasted_content>yy", P.strip_pasted) == "a [pasted 3 chars] b [pasted 2+ chars]"
    assert one(spark, "no paste", P.strip_pasted) == "no paste"
    assert one(spark, '{"a": "x", "n": 3, "o": {"p": 1}}', P.brief) == "a=x n=3"
    assert one(spark, "One two. Three four five six", lambda c: P.excerpt(c, 12)) == "One two.…"
    assert one(spark, "abcdefghijklmnop", lambda c: P.excerpt(c, 5)) == "abcde…"
    assert one(spark, "short", lambda c: P.excerpt(c, 10)) == "short"
