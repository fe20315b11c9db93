"""What git says about a repository, as tables: commits, added lines, changed files, state of the work tree.

A call has a time limit and a failed one gives no rows.  The output of a call is parsed by DataFrame functions, so that stored outputs
of many repositories can be parsed at once.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECONDS = 1.5


def call(root: str, *args: str, seconds: float = SECONDS) -> str:
    """Output of git in a folder; empty if it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.decode("utf-8", "replace")


def said(spark: SparkSession, root: str, *args: str, seconds: float = SECONDS) -> DataFrame:
    """(root, at, line) of a call's output."""
    text = call(root, *args, seconds=seconds)
    return spark.createDataFrame([(root, i, line) for i, line in enumerate(text.split("\n")) if line], "root string, at int, line string")


LOG = ("log", "--format=commit %H %at %ct %P", "--numstat")
SHOW = ("log", "--format=commit %H %at %ct %P", "-p", "-U0", "--no-color", "--no-ext-diff", "--no-renames")


def _commits(lines: DataFrame) -> DataFrame:
    """lines with the commit that they belong to."""
    head = F.when(F.col("line").rlike("^commit [0-9a-f]{40} "), F.split("line", " "))
    w = W.partitionBy("root").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("_h", F.last(head, ignorenulls=True).over(w)).withColumns({"commit": F.get("_h", F.lit(1)), "authored": F.get("_h", F.lit(2)).cast("long"), "committed": F.get("_h", F.lit(3)).cast("long"), "parent": F.nullif(F.get("_h", F.lit(4)), F.lit(""))}).drop("_h")


def commits(lines: DataFrame) -> DataFrame:
    """(root, commit, authored, committed, parent) of LOG's or SHOW's output; times in seconds."""
    return _commits(lines).where(F.col("line").startswith("commit ")).select("root", "commit", "authored", "committed", "parent")


def changes(lines: DataFrame) -> DataFrame:
    """(root, commit, path, added, removed) of LOG's output; null numbers for binary files."""
    p = F.split("line", "\t")
    rows = _commits(lines).where(F.col("line").rlike("^([0-9]+|-)\t([0-9]+|-)\t"))
    return rows.select("root", "commit", F.get(p, F.lit(2)).alias("path"), F.expr("try_cast(split(line, '\t')[0] AS long)").alias("added"), F.expr("try_cast(split(line, '\t')[1] AS long)").alias("removed"))


def added_lines(lines: DataFrame) -> DataFrame:
    """(root, commit, authored, committed, path, line, text) of SHOW's output: each added line with its number in the new file."""
    rows = _commits(lines)
    w = W.partitionBy("root").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    hunk = F.regexp_extract("line", r"^@@ -[0-9,]+ \+([0-9]+)", 1)
    in_head = F.col("line").startswith("diff --git ")
    mark = F.when(in_head, F.lit(-1)).when(hunk != "", hunk.cast("long"))  # -1: a file's head, in which +++ is no added line
    rows = rows.withColumn("_start", F.last(mark, ignorenulls=True).over(w)).withColumn("_hunk", F.sum(mark.isNotNull().cast("int")).over(w))
    name = F.when((F.col("_start") == -1) & F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    rows = rows.withColumn("path", F.last(name, ignorenulls=True).over(w))
    plus = (F.col("_start") >= 0) & F.col("line").startswith("+")
    number = F.col("_start") + F.sum(plus.cast("long")).over(W.partitionBy("root", "_hunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - 1
    return rows.withColumn("_n", number).where(plus & (F.col("path") != "/dev/null")).select("root", "commit", "authored", "committed", "path", F.col("_n").alias("line"), F.expr("substring(line, 2)").alias("text"))


def state(lines: DataFrame) -> DataFrame:
    """(root, path, how) of `status --porcelain`: added, modified, deleted, renamed or unknown; a rename has its new path."""
    code = F.trim(F.substring("line", 1, 2))
    how = F.when(code == "??", "unknown").when(code.contains("R"), "renamed").when(code.contains("D"), "deleted").when(code.contains("A"), "added").otherwise("modified")
    path = F.expr("substring(line, 4)")
    return lines.where(F.length("line") > 3).select("root", F.when(code.contains("R"), F.regexp_extract(path, "-> (.*)$", 1)).otherwise(path).alias("path"), how.alias("how"))
