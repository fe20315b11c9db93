"""Numbered commits in a folder that several writers share, and where tables are kept.

A commit is one small JSON file, made under its number if nobody has made it: the whole of it appears at once or not at all.
Writers put their data under names of their own first and then try for the next number; one that finds it taken has lost and
its data are never read.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tallyloom-kept-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def opened(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    store, at = opened(spark, path)
    store.delete(at, True)


class Commits:
    """The commits of a folder, from number 0 on; each has the whole state, so only the last one is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_commits"

    def number(self) -> int:
        """Number of the last commit; -1 for none."""
        store, at = opened(self.spark, self.folder)
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self, number: int) -> dict | None:
        """What a commit says; None for -1."""
        if number < 0:
            return None
        store, at = opened(self.spark, self._path(number))
        stream = store.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        at = self.number()
        return at, self.read(at)

    def put(self, number: int, state: dict) -> bool:
        """Makes a commit; False if another has made it.  Needs a store that renames at once and not over what is there (local disks
        and HDFS do)."""
        target = self._path(number)
        store, to = opened(self.spark, target)
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(draft)
        stream = store.create(at, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if store.getUri().getScheme() == "file":  # its rename would replace the other's commit
                os.link(at.toUri().getPath(), to.toUri().getPath())
                return True
            jvm, options = self.spark._jvm, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(at, to, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            store.delete(at, False)

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:010d}.json"
