"""A session with the settings that the engine relies on, and file access through Spark's own file systems."""

from __future__ import annotations

import json
import os
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tasks for each core of rows that are spread.
TASKS_A_CORE = 4


def session(app: str = "docfold", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a few tasks a core, as many as a shuffle has partitions at most, for work whose time goes by rows and not by bytes.
    The number keeps adaptive execution from putting small partitions together, and the hash keeps the planner from leaving the shuffle out where
    rows are dealt by these keys already: their shuffle may have been put together. More tasks would only cost their start and, of each shuffle
    that follows, a file for each of its partitions."""
    return rows.repartition(tasks_for_rows(rows.sparkSession), F.hash(*keys))


def tasks_for_rows(spark: SparkSession) -> int:
    """A few tasks a core, as many as a shuffle has partitions at most."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


class ConcurrentWrite(RuntimeError):
    """Another writer was first; read again and repeat."""


class Files:
    """Small files beside tables, on whatever file system the path is on."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.conf)

    def local(self) -> bool:
        """Whether the files are on a local or mounted file system."""
        return str(self._at("")[1].getUri().getScheme()) == "file"

    def plain(self) -> str:
        """The root's path on its file system."""
        path, fs = self._at("")
        return str(fs.makeQualified(path).toUri().getPath()).rstrip("/")

    def moved(self, source: str, target: str) -> None:
        """Gives a folder a name that nothing has, in one step."""
        _, fs = self._at("")
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(source), self.jvm.org.apache.hadoop.fs.Path(target)):
            raise ConcurrentWrite(f"{target} can't be made from {source}")

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def read(self, name: str, default: Any = None) -> Any:
        path, fs = self._at(name)
        if not fs.exists(path):
            return default
        stream = fs.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self, name: str) -> list[int]:
        """The numbers n of the files ``<name>-<n>.json``."""
        path, fs = self._at(f"{name}-*.json")
        found = [str(f.getPath().getName()) for f in fs.globStatus(path) or ()]
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(re.escape(name) + r"-(\d+)\.json", f)))

    def numbers(self, folder: str, key: str) -> list[int]:
        """The numbers n of the folders ``<folder>/<key>=<n>``."""
        path, fs = self._at(f"{folder}/{key}=*")
        return sorted(int(str(f.getPath().getName()).partition("=")[2]) for f in fs.globStatus(path) or ())

    def pairs(self, one: str, two: str) -> list[tuple[str, str]]:
        """The values (a, b) of the folders ``<one>=<a>/<two>=<b>``."""
        path, fs = self._at(f"{one}=*/{two}=*")
        found = [f.getPath() for f in fs.globStatus(path) or ()]
        return [(str(f.getParent().getName()).partition("=")[2], str(f.getName()).partition("=")[2]) for f in found]

    def latest(self, name: str, default: Any = None) -> tuple[int, Any]:
        """The greatest version and what it says; 0 and ``default`` without one."""
        have = self.versions(name)
        return (have[-1], self.read(f"{name}-{have[-1]}.json")) if have else (0, default)

    def publish(self, name: str, version: int, value: Any, keep: int = 8) -> None:
        """Makes ``value`` the next version: written beside and given a name that must be new, so a reader sees the old
        version or all of the new one, whenever the writer stops. Of two writers of a version, one fails, where giving a name is one step
        that fails if it is taken: a rename on HDFS and what behaves like it, a hard link on local disks, where a rename would replace. Stores
        whose rename copies (plain object stores) can let both win; put the ledger's pointer on one of the others there."""
        path, fs = self._at(f"{name}-{version}.json")
        beside, _ = self._at(f"_{name}-{version}-{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False), "utf-8"))
        out.close()
        if not self._named(fs, beside, path):
            fs.delete(beside, False)
            raise ConcurrentWrite(f"{name} has a version {version} already")
        for old in self.versions(name)[:-keep]:
            self.delete(f"{name}-{old}.json")

    def _named(self, fs, beside, path) -> bool:
        """Whether the file got its name, which nothing had before."""
        if str(fs.getUri().getScheme()) != "file":
            return not fs.exists(path) and fs.rename(beside, path)
        try:
            os.link(str(beside.toUri().getPath()), str(path.toUri().getPath()))
        except FileExistsError:
            return False
        fs.delete(beside, False)
        return True

    def delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)
