"""Artifacts and tables under one folder of any file system that Spark reads, each written whole or not at all.

Everything goes through Hadoop's file system, so driver and executors see one place.  A text or a table is written
beside its name and then renamed: a reader, or a second run after a failure, finds the old one or the new one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession

#: Where a long plan may be cut: gives the frame back, perhaps read from a table it was written to under that name.
Keep = Callable[[str, DataFrame], DataFrame]
#: Begins the names of what depends on the settings of the part under way.
OWN = "own-"


def unkept(name: str, df: DataFrame) -> DataFrame:
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new local one in local mode (tests), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Store:
    """Named texts, JSON and Parquet tables under a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    @staticmethod
    def temporary(spark: SparkSession, name: str) -> Store:
        """A store of its own in the shared folder."""
        return Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def version(self, names: Iterable[str]) -> str:
        """What changes when a file under one of the names does: from paths, sizes and times of writing."""
        told = []
        for name in names:
            fs, path = self._at(name)
            files = fs.listFiles(path, True) if fs.exists(path) else None
            while files is not None and files.hasNext():
                at = files.next()
                told.append(f"{at.getPath()} {at.getLen()} {at.getModificationTime()}")
        return sha1("\n".join(sorted(told)).encode()).hexdigest()[:16]

    def names(self, name: str = "") -> list[str]:
        """The files and folders directly under a name."""
        fs, path = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def _rename(self, written: str, name: str) -> None:
        """Put `written` in the place of `name`, in one step where the file system can."""
        fs, source = self._at(written)
        _, target = self._at(name)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(source), fs.makeQualified(target), options)

    def write_text(self, name: str, text: str) -> None:
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        fs, path = self._at(beside)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._rename(beside, name)

    def read_text(self, name: str) -> str:
        """The text; FileNotFoundError where there is none."""
        fs, path = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(self.path(name))
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_json(self, name: str, payload: dict) -> None:
        self.write_text(name, json.dumps(payload, default=str, sort_keys=True, indent=1))

    def read_json(self, name: str) -> dict:
        return json.loads(self.read_text(name))

    def write_table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df under a name that has no table yet, and read it back: lineage ends here."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        df.write.parquet(self.path(beside))
        fs, target = self._at(name)
        if fs.exists(target):
            fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._at(beside)[1], target):
            raise OSError(f"cannot rename to {self.path(name)}")
        return self.table(df, name)

    def table(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """The table of that name, written from df where there is none."""
        return self.table(df, name) if self.exists(name) else self.write_table(df, name)
