"""What several operators of this package need: tables, scratch storage, checked sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a new local one in local mode (tests), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


#: A key with over a HOT-th of the rows is joined by broadcast.
HOT = 4096


def join_counted(rows: DataFrame, known: DataFrame, key: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined to known, which has one row for each key with n, the number of rows of that key in `rows`.

    Keys of over a HOT-th of all rows (`total`, the sum of n) are fewer than HOT and go by broadcast, so that
    none of them meets in one task; the others are joined as usual.  `how` is inner or left.
    """
    if total is None:
        total = known.agg(F.sum("n")).first()[0] or 0
    hot, cold = known.filter(F.col("n") * HOT > total), known.filter(F.col("n") * HOT <= total)
    common = rows.join(F.broadcast(hot.drop("n")), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop("n"), key, how)
    return common.unionByName(others)


def held_out(doc_id, folds: int = 5):
    """True for the rows whose crc32(doc_id as text) mod folds is 0: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))
