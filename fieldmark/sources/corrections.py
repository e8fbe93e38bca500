"""Late corrections of a table kept by season: changed rows replace old ones in the seasons they touch, and what they replaced is kept.

A batch of corrections has a name.  Under it the replaced rows are written first, then the touched seasons, then a
commit record; the other seasons' files are never read or written.  A batch that is applied again, after a failure or
a replay, ends in the same table and the same history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.store import Store


def latest_changes(changes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row a key: the last by `at`; of several at one moment the greatest in order of the columns."""
    others = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at]))
    return changes.groupBy(*keys).agg(last.alias("__c")).select(*keys, "__c.*").select(changes.columns)


def corrected(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(current with the changes in, the rows of current that they replace or remove).

    changes has current's columns and `deleted`; rows that say what is there already replace nothing.
    """
    values = [c for c in current.columns if c not in keys]
    new = changes.select(*keys, F.struct(*values).alias("__new"), F.coalesce(F.col("deleted"), F.lit(False)).alias("__gone"))
    old = current.select(*keys, F.struct(*values).alias("__old"))
    both = old.join(new, list(keys), "full")
    kept = F.when(F.col("__gone").isNull(), F.col("__old")).when(~F.col("__gone"), F.col("__new"))
    differs = F.col("__old").isNotNull() & F.col("__gone").isNotNull() & (F.col("__gone") | ~F.col("__old").eqNullSafe(F.col("__new")))
    after = both.withColumn("__k", kept).filter(F.col("__k").isNotNull()).select(*keys, "__k.*").select(current.columns)
    return after, both.filter(differs).select(*keys, "__old.*").select(current.columns)


def apply_corrections(store: Store, name: str, changes: DataFrame, keys: Sequence[str], batch: str, at: str = "corrected_at", season: str = "season") -> list[int]:
    """Bring a batch into the table `name`, partitioned by season; the seasons that were written, none for a batch that was there.

    keys hold the season.  changes has the table's columns, `at` and `deleted`.
    """
    if season not in keys:
        raise ValueError("a correction's keys need the season it belongs to")
    mark = f"{name}.commits/{batch}.json"
    if store.exists(mark):
        return []
    spark = changes.sparkSession
    wanted = store.keep(f"{name}.work/{batch}-changes", latest_changes(changes, keys, at))
    seasons = sorted(r[0] for r in wanted.select(season).distinct().collect())
    if seasons:
        table = spark.read.parquet(store.path(name)) if store.exists(name) else wanted.drop(at, "deleted").limit(0)
        columns = [c for c in wanted.columns if c not in (at, "deleted")]
        current = table.filter(F.col(season).isin(seasons)).select(*[F.col(c).cast(wanted.schema[c].dataType).alias(c) for c in columns])
        held = store.keep(f"{name}.work/{batch}-before", current)  # what a second try starts from
        after, replaced = corrected(held, wanted, keys)
        store.keep(f"{name}.history/batch={batch}", replaced)
        done = store.keep(f"{name}.work/{batch}-after", after)
        writer = done.repartition(season).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season)
        writer.parquet(store.path(name))
        gone = set(seasons) - {r[0] for r in done.select(season).distinct().collect()}
        for s in gone:  # every row removed
            store.delete(f"{name}/{season}={s}")
    store.write_json(mark, {"seasons": seasons})
    store.delete(f"{name}.work")
    return seasons


def history(store: Store, name: str) -> DataFrame:
    """All replaced rows, with the batch that replaced them."""
    batches = [b for b in store.names(f"{name}.history") if b.startswith("batch=")]
    parts = [store.spark.read.parquet(store.path(f"{name}.history/{b}")).withColumn("batch", F.lit(b.removeprefix("batch="))) for b in batches]
    if not parts:
        raise FileNotFoundError(store.path(f"{name}.history"))
    return reduce(DataFrame.unionByName, parts)
