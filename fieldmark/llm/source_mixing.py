"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in one line, in an order that only their content decides, and the line is cut into
blocks of equal numbers of words.  The mix takes an exact quota of blocks of each source: whole passes over all
its blocks (at most REPEATS) and, in the last pass, the first blocks of a keyed permutation.  A tree splits the
quotas among output shards: a node that holds m blocks of mixed sources gives its left half as many of each as a
draw without replacement would (a multivariate hypergeometric draw, seeded by the node), so that every shard ends
with its exact number of blocks and none is drawn twice.  A shard's range of a source's draws names its blocks by
themselves; within the shard they are shuffled by a keyed hash.

One row of numbers a source reaches the driver, the recipe: size, weight, quota, a bound for each shard.  No row
of documents does.  Equal rows (same id, source and text) are one record with a count, spread again in runs of
RUN rows, and places in line come from sums over hash buckets whose number follows the number of records, so
neither a common source nor a common row meets in one task.

Defined results: a null text has size 0; null is a source of its own and the last; a document of size 0 is taken
0 times; equal rows stand in line each and have a row each; a null id is an id; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.shared import join_counted, stored

#: Weights of the sources in order of code points, repeating, and how often a document may be taken.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block at most, and blocks that a source is cut into at least, as far as it has the words.
BLOCK, BLOCKS = 64, 4096
SHARDS, SEED = 64, 7
#: Equal rows that one row stands for while they are placed.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Recipe:
    """What the mix does with one source: draws below `quota` are taken, and shard s has those from bounds[s] on to before bounds[s + 1]."""

    source: str | None
    size: int
    target: float
    block: int
    quota: int
    bounds: tuple[int, ...] = ()

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> np.ndarray:
    """Shares of the sum of sizes by weight; those over `repeats` sizes stop there and the excess is shared anew."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    most, free = size * repeats, np.ones(len(size), bool)
    out = np.zeros(len(size))
    while free.any():
        left = size.sum() - most[~free].sum()
        out = np.where(free, left * weight / weight[free].sum(), most)
        above = free & (out > most)
        if not above.any():
            break
        free &= ~above
    return np.minimum(out, most)


def quota(size: int, target: float, block: int) -> int:
    """Draws whose words come nearest the target: whole passes and the rest in blocks."""
    if not size:
        return 0
    blocks = -(-size // block)
    passes = int(target // size)
    return passes * blocks + min(blocks, round((target - passes * size) / block))


def split(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(sources, shards): how many draws of each source every shard gets.

    Shards' sizes differ by one at most.  Each node of the tree draws its left half's share without replacement,
    source by source: hypergeometric given what the sources before have left.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def give(held: np.ndarray, low: int, high: int, node: int) -> None:
        if high - low == 1:
            out[:, low] = held
            return
        mid = (low + high) // 2
        whole = int(held.sum())
        per, more = divmod(whole, high - low)
        room = (mid - low) * per + min(more, mid - low)
        left, rest = np.zeros_like(held), whole
        draw = np.random.default_rng([seed, node])
        for k, n in enumerate(held):
            rest -= int(n)
            left[k] = hypergeometric(draw, int(n), rest, room)
            room -= int(left[k])
        give(left, low, mid, 2 * node)
        give(held - left, mid, high, 2 * node + 1)

    give(np.array(quotas, np.int64), 0, shards, 1)
    return out


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good; beyond a thousand million, by the normal law within the possible."""
    if good + bad < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, n))
    whole = good + bad
    mean = n * (good / whole)
    spread = (mean * (bad / whole) * ((whole - n) / max(1, whole - 1))) ** 0.5
    return int(min(max(round(draw.normal(mean, spread)), n - bad, 0), good, n))


def recipes(sizes: Sequence[tuple[str | None, int]], shards: int = SHARDS, seed: int = SEED) -> list[Recipe]:
    """The recipe of every source; sources in order of code points, null last."""
    known = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(known))]
    aims = targets([n for _, n in known], weights)
    made = []
    for (source, size), target in zip(known, aims, strict=True):
        block = min(BLOCK, max(1, size // BLOCKS))
        made.append(Recipe(source, size, float(target), block, quota(size, target, block)))
    dealt = np.cumsum(split([r.quota for r in made], shards, seed), axis=1)
    return [Recipe(r.source, r.size, r.target, r.block, r.quota, (0, *map(int, dealt[k]))) for k, r in enumerate(made)]


def key_of(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each k in a keyed permutation of 0 .. n - 1: four Feistel rounds, again while the result is outside."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    x = k.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        left, right = y >> np.uint64(half), y & mask
        for r in range(4):
            f = (right + np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        x[todo] = left << np.uint64(half) | right
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def dealt(start: np.ndarray, size: np.ndarray, quota_: int, block: int, blocks: int, bounds: np.ndarray, key: int) -> dict[str, np.ndarray]:
    """The draws that take words of one source's documents at start .. start + size - 1: row, shard, place, from_word, words, by row and place."""
    some = size > 0
    low, high = start // block, np.where(some, (start + size - 1) // block, start // block - 1)
    n = high - low + 1
    row = np.repeat(np.arange(len(size)), n)
    own = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    first = np.maximum(own * block, start[row])
    count = np.minimum((own + 1) * block, (start + size)[row]) - first
    place = permuted(own, blocks, key)
    found = []
    for turn in range(-(-quota_ // blocks)):
        draw = turn * blocks + place
        k = np.flatnonzero(draw < quota_)
        found.append((row[k], np.searchsorted(bounds, draw[k], "right") - 1, draw[k], (first - start[row])[k], count[k]))
    names = ("row", "shard", "place", "from_word", "words")
    out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
    order = np.lexsort((out[2], out[0]))
    return {k: v[order] for k, v in zip(names, out, strict=True)}


def records(documents: DataFrame) -> DataFrame:
    """(doc_id, source, digest, size, n): one row for equal rows, n of them."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), words(text).alias("size"))
    return rows.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n"))


def in_line(found: DataFrame, total: int) -> DataFrame:
    """found with start, the words of the same source before a record; copies of a record stand one behind the other."""
    buckets = max(1, math.isqrt(total))  # so many buckets of so many records each
    spot = F.xxhash64("doc_id", "digest", "size")
    dealt = found.withColumn("bucket", F.pmod(spot, F.lit(buckets)))
    per = dealt.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("held"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    own = W.partitionBy("source", "bucket").orderBy(spot, "doc_id", "digest", "size").rowsBetween(W.unboundedPreceding, -1)
    stood = dealt.withColumn("own", F.coalesce(F.sum(F.col("size") * F.col("n")).over(own), F.lit(0)))
    joined = stood.join(per, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    return joined.withColumn("start", F.col("ahead") + F.col("own")).drop("of", "in", "ahead", "own", "bucket")


def single(stood: DataFrame) -> DataFrame:
    """One row for each of the equal rows again, each with its own start."""
    runs = stood.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    few, many = runs.filter(F.col("n") <= RUN), runs.filter(F.col("n") > RUN).repartition("digest", "run")
    spread = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    return spread.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("run", "n")


def plan(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, digest, size, copy, start) of every row, with its source's recipe."""
    found = stored(records(documents), "mix-records")
    size, rows = F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("rows")
    per = found.groupBy("source").agg(size, rows, F.count("*").alias("records")).collect()  # the recipe: a row a source
    made = recipes([(r.source, r["size"]) for r in per], shards, seed)
    return recipe_rows(single(in_line(found, sum(r.records for r in per))), made, {r.source: r.rows for r in per})


def source_key(source: Column) -> Column:
    """A source's name without null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def recipe_rows(rows: DataFrame, made: list[Recipe], counts: dict[str | None, int]) -> DataFrame:
    """rows with their source's numbers; sources of many rows by broadcast, the others by a join."""
    given = [(r.source, r.size, r.target, r.quota, r.block, r.blocks, list(r.bounds), counts[r.source]) for r in made]
    known = rows.sparkSession.createDataFrame(given, "of string, source_size long, target double, quota long, block long, blocks long, bounds array<long>, n long")
    keyed = known.withColumn("key", source_key(F.col("of"))).drop("of")
    return join_counted(rows.withColumn("key", source_key(F.col("source"))), keyed, "key", sum(counts.values())).drop("key")


def _dealt(seed: int, of: str, sums: int = 0):
    """A column with the draws that take words of each row, structs of the fields `of`; with sums, the number of shards, only the words in each shard."""

    @F.pandas_udf(f"array<struct<{of}>>")
    def pieces(source: pd.Series, start: pd.Series, size: pd.Series, quota_: pd.Series, block: pd.Series, blocks: pd.Series, bounds: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(size))]
        for s in source.unique():
            at = np.flatnonzero(source.isna() if s is None else source == s)
            r = at[0]
            d = dealt(start.to_numpy(np.int64)[at], size.to_numpy(np.int64)[at], int(quota_[r]), int(block[r]), max(1, int(blocks[r])), np.asarray(bounds[r], np.int64), key_of(seed, s))
            if sums:
                both, which = np.unique(d["row"] * sums + d["shard"], return_inverse=True)
                d = {"row": both // sums, "shard": both % sums, "words": np.bincount(which, weights=d["words"], minlength=len(both)).astype(np.int64)}
            names = [c for c in d if c != "row"]
            for k, *values in zip(at[d["row"]].tolist(), *(d[c].tolist() for c in names), strict=True):
                out[k].append(dict(zip(names, values, strict=True)))
        return pd.Series(out, dtype=object)

    return pieces("source", "start", "size", "quota", "block", "blocks", "bounds")


def take(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, dealt) for every row: how many of its words the mix takes, repeats counted.

    They are what the shards' draws hold of it, added up; dealt has the words in each shard that holds any.
    """
    told = plan(documents, shards, seed).withColumn("dealt", _dealt(seed, "shard:int,words:long", shards))
    taken = F.aggregate("dealt", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return told.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "dealt")


def draws(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, digest, size, copy, shard, place, from_word, words): every stretch of a document that a draw takes.

    place is the draw's number in its source; draws of (source, place) are one block.
    """
    each = plan(documents, shards, seed).withColumn("p", F.explode(_dealt(seed, "shard:int,place:long,from_word:long,words:long")))
    return each.select("doc_id", "source", "digest", "size", "copy", "p.*")


def mix(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, source, place, doc_id, from_word, words, text): the mix, shuffled within each shard.

    Blocks come in the order of a keyed hash and their stretches in the order of the line.  Words are those of
    WORD, joined by one space.
    """
    taken = draws(documents, shards, seed)
    key, run = ["doc_id", "source", "digest", "size"], F.floor(F.col("copy") / RUN)
    each = taken.groupBy(*key, "copy").agg(F.collect_list(F.struct("shard", "place", "from_word", "words")).alias("pieces")).withColumn("run", run)
    text = F.col("text").cast("string")
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), words(text).alias("size"), text.alias("text"))
    kept = kept.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    kept = kept.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).drop("n")  # no key has over RUN rows
    k = kept.select(*[F.col(c).alias(f"k_{c}") for c in kept.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in (*key, "run")])
    cut = each.join(k, same).withColumn("all", F.regexp_extract_all("k_text", F.lit(WORD), F.lit(0)))
    out = cut.select("doc_id", "source", "copy", F.explode(F.transform("pieces", lambda p: F.struct(p.shard.alias("shard"), p.place.alias("place"), p.from_word.alias("from_word"), p.words.alias("words"), F.array_join(F.slice("all", (p.from_word + 1).cast("int"), p.words.cast("int")), " ").alias("text")))).alias("p"))
    flat = out.select("p.shard", "source", "p.place", "doc_id", "copy", "p.from_word", "p.words", "p.text")
    order = F.xxhash64(F.lit(seed), "source", "place")
    return flat.repartition("shard").sortWithinPartitions("shard", order, "source", "place", "doc_id", "copy", "from_word").drop("copy")
