"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.  It is cut
into BLOCKS blocks; two fingerprints that differ in `distance` bits agree in at least BLOCKS - distance
of them, so every link shows in a join on some choice of that many blocks.  Candidates are then held
against the Hamming distance itself.

Work is over distinct fingerprints: copies collapse before anything is joined.  A block key shared by
more than SPLIT fingerprints is dealt out as pairs of bounded parts, and each part pair reports a
spanning forest of its links instead of all pairs, which loses no connection.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer
than `shingle` words is one shingle; repeated rows each keep a row; a component of rows whose doc_id is
null throughout has component_id null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.components import components
from fieldmark.llm.shared import join_counted, stored

BITS, BLOCKS, DISTANCE, SHINGLE, SEED = 64, 6, 3, 3, 42
#: Fingerprints of one block key that are compared in one task.
SPLIT = 4096
#: Shingles whose bits are counted at once, so that very long texts need bounded memory.
CHUNK = 65_536


def shingles(text: str, width: int = SHINGLE) -> list[bytes]:
    """The word shingles of a text, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and white space is \x20 and \x09-\x0D
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    grams = shingles(text or "", width)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none without hashes."""
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in text), np.uint64, len(text)).view(np.int64))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """An array with one key for each choice of blocks - distance blocks: the choice's number and the bits in it."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[k] for k in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(number).cast("byte").alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    x = np.unique(fps).view(np.uint64)
    if len(x) == 2:
        return [(int(x[0].view(np.int64)), int(x[1].view(np.int64)))] if int(x[0] ^ x[1]).bit_count() <= distance else []
    unseen, out = np.ones(len(x), bool), []
    for start in range(len(x)):
        if not unseen[start]:
            continue
        unseen[start] = False
        front = [start]
        while front:
            k = front.pop()
            rest = np.flatnonzero(unseen)
            near = rest[np.bitwise_count(x[rest] ^ x[k]) <= distance]
            unseen[near] = False
            front.extend(near.tolist())
            out.extend((int(x[k].view(np.int64)), int(v)) for v in x[near].view(np.int64))
    return out


def _forests(distance: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forests(parts: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _forest(np.asarray(p, np.int64), distance)] for p in parts])

    return forests


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) that links connect."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.choice", "k.bits")
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = keyed.join(shared, ["choice", "bits"]).withColumn("parts", F.ceil(F.col("n") / split).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = dealt.select("choice", "bits", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    grouped = paired.groupBy("choice", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    found = grouped.filter(F.size("fps") > 1).select(F.explode(_forests(distance)("fps")).alias("e"))
    return found.select("e.a", "e.b").distinct()


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row: component_id is the smallest doc_id reachable, root the component's least fp."""
    marked = stored(documents.select("doc_id", _fingerprints("text").alias("fp")), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    return in_components(marked, distinct, links(distinct.select("fp"), distance))


def in_components(marked: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of marked; distinct has (fp, first_id, n) of each fp, edges link them."""
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = stored(distinct.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    known = join_counted(rooted.withColumnRenamed("n", "rows"), ids, "root").select("fp", "component_id", "root", F.col("rows").alias("n"))
    return join_counted(marked.select("doc_id", "fp"), stored(known, "known"), "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(documents: DataFrame, distance: int = DISTANCE, groups: DataFrame | None = None, mark=_fingerprints) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id (one of them, where it is repeated).

    groups has other components than those of near_duplicates, and mark gives a text's fp in them.
    """
    groups = stored(near_duplicates(documents, distance) if groups is None else groups, "near-duplicates")
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    repeated = kept.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    plain = documents.join(kept.select("doc_id").join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi")
    if repeated.isEmpty():
        return plain.select(documents.columns)
    # rows that share a kept doc_id (or have none): one row of each component among them
    again = documents.join(repeated.select(F.col("doc_id").alias("__again_id")), F.col("doc_id").eqNullSafe(F.col("__again_id"))).drop("__again_id")
    marked = again.withColumn("__fp", mark("text"))
    roots = kept.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    one = marked.join(roots, marked["__fp"].eqNullSafe(roots["__fp"]) & marked["doc_id"].eqNullSafe(roots["__id"])).dropDuplicates(["doc_id", "__root"]).select(documents.columns)
    return plain.select(documents.columns).unionByName(one)
