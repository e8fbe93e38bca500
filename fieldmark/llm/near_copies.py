"""Near copies by the similarity of their five-word shingles: one document of each group stays.

Two texts are linked where the Jaccard similarity of their sets of word shingles is at least LEAST.
Candidates come from the SimHash blocks of simhash_blocks: every distinct set has a fingerprint, the majority
of its shingles' bits, and a key for each choice of blocks, which meets all sets within DISTANCE bits.  Sets of
similarity 0.8 lie ten bits apart on average, so what lies further has BANDS further keys of ROWS minhashes: two
sets of similarity s share none with a probability of (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above.  A
shared key only makes a candidate; what links is the exact similarity of the two sets.

Work is over distinct sets.  First each member of a key is held against the key's least member, which
gathers the groups in a number of pairs that is linear in the members.  Then, in keys that still hold more
than one group, members of different groups are held against each other in bounded parts, each of which
reports a forest: by their whole signatures, and what is not clearly below LEAST there by their sets.

Defined results: null, empty and blank texts have the empty set and are copies of each other; a text of
fewer than WIDTH words is one shingle; repeated rows and null ids are treated as in simhash_blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm import simhash_blocks
from fieldmark.llm.components import components
from fieldmark.llm.shared import stored
from fieldmark.llm.simhash_blocks import DISTANCE, SEED, block_keys, majority, shingles

WIDTH, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
#: Sets of one key, and shingles in them, that are compared in one task.
SPLIT, SPLIT_GRAMS = 2048, 2_000_000
#: Signatures that agree in a smaller share are not looked at further: at similarity 0.8 that is over nine standard deviations down.
DOUBT = 0.5
#: Shingles that are hashed by all functions at once.
CHUNK = 4096

_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def gram_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    grams = set(shingles(text or "", WIDTH))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def signature(grams: np.ndarray) -> np.ndarray:
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(out, (_MULTIPLY * low[at : at + CHUNK] + _ADD).min(1), out=out)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _print(grams: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(grams.tobytes(), SEED))


@F.pandas_udf(T.LongType())
def _prints(text: pd.Series) -> pd.Series:
    return pd.Series([_print(gram_set(t)) for t in text], dtype="int64")


@F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bits", T.LongType()), T.StructField("minima", T.BinaryType())]))
def _sketch(text: pd.Series) -> pd.DataFrame:
    sets = (gram_set(t) for t in text)
    return pd.DataFrame([(_print(g), len(g), _signed(majority(g)), signature(g).tobytes()) for g in sets], columns=["fp", "size", "bits", "minima"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(minima: pd.Series) -> pd.Series:
    width = 4 * ROWS
    return pd.Series([[_signed(xxhash.xxh64_intdigest(m[k * width : (k + 1) * width], k)) for k in range(BANDS)] for m in minima], dtype=object)


@F.pandas_udf(T.BinaryType())
def _sets(text: pd.Series) -> pd.Series:
    return pd.Series([gram_set(t).tobytes() for t in text], dtype=object)


@F.pandas_udf(T.BooleanType())
def _alike(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= LEAST - 1e-12 for a, b in zip(one, other, strict=True)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _forests(bands: pd.Series, parts: pd.Series) -> pd.Series:
    """Of each part a forest of links that connects the groups its members connect.

    A pair within DISTANCE bits counts under keys of blocks, which it always shares; any other in the first band it shares.
    """
    out = []
    for band, part in zip(bands, parts, strict=True):
        fp, root, size, bits = (np.array([m[c] for m in part], np.int64) for c in ("fp", "root", "size", "bits"))
        minima = np.array([np.frombuffer(m["minima"], np.uint32) for m in part]).reshape(len(part), BANDS, ROWS)
        sets = [np.frombuffer(m["grams"], np.uint64) for m in part]
        found = []
        for k in range(len(fp) - 1):
            rest = k + 1 + np.flatnonzero((root[k + 1 :] != root[k]) & (np.minimum(size[k + 1 :], size[k]) >= LEAST * np.maximum(size[k + 1 :], size[k]) - 1e-9))
            same = minima[rest] == minima[k]
            close = np.bitwise_count((bits[rest] ^ bits[k]).view(np.uint64)) <= DISTANCE
            here = close if band >= BANDS else ~close & (same.all(2).argmax(1) == band)
            for x in rest[(same.mean((1, 2)) >= DOUBT) & here]:
                if root[x] != root[k] and similarity(sets[k], sets[x]) >= LEAST - 1e-12:
                    found.append({"a": int(fp[k]), "b": int(fp[x])})
                    root[root == root[x]] = root[k]
        out.append(found)
    return pd.Series(out, dtype=object)


def links(sketches: DataFrame, texts: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that connect exactly the sets that similarity connects.

    sketches has one row (fp, rid, size, bits, minima) for each distinct set, texts (rid, text) a row with that rid.
    """
    keys = F.concat(_keys("minima"), F.transform(block_keys(F.col("bits")), lambda k: k["bits"]))  # the choices of blocks follow the bands
    keyed = sketches.filter("size > 0").select("fp", "size", "bits", F.posexplode(keys).alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.min("fp").alias("a"), F.min_by("bits", "fp").alias("a_bits"), F.count("*").alias("n")).filter("n > 1")
    members = stored(keyed.join(shared, ["band", "key"]), "shared-keys")
    wanted = sketches.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "rid")
    sets = stored(texts.join(wanted, "rid").select("fp", _sets("text").alias("grams")), "gram-sets")

    def alike(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("fp").alias("a"), F.col("grams").alias("one"))
        other = sets.select(F.col("fp").alias("b"), F.col("grams").alias("other"))
        return pairs.join(one, "a").join(other, "b").filter(_alike("one", "other")).select("a", "b")

    near = stored(alike(members.filter(f"a != fp and (band < {BANDS} or bit_count(bits ^ a_bits) <= {DISTANCE})").select("a", F.col("fp").alias("b")).distinct()), "near-sets")
    groups = components(near).select(F.col("node").alias("fp"), "root")
    rooted = members.join(groups, "fp", "left").select("band", "key", "fp", "size", "bits", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "grouped-keys")
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.sum("size").alias("grams")).filter("x != y")
    # the least member has been held against all: a key of two is settled
    mixed = mixed.filter("n > 2").select("band", "key", F.ceil(F.greatest(F.col("n") / split, F.col("grams") / SPLIT_GRAMS)).cast("int").alias("parts"))
    dealt = rooted.join(mixed, ["band", "key"]).join(sketches.select("fp", "minima"), "fp").join(sets, "fp")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = dealt.select("band", "key", "part", F.struct("fp", "root", "size", "bits", "minima", "grams").alias("m"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    parts = paired.groupBy("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list("m").alias("ms"))
    further = parts.filter(F.size("ms") > 1).select(F.explode(_forests("band", "ms")).alias("e")).select("e.a", "e.b").distinct()
    return near.union(stored(further, "further-near-sets"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row, as simhash_blocks.near_duplicates."""
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), _sketch("text").alias("s"))
    marked = stored(rows.select("doc_id", "text", "rid", "s.*"), "sketches")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("rid"), F.count("*").alias("n")), "distinct-sets")
    sketches = stored(marked.select("rid", "fp", "size", "bits", "minima").join(distinct.select("rid"), "rid", "left_semi"), "distinct-sketches")
    return simhash_blocks.in_components(marked, distinct, links(sketches, marked.select("rid", "text")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies: that of the smallest doc_id."""
    return simhash_blocks.one_of_each(documents, groups=near_duplicates(documents), mark=_prints)
