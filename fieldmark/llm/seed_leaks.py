"""Benchmark decontamination by spaced seeds.

Fixed masks choose the token positions of a window that are hashed and ignore the others, so a window
still meets its counterpart when ignored tokens were substituted.  Every window of every document is
looked up among the benchmark's window hashes; around a hit the two texts are aligned on the hit's
diagonal and the longest stretch with at least IDENTITY equal tokens, substituted ones at its edges among them, is
kept if it is LEAST tokens long (or covers a shorter item whole).

The benchmark is the stated query set: it is read in blocks of at most BLOCK_TOKENS tokens (a single
longer item makes a block of its own).  One block after another is made, sent to the tasks and released;
with a single block documents are never shuffled.

Defined results: null and empty texts have no leaks; items of fewer than SHORTEST tokens match only texts
of just these tokens; repeated items and repeated documents are reported each; tokens are \\w+ of the lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.shared import stored

MASKS = ("1101111", "11101011", "110110011", "1110010101", "11100001101")
#: By an item's length the further masks over the whole of it: with MASKS, every place of the substitutions IDENTITY allows is fitted.
SHORT_MASKS = {
    5: ("01111", "11101", "11011", "10111", "11110"), 6: ("111001", "100111", "011110"), 7: ("1111001", "1010111", "0111110"), 8: ("10110101",),
    10: ("1100001011", "1010110001"), 11: ("11010110001",),
}
IDENTITY, LEAST, SHORTEST = 0.8, 12, 5
BLOCK_TOKENS = 1_000_000
#: Window pairs that are put in order at once.
PAIRS = 1 << 20
_WORD = re.compile(r"\w+")
_FILTER_BITS = 22


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def longest_overlap(a: np.ndarray, identity: float = IDENTITY) -> tuple[int, int]:
    """(start, end) of the longest stretch of the boolean a with at least that share of True; it may begin and end on any token, the first of equally long ones counts."""
    if not a.any():
        return 0, 0
    # a stretch from i to before j is good enough when the balance at j, True over its share, is not below that at i
    balance = np.concatenate(([0.0], np.cumsum(a - identity)))
    best = np.maximum.accumulate(balance[::-1])  # the best balance from the end back, rising
    j = len(a) - np.searchsorted(best, balance - 1e-9, "left")  # the last place that a stretch from i can reach
    i = int((j - np.arange(len(j))).argmax())
    return i, int(j[i])


class Seeds:
    """The window hashes of a block of benchmark items, and the search of documents for them."""

    def __init__(self, items: Iterable[tuple[int, str]], masks: tuple[str, ...] = MASKS, identity: float = IDENTITY, least: int = LEAST):
        self.identity, self.least = identity, least
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        like: dict[tuple[int, ...], int] = {}
        self.tiny: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in items:
            own = tokens(text)
            if 0 < len(own) < SHORTEST:
                self.tiny.setdefault(tuple(own), []).append(item_id)
                continue
            w = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in own]
            if not w:
                continue
            at = like.setdefault(tuple(w), len(self.words))
            if at == len(self.words):
                self.ids.append([])
                self.words.append(np.array(w, np.int64))
            self.ids[at].append(item_id)  # items of like words are searched once
        short = [m for n in sorted({len(w) for w in self.words}) for m in SHORT_MASKS.get(n, ())]
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in (*masks, *short)]
        spans = [len(m) for m in (*masks, *short)]
        rng = np.random.default_rng(2024)
        self.mix = rng.integers(1, 1 << 63, (len(self.masks), max(spans, default=1)), np.uint64) | np.uint64(1)
        self.whole = [k >= len(masks) for k in range(len(self.masks))]
        self.spans = spans
        keys, before, owner, place = [], [], [], []
        for n, w in enumerate(self.words):
            for k in range(len(self.masks)):
                if self.whole[k] and len(w) != spans[k]:
                    continue
                h, _ = self._hashes(w, k)
                keys.append(h)
                before.append(np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)])
                owner.append(np.full(len(h), n))
                place.append(np.arange(len(h)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        behind = np.concatenate(before) if before else np.zeros(0, np.uint64)
        order = np.lexsort((behind, self.keys))
        self.keys, behind = self.keys[order], behind[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        # windows by (hash, hash of the window before), as numbers that sort the same
        self.behinds = np.unique(behind)
        self.first = np.searchsorted(self.keys, self.keys, "left")
        self.both = self.first * (len(self.behinds) + 1) + np.searchsorted(self.behinds, behind)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def _hashes(self, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window under mask k, and whether all hashed tokens are known."""
        n = len(w) - self.spans[k] + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        u = w.astype(np.uint64)
        for p in self.masks[k]:
            part = u[p : p + n]
            known &= part != 0
            h += part * self.mix[k, p]
            h ^= h >> np.uint64(29)
        h *= self.mix[k, 0]
        return h ^ (h >> np.uint64(32)), known

    def _diagonals(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray, firsts: np.ndarray) -> Iterator[np.ndarray]:
        """(text, item, diagonal) of the pairs of each window with the postings from begin to end, PAIRS at a time."""
        n = end - begin
        total = np.concatenate([[0], np.cumsum(n)])
        cuts = np.unique(np.concatenate([[0, len(n)], np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.repeat(np.arange(x, y), n[x:y])
            if len(own):
                e = begin[own] + np.arange(len(own)) - (total[own] - total[x])
                yield np.unique(np.stack([np.searchsorted(firsts, at[own], "right") - 1, self.owner[e], at[own] - self.place[e]], 1), axis=0)

    def search(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item_id, start, length, matched), the longest overlap for each item, in order of item."""
        known = self.vocabulary.get
        parts, starts, whole, total, gap = [], [], [], 0, max(self.spans, default=1)
        for text in texts:
            w = tokens(text)
            starts.append((total, len(w)))
            whole.append(self.tiny.get(tuple(w), []) if len(w) < SHORTEST else [])
            part = np.zeros(len(w) + gap, np.int64)
            part[: len(w)] = [known(t, 0) for t in w]
            parts.append(part)
            total += len(part)
        out: list[list[tuple[int, int, int, int]]] = [[(i, 0, n, n) for i in ids] for ids, (_, n) in zip(whole, starts, strict=True)]
        if not parts or not len(self.keys):
            return out
        w = np.concatenate(parts)
        firsts = np.array([s for s, _ in starts])
        found = [np.zeros((0, 3), np.int64)]
        for k in range(len(self.masks)):
            h, all_known = self._hashes(w, k)
            at = np.flatnonzero(all_known & self.maybe[h >> np.uint64(64 - _FILTER_BITS)])
            lo = np.searchsorted(self.keys, h[at], "left")
            hi = np.searchsorted(self.keys, h[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            # a pair whose windows before are equal too lies on a diagonal that the earlier pair has: repetitive texts have few others
            behind = np.where((at > 0) & all_known[at - 1], h[at - 1], np.uint64(0))
            rank = np.searchsorted(self.behinds, behind)
            there = (behind != 0) & (rank < len(self.behinds)) & (self.behinds[np.minimum(rank, len(self.behinds) - 1)] == behind)
            both = lo * (len(self.behinds) + 1) + rank
            a = np.where(there, np.searchsorted(self.both, both, "left"), hi)
            b = np.where(there, np.searchsorted(self.both, both, "right"), hi)
            for begin, end in ((lo, a), (b, hi)):
                found.extend(self._diagonals(at, begin, end, firsts))
        met = np.unique(np.concatenate(found), axis=0)
        starts_at = np.flatnonzero(np.any(met[1:, :2] != met[:-1, :2], axis=1)) + 1 if len(met) else np.zeros(0, int)
        seen = {(int(g[0, 0]), int(g[0, 1])): g[:, 2].tolist() for g in np.split(met, starts_at) if len(g)}
        for (doc, n), diagonals in seen.items():
            item, (first, size) = self.words[n], starts[doc]
            best = (0, 0, 0)
            ranges = sorted((max(0, first - d) - min(len(item), first + size - d), d) for d in diagonals)
            for shorter, d in ranges:  # those on which most of the item can lie come first
                if -shorter <= best[1]:
                    break
                lo, hi = max(0, first - d), min(len(item), first + size - d)
                same = w[d + lo : d + hi] == item[lo:hi]
                a, b = longest_overlap(same, self.identity)
                if b - a >= min(self.least, len(item)) and b - a > best[1]:
                    best = (d + lo + a - first, b - a, int(same[a:b].sum()))
            if best[1]:
                out[doc].extend((i, *best) for i in self.ids[n])
        return [sorted(found) for found in out]


class seed_blocks(Sequence):  # noqa: N801
    """The benchmark's seeds, in blocks of about `most` tokens; each is made when it is asked for and not kept."""

    def __init__(self, benchmark: DataFrame, most: int = BLOCK_TOKENS):
        self.sized = benchmark.select("item_id", "text").filter("text is not null")
        total = self.sized.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0))).head()[0]
        self.blocks = max(1, -(-total // most))

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, k: int) -> Seeds:
        if not 0 <= k < self.blocks:
            raise IndexError(k)
        rows = self.sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)) == k).orderBy("item_id", "text").collect()
        return Seeds([(r.item_id, r.text) for r in rows])


def _searcher(shared: Broadcast, schema: str, shape):
    @F.pandas_udf(schema)
    def search(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), 256):
            out.extend(map(shape, shared.value.search(text[at : at + 256])))
        return pd.Series(out, dtype=object)

    return search


def _block_by_block(spark: SparkSession, blocks: seed_blocks, found: Callable[[Broadcast], DataFrame], name: str) -> DataFrame:
    """What is found with each block, in one table; of several blocks each is searched, stored and released before the next."""
    parts = []
    for k in range(len(blocks)):
        shared = spark.sparkContext.broadcast(blocks[k])
        part = found(shared)
        if len(blocks) == 1:
            return part
        parts.append(stored(part, name))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _as_rows(found):
    return [{"item_id": a, "start_token": b, "aligned": c, "matched": d} for a, b, c, d in found]


def leaks(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, start_token, aligned, matched): the longest overlap of each document and item that overlap."""

    def found(shared: Broadcast) -> DataFrame:
        search = _searcher(shared, "array<struct<item_id:long,start_token:int,aligned:int,matched:int>>", _as_rows)
        return documents.select("doc_id", F.explode(search("text")).alias("e")).select("doc_id", "e.*")

    return _block_by_block(documents.sparkSession, seed_blocks(benchmark, most), found, "leaks")


def decontaminate(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """documents without those that overlap a benchmark item; with one block nothing is shuffled, with more the leaky texts are taken off by digest."""
    spark, blocks = documents.sparkSession, seed_blocks(benchmark, most)
    if len(blocks) == 1:
        return documents.filter(~_searcher(spark.sparkContext.broadcast(blocks[0]), "boolean", bool)("text"))

    def found(shared: Broadcast) -> DataFrame:
        return documents.filter(_searcher(shared, "boolean", bool)("text")).select(F.sha2("text", 256).alias("__leaky"))

    leaky = _block_by_block(spark, blocks, found, "leaky-texts").distinct()
    return documents.join(leaky, F.sha2("text", 256) == F.col("__leaky"), "left_anti")
