"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become token pieces of at most SEQUENCE tokens.  Only the histogram of piece lengths (at most
SEQUENCE numbers) reaches the driver.  There, patterns of two to six lengths that fill a sequence exactly
are enumerated, and their repeat counts are fitted to the histogram by non-negative least squares: an active
set of patterns, no larger than the number of lengths, grows by those that the misfit asks for most.  Counts
are rounded by largest remainder within what there is, and the residual lengths are packed best-fit
decreasing.  The plan is a table of runs (a length's pieces from a rank on lie in sequences from a number
on, at one offset); its size does not depend on how many pieces there are.

A piece's rank among those of its length is its number in the task that cut it plus the numbers of the tasks
before, so that no length, however common, meets in one task.

Defined results: a null text is the empty text, whose only token is the end mark; repeated rows are packed
each; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.shared import stored

SEQUENCE, END = 2048, 0
#: Most documents of a pattern, and how often each length is drawn as the first of as many.
DOCUMENTS, DRAWS = 6, 8
#: Patterns that may join the active set at once, and rounds of doing so.
BLOCK, ROUNDS = 64, 60
#: Characters tokenised at once; longer texts are cut at white space, which tokens never cross.
CUT = 1_000_000
#: Words, and runs between white space, that a worker remembers; the first that it meets.
WORDS, RUN = 600_000, 64
Pattern = tuple[tuple[int, ...], int]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of these characters alone are cut into the tokenizer's words here; others go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u017f\\u2013\\u2014\\u2018-\\u201f\\u2026\\u20ac]*")
# fixed values: the words that word_bpe_49k.json cuts lower-cased text into before merging
_WORD = re.compile(r"[a-zªµº\xdf-\xf6\xf8-\u017f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|(?:[^\w\s]|_)+")


def _cuts(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > CUT:
        end = next((k for k in range(at + CUT, len(text)) if text[k].isspace()), len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.  Merges never cross a word's edge, so words are encoded once and remembered.

    Only for tokenizers that cut words as _WORD does (`by_word`); others encode every text whole.
    """

    def __init__(self, path: str, most: int = WORDS):
        self.tokenizer, self.most = _tokenizer(path), most
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}  # of characters between white space
        self.by_word = path.endswith("word_bpe_49k.json")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of runs that are not remembered.  Words that are new are encoded together; both are remembered while there is room."""
        cut = {r: _WORD.findall(r) for r in runs}
        words, fresh = self.words, {}
        if new := list({w for ws in cut.values() for w in ws if w not in words}):
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            fresh = {w: raw[a:b] for w, a, b in zip(new, [0, *ends], ends, strict=False)}
            if len(ends) != len(new):
                raise ValueError("words do not end where the tokenizer ends them")
        made = {r: b"".join([words[w] if w in words else fresh[w] for w in ws]) for r, ws in cut.items()}
        for store, more in ((self.words, fresh), (self.runs, made)):
            if len(store) < self.most:
                store.update((k, v) for k, v in more.items() if len(k) <= RUN)
        return made

    def __call__(self, text: str) -> bytes:
        out = []
        for part in _cuts(text):
            if self.by_word and "<|" not in part and _PLAIN.fullmatch(part):
                runs = part.lower().split()
                got = list(map(self.runs.get, runs))
                if None in got:
                    gaps = [k for k, ids in enumerate(got) if ids is None]
                    other = self._learn({runs[k] for k in gaps})
                    for k in gaps:
                        got[k] = other[runs[k]]
                out.append(b"".join(got))
            else:
                out.append(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return Encoder(path)


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("own", T.LongType())])


def pieces(documents: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document; part is the task that cut it, own its number there among those of its length."""

    end, width = np.array([END], "<u4").tobytes(), 4

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part_id, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                for piece, start in enumerate(range(0, len(ids), width * sequence)):
                    part = ids[start : start + width * sequence]
                    length = len(part) // width
                    rows.append((doc_id, piece, start // width, length, zlib.crc32(part), part_id, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=PIECES.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES)


def list_patterns(hist: np.ndarray, sequence: int, draws: int = DRAWS, seed: int = 5) -> np.ndarray:
    """Patterns of two to DOCUMENTS present lengths that fill a sequence exactly, one a row, longest first, zeros behind.

    Every length that is there is the first of `draws` patterns of each size; the others are drawn by their
    share of the pieces, and the last is the one that fills the sequence, where there is such a length.
    """
    there = np.flatnonzero(hist[:sequence])
    there = there[there > 0]
    if not len(there):
        return np.zeros((0, DOCUMENTS), np.int64)
    share, rng, found = np.cumsum(hist[there]) / hist[there].sum(), np.random.default_rng(seed), []
    for k in range(1, DOCUMENTS):
        first = np.repeat(there, draws if k > 1 else 1)
        more = there[np.minimum(np.searchsorted(share, rng.random((len(first), k - 1)), "right"), len(there) - 1)]
        last = sequence - first - more.sum(1)
        fits = np.flatnonzero((last > 0) & (hist[np.maximum(last, 0)] > 0))
        rows = np.zeros((len(fits), DOCUMENTS), np.int64)
        rows[:, 0], rows[:, 1:k], rows[:, k] = first[fits], more[fits], last[fits]
        found.append(rows)
    rows = np.unique(-np.sort(-np.concatenate(found), 1), axis=0)
    needs = (rows[:, :, None] == rows[:, None, :]).sum(2)  # how often a pattern uses each of its lengths
    return rows[((rows == 0) | (needs <= hist[rows])).all(1)]


def fit_counts(patterns: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """How often each pattern repeats: non-negative least squares of the patterns' lengths to the histogram.

    An active set method: the patterns with the steepest descent join, the least squares of the active ones
    are solved by conjugate gradients, and a step stops where a count reaches nought and its pattern leaves.
    Lengths count by their relative misfit.
    """
    scale = 1 / np.sqrt(np.maximum(hist, 1.0))
    scale[0] = 0
    target, width, most = hist * scale, patterns.shape[1], int((hist[1:] > 0).sum())

    def forward(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), weights=np.repeat(x, width), minlength=len(hist)) * scale

    def back(rows: np.ndarray, misfit: np.ndarray) -> np.ndarray:
        return (misfit * scale)[rows].sum(1)

    def least_squares(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        misfit = target - forward(rows, x)
        g = d = back(rows, misfit)
        now = first = g @ g
        for _ in range(60):
            if now <= 1e-7 * first:
                break
            ahead = forward(rows, d)
            step = now / (ahead @ ahead)
            x, misfit = x + step * d, misfit - step * ahead
            g = back(rows, misfit)
            now, before = g @ g, now
            d = g + now / before * d
        return x

    x, active = np.zeros(len(patterns)), np.zeros(len(patterns), bool)
    for _ in range(ROUNDS):
        descent = back(patterns, target - forward(patterns[active], x[active]))
        descent[active] = 0
        joining = np.argsort(-descent, kind="stable")[: max(0, min(BLOCK, most - int(active.sum())))]
        joining = joining[descent[joining] > 1e-3]
        if not len(joining):
            break
        active[joining] = True
        while True:
            at = np.flatnonzero(active)
            now, best = x[at], least_squares(patterns[at], x[at])
            below = best <= 1e-9
            if not below.any():
                x[at] = best
                break
            leaving = below & (now <= 0)
            if not leaving.any():
                step = (now[below] / (now[below] - best[below])).min()
                now = now + step * (best - now)
                leaving = now <= 1e-9
            x[at] = np.where(leaving, 0, now)
            active[at[leaving]] = False
    return x


def best_fit_decreasing(hist: np.ndarray, sequence: int) -> list[Pattern]:
    """Best-fit decreasing of the lengths, in runs of equal bins."""
    spaces: dict[int, list[list]] = defaultdict(list)  # space left -> [lengths, bins]
    open_at = np.zeros(sequence + 1, bool)
    for length in range(len(hist) - 1, 0, -1):
        left = int(hist[length])
        while left:
            fits = np.flatnonzero(open_at[length:])
            if len(fits):
                space = length + int(fits[0])
                lengths, bins = spaces[space].pop()
                if not spaces[space]:
                    open_at[space] = False
                k = min(left, bins)
                if bins > k:
                    spaces[space].append([lengths, bins - k])
                    open_at[space] = True
                new = ((*lengths, length), k)
            else:
                n = min(sequence // length, left)
                k = max(1, left // n)
                new = ((length,) * n, k)
            left -= k * (len(new[0]) - (len(lengths) if len(fits) else 0))
            rest = sequence - sum(new[0])
            spaces[rest].append([new[0], new[1]])
            open_at[rest] = rest > 0
    return [(tuple(lengths), bins) for groups in spaces.values() for lengths, bins in groups if bins]


def rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Pattern]:
    """Whole repeats: first the whole part of each count, then one more by largest remainder, as far as `left` (taken from) has the pieces."""
    whole = np.floor(x).astype(np.int64)
    rest = x - whole
    by_rest = np.argsort(-rest, kind="stable")
    wanted = [*((k, int(whole[k])) for k in np.flatnonzero(whole)), *((k, 1) for k in by_rest if rest[k] > 0.05)]
    out: list[Pattern] = []
    for k, n in wanted:
        lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((tuple(patterns[k][patterns[k] > 0].tolist()), n))
    return out


def plan(hist: np.ndarray, sequence: int = SEQUENCE) -> tuple[list[Pattern], list[Pattern]]:
    """(lengths of one sequence, how many such sequences), which use every piece once: full pieces and fitted patterns, then the residual's."""
    left = hist.astype(np.int64).copy()
    full = [((sequence,), int(left[sequence]))] if left[sequence] else []
    left[sequence] = 0
    patterns = list_patterns(left, sequence)
    fitted = rounded(patterns, fit_counts(patterns, left.astype(float)), left) if len(patterns) else []
    return full + fitted, best_fit_decreasing(left, sequence)


def runs(made: list[Pattern], sequence: int = SEQUENCE) -> dict[str, np.ndarray]:
    """For each length and rank from: the first sequence's number and the offset there; sorted by length and rank."""
    used = np.zeros(sequence + 1, np.int64)
    rows, base = [], 0
    for lengths, n in made:
        at = 0
        for length in lengths:
            rows.append((length, used[length], base, at))
            used[length] += n
            at += length
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 48 | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def ranked(cut: DataFrame) -> DataFrame:
    """cut with rank, each piece's gapless number among those of its length."""
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("length", "part", before.alias("before"))
    return cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def pack(documents: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, fitted) for each piece of each document; fitted tells its place comes from a fitted pattern (or it fills a sequence)."""
    spark = documents.sparkSession
    cut = stored(pieces(documents, path or default_tokenizer(), sequence), "pieces")
    hist = np.zeros(sequence + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        hist[r.length] = r["count"]
    fitted, residual = plan(hist, sequence)
    from_residual = sum(n for _, n in fitted)
    table = spark.sparkContext.broadcast(runs(fitted + residual, sequence))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        k = np.searchsorted(t["key"], (length.to_numpy(np.int64) << 48) | rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][k] + rank.to_numpy(np.int64) - t["rank"][k], "offset": t["offset"][k]})

    placed = ranked(cut).withColumn("at", look_up("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", (F.col("at.sequence_id") < from_residual).alias("fitted"))
