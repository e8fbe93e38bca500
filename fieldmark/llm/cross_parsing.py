"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's labelled running text.  A text is parsed greedily
into the longest phrases that occur in the reference, across words; a phrase costs the logarithm of the
reference's length, the bits that point to a place in it, so that a language with a short reference is not at
a disadvantage.  The language that needs the fewest bits wins.

Texts are normalised alike for learning and parsing: lower case, runs of letters with one space between them
and around, as UTF-8 bytes (an alphabet that stays small in every script).  A parse starts anew every SEGMENT
bytes, so that the segments of a batch are parsed side by side in numpy.

The references come from a bounded sample of labelled rows: at most SAMPLE_DOCS distinct rows a language,
each with a running window of at most WINDOW characters at a place drawn from the row's hash, and a total of
TOTAL_BYTES dealt evenly over however many languages there are.  Every text is then parsed whole.

Defined results: `und` with score 0 for a null text or one without letters, and for every text where no
language was learned; ties go to the language with more labelled rows, then by name; repeated rows are
predicted each and are one row of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.shared import held_out

#: Bounds of the fit, as documented parameters.
SAMPLE_DOCS, WINDOW, TOTAL_BYTES = 60, 1200, 800_000
#: Bytes after which a parse starts anew, and bytes parsed side by side.
SEGMENT, TOGETHER = 1024, 1 << 23
_WORD = re.compile(r"[^\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Empty if there is no letter."""
    found = _WORD.findall(text.lower()) if text else []
    if not any(c.isalpha() for w in found for c in w):
        return b""
    return f" {' '.join(found)} ".encode("utf-8", "replace")


class SuffixAutomaton:
    """All substrings of a byte string as one table: row by row the state that a byte leads to, 0 for none."""

    def __init__(self, text: bytes):
        length, link, out = [0], [-1], [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append({})
            at = last
            while at >= 0 and c not in out[at]:
                out[at][c] = new
                at = link[at]
            if at >= 0:
                to = out[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    out.append(dict(out[to]))
                    while at >= 0 and out[at].get(c) == to:
                        out[at][c] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new
        alphabet = sorted(set(text))
        width = len(alphabet) + 1  # code 0: bytes that never occur
        self.size = len(text)
        self.codes = np.zeros(256, np.int32)
        self.codes[alphabet] = np.arange(1, width)
        states = np.repeat(np.arange(len(out)), [len(row) for row in out])
        reached = np.array([(c, t) for row in out for c, t in row.items()], np.int64).reshape(-1, 2)
        self.step = np.zeros(len(out) * width, np.int32)  # states are multiplied by the width, ready to be indexed
        self.step[states * width + self.codes[reached[:, 0]]] = reached[:, 1] * width

    def phrases(self, columns: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """How many longest matches each segment is parsed into.  Row t of columns holds byte t of the alive[t] segments that have one."""
        count = np.zeros(columns.shape[1], np.int64)
        state = np.zeros(columns.shape[1], np.int32)
        for row, n in zip(columns, alive.tolist(), strict=True):
            code = self.codes[row[:n]]
            to = self.step[state[:n] + code]
            # a phrase starts where the last one cannot go on; a byte that never occurs is a phrase by itself
            starts = (to == 0) | (state[:n] == 0)
            count[:n] += starts
            state[:n] = np.where(to == 0, self.step[code], to)
        return count


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' segments as columns, longest first; how many have a byte in each row; whose text each is."""
    cut = [(t[at : at + SEGMENT], k) for k, t in enumerate(texts) for at in range(0, len(t), SEGMENT)]
    cut.sort(key=lambda c: -len(c[0]))
    sizes = np.array([len(c) for c, _ in cut], np.int64)
    rows = np.zeros((len(cut), sizes[0] if len(cut) else 0), np.uint8)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(c for c, _ in cut), np.uint8)
    alive = np.searchsorted(-sizes, -np.arange(rows.shape[1]), "left")
    return np.ascontiguousarray(rows.T), alive, np.array([k for _, k in cut], np.int64)


class Languages:
    """An automaton for each language, in order of labelled rows."""

    def __init__(self, references: dict[str, bytes], counts: dict[str, int]):
        self.names = sorted((k for k in references if references[k]), key=lambda k: (-counts[k], k))
        self.automata = [SuffixAutomaton(references[k]) for k in self.names]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): phrases, each at the logarithm of the reference's length."""
        columns, alive, of = segments(texts)
        out = np.zeros((len(texts), len(self.names)))
        for k, a in enumerate(self.automata):
            out[:, k] = np.bincount(of, weights=a.phrases(columns, alive), minlength=len(texts)) * np.log2(a.size + 1)
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        group: list[tuple[int, bytes]] = []
        size = 0

        def tell() -> None:
            bits = self.bits([b for _, b in group])
            over = bits - bits.min(1, keepdims=True)
            share = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)  # the winner's, if a bit more makes a text half as likely
            for (at, _), best, s in zip(group, over.argmin(1).tolist(), share.tolist(), strict=True):
                lang[at], score[at] = self.names[best], s

        for at, text in enumerate(texts):
            if self.names and (raw := normalised(text)):
                group.append((at, raw))
                size += len(raw)
            if group and (size >= TOGETHER or at == len(texts) - 1):
                tell()
                group, size = [], 0
        return pd.DataFrame({"lang_pred": lang, "score": score})


def references(documents: DataFrame, docs: int = SAMPLE_DOCS, window: int = WINDOW, total: int = TOTAL_BYTES) -> tuple[dict[str, bytes], dict[str, int]]:
    """Each language's running text, from at most `docs` distinct rows outside the held-out fold (those of the least hashes), and its labelled rows."""
    usable = documents.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.withColumn("place", F.xxhash64(F.lit(7), "doc_id", "text"))
    found = {r.lang: r for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place", 0.02).alias("different")).collect()}
    if not found:
        return {}, {}
    # the least hashes, at a share that holds `docs` different rows with near certainty
    part = F.pmod("place", F.lit(1 << 40)) / (1 << 40)
    share = F.create_map(*[F.lit(x) for k, r in found.items() for x in (k, float(min(1.0, (1.2 * docs + 60) / r.different)))])
    at = F.pmod(F.xxhash64(F.lit(8), "place"), F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int") + 1
    chosen = usable.filter(part <= share[F.col("lang")]).groupBy("lang", "place").agg(F.min(F.substring("text", at, F.lit(window))).alias("text"))
    rows: dict[str, list[tuple[int, str]]] = {k: [] for k in found}
    for r in chosen.collect():
        rows[r.lang].append((r.place % (1 << 40), r.text))
    each = total // len(found)
    out = {}
    for lang, own in rows.items():
        texts = [normalised(t)[1:] for _, t in sorted(own)[:docs]]
        longest = max(1, each // max(1, len(texts)))  # with many languages all windows get shorter alike
        joined = b"".join(t[:longest] for t in texts)
        out[lang] = b" " + joined if joined else b""
    return out, {k: r.n for k, r in found.items()}


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS, window: int = WINDOW, total: int = TOTAL_BYTES) -> Languages:
    return Languages(*references(documents, docs, window, total))


def predict(documents: DataFrame, languages: Languages) -> Column:
    """A struct column (lang_pred, score) for the column text of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(languages)

    @F.pandas_udf("lang_pred string, score double")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    return parsed("text")
