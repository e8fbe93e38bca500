"""Cross-tokenizer alignment by a string of byte labels.

Two tokenizers cut the same bytes: A a byte-level BPE, B a piece model that puts a space before the text.  Every
byte of " " + text gets a label: no token ends there, one of A, one of B, or one of both.  A regular expression
scans the label string for spans up to each both-label; the labels inside count the tokens of a group, and each
label other than none stands for one link, a pair of tokens that share bytes.

Neither tokenizer merges across a single space between two characters that are not white space, so both ends lie
there: texts are cut at such places into chunks, and a worker labels a chunk once and remembers it.  `Aligner`
checks that the piece model allows it and labels whole texts if it does not.

What the corpus says of a pair of ids grows with it.  Documents are dealt into blocks of bounded size as they are
read; a block knows its distinct pairs and how often it holds each.  The counts of a pair are added up over
blocks, and each block gets back the totals of its own pairs: a pair, however common, is a row a block.

Defined results: documents whose text is null, empty, or not rebuilt by the bytes of both tokenizers have no
tokens: zeros and an empty digest; repeated rows count each; a null id stays null; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.shared import stored

#: A block ends at as many bytes of text, or as many chunks that it was first to meet.
BLOCK_BYTES, BLOCK_NEW = 12_000_000, 150_000
#: Chunks that a worker may remember from block to block; beyond, it keeps so many of those met most often.
REMEMBERED, KEPT = 360_000, 250_000
#: Ids of B are below; a pair is a * WIDTH + b.
WIDTH = 1 << 16
GROUP = re.compile(rb"[^c]*c")
PART = "block long, of_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_chunks long, chunks binary, pairs array<long>, counts array<long>, starts array<int>, of_chunk array<int>"
TOLD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def labels(a: np.ndarray, b: np.ndarray) -> bytes:
    """One label a byte from both cuts' token lengths, which have one sum: . for none, a, b, c for both."""
    out = np.full(int(a.sum()), 46, np.uint8)
    ends = np.cumsum(b) - 1
    out[np.cumsum(a) - 1] = 97
    out[ends] = np.where(out[ends] == 97, 99, 98)
    return out.tobytes()


def groups(marks: bytes) -> Iterator[tuple[int, int]]:
    """How many tokens of A and of B each group has."""
    for span in GROUP.findall(marks):
        yield span.count(b"a") + 1, span.count(b"b") + 1


def links(marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the two tokens of each link, in order of bytes: every end closes one link."""
    ends = np.frombuffer(marks.replace(b".", b""), np.uint8)
    i, j = np.cumsum(ends != 98), np.cumsum(ends != 97)
    return np.concatenate(([0], i[:-1])), np.concatenate(([0], j[:-1]))


class Aligner:
    """The two tokenizers and what is known of the chunks met, by number: how many tokens and groups, the groups' text, the pairs of ids.

    The pairs of chunk k are pairs[starts[k] : starts[k + 1]].
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        sign = byte_of_sign()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, k in vocabulary.items():
            self.a_bytes[k] = bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (list(map(str, range(len(t)))) for t in (self.a_bytes, self.b_bytes))
        by_regex = json.load(open(a_path))["pre_tokenizer"]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and by_regex.get("type") == "ByteLevel" and by_regex.get("use_regex", True)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bad: set[int] = set()
        self.n_a, self.n_b, self.n_groups, self.pairs, self.starts = (array("q") for _ in range(5))
        self.starts.append(0)
        self.text: list[bytes] = []
        self.met = np.zeros(0, np.int64)

    def count(self, kinds: np.ndarray, times: np.ndarray) -> None:
        """Note how often a block met its chunks."""
        self.met = np.concatenate([self.met, np.zeros(len(self.text) - len(self.met), np.int64)])
        self.met[kinds] += times

    def trim(self, kept: int) -> None:
        """Remember only as many chunks, those met most often, at new numbers."""
        best = np.sort(np.argpartition(-self.met, kept)[:kept])
        number = np.full(len(self.text), -1, np.int64)
        number[best] = np.arange(kept)
        known, text, met = self.known, self.text, self.met[best] // 2
        starts, pairs = np.frombuffer(self.starts, np.int64), np.frombuffer(self.pairs, np.int64)
        width = np.diff(starts)[best]
        place = np.repeat(starts[best] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        counts = [np.frombuffer(c, np.int64)[best] for c in (self.n_a, self.n_b, self.n_groups)]
        bad, flat = {int(number[k]) for k in self.bad if number[k] >= 0}, pairs[place]
        self.forget()
        self.bad, self.met = bad, met
        self.known = {p: int(number[k]) for p, k in known.items() if number[k] >= 0}
        self.text = [text[k] for k in best]
        for store, more in ((self.n_a, counts[0]), (self.n_b, counts[1]), (self.n_groups, counts[2]), (self.pairs, flat), (self.starts, np.cumsum(width))):
            store.frombytes(np.ascontiguousarray(more, np.int64).tobytes())

    def _learn(self, parts: list[str]) -> None:
        """Label the chunks " " + part, which stand beside each other in one run, and remember them.  One that the bytes do not rebuild is bad."""
        run = " " + " ".join(parts)
        raw = run.encode()
        a, b = self.a.encode(run, add_special_tokens=False).ids, self.b.encode(run[1:])
        if "▁" in run or b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
            if len(parts) > 1:
                for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
                    self._learn(half)
                return
            self.bad.add(len(self.text))
            self._remember(parts, [0], [0], [0], [0], [b""], [])
            return
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        marks = labels(self.a_size[ids_a], self.b_size[ids_b])
        ends = np.cumsum([len(p) + 1 for p in parts] if run.isascii() else [len(p.encode()) + 1 for p in parts])
        cut, i, j = [], 0, 0
        text_a, text_b = [self.a_text[k] for k in a], [self.b_text[k] for k in b]
        for m, n in groups(marks):
            cut.append(f"{text_a[i]}|{text_b[j]}" if m == n == 1 else f"{','.join(text_a[i : i + m])}|{','.join(text_b[j : j + n])}")
            i, j = i + m, j + n
        mark = np.frombuffer(marks, np.uint8)
        upto = [np.searchsorted(np.flatnonzero(hit) + 1, ends, "right") for hit in ((mark == 97) | (mark == 99), (mark == 98) | (mark == 99), mark == 99, mark != 46)]
        at_a, at_b = links(marks)
        g = upto[2].tolist()
        text = [";".join(cut[x:y]).encode() for x, y in zip([0, *g], g, strict=False)]
        self._remember(parts, *(np.diff(u, prepend=0).tolist() for u in upto), text, (ids_a[at_a] * WIDTH + ids_b[at_b]).tolist())

    def _remember(self, parts: list[str], n_a: list[int], n_b: list[int], n_groups: list[int], n_links: list[int], text: list[bytes], pairs: list[int]) -> None:
        self.known.update(zip(parts, range(len(self.text), len(self.text) + len(parts)), strict=True))
        for store, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.text, text)):
            store.extend(more)
        self.starts.extend([len(self.pairs) + x for x in accumulate(n_links)])
        self.pairs.extend(pairs)

    def chunks(self, text: str) -> list[int] | None:
        """Numbers of the chunks of " " + text; None if it has no tokens."""
        if not text:
            return None
        parts = text.split(" ") if self.cuts else [text]
        got = list(map(self.known.get, parts))
        if None in got:
            clean = self.cuts and not EDGE.search(text)
            parts = parts if clean else merged(parts) if self.cuts else parts
            new = [p for p in dict.fromkeys(parts) if p not in self.known]
            if clean:
                self._learn(new)
            else:  # beside each other these would meet at other white space
                for p in new:
                    self._learn([p])
            got = [self.known[p] for p in parts]
        return None if self.bad and not self.bad.isdisjoint(got) else got


#: A part between single spaces that is empty or has white space at an edge.
EDGE = re.compile(r"(?:\A| )(?:\s|\Z)|\s(?: |\Z)")


def merged(parts: list[str]) -> list[str]:
    """Parts between single spaces, put together again where a cut would stand beside more white space."""
    out = [[parts[0]]]
    for before, part in zip(parts, parts[1:], strict=False):
        if before and part and not before[-1].isspace() and not part[0].isspace():
            out.append([part])
        else:
            out[-1].append(part)
    return [" ".join(p) for p in out]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, so that what it remembers outlives a task."""
    return Aligner(a_path, b_path)


class Block:
    """The documents of one block while they are read."""

    def __init__(self, al: Aligner):
        self.al, self.ids, self.chunks, self.digests = al, [], [], []
        self.bytes, self.before = 0, len(al.text)

    def add(self, doc_id: int | None, text: str | None) -> None:
        al = self.al
        got = al.chunks(text or "")
        self.ids.append(doc_id)
        self.chunks.append(np.array(got or [], np.int32))
        self.digests.append("" if got is None else hashlib.sha256(b";".join([al.text[k] for k in got])).hexdigest())
        self.bytes += len(text or "")

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.al.text) - self.before >= BLOCK_NEW

    def rows(self, number: int) -> pa.RecordBatch:
        """A row a document and one of the block: its distinct pairs, their counts, and which of them each distinct chunk has."""
        al, n = self.al, len(self.ids)
        size = np.array(list(map(len, self.chunks)), np.int64)
        ends = np.cumsum(size)
        kinds, of = np.unique(np.concatenate(self.chunks), return_inverse=True)
        first = np.frombuffer(al.starts, np.int64)[kinds]
        width = np.frombuffer(al.starts, np.int64)[kinds + 1] - first
        place = np.repeat(first - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        flat = np.frombuffer(al.pairs, np.int64)[place] if len(place) else np.zeros(0, np.int64)
        counts = [np.frombuffer(c, np.int64)[kinds] if len(c) else np.zeros(0, np.int64) for c in (al.n_a, al.n_b, al.n_groups)]
        distinct, of_chunk = np.unique(flat, return_inverse=True)
        times = np.bincount(of, minlength=len(kinds))
        al.count(kinds, times)
        held = np.bincount(of_chunk, weights=np.repeat(times, width), minlength=len(distinct)).astype(np.int64)
        told = [sums(c[of], ends) for c in (*counts, width)]
        small = of.astype(np.uint16 if len(kinds) <= 1 << 16 else np.int32)
        raw = [small[e - s : e].tobytes() for s, e in zip(size, ends, strict=True)]
        columns = {
            "block": pa.array([number] * (n + 1), pa.int64()),
            "of_block": pa.array([False] * n + [True]),
            "doc_id": pa.array([*self.ids, None], pa.int64()),
            **{name: pa.array([*t.tolist(), None], pa.int64()) for name, t in zip(("n_a", "n_b", "n_groups", "n_links"), told, strict=True)},
            "groups_sha256": pa.array([*self.digests, None], pa.string()),
            "n_chunks": pa.array([*size.tolist(), None], pa.int64()),
            "chunks": pa.array([*raw, None], pa.binary()),
            "pairs": pa.array([None] * n + [distinct], pa.list_(pa.int64())),
            "counts": pa.array([None] * n + [held], pa.list_(pa.int64())),
            "starts": pa.array([None] * n + [(np.cumsum(width) - width).astype(np.int32)], pa.list_(pa.int32())),
            "of_chunk": pa.array([None] * n + [of_chunk.astype(np.int32)], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_pydict(columns)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches that end before `ends`, each beginning where the one before ends."""
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[ends]
    return np.diff(upto, prepend=0)


def blocks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """PART: the documents' groups, dealt into blocks, and what each block asks the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        made, block = 0, Block(al)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                block.add(doc_id, text.as_py())
                if block.full():
                    yield block.rows(first + made)
                    made += 1
                    if len(al.text) > REMEMBERED:
                        al.trim(KEPT)
                    block = Block(al)
        if block.ids:
            yield block.rows(first + made)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PART)


def pair_counts(told: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold a pair of ids, and whether that is the most for its id of B."""
    total = asked(told).groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(WIDTH - 1)
    most = total.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most WIDTH rows
    return total.join(F.broadcast(most), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def asked(told: DataFrame) -> DataFrame:
    """(block, at, pair, n) for each distinct pair of each block."""
    zipped = F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")
    return told.filter("of_block").select("block", zipped).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def answer(mine: pa.Table, known: pa.Table) -> pa.Table:
    """One block's documents with the sums over their links of what the corpus says of each link's pair."""
    of_block = mine.column("of_block").to_numpy()
    own = mine.filter(pa.array(of_block))
    docs = mine.filter(pa.array(~of_block))
    starts, of_chunk = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("starts", "of_chunk"))
    at = known.column("at").to_numpy()
    chunk = []
    for name in ("count", "best"):
        value = np.zeros(len(at), np.int64)
        value[at] = known.column(name).to_numpy().astype(np.int64)
        chunk.append(np.add.reduceat(value[of_chunk], starts) if len(starts) else np.zeros(0, np.int64))
    dtype = np.uint16 if len(starts) <= 1 << 16 else np.int32
    ends = np.cumsum(docs.column("n_chunks").to_numpy().astype(np.int64))
    numbers = np.frombuffer(b"".join(docs.column("chunks").to_pylist()), dtype)
    count_sum, n_best = (sums(c[numbers], ends) for c in chunk)
    out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**out, "n_best": n_best, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})


def align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """TOLD: every document's tokens, groups and links, and what the corpus says of its links."""
    default = default_tokenizers()
    told = stored(blocks(documents, a_path or default[0], b_path or default[1]), "alignment")
    known = asked(told).join(pair_counts(told), "pair").select(F.col("block").alias("asked_by"), "at", "count", "best")
    mine = told.select("block", "of_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_chunks", "chunks", "starts", "of_chunk")
    return mine.groupBy("block").cogroup(known.groupBy("asked_by")).applyInArrow(answer, TOLD)


def spans(text: str, a_path: str | None = None, b_path: str | None = None) -> list[tuple[int, int, list[int], list[int]]]:
    """For one text: (first byte, byte after the last, ids of A, ids of B) of each group of " " + text; none without tokens."""
    default = default_tokenizers()
    al = aligner(a_path or default[0], b_path or default[1])
    got = al.chunks(text)
    if got is None:
        return []
    out, at = [], 0
    for group in b";".join([al.text[k] for k in got]).decode().split(";"):
        a, b = ([int(k) for k in side.split(",")] for side in group.split("|"))
        size = sum(len(al.a_bytes[k]) for k in a)
        out.append((at, at + size, a, b))
        at += size
    return out
