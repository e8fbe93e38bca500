"""Masked pseudo-likelihood scores from a bidirectional window network and the corpus's own windows.

Every token (a run between white space, lower-cased) of every document is predicted from the two on either
side.

- The network (embeddings of the four neighbours, a hidden layer, a class tree of three levels whose softmax
  at every node reads the hidden layer) gives each of LEAVES leaves a probability.  The most frequent words
  have a leaf each, the rarer ones share hashed leaves evenly.  Leaves of like neighbours stand together in
  the tree; its biases begin as the frequencies of the whole corpus, and its weights are fitted to every window
  of every document in EPOCHS passes: one task fits the first WARM windows or so, then tasks of about TASK
  windows go on from there, each over its own share of all others (in a later pass, of all windows), and what
  they changed is averaged, each row of a weight by the windows that read it.
- What the rest of the corpus says is exact and grows with it: how often this token stood between these two
  neighbours, and how often these neighbours stood around any token, in all other documents.  With n and m
  for the two, P(token | both sides) = (n + WEIGHT * P_network) / (m + WEIGHT).  A document never counts for
  itself, so that only what others share of it makes it likelier.

A document's score is the sum of the log-probabilities of all its tokens.

Windows are counted where their neighbours' hashes meet: tasks send blocks of compact entries (eleven bytes a
token) to about total / PART_TOKENS parts, these send sums for each document back to its block.  A pair of
neighbours, or a token between such, that alone would outgrow a part is counted beforehand and travels with
the plan; there are at most HOT of them, since candidates need a share of 1 / HOT.

Defined results: a null or empty text has no tokens, log_prob 0 and no mean; repeated rows are scored each,
as documents of their own; on an empty table nothing is trained and nothing scored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.shared import stored

BRANCH = 32
LEAVES, RARE = BRANCH**3, 4096
FREQUENT = LEAVES - RARE
EMBED, HIDDEN = 24, 31
#: The network's fit: windows with which one task begins, windows of each task over all others, windows a step at least and at most.
WARM, TASK, STEP, STEPS = 1_000_000, 8_000_000, 2048, 1 << 14
#: Passes over the windows, whatever their number; windows that a trial of the network alone draws.
EPOCHS, SAMPLE = 2, 200_000
#: Tokens of a row of words at least, common words that tell where a leaf stands, numbers of a row of averaged weights.
LINE, NEAR, PIECE = 1 << 17, 128, 1 << 17
#: Numbers of a weight that are changed at once.
STRETCH = 1 << 15
#: How much the network weighs against counted windows.
WEIGHT = 1.0
#: Tokens of a block that is sent at once, of a matrix in the network, and about how many one part counts; parts at least.
BLOCK, CHUNK, PART_TOKENS, PARTS = 1 << 19, 1 << 16, 4_000_000, 256
#: Leading bits of a word by which the frequent ones are found.
PREFIX = 18
#: Neighbours that are counted beforehand: at most so many; blocks in which candidates are sought.
HOT, HOT_SEEN = 1 << 16, 16
#: Letters of scripts that put no spaces between words are tokens by themselves.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LEFT, _RIGHT, _MID = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens(text: str | None) -> list[str]:
    """The lower-cased runs between white space."""
    if not text:
        return []
    return (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).lower().split()


class Words:
    """Tokens of texts as 64-bit hashes, never 0."""

    def __call__(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MID
    return h ^ (h >> np.uint64(29))


@dataclass
class Block:
    """Some documents' tokens, one after another with two empty places between."""

    ids: list
    sizes: np.ndarray
    doc: np.ndarray  # of each token
    line: np.ndarray  # words, 0 in the empty places
    at: np.ndarray  # where in line each token stands

    @staticmethod
    def of(ids: list, texts: list[np.ndarray]) -> Block:
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = np.zeros(2, np.uint64)
        line = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
        doc = np.repeat(np.arange(len(texts)), sizes)
        return Block(ids, sizes, doc, line, 2 + np.arange(len(doc)) + 2 * doc)

    @property
    def words(self) -> np.ndarray:
        return self.line[self.at]

    def around(self, line: np.ndarray) -> list[np.ndarray]:
        """What stands in line (words, or something told of each) two and one to the left, one and two to the right of each token."""
        return [line[self.at + k] for k in (-2, -1, 1, 2)]

    def pairs(self) -> np.ndarray:
        left, right = self.line[self.at - 1], self.line[self.at + 1]
        return _mixed(left * _LEFT + (right ^ (right >> np.uint64(32))) * _RIGHT)

    def triples(self, pairs: np.ndarray) -> np.ndarray:
        return _mixed(pairs * _RIGHT + self.words * _LEFT)


LINED = T.StructType([T.StructField("turn", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("missing", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("codes", T.BinaryType())])


def word_lines(documents: DataFrame) -> DataFrame:
    """All documents' tokens in rows as Block has them: the row's different words and which of these stands at each place of its line; turn (0 to 1) is drawn by hash.

    Whoever passes over the tokens more than once stores these rows first; every function of this module takes them in the documents' place.
    """
    if documents.columns == LINED.names:
        return documents
    doc_id = F.col("doc_id").cast("long") if "doc_id" in documents.columns else F.lit(None).cast("long")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, k, ids, texts, size = Words(), TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pd.DataFrame:
            block = Block.of(ids, texts)
            known, codes = np.unique(block.line, return_inverse=True)
            turn = (xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 11) >> 11) / (1 << 53)
            fields = np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids]), block.sizes.astype("<i8"), known.astype("<u8"), codes.astype(_coded(len(known)))
            return pd.DataFrame([[turn, *(f.tobytes() for f in fields)]], columns=LINED.names)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(words(text))
                size += len(texts[-1])
                if size >= LINE or len(ids) >= 1 << 15:
                    yield row()
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield row()

    return documents.select(doc_id.alias("doc_id"), "text").mapInPandas(lines, LINED)


def _coded(known: int) -> str:
    """The numbers that tell so many words apart."""
    return "<u2" if known <= 1 << 16 else "<u4"


def blocks(batches: Iterator[pd.DataFrame], least: int = BLOCK) -> Iterator[Block]:
    """The documents of rows of word_lines, some rows at a time."""

    def joined(rows: list) -> Block:
        ids = [None if gone else i for r in rows for i, gone in zip(np.frombuffer(r.ids, "<i8").tolist(), np.frombuffer(r.missing, bool).tolist(), strict=True)]
        sizes = np.concatenate([np.frombuffer(r.sizes, "<i8") for r in rows])
        known = [np.frombuffer(r.words, "<u8") for r in rows]
        lines = [w[np.frombuffer(r.codes, _coded(len(w)))] for r, w in zip(rows, known, strict=True)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        return Block(ids, sizes, doc, np.concatenate([lines[0], *[x[2:] for x in lines[1:]]]), 2 + np.arange(len(doc)) + 2 * doc)

    held, size, docs = [], 0, 0
    for batch in batches:
        for r in batch.itertuples():
            held.append(r)
            docs += len(r.missing)
            size += len(r.codes) // (2 if _coded(len(r.words) // 8) == "<u2" else 4)
            if size >= least or docs >= 1 << 15:  # fewer than 2 ** 16 documents: a row has 2 ** 15 at most
                yield joined(held)
                held, size, docs = [], 0, 0
    if held:
        yield joined(held)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


COUNTED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
WORD, PAIR, TRIPLE, SEEN = 0, 1, 2, 3


def counts(documents: DataFrame) -> DataFrame:
    """(kind, key, n): how often each word occurs in all documents; and from every HOT_SEEN-th block its commonest pairs and triples, and its size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, block in enumerate(blocks(batches)):
            found = [(WORD, *np.unique(block.words, return_counts=True))]
            if k % HOT_SEEN == 0 and len(block.words):
                pairs = block.pairs()
                for kind, keys in ((PAIR, pairs), (TRIPLE, block.triples(pairs))):
                    key, n = np.unique(keys, return_counts=True)
                    found.append((kind, key[n > len(keys) // HOT], n[n > len(keys) // HOT]))
                found.append((SEEN, np.zeros(1, np.uint64), np.array([len(pairs)])))
            for kind, key, n in found:
                yield pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": _signed(key), "n": n})

    return word_lines(documents).mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The leaf of each word: its own for the frequent, a hashed one for the rest."""

    words: np.ndarray  # the frequent, sorted
    leaf: np.ndarray  # of each of these
    mass: np.ndarray  # tokens of each leaf
    kinds: float  # different words that share a rare leaf, on average
    place: np.ndarray = field(default_factory=lambda: np.arange(LEAVES))  # of each leaf in the tree

    def __post_init__(self):
        starts = np.searchsorted(self.words >> np.uint64(64 - PREFIX), np.arange((1 << PREFIX) + 1, dtype=np.uint64))
        self.first, self.most = starts[:-1].astype(np.uint16), int(np.diff(starts).max())  # of the words with each prefix

    def leaves(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word (0, an edge, has the last rare one), and whether it shares a leaf."""
        leaf = FREQUENT + ((words >> np.uint64(20)) & np.uint64(RARE - 1)).astype(np.int64)
        leaf[words == 0] = LEAVES - 1
        shared, first = np.ones(len(words), bool), self.first[words >> np.uint64(64 - PREFIX)]
        for k in range(self.most):
            at = np.minimum(first.astype(np.int32) + k, len(self.words) - 1)
            own = np.flatnonzero(self.words[at] == words)
            leaf[own], shared[own] = self.leaf[at[own]], False
        return leaf, shared

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word in the tree, and whether it shares a leaf."""
        leaf, shared = self.leaves(words)
        return self.place[leaf], shared


def vocabulary(counted: DataFrame) -> Vocabulary:
    words = counted.filter(F.col("kind") == WORD)
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    hashed = FREQUENT + F.pmod(F.shiftrightunsigned("key", 20), F.lit(RARE))
    shared = words.groupBy(hashed.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    mass = np.zeros(LEAVES)
    mass[shared["leaf"].to_numpy(int)] = shared["n"]
    np.subtract.at(mass, FREQUENT + ((keys >> np.uint64(20)) % np.uint64(RARE)).astype(int), top["n"].to_numpy())
    mass[: len(top)] = top["n"]
    return Vocabulary(keys[order], order, mass, max(1.0, (shared["kinds"].sum() - len(top)) / RARE))


def sample_windows(documents: DataFrame, total: int) -> np.ndarray:
    """About SAMPLE windows of five words, the middle one the target, from rows and places chosen by hash; for trials of the network alone."""
    share = min(1.0, 16 * SAMPLE / max(1, total))
    rate = min(1.0, SAMPLE / max(1, total) / share)
    row = F.pmod(F.xxhash64(F.lit(11), F.monotonically_increasing_id()), F.lit(1 << 30))
    chosen = documents.withColumn("__row", row).filter(F.col("__row") <= int(share * (1 << 30))).select("text")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for block in blocks(batches):
            some = block.at[rng.random(len(block.at)) < rate]
            rows = np.stack([block.line[some + k] for k in (-2, -1, 0, 1, 2)], 1)
            yield pd.DataFrame({"window": [rows.tobytes()]})

    got = b"".join(r.window for r in word_lines(chosen).mapInPandas(draw, "window binary").collect())
    return np.frombuffer(got, np.uint64).reshape(-1, 5)


def _neighbours(target: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(leaf, side and common leaf) numbered in one, of the windows whose neighbour on that side is common."""
    sides = [target[c] * 2 * NEAR + k * NEAR + leaf[c] for k, leaf in ((0, left), (1, right)) for c in [leaf < NEAR]]
    return np.concatenate(sides)


def arrange(near: np.ndarray) -> np.ndarray:
    """A place in the tree for each leaf, so that leaves of like neighbours stand together: by the leading components of their neighbours, counted by _neighbours."""
    near = np.sqrt(near.reshape(LEAVES, 2 * NEAR), dtype=np.float32)
    near /= np.linalg.norm(near, axis=1, keepdims=True) + 1.0
    _, axes = np.linalg.eigh((near.T @ near).astype(float))
    along = near @ axes[:, -3:]
    order = np.lexsort((np.arange(LEAVES), along[:, 1]))  # the first component mostly says how much is known of a leaf
    size = BRANCH * BRANCH
    inside = [np.array(g)[np.lexsort((g, along[g, 0]))] for g in np.split(order, LEAVES // size)]
    place = np.empty(LEAVES, np.int64)
    place[np.concatenate(inside)] = np.arange(LEAVES)
    return place


@dataclass
class Network:
    """Embeddings of places, the hidden layer, and a softmax at each node of the tree."""

    embed: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    nodes: list[np.ndarray]  # by level: (nodes, HIDDEN, BRANCH)
    tilt: list[np.ndarray]  # by level: (nodes, BRANCH)

    @staticmethod
    def start(mass: np.ndarray, seed: int = 3) -> Network:
        """Weights at random, biases at the corpus's frequencies."""
        rng = np.random.default_rng(seed)
        tree = (mass + 0.5).reshape(BRANCH, BRANCH, BRANCH)
        sums = [tree.sum((1, 2))[None], tree.sum(2), tree.reshape(-1, BRANCH)]
        tilt = [np.log(s / s.sum(1, keepdims=True)).astype(np.float32) for s in sums]
        return Network(
            rng.normal(0, 0.3, (LEAVES, EMBED)).astype(np.float32),
            rng.normal(0, (4 * EMBED) ** -0.5, (4 * EMBED, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            [np.zeros((len(t), HIDDEN, BRANCH), np.float32) for t in tilt],
            tilt,
        )

    def layer(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[sides].reshape(len(sides), -1)
        return x, np.maximum(x @ self.hidden + self.bias, 0)

    def ready(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What each place adds to the hidden layer as each of the four neighbours, and the nodes' weights with their tilts as those of one more unit that is always 1."""
        parts = [np.pad(self.embed @ self.hidden[k * EMBED : (k + 1) * EMBED], ((0, 0), (0, 1))) for k in range(4)]
        parts[0] += np.append(self.bias, np.float32(1))
        return parts, [np.concatenate([w, t[:, None]], 1) for w, t in zip(self.nodes, self.tilt, strict=True)]

    def log_prob(self, sides: list[np.ndarray], target: np.ndarray, ready: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> np.ndarray:
        """log P(leaf | four neighbours), all by their places."""
        parts, nodes = ready or self.ready()
        out = np.zeros(len(target), np.float32)
        for at in range(0, len(target), CHUNK):
            order = np.argsort(target[at : at + CHUNK].astype(np.uint16), kind="stable") + at
            goal = target[order]  # the tokens of a node stand together at every level
            h, beside, z = (np.empty((len(goal), n), np.float32) for n in (HIDDEN + 1, HIDDEN + 1, BRANCH))
            parts[0].take(sides[0][order], 0, out=h, mode="clip")
            for part, side in zip(parts[1:], sides[1:], strict=True):
                h += part.take(side[order], 0, out=beside, mode="clip")
            np.maximum(h, 0, out=h)
            got, rows = np.zeros(len(goal), np.float32), np.arange(len(goal)) * BRANCH
            for weights, bits in zip(nodes, (10, 5, 0), strict=True):
                node = goal >> (bits + 5)
                cuts = np.flatnonzero(np.diff(node, prepend=-1, append=len(weights)))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    np.dot(h[a:b], weights[node[a]], out=z[a:b])
                got += z.ravel()[rows + (goal >> bits & 31)]
                np.exp(z, out=z)
                got -= np.log(z @ np.ones(BRANCH, np.float32))
            out[order] = got
        return np.maximum(np.nan_to_num(out, nan=-30.0), -30)


class Descent:
    """A network in training by mini-batches (Adagrad): its weights, a node's with its tilts as those of one more unit that is always 1."""

    def __init__(self, net: Network, rate: float = 0.1):
        tied = [np.concatenate([w, t[:, None]], 1) for w, t in zip(net.nodes, net.tilt, strict=True)]
        self.weights = [net.embed.copy(), np.vstack([net.hidden, net.bias]), *tied]
        self.squares = [np.full_like(w, 1e-3) for w in self.weights]
        self.seen = [np.zeros(len(w)) for w in self.weights]  # windows that read each row
        self.rate = rate

    def copy(self) -> Descent:
        """The same weights and squares, with nothing seen yet."""
        out = Descent(self.network(), self.rate)
        out.squares = [s.copy() for s in self.squares]
        return out

    def network(self) -> Network:
        embed, hidden, *tied = self.weights
        return Network(embed, hidden[:-1], hidden[-1], [w[:, :-1] for w in tied], [w[:, -1] for w in tied])

    def _descend(self, k: int, grad: np.ndarray, room: dict) -> None:
        """Every row by its gradient, in place and a stretch at a time."""
        weights, squares, grad = self.weights[k].reshape(-1), self.squares[k].reshape(-1), grad.reshape(-1)
        for at in range(0, len(weights), STRETCH):
            g = grad[at : at + STRETCH]
            moved = np.multiply(g, g, out=room["moved"][: len(g)])
            squares[at : at + STRETCH] += moved
            np.divide(g, np.sqrt(squares[at : at + STRETCH], out=moved), out=moved)
            weights[at : at + STRETCH] -= np.multiply(moved, self.rate, out=moved)

    def _room(self, many: int) -> dict:
        """Arrays that the steps of a pass use again and again."""
        shapes = {"x": (4 * many, EMBED), "h": (many, HIDDEN + 1), "back": (many, HIDDEN + 1), "own": (many, HIDDEN + 1), "z": (many, BRANCH), "moved": (STRETCH,), "embed": (LEAVES, EMBED), "dx": (4 * EMBED * many,), "used": self.weights[-1].shape, "pushed": self.weights[-1].shape}
        return {k: np.empty(v, np.float32) for k, v in shapes.items()} | {"grad": [np.empty_like(w) for w in self.weights[2:]]}

    def step(self, sides: np.ndarray, goal: np.ndarray, room: dict) -> None:
        """One step down the mean loss of the windows, which stand in the order of _together."""
        many, scale = len(goal), np.float32(len(goal) ** -0.5)
        embed, hidden, *nodes = self.weights
        square = np.pad(hidden, ((0, 0), (0, 1)))
        square[-1, -1] = 1
        x = embed.take(sides.ravel(), 0, out=room["x"][: 4 * many], mode="clip").reshape(many, -1)
        h = np.matmul(x, square[:-1], out=room["h"][:many])
        h += square[-1]
        np.maximum(h, 0, out=h)
        back, own, z = (room[k][:many] for k in ("back", "own", "z"))
        back[:] = 0
        ones, rows = np.ones(BRANCH, np.float32), np.arange(many) * BRANCH
        for level, (weights, grad) in enumerate(zip(nodes, room["grad"], strict=True)):
            bits = 10 - 5 * level
            node = goal >> (bits + 5)
            cuts = np.flatnonzero(np.diff(node, prepend=-1, append=len(weights)))
            at, size = node[cuts[:-1]], np.diff(cuts)
            first = np.flatnonzero((np.diff(size, prepend=-1) != 0) | (np.diff(at >> 5, prepend=-1) != 0))  # of the nodes of one size
            used, pushed = weights.take(at, 0, out=room["used"][: len(at)], mode="clip"), room["pushed"][: len(at)]
            groups = []
            for i, j, n, a in zip(first.tolist(), [*first[1:].tolist(), len(at)], size[first].tolist(), cuts[first].tolist(), strict=True):
                b, shape = a + (j - i) * n, (j - i, n, BRANCH)
                groups.append((h[a:b].reshape(shape), z[a:b].reshape(shape), own[a:b].reshape(shape), used[i:j], pushed[i:j]))
            for hs, zs, _, ws, _ in groups:
                np.matmul(hs, ws, out=zs)
            np.exp(np.minimum(z, 80, out=z), out=z)
            z *= (scale / (z @ ones))[:, None]
            z.reshape(-1)[rows + (goal >> bits & 31)] -= scale
            for hs, zs, os, ws, gs in groups:
                np.matmul(zs, ws.transpose(0, 2, 1), out=os)
                np.matmul(hs.transpose(0, 2, 1), zs, out=gs)
            back += own
            grad[at] = pushed
            grad[np.delete(np.arange(len(grad)), at)] = 0
            self._descend(2 + level, grad, room)
            self.seen[2 + level][at] += size
        back *= h > 0
        back[:, HIDDEN] = 0
        dx = np.matmul(square[:-1], back.T, out=room["dx"][: 4 * EMBED * many].reshape(4 * EMBED, many)).reshape(4, EMBED, many)
        self._descend(1, np.vstack([(back.T @ x).T, back.sum(0)])[:, :HIDDEN], room)
        self.seen[1] += many
        read, grad = sides.T.ravel(), room["embed"]
        for k in range(EMBED):
            grad[:, k] = np.bincount(read, dx[:, k].ravel(), LEAVES)
        self._descend(0, grad, room)
        self.seen[0] += np.bincount(read, minlength=LEAVES)

    def run(self, sides: np.ndarray, target: np.ndarray, rng: np.random.Generator, step: int) -> None:
        """One pass over the windows in a random order."""
        order, room = rng.permutation(len(target)), self._room(min(step, len(target)))
        for begin in range(0, len(order), step):
            some = order[begin : begin + step]
            some = some[_together(target[some])]
            self.step(sides[some], target[some], room)


def _together(target: np.ndarray) -> np.ndarray:
    """An order in which the windows of a node stand together at every level, and a node's children that have as many windows as each other too."""
    node = target >> 5
    size = np.bincount(node, minlength=LEAVES // BRANCH)
    rank = np.empty(len(size), np.uint16)
    rank[np.lexsort((size, np.arange(len(size)) >> 5))] = np.arange(len(size))
    return np.argsort(rank[node] << 5 | (target & 31).astype(np.uint16), kind="stable")  # sorted by digits


def train(net: Network, sides: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Descent:
    """The network fitted to the windows in `epochs` passes."""
    found, rng = Descent(net), np.random.default_rng(seed)
    for _ in range(epochs):
        found.run(sides, target, rng, STEP)
    return found


@dataclass
class MaskedModel:
    vocabulary: Vocabulary
    network: Network
    total: int
    pairs: np.ndarray  # counted beforehand, sorted
    pair_n: np.ndarray
    triples: np.ndarray
    triple_n: np.ndarray

    @property
    def parts(self) -> int:
        return max(PARTS, -(-self.total // PART_TOKENS))

    def network_log_prob(self, block: Block, ready: tuple | None = None) -> np.ndarray:
        place, shared = self.vocabulary(block.line)
        alone = np.where(shared[block.at], np.log(self.vocabulary.kinds), 0).astype(np.float32)
        return self.network.log_prob(block.around(place), place[block.at], ready) - alone


def _hot(documents: DataFrame, counted: DataFrame, most: int = PART_TOKENS) -> list[np.ndarray]:
    """The pairs and triples of over `most` tokens, with their exact counts: candidates are seen in a share of the blocks, then counted in all."""
    near = counted.filter(F.col("kind") != WORD)
    seen = near.filter(F.col("kind") == SEEN).agg(F.sum("n")).first()[0] or 0
    total = counted.filter(F.col("kind") == WORD).agg(F.sum("n")).first()[0] or 0
    least = max(seen / HOT, 0.9 * most * seen / max(1, total))
    found = near.filter((F.col("kind") != SEEN) & (F.col("n") > least)).toPandas()  # at most HOT of each kind
    keys = [np.sort(found["key"][found["kind"] == kind].to_numpy(np.int64).view(np.uint64)) for kind in (PAIR, TRIPLE)]
    if not any(map(len, keys)):
        return [np.zeros(0, np.uint64), np.zeros(0, np.int64)] * 2
    shared = documents.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(len(k), np.int64) for k in shared.value]
        for block in blocks(batches):
            pairs = block.pairs()
            for k, own in enumerate((pairs, block.triples(pairs))):
                if len(shared.value[k]):
                    at = np.minimum(np.searchsorted(shared.value[k], own), len(sums[k]) - 1)
                    sums[k] += np.bincount(at[shared.value[k][at] == own], minlength=len(sums[k]))
        for k, n in enumerate(sums):
            yield pd.DataFrame({"kind": np.full(len(n), k, np.int32), "key": np.arange(len(n)), "n": n})

    exact = word_lines(documents).mapInPandas(count, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for k, own in enumerate(keys):
        n = np.zeros(len(own), np.int64)
        some = exact[exact["kind"] == k]
        n[some["key"].to_numpy(int)] = some["n"]
        out += [own[n > most], n[n > most]]
    return out


def fit_network(vocab: Vocabulary, windows: np.ndarray) -> tuple[np.ndarray, Network]:
    """The places of the leaves and the network, from windows at hand."""
    leaf = [vocab.leaves(windows[:, k])[0] for k in range(5)]
    vocab.place = arrange(np.bincount(_neighbours(leaf[2], leaf[1], leaf[3]), minlength=LEAVES * 2 * NEAR))
    sides = np.stack([vocab.place[leaf[k]] for k in (0, 1, 3, 4)], 1)
    return vocab.place, train(Network.start(_placed(vocab)), sides, vocab.place[leaf[2]]).network()


def _placed(vocab: Vocabulary) -> np.ndarray:
    """The tokens of each place."""
    mass = np.zeros(LEAVES)
    mass[vocab.place] = vocab.mass
    return mass


def leaf_lines(documents: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(turn, line, sizes): the leaves of all documents in blocks as in Block, each in its turn."""
    shared = documents.sparkSession.sparkContext.broadcast(vocab)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"turn": [r.turn], "line": [_row_leaves(r, shared.value).astype("<u2").tobytes()], "sizes": [r.sizes]})

    return word_lines(documents).mapInPandas(lines, "turn double, line binary, sizes binary")


def _line_windows(r, vocab: Vocabulary | None) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of a row of leaf_lines, or of one of word_lines under vocab, and where in it its tokens stand."""
    size = np.frombuffer(r.sizes, "<i8")
    leaf = np.frombuffer(r.line, "<u2").astype(np.int64) if vocab is None else _row_leaves(r, vocab)
    return leaf, 2 + np.arange(size.sum()) + 2 * np.repeat(np.arange(len(size)), size)


def _row_leaves(r, vocab: Vocabulary) -> np.ndarray:
    leaf = vocab.leaves(np.frombuffer(r.words, "<u8"))[0]
    return leaf[np.frombuffer(r.codes, _coded(len(leaf)))]


def _leafed(lines: DataFrame) -> tuple[DataFrame, bool]:
    """What is read of rows of leaf_lines or word_lines, and whether they are the latter."""
    words = lines.columns == LINED.names
    return lines.select(*(("words", "codes") if words else ("line",)), "sizes"), words


def neighbours(lines: DataFrame, total: int, vocab: Vocabulary | None = None) -> np.ndarray:
    """How often each leaf stood beside each common one, in all windows of lines (of leaves, or of words under vocab)."""
    shared = lines.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(LEAVES * 2 * NEAR, np.uint32)
        for batch in batches:
            for r in batch.itertuples():
                leaf, at = _line_windows(r, shared.value)
                np.add.at(sums, _neighbours(leaf[at], leaf[at - 1], leaf[at + 1]), 1)
        for part, own in enumerate(np.split(sums, BRANCH)):
            yield pd.DataFrame({"part": [part], "n": [zlib.compress(own.tobytes(), 1)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(zlib.decompress(n), np.uint32).astype(np.float64) for n in rows["n"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [zlib.compress(sums.astype("<f4").tobytes(), 1)]})

    schema = "part int, n binary"
    out = np.zeros((BRANCH, LEAVES * 2 * NEAR // BRANCH), np.float32)
    lines = _leafed(lines.coalesce(-(-total // TASK) or 1))[0]
    for r in lines.mapInPandas(count, schema).groupBy("part").applyInPandas(add, schema).collect():  # a bounded table: BRANCH rows
        out[r.part] = np.frombuffer(zlib.decompress(r.n), "<f4")
    return out


def _windows(batches: Iterator[pd.DataFrame], place: np.ndarray, vocab: Vocabulary | None = None, least: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the four neighbours and of the middle token of every window, many at a time."""
    held, n = [], 0
    for batch in batches:
        for r in batch.itertuples():
            leaf, at = _line_windows(r, vocab)
            own = place[leaf].astype(np.uint16)
            held.append(np.stack([own[at + k] for k in (-2, -1, 1, 2, 0)], 1))
            n += len(at)
            if n >= least:
                both, held, n = np.concatenate(held).astype(np.int64), [], 0
                yield both[:, :4], both[:, 4]
    if n:
        both = np.concatenate(held).astype(np.int64)
        yield both[:, :4], both[:, 4]


def _averaged(lines: DataFrame, place: np.ndarray, begun: Descent, vocab: Vocabulary | None = None, epoch: int = 0) -> Descent:
    """`begun` after a pass over all windows of lines: tasks train by themselves, and what they changed is averaged by the windows that read each row."""
    shared = lines.sparkSession.sparkContext.broadcast((place, begun, vocab))
    sent = "part int, piece int, moved binary, seen binary"

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, begun, vocab = shared.value
        own, rng = begun.copy(), np.random.default_rng((epoch << 32) + TaskContext.get().partitionId())
        for sides, target in _windows(batches, place, vocab):
            own.run(sides, target, rng, min(STEPS, max(STEP, len(target) // 32)))
        for part, (weights, old, seen) in enumerate(zip(own.weights, begun.weights, own.seen, strict=True)):
            rows = PIECE // weights[0].size
            for piece, a in enumerate(range(0, len(seen), rows)):
                read = seen[a : a + rows]
                if read.any():
                    moved = (weights[a : a + rows] - old[a : a + rows]).reshape(len(read), -1) * read[:, None]
                    yield pd.DataFrame({"part": [part], "piece": [piece], "moved": [moved.astype("<f4").tobytes()], "seen": [read.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        seen = sum(np.frombuffer(v) for v in rows["seen"])
        moved = sum(np.frombuffer(v, "<f4").astype(float) for v in rows["moved"]).reshape(len(seen), -1) / np.maximum(seen, 1)[:, None]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "piece": rows["piece"].iloc[:1], "moved": [moved.astype("<f4").tobytes()], "seen": [seen.tobytes()]})

    out, before = begun.copy(), begun.seen
    for r in _leafed(lines)[0].mapInPandas(learn, sent).groupBy("part", "piece").applyInPandas(add, sent).collect():  # the network's own size, whatever the input's
        weights, seen = out.weights[r.part], np.frombuffer(r.seen)
        a = r.piece * (PIECE // weights[0].size)
        weights[a : a + len(seen)] += np.frombuffer(r.moved, "<f4").reshape(-1, *weights.shape[1:])
        out.seen[r.part][a : a + len(seen)] += seen
    out.seen = [n + m for n, m in zip(out.seen, before, strict=True)]
    shared.unpersist()
    return out


def fit_whole(lines: DataFrame, vocab: Vocabulary, total: int, warm: int = WARM, task: int = TASK) -> Descent:
    """The network fitted to every window of lines (of leaves, or of words) in EPOCHS passes, whatever their number; `seen` of the result counts the windows that its rows read in the last pass."""
    share = min(1.0, warm / max(1, total))
    first, words = _leafed(lines.filter(F.col("turn") < share))
    leaves = vocab if words else None
    shared = lines.sparkSession.sparkContext.broadcast((vocab.place, _placed(vocab), leaves))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, mass, leaves = shared.value
        own, rng, some = Descent(Network.start(mass)), np.random.default_rng(4), list(_windows(batches, place, leaves))
        for _ in range(EPOCHS if share == 1 else 1):
            own = own.copy()
            for sides, target in some:
                own.run(sides, target, rng, STEP)
        yield pd.DataFrame({"model": [pickle.dumps(own)]})

    first = first.coalesce(1).mapInPandas(begin, "model binary").head()
    begun = pickle.loads(first.model) if first else Descent(Network.start(_placed(vocab)))
    if share == 1:
        return begun
    found = _averaged(lines.filter(F.col("turn") >= share).coalesce(-(-total // task)), vocab.place, begun, leaves)
    for epoch in range(1, EPOCHS):
        found = _averaged(lines.coalesce(-(-total // task)), vocab.place, found.copy(), leaves, epoch)
    return found


def fit(documents: DataFrame, hot: int = PART_TOKENS) -> MaskedModel:
    """Counts over all documents, then the network from all their windows."""
    lines = word_lines(documents)
    counted = stored(counts(lines), "counted")
    vocab = vocabulary(counted)
    total = int(vocab.mass.sum())
    vocab.place = arrange(neighbours(lines, total, vocab))
    return MaskedModel(vocab, fit_whole(lines, vocab, total).network(), total, *_hot(lines, counted, hot))


SENT = T.StructType(
    [T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("pair", T.BinaryType()), T.StructField("word", T.BinaryType()), T.StructField("prior", T.BinaryType()), T.StructField("doc", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()), T.StructField("base", T.BinaryType()), T.StructField("network", T.BinaryType())]
)
SUMS = T.StructType([f for f in SENT.fields if f.name in ("block", "doc", "ids", "sizes", "base", "network")])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("network_log_prob", T.DoubleType())])
_KNOWN = np.uint16(1 << 15)  # marks an entry whose pair is counted beforehand


def _runs(ordered: np.ndarray) -> np.ndarray:
    """For each of the sorted values, how many are like it."""
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)))
    n = np.diff(starts, append=len(ordered))
    return np.repeat(n, n)


def _others(key: np.ndarray, doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How often each row's key occurs in the other documents; documents are numbers below 2 ** 32, and order sorts the keys."""
    n = np.empty(len(key), np.int64)
    n[order] = _runs(key[order])
    again = np.flatnonzero(n > 1)  # only these can have more than one in their own document
    _, number = np.unique(key[again], return_inverse=True)
    both = (number.astype(np.uint64) << np.uint64(32)) | doc[again].astype(np.uint64)
    order = np.argsort(both)
    mine = np.ones(len(key), np.int64)
    mine[again[order]] = _runs(both[order])
    return n - mine


def _own(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each row's key occurs in its own document."""
    _, number = np.unique(key, return_inverse=True)
    both = (number.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64)
    out, order = np.empty(len(key), np.int64), np.argsort(both)
    out[order] = _runs(both[order])
    return out


def _sent(block: Block, number: int, model: MaskedModel, ready: tuple | None = None) -> list[dict]:
    """The block's entries by part, and a row about its documents, which is a part of its own."""
    prior = model.network_log_prob(block, ready)
    pairs = block.pairs()
    triples = block.triples(pairs)
    base = np.zeros(len(block.sizes))
    network = np.bincount(block.doc, weights=prior, minlength=len(base))
    coded = np.minimum(np.round(-prior * 1000), 32767).astype(np.uint16)
    key, open_ = pairs.copy(), np.ones(len(pairs), bool)
    if len(model.pairs):
        at = np.minimum(np.searchsorted(model.pairs, pairs), len(model.pairs) - 1)
        hot = model.pairs[at] == pairs
        mine = _own(pairs, block.doc)
        base -= np.bincount(block.doc, weights=np.where(hot, np.log(np.where(hot, model.pair_n[at] - mine, 0) + WEIGHT), 0), minlength=len(base))
        key[hot], coded[hot] = triples[hot], coded[hot] | _KNOWN
        if len(model.triples):
            at = np.minimum(np.searchsorted(model.triples, triples), len(model.triples) - 1)
            known = hot & (model.triples[at] == triples)
            mine = _own(triples, block.doc)
            n = np.where(known, model.triple_n[at] - mine, 0)
            base += np.bincount(block.doc, weights=np.where(known, np.log(n + WEIGHT * np.exp((coded & ~_KNOWN) / -1000.0)), 0), minlength=len(base))
            open_ = ~known
    part = ((key >> np.uint64(32)) % np.uint64(model.parts)).astype(np.min_scalar_type(model.parts))  # small ones are sorted by digits
    order = np.argsort(part, kind="stable")
    order = order[open_[order]]
    word = np.ascontiguousarray(block.words[order]).view(np.uint8).reshape(-1, 8)[:, 5:]  # three bytes tell words between the same two apart
    fields = {"pair": key.astype(np.uint32)[order], "word": word, "prior": coded[order], "doc": block.doc.astype(np.uint16)[order]}
    cuts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1, append=model.parts))
    apart = np.diff(fields["doc"], prepend=np.uint16(0))  # a row's documents ascend: the first, then the distances, which pack better
    apart[cuts[:-1]] = fields["doc"][cuts[:-1]]
    fields["doc"] = apart
    rows = [{"part": int(part[order[a]]), "block": number, **{k: v[a:b].tobytes() for k, v in fields.items()}} for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return [*rows, {"part": -1 - number, "block": number, "ids": block.ids, "sizes": block.sizes.tobytes(), "base": base.tobytes(), "network": network.tobytes()}]


def _part_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block the documents with entries in this part, and the sums of their log-probabilities; rows about documents pass."""
    if rows["part"].iat[0] < 0:
        return rows[SUMS.names]
    rows = rows.sort_values("block")
    pair, prior = (np.frombuffer(b"".join(rows[c]), d) for c, d in (("pair", "<u4"), ("prior", "<u2")))
    doc = np.concatenate([np.cumsum(np.frombuffer(d, "<u2"), dtype=np.int64) for d in rows["doc"]])
    word = np.zeros((len(pair), 4), np.uint8)
    word[:, :3] = np.frombuffer(b"".join(rows["word"]), np.uint8).reshape(-1, 3)
    triple = (pair.astype(np.uint64) << np.uint64(32)) | word.view("<u4")[:, 0]
    sizes = [len(d) // 2 for d in rows["doc"]]
    whose = np.repeat(np.arange(len(rows), dtype=np.int64), sizes) << 16 | doc
    weighed, got = WEIGHT * np.exp((prior & ~_KNOWN) / -1000.0), np.empty(len(pair))
    known = (prior & _KNOWN) > 0
    for some, alone in ((np.flatnonzero(~known), True), (np.flatnonzero(known), False)):
        order = np.argsort(triple[some])  # by pair, then by word
        got[some] = np.log(_others(triple[some], whose[some], order) + weighed[some])
        if alone:
            got[some] -= np.log(_others(pair[some].astype(np.uint64), whose[some], order) + WEIGHT)
    docs, at = np.unique(whose, return_inverse=True)
    sums = np.bincount(at, weights=got)
    cuts = np.searchsorted(docs >> 16, np.arange(len(rows) + 1))
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    whom, what = [(docs[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in parts], [sums[a:b].astype("<f4").tobytes() for a, b in parts]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "doc": whom, "base": what} | {c: [None] * len(rows) for c in ("ids", "sizes", "network")})[SUMS.names]


def _block_scores(rows: pd.DataFrame) -> pd.DataFrame:
    about = rows[rows["sizes"].notna()].iloc[0]
    total = np.frombuffer(about["base"]).copy()
    parts = rows[rows["sizes"].isna()]
    if len(parts):
        np.add.at(total, np.frombuffer(b"".join(parts["doc"]), "<u2"), np.frombuffer(b"".join(parts["base"]), "<f4"))
    ids = pd.array([None if i is None or pd.isna(i) else int(i) for i in about["ids"]], "Int64")
    return pd.DataFrame({"doc_id": ids, "n_tokens": np.frombuffer(about["sizes"], np.int64), "log_prob": total, "network_log_prob": np.frombuffer(about["network"])})


def scores(documents: DataFrame, model: MaskedModel) -> DataFrame:
    """(doc_id, n_tokens, log_prob, network_log_prob) of each row; the last is what the network alone says."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, ready = TaskContext.get().partitionId() << 32, shared.value.network.ready()
        for k, block in enumerate(blocks(batches)):
            rows = _sent(block, first + k, shared.value, ready)
            yield pd.DataFrame({c: [r.get(c) for r in rows] for c in SENT.names})

    sent = word_lines(documents).mapInPandas(send, SENT)
    return sent.groupBy("part").applyInPandas(_part_sums, SUMS).groupBy("block").applyInPandas(_block_scores, SCORES)


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob, network_log_prob) of each document under a model of all others."""
    lines = stored(word_lines(documents), "words")
    found = scores(lines, fit(lines))
    return found.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"), "network_log_prob")
