import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldmark.llm import near_copies as n


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(rows):
    """The least id of each row's group, and the linked pairs of different sets: all pairs, whole sets."""
    sets = {d: plain_set(t) for d, t in rows}
    ids, root, near = sorted(sets), {d: d for d in sets}, []

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                continue
            if 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
                near.extend([(a, b)] if x != y else [])
    return {d: find(d) for d in ids}, near


def planted():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(60):
        base = list(rng.choice(words, 200))
        rows.append(base)
        for changes in (1, 2, 3, 4, 5):  # each takes five of 196 shingles: 0.8 is passed between four and five
            copy = list(base)
            for at in rng.choice(np.arange(5, 195, 7), changes, replace=False):
                copy[at] = f"x{k}-{changes}-{at}"
            rows.append(copy)
    chain = list(rng.choice(words, 120))
    for k in range(12):  # a chain whose ends have little in common
        rows.append(list(chain))
        chain[k * 8 : k * 8 + 8] = [f"c{k}-{i}" for i in range(8)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("split", [n.SPLIT, 3])
def test_planted_near_copies_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(n.links, "__defaults__", (split,))
    rows = planted()
    want, near = plain_groups(rows)
    assert len(near) > 300
    got = {r.doc_id: r.component_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("split", [n.SPLIT, 2])
def test_blocks_alone_link_what_lies_within_three_bits(spark, monkeypatch, split):
    """Without bands the SimHash blocks still give every pair of near copies within three bits, and no other."""
    monkeypatch.setattr(n, "_keys", lambda c: F.transform(F.sequence(F.lit(1), F.lit(n.BANDS)), lambda k: F.xxhash64(F.col(c), k)))
    monkeypatch.setattr(n.links, "__defaults__", (split,))
    rng, rows = np.random.default_rng(8), []
    for k in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, 500)]
        rows += [" ".join([*base[:at], f"x{k}-{at}", *base[at + 1 :]]) if at else " ".join(base) for at in (0, 100, 200, 300, 400)]

    def plain_bits(text):
        h = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in plain_set(text)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    bits, sets, root = [plain_bits(t) for t in rows], [plain_set(t) for t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= 3 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    want = {k: min(x for x, r in enumerate(root) if r == root[k]) for k in range(len(rows))}
    got = {r.doc_id: r.component_id for r in n.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want and 25 < len(set(want.values())) < 100


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    import corpus_pipeline

    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_groups(rows)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == set(want.values())


def test_documents_equal_brute_force(documents, texts):
    got = {r.doc_id: r.component_id for r in n.near_duplicates(documents).collect()}
    assert got == plain_groups(list(texts.items()))[0]


def test_odd_rows(odd, none):
    kept = n.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d in (1, 3, 6, 7, None, 9, 10))
    assert n.one_of_each(none).count() == 0
