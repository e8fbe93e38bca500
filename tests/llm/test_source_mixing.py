import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from fieldmark.llm import source_mixing as sm


def aims(sizes):
    """Water-filling with exact fractions: sources (code points, null last) weigh 5, 2, 1 and stop at three sizes."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:
        left, free = sum(sizes.values()) - sum(capped.values()), [s for s in order if s not in capped]
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**share, **capped}
        capped |= {s: 3 * sizes[s] for s in above}


def check(rows, got):
    """The contract, from the rows alone."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += size(text)
    target = aims(sizes)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r["size"]) for r in got], key=key) == sorted([(d, size(t)) for d, _, t in rows], key=key)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source])) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - target[s]) <= 1.5 * min(sm.BLOCK, max(1, n // sm.BLOCKS)), s


def test_documents_reach_their_targets(spark, documents):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    got = sm.take(documents).collect()
    check(rows, got)
    again = sm.take(documents.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    check(rows, sm.take(odd.withColumnsRenamed({"size": "taken"})).collect())
    assert sm.take(none).collect() == [] and sm.mix(none).collect() == []


def test_many_sources_and_copies(spark):
    """Null, empty and non-Latin sources; one source and one row with a third of all; a source whose target stops at three sizes."""
    rows = [(k, None if k % 7 == 0 else ["", "zeta", "alpha", "ü", "web", "web"][k % 6], "w " * (k % 11)) for k in range(500)]
    rows += [(9000, "web", "the same row again")] * 700 + [(9001, "zeta", "tiny")]
    held, sm.RUN = sm.RUN, 64
    try:
        got = sm.take(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)).collect()
        check(rows, got)
        parts = sm.draws(spark.createDataFrame(rows, "doc_id long, source string, text string"), shards=8).collect()
    finally:
        sm.RUN = held
    words = Counter()
    for p in parts:
        words[p.source, p.doc_id] += p.words
    expected = Counter()
    for r in got:
        expected[r.source, r.doc_id] += r.taken
    assert words == +expected


def test_mix_deals_each_block_once_and_evenly(spark, documents):
    shards = 6
    out = sm.mix(documents, shards=shards).collect()
    texts = {r.doc_id: re.findall(sm.WORD, r.text or "") for r in documents.collect()}
    blocks = defaultdict(set)
    for r in out:
        assert r.text.split(" ") == texts[r.doc_id][r.from_word : r.from_word + r.words]
        blocks[r.source, r.place].add(r.shard)
    assert all(len(s) == 1 for s in blocks.values())  # disjoint
    per = Counter(next(iter(s)) for s in blocks.values())
    assert len(per) == shards and max(per.values()) - min(per.values()) <= 1
    taken = {r.doc_id: r.taken for r in sm.take(documents, shards=shards).collect()}
    got = Counter()
    for r in out:
        got[r.doc_id] += r.words
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_taken_words_are_those_of_the_shards(spark, documents, monkeypatch):
    """The query's numbers come from the tree's deal: per document and shard as the draws hold them, and another deal of the tree gives another."""
    shards, words = 6, Counter()
    got = sm.take(documents, shards=shards).collect()
    for p in sm.draws(documents, shards=shards).collect():
        words[p.doc_id, p.shard] += p.words
    assert {(r.doc_id, p.shard): p.words for r in got for p in r.dealt} == dict(words) and {s for _, s in words} == set(range(shards))
    assert all(r.taken == sum(p.words for p in r.dealt) for r in got)
    whole = sm.split
    monkeypatch.setattr(sm, "split", lambda quotas, shards, seed: whole(quotas, shards, seed)[:, ::-1])
    other = sm.take(documents, shards=shards).collect()
    assert sorted((r.doc_id, r.taken) for r in other) == sorted((r.doc_id, r.taken) for r in got)
    assert {r.doc_id: r.dealt for r in other} != {r.doc_id: r.dealt for r in got}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(sm.permuted(np.arange(n), n, 99)) == list(range(n))


def test_split_is_exact_and_hypergeometric():
    quotas = [10, 0, 20, 33]
    got = sm.split(quotas, 7)
    assert got.sum(axis=1).tolist() == quotas and set(got.sum(axis=0)) == {9}
    means = np.mean([sm.split([30, 10], 4, seed=s)[0] for s in range(400)], axis=0)
    assert np.allclose(means, 7.5, atol=0.3)
    spread = np.var([sm.split([30, 10], 4, seed=s)[0, 0] for s in range(1500)])
    assert spread == pytest.approx(10 * 0.75 * 0.25 * 30 / 39, rel=0.15)  # n p (1 - p) (N - n) / (N - 1)
    big = sm.split([3_000_000_000, 1_000_000_000], 4)
    assert big.sum(axis=0).tolist() == [1_000_000_000] * 4
