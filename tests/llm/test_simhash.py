import re

import numpy as np
import xxhash

from fieldmark.llm import simhash_blocks as s
from fieldmark.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=3):
    fps = [f for _, f in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_query_equals_brute_force(spark, sf_dir, texts):
    from fieldmark.llm.queries import op9_simhash_blocks

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash_blocks(spark, sf_dir).collect()}
    rows = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows), strict=True)}
    assert got == want


def test_odd_rows(odd, none):
    rows = s.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] and {c for _, c in by[2]} == {1}
    assert {f for f, _ in by[3] | by[4] | by[5]} == {0} and {c for _, c in by[4]} == {3}
    assert {c for _, c in by[8]} == {7}
    assert s.near_duplicates(none).count() == 0
    kept = s.one_of_each(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((d is None, d or 0) for d in (1, 3, 6, 7, None, 9, 10))
    assert s.one_of_each(odd).columns == odd.columns
    assert s.one_of_each(none).count() == 0


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 63, 3, np.uint64)
    fps = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in center for a, b in rng.integers(0, 20, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 200, np.uint64)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(s.links(df, split=8)).collect()}
    rows = [(int(np.uint64(f).view(np.int64)), f) for f in sorted(fps)]
    want = plain_components(rows)
    for (node, _), c in zip(rows, want, strict=True):
        assert roots.get(node, node) == c


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
