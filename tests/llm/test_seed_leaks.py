import re
import time
from itertools import combinations

import numpy as np

from fieldmark.llm import seed_leaks as s


def plain_overlaps(text, items, identity=0.8, least=12):
    """All diagonals, all stretches."""
    w = re.findall(r"\w+", (text or "").lower())
    out = {}
    for item_id, t in items:
        it = re.findall(r"\w+", (t or "").lower())
        if len(it) < 5:
            continue
        best = 0
        for d in range(-len(it) + 1, len(w)):
            at = range(max(0, -d), min(len(it), len(w) - d))
            same = [w[d + k] == it[k] for k in at]
            upto = [0]
            for x in same:
                upto.append(upto[-1] + x)
            for i in range(len(same)):
                for j in range(len(same), i + best, -1):
                    if upto[j] > upto[i] and upto[j] - upto[i] >= identity * (j - i) - 1e-9:
                        best = j - i
                        break
        if best >= min(least, len(it)):
            out[item_id] = best
    return out


def test_query_equals_brute_force(spark, sf_dir, texts, benchmark_items):
    from fieldmark.llm.queries import op2_seed_leaks

    got = {}
    for r in op2_seed_leaks(spark, sf_dir).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.aligned
    items = [(r.item_id, r.text) for r in benchmark_items.collect()]
    some = sorted(got)[:6] + [d for d in texts if d not in got and len(texts[d]) < 1500][:25]
    for d in some:
        assert got.get(d, {}) == plain_overlaps(texts[d], items)


def test_repetitive_texts_take_no_longer():
    for unit in (["a"], ["a", "b", "c"], ["a", "b", "a", "c", "d"]):
        item, text = " ".join(unit * (60 // len(unit))), " ".join(["x", *unit * (100 // len(unit)), "b", "y"])
        got = s.Seeds([(1, item)]).search([text])[0]
        assert {1: got[0][2]} == plain_overlaps(text, [(1, item)])
        began = time.process_time()
        found = s.Seeds([(1, " ".join(unit * 1200))]).search([" ".join(unit * 8000)])[0]
        assert found[0][2] == 1200 * len(unit) and time.process_time() - began < 20


def test_many_like_repetitive_items_take_no_longer():
    """Documents and items of two alternating words meet on every other diagonal; the longest ends the search of a pair."""
    items = [(k, "aa bb " * (600 + k // 10)) for k in range(50)]
    seeds = s.Seeds(items)
    began = time.process_time()
    found = seeds.search(["aa bb " * 20_000])[0]
    assert [(f[0], f[2]) for f in found] == [(k, 2 * (600 + k // 10)) for k in range(50)] and time.process_time() - began < 10


def test_shortest_items_match_whole_texts():
    seeds = s.Seeds([(1, "Yes, it is."), (2, "no"), (3, "")])
    assert seeds.search(["yes it IS", "No!", "yes it is not", "", None]) == [[(1, 0, 3, 3)], [(2, 0, 1, 1)], [], [], []]


def test_substitutions_are_tolerated():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(30)]
    seeds = s.Seeds([(7, " ".join(item))])
    found = 0
    for _ in range(200):
        copy = list(item)
        for k in rng.choice(np.arange(1, 29), 5, replace=False):
            copy[k] = word()
        text = " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])
        found += bool(seeds.search([text])[0])
    assert found >= 196
    assert seeds.search(["nothing of it", None, ""]) == [[], [], []]


def test_longest_overlap():
    assert s.longest_overlap(np.array([0, 0], bool)) == (0, 0)
    assert s.longest_overlap(np.array([1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool)) == (0, 6)
    assert s.longest_overlap(np.array([0, 1, 1, 1, 1, 0, 0], bool)) == (0, 5) and s.longest_overlap(np.array([0, 0, 1], bool)) == (2, 3)
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.random(rng.integers(1, 30)) < 0.7
        x, y = s.longest_overlap(a)
        best = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j].any() and a[i:j].sum() >= 0.8 * (j - i) - 1e-9), default=0)
        assert y - x == best and (not best or a[x:y].sum() >= 0.8 * best - 1e-9)


def test_odd_rows(spark, odd, none, benchmark_items):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "the"), (5, "wort " * 40)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in s.leaks(odd, items).collect())
    assert got == sorted([(d, 1) for d in (1, 2, 2) for _ in range(2)] + [(7, 5), (8, 5)])
    kept = s.decontaminate(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 9, 10]
    assert s.leaks(none, items).count() == 0 and s.leaks(odd, items.limit(0)).count() == 0
    assert s.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_blocks_of_the_benchmark_add_up(documents, benchmark_items):
    parts = s.seed_blocks(benchmark_items, most=300)
    assert len(parts) > 2 and sum(len(p.ids) for p in parts) == benchmark_items.count()


def fitted(pattern, masks):
    """Whether some mask stands somewhere on the pattern's equal tokens."""
    return any(all(pattern[k + i] == "1" for i, c in enumerate(m) if c == "1") for m in masks for k in range(len(pattern) - len(m) + 1))


def test_masks_fit_every_pattern_of_short_items():
    for n in range(s.SHORTEST, 21):
        for subs in range(int(n * (1 - s.IDENTITY) + 1e-9) + 1):
            for places in combinations(range(n), subs):
                pattern = "".join("0" if k in places else "1" for k in range(n))
                assert fitted(pattern, (*s.MASKS, *s.SHORT_MASKS.get(n, ()))), pattern


def test_masks_fit_every_stretch_of_long_items():
    # the fewest substitutions that keep all masks off a stretch of `size` tokens, by what its last tokens were
    span = max(map(len, s.MASKS))
    masks = [(len(m), int(m, 2)) for m in s.MASKS]
    fewest = {1: 0}
    for size in range(2, 151):
        after = {}
        for last, subs in fewest.items():
            for bit in (0, 1):
                now = last << 1 | bit
                if not any(size >= n and now & m == m for n, m in masks):
                    key = now & (1 << span - 1) - 1
                    after[key] = min(after.get(key, size), subs + 1 - bit)
        fewest = after
        assert size < s.LEAST or all(size - subs < s.IDENTITY * size - 1e-9 for last, subs in fewest.items() if last & 1), size


def test_short_items_are_found_with_every_substitution():
    for n in range(5, 21):
        item = [f"t{k}" for k in range(n)]
        seeds = s.Seeds([(1, " ".join(item))])
        most = int(n * (1 - s.IDENTITY) + 1e-9)
        for places in [p for p in combinations(range(n), most) if n < 15 or 0 in p or n - 1 in p or sum(p) % 5 == 0]:
            copy = [f"x{k}" if k in places else t for k, t in enumerate(item)]
            assert [f[0][:3] for f in seeds.search([" ".join(["a", "b", *copy, "c"])])] == [(1, 2, n)]


def test_several_blocks_find_what_one_finds(odd, documents, benchmark_items):
    assert sorted(s.leaks(documents, benchmark_items, most=1000).collect()) == sorted(s.leaks(documents, benchmark_items).collect())
    one, more = (s.decontaminate(documents.union(odd.select(documents.columns)), benchmark_items, most=m) for m in (s.BLOCK_TOKENS, 1000))
    assert sorted(one.collect(), key=str) == sorted(more.collect(), key=str)
