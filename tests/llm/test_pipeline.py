import re
from collections import defaultdict

import pytest

from tests.llm.test_near_copies import plain_groups
from tests.llm.test_pii import ANY
from tests.llm.test_placing import check_packing
from tests.llm.test_seed_leaks import plain_overlaps


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage of the pipeline returns, as rows."""
    import corpus_pipeline
    from fieldmark.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, sf_dir, stages, labels, benchmark_items):
    columns = stages[0].columns
    assert all(s.columns == columns for s in stages[1:-1])
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in stages[:-1]]
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(quality.get(d) == 1 for d in rows[0]) * 0.97 <= sum(quality.get(d) == 1 for d in rows[1])
    assert sum(quality.get(d) == 0 for d in rows[1]) <= 0.2 * sum(quality.get(d) == 0 for d in rows[0])
    groups, _ = plain_groups(list(rows[1].items()))  # similarity of five-word shingles, all pairs
    assert set(rows[2]) == set(groups.values())
    items = [(r.item_id, r.text) for r in benchmark_items.collect()]
    grams = {tuple(w[k : k + 3]) for _, t in items for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 2)}
    for d, t in rows[2].items():
        w = re.findall(r"\w+", t.lower())
        shared = sum(tuple(w[k : k + 3]) in grams for k in range(len(w) - 2))
        if d not in rows[3]:
            assert plain_overlaps(t, items)
        elif shared >= 5 and len(t) < 3000:
            assert not plain_overlaps(t, items)
    assert set(rows[4]) == set(rows[3])
    for d, t in rows[3].items():
        assert ANY.sub("\0", t) == ANY.sub("\0", rows[4][d]) and not {m.group() for m in ANY.finditer(t)} & {m.group() for m in ANY.finditer(rows[4][d])}
    from fieldmark.llm import pattern_packing as k

    tokenizer = k._tokenizer(k.default_tokenizer())
    packed = stages[-1].collect()
    check_packing(packed, lambda d: [*tokenizer.encode(rows[4][d], add_special_tokens=False).ids, 0])
    assert {r.doc_id for r in packed} == set(rows[4])


def test_run_returns_the_last_stage(spark, sf_dir, stages):
    import corpus_pipeline

    def content(df):
        out = defaultdict(list)
        for r in df.collect():
            out[r.doc_id].append((r.piece, r.length, r.ids_crc32))
        return {d: sorted(v) for d, v in out.items()}

    assert content(corpus_pipeline.run(spark, sf_dir)) == content(stages[-1])


def test_odd_rows_pass_every_stage(spark, sf_dir, odd, none):
    import corpus_pipeline
    from fieldmark.llm.shared import stored

    for docs in (odd, none):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stored(stage(spark, docs, sf_dir), f"odd-{name}")
            assert k == 4 or docs.columns == columns
        docs.count()
