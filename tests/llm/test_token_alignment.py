import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fieldmark.llm import token_alignment as ta


def brute(rows):
    """Whole texts through both tokenizers, every pair of byte ranges compared."""
    import json

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    entry = {k: t for t, k in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    sign = ta.byte_of_sign()

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    held, per = Counter(), []
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        pa_ = [bytes(sign[c] for c in entry[k]) for k in ia]
        pb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        if not text or b"".join(pa_) != raw or b"".join(pb) != raw:
            per.append((doc_id, None))
            continue
        ra, rb = ranges(pa_), ranges(pb)
        pairs = [(x, y) for x, (s, e) in zip(ia, ra) for y, (t, f) in zip(ib, rb) if s < f and t < e]
        held.update(pairs)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [f"{','.join(str(k) for k, (_, e) in zip(ia, ra) if lo < e <= hi)}|{','.join(str(k) for k, (_, e) in zip(ib, rb) if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts)]
        per.append((doc_id, (len(ia), len(ib), groups, pairs)))
    most = Counter()
    for (_, y), n in held.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, t in per:
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, pairs = t
            out.append((doc_id, na, nb, len(groups), len(pairs), sum(held[p] == most[p[1]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_equals_all_pairs_of_ranges(spark):
    rng = random.Random(5)
    signs = "ab cC  \n\t.,'sé你\U0001f600  \x1c\x85  12#ﬁ\r<|>▁"
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "<|endoftext|> <s> </s> <unk>"), (404, "same words here"), (404, "same words here"), (None, "no id"), (405, "x" * 3000), (406, "one ▁ two")]
    got = ta.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_documents_against_whole_texts(spark, documents):
    """Real texts, in many blocks: chunks and blocks change nothing."""
    rows = [(r.doc_id, (r.text or "")[:1500]) for r in documents.select("doc_id", "text").limit(60).collect()]
    held = ta.BLOCK_BYTES, ta.REMEMBERED, ta.KEPT
    ta.BLOCK_BYTES, ta.REMEMBERED, ta.KEPT = 20_000, 500, 200
    try:
        got = ta.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    finally:
        ta.BLOCK_BYTES, ta.REMEMBERED, ta.KEPT = held
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_odd_rows(spark, odd, none):
    got = ta.align(odd)
    assert got.columns == [c.split(" ")[0] for c in ta.TOLD.split(", ")]
    rows = got.collect()
    assert len(rows) == 13 and {r.n_a for r in rows if r.doc_id in (3, 4)} == {0}
    same = [r[1:] for r in rows if r.doc_id in (1, 2)]
    assert len(same) == 3 and len(set(same)) == 1 and same[0][0] > 0
    assert len({r[1:] for r in rows if r.doc_id in (7, 8)}) == 1
    assert ta.align(none).collect() == []


def test_labels_groups_links():
    marks = ta.labels(np.array([1, 2, 3]), np.array([3, 1, 2]))
    assert marks == b"a.cb.c" and list(ta.groups(marks)) == [(2, 1), (1, 2)]
    i, j = ta.links(marks)
    assert list(zip(i, j)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_spans_cover_the_text():
    text = "Straße, naïve  \n 123"
    got = ta.spans(text)
    assert [s[0] for s in got[1:]] == [s[1] for s in got[:-1]] and got[-1][1] == len((" " + text).encode()) and ta.spans("") == [] and ta.spans("▁") == []


@pytest.mark.parametrize("parts,out", [(["a", "b"], ["a", "b"]), (["a", "", "b"], ["a  b"]), (["a\n", "b", "c"], ["a\n b", "c"]), (["", ""], [" "])])
def test_merged(parts, out):
    assert ta.merged(parts) == out
