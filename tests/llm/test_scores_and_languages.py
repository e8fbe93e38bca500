import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldmark.llm import cross_parsing as c
from fieldmark.llm import masked_scores as m


@pytest.fixture(scope="module")
def model(documents):
    return m.fit(documents)


def split(text):
    return (text or "").lower().replace("你", " 你 ").replace("好", " 好 ").split()


def plain_network(model, window):
    """log P(middle | others) by walking the tree of one window."""
    leaves, shared = model.vocabulary(np.array([xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in window], np.uint64))
    net, goal = model.network, int(leaves[2])
    h = np.maximum(np.concatenate([net.embed[k] for k in leaves[[0, 1, 3, 4]]]) @ net.hidden + net.bias, 0)
    out = -math.log(model.vocabulary.kinds) if shared[2] else 0.0
    for level in range(3):
        z = h @ net.nodes[level][goal // 32 ** (3 - level)] + net.tilt[level][goal // 32 ** (3 - level)]
        out += z[goal // 32 ** (2 - level) % 32] - math.log(np.exp(z).sum())
    return out


def test_scores_equal_brute_force(spark, documents, texts, model):
    got = {r.doc_id: r for r in m.scores(documents, model).collect()}
    words = {d: ["", "", *split(t), "", ""] for d, t in texts.items()}
    windows = {d: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for d, w in words.items()}
    own = {d: (Counter(w[1:4] for w in ws), Counter((w[1], w[3]) for w in ws)) for d, ws in windows.items()}
    triples, pairs = (sum((o[k] for o in own.values()), Counter()) for k in (0, 1))
    assert model.total == sum(map(len, windows.values()))
    for d in [d for d in texts if len(windows[d]) < 400][:60]:
        base, want = 0.0, 0.0
        for w in windows[d]:
            prior = plain_network(model, w)
            n, near = triples[w[1:4]] - own[d][0][w[1:4]], pairs[w[1], w[3]] - own[d][1][w[1], w[3]]
            base += prior
            want += math.log((n + m.WEIGHT * math.exp(prior)) / (near + m.WEIGHT))
        assert got[d].n_tokens == len(windows[d])
        assert got[d].network_log_prob == pytest.approx(base, rel=1e-3, abs=1e-2) and got[d].log_prob == pytest.approx(want, rel=2e-3, abs=2e-2)


def test_network_is_fitted_to_every_window(spark, documents, texts):
    """The first windows, then rounds over all others: each window once, whatever their number; the tree is laid by counts of all windows."""
    vocab = m.vocabulary(m.counts(documents))
    total = sum(len(split(t)) for t in texts.values())
    lines = m.stored(m.leaf_lines(documents.repartition(3), vocab), "test-lines")
    near = m.neighbours(lines, total).reshape(m.LEAVES, 2, m.NEAR)
    leaf = lambda w: int(vocab.leaves(np.array([xxhash.xxh64_intdigest(w) | 1 if w else 0], np.uint64))[0][0])
    pairs = Counter((a, b) for t in texts.values() for w in [["", *split(t), ""]] for a, b in zip(w, w[1:], strict=False))
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[leaf(b), leaf(a)] += n if b else 0
        right[leaf(a), leaf(b)] += n if a else 0
    for k, want in ((0, left), (1, right)):
        want = {key: n for key, n in want.items() if n and key[1] < m.NEAR}
        assert {(int(i), int(j)): int(near[i, k, j]) for i, j in zip(*np.nonzero(near[:, k]), strict=True)} == want
    vocab.place = m.arrange(near)
    for warm in (total // 4, 0):
        got = m.fit_whole(lines, vocab, total, warm=warm, task=total // 3)
        assert (got.seen[1] == total).all() and got.seen[2].sum() == total and got.seen[0].sum() == 4 * total
    # the average over a single task is what that task learns
    begun = m.Descent(m.Network.start(m._placed(vocab)))
    alone = m._averaged(lines.coalesce(1), vocab.place, begun)
    own, rng = m.Descent(begun.network()), np.random.default_rng(0)
    for sides, target in m._windows([lines.coalesce(1).toPandas()], vocab.place):
        own.run(sides, target, rng, min(m.STEPS, max(m.STEP, len(target) // 32)))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone.weights, own.weights, strict=True))


def test_every_pass_reads_every_window(documents, monkeypatch):
    """A corpus that many tasks fit is read as often as one that a single task does."""
    vocab = m.vocabulary(m.counts(documents))
    total = int(vocab.mass.sum())
    lines, read, averaged = m.stored(m.leaf_lines(documents.repartition(3), vocab), "test-lines"), [], m._averaged

    def counted(some, *args):
        read.append(sum(int(np.frombuffer(r.sizes, "<i8").sum()) for r in some.collect()))
        return averaged(some, *args)

    monkeypatch.setattr(m, "_averaged", counted)
    for warm in (0, total // 4):
        read.clear()
        got = m.fit_whole(lines, vocab, total, warm=warm, task=total // 3)
        first = total if not warm else read[0]
        assert read == [first, *[total] * (m.EPOCHS - 1)] and (got.seen[1] == total).all()
    assert (m.fit_whole(lines, vocab, total, warm=total).seen[1] == total).all()


def test_hot_windows_counted_beforehand_change_nothing(documents, model):
    early = m.fit(documents, hot=40)
    assert len(early.pairs) > 10 and len(early.triples) > 5 and not len(model.pairs)
    early.vocabulary, early.network = model.vocabulary, model.network
    a, b = ({r.doc_id: r.log_prob for r in m.scores(documents, x).collect()} for x in (model, early))
    assert a == pytest.approx(b, rel=1e-3, abs=1e-2)


def test_network_beats_frequencies_and_prefers_order(spark):
    """On windows it was not fitted to, a good part of a nat over the frequencies alone is gained, and lost where the order is shuffled."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5)))  # copies stay together
    known = d.filter("fold > 0").drop("fold")
    vocab = m.vocabulary(m.counts(known))
    place, net = m.fit_network(vocab, m.sample_windows(known, int(vocab.mass.sum())))
    mass = np.zeros(m.LEAVES)
    mass[place] = vocab.mass

    def mean(texts, net):
        block = m.Block.of([], texts)
        places = vocab(block.line)[0]
        return net.log_prob(block.around(places), places[block.at]).mean()

    words, rng = m.Words(), np.random.default_rng(0)
    held = [words(r.text) for r in d.filter("fold = 0 and length(text) > 200").collect()]
    gain = mean(held, net) - mean(held, m.Network.start(mass))
    order = mean(held, net) - mean([rng.permutation(t) for t in held], net)
    assert gain > 0.3 and order > 0.3, (gain, order)


def test_documents_that_occur_twice_stand_apart(documents, model):
    rows = m.scores(documents, model).join(documents.select("doc_id", "text"), "doc_id").filter("n_tokens >= 20").collect()
    often = Counter(r.text for r in rows)
    twice = [r.log_prob / r.n_tokens for r in rows if often[r.text] > 1]
    once = sorted(r.log_prob / r.n_tokens for r in rows if often[r.text] == 1)
    assert np.mean(np.array(twice) > once[int(0.9 * len(once))]) > 0.9


def test_odd_scores(odd, none):
    rows = m.score_documents(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_tokens == 0) == (r.mean_log_prob is None) and r.log_prob <= 0
    assert m.score_documents(none).count() == 0


def test_tokens_are_split_once_and_kept(odd):
    """The rows that all passes read have every document's tokens, ids and repeated rows, and stand in the documents' place."""
    lines = m.stored(m.word_lines(odd), "test-words")
    assert m.word_lines(lines) is lines
    got = [(i, block.words[block.doc == k].tolist()) for block in m.blocks([lines.toPandas()]) for k, i in enumerate(block.ids)]
    want = [(r.doc_id, [xxhash.xxh64_intdigest(w) | 1 for w in m.tokens(r.text)]) for r in odd.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_phrases(reference, text):
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in reference:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def plain_bits(reference, raw):
    return sum(plain_phrases(reference, raw[k : k + c.SEGMENT]) for k in range(0, len(raw), c.SEGMENT)) * math.log2(len(reference) + 1)


def test_parses_equal_substring_search():
    rng = np.random.default_rng(3)
    refs = {"a": bytes(rng.choice(list(b"abc "), 300).tolist()), "b": bytes(rng.choice(list(b"abd "), 90).tolist())}
    languages = c.Languages(refs, {"a": 1, "b": 2})
    assert languages.names == ["b", "a"]
    sizes = [*rng.integers(1, 60, 60), c.SEGMENT - 1, c.SEGMENT, c.SEGMENT + 1, 5 * c.SEGMENT + 7]
    texts = [bytes(rng.choice(list(b"abcd \xc3"), n).tolist()) for n in sizes]
    got = languages.bits(texts)
    assert got == pytest.approx(np.array([[plain_bits(refs[k], t) for k in languages.names] for t in texts]))


def test_query_equals_brute_force(spark, odd, documents):
    """The predictions of whole tables by plain substring search, odd rows and ties among them."""
    some = documents.filter("length(text) < 2500")
    refs, counts = c.references(documents, docs=12, window=400)
    names = sorted(refs, key=lambda k: (-counts[k], k))
    table = some.select("doc_id", "text").unionByName(odd.filter("length(text) < 2500 or text is null").select("doc_id", "text"))
    for r in table.select("text", c.predict(table, c.fit(documents, docs=12, window=400)).alias("p")).collect():
        raw = c.normalised(r.text)
        bits = [plain_bits(refs[k], raw) for k in names]
        assert r.p.lang_pred == (names[int(np.argmin(bits))] if raw else "und")


def test_phrases_cross_words(spark, documents):
    """Texts without their spaces hold no word of a list, and are told all the same; one common row cannot crowd out the sample."""
    rows = [(r.doc_id, re.sub(r"\s", "", r.text), r.lang) for r in documents.collect() if r.text]
    run = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = documents.filter("doc_id = 3").crossJoin(spark.range(500)).select(documents.columns)
    languages = c.fit(documents.unionByName(copies))
    got = run.select("lang", c.predict(run, languages).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang_pred for r in got]) >= 0.95


def test_any_number_of_languages(spark):
    rows = [(k, f"{w} {w[::-1]} {w}", w) for k, w in enumerate(f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)) if zlib.crc32(str(k).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = df.select("lang", c.predict(df, c.fit(df)).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang_pred for r in got]) >= 0.95


def test_held_out_languages(spark, sf_dir, documents):
    from fieldmark.llm.queries import op7_cross_parsing

    lang = {r.doc_id: r.lang for r in documents.collect()}
    got = op7_cross_parsing(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 200 and len(held) > 20 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) >= 0.95


def test_odd_languages(spark, odd, none, documents):
    languages = c.fit(documents)
    rows = odd.select("doc_id", "text", c.predict(odd, languages).alias("p")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.p.lang_pred == "und") == (not any(x.isalpha() for x in r.text or ""))
    assert none.select(c.predict(none, languages)).count() == 0
    nothing = c.fit(none)
    assert nothing.names == [] and {r.p.lang_pred for r in odd.select(c.predict(odd, nothing).alias("p")).collect()} == {"und"}
