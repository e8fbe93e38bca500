import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldmark.llm import rule_quality as q


def test_held_out_accuracy_and_compiled_rules(spark, sf_dir, labels):
    from fieldmark.llm.queries import op4_rule_quality

    got = {r.doc_id: r for r in op4_rule_quality(spark, sf_dir).collect()}
    assert len(got) == 200
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    marked = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in marked]) >= 0.85
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = q.fit(documents, labels)
    stats = q.with_statistics(documents.select("doc_id", "text")).toPandas()
    plain = model.predict(stats[[f"__{k}" for k in q.STATISTICS]].to_numpy(float), list(q.STATISTICS))
    assert np.allclose(plain, [got[d].score for d in stats.doc_id], atol=1e-9)


def test_lasso_is_sparse_and_right():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, (2000, 30)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * a[:, 0] - 3 * a[:, 1])))).astype(float)
    b, w = q.lasso_logistic(a, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and (np.abs(w[2:]) < 0.2).all() and (np.abs(w) < 1e-9).sum() >= 15


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (None, 1), (9, None), (9, 1), (10, 0)], "doc_id long, quality int").withColumn("y", F.lit("x")).withColumn("text", F.lit("x"))
    model = q.fit(odd, labels)
    rows = q.score(odd, model)
    assert rows.count() == odd.count()
    by = {}
    for r in rows.collect():
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[2]) == 1 and by[1] == by[2] and by[3] == by[4]
    assert set(rows.columns) == set(odd.columns)
    assert q.score(none, model).count() == 0
    kept = q.accepted(odd, model)
    assert kept.schema == odd.schema and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in rows.filter("predicted = 1").collect())
    assert q.fit(none, labels).rules == [] and q.fit(odd, labels.limit(0)).intercept == 0.0
    one = q.fit(odd, labels.filter("quality = 1"))
    assert one.rules == [] and one.intercept > 0
