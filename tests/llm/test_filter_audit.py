import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from fieldmark.llm import filter_audit as fa


def brute(rows, labels):
    """(part, order, step): the seven counts, document by document."""
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for d, lang, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = sum("A" <= c <= "Z" for c in text)
        copy = d is not None and any(e is not None and e < d and (t or "") == text for e, _, t in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * capitals > 10 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": copy}
        docs.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        removed = defaultdict(int)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                go = [x for x in left if x[1][f]]
                gone_before = sum(x[1][f] for x in mine) - len(go)
                left = [x for x in left if not x[1][f]]
                only = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                out[part, "".join(order), k + 1] = [len(left), len(go), gone_before, only, sum(x[2] for x in go), sum(x[3] for x in go)]
                removed[f] += len(go)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def told(df):
    rows = df.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows}) and all(r.filter == r.filter_order[r.step - 1] for r in rows)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_equals_a_walk_through_every_order(spark):
    long = " ".join(f"w{k}" for k in range(120))
    texts = [long, long, long + " #", "SHOUT " * 150, "few words", "", None, " \n", long + " x", "A" * 500 + long, "é" * 30, "same same " * 80, long.upper(), "few words"]
    rows = [(k, ["en", None, "", "de"][k % 4], texts[k % len(texts)]) for k in range(90)] + [(None, "en", "few words"), (None, None, long), (3, "en", "few words"), (3, "en", "few words"), (3, "de", long)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (3, None, None), (2, 1, 0)]
    got = fa.audit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told(got) == brute(rows, labels)


def test_documents_against_sql(spark, sf_dir, documents, labels):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = con.execute(fa.ORACLE).fetchdf()
    got = told(fa.audit(documents, labels))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [getattr(r, c) for c in names] for r in sql.itertuples()} == got
    assert got == brute([(r.doc_id, r.lang, r.text) for r in documents.collect()], [tuple(r) for r in labels.collect()])


def test_odd_rows(spark, odd, none, labels):
    clash = odd.withColumns({c: odd.n for c in ("part", "digest", "quality", "toxic", "A", "E", "mask", "first", "f")})
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect()]
    assert told(fa.audit(clash, labels.limit(0))) == brute(rows, [])
    assert fa.audit(none, labels).collect() == []


def test_cube_meets_only_counted_cells(spark, documents, labels):
    cells = fa.flagged(documents, labels)
    assert cells.count() <= documents.select("lang").distinct().count() * 32 * 4
    assert cells.agg({"n": "sum"}).first()[0] == documents.count()


@pytest.mark.parametrize("text,fails", [("#", "AD"), ("A b " * 60, "BC"), (" ".join(f"x{k}" for k in range(100)), ""), (" ".join(f"x{k}" for k in range(99)), "A")])
def test_text_flags(spark, text, fails):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(fa.text_flags(F.col("t")).alias("f")).first().f
    assert "".join(k for k in "ABCD" if row[k]) == fails
