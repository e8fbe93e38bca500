import pytest

LONG = "wort " * 30_000 + "x" * 200_000
#: null, empty, blank, one word, repeated rows, ties, very long texts, a null id
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, None), (4, ""), (5, "   \n\t "), (6, "word"), (7, LONG), (8, LONG), (None, "orphan text without an id"), (None, None), (9, "éè 你好 \U0001f600 İstanbul ΣΑΣ cáfe"), (10, "| | | $$$ !!! ###"),
]
#: extra columns whose names the operators use themselves
EXTRA = ["score", "predicted", "fp", "root", "component_id", "entities", "digest", "shard", "slot", "y", "h", "n", "size", "media", "length", "rank", "part", "labelled_id", "item_id"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case and clashing extra columns."""
    rows = [(i, t, "en", "s", len(t or ""), *["x"] * len(EXTRA)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """No documents at all."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
