"""Filter interaction audit: what each filter removes in every order of five, from one SQL CUBE.

Every document gets five failure flags.  Documents are counted once by part and flags; CUBE over the five flags and
the part then sums those few cells for every subset of flags.  The rows of a grouping set whose flags are all false
count what survives that subset.  An order's step leads from the subset of the filters before it to the one with its
own filter: joining the survivors of both subsets gives what it keeps and removes.

Equal texts are found by digest: the least id of each digest is joined back on (digest, id), so that a group of
copies, however large, meets on no key; rows that are equal in all that counts are one row with a count before.
Labels are joined by id, common ids by broadcast.

Defined results: a null text is the empty text; null and empty `lang` are the part ''; a null id fails E never and
passes its text to no other; rows of one id and text do not fail E for each other; of several labels of an id, the
highest value of each column counts; documents without labels are neither good nor toxic; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.shared import join_counted, stored

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Bit k of a mask is filter k of FILTERS.
ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> Column:
    """Failures A to D as one struct: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.struct(F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.transform(
        F.array(n),
        lambda w: F.struct(
            (w.words < 100).alias("A"),
            (w.distinct * 100 < w.words * 80).alias("B"),
            (capitals.cast("long") * 100 > F.length(text).cast("long") * 10).alias("C"),
            text.rlike(r"[#$%&*|]").alias("D"),
        ),
    )[0]


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): one row an id."""
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False))) for c in ("quality", "toxic"))
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"), toxic.alias("toxic"))


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A .. E, good, toxic, n): documents that agree in all of these, counted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), text_flags(text).alias("f"))
    rows = stored(own.groupBy("doc_id", "part", "digest", "f.A", "f.B", "f.C", "f.D").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    times = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    known = labelled(labels).filter("doc_id is not null").join(times, "doc_id")
    with_id = join_counted(marked.filter("doc_id is not null").withColumnRenamed("n", "times"), known, "doc_id", how="left").withColumnRenamed("times", "n")
    without = marked.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})  # never joined: null is one key
    both = with_id.unionByName(without)
    told = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return both.select("part", *FILTERS, *told, "n").groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def survivors(cells: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) for every part and subset of filters, zeros included: documents that fail none of the subset."""
    cube = """
        SELECT part, mask, n, good, toxic FROM (
            SELECT part, A, B, C, D, E, grouping(part) AS over_parts, {mask} AS mask, sum(n) AS n, sum(if(good, n, 0)) AS good, sum(if(toxic, n, 0)) AS toxic
            FROM {{cells}} GROUP BY CUBE (part, A, B, C, D, E)
        ) WHERE over_parts = 0 AND NOT ({failed})
    """.format(mask=" + ".join(f"(1 - grouping({f})) * {1 << k}" for k, f in enumerate(FILTERS)), failed=" OR ".join(f"coalesce({f}, false)" for f in FILTERS))
    found = cells.sparkSession.sql(cube, cells=cells)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").fillna(0, ["n", "good", "toxic"])


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before, after, alone, others) for every step of every order; the last four are masks."""
    rows = []
    for order in permutations(FILTERS):
        done = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), k + 1, f, done, done | bit, bit, ALL ^ bit))
            done |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, alone int, others int")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = stored(survivors(flagged(documents, labels)), "audit-survivors")

    def of(name: str) -> DataFrame:
        return counts.select("part", F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")])

    ends = counts.groupBy("part").agg(F.max(F.when(F.col("mask") == 0, F.col("n"))).alias("total"), F.max(F.when(F.col("mask") == ALL, F.col("n"))).alias("clean"))
    paired = steps(documents.sparkSession).join(of("before"), "before")
    paired = reduce(lambda rows, name: rows.join(of(name), ["part", name]), ("after", "alone", "others"), paired).join(ends, "part")
    removed = F.col("before_n") - F.col("after_n")
    told = paired.select(
        "part", "filter_order", "step", "filter",
        F.col("after_n").alias("kept"),
        removed.alias("removed"),
        (F.col("total") - F.col("alone_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("clean")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"),
        (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))  # 120 rows each


#: The same rows, document by document: the first filter of an order that a document fails removes it.
ORACLE = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
    SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs
), marked AS (
    SELECT w.doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM worded w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS filter FROM orders, range(1, 6) r(s)
), gone AS (  -- the step at which a document leaves, 6 if none
    SELECT doc_id, part, fails, good, toxic, filter_order, coalesce(list_min([s FOR s IN [1, 2, 3, 4, 5] IF fails[strpos('ABCDE', substr(filter_order, s, 1))]]), 6) AS leaves
    FROM marked, orders
), told AS (
    SELECT part, filter_order, step, filter,
        sum((leaves > step)::INT)::BIGINT AS kept,
        sum((leaves = step)::INT)::BIGINT AS removed,
        sum((leaves < step AND fails[strpos('ABCDE', filter)])::INT)::BIGINT AS redundant,
        sum((fails[strpos('ABCDE', filter)] AND len(list_filter(fails, lambda f: f)) = 1)::INT)::BIGINT AS unique_fails,
        sum((leaves = step AND good)::INT)::BIGINT AS good_lost,
        sum((leaves = step AND toxic)::INT)::BIGINT AS toxic_lost
    FROM gone JOIN steps USING (filter_order) GROUP BY part, filter_order, step, filter
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told
"""
