"""Interaction of corpus filters by direct relational replay, in DataFrame expressions only.

Every document's filter flags are crossed with the broadcast table of all orders of the filters (n! constant rows, n at
most MOST_FILTERS; 120 for five). Each of the pairs is exploded into its steps; the first failing step of the order
decides what a step keeps, removes or finds already removed. One conditional aggregation by part, order and step follows:
every task adds up its own documents first, so what is shuffled does not depend on the number of documents.

A document is a row. Null texts, parts and ids: a null text or part reads as the empty string; a row without an id is a
copy of nothing and no smaller copy of anything, and has no labels. Rows that share an id and a text are no copies of each other (neither id
is smaller); several labels of an id count as one that has every mark given to it. Very long texts are handled whole, one at a time. An
empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_FILTERS = 6
WORD_BREAK = r"[\x20\x09-\x0D]+"


def rule_flags(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def with_copies(docs: DataFrame, id_col: str, digest_col: str, out_col: str) -> DataFrame:
    """docs with a boolean out_col: a row with a smaller id has the same digest. Rows meet the table of first ids on id and
    digest, so a digest that many rows share is dealt out by id."""
    first = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(digest_col).alias("_digest")).agg(F.min(id_col).alias("_first"))
    joined = docs.join(first, (docs[digest_col] == first["_digest"]) & (docs[id_col] == first["_first"]), "left")
    return joined.withColumn(out_col, F.col(id_col).isNotNull() & F.col("_first").isNull()).drop("_digest", "_first")


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic), one row per row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in rule_flags(F.col("text")).items()])
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = with_copies(rows, "doc_id", "digest", "E").join(marks, "doc_id", "left")
    return flagged.select("doc_id", "part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders_of(spark: SparkSession, filters: list[str]) -> DataFrame:
    """(filter_order, masks): all orders of the filters; a filter's mask is its bit, in the order of `filters`."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, as all their orders are replayed")
    bits = {name: 1 << i for i, name in enumerate(filters)}
    return spark.createDataFrame([("".join(p), [bits[x] for x in p]) for p in permutations(filters)], "filter_order string, masks array<int>")


def replay(flags: DataFrame, filters: list[str], part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of boolean columns `filters`.

    Every part occurs with every order and step. A null flag is no failure, a null mark none.
    """
    n, orders = len(filters), orders_of(flags.sparkSession, filters)
    failed = reduce(Column.bitwiseOR, [F.when(F.col(name), 1 << i).otherwise(0) for i, name in enumerate(filters)])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    docs = flags.select(F.col(part_col).alias("part"), failed.alias("failed"), flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    crossed = docs.crossJoin(F.broadcast(orders))
    fails = lambda mask: F.col("failed").bitwiseAND(mask) != 0
    first = F.coalesce(*[F.when(fails(F.col("masks")[k]), k + 1) for k in range(n)], F.lit(n + 1))
    steps = crossed.select("part", "failed", "good", "toxic", "filter_order", first.alias("first"), F.posexplode("masks").alias("at", "mask"))
    step, first = F.col("at") + 1, F.col("first")
    removed = step == first
    count = lambda c, name: F.count_if(c).alias(name)
    by = steps.groupBy("part", "filter_order", "at", "mask").agg(
        count(step < first, "kept"),
        count(removed, "removed"),
        count((step > first) & fails(F.col("mask")), "redundant"),
        count(F.col("failed") == F.col("mask"), "unique_fails"),
        count(removed & F.col("good"), "good_lost"),
        count(removed & F.col("toxic"), "toxic_lost"),
    )
    # of one part and filter there are (n-1)! rows of each step, whatever the number of documents
    shapley = F.sum("removed").over(Window.partitionBy("part", "mask"))
    return by.select("part", "filter_order", step.alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
