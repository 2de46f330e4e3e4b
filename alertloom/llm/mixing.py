"""Mixing sources to target weights.

Each source gets a target of words: `share` of all words is divided by weight, no target passes `most_epochs` times
its source's words, and what that frees goes to the others by weight (the closed form of repeated resharing).
Whole epochs of a source are taken first; for the rest, documents get hash-random keys, are range-sorted within
their source by bins of that key, and a distributed prefix sum (bins, then rows inside a bin) cuts at the exact
budget: the document on the cut gives only its first words.

Bins are equal ranges of a uniform hash, as many as the source needs for `bin_rows` rows each, so a source with a
third of all rows is spread over many tasks. Null sources are a source of their own, sorted last. Null and empty
texts have size 0 and take 0. Equal doc_ids share a key and are ordered by size; equal rows are interchangeable.
An empty table gives an empty result, and a corpus without words takes nothing. Texts are counted whole, however long;
other columns are never read, whatever their names. The sources themselves, one row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free_name

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """sources(source, source_size, n_rows) -> the same with weight and target; one row a source.

    With capacity = most_epochs * size, the sources of least capacity / weight are capped: the largest level at which
    the budget is met exactly is found from prefix sums in that order.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight).withColumn("capacity", F.col("source_size") * most_epochs)
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    s = s.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # at this source's turn all before it are capped; the rest shares what is left by weight
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left_weight"))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("capacity"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("common", level)
    target = F.when(F.col("common").isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), F.col("common") * F.col("weight")))
    return s.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_epochs: int = 2, seed: str = "mix", bin_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per input row; `taken` words, repeats counted."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    rows = scratch.save(rows.withColumn("mix_key", key))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = scratch.save(targets(sources, weights, share, most_epochs))
    plan = plan.withColumn("n_bins", F.ceil(F.col("n_rows") / bin_rows).cast("int"))
    plan = plan.withColumn("budget", F.round("target").cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    dealt = rows.alias("r").join(plan.alias("p"), same).select("doc_id", "r.source", "size", "mix_key", "source_size", "target", "epochs", "rest", "n_bins")
    place = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    dealt = dealt.withColumn("bin", F.floor(place * F.col("n_bins") / F.lit(1 << 32)).cast("int"))
    bins = dealt.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    ahead = F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("source", "bin", ahead.alias("ahead"))
    inside = W.partitionBy("source", "bin").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    run = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.alias("d").join(bins.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin")))
    start = F.col("within") + F.col("ahead")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return run.select("doc_id", "d.source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def materialise(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs (all columns) as often as the mix takes them: whole epochs, and one more copy where at least half of
    the document lies before the cut. Documents the mix takes no half of are left out.

    One plan per doc_id: rows that share a doc_id are repeated alike. Documents without words stay as they are.
    """
    key, times, copy = (free_name(n, docs) for n in ("mix_id", "mix_times", "mix_copy"))
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).cast("int")
    plan = mixed.select(F.col("doc_id").alias(key), whole.alias(times)).groupBy(key).agg(F.max(times).alias(times)).filter(F.col(times) > 0)
    out = docs.join(plan, docs[id_col].cast("long").eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)
