"""Sharding by sampled splitters, law `bytes`: the shards' sizes are near equal.

Keys (crc32 of the text, doc_id, a mark of size and chance) are range-partitioned. A Poisson sample that picks rows with
chance in proportion to their size (none left out that is larger than a sample step) gives the quantile boundaries of
many small ranges, one for `range_bytes` at least; ranges that turn out overfull are sampled again, finer, and
subdivided until none is left that holds more than its largest row. Exact byte and row counts of the ranges and a
running sum inside each then give every row its place in the whole order, from which its shard and slot follow. Equal
texts share a crc, but their doc_ids differ, and rows repeated whole differ in the mark, so a group of copies that holds a
third of all rows is cut like any other stretch of keys.

Texts are measured whole, however long; other columns are never read, whatever their names. Null texts have size
`overhead`, no crc and come first. Rows that agree in text, doc_id and size are interchangeable. An empty table gives an
empty result. Only the boundaries and the ranges' counts reach the driver: about `samples_per_range` keys for each range
or `range_bytes` of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, long_array

OVERHEAD = 16
LAST = (1 << 63) - 1


KEY = ("c", "d", "e")


def _range_of(cuts: list[tuple[int, ...]]) -> Column:
    """Number of boundaries at or below a row's key, by bisection over constant arrays.

    A boundary may be shorter than a key; it then stands before every key that starts with it.
    """
    if not cuts:
        return F.lit(0)
    n = len(cuts)
    parts = [long_array([cut[i] if i < len(cut) else -LAST for cut in cuts]) for i in range(len(KEY))]

    def halve(span: Column, _: Column) -> Column:
        lo, hi = span["lo"], span["hi"]
        mid = ((lo + hi) / 2).cast("int")
        under = F.lit(True)
        for name, part in reversed(list(zip(KEY, parts, strict=True))):
            at = F.get(part, mid)
            under = (at < F.col(name)) | ((at == F.col(name)) & under)
        done = lo >= hi
        return F.struct(F.when(done | ~under, lo).otherwise(mid + 1).cast("int").alias("lo"), F.when(done | under, hi).otherwise(mid).cast("int").alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def _cuts(keys: DataFrame, weight: Column, step: float, ranges: int) -> list[tuple[int, ...]]:
    """Boundaries of about `ranges` ranges of equal weight; keys are picked with chance weight / step."""
    chance = F.least(F.lit(1.0), weight / F.lit(step))
    u = F.pmod(F.xxhash64(*KEY, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = keys.filter(u < chance).select(*KEY, F.greatest(F.lit(step), weight.cast("double")).alias("w"))
    rows = sorted(map(tuple, picked.collect()))  # about total weight / step keys
    total, run, out = sum(r[-1] for r in rows), 0.0, []
    for *key, w in rows:
        if run >= total * (len(out) + 1) / ranges:
            out.append(tuple(key))
        run += w
    return out


def shard(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 16, samples_per_range: int = 12, range_bytes: int = 4 << 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per input row; shard 0..shards-1, slots gapless from 0."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # size first, then chance: written here once, so that later reads agree on it
    rows = scratch.save(rows.withColumn("e", F.shiftleft("size", 31) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31))))
    keys = rows.select("*", F.coalesce("text_crc32", F.lit(-1)).alias("c"), F.coalesce("doc_id", F.lit(-LAST)).alias("d"))
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(shards * ranges_per_shard, -(-total // range_bytes))
    cuts = _cuts(keys, F.col("size"), total / (ranges * samples_per_range), ranges)

    def loads(cuts: list) -> dict[int, tuple[int, int]]:
        got = keys.groupBy(_range_of(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest"))
        return {r["range"]: (r["bytes"], r["n"], r["largest"]) for r in got.collect()}  # a row per range

    load, finer = loads(cuts), 1
    while over := sorted(k for k, (b, n, largest) in load.items() if b > 2 * total / ranges and n > 1 and b > 2 * largest):
        heavy = keys.withColumn("range", _range_of(cuts)).filter(F.col("range").isin(over))
        share = sum(load[k][0] for k in over)
        parts = max(4 * len(over), -(-share * ranges // total))
        more = _cuts(heavy, F.col("size"), share / (parts * samples_per_range * finer), parts)
        if set(more) <= set(cuts):
            # nothing new was picked: a sample twice as dense ends with every key of these ranges
            finer *= 2
            continue
        cuts = sorted(set(cuts) | set(more))
        load = loads(cuts)
    ahead_b, ahead_n, b, n = [], [], 0, 0
    for k in range(len(cuts) + 1):
        ahead_b.append(b)
        ahead_n.append(n)
        b, n = b + load.get(k, (0, 0))[0], n + load.get(k, (0, 0))[1]
    placed = keys.withColumn("range", _range_of(cuts))
    inside = W.partitionBy("range").orderBy(*KEY)
    start = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") + F.get(long_array(ahead_b), F.col("range"))
    place = F.row_number().over(inside) - 1 + F.get(long_array(ahead_n), F.col("range"))
    # a row belongs where its middle byte falls
    middle = (start * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total))).cast("int").alias("shard"), place.alias("place"))
    placed = scratch.save(placed)
    first = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}  # one row a shard
    slot = F.col("place") - F.get(long_array([first.get(k, 0) for k in range(shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
