"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its shingle-set size, a 128-bit digest of the set and band keys of
   its MinHash signature. Documents with equal sets form a class; the class is named by its smallest doc_id.
2. Band rows carry a sketch (one byte of SKETCH signature slots). Within a bucket the first batch of the Bayesian test
   runs on sketches: members whose posterior chance of being similar is above `miss` are joined, as a spanning forest of
   the bucket. Connected components of the forests are blocks: no surviving candidate pair crosses two blocks, and
   documents that merely share a passage seldom survive, so blocks stay near the size of true groups.
3. Only texts of classes in blocks of two or more are read again; set and signature go once to the block's task.
   There the banded candidates are compared in batches of signature slots. After each batch the posterior
   chance (uniform prior) that the similarity reaches the threshold is bounded; pairs below `miss` are pruned,
   survivors are verified on the full sets in integers. Pairs already connected need no test, so a bucket costs
   about its size once its members have met. A task returns a spanning forest, never all pairs.
4. Large groups. A bucket above `bucket_rows` is joined whole, without the sketches, by edges to one member: a larger
   block than need be, nothing lost, and no task holds the bucket. A block above `block_rows` is dealt into parts by
   hash; each part is linked together with the block's hubs, the members most typical of the groups found in a first
   part, which connects a family of any size at about its size. What then lies outside a block's largest component meets
   all of the block, in chunks of which every two meet: no candidate is dropped, memory stays bounded, and the cost beyond
   the block's size is that of its outsiders.
5. Components of those forests are the result.

Defined cases. Null, empty and blank texts have no shingles, link with nothing and are kept. Fewer words than the
shingle size give the whole sequence as one shingle. Equal doc_ids are one vertex, so rows that share one are in
one component. An empty table gives an empty result. Other columns are never read, whatever their names.
distinct_documents() takes rows, not ids, for vertices: rows that share an id are told apart.

Missed pairs: a pair at similarity 0.85 shares no band with chance (1 - 0.85**6)**21 = 5e-5, and is pruned with
chance `miss` a batch at most (the sketch's bytes agree by chance in 1 of 256 slots, which only keeps more pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekernel as bk
from .common import Scratch, free_name, join_each, small_batches
from .components import components

BANDS, ROWS = 21, 6
#: Hubs of a large block, and how many of them a group found in the first part gives at most.
HUBS, HUBS_OF_GROUP = 48, 16
SLOTS = 128
BATCH = 16
SKETCH = 32
_rng = np.random.default_rng(77)
_XOR = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """SLOTS minima (upper halves) of a non-empty set of hashes."""
    best = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        x = (s[at : at + 2048, None] ^ _XOR) * _MUL
        np.minimum(best, (x ^ (x >> np.uint64(29))).min(0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return bk.mix((part * bk.MULTIPLIERS[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketch(sig: np.ndarray) -> bytes:
    return (sig[:: SLOTS // SKETCH] & 0xFF).astype(np.uint8).tobytes()


@lru_cache(maxsize=None)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For 16, 32, ... compared slots: the fewest matches at which P(similarity >= threshold | matches) > miss."""
    out = []
    for n in range(BATCH, SLOTS + 1, BATCH):
        for m in range(n + 1):
            # Beta(m + 1, n - m + 1) above the threshold, as a binomial sum
            if sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) > miss:
                break
        out.append(m)
    return tuple(out)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        sizes, h1, h2, bands, sketches = [], [], [], [], []
        for _, _, data, off in bk.steps(texts):
            for s in bk.shingle_sets(data, off):
                sizes.append(len(s))
                t = bk.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                h1.append(int((s.sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64)))
                h2.append(int(t.sum(dtype=np.uint64).view(np.int64)))
                sig = signature(s) if len(s) else None
                bands.append(None if sig is None else band_keys(sig).view(np.int64))
                sketches.append(None if sig is None else sketch(sig))
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, size, text) -> (node, block, size, shingles, sig)."""
    for b in batches:
        sets, sigs = [], []
        for _, _, data, off in bk.steps(b.column(3)):
            for s in bk.shingle_sets(data, off):
                sets.append(s.tobytes())
                sigs.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["node", "block", "size", "shingles", "sig"])


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self, ids: np.ndarray) -> np.ndarray:
        return np.fromiter((self.root(i) for i in ids), np.int64, len(ids))

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bucket_forest(nodes: np.ndarray, sketches: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Spanning forest of a bucket's pairs with at least `need` equal sketch bytes.

    Members go to the first hub they resemble; then those outside the largest group are compared with all others, so no
    pair is missed, and a bucket of one group costs about its size.
    """
    nodes, at = np.unique(nodes, return_index=True)
    sketches = sketches[at]
    edges: list[tuple[int, int]] = []
    forest, rest = Forest(len(nodes)), np.arange(len(nodes))
    group = np.zeros(len(nodes), np.int64)
    while len(rest):
        near = (sketches[rest] == sketches[rest[0]]).sum(1) >= need
        near[0] = True
        group[rest[near]] = rest[0]
        for j in rest[near][1:].tolist():
            forest.union(int(rest[0]), j)
            edges.append((int(rest[0]), j))
        rest = rest[~near]
    names, counts = np.unique(group, return_counts=True)
    for a in np.flatnonzero(group != names[counts.argmax()]).tolist() if len(names) > 1 else ():
        for j in np.flatnonzero((sketches == sketches[a]).sum(1) >= need).tolist():
            if forest.root(a) != forest.root(j):
                forest.union(a, j)
                edges.append((a, j))
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def _bucket_edges(need: int, bucket_rows: int = 10_000):
    """Forests of all buckets of a partition that is sorted by band; a bucket above bucket_rows becomes a star, in passing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, hub = None, [], 0, None  # the open bucket: its pieces, or its hub once it is too large

        def batch(u, v) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64))], names=["u", "v"])

        def close() -> list[tuple[int, int]]:
            return bucket_forest(*(np.concatenate(x) for x in zip(*held, strict=True)), need) if hub is None and size > 1 else []

        for b in batches:
            band, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            flat = np.frombuffer(b"".join(b.column(2).cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, SKETCH)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(band)) + 1, [len(band)]]).tolist()
            edges: list[tuple[int, int]] = []
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if band[at] != key:
                    edges += close()
                    key, held, size, hub = band[at], [], 0, None
                size += end - at
                if hub is None:
                    held.append((node[at:end], flat[at:end]))
                    if size <= bucket_rows:
                        continue
                    hub, members = held[0][0][0], np.concatenate([x for x, _ in held])
                    held = []
                else:
                    members = node[at:end]
                members = members[members != hub]
                yield batch(members, np.full(len(members), hub))
            if edges:
                yield batch(*zip(*edges, strict=True))
        if edges := close():
            yield batch(*zip(*edges, strict=True))

    return run


def _candidate_edges(classes: DataFrame, need: int, bucket_rows: int) -> DataFrame:
    """(u, v) edges that connect all candidates that survive the sketches."""
    keyed = classes.select(F.explode("bands").alias("band"), "node", "sketch")
    total = classes.count()
    counts = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
    # every class has BANDS keys: of buckets with over a hundredth of the classes there are at most 100 * BANDS
    hot = F.broadcast(counts.filter((F.col("n") > bucket_rows) & (F.col("n") * 100 > total)).select("band", "hub"))
    star = keyed.join(hot, "band").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    cold = keyed.join(hot.select("band"), "band", "left_anti").repartition("band").sortWithinPartitions("band")
    return star.unionByName(cold.mapInArrow(_bucket_edges(need, bucket_rows), "u long, v long"))


def link_block(nodes: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, percent: int, miss: float, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among one block's members, as pairs of nodes, or of groups if known already."""
    groups = nodes if groups is None else groups
    need = least_matches(percent / 100, miss)
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    # one vertex for equal node ids, and for what is connected already
    first: dict[int, int] = {}
    for i, v in enumerate(groups.tolist()):
        forest.union(first.setdefault(v, i), i)
    failed: set[int] = set()

    def test(a: int, others: np.ndarray) -> None:
        """Compare member a with others: prune by batches, verify the rest, unite the linked."""
        low, high = np.minimum(sizes[a], sizes[others]), np.maximum(sizes[a], sizes[others])
        others = others[100 * low >= percent * high]
        matches = np.zeros(len(others), np.int64)
        for k, least in enumerate(need):
            if not len(others):
                return
            at = slice(k * BATCH, (k + 1) * BATCH)
            matches += (sigs[others, at] == sigs[a, at]).sum(1)
            keep = matches >= least
            others, matches = others[keep], matches[keep]
        order = np.argsort(-matches, kind="stable")
        for b in others[order].tolist():
            if forest.root(a) == forest.root(b):
                continue
            key = min(a, b) * len(sets) + max(a, b)
            if key in failed:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                forest.union(a, b)
            else:
                failed.add(key)

    keys = np.stack([band_keys(s) for s in sigs]) if len(sigs) else np.zeros((0, BANDS), np.uint64)
    for band in range(BANDS):
        order = np.argsort(keys[:, band], kind="stable")
        cut = np.flatnonzero(np.diff(keys[order, band])) + 1
        for bucket in np.split(order, cut):
            if len(bucket) < 2:
                continue
            roots = forest.roots(bucket)
            if (roots == roots[0]).all():
                continue
            # the likeliest hub first: the member that agrees most with the bucket's usual slots
            usual = np.array([np.bincount(np.unique(c, return_inverse=True)[1]).argmax() for c in sigs[bucket, :BATCH].T])
            codes = np.stack([np.unique(c, return_inverse=True)[1] for c in sigs[bucket, :BATCH].T], 1)
            hub = bucket[(codes == usual).sum(1).argmax()]
            test(hub, bucket[roots != forest.root(hub)])
            roots = forest.roots(bucket)
            names, counts = np.unique(roots, return_counts=True)
            if len(names) == 1:
                continue
            # all pairs that are not yet connected, from the smaller components' side
            for a in bucket[roots != names[counts.argmax()]].tolist():
                roots = forest.roots(bucket)
                test(a, bucket[roots != forest.root(a)])
    out = set()
    for i in range(len(sets)):
        r = forest.root(i)
        if groups[r] != groups[i]:
            out.add((int(groups[i]), int(groups[r])))
    return sorted(out)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    return pdf.node.to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf.shingles], np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(-1, SLOTS)


def hubs_of(nodes: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Positions of the members most typical of the linked groups, the largest groups first, at most HUBS."""
    at = {v: i for i, v in enumerate(nodes.tolist())}
    forest = Forest(len(nodes))
    for u, v in link_block(nodes, sets, sigs, percent, miss):
        forest.union(at[u], at[v])
    roots = forest.roots(np.arange(len(nodes)))
    names, counts = np.unique(roots, return_counts=True)
    out: list[int] = []
    for name in names[np.argsort(-counts, kind="stable")][: HUBS // 2].tolist():
        group = np.flatnonzero(roots == name)
        agree = np.zeros(len(group), np.int64)
        for column in sigs[group].T:
            values, inverse, n = np.unique(column, return_inverse=True, return_counts=True)
            agree += inverse == n.argmax()
        out += group[np.argsort(-agree, kind="stable")[:HUBS_OF_GROUP]].tolist()
        if len(out) >= HUBS:
            break
    return np.array(out[:HUBS], np.int64)


def _deal(count: Column, most: float) -> tuple[Column, Column]:
    """(number of parts for `count` rows, a row's part by its node)."""
    parts = F.ceil(count / F.lit(most)).cast("int")
    return parts, F.pmod(F.xxhash64("node", F.lit("part")), parts).cast("int")


def _numbers(parts: Column) -> Column:
    return F.sequence(F.lit(0), parts - 1)


def _linked(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """(u, v): forests of rows(block, low, high, node, shingles, sig, comp) by (block, low, high); comp: connected already."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "shingles"]).sort_values("node", kind="stable")
        found = link_block(*_arrays(pdf), percent, miss, pdf.comp.to_numpy())
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return rows.groupBy("block", "low", "high").applyInPandas(work, "u long, v long")


def _block_forests(sets: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int, miss: float, block_rows: int) -> DataFrame:
    """(u, v) forests of the links in all blocks; sets(node, block, size, shingles, sig), sizes(block, size)."""
    parts, part = _deal(F.col("size"), block_rows)
    cells = sets.select("block", part.alias("low"), part.alias("high"), "node", "shingles", "sig", F.col("node").alias("comp"))
    large = sizes.filter(F.col("size") > block_rows)
    if large.isEmpty():
        return scratch.save(_linked(cells, percent, miss))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", kind="stable")
        return pdf.iloc[hubs_of(*_arrays(pdf), percent, miss)][["block", "node", "shingles", "sig"]]

    sample = sets.filter((F.col("size") > block_rows) & (part == 0)).select("block", "node", "shingles", "sig")
    hubs = sample.groupBy("block").applyInPandas(choose, "block long, node long, shingles binary, sig binary")
    hubs = scratch.save(hubs.join(large, "block"))
    spread = hubs.withColumn("low", F.explode(_numbers(parts))).select("block", "low", F.col("low").alias("high"), "node", "shingles", "sig", F.col("node").alias("comp"))
    first = scratch.save(_linked(cells.unionByName(spread), percent, miss))

    # members of large blocks with their component so far; outsiders are those beyond a block's largest component
    total = large.agg(F.sum("size")).first()[0]
    known = components(first, scratch)
    rows = sets.filter(F.col("size") > block_rows).join(known, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    rows = scratch.save(rows.select("block", "node", "shingles", "sig", "comp"))
    groups = rows.groupBy("block", "comp").agg(F.count("*").alias("n"))
    main = groups.groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"))
    main = scratch.save(main.select("block", "main", (F.col("size") - F.col("most")).alias("outside"), F.col("most"), F.col("size").alias("n")))
    rows = join_each(rows, main, ["block"], "n", total).filter("outside > 0")
    beyond, within = F.col("comp") != F.col("main"), F.col("comp") == F.col("main")
    o_parts, o_part = _deal(F.col("outside"), block_rows / 2)
    m_parts, m_part = _deal(F.col("most"), block_rows / 2)
    columns = ("block", "low", "high", "node", "shingles", "sig", "comp")
    # every two chunks of outsiders meet (low, high >= 0), and every chunk of outsiders meets every other chunk (high < 0)
    out = rows.filter(beyond).withColumn("part", o_part)
    mates = F.when(o_parts == 1, F.array(F.lit(0))).otherwise(F.filter(_numbers(o_parts), lambda k: k != F.col("part")))
    pairs = out.withColumn("other", F.explode(mates)).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    cross = out.withColumn("low", F.col("part")).withColumn("mate", F.explode(_numbers(m_parts))).withColumn("high", -1 - F.col("mate"))
    inner = rows.filter(within).withColumn("high", -1 - m_part).withColumn("low", F.explode(_numbers(o_parts)))
    dealt = pairs.select(*columns).unionByName(cross.select(*columns)).unionByName(inner.select(*columns))
    return first.unionByName(scratch.save(_linked(dealt, percent, miss)))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6, block_rows: int = 1500, bucket_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept): one row per input row; see the module's text.

    Documents with 100 * intersection >= percent * union of their 5-word shingle sets are linked.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.save(src.mapInArrow(_features, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"))

    some = feats.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = scratch.save(classes)
    need = least_matches(percent / 100, miss)[SKETCH // BATCH - 1]
    blocks = scratch.save(components(_candidate_edges(classes, need, bucket_rows), scratch).select("node", F.col("component").alias("block")))
    sizes = scratch.save(blocks.groupBy("block").agg(F.count("*").alias("size")))
    n_blocked = sizes.agg(F.sum("size")).first()[0] or 0
    # only class heads carry sets; equal texts of other rows add nothing
    heads = join_each(blocks, sizes.withColumn("n", F.col("size")), ["block"], "n", n_blocked).withColumnRenamed("node", "doc_id")
    # a sort-merge join at every size: whether the heads would fit a broadcast must not decide the plan
    sets = src.hint("merge").join(heads, "doc_id").select(F.col("doc_id").alias("node"), "block", "size", "text")
    sets = scratch.save(sets.mapInArrow(_sets, "node long, block long, size long, shingles binary, sig binary").filter("length(shingles) > 0"))
    final = components(_block_forests(sets, sizes, scratch, percent, miss, block_rows), scratch)

    classed = classes.select("h1", "h2", "node", "copies").join(final, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"), "copies")
    classed = scratch.save(classed)
    n_rows = classed.agg(F.sum("copies")).first()[0] or 0
    out = join_each(some.select("doc_id", "n_shingles", "h1", "h2"), classed, ["h1", "h2"], "copies", n_rows).select("doc_id", "n_shingles", "component_id")
    rest = feats.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for each group of near-duplicates only that of the smallest id.

    Rows are compared as they stand: rows that share an id but not a text stay, repeated rows are copies of each other,
    and of rows with the same id the one read first stays; a null id comes last. Texts without words are no copies.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    row, one = free_name("row_number", docs), free_name("component", docs)
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows, percent, id_col=row, text_col=text_col).select(F.col("doc_id").alias(row), F.col("component_id").alias(one))
    named = scratch.save(rows.select(row, F.col(id_col).cast("long").alias("id")).join(found, row))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", row))
    groups = named.groupBy(one).agg(first.alias("kept"), F.count("*").alias("n")).filter("n > 1")
    groups = scratch.save(groups.select(one, F.col(f"kept.{row}").alias("kept"), "n"))
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    copies = join_each(named.select(row, one), groups, [one], "n", n_rows).filter(F.col(row) != F.col("kept")).select(row)
    return rows.join(copies, row, "left_anti").drop(row)
