"""Embedding near-duplicates over a robust-pruned flat graph.

1. Vectors that can be compared (label not null, components finite, norm above zero) are normalised in double
   precision; equal vectors of a label form one class, named by its smallest vec_id, with a count of copies.
2. Labels above `shard_rows` classes are cut by centroids fitted on a bounded sample (`sample_rows`); centroids too
   near to part linked vectors share a shard. Every class goes to its nearest centroid's shard, its home, and to every
   shard that may be the home of a class in range (see reach()), however many these are, so both classes of a link meet
   in both homes. A label stays in one shard if its shards would cost more. Oversized shards are dealt into parts by
   hash, and every two parts meet in one task.
3. In each shard, near neighbours are pruned robustly (a neighbour is dropped if a kept one is nearer to it than
   the vertex by factor `alpha`); the lists of a vertex are united over its shards, the nearest `degree` staying, and
   edges count both ways.
4. Range-expanding greedy search on the united graph: from the shard's medoid a beam walks to each vertex's own
   neighbourhood, then the frontier of vertices in range expands until no neighbour in range is new.
   Every hit is verified by the double-precision cosine. A pair is decided in one task, that of the smaller home (and
   of its two parts), whichever end finds the other, and counts for both ends. `exact` compares all pairs of a
   task instead of searching: the yardstick of the search, and the way to take where the audit fails.
5. Recall is audited on up to `audit_rows` classes that have links, against brute force over all rows: found over true
   links to other classes, without a class and its copies. Such classes are looked for among samples of growing size, up
   to `sample_rows` classes; the audited recall is null if none is among them. Below `recall` the search is run again with
   a wider beam and longer lists, and an error says so if that does not help.

Vectors are stored and shuffled in their own type, once for each shard they are in to build the lists and once to search; only
lists of ids go between. A shard task returns counts and a spanning forest, never all pairs. Null, zero and non-finite vectors, null labels
and vectors of other lengths link with nothing. Repeated vec_ids are one vertex for components, and rows of their own
for counts. An empty table gives an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import components


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids by cosine; one centroid for ten vectors at most."""
    k = max(1, min(k, len(x) // 10 or 1))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def reach(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows x: the nearest of the centroids c, and which cells may hold a vector with cosine >= threshold.

    Let p have its home at f and q at c, so q(c - f) >= 0. The sine of the angle between p and the plane between the
    cells, p(f - c) / |f - c|, is then at most that of the angle between p and q.
    """
    s = x @ c.T
    first = s.argmax(1)
    gap = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0))
    return first, s[np.arange(len(x)), first][:, None] - s <= sine(threshold) * gap[first] + 1e-7


def sine(threshold: float) -> float:
    """Of the largest angle whose cosine is at least the threshold; 1 from a right angle on."""
    return float(np.sqrt(1 - min(threshold, 1.0) ** 2)) if threshold > 0 else 1.0


def leaders(c: np.ndarray, threshold: float) -> np.ndarray:
    """The shard of each centroid: those within twice the margin of an earlier one share its shard."""
    shard, heads = np.zeros(len(c), np.int64), []
    for j in range(len(c)):
        near = [k for k, h in enumerate(heads) if np.linalg.norm(c[j] - c[h]) <= 2 * sine(threshold)]
        shard[j] = near[0] if near else len(heads)
        heads += [] if near else [j]
    return shard


def members(x: np.ndarray, c: np.ndarray, shard: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home shard of each row of x, rows x shards: where it has to be)."""
    first, cells = reach(x, c, threshold)
    inside = np.zeros((len(x), shard.max() + 1), bool)
    for j, k in enumerate(shard.tolist()):
        inside[:, k] |= cells[:, j]
    return shard[first], inside


def work(sizes: np.ndarray, shard_rows: int) -> float:
    """Compared pairs of shards of these sizes; every two parts of a large shard meet, which doubles them."""
    sizes = np.asarray(sizes, float)
    return float((sizes**2 * np.where(sizes > 4 * shard_rows, 2, 1)).sum())


def robust_prune(x: np.ndarray, degree: int, pool: int, alpha: float, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """Adjacency lists of the unit vectors `rows` of x: from the `pool` nearest, at most `degree` that don't shadow each other."""
    n = len(x)
    rows = np.arange(n) if rows is None else rows
    pool = min(pool, n - 1)
    out: list[np.ndarray] = []
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        sims = x[part] @ x.T
        sims[np.arange(len(part)), part] = -np.inf
        if pool <= 0:
            out += [np.zeros(0, np.int64)] * len(part)
            continue
        near = np.argpartition(-sims, pool - 1, 1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, near, 1), 1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = 1 - np.take_along_axis(sims, near, 1)
        between = 1 - x[near] @ x[near].transpose(0, 2, 1)
        alive = np.ones(near.shape, bool)
        kept = np.zeros(near.shape, bool)
        count = np.zeros(len(part), int)
        for j in range(pool):
            take = alive[:, j] & (count < degree)
            kept[take, j] = True
            count += take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= dist))
        out += [near[q][kept[q]] for q in range(len(part))]
    return out


def greedy(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Beam search from the medoid for each query row of x: the `beam` nearest vertices found, best first."""
    n, degree = len(x), max((len(a) for a in lists), default=0)
    beam = min(beam, n)
    medoid = int((x @ x.mean(0)).argmax())
    if n <= beam or not degree:
        return np.tile(np.arange(n)[:beam], (len(queries), 1))
    table = np.full((n, degree), -1)
    for i, a in enumerate(lists):
        table[i, : len(a)] = a
    found = np.empty((len(queries), beam), np.int64)
    for at in range(0, len(queries), 512):
        q = x[queries[at : at + 512]]
        ids = np.full((len(q), beam), -1)
        sims = np.full((len(q), beam), -np.inf)
        open_ = np.zeros((len(q), beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = medoid, q @ x[medoid], True
        line = np.arange(len(q))
        for _ in range(n):
            best = np.where(open_, sims, -np.inf)
            j = best.argmax(1)
            live = best[line, j] > -np.inf
            if not live.any():
                break
            open_[line, j] = False
            nxt = np.where(live[:, None], table[np.maximum(ids[line, j], 0)], -1)
            fresh = (nxt >= 0) & ~(nxt[:, :, None] == ids[:, None, :]).any(2)
            got = np.where(fresh, np.einsum("qd,qrd->qr", q, x[np.maximum(nxt, 0)]), -np.inf)
            ids, sims, open_ = np.concatenate([ids, np.where(fresh, nxt, -1)], 1), np.concatenate([sims, got], 1), np.concatenate([open_, fresh], 1)
            top = np.argsort(-sims, 1, kind="stable")[:, :beam]
            ids, sims, open_ = (np.take_along_axis(a, top, 1) for a in (ids, sims, open_))
        found[at : at + 512] = ids
    return found


def reversed_lists(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each vertex, those that have it in their list; at most as many as the shard has rows."""
    head = np.repeat(np.arange(len(lists)), [len(a) for a in lists])
    tail = np.concatenate(lists).astype(np.int64) if lists else head
    order = np.argsort(tail, kind="stable")
    return np.split(head[order], np.searchsorted(tail[order], np.arange(1, len(lists)))) if lists else []


def range_search(x: np.ndarray, lists: list[np.ndarray], back: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
    """For each query row of x, the other rows with cosine >= threshold that the expanding search reaches.

    The greedy walk follows the bounded lists; the expansion follows edges both ways.
    """
    begin = greedy(x, lists, queries, beam)
    both = [np.concatenate(ab) for ab in zip(lists, back, strict=True)]
    seen = np.zeros(len(x), bool)
    out = []
    for q, ids in zip(queries.tolist(), begin, strict=True):
        near = np.unique(np.append(ids[ids >= 0], q))
        touched, hits = [near], []
        seen[near] = True
        while len(near):
            inside = near[(x[near] @ x[q] >= threshold) | (near == q)]
            hits.append(inside)
            if not len(inside):
                break
            near = np.concatenate([both[i] for i in inside])
            near = near[~seen[near]]
            seen[near] = True
            near = np.unique(near)
            touched.append(near)
        for t in touched:
            seen[t] = False
        found = np.sort(np.concatenate(hits))
        out.append(found[found != q])
    return out


def groups_of(pairs: np.ndarray) -> np.ndarray:
    """The smallest row each row reaches in a symmetric matrix of pairs."""
    roots = np.full(len(pairs), -1)
    for i in range(len(pairs)):
        front = np.array([i]) if roots[i] < 0 else np.zeros(0, np.int64)
        roots[front] = i
        while len(front):
            front = np.flatnonzero(pairs[front].any(0) & (roots < 0))
            roots[front] = i
    return roots


def _units(pdf: pd.DataFrame) -> np.ndarray:
    """Unit rows in double precision of columns v and norm."""
    return np.stack([np.asarray(v, np.float64) for v in pdf.v]) / pdf.norm.to_numpy()[:, None] if len(pdf) else np.zeros((0, 1))


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, shard_rows: int = 3000, sample_rows: int = 20_000, degree: int = 32, pool: int = 64, alpha: float = 1.2, beam: int = 16, audit_rows: int = 200, recall: float = 0.97, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall): one row per input row; see the module's text."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embed")
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.withColumn("norm", F.when(fine, norm)).withColumn("fine", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))
    rows = rows.withColumn("class", F.when(F.col("fine"), F.unhex(F.sha2(F.concat_ws(":", "label", F.size("v"), F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string")))), 256))))
    fit = rows.filter("fine")
    classes = fit.groupBy("class").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"), F.first("norm").alias("norm"))
    classes = scratch.save(classes.withColumn("label", F.concat_ws(":", "label", F.size("v"))))
    # labels that need centroids are those above shard_rows; their sample is bounded
    big = classes.groupBy("label").count().filter(f"count > {shard_rows}")
    sample = classes.join(big, "label", "left_semi").orderBy(F.xxhash64("node", F.lit(5))).limit(sample_rows).select("label", "v", "norm")
    named = F.broadcast(sample.select("label").distinct())  # at most sample_rows labels
    counted = {r["label"]: r["count"] for r in big.join(named, "label", "left_semi").collect()}
    centres = {}
    for name, part in sample.toPandas().groupby("label") if counted else ():
        if name in counted:
            x, n = _units(part), counted[name]
            c = kmeans(x, -(-n * 2 // shard_rows))
            shard = leaders(c, threshold)
            if work(members(x, c, shard, threshold)[1].mean(0) * n, shard_rows) < work([n], shard_rows):
                centres[name] = c, shard

    truth, size, n_classes = {}, audit_rows, classes.count()
    while audit_rows and n_classes:
        size = min(size, sample_rows, n_classes)
        truth = _true_links(classes, size, threshold)
        if len(truth) >= audit_rows or size == min(sample_rows, n_classes):
            break
        size *= 10
    truth = dict(list(truth.items())[:audit_rows])

    measured = None
    for attempt in range(3):
        wide = 2**attempt
        searched = _search(classes, centres, scratch, threshold, shard_rows, degree * wide, pool * wide, alpha, beam * wide, exact)
        links = searched.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
        if not truth:
            break
        wanted = F.col("node").isin([int(i) for i in truth])  # at most audit_rows ids
        got = {r["node"]: r["links"] for r in links.filter(wanted).collect()}
        measured = audited(truth, got)
        if measured >= recall:
            break
    if measured is not None and measured < 0.9:
        raise RuntimeError(f"audited recall {measured:.3f} is below 0.9")
    final = components(searched.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")), scratch)
    labelled = classes.select("class", "node", "copies").join(links, "node", "left").join(final, "node", "left")
    per = labelled.select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "class").join(per, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audited_recall", F.lit(measured).cast("double"))


def audited(truth: dict[int, int], got: dict[int, int]) -> float:
    """Found links over true links of the audited classes, both to other classes only."""
    return sum(min(got.get(i, 0), n) for i, n in truth.items()) / sum(truth.values())


def _true_links(classes: DataFrame, size: int, threshold: float) -> dict[int, int]:
    """Of the `size` classes of the smallest hash, those with links to other classes and their number, by brute force."""
    audit = classes.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(size).select("node", "label", "v", "norm").toPandas()
    questions = {name: (part.node.to_numpy(), _units(part)) for name, part in audit.groupby("label")}

    def brute(batches):
        total: dict[int, int] = {}
        for pdf in batches:
            for name, part in pdf.groupby("label"):
                if name in questions:
                    ids, q = questions[name]
                    hits = (q @ _units(part).T >= threshold) & (ids[:, None] != part.node.to_numpy())
                    counts = (hits * part.copies.to_numpy()).sum(1)
                    for i in np.flatnonzero(counts).tolist():
                        total[int(ids[i])] = total.get(int(ids[i]), 0) + int(counts[i])
        yield pd.DataFrame({"node": list(total), "n": list(total.values())}, dtype="int64")

    found = classes.select("node", "label", "v", "norm", "copies").mapInPandas(brute, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    true = {r["node"]: r["n"] for r in found.collect()}  # at most `size` rows
    return {i: true[i] for i in audit.node.tolist() if i in true}


def _search(classes: DataFrame, centres: dict, scratch: Scratch, threshold: float, shard_rows: int, degree: int, pool: int, alpha: float, beam: int, exact: bool = False) -> DataFrame:
    """(node, links, other): count rows (other null) and forest edges of every class."""

    def inside(pdf: pd.DataFrame):
        """(label, its rows, shard and home of each), a row once for each shard it is in."""
        for name, part in pdf.groupby("label"):
            if name not in centres:
                yield name, part, np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                continue
            home, held = members(_units(part), *centres[name], threshold)
            row, shard = np.nonzero(held)
            yield name, part.iloc[row], shard, home[row]

    def count(batches):
        for pdf in batches:
            total = [(name, int(k), int(n)) for name, _, shard, _ in inside(pdf) for k, n in zip(*np.unique(shard, return_counts=True), strict=True)]
            yield pd.DataFrame(total, columns=["label", "shard", "n"])

    # a shard beyond four times the aim is dealt into parts, and every two of them meet; these shards are few
    sizes = classes.select("label", "v", "norm").mapInPandas(count, "label string, shard long, n long").groupBy("label", "shard").agg(F.sum("n").alias("n")).filter(F.col("n") > 4 * shard_rows)
    split = {(r["label"], r["shard"]): -(-r["n"] // (2 * shard_rows)) for r in sizes.collect()}

    def deal(batches):
        for pdf in batches:
            out = [pdf.iloc[:0].assign(shard=0, home=0, part=0, low=0, high=0)]
            for name, rows, shard, home in inside(pdf):
                rows = rows.assign(shard=shard, home=home)
                for k, block in rows.groupby("shard"):
                    parts = split.get((name, k), 1)
                    own = (block.node.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                    for other in range(parts):
                        here = (own != other) | (parts == 1)
                        out.append(block[here].assign(part=own[here], low=np.minimum(own[here], other), high=np.maximum(own[here], other)))
            yield pd.concat(out)[columns]

    keys, kind = ["label", "shard", "low", "high"], classes.schema["v"].dataType.simpleString()
    columns, schema = [*keys, "home", "part", "node", "copies", "v", "norm"], f"label string, shard long, low long, high long, home long, part long, node long, copies long, v {kind}, norm double"
    wanted = classes.select("label", "node", "copies", "v", "norm")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _units(pdf), pdf.node.to_numpy()
        lists = robust_prune(x, degree, pool, alpha)
        return pd.DataFrame({"node": ids, "far": [(1 - x[a] @ x[i]).astype(np.float32) for i, a in enumerate(lists)], "near": [ids[a] for a in lists]})

    if not exact:
        lists = wanted.mapInPandas(deal, schema).groupBy(*keys).applyInPandas(build, "node long, far array<float>, near array<long>")
        nearest = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "near"))))  # a vertex's lists, as many as its shards
        united = lists.groupBy("node").agg(F.slice(F.array_distinct(F.transform(nearest, lambda e: e["near"])), 1, degree).alias("near"))
        wanted, columns, schema = wanted.join(scratch.save(united), "node"), [*columns, "near"], f"{schema}, near array<long>"
    joined = wanted.mapInPandas(deal, schema)

    def found(pdf: pd.DataFrame, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Pairs of rows in range, both ways; at least one of each pair is a query."""
        x = _units(pdf)
        pairs = np.zeros((len(ids), len(ids)), bool)  # a task holds at most 4 * shard_rows rows
        if exact:
            for at in range(0, len(queries), 512):
                pairs[queries[at : at + 512]] = x[queries[at : at + 512]] @ x.T >= threshold
        else:
            at = {v: i for i, v in enumerate(ids.tolist())}
            lists = [np.array([at[j] for j in near if j in at], np.int64) for near in pdf.near]
            for q, hits in zip(queries.tolist(), range_search(x, lists, reversed_lists(lists), queries, threshold, beam), strict=True):
                pairs[q, hits] = True
        pairs |= pairs.T
        np.fill_diagonal(pairs, False)
        return pairs

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, home, own, copies = (pdf[c].to_numpy() for c in ("node", "home", "part", "copies"))
        shard, low, high = pdf["shard"].iloc[0], pdf.low.iloc[0], pdf.high.iloc[0]
        pairs = found(pdf, ids, np.flatnonzero(home == shard))
        roots = groups_of(pairs)
        # a pair counts in the smaller of its homes, and one inside a part in one of the part's tasks
        once = np.array([low == high or (p == high and low == high - 1) or (p == low == 0 and high == 1) for p in own])
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), 512):
            b = slice(at, at + 512)
            links[b] = (pairs[b] & (np.minimum(home[b, None], home) == shard) & ((own[b, None] != own) | once[b, None])) @ copies
        linked, joined = np.flatnonzero(links), np.flatnonzero(roots != np.arange(len(ids)))
        other = pd.array([None] * len(linked) + ids[roots[joined]].tolist(), "Int64")
        return pd.DataFrame({"node": np.concatenate([ids[linked], ids[joined]]), "links": np.concatenate([links[linked], np.zeros(len(joined), np.int64)]), "other": other})

    return scratch.save(joined.groupBy(*keys).applyInPandas(search, "node long, links long, other long"))
