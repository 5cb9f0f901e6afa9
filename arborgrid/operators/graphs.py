"""Connected components, spanning forests and path-cost forests as bounded fixpoints of joins.

Rounds are written to the shared folder (plans.Scratch), which cuts the lineage; each loop ends
when a round changes nothing. Null ids are left out. Weights that tie are ordered by their ends,
so every result is unique. Edge tables of at most ``small`` rows (counted first) are solved in one
task instead, with the same result: rounds of joins cost more there than the work itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborgrid.plans import Scratch

#: Edges that one task solves.
SMALL = 1_000_000


def pixel_id(image: str, x: str, y: str) -> Column:
    """One number for a pixel: image (23 bits), row, column in 20 bits each; other numbers raise."""
    i, x, y = (F.col(c).cast("long") for c in (image, x, y))
    fits = x.between(0, 2**20 - 1) & y.between(0, 2**20 - 1) & i.between(0, 2**23 - 1)
    return F.when(~fits, F.raise_error(F.lit("image, row or column is too large for a pixel's number")).cast("long")).otherwise(F.shiftleft(i, 40) + F.shiftleft(y, 20) + x)


def smallest_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (a, b) and the smallest vertex of each one's component."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(ids))
    while True:
        ru, rv = up[u], up[v]
        apart = ru != rv
        if not apart.any():
            return ids, ids[up]
        np.minimum.at(up, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while True:
            top = up[up]
            if (top == up).all():
                break
            up = top


def _in_one_task(edges: DataFrame, solve, schema: str) -> DataFrame:
    return edges.coalesce(1).withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: solve(pdf), schema)


def connected_components(edges: DataFrame, scratch: Scratch, small: int | None = None) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b); root is the component's smallest id.

    Alternating large and small stars: each vertex ties its larger neighbours to the smallest id it
    sees, then its smaller ones; stars remain after O(log n) rounds, and no vertex gathers a list.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    loops = now.where("a = b").select("a").distinct()
    now = scratch.put(now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        """Changes with the edges: their number and the sums of two hashes of them."""
        return tuple(df.agg(F.count(F.lit(1)), *[F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "a", "b"), 20)) for i in (1, 2)]).first())

    if now.count() <= (SMALL if small is None else small):

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, roots = smallest_members(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            return pd.DataFrame({"id": ids, "root": roots})

        found = scratch.put(_in_one_task(now, solve, "id long, root long"))
        return found.unionByName(loops.select(F.col("a").alias("id"), F.col("a").alias("root")).join(found.select("id"), "id", "left_anti"))
    last = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.put(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_stars = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        small_stars = scratch.put(small_stars.distinct())
        is_now = state(small_stars)
        scratch.drop(now, large)
        now = small_stars
        if is_now == last:
            break
        last = is_now
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return stars.unionByName(roots).unionByName(loops.select(F.col("a").alias("id"), F.col("a").alias("root")).join(stars.unionByName(roots).select("id"), "id", "left_anti"))


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of the minimum spanning forest, in one task."""
    pdf = pdf.sort_values(["w", "a", "b"], kind="stable")
    ids, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    up, kept = list(range(len(ids))), np.zeros(len(pdf), dtype=bool)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (a, b) in enumerate(zip(ends[: len(pdf)].tolist(), ends[len(pdf) :].tolist())):
        a, b = find(a), find(b)
        if a != b:
            up[a] = b
            kept[i] = True
    return pdf[kept][["a", "b", "w"]]


def minimum_spanning_forest(edges: DataFrame, scratch: Scratch, small: int | None = None) -> DataFrame:
    """Edges (a, b, w) of the minimum spanning forest by Boruvka rounds; ties by (a, b), a < b."""
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    now = scratch.put(now.groupBy("a", "b").agg(F.min("w").alias("w")))
    if now.count() <= (SMALL if small is None else small):
        return scratch.put(_in_one_task(now, _kruskal, now.select("a", "b", "w").schema.simpleString().removeprefix("struct<").removesuffix(">")))
    now = scratch.put(now.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")))
    chosen: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = scratch.put(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("to"), "m.e"))
        chosen.append(best.select("e.a", "e.b", "e.w").distinct())
        # weights are unique, so chosen arcs form trees with one mutual pair each: its smaller end is the root
        back = best.select(F.col("u").alias("to"), F.col("to").alias("back"))
        pred = best.join(back, "to").select(F.col("u").alias("id"), F.when((F.col("back") != F.col("u")) | (F.col("u") > F.col("to")), F.col("to")).alias("pred"))
        roots = scratch.put(forest_descendants(pred, scratch).select("id", "root"))
        ru, rv = roots.select(F.col("id").alias("u"), F.col("root").alias("ru")), roots.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        left = now.join(ru, "u").join(rv, "v").where("ru <> rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e"))
        nxt = scratch.put(left)
        scratch.drop(now)
        now = nxt
    if not chosen:
        return edges.sparkSession.createDataFrame([], "a long, b long, w double")
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out.distinct()


def fmax(cost: Column, weight: Column) -> Column:
    """Path cost: the largest arc on the path."""
    return F.greatest(cost, weight)


def fsum(cost: Column, weight: Column) -> Column:
    """Path cost: the sum of the arcs."""
    return cost + weight


#: The path costs that are known as functions of numbers too.
ADD = {fmax: max, fsum: lambda c, w: c + w}


def _grow_small(adj: pd.DataFrame, seeds: pd.DataFrame, add: Callable[[float, float], float]) -> pd.DataFrame:
    """(id, cost, label, root) by a queue ordered by (cost, label, root); ``adj`` has a, b, w both ways."""
    ids, ends = np.unique(np.concatenate([adj["a"].to_numpy(), adj["b"].to_numpy(), seeds["id"].to_numpy()]), return_inverse=True)
    m = len(adj)
    order = np.argsort(ends[:m], kind="stable")
    first = np.searchsorted(ends[:m][order], np.arange(len(ids) + 1)).tolist()
    to, w = ends[m : 2 * m][order].tolist(), adj["w"].to_numpy()[order].tolist()
    heap = [(c, lab, i, int(p)) for c, lab, i, p in zip(seeds["cost"], seeds["label"], seeds["id"], ends[2 * m :])]
    heapq.heapify(heap)
    best: dict[int, tuple] = {}
    while heap:
        c, lab, root, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = (c, lab, root)
        for e in range(first[p], first[p + 1]):
            if to[e] not in best:
                heapq.heappush(heap, (add(c, w[e]), lab, root, to[e]))
    return pd.DataFrame([(ids[p], *v) for p, v in best.items()], columns=["id", "cost", "label", "root"])


def path_forest(edges: DataFrame, seeds: DataFrame, scratch: Scratch, cost: Callable[[Column, Column], Column] = fmax, max_rounds: int = 1_000_000, small: int | None = None) -> DataFrame:
    """(id, cost, label, root) of every vertex that a seed reaches, by relaxation of arcs.

    ``edges`` (a, b, w) are undirected, ``seeds`` (id, label, cost). A vertex takes the least
    (cost, label, root), so ties between equal costs have one defined winner whatever the order
    of the work; only where equal costs of several labels meet on longer ways may one task and rounds
    of joins name different ones. Only vertices that changed send offers in the next round. More than ``max_rounds``
    rounds raise RuntimeError.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    arcs = scratch.put(both.where("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL").groupBy("a", "b").agg(F.min("w").alias("w")))
    label = seeds.schema["label"].dataType.simpleString()
    if cost in ADD and arcs.count() <= 2 * (SMALL if small is None else small) and seeds.count() <= (SMALL if small is None else small):
        add = ADD[cost]
        ends = seeds.select(F.col("id").cast("long").alias("id"), F.col("cost").cast("double").alias("cost"), "label").where("id IS NOT NULL")

        def solve(key, adj: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            return _grow_small(adj, at, add)

        met = arcs.coalesce(1).withColumn("_g", F.lit(0)).groupBy("_g").cogroup(ends.coalesce(1).withColumn("_g", F.lit(0)).groupBy("_g"))
        return scratch.put(met.applyInPandas(solve, f"id long, cost double, label {label}, root long"))
    start = seeds.groupBy("id").agg(F.min(F.struct(F.col("cost").cast("double").alias("cost"), "label", F.col("id").alias("root"))).alias("s"))
    state = scratch.put(start.withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        offers = state.where("moved").select(F.col("id").alias("a"), "s").join(arcs, "a")
        offers = offers.select(F.col("b").alias("id"), F.struct(cost(F.col("s.cost"), F.col("w")).cast("double").alias("cost"), F.col("s.label").alias("label"), F.col("s.root").alias("root")).alias("s"))
        merged = state.select("id", "s", F.col("s").alias("old")).unionByName(offers.groupBy("id").agg(F.min("s").alias("s")), allowMissingColumns=True)
        nxt = merged.groupBy("id").agg(F.min("s").alias("s"), F.first("old", True).alias("old"))
        nxt = scratch.put(nxt.select("id", "s", (F.col("old").isNull() | (F.col("s") < F.col("old"))).alias("moved")))
        scratch.drop(state)
        state = nxt
        if state.where("moved").isEmpty():
            return state.select("id", "s.cost", "s.label", "s.root")
    raise RuntimeError(f"costs still fall after {max_rounds} rounds")


def grid_components(pixels: DataFrame, scratch: Scratch, tile: int = 256) -> DataFrame:
    """(image_id, x, y, id, root) of each pixel of the table (those of the mask): root is the smallest
    pixel id of its 4-connected component.

    Components are found within tiles first, a tile a task; only pairs of pixels that touch across a
    border between tiles become edges.
    """
    tx, ty = F.floor(F.col("x") / tile).cast("int"), F.floor(F.col("y") / tile).cast("int")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = (pdf[c].to_numpy() for c in ("x", "y", "id"))
        at = np.full((y.max() - y.min() + 2, x.max() - x.min() + 2), -1, dtype=np.int64)
        at[y - y.min(), x - x.min()] = np.arange(len(ids))
        pairs = np.concatenate([np.stack([at[:-1].ravel(), at[1:].ravel()]), np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()])], 1)
        pairs = pairs[:, (pairs >= 0).all(0)]
        order = np.argsort(ids, kind="stable")  # so that the smallest number is the smallest id
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        root = np.arange(len(ids))
        if pairs.shape[1]:
            some, top = smallest_members(place[pairs[0]], place[pairs[1]])
            root[some] = top
        return pdf.assign(root=ids[order][root[place]])

    rows = pixels.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), pixel_id("image_id", "x", "y").alias("id")).distinct()
    local = rows.withColumn("_tx", tx).withColumn("_ty", ty).groupBy("image_id", "_tx", "_ty")
    local = scratch.put(local.applyInPandas(lambda pdf: label(pdf)[["image_id", "x", "y", "id", "root"]], "image_id long, x int, y int, id long, root long"))
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    side = local.where(edge)
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))]))
    sent = side.select("image_id", "x", "y", F.col("root").alias("a"), steps.alias("s")).select("image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "a")
    met = sent.join(side.select("image_id", "x", "y", F.col("root").alias("b")), ["image_id", "x", "y"]).where("a <> b").select("a", "b").distinct()
    tops = connected_components(met, scratch).select(F.col("id").alias("root"), F.col("root").alias("_top"))
    return local.join(tops, "root", "left").select("image_id", "x", "y", "id", F.coalesce("_top", "root").alias("root"))


def forest_descendants(pred: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root, depth) along a predecessor map (id, pred; roots have null), by pointer jumping."""
    now = scratch.put(pred.select("id", F.coalesce("pred", "id").alias("up"), F.when(F.col("pred").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        nxt = scratch.put(now.join(above, "up").select("id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("top") != F.col("up")).alias("moved")))
        done = nxt.where("moved").isEmpty()
        scratch.drop(now)
        now = nxt
        if done:
            return now.select("id", F.col("up").alias("root"), "depth")


def leaves_and_roots(pred: DataFrame) -> DataFrame:
    """(id, is_root, is_leaf): no predecessor; nobody's predecessor."""
    used = pred.where("pred IS NOT NULL").select(F.col("pred").alias("id")).distinct().withColumn("_used", F.lit(True))
    return pred.join(used, "id", "left").select("id", F.col("pred").isNull().alias("is_root"), F.col("_used").isNull().alias("is_leaf"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Directed edges (a, b) without their reverse."""
    return edges.select("a", "b").join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
