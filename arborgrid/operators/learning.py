"""Clustering and classification of sample tables (id, vector, label).

Centres, prototypes and parameters are small and travel in the plan as literals or broadcasts of
bounded size (k vectors); samples are read once a round and aggregated before any shuffle.
Rounds are bounded and stop when nothing moves. Equal distances go to the smaller centre or id.

Defined cases: null vectors take no part; an empty cluster keeps its centre; fewer samples than k
give as many clusters as samples.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborgrid.functions import distance
from arborgrid.operators import graphs, neighbours
from arborgrid.plans import Scratch

#: The most centres, and numbers in them, that travel with a plan.
MAX_CENTRES = 4096


def _centre_array(centres: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])


def first_samples(df: DataFrame, id_col: str, vec_col: str, k: int) -> list[list[float]]:
    """Vectors of the k smallest ids (k rows)."""
    rows = df.where(F.col(vec_col).isNotNull()).orderBy(id_col).limit(k).select(F.col(vec_col).cast("array<double>").alias("v")).collect()
    return [list(r["v"]) for r in rows]


def assign(df: DataFrame, vec_col: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with cluster (from 1) and dist (squared Euclidean) of the nearest centre.

    Distances run in numpy on Arrow batches: |batch| x k at a time.
    """
    if not centres:
        raise ValueError("no centres")
    if len(centres) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    c = np.asarray(centres, dtype=float)

    @F.pandas_udf("struct<cluster:int,dist:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float)
        d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
        i = d.argmin(1)
        return pd.DataFrame({"cluster": (i + 1).astype("int32"), "dist": d[np.arange(len(x)), i]})

    rows = df.where(F.col(vec_col).isNotNull()).withColumn("_n", nearest(F.col(vec_col).cast("array<double>")))
    return rows.withColumn("cluster", F.col("_n.cluster")).withColumn("dist", F.col("_n.dist")).drop("_n")


def _means(df: DataFrame, vec_col: str, centres: Sequence[Sequence[float]]) -> dict[int, list[float]]:
    """Mean vector of each centre's nearest samples. Batches are summed where they are read; at most
    k x dim numbers reach the driver."""
    c = np.asarray(centres, dtype=float)

    def sums(batches):
        n, s = np.zeros(len(c)), np.zeros_like(c)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                lab = np.stack([((x - row) ** 2).sum(1) for row in c], 1).argmin(1)
                n += np.bincount(lab, minlength=len(c))
                np.add.at(s, lab, x)
        some = np.flatnonzero(n)
        if len(some):  # a partition without samples has no list that Arrow could convert
            yield pd.DataFrame({"cluster": some.astype("int32") + 1, "n": n[some], "s": list(s[some])})

    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
    parts = rows.mapInPandas(sums, "cluster int, n double, s array<double>").select("cluster", "n", F.posexplode("s").alias("p", "v"))
    out: dict[int, list[float]] = {}
    for r in parts.groupBy("cluster", "p").agg((F.sum("v") / F.sum("n")).alias("m")).collect():
        out.setdefault(r["cluster"], [0.0] * c.shape[1])[r["p"]] = r["m"]
    return out


def kmeans(df: DataFrame, id_col: str, vec_col: str, k: int, max_iter: int = 100, tol: float = 1e-6, spherical: bool = False, initial: Sequence[Sequence[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's rounds from the given centres or the k smallest ids; (assigned rows, centres).

    Every sample counts once in its mean, and a centre has converged when it moves by at most ``tol``.
    """
    centres = [list(c) for c in initial] if initial is not None else first_samples(df, id_col, vec_col, k)
    for _ in range(max_iter):
        if len(centres) > MAX_CENTRES:
            raise ValueError(f"more than {MAX_CENTRES} centres")
        means = _means(df, vec_col, centres)
        new = [means.get(i + 1, c) for i, c in enumerate(centres)]
        if spherical:
            new = [list(np.asarray(c) / (np.linalg.norm(c) or 1.0)) for c in new]
        moved = max(float(np.abs(np.asarray(a) - np.asarray(b)).max()) for a, b in zip(new, centres))
        centres = new
        if moved <= tol:
            break
    return assign(df, vec_col, centres), centres


def nearest_members(assigned: DataFrame, id_col: str) -> DataFrame:
    """The member nearest to each centre."""
    return assigned.groupBy("cluster").agg(F.min_by(id_col, F.struct("dist", id_col)).alias("medoid"), F.count(F.lit(1)).alias("size"))


def row_sums(df: DataFrame, id_col: str, vec_col: str, block: int = neighbours.BLOCK) -> DataFrame:
    """(id, total): sum of the distances to all samples, by pairs of blocks, a number a row and block."""
    n = df.count()
    b = max(1, -(-n // block))
    q, p = (neighbours._side(df, id_col, vec_col, [], b, b, side) for side in (True, False))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "part": pd.Series([], dtype=float)})
        d = neighbours.pairwise(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()))
        return pd.DataFrame({"id": left["id"], "part": d.sum(1)})

    return q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(sums, "id long, part double").groupBy("id").agg(F.sum("part").alias("total"))


def kmedoids_seeds(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """The k samples with the smallest sum over j of d(i, j) / (sum of d(j, l) over l)."""
    totals = row_sums(df, id_col, vec_col).withColumnRenamed("total", "t")
    n = df.count()
    b = max(1, -(-n // neighbours.BLOCK))
    weighed = df.join(totals, F.col(id_col) == F.col("id")).drop("id")
    q, p = neighbours._side(weighed, id_col, vec_col, [], b, b, True), neighbours._side(weighed, id_col, vec_col, ["t"], b, b, False)

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "v": pd.Series([], dtype=float)})
        d = neighbours.pairwise(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()))
        t = right["t"].to_numpy()
        return pd.DataFrame({"id": left["id"], "v": (d / np.where(t > 0, t, 1.0)[None]).sum(1)})

    v = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(part, "id long, v double").groupBy("id").agg(F.round(F.sum("v"), 9).alias("v"))
    return v.orderBy("v", "id").limit(k)


def kmedoids(df: DataFrame, id_col: str, vec_col: str, k: int, max_iter: int = 20) -> tuple[DataFrame, list[int]]:
    """Alternate assignment and medoid choice until the medoids stay; a cluster's medoid has the least
    sum of distances to its members (found in blocks within the cluster)."""
    ids = [r["id"] for r in kmedoids_seeds(df, id_col, vec_col, k).collect()]
    for _ in range(max_iter):
        rows = {r[id_col]: list(r[vec_col]) for r in df.where(F.col(id_col).isin(ids)).select(id_col, vec_col).collect()}
        assigned = assign(df, vec_col, [rows[i] for i in ids])
        new = []
        for c in range(1, len(ids) + 1):
            best = row_sums(assigned.where(F.col("cluster") == c), id_col, vec_col).orderBy(F.round("total", 9), "id").first()
            new.append(best["id"] if best else ids[c - 1])
        if new == ids:
            break
        ids = new
    return assigned, ids


def farthest_first(df: DataFrame, id_col: str, vec_col: str, k: int) -> list[int]:
    """Seeds: the smallest id, then again and again the sample farthest from all seeds (k rounds)."""
    first = df.where(F.col(vec_col).isNotNull()).orderBy(id_col).select(id_col, vec_col).first()
    if first is None:
        return []
    ids, centres = [first[0]], [list(first[1])]
    while len(ids) < k:
        far = assign(df, vec_col, centres).where(F.col("dist") > 0).agg(F.max_by(F.struct(id_col, vec_col), F.struct(F.round("dist", 9), -F.col(id_col))).alias("r")).first()["r"]
        if far is None:
            break
        ids.append(far[0])
        centres.append(list(far[1]))
    return ids


def knn_edges(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(a, b, w): arcs to the k nearest others, undirected and once."""
    n = neighbours.nearest(df, df, id_col, vec_col, k, exclude_self=True)
    return n.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.col("dist").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def spanning_tree(df: DataFrame, id_col: str, vec_col: str, k: int, scratch: Scratch) -> DataFrame:
    """(a, b, w): the minimum spanning tree of all vectors, that of the complete graph; ties by (a, b).

    Boruvka rounds: a vector's nearest one outside its component is read from its ``k`` nearest; only
    vectors whose list lies inside their component, and may still hold its shortest way out, are
    searched against all in blocks.
    """
    rows = scratch.put(df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    n = rows.count()
    lists = scratch.put(neighbours.nearest(rows, rows, "id", "vec", k, exclude_self=True, n_queries=n, n_points=n))
    comp = scratch.put(rows.select("id", F.col("id").alias("root")))
    arc = F.struct(F.col("dist").alias("w"), F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.col("other").alias("to"))
    chosen: list[DataFrame] = []
    while comp.select("root").distinct().limit(2).count() > 1:
        other = comp.select(F.col("id").alias("neighbour"), F.col("root").alias("other"))
        met = lists.join(comp, "id").join(other, "neighbour")
        own = scratch.put(met.groupBy("id", "root").agg(F.max("dist").alias("radius"), F.min(F.when(F.col("root") != F.col("other"), arc)).alias("e")))
        known = own.groupBy("root").agg(F.min("e.w").alias("w"))
        inside = scratch.put(own.where("e IS NULL").join(known, "root").where("w IS NULL OR radius <= w").select("id", "root"))
        found = own.where("e IS NOT NULL").select("root", "e")
        searched = inside.count()
        if searched:
            out = neighbours.nearest(rows.join(inside, "id"), rows.join(comp, "id"), "id", "vec", 1, n_queries=searched, n_points=n, apart_col="root")
            found = found.unionByName(out.join(comp, "id").join(other, "neighbour").select("root", arc.alias("e")))
        best = scratch.put(found.groupBy("root").agg(F.min("e").alias("e")).select("root", "e", "e.to"))
        chosen.append(best.select("e.a", "e.b", "e.w").distinct())
        # arcs are ordered without ties, so each tree of components has one mutual pair: its smaller end is the root
        back = best.select(F.col("root").alias("to"), F.col("to").alias("back"))
        pred = best.join(back, "to").select(F.col("root").alias("id"), F.when((F.col("back") != F.col("root")) | (F.col("root") > F.col("to")), F.col("to")).alias("pred"))
        tops = graphs.forest_descendants(pred, scratch).select(F.col("id").alias("root"), F.col("root").alias("top"))
        nxt = scratch.put(comp.join(tops, "root").select("id", F.col("top").alias("root")))
        scratch.drop(comp, own, inside)
        comp = nxt
    if not chosen:
        return df.sparkSession.createDataFrame([], "a long, b long, w double")
    tree = chosen[0]
    for c in chosen[1:]:
        tree = tree.unionByName(c)
    return tree.distinct()


def prototypes(mst: DataFrame, labels: DataFrame) -> DataFrame:
    """Ends of the spanning arcs that join different classes."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    cut = mst.join(la, "a").join(lb, "b").where("la <> lb")
    return cut.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("la").alias("label")), F.struct(F.col("b").alias("id"), F.col("lb").alias("label")))).alias("s")).select("s.*").distinct()


def train_path_forest(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int, scratch: Scratch) -> DataFrame:
    """Supervised optimum-path forest on the complete graph: prototypes from the spanning tree (found
    by lists of the ``k`` nearest), then least largest arc. (id, cost, label, root); where all samples
    are of one class there is no prototype, and they keep their label at cost 0."""
    mst = scratch.put(spanning_tree(df, id_col, vec_col, k, scratch))
    labels = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    seeds = prototypes(mst, labels).withColumn("cost", F.lit(0.0))
    # costs on the spanning tree equal those on the graph: its paths have the least largest arcs
    forest = graphs.path_forest(mst, seeds, scratch, graphs.fmax)
    rest = labels.join(forest.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("cost"), "label", F.col("id").alias("root"))
    return forest.unionByName(rest)


def classify_path_forest(trained: DataFrame, train: DataFrame, test: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, cost): label of the sample that offers the least max(cost, distance)."""
    points = train.join(trained.select(F.col("id").alias(id_col), "cost", F.col("label").alias("_l")), id_col)
    best = neighbours.nearest(test, points, id_col, vec_col, 1, cost_col="cost")
    return best.join(trained.select(F.col("id").alias("neighbour"), "label"), "neighbour").select("id", "label", F.col("dist").alias("cost"))


def semi_supervised(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int, scratch: Scratch) -> DataFrame:
    """Labels for all samples from the few that have one (label not null): least largest arc on the
    spanning tree of the complete graph, labelled samples at cost 0. (id, label, cost) of every sample
    with a vector, if any has a label."""
    mst = scratch.put(spanning_tree(df, id_col, vec_col, k, scratch))
    seeds = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.lit(0.0).alias("cost"))
    return graphs.path_forest(mst, seeds, scratch, graphs.fmax).select("id", "label", "cost")


def without_outliers(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int) -> DataFrame:
    """Samples most of whose k nearest others share their label."""
    n = neighbours.nearest(df, df, id_col, vec_col, k, exclude_self=True)
    labels = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    vote = n.join(labels.withColumnRenamed("id", "neighbour").withColumnRenamed("label", "other"), "neighbour").join(labels, "id")
    kept = vote.groupBy("id").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("s")).where("s > 0.5").select(F.col("id").alias(id_col))
    return df.join(kept, id_col, "left_semi")


class Classifier:
    """Strategy of two callables: ``train(df) -> model`` and ``predict(model, df) -> df`` with ``pred``."""

    def __init__(self, train, predict_):
        self.train, self.predict = train, predict_


CLASSIFIERS = {
    "logistic": lambda vec, label: Classifier(lambda df: linear_classifier(df, vec, label), lambda m, df: predict(m, df, vec)),
    "svm": lambda vec, label: Classifier(lambda df: linear_classifier(df, vec, label, "svm"), lambda m, df: predict(m, df, vec)),
}


def density(edges: DataFrame) -> DataFrame:
    """(id, density): mean of exp(-w^2 / 2 s^2) over the arcs of a node, s a third of the longest arc."""
    s = edges.agg((F.max("w") / 3).alias("s"))
    arcs = edges.select(F.explode(F.array("a", "b")).alias("id"), "w").join(F.broadcast(s))  # one row
    return arcs.groupBy("id").agg(F.round(F.avg(F.exp(-F.col("w") * F.col("w") / (2 * F.col("s") * F.col("s")))), 9).alias("density"))


def cluster_by_density(df: DataFrame, id_col: str, vec_col: str, k: int, scratch: Scratch) -> DataFrame:
    """Unsupervised optimum-path forest: each sample climbs to its densest neighbour that is denser
    than itself; maxima are the roots. (id, cluster, density), cluster the root's id."""
    edges = scratch.put(knn_edges(df, id_col, vec_col, k))
    d = scratch.put(density(edges))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(d.select(F.col("id").alias("a"), F.col("density").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("density").alias("db")), "b")
    higher = met.where((F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a"))))
    up = higher.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct(-F.col("db"), F.col("b"))).alias("pred"))
    forest = graphs.forest_descendants(d.select("id").join(up, "id", "left"), scratch)
    return forest.join(d, "id").select("id", F.col("root").alias("cluster"), "density")


def pca(df: DataFrame, vec_col: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) from the covariance (dim x dim numbers reach the driver). Signs:
    the largest element of a component is positive. Vectors of several lengths raise ValueError."""
    df = df.where(F.col(vec_col).isNotNull())
    least, dim = df.select(F.min(F.size(vec_col)), F.max(F.size(vec_col))).first()
    if least != dim:
        raise ValueError("vectors of more than one length")
    dim = dim or 0
    x = df.select(F.col(vec_col).cast("array<double>").alias("v"))

    def partial(batches):
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy())
                n, s, c = n + len(m), s + m.sum(0), c + m.T @ m
        yield pd.DataFrame({"n": [n], "s": [s], "c": [c.ravel()]})

    parts = x.mapInPandas(partial, "n long, s array<double>, c array<double>").toPandas()
    n = max(int(parts["n"].sum()), 1)
    mean = np.sum(np.stack(parts["s"].to_numpy()), 0) / n
    cov = np.sum(np.stack(parts["c"].to_numpy()), 0).reshape(dim, dim) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    comp = vectors[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return mean, comp, values[order]


def project(df: DataFrame, vec_col: str, mean: np.ndarray, comp: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.round((np.stack(v.to_numpy()).astype(float) - mean) @ comp.T, 6)))

    return df.withColumn("projected", apply(F.col(vec_col).cast("array<double>")))


def linear_classifier(df: DataFrame, vec_col: str, label_col: str, kind: str = "logistic"):
    """MLlib logistic regression, or one-vs-rest linear support vectors, on an array column."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    base = LogisticRegression(maxIter=30) if kind == "logistic" else OneVsRest(classifier=LinearSVC(maxIter=20))
    return base.fit(data)


def predict(model, df: DataFrame, vec_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))).withColumn("pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def bag_of_words(assigned: DataFrame, item: str, k: int, digits: int = 6) -> DataFrame:
    """Hard coding: share of each word among an item's parts, in unit length. (item, bow)"""
    c = assigned.groupBy(item, "cluster").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    return m.select(item, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.round(F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("l"), digits)).alias("bow"))


def soft_bag_of_words(df: DataFrame, item: str, vec_col: str, centres: Sequence[Sequence[float]], sigma: float, digits: int = 6) -> DataFrame:
    """Soft coding: sum of Gaussian activations of each word, in unit length."""
    acts = F.transform(_centre_array(centres), lambda c: F.exp(-distance.squared_l2(F.col(vec_col), c) / (2 * sigma * sigma)))
    s = df.select(item, F.posexplode(acts).alias("w", "a")).groupBy(item, "w").agg(F.sum("a").alias("a"))
    g = s.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("w", "a"))).alias("l"), F.sqrt(F.sum(F.col("a") ** 2)).alias("n"))
    return g.select(item, F.transform("l", lambda e: F.round(e["a"] / F.col("n"), digits)).alias("bow"))


def grid_search(params: DataFrame, fitness: str) -> DataFrame:
    """Row of a parameter table with the best fitness, the first in column order among equals."""
    rest = [c for c in params.columns if c != fitness]
    return params.agg(F.min_by(F.struct(*rest, fitness), F.struct(-F.col(fitness), *rest)).alias("b")).select("b.*")


def connected_knn_graph(df: DataFrame, id_col: str, vec_col: str, k: int, scratch: Scratch) -> DataFrame:
    """(a, b, w): arcs to the k nearest others and those of the spanning tree, so the graph is connected."""
    near = knn_edges(df, id_col, vec_col, k)
    return near.unionByName(spanning_tree(df, id_col, vec_col, k, scratch)).groupBy("a", "b").agg(F.min("w").alias("w"))


def iterated_path_forest(df: DataFrame, id_col: str, vec_col: str, edges: DataFrame, k: int, scratch: Scratch, cost=graphs.fsum, rounds: int = 10) -> DataFrame:
    """(id, cluster, cost): ``k`` seeds (farthest first) grow a path forest over a graph; each seed moves to the
    member nearest to its tree's mean, until none moves or ``rounds`` are over. ``cluster`` is the seed's id."""
    rows = scratch.put(df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    seeds = sorted(farthest_first(rows, "id", "vec", k))
    found = None
    for _ in range(max(rounds, 1)):
        start = rows.sparkSession.createDataFrame([(i, i, 0.0) for i in seeds], "id long, label long, cost double")
        found = scratch.put(graphs.path_forest(edges, start, scratch, cost).select("id", F.col("label").alias("cluster"), "cost"))
        members = rows.join(found, "id")
        means = members.select("cluster", F.posexplode("vec").alias("p", "v")).groupBy("cluster", "p").agg(F.avg("v").alias("v"))
        means = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e["v"]).alias("mean"))  # a number a place
        d = members.join(F.broadcast(means), "cluster").withColumn("d", F.round(distance.squared_l2(F.col("vec"), F.col("mean")), 9))  # k rows
        new = sorted(r["id"] for r in d.groupBy("cluster").agg(F.min_by("id", F.struct("d", "id")).alias("id")).collect())
        if new == seeds:
            break
        seeds = new
    return found


def normalised_cut(edges: DataFrame, labels: DataFrame) -> float:
    """Sum over clusters of the weight of arcs that leave it by the weight of all its arcs; an arc (a, b, w)
    weighs 1 / w. ``labels`` has id and cluster."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    met = edges.where("w > 0").join(la, "a").join(lb, "b").withColumn("v", 1 / F.col("w"))
    ends = met.select(F.explode(F.array("ca", "cb")).alias("c"), (F.col("ca") != F.col("cb")).alias("out"), "v")
    by = ends.groupBy("c").agg(F.sum(F.when(F.col("out"), F.col("v")).otherwise(0.0)).alias("o"), F.sum("v").alias("t"))
    return by.agg(F.sum(F.col("o") / F.col("t")).alias("cut")).first()["cut"] or 0.0


def best_k(df: DataFrame, id_col: str, vec_col: str, candidates: Sequence[int], scratch: Scratch, cut=normalised_cut) -> tuple[int, DataFrame]:
    """The number of neighbours whose density clusters have the least cut (the first among equals), and the
    clusters (id, cluster, density). ``cut`` is a function of arcs and clusters; one cluster counts 1."""
    best = None
    for k in candidates:
        found = scratch.put(cluster_by_density(df, id_col, vec_col, k, scratch))
        value = cut(knn_edges(df, id_col, vec_col, k), found) if found.select("cluster").distinct().limit(2).count() > 1 else 1.0
        if best is None or value < best[0]:
            best = (value, k, found)
    if best is None:
        raise ValueError("no candidates")
    return best[1], best[2]


def fisher_scores(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """(place, score) of each place of the vectors: variance of the class means by mean variance within
    classes, each class by its share; 0 where nothing varies within classes."""
    flat = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("_l"), F.posexplode(vec_col).alias("place", "v"))
    c = flat.groupBy("place", "_l").agg(F.count("v").alias("n"), F.avg(F.col("v").cast("double")).alias("m"), F.var_pop(F.col("v").cast("double")).alias("s"))
    t = c.groupBy("place").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("t"))
    g = c.join(t, "place").groupBy("place").agg((F.sum(F.col("n") * (F.col("m") - F.col("t")) ** 2) / F.sum("n")).alias("b"), (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("w"))
    return g.select("place", F.when(F.col("w") > 0, F.col("b") / F.col("w")).otherwise(0.0).alias("score"))


def neural_network(df: DataFrame, vec_col: str, label_col: str, hidden: Sequence[int] = (32,), rounds: int = 60, seed: int = 1):
    """Feed-forward network (MLlib) on an array column; labels are whole numbers from 0. For ``predict``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    r = df.select(F.max(F.size(vec_col)).alias("d"), F.max(label_col).alias("c")).first()
    data = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[r["d"], *hidden, int(r["c"]) + 1], maxIter=rounds, seed=seed).fit(data)
