"""Distances, neighbours, clustering, spanning trees, path forests, classifiers and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import distance
from arborgrid.operators import graphs, learning, metrics, neighbours, sampling
from arborgrid.plans import Scratch
from arborgrid.registry import query
from arborgrid.tables import read

D = "sqrt(list_sum([pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2) FOR x IN list_zip({a}, {b})]))"
NB = "d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), neighbour) AS rank FROM d QUALIFY rank <= {k})"


def vectors(spark, folder):
    return read(spark, folder, "embeddings")


def _z(f: str) -> str:
    return f"list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: {f}))".replace("X", "CAST(z[1] AS DOUBLE)").replace("Y", "CAST(z[2] AS DOUBLE)")


PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, folder):
    e = vectors(spark, folder).select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id")


@query("distances", f"""SELECT a.vec_id, round({_z('abs(X - Y)')}, 6) AS l1, round(sqrt({_z('(X - Y) * (X - Y)')}), 6) AS l2, round({_z('abs(X - Y)')} / (64 + 1e-6), 6) AS l1n, round(0.5 - {_z('X * Y')} / 2, 6) AS cosine,
  round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS linf, round(pow({_z('pow(abs(X - Y), 3)')}, 1 / 3.0), 6) AS minkowski3 {PAIRS}""")
def distances(spark, folder):
    a, b = F.col("embedding"), F.col("next")
    fs = {"l1": distance.l1(a, b), "l2": distance.l2(a, b), "l1n": distance.l1_normalized(a, b), "cosine": distance.cosine(a, b), "linf": distance.chebyshev(a, b), "minkowski3": distance.minkowski(a, b, 3)}
    return _pairs(spark, folder).select("vec_id", *[F.round(c, 6).alias(n) for n, c in fs.items()])


@query("dist_emd", """WITH z AS (SELECT a.vec_id, unnest(range(1, 65)) AS i, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  c AS (SELECT vec_id, sum(CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE)) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM z) SELECT vec_id, round(sum(abs(c)), 6) AS emd, round(sum(c), 6) AS emd_signed FROM c GROUP BY 1""")
def dist_emd(spark, folder):
    a, b = F.col("embedding"), F.col("next")
    return _pairs(spark, folder).select("vec_id", F.round(distance.earth_movers(a, b), 6).alias("emd"), F.round(distance.earth_movers_signed(a, b), 6).alias("emd_signed"))


@query("gram_kernels", f"""SELECT a.vec_id, round({_z('X * Y')}, 6) AS linear, round(pow({_z('X * Y')} + 1, 2), 6) AS polynomial, round(exp(-{_z('(X - Y) * (X - Y)')} / 2), 6) AS gaussian, round(exp(-sqrt({_z('(X - Y) * (X - Y)')})), 6) AS laplacian,
  round(tanh({_z('X * Y')}), 6) AS sigmoid, round(1 - {_z('(X - Y) * (X - Y)')} / ({_z('(X - Y) * (X - Y)')} + 1), 6) AS rational, round(1 / sqrt({_z('(X - Y) * (X - Y)')} + 1), 6) AS inverse_multiquadric,
  round(-ln({_z('(X - Y) * (X - Y)')} + 1), 6) AS log, round(1 / (1 + {_z('(X - Y) * (X - Y)')}), 6) AS student {PAIRS}""")
def gram_kernels(spark, folder):
    a, b = F.col("embedding"), F.col("next")
    names = ("linear", "polynomial", "gaussian", "laplacian", "sigmoid", "rational", "inverse_multiquadric", "log", "student")
    return _pairs(spark, folder).select("vec_id", *[F.round(distance.KERNELS[n](a, b), 6).alias(n) for n in names])


@query("knn_graph", f"WITH {NB.format(k=5)} SELECT id, neighbour, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM n")
def knn_graph(spark, folder):
    e = vectors(spark, folder)
    return neighbours.nearest(e, e, "vec_id", "embedding", 5, exclude_self=True).withColumn("dist", F.round("dist", 6))


@query("knn_classify", f"WITH {NB.format(k=7)}, v AS (SELECT id, lb AS label, count(*) AS n FROM n GROUP BY 1, 2) SELECT id, arg_min(label, (-n, label)) AS label FROM v GROUP BY 1")
def knn_classify(spark, folder):
    e = vectors(spark, folder)
    n = neighbours.nearest(e, e, "vec_id", "embedding", 7, exclude_self=True)
    return neighbours.classify(n, e.select(F.col("vec_id").alias("id"), "label"))


TRAIN = "t AS (SELECT *, vec_id % 3 = 0 AS test FROM embeddings), d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) AS dist FROM t a JOIN t b ON a.test AND NOT b.test)"


@query("classify_certainty", f"WITH {TRAIN}, c AS (SELECT id, lb AS label, min(dist) AS cost FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, label) AS r FROM c) SELECT id, any_value(label) FILTER (r = 1) AS label, round(max(cost) FILTER (r = 2) / (max(cost) FILTER (r = 1) + max(cost) FILTER (r = 2)), 6) AS certainty FROM r WHERE r <= 2 GROUP BY 1")
def classify_certainty(spark, folder):
    """Every third vector is a query held against all the others, class by class."""
    e = vectors(spark, folder)
    queries, train = e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0")
    best = None
    for c in sorted(r["label"] for r in train.select("label").distinct().collect()):
        one = neighbours.nearest(queries, train.where(F.col("label") == c), "vec_id", "embedding", 1).select("id", F.lit(c).alias("label"), F.col("dist").alias("cost"))
        best = one if best is None else best.unionByName(one)
    return neighbours.certainty(best)


@query("one_class_radius", f"WITH {NB.format(k=9)} SELECT id, round(max(dist), 6) AS radius FROM n GROUP BY 1")
def one_class_radius(spark, folder):
    e = vectors(spark, folder)
    return neighbours.nearest(e, e, "vec_id", "embedding", 9, exclude_self=True).groupBy("id").agg(F.round(F.max("dist"), 6).alias("radius"))


KM = "c0 AS (SELECT vec_id + 1 AS c, embedding AS m FROM embeddings WHERE vec_id < 5), "
_STEP = """a{i} AS (SELECT vec_id, embedding, arg_min(c, (d, c)) AS cluster FROM (SELECT e.vec_id, e.embedding, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM embeddings e, c{p} c) GROUP BY ALL),
 c{i} AS (SELECT cluster AS c, list(v ORDER BY i) AS m FROM (SELECT cluster, i, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT cluster, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY 1), """


@query("kmeans_5", "WITH " + KM + "".join(_STEP.format(i=i, p=i - 1) for i in range(1, 5)) + "z AS (SELECT 1) SELECT vec_id, CAST(arg_min(c, (d, c)) AS INT) AS cluster, round(min(d), 6) AS dist FROM (SELECT e.vec_id, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM embeddings e, c4 c) GROUP BY 1")
def kmeans_5(spark, folder):
    """Four rounds from the five smallest ids."""
    a, _ = learning.kmeans(vectors(spark, folder), "vec_id", "embedding", 5, max_iter=4, tol=0.0)
    return a.select("vec_id", "cluster", F.round("dist", 6).alias("dist"))


def _lloyd(k: int, rounds: int, table: str = "embeddings", unit: bool = False) -> str:
    """CTEs a1, c1, ... of Lloyd's rounds from the k smallest ids."""
    mean = "avg(CAST(v AS DOUBLE))"
    out = [f"c0 AS (SELECT vec_id + 1 AS c, embedding AS m FROM {table} WHERE vec_id < {k})"]
    for i in range(1, rounds + 1):
        out.append(f"a{i} AS (SELECT vec_id, embedding, arg_min(c, (d, c)) AS cluster, min(d) AS d FROM (SELECT e.vec_id, e.embedding, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM {table} e, c{i - 1} c) GROUP BY ALL)")
        out.append(f"m{i} AS (SELECT cluster AS c, list(v ORDER BY i) AS m FROM (SELECT cluster, i, {mean} AS v FROM (SELECT cluster, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY 1)")
        out.append(f"c{i} AS (SELECT c, " + ("list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m" if unit else "m") + f" FROM m{i})")
    return ", ".join(out)


def _assigned(rounds: int, table: str = "embeddings") -> str:
    return f"z AS (SELECT vec_id, CAST(arg_min(c, (d, c)) AS INT) AS cluster, min(d) AS d FROM (SELECT e.vec_id, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM {table} e, c{rounds} c) GROUP BY 1)"


@query("kmeans_twelve_rounds", "WITH " + _lloyd(10, 12) + ", " + _assigned(12) + " SELECT cluster, arg_min(vec_id, (d, vec_id)) AS medoid, count(*) AS size FROM z GROUP BY 1")
def kmeans_twelve_rounds(spark, folder):
    """Ten clusters after twelve rounds: the member nearest to each centre, and sizes."""
    a, _ = learning.kmeans(vectors(spark, folder), "vec_id", "embedding", 10, max_iter=12, tol=0.0)
    return learning.nearest_members(a, "vec_id")


@query("kmeans_converged")
def kmeans_converged(spark, folder):
    a, _ = learning.kmeans(vectors(spark, folder), "vec_id", "embedding", 10)
    return learning.nearest_members(a, "vec_id")


UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS embedding FROM embeddings)"


@query("spherical_kmeans", f"WITH {UNIT}, " + _lloyd(5, 10, "u", True) + ", " + _assigned(10, "u") + " SELECT vec_id, cluster FROM z")
def spherical_kmeans(spark, folder):
    a, _ = learning.kmeans(vectors(spark, folder).withColumn("unit", distance.unit(F.col("embedding"))), "vec_id", "unit", 5, max_iter=10, spherical=True)
    return a.select("vec_id", "cluster")


@query("kmedoids_init", "WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) AS d FROM embeddings a, embeddings b), t AS (SELECT i AS j, sum(d) AS t FROM d GROUP BY 1) SELECT i AS id, round(sum(d / t), 6) AS v FROM d JOIN t USING (j) GROUP BY 1 ORDER BY round(sum(d / t), 9), id LIMIT 5")
def kmedoids_init(spark, folder):
    return learning.kmedoids_seeds(vectors(spark, folder), "vec_id", "embedding", 5).withColumn("v", F.round("v", 6))


@query("kmedoids")
def kmedoids(spark, folder):
    a, _ = learning.kmedoids(vectors(spark, folder), "vec_id", "embedding", 3, max_iter=3)
    return a.select("vec_id", "cluster")


def _far(k: int) -> str:
    out = ["f0 AS (SELECT min(vec_id) AS id FROM embeddings)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT id FROM f{j}" for j in range(i))
        out.append(f"f{i} AS (SELECT arg_max(vec_id, (round(d, 9), -vec_id)) AS id FROM (SELECT e.vec_id, min(list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS d FROM embeddings e JOIN embeddings c ON c.vec_id IN (SELECT id FROM ({chosen})) GROUP BY 1) WHERE d > 0)")
    return ", ".join(out)


@query("farthest_first", "WITH " + _far(6) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS rank, id AS vec_id FROM f{i}" for i in range(6)))
def farthest_first(spark, folder):
    ids = learning.farthest_first(vectors(spark, folder), "vec_id", "embedding", 6)
    return spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "rank int, vec_id long")


def _knn_edges(spark, folder, scratch, k=5):
    return scratch.put(learning.knn_edges(vectors(spark, folder), "vec_id", "embedding", k))


EDGES = f"WITH RECURSIVE {NB.format(k=5)}, e AS (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, min(dist) AS w FROM n GROUP BY ALL), g AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e)"


@query("knn_components", EDGES + ", r(id, root) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id WHERE r.root < g.b) SELECT id, min(root) AS root FROM r GROUP BY 1")
def knn_components(spark, folder):
    scratch = Scratch(spark, "knn")
    return graphs.connected_components(_knn_edges(spark, folder, scratch), scratch)


@query("mst_counts", EDGES + ", r(id, root) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id WHERE r.root < g.b), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1), l AS (SELECT a AS id, min(w) AS w FROM g GROUP BY 1) SELECT root, count(*) - 1 AS arcs, true AS holds_nearest FROM c GROUP BY 1")
def mst_counts(spark, folder):
    """Of every component of the 5-nearest graph: the spanning tree's arcs (its vertices less one), and
    whether each vertex's shortest arc is one of them, as it must be."""
    scratch = Scratch(spark, "mst")
    edges = _knn_edges(spark, folder, scratch)
    tree = scratch.put(graphs.minimum_spanning_forest(edges, scratch))
    comp = graphs.connected_components(edges, scratch)
    both = edges.select(F.col("a").alias("id"), "w", "a", "b").unionByName(edges.select(F.col("b").alias("id"), "w", "a", "b"))
    least = both.groupBy("id").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("id", "e.a", "e.b")
    held = least.join(tree.select("a", "b", F.lit(True).alias("held")), ["a", "b"], "left").join(comp, "id").groupBy("root").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("holds_nearest"))
    arcs = tree.join(comp, F.col("a") == F.col("id")).groupBy("root").agg(F.count(F.lit(1)).alias("arcs"))
    return arcs.join(held, "root").select("root", "arcs", "holds_nearest")


@query("mst_edges")
def mst_edges(spark, folder):
    scratch = Scratch(spark, "mst")
    return graphs.minimum_spanning_forest(_knn_edges(spark, folder, scratch), scratch).withColumn("w", F.round("w", 6))


@query("path_forest_max", EDGES + ", s(id, cost) AS (SELECT vec_id, 0.0::DOUBLE FROM embeddings WHERE label = 0), r(id, cost) USING KEY (id) AS (SELECT id, cost FROM s UNION SELECT g.b, min(greatest(r.cost, g.w)) FROM r JOIN g ON g.a = r.id LEFT JOIN recurring.r o ON o.id = g.b WHERE greatest(r.cost, g.w) < coalesce(o.cost, 1e300) GROUP BY g.b) SELECT id, round(cost, 6) AS cost FROM r")
def path_forest_max(spark, folder):
    """Least largest arc on a path from any vector of label 0, over the 5-nearest graph."""
    scratch = Scratch(spark, "paths")
    seeds = vectors(spark, folder).where("label = 0").select(F.col("vec_id").alias("id"), "label", F.lit(0.0).alias("cost"))
    return graphs.path_forest(_knn_edges(spark, folder, scratch), seeds, scratch).select("id", F.round("cost", 6).alias("cost"))


@query("path_forest_sum", EDGES + ", s(id, c) AS (SELECT vec_id, (0.0::DOUBLE, vec_id, vec_id) FROM embeddings WHERE vec_id % 97 = 0), r(id, c) USING KEY (id) AS (SELECT id, c FROM s UNION SELECT g.b, min((r.c[1] + g.w, r.c[2], r.c[3])) FROM r JOIN g ON g.a = r.id LEFT JOIN recurring.r o ON o.id = g.b WHERE o.id IS NULL OR (r.c[1] + g.w, r.c[2], r.c[3]) < o.c GROUP BY g.b) SELECT id, round(c[1], 6) AS cost, c[2] AS label, c[3] AS root FROM r")
def path_forest_sum(spark, folder):
    scratch = Scratch(spark, "paths")
    seeds = vectors(spark, folder).where("vec_id % 97 = 0").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("label"), F.lit(0.0).alias("cost"))
    return graphs.path_forest(_knn_edges(spark, folder, scratch), seeds, scratch, graphs.fsum).withColumn("cost", F.round("cost", 6))


@query("path_forest_supervised")
def path_forest_supervised(spark, folder):
    """Trained on two thirds, predicting every third vector."""
    scratch = Scratch(spark, "train")
    e = vectors(spark, folder)
    train, test = e.where("vec_id % 3 <> 0"), e.where("vec_id % 3 = 0")
    trained = scratch.put(learning.train_path_forest(train, "vec_id", "embedding", "label", 8, scratch))
    return learning.classify_path_forest(trained, train, test, "vec_id", "embedding").withColumn("cost", F.round("cost", 6))


@query("path_forest_unsupervised")
def path_forest_unsupervised(spark, folder):
    scratch = Scratch(spark, "train")
    return learning.cluster_by_density(vectors(spark, folder), "vec_id", "embedding", 10, scratch).withColumn("density", F.round("density", 6))


PRED = "p AS (SELECT l_orderkey, CAST(1 + l_quantity % 3 AS INT) AS truth, CAST(CASE WHEN l_discount > 0.02 THEN 1 + l_quantity % 3 ELSE 1 + l_linenumber % 3 END AS INT) AS pred FROM lineitem)"


def _pred(spark, folder):
    q = (1 + F.col("l_quantity") % 3).cast("int")
    return read(spark, folder, "lineitem").select("l_orderkey", q.alias("truth"), F.when(F.col("l_discount") > 0.02, q).otherwise((1 + F.col("l_linenumber") % 3).cast("int")).alias("pred"))


@query("confusion", f"WITH {PRED} SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(_pred(spark, folder), "truth", "pred")


PC = f"WITH {PRED}, k AS (SELECT DISTINCT truth AS class FROM p), c AS (SELECT class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (truth <> class AND pred = class) AS fp, count(*) FILTER (truth = class AND pred <> class) AS fn, count(*) FILTER (truth <> class AND pred <> class) AS tn, count(*) AS t FROM k, p GROUP BY 1)"


@query("class_rates", PC + " SELECT class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / t, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS fscore, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(1 - (fp / (fp + tn) + fn / (fn + tp)) / 2, 6) AS weighted_accuracy FROM c")
def class_rates(spark, folder):
    return metrics.rates(metrics.per_class(metrics.confusion(_pred(spark, folder), "truth", "pred")), ["class"])


@query("classification_summary", PC + """, s AS (SELECT sum(tp) / any_value(t) AS po, sum((tp + fp) * CAST(tp + fn AS DOUBLE)) / any_value(t) / any_value(t) AS pe, avg(2 * tp / (2 * tp + fp + fn)) AS macro_f, avg(tp / (tp + fn)) AS mean_recall,
  sum(tp / (tp + fn) * (1 - (tp + fn) / t)) / sum(1 - (tp + fn) / t) AS skewed, 1 - sum(fp / (t - tp - fn) + fn / (tp + fn)) / (2 * count(*)) AS path_accuracy, 1 - greatest(avg(fp / (t - tp - fn)), avg(fn / (tp + fn))) AS worst_accuracy FROM c)
  SELECT round(po, 6) AS true_positives, round((po - pe) / (1 - pe + 1e-7), 6) AS kappa, round(macro_f, 6) AS macro_f, round(mean_recall, 6) AS mean_recall, round(skewed, 6) AS skewed, round(path_accuracy, 6) AS path_accuracy, round(worst_accuracy, 6) AS worst_accuracy FROM s""")
def classification_summary(spark, folder):
    return metrics.summary(_pred(spark, folder), "truth", "pred")


@query("cluster_purity", "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY 1")
def cluster_purity(spark, folder):
    return metrics.purity(read(spark, folder, "lineitem"), "l_suppkey", "l_returnflag")


@query("far_frr", "SELECT round(avg(CAST(l_quantity >= 30 AS INT)) FILTER (l_returnflag <> 'R'), 6) AS far, round(avg(CAST(l_quantity < 30 AS INT)) FILTER (l_returnflag = 'R'), 6) AS frr, round((avg(CAST(l_quantity >= 30 AS INT)) FILTER (l_returnflag <> 'R') + avg(CAST(l_quantity < 30 AS INT)) FILTER (l_returnflag = 'R')) / 2, 6) AS err FROM lineitem")
def far_frr(spark, folder):
    return metrics.far_frr(read(spark, folder, "lineitem").withColumn("g", F.col("l_returnflag") == "R"), "l_quantity", "g", 30)


@query("best_score_row", "WITH s AS (SELECT l_suppkey, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1) SELECT l_suppkey, total FROM s ORDER BY total DESC, l_suppkey LIMIT 1")
def best_score_row(spark, folder):
    return metrics.best_row(read(spark, folder, "lineitem"), "l_suppkey", "l_discount")


@query("kfold_stratified", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def kfold_stratified(spark, folder):
    return sampling.kfold(read(spark, folder, "orders"), "o_orderkey", 5, ["o_orderpriority"], seed=None).select("o_orderkey", "fold")


@query("fold_counts", "WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, CAST(f AS INT) AS fold, n // 5 + CAST(f < n % 5 AS INT) AS n FROM n, range(5) r(f)")
def fold_counts(spark, folder):
    """Sizes of random folds: even in each stratum."""
    return kfold_random(spark, folder).groupBy("o_orderpriority", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("subsample_counts", "WITH l AS (SELECT l_returnflag AS stratum, ceil(count(*) * 0.1) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderpriority AS stratum, least(100, count(*)) AS n FROM orders GROUP BY 1) SELECT stratum, CAST(n AS BIGINT) AS n FROM l UNION ALL SELECT stratum, n FROM o")
def subsample_counts(spark, folder):
    """Rows of each stratum in the proportional and in the balanced subsample."""
    one = proportional_subsample(spark, folder).groupBy(F.col("l_returnflag").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(balanced_subsample(spark, folder).groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("n")))


@query("kfold_random")
def kfold_random(spark, folder):
    return sampling.kfold(read(spark, folder, "orders"), "o_orderkey", 5, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "fold")


@query("balanced_subsample")
def balanced_subsample(spark, folder):
    return sampling.stratified(read(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 100, ["o_orderpriority"])


@query("proportional_subsample")
def proportional_subsample(spark, folder):
    return sampling.proportional(read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("key")), "key", 0.1, ["l_returnflag"])


@query("areas_above", "SELECT l_suppkey, count(*) AS area FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 550 AND 620")
def areas_above(spark, folder):
    return sampling.groups_in_area(read(spark, folder, "lineitem"), "l_suppkey", 550, 620)


@query("nearest_to_root", "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1), d AS (SELECT o.o_custkey, o_orderkey, round(abs(o_totalprice - m), 1) AS d FROM orders o JOIN m USING (o_custkey)) SELECT o_custkey, o_orderkey, d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS INT) AS rank FROM d QUALIFY rank <= 2")
def nearest_to_root(spark, folder):
    o = read(spark, folder, "orders")
    m = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    d = o.join(m, "o_custkey").select("o_custkey", "o_orderkey", F.round(F.abs(F.col("o_totalprice") - F.col("m")), 1).alias("d"))
    return sampling.nearest_to_root(d, "o_custkey", "d", "o_orderkey", 2)


@query("active_selection")
def active_selection(spark, folder):
    e = vectors(spark, folder)
    a, _ = learning.kmeans(e, "vec_id", "embedding", 5, max_iter=3)
    roots = a.groupBy("cluster").agg(F.min_by("label", F.struct("dist", "vec_id")).alias("root_label"))
    return sampling.active_selection(a.join(roots, "cluster"), "cluster", "dist", "vec_id", "root_label", "label", 4).select("cluster", "vec_id", "rank")


@query("pca_projection")
def pca_projection(spark, folder):
    e = vectors(spark, folder)
    mean, comp, _ = learning.pca(e, "embedding", 3)
    return learning.project(e.select("vec_id", "embedding"), "embedding", mean, comp).select("vec_id", "projected")


@query("logistic_regression")
def logistic_regression(spark, folder):
    e = vectors(spark, folder)
    return learning.predict(learning.linear_classifier(e, "embedding", "label"), e, "embedding").select("vec_id", "label", "pred")


@query("linear_svm")
def linear_svm(spark, folder):
    e = vectors(spark, folder)
    return learning.predict(learning.linear_classifier(e, "embedding", "label", "svm"), e, "embedding").select("vec_id", "label", "pred")


@query("bow_hard_coding", "WITH " + KM + "a AS (SELECT vec_id, label, arg_min(c, (d, c)) AS cluster FROM (SELECT e.vec_id, e.label, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM embeddings e, c0 c) GROUP BY ALL), n AS (SELECT label, w AS w, count(*) FILTER (cluster = w) AS n FROM a, (SELECT unnest(range(1, 6)) AS w) GROUP BY ALL), s AS (SELECT label, sqrt(sum(n * n)) AS l FROM n GROUP BY 1) SELECT label, list(round(n / l, 6) ORDER BY w) AS bow FROM n JOIN s USING (label) GROUP BY 1")
def bow_hard_coding(spark, folder):
    e = vectors(spark, folder)
    return learning.bag_of_words(learning.assign(e, "embedding", learning.first_samples(e, "vec_id", "embedding", 5)), "label", 5)


@query("bow_soft_coding", "WITH c0 AS (SELECT vec_id + 1 AS c, embedding AS m FROM embeddings WHERE vec_id < 5), s AS (SELECT label, c, sum(exp(-d / 2)) AS a FROM (SELECT e.label, c.c, list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM embeddings e, c0 c) GROUP BY ALL), n AS (SELECT label, sqrt(sum(a * a)) AS n FROM s GROUP BY 1) SELECT s.label, list(round(a / n, 6) ORDER BY c) AS bow FROM s JOIN n ON n.label = s.label GROUP BY 1")
def bow_soft_coding(spark, folder):
    e = vectors(spark, folder)
    return learning.soft_bag_of_words(e, "label", "embedding", learning.first_samples(e, "vec_id", "embedding", 5), 1.0)


@query("grid_search", "WITH p AS (SELECT p_size, CAST(p_partkey % 7 AS INT) AS q, max(p_retailprice) AS f FROM part GROUP BY ALL) SELECT p_size, q, f FROM p ORDER BY f DESC, p_size, q LIMIT 1")
def grid_search(spark, folder):
    p = read(spark, folder, "part").groupBy("p_size", (F.col("p_partkey") % 7).cast("int").alias("q")).agg(F.max("p_retailprice").alias("f"))
    return learning.grid_search(p, "f")


@query("semi_supervised_cost", "WITH RECURSIVE g AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))) AS w FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r(id, c) USING KEY (id) AS (SELECT vec_id, (0.0::DOUBLE, label) FROM embeddings WHERE vec_id % 4 = 0 UNION SELECT g.b, min((greatest(r.c[1], g.w), r.c[2])) FROM r JOIN g ON g.a = r.id LEFT JOIN recurring.r o ON o.id = g.b WHERE o.id IS NULL OR (greatest(r.c[1], g.w), r.c[2]) < o.c GROUP BY g.b) SELECT id, round(c[1], 6) AS cost FROM r")
def semi_supervised_cost(spark, folder):
    """Costs of semi_supervised: the least largest arc from a labelled vector, on the complete graph."""
    return semi_supervised(spark, folder).select("id", "cost")


@query("semi_supervised")
def semi_supervised(spark, folder):
    """Every fourth vector keeps its label; the others get one."""
    e = vectors(spark, folder).withColumn("label", F.when(F.col("vec_id") % 4 == 0, F.col("label")))
    return learning.semi_supervised(e, "vec_id", "embedding", "label", 8, Scratch(spark, "semi")).withColumn("cost", F.round("cost", 6))


@query("without_outliers", f"WITH {NB.format(k=5)}, s AS (SELECT id, avg(CAST(la = lb AS INT)) AS s FROM n GROUP BY 1) SELECT id AS vec_id FROM s WHERE s > 0.5")
def without_outliers(spark, folder):
    return learning.without_outliers(vectors(spark, folder), "vec_id", "embedding", "label", 5).select("vec_id")
