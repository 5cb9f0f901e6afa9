"""Problem 4: the k most similar vectors of every vector, by a forest of random-projection trees.

1. Equal vectors form one class (id: its smallest node); search runs over classes.
2. ``trees`` balanced trees are fitted on a hashed sample of the classes (at most about
   ``sample_rows`` rows and 64 MB): a node splits at the median along the line through two random
   members, the one of 8 lines on which the members lie widest apart. Leaves hold about ``leaf``
   classes of the whole table; more once a sample has less than 8 rows for each leaf.
3. A query walks all trees with one shared priority queue, ordered by the squared distances to the
   planes crossed on the way, until it has ``probes`` leaves. The walk is done level by level for a
   batch of queries: keeping the best ``probes`` nodes of all trees at each level reaches the same
   leaves, because every node has a child of the node's own priority.
4. ``probes`` follows from the data: the true neighbours of about 512 hashed queries among all
   classes are found by brute force, and the fewest leaves are taken that hold ``recall`` of them.
   So the accuracy holds when the table grows, and the number of leaves read grows instead. Where
   that many leaves would make up a whole tree, all leaves of one tree are read, which is exact.
5. Queries meet the classes of their leaves by one shuffle on the leaf, in blocks of bounded size.
   Candidates are ranked by exact distance in double precision; the leaves' lists of one query are
   merged in batches, equal distances going to the smaller id.
6. Classes are expanded to nodes: a node's own copies come first, then members of near classes.
   Classes of at least 1/200 of all nodes (200 at most) meet their nodes by a broadcast.

Defined cases: null vectors, vectors with null, NaN or infinite elements take no part; only vectors
of one length are compared; repeated ids count once (vectors of one id that differ: the smallest
vector is used); fewer than k others give shorter lists; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborgrid.plans import Scratch, bounded_broadcast

K, TREES, LEAF, RECALL, SAMPLE_ROWS, SEED = 10, 4, 2048, 0.998, 262_144, 11
SAMPLE_BYTES, TRIAL_QUERIES, LINES = 64 << 20, 512, 8
#: Classes and queries that meet in one task, lists that are merged in one.
POINTS_BLOCK, QUERIES_BLOCK, LISTS_BLOCK = 65_536, 131_072, 200_000
#: Classes of at least 1/BIG_SHARE of all nodes are broadcast; so are at most MEMBER_ROWS lists of members.
BIG_SHARE, MEMBER_ROWS = 200, 100_000


class Forest:
    """Planes of balanced trees: ``normals[tree, node]`` and ``cuts[tree, node]``, nodes as in a heap."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth = depth
        n_nodes = 2**depth - 1
        self.normals = np.zeros((trees, max(n_nodes, 1), sample.shape[1]), dtype=np.float32)
        self.cuts = np.zeros((trees, max(n_nodes, 1)), dtype=np.float32)
        for t in range(trees):
            groups = [np.arange(len(sample))]
            for level in range(depth):
                nxt = []
                for i, rows in enumerate(groups):
                    node = 2**level - 1 + i
                    normal = self._line(sample, rows, rng)
                    along = sample[rows] @ normal
                    order = np.argsort(along, kind="stable")
                    half = len(rows) // 2
                    if len(rows) > 1:
                        self.cuts[t, node] = (along[order[half - 1]] + along[order[half]]) / 2
                    elif len(rows):
                        self.cuts[t, node] = along[0]
                    self.normals[t, node] = normal
                    nxt += [rows[order[:half]], rows[order[half:]]]
                groups = nxt

    @staticmethod
    def _line(sample: np.ndarray, rows: np.ndarray, rng) -> np.ndarray:
        """Of some lines through two random members the one with the greatest spread of members."""
        if len(rows) > 1:
            ends = rng.choice(rows, (2, LINES))
            lines = sample[ends[0]] - sample[ends[1]]
            length = np.linalg.norm(lines, axis=1)
            if (length > 0).any():
                lines = lines[length > 0] / length[length > 0, None]
                some = rows if len(rows) <= 256 else rng.choice(rows, 256, replace=False)
                return lines[np.argmax((sample[some] @ lines.T).std(0))].astype(np.float32)
        line = rng.standard_normal(sample.shape[1])
        return (line / np.linalg.norm(line)).astype(np.float32)

    def search(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (tree * 2**depth + leaf) of each row's ``probes`` best paths; whether each is the
        row's own leaf in its tree. Fewer columns come back where the forest has fewer leaves."""
        trees, leaves = len(self.normals), 2**self.depth
        probes = max(probes, trees)
        n = len(x)
        tree = np.broadcast_to(np.arange(trees), (n, trees))
        node = np.zeros((n, trees), dtype=np.int64)
        rank = np.zeros((n, trees), dtype=np.float32)
        own = np.ones((n, trees), dtype=bool)
        for level in range(self.depth):
            at = node + (2**level - 1)
            margin = np.einsum("nwd,nd->nw", self.normals[tree, at], x) - self.cuts[tree, at]
            right = (margin > 0).astype(np.int64)
            far = rank - margin * margin
            tree = np.concatenate([tree, tree], 1)
            node = np.concatenate([2 * node + right, 2 * node + 1 - right], 1)
            rank = np.concatenate([rank, far], 1)
            own = np.concatenate([own, np.zeros_like(own)], 1)
            if rank.shape[1] > probes:
                order = rank + own  # the own leaves always stay
                keep = np.argpartition(-order, probes - 1, axis=1)[:, :probes]
                tree, node, rank, own = (np.take_along_axis(a, keep, 1) for a in (tree, node, rank, own))
        return tree * leaves + node, own

    def turns(self, q: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
        """For each vector of ``near`` (a matrix a query) the turn at which the queue of its query
        reaches a leaf that holds it; the first turn is 1."""
        trees, out = len(self.normals), []
        for x, targets in zip(q, near):
            rank = np.zeros((trees, 1), dtype=np.float32)
            for level in range(self.depth):
                here = slice(2**level - 1, 2 ** (level + 1) - 1)
                margin = self.normals[:, here] @ x - self.cuts[:, here]
                far = rank - margin * margin
                rank = np.stack([np.where(margin > 0, far, rank), np.where(margin > 0, rank, far)], -1).reshape(trees, -1)
            turn = np.empty(rank.size, dtype=np.int64)
            turn[np.argsort(-rank.ravel(), kind="stable")] = np.arange(1, rank.size + 1)
            leaf, own = self.search(targets, trees)
            own_leaf = np.where(own, leaf, 0)
            out.append(np.where(own, turn[own_leaf], rank.size + 1).min(1))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def nearest_in_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest of ``x`` with another id: (query index, ids, squared distances),
    ordered by query, exact distance, id. All pairs stay within the block's arrays."""
    if len(x) == 0 or len(q) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, q = x.astype(np.float64), q.astype(np.float64)
    centre = x.mean(0)
    xc = x - centre
    norms = (xc * xc).sum(1)
    rows, found, dist = [], [], []
    step = max(1, 4_000_000 // max(len(x), 1))
    for at in range(0, len(q), step):
        qc = q[at : at + step] - centre
        d = norms[None, :] - 2 * (qc @ xc.T)
        d[ids[None, :] == q_ids[at : at + step, None]] = np.inf
        top = min(2 * k + 6, len(x))
        c = np.argpartition(d, top - 1, axis=1)[:, :top] if top < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
        exact = ((x[c] - q[at : at + step, None, :]) ** 2).sum(2)
        exact[ids[c] == q_ids[at : at + step, None]] = np.inf
        order = np.lexsort((ids[c], exact), axis=1)[:, :k]
        c, exact = np.take_along_axis(c, order, 1), np.take_along_axis(exact, order, 1)
        ok = np.isfinite(exact)
        rows.append(np.nonzero(ok)[0] + at)
        found.append(ids[c][ok])
        dist.append(exact[ok])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


NEAR = "rep long, near array<struct<d2:double,id:long>>"


def _lists(who: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.Table:
    """Table of NEAR from pairs ordered by query index ``q``."""
    offsets = np.searchsorted(q, np.arange(len(who) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(d), pa.array(ids.astype(np.int64))], ["d2", "id"])
    return pa.table([pa.array(who), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["rep", "near"])


def _router(forest, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column("vec"), dim).astype(np.float32)
                leaf, own = f.search(x, probes)
                n, w = leaf.shape
                who = np.repeat(np.arange(n), w)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.ravel().astype(np.int32)), pa.array(own.ravel()), part.column("rep").take(pa.array(who)), raw.take(pa.array(who))],
                    ["leaf", "own", "rep", "raw"],
                )

    return run


def _searcher(dim: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        rep = t.column("rep").to_numpy()
        raw = t.column("raw").combine_chunks()
        x = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.float32).reshape(-1, dim)
        point, ask = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_point", "is_query"))
        q, ids, d = nearest_in_block(rep[point], x[point], rep[ask], x[ask], k)
        return _lists(rep[ask], q, ids, d)

    return run


def _merger(k: int):
    """The k nearest of all lists of a query, each neighbour once."""

    def run(t: pa.Table) -> pa.Table:
        near = t.column("near").combine_chunks()
        reps, who = np.unique(t.column("rep").to_numpy(), return_inverse=True)
        pairs = near.flatten()
        d, ids = pairs.field("d2").to_numpy(), pairs.field("id").to_numpy()
        q = np.repeat(who, near.value_lengths().to_numpy())
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # a pair has one distance, so repeats are adjacent
        q, ids, d = q[new], ids[new], d[new]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return _lists(reps, q[first], ids[first], d[first])

    return run


def _brute(ask, dim: int, k: int, seen: str):
    """Over all batches of a partition: the k nearest of each of the broadcast queries, with vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = ask.value
        best = [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros((0, dim), np.float32)]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, x = part.column(seen).to_numpy(), _matrix(part.column("vec"), dim).astype(np.float32)
                who, found, d = nearest_in_block(ids, x, q_ids, q, k)
                where = np.argsort(ids, kind="stable")
                vec = x[where[np.searchsorted(ids[where], found)]]
                best = [np.concatenate(p) for p in zip(best, (who, found, d, vec))]
                order = np.lexsort((best[1], best[2], best[0]))
                best = [c[order] for c in best]
                first = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                best = [c[first] for c in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[best[0]], pa.int64()), pa.array(best[1]), pa.array(best[2]), pa.array([v.tobytes() for v in best[3]], pa.binary())], ["query", "id", "d2", "raw"]
        )

    return run


def true_neighbours(rows: DataFrame, queries: DataFrame, id_col: str, dim: int, k: int) -> DataFrame:
    """(query, near: list of (d2, id, raw)) by brute force over all ``rows``; ``queries`` is small: it
    is collected and broadcast."""
    t = queries.select(id_col, "vec").toArrow()
    ask = (t.column(id_col).to_numpy(), _matrix(t.column("vec"), dim).astype(np.float32) if t.num_rows else np.zeros((0, dim), np.float32))
    parts = rows.select(id_col, "vec").mapInArrow(_brute(rows.sparkSession.sparkContext.broadcast(ask), dim, k, id_col), "query long, id long, d2 double, raw binary")
    return parts.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id", "raw"))), 1, k).alias("near"))


def _hashed(df: DataFrame, id_col: str, share: float, salt: int) -> DataFrame:
    """About ``share`` of the rows, by a hash of the id."""
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(salt), id_col), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1)))


def fewest_probes(forest: Forest, reps: DataFrame, n: int, dim: int, k: int, recall: float) -> int:
    """The fewest leaves that hold ``recall`` of the true neighbours of about TRIAL_QUERIES classes."""
    queries = _hashed(reps, "rep", TRIAL_QUERIES / max(n, 1), 7).limit(2 * TRIAL_QUERIES)
    found = {r["query"]: [p["raw"] for p in r["near"]] for r in true_neighbours(reps, queries, "rep", dim, k).collect()}  # a row a query
    if not found:
        return len(forest.normals)
    vec = {r["rep"]: r["vec"] for r in queries.select("rep", "vec").collect()}
    asked = [r for r in sorted(found) if found[r]]
    near = [np.frombuffer(b"".join(found[r]), dtype=np.float32).reshape(-1, dim) for r in asked]
    turns = np.sort(forest.turns(np.asarray([vec[r] for r in asked], dtype=np.float32).reshape(-1, dim), near))
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)]) if len(turns) else len(forest.normals)


def _search_classes(spark, reps: DataFrame, n: int, dim: int, k: int, trees: int, leaf: int, probes: int | None, recall: float, sample_rows: int) -> DataFrame:
    """(rep, near: list of (d2, id) by distance then id) over classes (rep, vec)."""
    sample_rows = max(1, min(sample_rows, SAMPLE_BYTES // (4 * dim)))
    table = _hashed(reps, "rep", sample_rows / max(n, 1), 0).limit(2 * sample_rows).select("vec").toArrow()
    sample = _matrix(table.column("vec"), dim).astype(np.float32) if table.num_rows else np.zeros((0, dim), np.float32)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    depth = min(depth, max(0, int(np.floor(np.log2(max(len(sample), 1) / 8)))))
    forest = Forest(sample, trees if depth else 1, depth)
    if probes is None:
        probes = fewest_probes(forest, reps, n, dim, k, recall) if depth else 1
    if probes >= 2**depth:  # one whole tree holds everything
        forest.normals, forest.cuts, probes = forest.normals[:1], forest.cuts[:1], 2**depth
    shared = spark.sparkContext.broadcast(forest)

    routed = reps.select("rep", "vec").mapInArrow(_router(shared, dim, probes), "leaf int, own boolean, rep long, raw binary")
    # expected sizes of a leaf: trees are balanced
    pb = max(1, int(np.ceil(n / 2**depth / POINTS_BLOCK)))
    qb = max(1, int(np.ceil(n * max(probes, len(forest.normals)) / (len(forest.normals) * 2**depth) / QUERIES_BLOCK)))
    if pb == qb == 1:
        keyed = routed.select("leaf", F.lit(0).alias("pb"), F.lit(0).alias("qb"), "rep", "raw", F.col("own").alias("is_point"), F.lit(True).alias("is_query"))
    else:
        block, every = (lambda b: F.pmod(F.xxhash64("rep"), F.lit(b)).cast("int")), (lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        points = routed.where("own").select("leaf", block(pb).alias("pb"), every(qb).alias("qb"), "rep", "raw", F.lit(True).alias("is_point"), F.lit(False).alias("is_query"))
        asks = routed.select("leaf", every(pb).alias("pb"), block(qb).alias("qb"), "rep", "raw", F.lit(False).alias("is_point"), F.lit(True).alias("is_query"))
        keyed = points.unionByName(asks)
    lists = keyed.groupBy("leaf", "pb", "qb").applyInArrow(_searcher(dim, k), NEAR)
    batches = max(1, int(np.ceil(n * probes * pb / LISTS_BLOCK)))
    return lists.withColumn("_b", F.pmod(F.xxhash64("rep"), F.lit(batches))).groupBy("_b").applyInArrow(_merger(k), NEAR)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector as floats) of the rows whose vector is there, not empty and finite."""
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(fine).select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col))


def _classes(df: DataFrame, id_col: str, vec_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, vec), and classes of equal vectors (vec, rep, copies, dim)."""
    nodes = usable(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("node"), F.transform(vec_col, lambda v: v + F.lit(0).cast("float")).alias("vec"))
    nodes = scratch.put(nodes.groupBy("node").agg(F.min("vec").alias("vec")))
    return nodes, scratch.put(nodes.groupBy("vec").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vec")))


def nearest(
    df: DataFrame, id_col: str, vec_col: str, k: int = K, trees: int = TREES, leaf: int = LEAF, probes: int | None = None, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(id, rank, neighbour, distance) with rank from 1 to k for each usable row of ``df``.

    ``probes`` is the number of leaves read for a query; without it, the number follows from ``recall``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "nearest")
    nodes, reps = _classes(df, id_col, vec_col, scratch)
    sizes = {r["dim"]: (r["n"], r["m"]) for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("m")).collect()}
    found = None
    for dim, (n, _) in sorted(sizes.items()):
        part = _search_classes(spark, reps.where(F.col("dim") == dim), n, dim, k, trees, leaf, probes, recall, sample_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "id long, rank int, neighbour long, distance double")

    # nodes of classes with several members; the few big classes meet theirs by a broadcast
    limit = max(2, -(-sum(m for _, m in sizes.values()) // BIG_SHARE))
    big = F.broadcast(reps.where(F.col("copies") >= limit).select("vec", "rep"))  # at most BIG_SHARE rows
    told = nodes.join(big, "vec", "left")
    small = told.where("rep IS NULL").drop("rep").join(reps.where((F.col("copies") > 1) & (F.col("copies") < limit)).select("vec", "rep"), "vec")
    many = scratch.put(told.where("rep IS NOT NULL").select("rep", "node", F.lit(True).alias("big")).unionByName(small.select("rep", "node", F.lit(False).alias("big"))))
    # their smallest k + 1 nodes, cut down in salted parts first
    salt = F.pmod(F.xxhash64("node"), F.lit(64)).alias("salt")
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    ranked = many.groupBy("rep", salt, F.shiftright(F.xxhash64("node"), 48).alias("part")).agg(least(F.collect_list("node")).alias("m"))
    ranked = ranked.groupBy("rep", "salt").agg(least(F.flatten(F.collect_list("m"))).alias("m"))
    members = scratch.put(ranked.groupBy("rep").agg(least(F.flatten(F.collect_list("m"))).alias("members")))

    near = found.select("rep", F.explode("near").alias("p")).select("rep", F.col("p.id").alias("other"), F.col("p.d2").alias("d2"))
    spread = near.join(bounded_broadcast(members.withColumnRenamed("rep", "other"), MEMBER_ROWS), "other", "left")
    spread = spread.select("rep", F.transform(F.coalesce("members", F.array("other")), lambda m: F.struct(F.col("d2").alias("d2"), m.alias("id"))).alias("near"))
    others = spread.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    lists = reps.select("rep", "copies").join(others, "rep", "left").join(bounded_broadcast(members, MEMBER_ROWS), "rep", "left")
    none = F.array().cast("array<struct<d2:double,id:long>>")
    lists = scratch.put(lists.select("rep", "copies", F.coalesce("near", none).alias("near"), F.coalesce("members", F.array("rep")).alias("members")))

    own = many.where("NOT big").join(lists.where((F.col("copies") > 1) & (F.col("copies") < limit)), "rep")
    own = own.unionByName(many.where("big").join(F.broadcast(lists.where(F.col("copies") >= limit)), "rep"))  # at most BIG_SHARE rows
    own = own.select("node", "near", "members").unionByName(lists.where("copies = 1").select(F.col("rep").alias("node"), "near", "members"))
    copies = F.transform(F.filter("members", lambda m: m != F.col("node")), lambda m: F.struct(F.lit(0.0).alias("d2"), m.alias("id")))
    full = own.select(F.col("node").alias("id"), F.slice(F.concat(copies, "near"), 1, k).alias("near"))
    flat = full.select("id", F.posexplode("near").alias("pos", "p"))
    return flat.select("id", (F.col("pos") + 1).alias("rank"), F.col("p.id").alias("neighbour"), F.sqrt("p.d2").alias("distance"))


def recall(df: DataFrame, id_col: str, vec_col: str, k: int = K) -> DataFrame:
    """(queries, neighbours, found, recall): brute force for every usable row whose id is divisible by
    100, against all rows, held against the result of :func:`nearest`. A neighbour counts as found
    if a row as near as the k-th true one stands in its place."""
    scratch = Scratch(df.sparkSession, "recall")
    nodes = _classes(df, id_col, vec_col, scratch)[0].withColumn("dim", F.size("vec"))
    got = scratch.put(nearest(df, id_col, vec_col, k).where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "rank", "distance"))
    true = None
    for dim in sorted(r["dim"] for r in nodes.select("dim").distinct().collect()):
        rows = nodes.where(F.col("dim") == dim)
        # 100,000 queries at most meet at once, so that the broadcast is bounded
        asked = rows.where("node % 100 = 0")
        for part in range(max(1, -(-asked.count() // 100_000))):
            some = asked.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-asked.count() // 100_000)))) == part)
            one = true_neighbours(rows, some, "node", dim, k).select("query", F.size("near").alias("n"), F.sqrt(F.element_at("near", -1)["d2"]).alias("worst"))
            true = one if true is None else true.unionByName(one)
    if true is None:
        return df.sparkSession.createDataFrame([(0, 0, 0, 1.0)], "queries long, neighbours long, found long, recall double")
    met = true.where("n > 0").join(got, "query", "left").groupBy("query", "n").agg(F.count_if(F.col("distance") <= F.col("worst") * (1 + 1e-12)).alias("hit"))
    total = met.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("neighbours"), F.coalesce(F.sum(F.least("n", "hit")), F.lit(0)).cast("long").alias("found"))
    return total.withColumn("recall", F.round(F.when(F.col("neighbours") > 0, F.col("found") / F.col("neighbours")).otherwise(1.0), 4))


def matrix_rows(matrix: DataFrame, graph: DataFrame) -> DataFrame:
    """(node_id, vec) of the nodes of ``graph`` that point (z, sample) to a row of ``matrix``.

    Repeats count once: of a matrix the latest ``loaded_at``, of a node the smallest (z, sample). Rows outside a matrix's nrows, unknown
    matrices and rows that the list doesn't hold in full give no vector.
    """
    latest = matrix.groupBy("matrix_id").agg(F.max_by(F.struct("nrows", "ncols", "val"), F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))).alias("m"))
    rows = latest.select("matrix_id", "m.*").where("nrows > 0 AND ncols > 0 AND val IS NOT NULL")
    cut = F.transform(F.sequence(F.lit(0), F.col("nrows") - 1), lambda i: F.slice("val", i * F.col("ncols") + 1, F.col("ncols")))
    rows = rows.select(F.col("matrix_id").alias("z"), "ncols", F.posexplode(cut).alias("sample", "vec")).where(F.size("vec") == F.col("ncols"))
    nodes = graph.where("node_id IS NOT NULL AND z IS NOT NULL AND sample >= 0").groupBy("node_id").agg(F.min(F.struct("z", "sample")).alias("g"))
    return nodes.select("node_id", "g.*").join(rows, ["z", "sample"]).select("node_id", "vec")
