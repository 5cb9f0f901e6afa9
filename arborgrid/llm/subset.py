"""Problem 2: a varied subset of given size per request.

1. Local density: each vector falls into one bucket of each of ``rounds`` locality-sensitive hash
   functions (floors of random projections, drawn for each length of vector, of a width taken from
   the spread of vectors of that length). Its density is the mean number of the request's
   candidates in its buckets, counted before any shuffle.
2. Weighted draw: a candidate's key is -ln(u) * density with u a hash of (request, node) in (0, 1);
   the smallest keys form a sample without replacement with probability inverse to density.
3. Cover: half of the request's size is spread over its clusters evenly, at least one node each
   (where there are more clusters than that, those with the smallest hash); the other half goes to
   clusters by the sum of their members' inverse densities, that is by their expected share of the
   weighted draw, with the largest remainder. A cluster's root, where it is a candidate of the
   cluster, comes before the draw. Within a cluster the keys decide.

Candidates of a request are counted and ranked by cluster and hash bucket (plans.ranking); they
are never brought together in one task. Buckets that hold at least 1/200 of all candidates (200 a
hash function at most) meet them by a broadcast. A request's list of cluster sizes is as long as
its ``clusterlist`` and is allotted in one task, about a thousand requests at a time.

Defined cases: nodes that do not exist, nulls and null or empty clusters are no candidates; a node
listed more than once counts once, in the cluster it is the root of, else in the first of its
clusters; a candidate without a usable vector has the density of the vectorless nodes of its
cluster; requests for null or fewer than one node give no rows; requests for more than there are
give all; requests without a selector row, and selector rows without a request, give no rows;
repeated selector rows count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborgrid.llm.quota import allocate
from arborgrid.plans import Scratch, take_smallest

ROUNDS, PLANES, SEED = 8, 4, 17
BIG_SHARE = 200
#: About so many requests are allotted in one task.
TASK_REQUESTS = 1_000


def candidates(selectors: DataFrame, existing: DataFrame) -> DataFrame:
    """(selector_id, cluster, node, is_root), each node once a selector."""
    lists = F.posexplode(F.zip_with("clusterlist", F.coalesce("rootarray", F.array().cast("array<bigint>")), lambda c, r: F.struct(c.alias("nodes"), r.alias("root"))))
    one = selectors.where("selector_id IS NOT NULL AND clusterlist IS NOT NULL").select("selector_id", lists.alias("cluster", "c")).distinct()
    nodes = one.select("selector_id", "cluster", F.col("c.root").alias("root"), F.explode("c.nodes").alias("node")).where("node IS NOT NULL")
    other = F.coalesce(F.col("root") != F.col("node"), F.lit(True))
    nodes = nodes.groupBy("selector_id", "node").agg(F.min(F.struct(other.alias("other"), "cluster")).alias("f"))
    nodes = nodes.select("selector_id", "node", "f.cluster", (~F.col("f.other")).alias("is_root"))
    return nodes.join(existing.where("node_id IS NOT NULL").select(F.col("node_id").alias("node")).distinct(), "node")


def widths(vectors: DataFrame) -> dict[int, float]:
    """Mean deviation over the places of the vectors of each length (a row a length reaches the driver)."""

    def sums(batches):
        for pdf in batches:
            length = pdf["vec"].map(len).to_numpy()
            for d in np.unique(length):
                x = np.stack(pdf["vec"].to_numpy()[length == d]).astype(float)
                yield pd.DataFrame({"d": int(d), "p": np.arange(d, dtype="int32"), "n": len(x), "s": x.sum(0), "q": (x * x).sum(0)})

    places = vectors.select("vec").mapInPandas(sums, "d int, p int, n long, s double, q double").groupBy("d", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    dev = F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
    return {r["d"]: float(r["w"]) or 1.0 for r in places.groupBy("d").agg(F.avg(dev).alias("w")).collect()}


def buckets(vectors: DataFrame, rounds: int = ROUNDS, planes: int = PLANES, width: float = 1.0, seed: int = SEED) -> DataFrame:
    """(node, codes): one bucket code a round, from ``planes`` random projections each."""
    spread = widths(vectors)

    def run(batches):
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            length = pdf["vec"].map(len).to_numpy()
            for d in np.unique(length).tolist():
                if d not in drawn:
                    rng = np.random.default_rng((seed, d))
                    normals = rng.standard_normal((d, rounds * planes)).astype(np.float32)
                    drawn[d] = normals / np.maximum(np.linalg.norm(normals, axis=0), 1e-9), rng.random(rounds * planes).astype(np.float32)
                normals, shift = drawn[d]
                part = pdf[length == d]
                x = np.stack(part["vec"].to_numpy()).astype(np.float32)
                cells = np.floor(x @ normals / (width * spread[d]) + shift).astype(np.int64).reshape(len(x), rounds, planes)
                mixed = np.full((len(x), rounds), d, dtype=np.int64)
                for p in range(planes):
                    mixed = mixed * 1_000_003 + cells[:, :, p]
                yield pd.DataFrame({"node": part["node"], "codes": list(mixed)})

    return vectors.mapInPandas(run, "node long, codes array<long>")


def _shares(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quota of each cluster of whole requests."""
    size, variety, turn = (pdf[c].to_numpy(t) for c, t in (("size", np.int64), ("variety", float), ("turn", np.int64)))
    wanted, quota = pdf["nsamples"].to_numpy(), np.zeros(len(pdf), dtype=np.int64)
    for rows in pdf.groupby("selector_id", sort=False).indices.values():
        want, order = int(wanted[rows[0]]), rows[np.argsort(turn[rows], kind="stable")]
        even = np.full(len(rows), max(want // (2 * len(rows)), 1))
        if want < len(rows):
            even = np.zeros(len(rows), dtype=np.int64)
            even[:want] = 1
        quota[order] = allocate(variety[order], even, size[order], want)
    return pdf[["selector_id", "cluster"]].assign(quota=quota)


def coded_candidates(selectors: DataFrame, requests: DataFrame, existing: DataFrame, vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS, planes: int = PLANES) -> tuple[DataFrame, DataFrame]:
    """Requests (selector_id, nsamples), and candidates (selector_id, node, cluster, is_root, codes)."""
    asked = scratch.put(requests.where("selector_id IS NOT NULL AND nsamples >= 1").groupBy("selector_id").agg(F.max("nsamples").alias("nsamples")))
    cand = candidates(selectors, existing).join(asked.select("selector_id"), "selector_id")
    codes = buckets(vectors.select(F.col("node_id").alias("node"), "vec"), rounds, planes)
    none = F.array(F.concat(F.lit("c"), F.col("cluster")))
    named = F.transform("codes", lambda c, i: F.concat_ws(":", i, c))
    return asked, scratch.put(cand.join(codes, "node", "left").select("selector_id", "node", "cluster", "is_root", F.coalesce(named, none).alias("codes")))


def densities(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """(selector_id, node, density): mean count of a candidate's buckets."""
    flat = coded.select("selector_id", "node", F.explode("codes").alias("code"))
    counts = scratch.put(flat.groupBy("selector_id", "code").agg(F.count(F.lit(1)).alias("n")))
    limit = max(2, -(-coded.count() // BIG_SHARE))
    told = flat.join(F.broadcast(counts.where(F.col("n") >= limit)), ["selector_id", "code"], "left")  # BIG_SHARE rows a round at most
    rest = told.where("n IS NULL").drop("n").join(counts.where(F.col("n") < limit), ["selector_id", "code"])
    return told.where("n IS NOT NULL").unionByName(rest).groupBy("selector_id", "node").agg(F.avg("n").alias("density"))


def varied_subset(selectors: DataFrame, requests: DataFrame, existing: DataFrame, vectors: DataFrame, rounds: int = ROUNDS, planes: int = PLANES) -> DataFrame:
    """(selector_id, node_id, cluster, is_root, density) of the chosen nodes.

    ``existing`` has node_id, ``vectors`` has node_id and vec (usable vectors only).
    """
    scratch = Scratch(selectors.sparkSession, "subset")
    return _drawn(*coded_candidates(selectors, requests, existing, vectors, scratch, rounds, planes), scratch)


def _drawn(asked: DataFrame, coded: DataFrame, scratch: Scratch) -> DataFrame:
    weighed = scratch.put(coded.drop("codes").join(densities(coded, scratch), ["selector_id", "node"]))
    sizes = weighed.groupBy("selector_id", "cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(1 / F.col("density")).alias("variety"))
    sizes = sizes.join(asked, "selector_id").withColumn("turn", F.xxhash64(F.lit(SEED), "selector_id", "cluster"))
    tasks = max(8, -(-asked.count() // TASK_REQUESTS))
    dealt = sizes.withColumn("_task", F.pmod(F.xxhash64("selector_id"), F.lit(tasks))).groupBy("_task")
    quota = scratch.put(dealt.applyInPandas(_shares, T.StructType([*sizes.select("selector_id", "cluster").schema, T.StructField("quota", T.LongType())])))
    offered = weighed.join(quota, ["selector_id", "cluster"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "selector_id", "node"), 1) + 1) / F.lit(float(2**63))
    key = -F.log(u) * F.col("density")
    # an even spread over buckets: keys are exponential, so 1 - exp(-key / density bound) is flat enough
    flat_key = F.when(F.col("is_root"), F.lit(-1)).otherwise((F.atan(F.log1p(key)) / F.lit(np.pi / 2) * F.lit(float(2**62))).cast("long"))
    picked = take_smallest(offered.withColumn("draw", key), ["selector_id", "cluster"], flat_key, "quota", ["draw", "node"])
    return picked.select("selector_id", F.col("node").alias("node_id"), "cluster", "is_root", "density")


def coverage(selectors: DataFrame, requests: DataFrame, existing: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per request: chosen, clusters and hash buckets its candidates have, how many of each the subset
    reaches, and how many a uniform draw of as many candidates (by a hash) reaches."""
    scratch = Scratch(selectors.sparkSession, "coverage")
    asked, coded = coded_candidates(selectors, requests, existing, vectors, scratch)
    chosen = _drawn(asked, coded, scratch).select("selector_id", F.col("node_id").alias("node"), F.lit(True).alias("ours"))
    random = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "selector_id", "node"), 1)
    uniform = take_smallest(coded.select("selector_id", "node").join(asked, "selector_id"), ["selector_id"], random, "nsamples", ["node"])
    marked = coded.join(chosen, ["selector_id", "node"], "left").join(uniform.select("selector_id", "node", F.lit(True).alias("even")), ["selector_id", "node"], "left")
    things = F.explode(F.concat("codes", F.array(F.concat(F.lit("cluster "), F.col("cluster")))))
    hit = marked.select("selector_id", "ours", "even", things.alias("thing")).groupBy("selector_id", "thing").agg(F.max("ours").alias("ours"), F.max("even").alias("even"))
    is_cluster = F.col("thing").startswith("cluster ")
    count = lambda c, n: F.count_if(c).alias(n)
    reach = hit.groupBy("selector_id").agg(
        count(is_cluster, "clusters"), count(is_cluster & F.col("ours"), "clusters_reached"), count(is_cluster & F.col("even"), "clusters_reached_uniform"),
        count(~is_cluster, "buckets"), count(~is_cluster & F.col("ours"), "buckets_reached"), count(~is_cluster & F.col("even"), "buckets_reached_uniform"),
    )
    return chosen.groupBy("selector_id").agg(F.count(F.lit(1)).alias("chosen")).join(reach, "selector_id")
