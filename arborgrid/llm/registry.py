"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborgrid.llm import chunk, encode, nearest, pack, quota, related, subset
from arborgrid.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


@query("p6_ids")
def p6_ids(spark, folder):
    """Ids of every document."""
    return encode.encode_corpus(read(spark, folder, "documents"))


def _packed(spark, folder):
    docs = read(spark, folder, "documents")
    return pack.pack(encode.token_counts(docs), "doc_id", "n_tokens", n_items=docs.count())


@query("p7_containers")
def p7_containers(spark, folder):
    """Every document's place or places in containers of 2048 tokens."""
    return _packed(spark, folder)


@query("p7_found")
def p7_found(spark, folder):
    """Documents that had to be divided: those of more than 2048 tokens."""
    return _packed(spark, folder).where((F.col("n_parts") > 1) & (F.col("part") == 0)).select("doc_id").distinct()


@query("p8_pieces")
def p8_pieces(spark, folder):
    """Pieces of the documents over 512 tokens."""
    return chunk.split_oversized(read(spark, folder, "documents"))


@query("p8_found")
def p8_found(spark, folder):
    """Documents that were cut: those over 512 tokens."""
    return chunk.split_oversized(read(spark, folder, "documents")).where(F.col("piece") == 0).select("doc_id").distinct()


def _nearest(spark, folder):
    vectors = nearest.matrix_rows(read(spark, folder, "ift_matrix"), read(spark, folder, "ift_graph"))
    return nearest.nearest(vectors, "node_id", "vec")


# vectors of usable nodes and all their distances; small tables only
NEAREST = """WITH m AS (SELECT matrix_id, arg_max({'r': nrows, 'c': ncols, 'v': val}, coalesce(loaded_at, TIMESTAMP '1970-01-01')) AS m FROM ift_matrix GROUP BY 1),
    g AS (SELECT node_id, min((z, sample)) AS g FROM ift_graph WHERE node_id IS NOT NULL AND z IS NOT NULL AND sample >= 0 GROUP BY 1),
    v AS (SELECT node_id, list_transform(m.v[g[2] * m.c + 1 : g[2] * m.c + m.c], lambda e: CAST(e AS DOUBLE)) AS v FROM g JOIN m ON m.matrix_id = g[1] WHERE g[2] < m.r AND m.r > 0 AND m.c > 0 AND len(m.v[g[2] * m.c + 1 : g[2] * m.c + m.c]) = m.c),
    u AS (SELECT * FROM v WHERE len(list_filter(v, lambda e: e IS NOT NULL AND isfinite(e))) = len(v)),
    d AS (SELECT a.node_id AS id, b.node_id AS neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM u a JOIN u b ON a.node_id <> b.node_id AND len(a.v) = len(b.v)),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), neighbour) AS rank FROM d QUALIFY rank <= 10)"""


@query("p4_neighbours", NEAREST + " SELECT id, CAST(rank AS INT) AS rank, neighbour, round(sqrt(d), 6) AS distance FROM n")
def p4_neighbours(spark, folder):
    """The 10 nearest other nodes of every usable node, over all graphs."""
    return _nearest(spark, folder).withColumn("distance", F.round("distance", 6))


@query("p4_recall", NEAREST + ", t AS (SELECT count(DISTINCT id) AS q, count(*) AS n FROM n WHERE id % 100 = 0) SELECT q AS queries, n AS neighbours, n AS found, 1.0::DOUBLE AS recall FROM t")
def p4_recall(spark, folder):
    """Share of the true neighbours that are found, for the nodes whose id is divisible by 100."""
    vectors = nearest.matrix_rows(read(spark, folder, "ift_matrix"), read(spark, folder, "ift_graph"))
    return nearest.recall(vectors, "node_id", "vec")


@query("p4_found", NEAREST + " SELECT DISTINCT least(id, neighbour) AS node_a, greatest(id, neighbour) AS node_b FROM n")
def p4_found(spark, folder):
    """Pairs of nodes of which one is among the other's 10 nearest."""
    pairs = _nearest(spark, folder).select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b"))
    return pairs.distinct()


def _split(spark, folder):
    records = read(spark, folder, "split")
    targets = {r["split_name"]: float(r["target_pct"]) for r in read(spark, folder, "split_targets").collect()}  # fixed, 3 rows
    keys = {n: f(F.col(n)) for n, f in related.KEYS.items()}
    return related.related_split(records, "ids", "true_labels", "loaded_at", keys, targets)


@query("p3_splits")
def p3_splits(spark, folder):
    """Split, group of related records and label of every record."""
    placed = _split(spark, folder)[0]
    return placed.select(F.col("id").alias("ids"), F.col("label").alias("true_labels"), F.col("root").alias("group_id"), F.col("size").alias("group_size"), F.col("split").alias("split_name"))


@query("p3_forest")
def p3_forest(spark, folder):
    """Edges of the spanning forest."""
    return _split(spark, folder)[1].select(F.col("a").alias("ids_a"), F.col("b").alias("ids_b"))


GROUPS = r"""WITH RECURSIVE k AS (
        SELECT ids, 'a:' || array_to_string(list_sort(w), ' ') AS key
        FROM (SELECT ids, list_filter(string_split_regex(lower(strip_accents(author)), '[^a-z]+'), lambda x: x <> '') AS w FROM split) WHERE len(w) = 3
        UNION
        SELECT ids, 's:' || CAST(CAST(rig AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(series AS BIGINT) AS VARCHAR)
        FROM (SELECT ids, regexp_extract(lower(source), 'rig[^0-9]*([0-9]+)', 1) AS rig, regexp_extract(lower(source), 'series[^0-9]*([0-9]+)', 1) AS series FROM split) WHERE rig <> '' AND series <> ''
        UNION
        SELECT ids, 'e:' || CAST(CAST(n[1] AS BIGINT) AS VARCHAR) FROM (SELECT ids, regexp_extract_all(entity, '[0-9]+') AS n FROM split) WHERE len(n) = 1),
    h AS (SELECT key, min(ids) AS m FROM k GROUP BY 1),
    e AS (SELECT DISTINCT m AS a, ids AS b FROM k JOIN h USING (key) WHERE m <> ids),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, root) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id WHERE r.root < g.b),
    c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"""


@query("p3_found", GROUPS + " SELECT root AS ids_a, id AS ids_b FROM c WHERE id <> root")
def p3_found(spark, folder):
    """The smallest record of each group of related records with each other one."""
    placed = _split(spark, folder)[0]
    return placed.where(F.col("id") != F.col("root")).select(F.col("root").alias("ids_a"), F.col("id").alias("ids_b"))


@query(
    "p3_groups",
    GROUPS + ", n AS (SELECT ids, arg_max(true_labels, coalesce(loaded_at, TIMESTAMP '1970-01-01')) AS true_labels FROM split WHERE ids IS NOT NULL GROUP BY 1), m AS (SELECT ids, true_labels, coalesce(root, ids) AS group_id FROM n LEFT JOIN c ON c.id = n.ids) SELECT ids, coalesce(true_labels, -1) AS true_labels, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM m",
)
def p3_groups(spark, folder):
    """Group, its size and label (-1: none) of every record; p3_splits without the split, which no SQL can say."""
    return p3_splits(spark, folder).drop("split_name").withColumn("true_labels", F.coalesce("true_labels", F.lit(-1)))


@query("p3_kept_together", "SELECT split_name, true AS groups_whole, true AS share_near FROM split_targets")
def p3_kept_together(spark, folder):
    """Of every split: whether its groups lie in it as a whole, and whether its share of the records is
    within two hundredths, or the largest group's share, of its target."""
    placed = p3_splits(spark, folder)
    whole = placed.groupBy("group_id", "group_size").agg(F.min("split_name").alias("split_name"), F.max("split_name").alias("_m"), F.count(F.lit(1)).alias("n"))
    whole = whole.groupBy("split_name").agg(F.bool_and((F.col("split_name") == F.col("_m")) & (F.col("n") == F.col("group_size"))).alias("groups_whole"), F.sum("n").alias("n"), F.max("n").alias("top"))
    all_ = whole.agg(F.sum("n").alias("total"), F.max("top").alias("top"))
    targets = read(spark, folder, "split_targets")
    goal = targets.join(targets.agg(F.sum("target_pct").alias("pct"))).join(all_)  # 3 rows with 1 and 1
    met = goal.join(whole.drop("top"), "split_name", "left")
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("target_pct") / F.col("pct")) <= F.greatest(F.lit(0.02), F.col("top") / F.col("total"))
    return met.select("split_name", F.coalesce("groups_whole", F.lit(True)).alias("groups_whole"), F.coalesce(near, F.lit(True)).alias("share_near"))


def _quotas(spark, folder):
    samples = quota.split_samples(read(spark, folder, "split")).unionByName(quota.file_samples(read(spark, folder, "ift_filenames")))
    return samples, quota.quotas(samples, read(spark, folder, "sample_targets"), ["tbl", "pool"], "class")


# distinct samples of each pool and class
COUNTS = r"""WITH s AS (
        SELECT 'split' AS tbl, pool, true_labels AS class, ids AS sample FROM split WHERE true_labels > 0
        UNION
        SELECT 'ift_filenames', pool, CAST(m[1] AS INT), CAST(m[2] AS BIGINT)
        FROM (SELECT pool, regexp_extract_all(filename, '([0-9]+)_([0-9]+)(_[A-Za-z]+)?\.[A-Za-z.]+\s*$', 0) AS w, string_split(regexp_extract(filename, '[0-9]+_[0-9]+(_[A-Za-z]+)?\.[A-Za-z.]+\s*$'), '_') AS p,
                     [regexp_extract(filename, '([0-9]+)_([0-9]+)(_[A-Za-z]+)?\.[A-Za-z.]+\s*$', 1), regexp_extract(filename, '([0-9]+)_([0-9]+)(_[A-Za-z]+)?\.[A-Za-z.]+\s*$', 2)] AS m
              FROM ift_filenames WHERE pool IS NOT NULL) WHERE m[1] <> ''),
    n AS (SELECT tbl, pool, class, count(DISTINCT sample) AS n FROM s GROUP BY ALL)"""


@query("p5_sample")
def p5_sample(spark, folder):
    """The samples drawn from each pool."""
    samples, q = _quotas(spark, folder)
    return quota.draw(samples, q, ["tbl", "pool"], "class", "sample")


@query("p5_report")
def p5_report(spark, folder):
    """Quota, availability and shortfall of every target."""
    return _quotas(spark, folder)[1]


@query(
    "p5_totals",
    COUNTS + """, t AS (SELECT tbl, pool, class, greatest(max(coalesce(target_pct, 0)), 0) AS pct, greatest(max(coalesce(min_n, 0)), 0) AS floor, greatest(max(coalesce(sample_size, 0)), 0) AS size FROM sample_targets GROUP BY ALL),
    j AS (SELECT t.*, least(floor, coalesce(n.n, 0)) AS low, CASE WHEN pct > 0 THEN coalesce(n.n, 0) ELSE least(floor, coalesce(n.n, 0)) END AS high FROM t LEFT JOIN n ON n.tbl = t.tbl AND n.pool = t.pool AND n.class = t.class)
    SELECT tbl, pool, CAST(greatest(sum(low), least(max(size), sum(high))) AS BIGINT) AS drawn, CAST(greatest(sum(low) - max(size), 0) AS BIGINT) AS over_size, true AS within FROM j GROUP BY ALL""",
)
def p5_totals(spark, folder):
    """Of every pool: samples drawn, how many of them are over its size (floors come first), and whether
    each class has between its floor, as far as there is, and what there is."""
    samples, q = _quotas(spark, folder)
    drawn = quota.draw(samples, q, ["tbl", "pool"], "class", "sample").groupBy("tbl", "pool", "class").agg(F.count(F.lit(1)).alias("n"))
    met = q.join(drawn, ["tbl", "pool", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    within = F.bool_and((F.col("n") >= F.least("min_n", "available")) & (F.col("n") <= F.col("available")) & (F.col("n") == F.col("quota")))
    return met.groupBy("tbl", "pool").agg(F.sum("n").alias("drawn"), F.max("over_size").alias("over_size"), within.alias("within"))


@query("p5_found", COUNTS + " SELECT t.tbl, t.pool, t.class FROM sample_targets t LEFT JOIN n ON n.tbl = t.tbl AND n.pool = t.pool AND n.class = t.class WHERE coalesce(n.n, 0) * 100 < t.target_pct * t.sample_size OR coalesce(n.n, 0) < t.min_n")
def p5_found(spark, folder):
    """Targets for which the pool does not suffice."""
    return _quotas(spark, folder)[1].where("short").select("tbl", "pool", "class")


def _subset_tables(spark, folder):
    graph = read(spark, folder, "ift_graph")
    vectors = nearest.usable(nearest.matrix_rows(read(spark, folder, "ift_matrix"), graph), "node_id", "vec")
    return read(spark, folder, "ift_unlabeled_selector"), read(spark, folder, "subset_requests"), graph, vectors


@query("p2_subset")
def p2_subset(spark, folder):
    """The varied subset of each selector row."""
    return subset.varied_subset(*_subset_tables(spark, folder))


@query(
    "p2_counts",
    """WITH q AS (SELECT selector_id, max(nsamples) AS n FROM subset_requests WHERE nsamples >= 1 GROUP BY 1), e AS (SELECT DISTINCT node_id FROM ift_graph),
    l AS (SELECT selector_id, clusterlist, rootarray, unnest(range(1, len(clusterlist) + 1)) AS c FROM ift_unlabeled_selector WHERE clusterlist IS NOT NULL),
    m AS (SELECT selector_id, c, rootarray[c] AS root, unnest(clusterlist[c]) AS node FROM l),
    o AS (SELECT selector_id, node, min((coalesce(root <> node, true), c))[2] AS c FROM m WHERE node IN (SELECT node_id FROM e) GROUP BY ALL)
    SELECT selector_id, least(max(n), count(*)) AS chosen, count(DISTINCT c) AS clusters, least(max(n), count(DISTINCT c)) AS clusters_reached FROM o JOIN q USING (selector_id) GROUP BY 1""",
)
def p2_counts(spark, folder):
    """Of every request: nodes chosen, clusters with candidates, and how many of these the subset reaches."""
    return subset.coverage(*_subset_tables(spark, folder)).select("selector_id", "chosen", "clusters", "clusters_reached")


@query("p2_coverage")
def p2_coverage(spark, folder):
    """Clusters and hash buckets that each subset reaches, beside those of a uniform draw."""
    return subset.coverage(*_subset_tables(spark, folder))
