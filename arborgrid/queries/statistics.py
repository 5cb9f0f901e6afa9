"""Histograms, moments, entropies, normalisation, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import arith
from arborgrid.operators import histogram, statistics
from arborgrid.registry import query
from arborgrid.tables import read

HIST = """h AS (SELECT l_returnflag AS label, CAST(floor(l_quantity / (51.0 / 17)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
  d AS (SELECT label, b.bin FROM (SELECT DISTINCT label FROM h), (SELECT CAST(unnest(range(17)) AS INT) AS bin) b),
  f AS (SELECT d.label, d.bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM d LEFT JOIN h ON h.label = d.label AND h.bin = d.bin)"""


def _hist(spark, folder):
    rows = read(spark, folder, "lineitem").select(F.col("l_returnflag").alias("label"), "l_quantity")
    return histogram.histogram(rows, "l_quantity", nbins=17, max_val=50, by=["label"])


@query("hist_by_label", f"WITH {HIST} SELECT label, bin, n, round(n / greatest(sum(n) OVER (PARTITION BY label), 1), 6) AS share FROM f")
def hist_by_label(spark, folder):
    return _hist(spark, folder)


@query(
    "hist_gray",
    """WITH h AS (SELECT CAST(floor(l_quantity / (51.0 / 51)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1),
    d AS (SELECT CAST(unnest(range(51)) AS INT) AS bin)
    SELECT d.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share FROM d LEFT JOIN h USING (bin)""",
)
def hist_gray(spark, folder):
    return histogram.histogram(read(spark, folder, "lineitem"), "l_quantity", nbins=51, max_val=50)


@query(
    "hist_cumulative",
    f"""WITH {HIST} SELECT label, bin, n, CAST(sum(n) OVER w AS BIGINT) AS cum, round(sum(n) OVER w / greatest(sum(n) OVER (PARTITION BY label), 1), 6) AS cdf
    FROM f WINDOW w AS (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING)""",
)
def hist_cumulative(spark, folder):
    return histogram.cumulative(_hist(spark, folder), ["label"])


@query(
    "hist_stats",
    f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY label) AS t FROM f)
    SELECT label, arg_max(bin, n * 1000 - bin) AS mode, round(sum(bin * n) / greatest(sum(n), 1), 6) AS mean, min(CASE WHEN c * 2 >= t THEN bin END) AS median,
           arg_min(bin, n * 1000 + bin) AS argmin FROM c GROUP BY label""",
)
def hist_stats(spark, folder):
    return histogram.summary(_hist(spark, folder), ["label"])


@query(
    "color_hist",
    """SELECT CAST(least(floor(l_quantity * 4 / 51.0), 3) + 4 * least(floor(l_discount * 100 * 4 / 51.0), 3) + 16 * least(floor(l_tax * 100 * 4 / 51.0), 3) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1""",
)
def color_hist(spark, folder):
    from arborgrid.functions import color

    b = color.quantized_bin(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, 4, 50.0)
    return read(spark, folder, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_stats",
    """SELECT o_orderpriority, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max,
    round(var_pop(o_totalprice), 2) AS var, round(stddev_pop(o_totalprice), 4) AS std, round(median(o_totalprice), 6) AS median, round(coalesce(avg(CASE WHEN o_totalprice <> 0 THEN o_totalprice END), 0), 6) AS mean_nonzero
    FROM orders GROUP BY 1""",
)
def region_stats(spark, folder):
    s = statistics.describe(read(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"])
    return s.withColumn("sum", F.round("sum", 2)).withColumn("var", F.round("var", 2)).withColumn("std", F.round("std", 4))


@query(
    "region_mean_std",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
)
def region_mean_std(spark, folder):
    return statistics.describe(read(spark, folder, "events"), "value", ["event_type"]).select("event_type", "mean", "std")


@query(
    "arg_extremes",
    "SELECT o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS argmin, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS argmax FROM orders GROUP BY 1",
)
def arg_extremes(spark, folder):
    return statistics.arg_extremes(read(spark, folder, "orders"), "o_totalprice", "o_orderkey", ["o_orderstatus"])


@query(
    "association",
    """WITH m AS (SELECT l_returnflag, covar_pop(l_quantity, l_extendedprice) AS cov, corr(l_quantity, l_extendedprice) AS r, var_pop(l_quantity) AS vx, var_pop(l_extendedprice) AS vy FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(cov, 3) AS cov, round(r, 6) AS r, round(1 - abs(r), 6) AS r_distance, round(vx + vy - sqrt(greatest((vx + vy) * (vx + vy) - 4 * vx * vy * (1 - r * r), 0)), 2) AS mici FROM m""",
)
def association(spark, folder):
    a = statistics.association(read(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return a.withColumn("cov", F.round("cov", 3)).withColumn("mici", F.round("mici", 2))


@query(
    "linear_regression",
    "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
)
def linear_regression(spark, folder):
    r = statistics.regression(read(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"])
    return r.withColumn("slope", F.round("slope", 4)).withColumn("intercept", F.round("intercept", 2))


@query(
    "weighted_median",
    """WITH m AS (SELECT l_shipdate, l_quantity, sum(CAST(l_discount * 100 AS BIGINT)) AS w FROM lineitem WHERE CAST(l_discount * 100 AS BIGINT) > 0 GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_shipdate ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY l_shipdate) AS t FROM m)
    SELECT l_shipdate, min(l_quantity) AS weighted_median FROM c WHERE c * 2 >= t GROUP BY 1""",
)
def weighted_median(spark, folder):
    rows = read(spark, folder, "lineitem").withColumn("w", F.round(F.col("l_discount") * 100).cast("long"))
    return statistics.weighted_median(rows, "l_quantity", "w", ["l_shipdate"])


@query(
    "weighted_mean",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS weighted_mean FROM lineitem GROUP BY 1, 2",
)
def weighted_mean(spark, folder):
    return statistics.weighted_mean(read(spark, folder, "lineitem"), "l_quantity", "l_discount", ["l_returnflag", "l_linestatus"])


@query(
    "entropy",
    "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM c) SELECT l_returnflag, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
)
def entropy(spark, folder):
    return statistics.entropy(read(spark, folder, "lineitem"), "l_quantity", ["l_returnflag"])


@query(
    "nmi",
    """WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j),
    hx AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / any_value(t) AS p FROM j, t GROUP BY a)), hy AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / any_value(t) AS p FROM j, t GROUP BY b)),
    hxy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM j, t)
    SELECT round(hx.h, 6) AS hx, round(hy.h, 6) AS hy, round(hxy.h, 6) AS hxy, round((hx.h + hy.h) / hxy.h, 6) AS nmi FROM hx, hy, hxy""",
)
def nmi(spark, folder):
    return statistics.mutual_information(read(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "kl_divergence",
    """WITH g AS (SELECT l_quantity, count(*) FILTER (l_linestatus = 'F') AS p, count(*) FILTER (l_linestatus <> 'F') AS q FROM lineitem GROUP BY 1), s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM g)
    SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END), 6) AS kl FROM s""",
)
def kl_divergence(spark, folder):
    f = F.col("l_linestatus") == "F"
    return statistics.kl_divergence(read(spark, folder, "lineitem"), "l_quantity", f.cast("long"), (~f).cast("long"))


@query(
    "zscore_by_group",
    "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)",
)
def zscore_by_group(spark, folder):
    return statistics.normalize(read(spark, folder, "events"), "value", ["event_type"], "zscore").select("event_id", "scaled")


@query(
    "minmax_by_group",
    "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)",
)
def minmax_by_group(spark, folder):
    return statistics.normalize(read(spark, folder, "events"), "value", ["event_type"], "minmax", 255.0).select("event_id", "scaled")


@query(
    "otsu_threshold",
    """WITH c AS (SELECT l_returnflag AS f, CAST(l_quantity AS INT) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT f, v, sum(n) OVER w AS w0, sum(v * n) OVER w AS s0, sum(n) OVER (PARTITION BY f) AS w, sum(v * n) OVER (PARTITION BY f) AS s FROM c WINDOW w AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT f, v, round(CASE WHEN w > w0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END / w / w, 9) AS b FROM s)
    SELECT f AS l_returnflag, arg_min(v, (-b, v)) AS threshold FROM b GROUP BY 1""",
)
def otsu_threshold(spark, folder):
    rows = read(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("v"))
    return statistics.otsu(rows, "v", ["l_returnflag"])


@query(
    "cum_hist_threshold",
    """WITH c AS (SELECT l_linestatus AS f, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY f) AS t FROM c)
    SELECT f AS l_linestatus, min(v) AS threshold FROM s WHERE c >= t * 0.9 GROUP BY 1""",
)
def cum_hist_threshold(spark, folder):
    return statistics.percentile_threshold(read(spark, folder, "lineitem"), "l_quantity", 0.9, ["l_linestatus"])


@query(
    "equalize",
    """WITH c AS (SELECT CAST(l_quantity AS INT) AS v, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT v, n, CAST(least(floor(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 256 / sum(n) OVER ()), 255) AS INT) AS equalized FROM c""",
)
def equalize(spark, folder):
    return statistics.equalize(read(spark, folder, "lineitem").select(F.col("l_quantity").cast("int").alias("v")), "v", 255)


@query(
    "match_histogram",
    """WITH a AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_discount * 100 AS t, count(*) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1),
    fa AS (SELECT v, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS f FROM a), fb AS (SELECT t, sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS f FROM b)
    SELECT v AS q, round(min(t), 6) AS matched FROM fa JOIN fb ON fb.f >= fa.f GROUP BY v""",
)
def match_histogram(spark, folder):
    li = read(spark, folder, "lineitem")
    a, b = li.where("l_linestatus = 'F'").select(F.col("l_quantity").alias("q")), li.where("l_linestatus <> 'F'").select((F.col("l_discount") * 100).alias("q"))
    return statistics.match_histogram(a, b, "q").withColumn("matched", F.round("matched", 6))


@query(
    "pixel_arithmetic",
    """SELECT l_orderkey, l_linenumber, round(0.3 * l_quantity + 0.7 * l_tax, 6) AS blend, abs(l_quantity - 25) AS dist, (l_quantity - 25) * (l_quantity - 25) AS sq, greatest(l_quantity - 25, 0) AS relu, 50 - l_quantity AS complement,
    CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 7 ELSE 0 END AS band, round(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity > 40 THEN 255 ELSE (l_quantity - 10) * 8.5 END, 6) AS stretched,
    CAST(CASE WHEN l_discount * 10 >= 0 THEN floor(l_discount * 10 + 0.5) END AS BIGINT) AS rounded FROM lineitem""",
)
def pixel_arithmetic(spark, folder):
    q = F.col("l_quantity")
    return read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(arith.linear_combination(q, F.col("l_tax"), 0.3), 6).alias("blend"), arith.abs_diff(q, F.lit(25)).alias("dist"), arith.square_diff(q, F.lit(25)).alias("sq"),
        arith.relu_diff(q, F.lit(25)).alias("relu"), arith.complement(q, 50).alias("complement"), arith.threshold(q, 10, 20, 7).alias("band"), F.round(arith.linear_stretch(q, 10, 40, 0, 255), 6).alias("stretched"),
        arith.half_away(F.col("l_discount") * 10).alias("rounded"),
    )


@query(
    "scalar_maths",
    """SELECT p_partkey, round(1 / (1 + exp(-p_size / 10.0)), 6) AS sigmoid, round(ln(p_size) / ln(3), 6) AS log3, CAST(((p_size - 30) % 7 + 7) % 7 AS INT) AS pmod, factorial(p_size % 15) AS fact,
    CAST(pow(2, greatest(ceil(log2(p_size + 1)), 1)) - 1 AS BIGINT) AS full_range,
    (p_size > 1 AND NOT list_contains([p_size % d = 0 AND d < p_size FOR d IN range(2, 51)], true)) AS is_prime,
    round(p_size * p_size + (p_size - 3.0) * (p_size - 3.0), 6) AS sphere, round(100 * pow(p_size - 3.0 - CAST(p_size * p_size AS DOUBLE), 2) + pow(1 - p_size, 2), 2) AS rosenbrock FROM part""",
)
def scalar_maths(spark, folder):
    s = F.col("p_size")
    xs = [s.cast("double"), s.cast("double") - 3]
    return read(spark, folder, "part").select(
        "p_partkey", F.round(arith.sigmoid(s / 10.0), 6).alias("sigmoid"), F.round(arith.log_base(s, 3), 6).alias("log3"), arith.positive_mod(s - 30, 7).cast("int").alias("pmod"), F.factorial(s % 15).alias("fact"),
        arith.full_range(s).alias("full_range"), arith.is_prime(s).alias("is_prime"), F.round(arith.sphere(xs), 6).alias("sphere"), F.round(arith.rosenbrock(xs), 2).alias("rosenbrock"),
    )


@query(
    "test_functions",
    """SELECT event_id, round(value * value - 10 * cos(2 * pi() * value) + 10, 4) AS rastrigin, round(value * value / 4000 - cos(value) + 1, 4) AS griewank,
    round(-20 * exp(-0.2 * abs(value)) - exp(cos(2 * pi() * value)) + 20 + exp(1.0), 4) AS ackley FROM events""",
)
def test_functions(spark, folder):
    x = [F.col("value")]
    return read(spark, folder, "events").select("event_id", F.round(arith.rastrigin(x), 4).alias("rastrigin"), F.round(arith.griewank(x), 4).alias("griewank"), F.round(arith.ackley(x), 4).alias("ackley"))
