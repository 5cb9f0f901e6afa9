from pyspark.sql import functions as F

from arborgrid.plans import grouped_rank, take_smallest
from arborgrid.operators import sampling


def frame(spark):
    rows = [("hot", i) for i in range(2000)] + [("small", i) for i in range(3)] + [(None, i) for i in range(5)]
    return spark.createDataFrame(rows, "g string, id long")


def test_rank_equals_a_sort(spark):
    df = frame(spark).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
    got = grouped_rank(df, ["g"], F.col("h"), ["id"]).toPandas()
    for _, g in got.groupby("g", dropna=False):
        assert g.sort_values(["h", "id"])["rank"].tolist() == list(range(1, len(g) + 1))


def test_smallest_with_ties_nulls_and_large_quotas(spark):
    df = frame(spark).withColumn("q", F.when(F.col("g") == "hot", 7).when(F.col("g") == "small", 99).otherwise(2)).withColumn("h", F.lit(5))
    got = take_smallest(df, ["g"], F.col("h"), "q", ["id"]).toPandas()
    assert {k if isinstance(k, str) else None: sorted(v) for k, v in got.groupby("g", dropna=False)["id"]} == {"hot": list(range(7)), "small": [0, 1, 2], None: [0, 1]}
    assert take_smallest(df.withColumn("q", F.lit(None).cast("int")), ["g"], F.col("h"), "q", ["id"]).count() == 0
    assert take_smallest(df.limit(0), ["g"], F.col("h"), "q", ["id"]).count() == 0


def test_folds_are_balanced(spark):
    for seed in (None, 3):
        got = sampling.kfold(frame(spark).where("g = 'hot'"), "id", 5, ["g"], seed=seed).toPandas()
        assert got.fold.value_counts().tolist() == [400] * 5
    assert sampling.kfold(frame(spark).where("g = 'hot'"), "id", 5, ["g"], seed=None).where("fold <> id % 5").count() == 0


def test_samples_by_stratum(spark):
    df = frame(spark).where("g IS NOT NULL")
    assert sampling.stratified(df, "id", 4, ["g"]).groupBy("g").count().toPandas().set_index("g")["count"].to_dict() == {"hot": 4, "small": 3}
    assert sampling.proportional(df, "id", 0.1, ["g"]).groupBy("g").count().toPandas().set_index("g")["count"].to_dict() == {"hot": 200, "small": 1}
