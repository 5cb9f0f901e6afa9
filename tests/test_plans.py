import pytest

from arborgrid.plans import Scratch, lookup


@pytest.mark.parametrize("how", ["inner", "left"])
def test_big_keys_meet_their_table_like_others(spark, how):
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(900)] + [(None, -1), (5000, -2)], "k long, v long")
    table = spark.createDataFrame([(i, f"t{i}") for i in range(900)], "k long, name string")
    want = sorted(tuple(r) for r in rows.join(table, "k", how).collect() if True) if how == "inner" else None
    got = [tuple(r) for r in lookup(rows, table, "k", how, task_rows=10).select("k", "v", "name").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [tuple(r) for r in lookup(rows, table, "k", how).select("k", "v", "name").collect()]))
    assert want is None or sorted(got) == want
    assert lookup(rows.limit(0), table, "k", how, task_rows=-1).count() == 0


def test_scratch_tables_are_dropped(spark):
    scratch = Scratch(spark)
    t = scratch.put(spark.range(5))
    assert t.count() == 5
    scratch.drop(t)
    with pytest.raises(Exception):
        t.count()
