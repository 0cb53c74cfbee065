import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common


@pytest.mark.parametrize("limit, bits", [(100, 64), (0, 1 << 20), (0, 1 << 15), (0, 64)])
def test_split_rows_is_exact(spark, limit, bits):
    """With keys broadcast, and with bitmaps that fit, crowd and are full."""
    rows = [(i % 60 or None, f"t{i % 90}" if i % 7 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, _key int").repartition(3)
    key = common.content_key("id", "text")
    keys = common.cut(df.filter("_key % 4 = 1").select(key.alias("_key")).distinct())
    wanted = {(r[0], r[1]) for r in rows if r[2] % 4 == 1}
    inside, outside = common.split_rows(df, key, keys, limit, bits)
    assert inside.columns == outside.columns == df.columns
    assert sorted(r._key for r in inside.collect()) == [r[2] for r in rows if r[:2] in wanted]
    assert sorted(r._key for r in outside.collect()) == [r[2] for r in rows if r[:2] not in wanted]
    gone, all_of_them = common.split_rows(df, key, keys.filter("false"), limit, bits)
    assert gone.count() == 0 and all_of_them.count() == 600
    assert common.split_rows(df.filter("false"), key, keys, limit, bits)[1].count() == 0


def test_wide_rows_stay_out_of_shuffles(spark):
    df = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 50).alias("text"))
    keys = common.cut(df.filter("id < 30").select(common.content_key("id", "text").alias("_key")))
    _, outside = common.split_rows(df, common.content_key("id", "text"), keys, 0)
    plan = outside.filter("id > 40")._jdf.queryExecution().executedPlan().toString()
    assert outside.count() == 970 and "Union" in plan
