"""Joins of heavy keys and exact samples against plain forms."""

import pytest
from pyspark.sql import functions as F

from ratelens.operators import colocate as C
from ratelens.operators.heavy_join import heavy_keys, join_heavy
from ratelens.operators.sample import exact_sample, sample_number


@pytest.fixture()
def sides(spark):
    # key 1 holds a third of the detail rows, key 2 much of both sides; null keys, repeated rows, a key on one side only
    master = [(k, f"m{k}") for k in range(400)] + [(2, f"x{k}") for k in range(150)] + [(None, "none")] * 3 + [(900, "alone")] * 2
    detail = [(1 if k % 3 == 0 else 2 if k % 50 == 1 else k % 390, k % 600) for k in range(3000)] + [(None, 1)] * 5 + [(7, 7)] * 4
    return (
        spark.createDataFrame(master, "id long, row_salt string"),
        spark.createDataFrame(detail, "key int, amount long"),
    )


def test_join_heavy_equals_plain_join(spark, sides):
    m, d = sides
    heavy = {r["key"]: (r["left_salts"], r["right_salts"]) for r in heavy_keys(m, d, "id", "key").collect()}
    assert heavy[1][0] == 1 and heavy[1][1] >= 2 and heavy[2][0] >= 2 and len(heavy) < 16
    got = join_heavy(m, d, "id", "key")
    assert got.columns == ["id", "row_salt", "amount"]
    want = m.join(d, m["id"] == d["key"]).select("id", "row_salt", "amount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert join_heavy(m.limit(0), d, "id", "key").collect() == []
    assert join_heavy(m, d.limit(0), "id", "key").collect() == []


def test_heavy_key_spreads_and_light_keys_need_no_shuffle(spark, sides, scratch):
    m, d = sides
    C.save_bucketed(m, "id", "heavy_m", f"{scratch}/m")
    C.save_bucketed(d.select(F.col("key").cast("long"), "amount"), "key", "heavy_d", f"{scratch}/d")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = join_heavy(spark.table("heavy_m"), spark.table("heavy_d"), "id", "key")
        hot = got.where("id = 1").groupBy(F.spark_partition_id()).count().collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        # the two sides of the grid; the light keys' tables are joined as they are stored
        assert plan.count("Exchange hashpartitioning") == 2
        assert len(hot) >= 2 and max(r["count"] for r in hot) < 800
        want = m.join(d, m["id"] == d["key"]).count()
        assert got.count() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE heavy_m")
        spark.sql("DROP TABLE heavy_d")


def test_exact_sample(spark):
    rows = [(k // 3, f"v{k % 3}", None if k % 7 == 0 else k % 5) for k in range(999)] + [(5, "v0", 1)] * 30
    df = spark.createDataFrame(rows, "id long, name string, part long")
    for keys, n in ((["id", "name"], 100), (["id"], 101), (["part"], 333), (["part"], 1)):
        want = sorted(df.withColumn("h", sample_number(keys, 9)).collect(), key=lambda r: (r["h"], *(((v is not None), v or 0) for v in r[:3])))
        want = [tuple(r[:3]) for r in want[:n]]
        for parts in (1, 7):
            got = [tuple(r) for r in exact_sample(df.repartition(parts), keys, n, 9).collect()]
            assert sorted(got, key=str) == sorted(want, key=str), (keys, n)
    assert exact_sample(df, ["id"], 0).collect() == [] and exact_sample(df, ["id"], 5000).count() == len(rows)
    assert exact_sample(df.limit(0), ["id"], 5).collect() == []
    one, two = (set(map(tuple, exact_sample(df, ["id", "name"], 200, s).collect())) for s in (1, 2))
    assert one != two
