import datetime as dt

from pyspark.sql import functions as F

from ratelens.sources.snapshots import SnapshotStore, stamp_load_date


def test_capture_dynamic_overwrite_and_as_of(spark, scratch):
    store = SnapshotStore(spark, f"{scratch}/store")
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, v double")
    store.capture(a, 2025, 3)
    store.capture(a.withColumn("v", F.col("v") + 1), 2025, 4)
    assert store.read().count() == 4  # April did not replace March
    store.capture(a.limit(1), 2025, 3)  # re-capture March only
    assert store.month(2025, 3).count() == 1 and store.month(2025, 4).count() == 2
    assert {r.v for r in store.as_of("2025-04-15").collect()} == {10.0}
    assert {r.v for r in store.as_of("2025-04-30").collect()} == {11.0, 21.0}
    snaps = {(r.year, r.month): r.expired for r in store.list_snapshots(30, today="2025-05-15").collect()}
    assert snaps == {(2025, 3): True, (2025, 4): False}


def test_capture_partition_of_partitioned_table(spark, scratch):
    store = SnapshotStore(spark, f"{scratch}/base")
    t = stamp_load_date(spark.createDataFrame([(1,), (2,)], "id int"), dt.datetime(2025, 3, 5))
    t = t.unionByName(stamp_load_date(spark.createDataFrame([(3,)], "id int"), dt.datetime(2025, 4, 2)))
    store.capture(t, 2025, 3)
    assert sorted(r.id for r in store.read().collect()) == [1, 2]
    assert store.month(2025, 3).where("load_date IS NOT NULL").count() == 2


def test_clustered_write_orders_row_groups(spark, scratch):
    from ratelens.sources.snapshots import clustered_write

    df = spark.range(0, 2000).select(((F.col("id") * 7919) % 2000).alias("rate"), F.col("id"))
    clustered_write(df, f"{scratch}/clustered", ["rate"], num_files=4)
    back = spark.read.parquet(f"{scratch}/clustered")
    assert back.count() == 2000
    # each file holds one contiguous range of the clustering column
    ranges = back.groupBy(F.input_file_name()).agg(F.min("rate").alias("lo"), F.max("rate").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))


def test_critical_view_and_save_table(spark):
    from ratelens.plans.monitor import critical_view
    from ratelens.sources.tables import read_source, save_table

    df = spark.createDataFrame([(1, 2.0, "a")], "id int, rate double, code string").withColumn("ts", F.current_timestamp())
    v = critical_view(df, ["rate"], "ts", name="critical_v")
    assert v.columns == ["rate", "ts"] and spark.table("critical_v").columns == ["rate", "ts"]
    save_table(v.select("rate"), "saved_rates")
    assert read_source(spark, "saved_rates").first().rate == 2.0


def test_capture_of_an_emptied_month_leaves_no_row(spark, scratch):
    store = SnapshotStore(spark, f"{scratch}/emptied")
    t = stamp_load_date(spark.createDataFrame([(1,)], "id int"), dt.datetime(2025, 3, 5))
    store.capture(t, 2025, 3)
    store.capture(t.withColumns({"month": F.lit(4)}), 2025, 4)
    store.capture(t.where("id > 1"), 2025, 3)
    assert store.month(2025, 3).count() == 0 and store.month(2025, 4).count() == 1
