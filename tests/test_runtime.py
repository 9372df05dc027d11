from gistmap.runtime import checkpoint_dir, cut, scratch_table, ship, spread, width


def test_spread_touches_scans_only(spark):
    few = spark.range(10).coalesce(1)
    assert spread(spark.createDataFrame([(1,)], "a int").coalesce(1), 4).rdd.getNumPartitions() in (8, 1)
    grouped = few.groupBy("id").count()
    assert spread(grouped) is grouped
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide


def test_cuts_keep_rows(spark):
    assert checkpoint_dir(spark)
    df = spark.range(5)
    assert sorted(r.id for r in scratch_table(df, "t").collect()) == sorted(r.id for r in cut(df).collect()) == list(range(5))


def test_ship_once(spark):
    ship(spark)
    ship(spark)
    assert width(spark) >= 4
