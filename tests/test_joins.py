"""Size-checked broadcast and lineage helpers."""

from ledgermatch.plans.joins import Size, checked_broadcast, materialize, measure


def test_measure_counts_text_as_it_is(spark):
    df = spark.createDataFrame([(1, "a" * 1000), (2, None)], "id bigint, s string")
    assert measure(df) == Size(2, 1000 + 16 * 2 * 3)
    assert measure(df.limit(0)) == Size(0, 0)


def test_checked_broadcast_row_and_byte_bounds(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) as s")
    size = measure(df)
    assert checked_broadcast(df, 100)[1] is True
    assert checked_broadcast(df, 99)[1] is False
    assert checked_broadcast(df, 1000, max_bytes=size.bytes)[1] is True
    assert checked_broadcast(df, 1000, max_bytes=size.bytes - 1)[1] is False


def test_materialize_keeps_rows(spark):
    df = spark.range(50).selectExpr("id * 2 as x")
    m = materialize(df)
    assert m.count() == 50 and m.agg({"x": "sum"}).first()[0] == 2450
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
