import pytest

from trackwell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_is_covered():
    assert set(catalog.SQL) == set(catalog.QUERIES) - {"scan_recorded"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_streamed_tracks_equal_those_in_batch(spark):
    """Over five videos: all frames of ended ones, all but the newest of one that goes on."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in catalog.QUERIES["tracker_stream"](spark, d).collect())
    whole = catalog.QUERIES["tracker_full"](spark, d).collect()
    open_ = {r.video_id: r.last for r in catalog._faces(spark, d)[0].groupBy("video_id").agg(F.max("frame_index").alias("last")).collect() if r.last % 250 != 249}
    assert got and got == sorted(tuple(r) for r in whole if r.frame_index != open_.get(r.video_id))
