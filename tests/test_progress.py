"""Observed totals equal aggregates, in batch and over the micro-batches of a stream."""

from pyspark.sql import functions as F

from trackwell.streaming import progress


def test_batch_totals_come_with_the_action(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame, watch = progress.observed(events, "batch", "event_id", {"users": F.max("user_id")})
    frame.write.format("noop").mode("overwrite").save()
    want = events.agg(*[c.alias(n) for n, c in {**progress.totals("event_id"), "users": F.max("user_id")}.items()]).first()
    assert watch.get == want.asDict()
    none, watch = progress.observed(events.where("false"), "none", "event_id")
    none.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 0, "first": None, "last": None}


def test_stream_totals_add_up(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    listener = progress.StreamProgress("frames")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen, watch = progress.observed(stream, "frames", "event_id")
        assert watch is None
        query = seen.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert listener.ended.wait(20)
    finally:
        spark.streams.removeListener(listener)
    n, first, last = events.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()
    assert (listener.rows, listener.first, listener.last) == (n, first, last) and listener.batches >= 4
    assert listener.share(n) == 100 and listener.share(2 * n) == 50 and listener.share(n + 1) == 99
