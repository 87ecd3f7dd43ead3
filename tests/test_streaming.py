from pyspark.sql import functions as F

from lakequill.streaming.windows import counts, events_stream, sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_a_stream_counts_as_a_batch_does(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts(events_stream(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("counted").collect()}
    assert got == {(r.window_start, r.event_type): r.n for r in counts(batch).collect()}
    assert sum(got.values()) == batch.count()


def test_sessions_hold_all_events(spark):
    batch = spark.read.parquet(EVENTS)
    assert sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
