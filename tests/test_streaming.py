from scanloom.sources import catalog
from scanloom.streaming.sessions import session_counts


def test_sessions_of_a_stream_are_those_of_the_batch(spark, small, tmp_path):
    events = catalog.table(spark, small, "events").selectExpr("user_id as det", "ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = session_counts(stream, "ts", "det", "6 hours", "40 days").writeStream.outputMode("append").format("memory").queryName("sessions").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = session_counts(events, "ts", "det", "6 hours", "40 days")
    assert batch.agg({"n": "sum"}).first()[0] == events.count()
    assert spark.table("sessions").exceptAll(batch).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
