import os
import tempfile
import uuid

from tabsense.streaming.monitor import missing_stream


def test_missing_stream_counts(spark):
    d = tempfile.mkdtemp(prefix="tabsense-stream-")
    src = os.path.join(d, "in")
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    df.write.parquet(os.path.join(src, "batch1"))
    df.write.parquet(os.path.join(src, "batch2"))
    stream = missing_stream(spark, os.path.join(src, "*"), "a int, b string")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("tabsense_missing")
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = {r["column_name"]: (r["rows"], r["missing"]) for r in spark.table("tabsense_missing").collect()}
    assert rows == {"a": (6, 2), "b": (6, 4)}


def test_monitor_defaults_to_shared_checkpoint(spark):
    from tabsense.streaming.monitor import start_missing_monitor
    d = tempfile.mkdtemp(prefix="tabsense-stream-")
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, None), (None, "y")], "a int, b string").write.parquet(os.path.join(src, "b1"))
    table = "tabsense_monitor_" + uuid.uuid4().hex   # managed-table folders outlive the session catalog
    q = start_missing_monitor(spark, os.path.join(src, "*"), "a int, b string", table, available_now=True)
    q.awaitTermination(120)
    rows = {r["column_name"]: r["missing"] for r in spark.table(table).collect()}
    assert rows == {"a": 1, "b": 1}
