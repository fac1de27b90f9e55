"""Missing-value report (H4) over a folder that receives new files.

A Structured Streaming aggregation: each arriving micro-batch is unpivoted
to (column_name, is_missing) and folded into a running count per column.
State is one row per column (bounded by the schema), so the query runs
for as long as files keep arriving.  The caller chooses the sink and the
trigger; the checkpoint location must be a shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import is_floating, q
from tabsense.session import checkpoint_dir


def missing_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Streaming DataFrame (column_name, rows, missing, missing_pct), to be
    written in ``complete`` output mode."""
    src = spark.readStream.schema(schema).format(fmt).load(path)
    fields = src.schema.fields
    flags = F.array(*[F.struct(F.lit(f.name).alias("column_name"),
                               (q(f.name).isNull() | (F.isnan(q(f.name)) if is_floating(f.dataType) else F.lit(False)))
                               .cast("long").alias("m")) for f in fields])
    long = src.select(F.explode(flags).alias("s")).select("s.column_name", "s.m")
    return long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("m").alias("missing"),
        F.bround(F.sum("m") / F.count(F.lit(1)) * 100, 2).alias("missing_pct"))


def start_missing_monitor(spark: SparkSession, path: str, schema, out_table: str, checkpoint: str | None = None,
                          fmt: str = "parquet", available_now: bool = False):
    """Start the monitor writing the running report to a table (complete
    mode, replaced each micro-batch through ``foreachBatch``).

    Without ``checkpoint`` the state lives in a fixed folder per output table
    under the session's shared ``spark.checkpoint.dir``, so a restarted
    monitor resumes where it stopped."""
    if checkpoint is None:
        base = checkpoint_dir(spark)
        if not base:
            raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir")
        checkpoint = f"{base.rstrip('/')}/tabsense-missing-monitor/{out_table}"
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").saveAsTable(out_table)

    w = missing_stream(spark, path, schema, fmt).writeStream.outputMode("complete") \
        .option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
