"""Streaming writers. Progress (offsets, commits) lives in the checkpoint
folder, so a restarted query resumes where it stopped: no lost and no
repeated rows in file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.quality import tag_rejects
from tidewater.operators.relations import latest_by_key
from tidewater.session import shared_dir


def _trigger(writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)


def bronze_ingest(stream: DataFrame, path: str | None, checkpoint: str,
                  table: str | None = None, trigger: str | None = None,
                  partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append raw events with an ``ingest_ts`` column to a parquet folder or
    a catalog table. Rows per micro-batch are reported as observed metrics
    (``bronze`` in the query progress), computed in the same pass."""
    out = (stream.withColumn("ingest_ts", F.current_timestamp())
           .observe("bronze", F.count(F.lit(1)).alias("rows")))
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = _trigger(writer, trigger)
    if table:
        return writer.toTable(table)
    return writer.start(path)


def validate_stream(stream: DataFrame, out_path: str, checkpoint: str,
                    trigger: str | None = None) -> StreamingQuery:
    """Tag each event with its first broken rule and append it under
    ``status=valid`` or ``status=quarantine`` in one pass. Rows and rejected
    rows per micro-batch are reported as observed metrics (``validation``)."""
    tagged = (tag_rejects(stream).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), F.lit("valid"))
                   .otherwise(F.lit("quarantine")))
        .observe("validation", F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")))
    writer = (tagged.writeStream.outputMode("append").format("parquet")
              .partitionBy("status").option("checkpointLocation", checkpoint))
    return _trigger(writer, trigger).start(out_path)


def running_aggregate(stream: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                      out_path: str, checkpoint: str,
                      trigger: str | None = None) -> StreamingQuery:
    """Running totals per key in complete mode (state stays in the state
    store; nothing is gathered on the driver).

    Each micro-batch writes the full current table into one of two slots
    (``slot = epoch % 2``) with dynamic partition overwrite, tagged with its
    epoch, and then appends the epoch to ``<out_path>_epochs``.
    ``read_running_result`` reads the newest epoch found there, so a batch that
    fails while its slot is being replaced, or a store where a folder appears
    file by file, never shows a part of a result."""
    agg = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch_id).cast("bigint"))
              .withColumn("slot", F.lit(epoch_id % 2))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("slot").parquet(out_path))
        done = batch.sparkSession.range(1).select(F.lit(epoch_id).cast("bigint").alias("epoch"))
        done.write.mode("append").parquet(epochs_path(out_path))

    writer = (agg.writeStream.outputMode("complete")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(write_batch))
    return _trigger(writer, trigger).start()


def epochs_path(out_path: str) -> str:
    """Where ``running_aggregate`` notes the epochs it has written whole."""
    return f"{out_path.rstrip('/')}_epochs"


def read_running_result(spark, out_path: str) -> DataFrame:
    """The newest complete result written by ``running_aggregate``."""
    newest = spark.read.parquet(epochs_path(out_path)).agg(F.max("epoch")).first()[0]
    slot = spark.read.parquet(out_path).filter(F.col("slot") == newest % 2)
    return slot.filter(F.col("epoch") == newest).drop("epoch", "slot")


def running_updates(stream: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], out_path: str,
                    checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Running totals per key that write only what changed: each micro-batch
    appends the new totals of the keys it touched (update mode) under
    ``epoch=<n>``, and a batch that is repeated after a failure replaces its
    own epoch. ``read_running_updates`` gives the newest totals per key,
    ``compact_running`` folds finished epochs into one.

    Work per batch grows with the keys of the batch, not with all keys seen;
    the writer's list of finished epochs is the stream's own commit log."""
    agg = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch_id).cast("bigint"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("epoch").parquet(out_path))

    writer = (agg.writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(write_batch))
    return _trigger(writer, trigger).start()


def finished_epochs(spark: SparkSession, checkpoint: str) -> list[int]:
    """The micro-batches that a stream has committed, from its checkpoint
    folder on any Hadoop file system (Spark keeps the last hundred)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def read_running_updates(spark: SparkSession, out_path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """The newest totals per key among committed micro-batches: rows of a
    batch that is still being written are not seen."""
    last = (finished_epochs(spark, checkpoint) or [-1])[-1]
    rows = spark.read.parquet(out_path).filter(F.col("epoch") <= last)
    return latest_by_key(rows, list(keys), ["epoch"]).drop("epoch")


def compact_running(spark: SparkSession, out_path: str, checkpoint: str, keys: Sequence[str]) -> int:
    """Fold all committed epochs into the newest of them and remove the older
    ones; returns how many were removed. To be run between micro-batches (or
    by the job that runs the stream, after it); a crash in between leaves
    epochs that the next run folds again, with the same result, as the newest
    epoch is replaced as a whole before older ones go."""
    done = finished_epochs(spark, checkpoint)
    if not done:
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    epochs = sorted(int(n.split("=", 1)[1]) for f in fs.listStatus(folder) if (n := f.getPath().getName()).startswith("epoch="))
    old = [e for e in epochs if e < done[-1]]
    if not old:
        return 0
    newest = max(e for e in epochs if e <= done[-1])
    # Through a folder of its own: what is read is about to be replaced.
    merged = shared_dir(spark, "compacted")
    latest_by_key(spark.read.parquet(out_path).filter(F.col("epoch") <= newest), list(keys), ["epoch"]).write.parquet(merged)
    (spark.read.parquet(merged).withColumn("epoch", F.lit(newest).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_path))
    gone = [e for e in old if e != newest]
    for e in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out_path.rstrip('/')}/epoch={e}"), True)
    return len(gone)
