"""The dedup + metrics stream (C3) and its sinks.

Two queries share one enriched stream, each with its own checkpoint and
offsets: the clean-events file sink (exactly once through its commit log) and
the per-batch metrics sink (``foreachBatch``; the batch id partitions the
output, so a replayed batch overwrites itself instead of double counting).
Checkpoints live under ``spark.checkpoint.dir`` (the cluster's shared folder).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import decode_events, enrich_events
from ..operators.metrics import batch_metrics
from ..schema import DEFAULT_POLICY, METRICS_SCHEMA, SUBSCRIBE_PATTERN
from ..session import checkpoint_root
from ..sources.io import read_event_stream
from .dedup import dedup_stream


def event_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, servers: str | None = None,
                 pattern: str = SUBSCRIBE_PATTERN, **opts) -> DataFrame:
    """S1 + P1-P6: subscribed topics decoded and enriched."""
    raw = read_event_stream(spark, fmt, path=path, servers=servers, pattern=pattern, **opts)
    return enrich_events(decode_events(raw))


def write_clean_events(deduped: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append clean events to Parquet, exactly once through the sink's
    commit log. Each micro-batch writes up to one file per state partition;
    ``compact_table`` rewrites the accumulated small files offline."""
    w = (deduped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return (w.trigger(**trigger) if trigger else w).start()


def compact_table(spark: SparkSession, path: str, out: str, target_file_bytes: int = 128 * 1024 * 1024) -> int:
    """Rewrite a Parquet table (e.g. the clean-events sink) into files of about
    ``target_file_bytes``. The size comes from the file system's summary (metadata
    only); the rewrite is one distributed job. Returns the file count used."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(jpath).getLength()
    n = max(1, -(-int(size) // int(target_file_bytes)))
    spark.read.parquet(path).repartition(n).write.mode("overwrite").parquet(out)
    return n


def metrics_batch_writer(path: str, batch_time=None):
    """foreachBatch body. Metrics of the micro-batch by (topic, client),
    stamped with the batch time and written to ``batch_id=<id>`` with overwrite."""
    cols = [f.name for f in METRICS_SCHEMA.fields if f.name != "batch_id"]

    def write(batch_df: DataFrame, batch_id: int) -> None:
        bt = F.current_timestamp() if batch_time is None else F.lit(batch_time).cast("timestamp")
        m = batch_metrics(batch_df.withColumn("_b", F.lit(batch_id).cast("long")), batch_col="_b", time_col=None)
        m = m.withColumn("batch_time", bt).select(*cols)
        m.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def write_metrics(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  batch_time=None) -> StreamingQuery:
    w = events.writeStream.foreachBatch(metrics_batch_writer(path, batch_time)).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


@dataclass
class Pipeline:
    clean: StreamingQuery
    metrics: StreamingQuery

    def await_any(self, timeout: float | None = None):
        """Wait on either query, so a failure of the second one surfaces."""
        spark = self.clean.sparkSession
        return spark.streams.awaitAnyTermination(timeout) if timeout else spark.streams.awaitAnyTermination()

    def process_all_available(self):
        self.clean.processAllAvailable()
        self.metrics.processAllAvailable()

    def stop(self):
        self.clean.stop()
        self.metrics.stop()


def start_pipeline(spark: SparkSession, clean_path: str, metrics_path: str, fmt: str = "kafka",
                   source_path: str | None = None, servers: str | None = None, name: str = "replaygate",
                   delay: str = DEFAULT_POLICY.watermark, trigger: dict | None = None,
                   checkpoint_dir: str | None = None, **source_opts) -> Pipeline:
    """Start both queries. Restarting with the same
    ``checkpoint_dir`` resumes from the committed offsets and watermark."""
    root = checkpoint_dir or f"{checkpoint_root(spark)}/{name}"
    ev = event_stream(spark, fmt, path=source_path, servers=servers, **source_opts)
    clean = write_clean_events(dedup_stream(ev, delay), clean_path, f"{root}/clean_events", trigger)
    met = write_metrics(ev, metrics_path, f"{root}/client_event_metrics", trigger)
    return Pipeline(clean, met)


def admission_rate_stream(admitted: DataFrame, time_col: str = "event_ts", delay: str = "10 seconds",
                          window: str = "30 seconds", slide: str = "5 seconds", window_s: int = 30) -> DataFrame:
    """T12 / W4 on a stream: sliding-window rates, finalised once the watermark passes."""
    w = F.window(F.col(time_col), window, slide)
    out = admitted.withWatermark(time_col, delay).groupBy(w.alias("w")).agg(
        F.count_if(F.col("admitted")).alias("accepted"), F.count_if(~F.col("admitted")).alias("blocked"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      (F.col("accepted") / F.lit(float(window_s))).alias("accepted_per_s"),
                      (F.col("blocked") / F.lit(float(window_s))).alias("blocked_per_s"))


def running_counters(admitted: DataFrame) -> DataFrame:
    """Accepted / blocked per (client, topic), updated every batch (update mode)."""
    return admitted.groupBy("client_id", F.col("source_topic").alias("topic")).agg(
        F.count_if(F.col("admitted")).alias("accepted"), F.count_if(~F.col("admitted")).alias("blocked"))
