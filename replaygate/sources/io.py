"""Sources and sinks.

Topic logs are read and written through a ``fmt`` switch: ``kafka`` uses the
Kafka connector when its package is on the classpath; ``files`` uses a folder
per topic (``<path>/topic=<name>/``) of JSON-text messages, which the streams read;
``log`` is a Parquet log with partitions and offsets
(``<path>/topic=<name>/partition=<p>/``): an offset is a message's row position in
its file plus the rows of the partition's earlier files. Tables (metrics, limits, runs) are
Parquet; Delta/Iceberg can be swapped in through ``fmt`` where installed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_payload
from ..operators.enrich import encode_events
from ..schema import (DEFAULT_POLICY, EVENT_SCHEMA, LIMITS_SCHEMA, METRICS_SCHEMA, RUNS_SCHEMA,
                      SUBSCRIBE_PATTERN, Policy)

_FILE_SCHEMA = "value string, topic string"


# --------------------------------------------------------------------------- topic logs

def read_event_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                      servers: str | None = None, pattern: str = SUBSCRIBE_PATTERN,
                      starting_offsets: str = "earliest", **opts) -> DataFrame:
    """Subscribe to every topic matching ``pattern`` from the earliest offset.
    Returns (topic, value[, partition, offset]). New matching topics join a running query."""
    if fmt == "kafka":
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
             .option("subscribePattern", pattern).option("startingOffsets", starting_offsets))
        for k, v in opts.items():
            r = r.option(k, v)
        return r.load().select("topic", "value", "partition", "offset")
    r = spark.readStream.format("text")
    for k, v in opts.items():
        r = r.option(k, v)
    df = r.schema(_FILE_SCHEMA).load(path)
    return df.filter(F.col("topic").rlike(f"^(?:{pattern})$")).select("topic", "value")


def read_topic(spark: SparkSession, topic: str, fmt: str = "kafka", path: str | None = None,
               servers: str | None = None, n: int | None = None) -> DataFrame:
    """Bounded read of one topic from the beginning; the first ``n`` messages
    in (partition, offset) order when given (taking n is the feature, as in a console
    consumer). Of a folder of text files they come file by file, line by line."""
    if fmt == "kafka":
        df = (spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", "earliest").load()
              .select("topic", "partition", "offset", F.col("value").cast("string").alias("value")))
        order = ["partition", "offset"]
    elif fmt == "log":
        df, order = read_log(spark, path, topic), ["partition", "offset"]
    else:
        df = spark.read.schema(_FILE_SCHEMA).text(path).filter(F.col("topic") == F.lit(topic)).select(
            "topic", "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
        order = ["_file", "_start", "_row"]  # a block of a file is read by one task, in line order
    df = df.orderBy(*order).limit(int(n)) if n is not None else df
    return df.drop("_file", "_start", "_row")


def write_events(df: DataFrame, fmt: str = "kafka", path: str | None = None, servers: str | None = None,
                 mode: str = "append") -> None:
    """Publish events as JSON to the topic named in each row (no key)."""
    msgs = encode_events(df)
    if fmt == "kafka":
        msgs.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        msgs.write.mode(mode).partitionBy("topic").text(path)


_LOG_SCHEMA = "value string, topic string, partition int"


def write_log(df: DataFrame, path: str, partitions: int = 4, order=("us", "event_id"), partition=None, topic_col: str = "source_topic") -> None:
    """S6 into a log: append events as JSON messages, each partition in ``order``.
    Without a ``partition`` expression messages are dealt by a hash of ``order``, as
    a producer without keys does. A partition is written by one task; the number of
    partitions bounds how much that is."""
    part = F.pmod(F.xxhash64(*order), F.lit(partitions)).cast("int") if partition is None else partition.cast("int")
    msgs = encode_events(df, topic_col, keep=tuple(order)).withColumn("partition", part)
    (msgs.repartition("topic", "partition").sortWithinPartitions("topic", "partition", *order)
         .select("value", "topic", "partition").write.mode("append").partitionBy("topic", "partition").parquet(path))


def read_log(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """(topic, partition, offset, value) of a log. Files of a partition follow each
    other in the order they were written; only the table of files is summed over."""
    rows = spark.read.schema(_LOG_SCHEMA).parquet(path).select(
        "topic", "partition", "value", F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("written"))
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    files = rows.groupBy("topic", "partition", "written", "file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("topic", "partition").orderBy("written", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("topic", "partition", "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, ["topic", "partition", "file"]).select("topic", "partition", (F.col("base") + F.col("row")).alias("offset"), "value")


# --------------------------------------------------------------------------- uploads

def _header_cells(spark: SparkSession, path: str) -> int:
    """As many cells as the widest header can have: its commas, quoted ones too, and one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    heads = lines.filter("start = 0 and value rlike '[^ \\t\\r]'").groupBy("file").agg(F.min_by("value", "row").alias("head"))
    return heads.agg(F.max(F.size(F.split("head", ",", -1)))).first()[0] or 1


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV upload. Each file's own header row names its columns, in any order;
    '"' quotes with '""' escapes, every cell trimmed, blank lines skipped; a missing
    or empty cell reads as ''. Only the five event fields are kept; payload text
    becomes a map (P11), an empty event_time becomes NULL.

    Cells are read by position together with the file they come from. A file's
    header is the first row of its first split; it is looked up per file. As many
    cells are read as the widest header has."""
    cells = [f"_{i}" for i in range(_header_cells(spark, path))]
    raw = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", False).option("quote", '"').option("escape", '"')
           .option("nullValue", "\u0000").option("emptyValue", "").option("mode", "PERMISSIVE").csv(path))
    rows = raw.select(F.array(*[F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^\\ufeff", "")) for c in cells]).alias("cells"),
                      F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    heads = rows.filter("start = 0").groupBy("file").agg(F.min("row").alias("head"), F.min_by("cells", "row").alias("names"))
    body = rows.join(heads, "file").filter("row <> head")

    def cell(c):
        at = F.array_position("names", F.lit(c)).cast("int")
        return F.when(at > 0, F.get("cells", at - 1)).otherwise(F.lit(""))
    return body.select(
        cell("client_id").alias("client_id"), cell("event_type").alias("event_type"),
        cell("entity_id").alias("entity_id"),
        F.nullif(cell("event_time"), F.lit("")).alias("event_time"),
        parse_payload(cell("payload")).alias("payload"),
    )


_UPLOAD_SCHEMA = EVENT_SCHEMA


def read_events_jsonl(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One JSON event per line. FAILFAST (default) fails the load on any bad
    line, as an upload does; PERMISSIVE keeps bad lines in ``_corrupt_record``."""
    schema = _UPLOAD_SCHEMA
    r = spark.read.option("mode", mode)
    if mode == "PERMISSIVE":
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    return r.schema(schema).json(path)


def read_events_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON array of events. Anything else at the top level,
    and any bad element, fails the load."""
    text = spark.read.text(path, wholetext=True)
    array = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.raise_error(F.lit("the top level of a JSON upload must be an array")))
    parsed = F.from_json(array, T.ArrayType(_UPLOAD_SCHEMA), {"mode": "FAILFAST"})
    return text.select(F.explode(parsed).alias("event")).select("event.*")


# --------------------------------------------------------------------------- tables

def write_metrics_table(metrics: DataFrame, path: str) -> None:
    """Batch write of metric rows partitioned by batch_id; rewriting a batch
    replaces only that batch's partition (idempotent)."""
    cols = [f.name for f in METRICS_SCHEMA.fields]
    (metrics.select(*[F.col(c) for c in cols]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def write_metrics_by_date(metrics: DataFrame, path: str) -> None:
    """Metric rows in (metrics_date, batch_id) partitions of their batch
    time. Writing a batch again replaces its partition."""
    cols = [f.name for f in METRICS_SCHEMA.fields]
    (metrics.select(*cols, F.to_date("batch_time").alias("metrics_date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("metrics_date", "batch_id").parquet(path))


def read_metrics_by_date(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Metric rows with ``since`` <= batch_time <= ``until``; the dates of the
    bounds prune partitions before any file is opened."""
    rows = spark.read.schema(T.StructType(METRICS_SCHEMA.fields + [T.StructField("metrics_date", T.DateType())])).parquet(path)
    for bound, op in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            rows = rows.filter(getattr(F.col("metrics_date"), op)(F.to_date(at))).filter(getattr(F.col("batch_time"), op)(at))
    return rows.drop("metrics_date")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Scan the metrics store (filters on batch_time / batch_id prune files and row groups)."""
    return spark.read.schema(METRICS_SCHEMA).parquet(path)


def write_limits(decisions: DataFrame, path: str) -> None:
    """Append decisions to the limit history (read back as-of, J2 / S11)."""
    (decisions.select(F.col("client_id"), F.col("new_limit_per_minute").cast("int").alias("limit_per_minute"),
                      "use_case_topic", "duplicate_ratio", "decided_at", "valid_until")
     .write.mode("append").parquet(path))


def read_limits(spark: SparkSession, path: str, as_of=None, client_id: str | None = None) -> DataFrame:
    """The limits in force at ``as_of`` (TTL applied, last write wins per client)."""
    from ..operators.limits import current_limits
    hist = spark.read.schema(LIMITS_SCHEMA).parquet(path)
    if client_id is not None:
        hist = hist.filter(F.col("client_id") == F.lit(client_id))
    return current_limits(hist.withColumnRenamed("limit_per_minute", "new_limit_per_minute"), as_of=as_of)


def write_runs(runs: DataFrame, path: str) -> None:
    """Append experiment runs; the store keeps one live row per topic on read."""
    cols = [f.name for f in RUNS_SCHEMA.fields]
    runs.select(*cols).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, as_of=None, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Live runs: latest row per topic, saved within the run TTL before ``as_of``; topic order."""
    runs = spark.read.schema(RUNS_SCHEMA).parquet(path)
    if as_of is not None:
        at = F.lit(as_of).cast("timestamp")
        runs = runs.filter((F.col("saved_at") <= at)
                           & (F.col("saved_at") > at - F.expr(f"INTERVAL {int(policy.run_ttl_s)} SECONDS")))
    latest = runs.groupBy("topic").agg(F.max_by(F.struct(*[c for c in runs.columns]), F.col("saved_at")).alias("_r"))
    return latest.select("_r.*").orderBy("topic")
