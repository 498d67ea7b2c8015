"""A keyed table that is updated by copy-on-write (S10, S12, C6 bucket store).

Rows live in hash parts of their key, and each part has two slots. An upsert
merges the new rows into the parts they touch and writes those into the slot that
is not in use, in one job; then it writes a manifest that names the slot of every
part. Readers follow the newest manifest, so a write that fails before its manifest
is not seen, and a store holds at most two copies of a part however often it is
updated. One writer at a time; a reader that outlives two upserts of a part must
reread.

    <path>/slot=<0|1>/part=<n>/...parquet
    <path>/manifest/slot=<0|1>/...json        one row: version, slots
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, slots array<int>, slot int"


class KeyedStore:
    """``schema``: the rows; ``key``: its key columns; ``order``: columns by which the
    last row of a key wins, then a row of the upsert over a stored one; ``parts``: hash parts."""

    def __init__(self, spark: SparkSession, path: str, schema, key, order, parts: int = 16):
        self.spark, self.path, self.key, self.order, self.parts = spark, path.rstrip("/"), list(key), list(order), parts
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def manifest(self) -> tuple[int, list[int]]:
        """(version, slot of each part; -1 without rows); version 0 is the empty store."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").collect()  # two rows at most
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        best = max(rows, key=lambda r: r["version"], default=None)
        return (best["version"], list(best["slots"])) if best else (0, [-1] * self.parts)

    def _stored(self, slots: list[int], only=None) -> DataFrame:
        wanted = [(s, p) for p, s in enumerate(slots) if s >= 0 and (only is None or p in only)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        held = T.StructType(self.schema.fields + [T.StructField("slot", T.IntegerType()), T.StructField("part", T.IntegerType())])
        by_slot = [F.col("part").isin(*[p for s, p in wanted if s == slot]) & (F.col("slot") == slot) for slot in (0, 1) if any(s == slot for s, _ in wanted)]
        chosen = by_slot[0] if len(by_slot) == 1 else by_slot[0] | by_slot[1]
        used = [f"{self.path}/slot={slot}" for slot in (0, 1) if any(s == slot for s, _ in wanted)]
        return self.spark.read.schema(held).option("basePath", self.path).parquet(*used).filter(chosen).select(*self.schema.names)

    def read(self) -> DataFrame:
        """The rows of the newest version; filters on key columns and others are pushed into its scan."""
        return self._stored(self.manifest()[1])

    def upsert(self, rows: DataFrame, keep=None) -> int:
        """Merge ``rows``: the last row of each key stays. ``keep``: a condition that
        rows of rewritten parts must meet to stay (a TTL). Returns the new version."""
        version, slots = self.manifest()
        part = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(self.parts)).cast("int")
        fresh = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("part", part)
        touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # as many as parts
        if not touched:
            return version
        old = self._stored(slots, set(touched)).withColumn("part", part)
        both = fresh.withColumn("_fresh", F.lit(1)).unionByName(old.withColumn("_fresh", F.lit(0)))
        last = Window.partitionBy("part", *self.key).orderBy(*[F.col(c).desc_nulls_last() for c in self.order], F.col("_fresh").desc())
        merged = both.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_fresh")
        merged = merged.filter(keep) if keep is not None else merged
        full = set(touched) if keep is None else {r["part"] for r in merged.select("part").distinct().collect()}
        target = [-1 if p in touched and p not in full else 1 - s if p in touched and s >= 0 else (0 if p in touched else s) for p, s in enumerate(slots)]
        slot = F.element_at(F.array(*[F.lit(s) for s in target]), F.col("part") + 1)  # an emptied part has no slot
        self._write(merged.withColumn("slot", slot))
        self._publish(version + 1, target)
        return version + 1

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "part").parquet(self.path)

    def _publish(self, version: int, slots: list[int]) -> None:
        row = self.spark.createDataFrame([(version, slots)], "version long, slots array<int>").coalesce(1)
        row.write.mode("overwrite").json(f"{self.path}/manifest/slot={version % 2}")


LIMIT_ROWS = "client_id string, limit_per_minute int, use_case_topic string, duplicate_ratio double, decided_at timestamp, valid_until timestamp"
RUN_ROWS = "topic string, experiment_mode string, total_events long, accepted long, rejected long, saved_at timestamp"
BUCKET_ROWS = "experiment_mode string, client_id string, tokens double, last_refill long, limit_per_minute int, bucket_capacity int"


def limit_store(spark: SparkSession, path: str) -> KeyedStore:
    """The current limit of each client, in (decided_at, topic) order."""
    return KeyedStore(spark, path, LIMIT_ROWS, ["client_id"], ["decided_at", "use_case_topic"])


def run_store(spark: SparkSession, path: str) -> KeyedStore:
    """The last run of each topic."""
    return KeyedStore(spark, path, RUN_ROWS, ["topic"], ["saved_at"])


def bucket_store(spark: SparkSession, path: str) -> KeyedStore:
    """The bucket of each (mode, client) between uploads."""
    return KeyedStore(spark, path, BUCKET_ROWS, ["experiment_mode", "client_id"], ["last_refill"])
