"""Helpers shared by the text operators: whole-batch word splitting and ragged sums."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import threading
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, table_path

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 4_000_000

#: Bits of the map by which rows without a partner stay out of a shuffle: 2 MB.
MET_BITS = 1 << 24

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES = threading.local()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: cuts the
    lineage, survives lost executors, and later readers prune its columns. The
    shuffle files of the write go with it. In a `releasing` function the table is
    deleted when nothing that the function returns reads it."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if _scopes():
        _scopes()[-1].add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Spark deletes the shuffle files of the queries run here as soon as they end."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def _scopes() -> list[set[str]]:
    """Paths of the tables stored in each `releasing` function that runs in this thread, the innermost last."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    return _SCOPES.open


def _read_by(df: DataFrame, paths: set[str]) -> set[str]:
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    return {p for p in paths if p.rsplit("/", 1)[-1] in folders}


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete what the running `releasing` function stored and `tables` read; nothing
    may read it afterwards. Tables stored elsewhere stay."""
    scope = _scopes()[-1] if _scopes() else set()
    for df in tables:
        paths = _read_by(df, scope)
        _delete(df.sparkSession, paths)
        scope -= paths


def releasing(operator):
    """`operator`, a function that returns a DataFrame: when it ends, the tables that
    it stored and that its result does not read are deleted. The others pass to the
    `releasing` function that called it, if any, else they stay. If it fails, all stay."""
    @functools.wraps(operator)
    def run(*args, **kwargs):
        scope: set[str] = set()
        _scopes().append(scope)
        try:
            out = operator(*args, **kwargs)
        finally:
            _scopes().pop()
        kept = _read_by(out, scope)
        _delete(out.sparkSession, scope - kept)
        if _scopes():
            _scopes()[-1].update(kept)
        return out

    return run


def numbered(df: DataFrame, row_col: str) -> DataFrame:
    """`df` with distinct longs in `row_col`, the same whenever it is read, that rise
    with a row's place. The rows of Parquet files are numbered by file and place in
    it, without a copy; any other table is stored with its numbers."""
    placed = None
    if df._jdf.queryExecution().analyzed().children().isEmpty():  # a joined or exploded row shares its place with others
        with suppress(AnalysisException):
            placed = df.withColumns({"__file": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
    if placed is None:
        return stored(df.withColumn(row_col, F.monotonically_increasing_id()), "numbered")
    files = placed.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
    row = F.shiftleft("__number", 40) + F.col("__place")  # a row a file in the window, as many as the driver lists
    return placed.join(F.broadcast(stored(files, "files")), "__file").select(*df.columns, row.alias(row_col))


def with_met(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """`df` with __met: false only where no row of `keys` (one column) equals `key`;
    nulls equal each other. The map behind it has MET_BITS bits whatever the number
    of keys. It spares rows a shuffle; an exact join has to follow."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(MET_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__place") % 64).cast("int"))
    places = keys.select(place(F.col(keys.columns[0])).alias("__place"))
    bits = stored(places.groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")), "met")
    out = df.withColumn("__place", place(key)).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(bits), "__word", "left")
    return out.select(*df.columns, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)).alias("__met"))


def left_joined(df: DataFrame, key: Column, other: DataFrame, other_key: str, on) -> DataFrame:
    """`df` left joined with `other` by the condition `on`, which implies that `key`
    equals `other_key`; rows without a partner mostly stay out of the shuffle."""
    met = with_met(df, key, other.select(other_key))
    alone = met.filter("not __met").drop("__met")
    for f in other.schema:
        alone = alone.withColumn(f.name, F.lit(None).cast(f.dataType))
    return met.filter("__met").drop("__met").join(other, on, "left").unionByName(alone)


def slices(batch: pa.RecordBatch, text: str):
    """Parts of a batch whose text column holds about SLICE_BYTES each. Parts are
    copies: some Arrow kernels misread an array that begins inside its buffers."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b - a == batch.num_rows:
            yield batch
        elif b > a:
            yield batch.take(pa.array(np.arange(a, b)))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): words are the runs of bytes other than 0x20 and 0x09-0x0D
    in each text; row i holds words[offsets[i]:offsets[i + 1]]; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    off = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(off[0], off[-1] - off[0])
    off = off - off[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        off = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[off]
        words = words.filter(pa.array(full))
    return off, words


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words) of split_words()."""
    off, words = split_words(texts)
    coded = words.dictionary_encode()
    return off, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each row i; 0 for an empty row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def ragged_take(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[off[r]:off[r + 1]] over rows, and its own offsets."""
    sizes = (off[1:] - off[:-1])[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out[-1]) + np.repeat(off[:-1][rows] - out[:-1], sizes)
    return flat[at], out


_HELD: dict[str, object] = {}
_LIBC = ctypes.CDLL(None)


def held_in_worker(name: str, make):
    """The object `name` of this Python worker, made on first use. A worker holds one
    such object: that of another operator is let go, since workers are used again by
    the jobs that follow."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[name] = make()
    return _HELD[name]


def letting_go(batches):
    """The batches; afterwards free memory goes back to the system, since the worker
    waits beside those of other stages."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def unburdened(batches):
    """The batches, in a worker that holds nothing of the operators it ran before."""
    _HELD.clear()
    return letting_go(batches)


class RaggedCache:
    """Integer rows of strings in flat arrays. Its memory is bounded: past `limit`
    keys it forgets all but those just asked for; the answers are the same."""

    def __init__(self, limit: int = 200_000, dtype=np.uint32):
        self.limit, self.dtype = limit, dtype
        self._clear()

    def __len__(self) -> int:
        return len(self.rows)

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.off = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def get(self, keys: list[str], make) -> tuple[np.ndarray, np.ndarray]:
        """(flat, offsets) of the rows of distinct `keys`; make(missing keys) gives
        the flat values and sizes of those not held."""
        if len(self.rows) > self.limit:
            self._clear()
        at = np.fromiter(map(self.rows.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            flat, sizes = make(new)
            at[missing] = len(self.off) - 1 + np.arange(len(new))
            self.rows.update(zip(new, at[missing].tolist()))
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes, dtype=np.int64)])
            self.flat = np.concatenate([self.flat, np.asarray(flat, self.dtype)])
        return ragged_take(self.flat, self.off, at)


def next_power(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))
