"""The exact token bucket (T8): whole-number levels, and folds that run in chunks.

Levels are whole numbers of 1/60,000,000 token, so that a microsecond at a limit
of L per minute refills exactly L of them and no rounding depends on how a
timeline is cut. Per event, in order: the level is cut to the capacity
(max(1, limit) tokens), refilled by elapsed * limit up to the capacity, and one
token is taken if there is one. A bucket that does not exist or was idle for the
TTL starts full.

**Chunks.** A client's timeline is cut into slots of 30 s and at limit changes. In
a chunk with limit L >= 2 the refill between its first and last event is below
(capacity - 1) tokens. So a level that fell below one token cannot reach the
capacity again inside the chunk: whatever overflows does so before the first
rejection, while every event is still admitted. With R_i the refill up to event i
(R_1 = 0), the level y before the first event then passes the chunk as follows:

- starts above c = min_i(capacity - R_i + (i - 1) tokens) end as c does: they
  overflow by the difference. y is replaced by min(y, c);
- a start that never overflows gets min_i(i..k left + whole tokens in y + R_i)
  events admitted, which is min(k, floor((y + s) / token)) with
  s = min_i(R_i - i tokens) + k tokens;
- the level after the chunk is y + R_k - admitted tokens.

So **a chunk's map of the starting level is four numbers (k, R, s, c)**, however many
events it holds, all of them minima and counts that Spark's windows compute. For
limits of 0 or 1 the capacity is one token and a chunk is one microsecond, within
which nothing is refilled.

The plan: windows over (client, slot) give the maps; one small row per chunk goes
through the serial pass, in time order, with two numbers of state per client; the
starting levels are joined back and every event is decided by the same closed form.
A client that never pauses is spread over as many tasks as it has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import idiv
from ..schema import DEFAULT_POLICY

US_PER_S = 1_000_000
#: Levels are counted in this share of a token.
TOKEN = 60_000_000
#: Slots in which a bucket with a limit of 2 or more refills less than its capacity less one token.
CHUNK_US = 30 * US_PER_S
TTL_US = DEFAULT_POLICY.bucket_ttl_s * US_PER_S


def capacity(limit: int) -> int:
    return max(1, limit) * TOKEN


def refilled(level: int, last: int | None, now: int, limit: int, ttl_us: int = TTL_US) -> int:
    """The level right before the event at `now`; `last` is None for a new bucket. Late events refill nothing."""
    cap = capacity(limit)
    if last is None or now - last >= ttl_us:
        return cap
    return min(cap, min(level, cap) + max(0, now - last) * limit)


def bucket_fold(us, lim, level: int, last: int | None, ttl_us: int = TTL_US):
    """Fold one bucket over events in order: (admitted, levels after, level, last)."""
    admitted, levels = [], []
    for now, limit in zip(us, lim):
        level, last = refilled(level, last, now, limit, ttl_us), now
        admitted.append(level >= TOKEN)
        if admitted[-1]:
            level -= TOKEN
        levels.append(level)
    return admitted, levels, level, last


def pass_chunk(level: int, k: int, refill: int, spare: int, cut: int) -> int:
    """A chunk's map: the level after it from the level before its first event."""
    level = min(level, cut)
    return level + refill - TOKEN * min(k, (level + spare) // TOKEN)


def bucket_key(columns) -> Column:
    """One non-null text for the values of the key columns: NULL is a value of its own."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
                      for c in columns])


def _slotted(rows: DataFrame, time_col: str, steady: bool) -> DataFrame:
    """Adds _slot and, where a bucket's limit never changes, _run."""
    t = F.col(time_col)
    rows = rows.withColumn("_slot", idiv(t - F.pmod(t, F.lit(CHUNK_US)), CHUNK_US))  # floors, also before 1970
    alone = F.when(F.col("_lim") <= 1, t)  # one microsecond a chunk
    return rows.withColumn("_run", F.coalesce(alone, F.lit(0).cast("long"))) if steady else rows


def _maps(rows: DataFrame, time_col: str) -> DataFrame:
    """The chunk maps of `rows` as ``_chunked`` leaves them."""
    return rows.groupBy("_k", "_slot", "_run").agg(
        F.max("_i").alias("_n"), F.min(time_col).alias("_first"), F.max(time_col).alias("_last"), F.max("_lim").alias("_lim"),
        F.max("_refill").alias("_refill"), F.min("_least").alias("_least"), F.min("_cut").alias("_cut"))


def _steady_maps(slotted: DataFrame, time_col: str, copies: str | None = None) -> DataFrame:
    """The same maps where limits never change, from counts per microsecond: of the
    events of one time, all with one refill, the last gives the least and the first the
    cut. Counts combine before the shuffle, and only (chunk, time) rows are sorted. A row
    stands for as many events as `copies` says."""
    n = F.count(F.lit(1)) if copies is None else F.sum(copies)
    ties = slotted.groupBy("_k", "_slot", "_run", time_col).agg(n.alias("_m"), F.max("_lim").alias("_lim"))
    upto = Window.partitionBy("_k", "_slot", "_run").orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("_i", F.sum("_m").over(upto)).withColumn("_refill", (F.col(time_col) - F.min(time_col).over(upto)) * F.col("_lim"))
    room = F.greatest(F.lit(1), F.col("_lim")).cast("long") * TOKEN - F.col("_refill") + (F.col("_i") - F.col("_m")) * TOKEN
    return _maps(ties.withColumn("_least", F.col("_refill") - F.col("_i") * TOKEN).withColumn("_cut", room), time_col)


def _chunked(rows: DataFrame, time_col: str, order, steady: bool) -> DataFrame:
    """Completes the chunk (_k, _slot, _run) of slotted rows and adds, per event, _i, _refill and the running
    minima that give spare and cut up to it and up to the event before."""
    at = [time_col, *order]
    if not steady:
        w = Window.partitionBy("_k", "_slot").orderBy(*at)
        changed = (F.lag("_lim").over(w).isNull() | (F.lag("_lim").over(w) != F.col("_lim"))
                   | ((F.col("_lim") <= 1) & (F.lag(time_col).over(w) != F.col(time_col)))).cast("long")
        rows = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    w = Window.partitionBy("_k", "_slot", "_run").orderBy(*at)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.row_number().over(w).cast("long")) \
        .withColumn("_refill", (F.col(time_col) - F.min(time_col).over(upto)) * F.col("_lim"))
    owed = F.col("_refill") - F.col("_i") * TOKEN
    room = F.greatest(F.lit(1), F.col("_lim")).cast("long") * TOKEN - F.col("_refill") + (F.col("_i") - 1) * TOKEN
    return rows.withColumn("_owed", owed).withColumn("_room", room).withColumns({
        "_least": F.min("_owed").over(upto), "_cut": F.min("_room").over(upto),
        "_least0": F.min("_owed").over(before), "_cut0": F.min("_room").over(before)}).drop("_owed", "_room")


_SCAN = "_ck string, _cslot long, _crun long, _start long"


def _scan(chunks: DataFrame, ttl_us: int) -> DataFrame:
    """The serial pass over chunk maps: each chunk's level before its first event.
    Rows come sorted by client and time; two numbers of state cross Arrow batches."""
    def run(batches):
        key, level, last = None, 0, None
        for pdf in batches:
            starts, given = [], []
            for k, n, first, end, limit, refill, least, cut in zip(*(pdf[c].tolist() for c in ("_k", "_n", "_first", "_last", "_lim", "_refill", "_least", "_cut"))):
                if k != key:
                    key, level, last = k, 0, None
                given.append(n > 0)
                if not n:  # a stored bucket
                    level, last = refill, first
                    continue
                level = refilled(level, last, first, limit, ttl_us)
                starts.append(level)
                level, last = pass_chunk(level, n, refill, least + n * TOKEN, cut), end
            yield pdf.loc[given, ["_k", "_slot", "_run"]].set_axis(["_ck", "_cslot", "_crun"], axis=1).assign(_start=starts)

    return chunks.repartition("_k").sortWithinPartitions("_k", F.col("_n") > 0, "_slot", "_first", "_run").mapInPandas(run, _SCAN)


def fold_in_chunks(src: DataFrame, key_cols, time_col: str, order, steady: bool = False, initial: DataFrame | None = None,
                   ttl_us: int = TTL_US) -> DataFrame:
    """`src` (with the limit in `_lim`) with `admitted` and `_level`, the level after each event."""
    slotted = _slotted(src.withColumn("_k", bucket_key(key_cols)), time_col, steady)
    rows = _chunked(slotted, time_col, order, steady)
    chunks = _steady_maps(slotted, time_col) if steady else _maps(rows, time_col)
    if initial is not None:
        zero = F.lit(0).cast("long")
        chunks = chunks.unionByName(initial.select(
            bucket_key(key_cols).alias("_k"), zero.alias("_slot"), zero.alias("_run"), zero.alias("_n"), F.col("last_refill").cast("long").alias("_first"),
            F.col("last_refill").cast("long").alias("_last"), F.lit(0).alias("_lim"), to_level("tokens").alias("_refill"), zero.alias("_least"), zero.alias("_cut")))
    starts = _scan(chunks, ttl_us)
    # the events lie sorted by chunk already; a broadcast of either side would move them, or ask for memory, on an estimate
    out = rows.hint("merge").join(starts, (F.col("_k") == F.col("_ck")) & (F.col("_slot") == F.col("_cslot")) & (F.col("_run") == F.col("_crun")))

    def admitted(i, cut, least):
        y = F.least(F.col("_start"), cut)
        return y, F.least(i, idiv(y + least + i * TOKEN, TOKEN))

    y, now = admitted(F.col("_i"), F.col("_cut"), F.col("_least"))
    _, earlier = admitted(F.col("_i") - 1, F.coalesce("_cut0", F.col("_start")), F.coalesce("_least0", F.lit(0).cast("long")))
    return out.withColumn("admitted", now > F.when(F.col("_i") == 1, F.lit(0).cast("long")).otherwise(earlier)) \
        .withColumn("_level", y + F.col("_refill") - now * TOKEN) \
        .drop("_k", "_slot", "_run", "_i", "_refill", "_least", "_cut", "_least0", "_cut0", "_ck", "_cslot", "_crun", "_start")


_COPIED = ("_lim", "_end", "_twins", "_twin", "_refill", "_cut", "_least0", "_start")


def fold_copied(src: DataFrame, key_cols, time_col: str, order, copies: str, ttl_us: int = TTL_US) -> DataFrame:
    """The fold of steady buckets over rows that each stand for `copies` events, ordered by
    `order` and then by the copy's number: each row with what ``copied`` needs to decide its
    events. The rows of a bucket that are twins in time and order have equal `copies`."""
    n = F.col(copies).cast("long")
    slotted = _slotted(src.withColumn("_k", bucket_key(key_cols)).withColumn("_n", n), time_col, True)
    starts = _scan(_steady_maps(slotted, time_col, "_n"), ttl_us)
    w = Window.partitionBy("_k", "_slot", "_run").orderBy(time_col, *order)
    upto, twins = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.currentRow)
    rows = slotted.withColumns({
        "_end": F.sum("_n").over(upto), "_twins": F.count(F.lit(1)).over(twins), "_at": F.row_number().over(w), "_rows": F.count(F.lit(1)).over(upto),
        "_refill": (F.col(time_col) - F.min(time_col).over(w.rowsBetween(Window.unboundedPreceding, 0))) * F.col("_lim")})
    rows = rows.withColumn("_twin", F.col("_at") - F.col("_rows") + F.col("_twins"))
    room = F.greatest(F.lit(1), F.col("_lim")).cast("long") * TOKEN - F.col("_refill") + (F.col("_end") - F.col("_twins") * F.col("_n")) * TOKEN
    rows = rows.withColumn("_owed", F.col("_refill") - F.col("_end") * TOKEN).withColumn("_room", room)
    before = F.coalesce(F.min("_owed").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit((1 << 63) - 1))
    rows = rows.withColumns({"_cut": F.min("_room").over(upto), "_least0": before})
    rows = rows.withColumn("_least0", F.max("_least0").over(twins))  # before the first of the twins
    out = rows.hint("merge").join(starts, (F.col("_k") == F.col("_ck")) & (F.col("_slot") == F.col("_cslot")) & (F.col("_run") == F.col("_crun")))
    return out.select(*src.columns, *(c for c in _COPIED if c not in src.columns))


def _admitted_upto(i):
    """Of a chunk's first i events those admitted, where i is one of the row's or the event before them."""
    return F.least(i, idiv(F.least("_start", "_cut") + F.least(F.col("_least0"), F.col("_refill") - i * TOKEN) + i * TOKEN, TOKEN))


def copied(folded: DataFrame, copies: str, copy_col: str = "copy_no") -> DataFrame:
    """The events of the rows of ``fold_copied`` with `copy_col`, `admitted` and `_level`."""
    rows = folded.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(copies).cast("int") - 1)))
    i = F.col("_end") - F.col("_twins") * F.col(copies) + F.col(copy_col) * F.col("_twins") + F.col("_twin")
    rows, now = rows.withColumn("_i", i), _admitted_upto(F.col("_i"))
    return rows.withColumn("admitted", now > _admitted_upto(F.col("_i") - 1)) \
        .withColumn("_level", F.least("_start", "_cut") + F.col("_refill") - now * TOKEN).drop(*_COPIED[1:], "_i")


def copies_admitted(copies: str) -> Column:
    """How many events of a row of ``fold_copied`` are admitted: at one time the first ones are, twin after twin."""
    first = _admitted_upto(F.col("_end")) - _admitted_upto(F.col("_end") - F.col("_twins") * F.col(copies))
    return F.greatest(F.lit(0), F.least(F.col(copies).cast("long"), F.floor((first - F.col("_twin")) / F.col("_twins")) + 1))


def fold_serially(src: DataFrame, key_cols, time_col: str, order, ttl_us: int = TTL_US) -> DataFrame:
    """The same, event by event: each client is one serial fold. The chunked form is compared with it."""
    schema = T.StructType(src.schema.fields + [T.StructField("admitted", T.BooleanType()), T.StructField("_level", T.LongType())])
    keyed = src.withColumn("_k", bucket_key(key_cols))

    def run(batches):
        key, level, last = None, 0, None
        for pdf in batches:
            keys, us, lim = pdf["_k"].tolist(), pdf[time_col].tolist(), pdf["_lim"].tolist()
            admitted, levels, i = [], [], 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key:
                    key, level, last = keys[i], 0, None
                a, b, level, last = bucket_fold(us[i:j], lim[i:j], level, last, ttl_us)
                admitted, levels, i = admitted + a, levels + b, j
            yield pdf.drop(columns="_k").assign(admitted=admitted, _level=levels)

    return keyed.repartition("_k").sortWithinPartitions("_k", time_col, *order).mapInPandas(run, schema)


def to_tokens(level="_level") -> Column:
    return F.col(level) / F.lit(float(TOKEN))


def to_level(tokens="tokens") -> Column:
    """Exact: levels are far below 2^53 and tokens carry 53 bits."""
    return F.round(F.col(tokens) * F.lit(float(TOKEN))).cast("long")
