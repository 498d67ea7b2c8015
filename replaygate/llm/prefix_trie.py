"""Conversation prefix trie by truncation peeling (operator 13).

A depth-d node is a distinct sequence of the first d turns of some conversation.
Levels are peeled from the deepest: the conversations that end at a depth join
the nodes that survived from below, equal sequences merge, and stripping the
last turn of every merged node gives the rows of the next level. Member counts,
leaves and savings are summed in the same regrouping that discovers the nodes.

Sequences are compared by 128-bit keys of running sums of position-dependent turn
digests, so neither a conversation nor a path is ever held in one row. What only
one conversation passes through is a bare tail: one node a turn, one member, one
leaf, nothing saved. Tails are written straight from the turns, and the
conversation enters the peeling where its sequence is first shared. The rounds
are as many as the deepest shared node has turns, whatever the longest
conversation is.

Null role or text count as empty, null turns come first, equal turns are ordered
by role and the digest of the text. Rows without a conversation id form no
conversation. An empty table gives no node.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table_path
from .words import stored, text_or_empty

#: Conversations of one hundred ids share the opening of the first of them.
FAMILY = 100
#: A shared opening has fewer turns than this.
OPENINGS = 6
_PARTS = 4


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of each conversation numbered from 1."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    turns = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def share_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation opens with the first h turns of
    the first conversation of its family (all if it has fewer, none if it is not
    there) and goes on with its own turns after its first h."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.withColumn("h", opening_turns(F.col("conv_id"))).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    openings = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < OPENINGS)).groupBy(F.col("conv_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("opening"))  # fewer than OPENINGS turns
    plans = stored(convs.join(openings, F.col("first") == F.col("of"), "left").select(
        "conv_id", "h", F.coalesce(F.filter("opening", lambda t: t["pos"] <= F.col("h")), F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")).alias("opening")), "openings")
    taken = plans.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.pos", "t.digest", "t.chars")
    kept = turns.join(plans.select("conv_id", "h", F.size("opening").alias("k")), "conv_id").filter(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "digest", "chars")
    return taken.unionByName(kept), plans.select("conv_id")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, chars): each turn as the last one of a prefix.

    The key depends on the sum of the digests of (position, turn) up to there: four
    sums of 33 bits, so 2^30 turns fit a long and a prefix needs no list."""
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "chars",
                        *(F.shiftright(F.xxhash64(F.lit(i), "pos", "digest"), 31).alias(f"h{i}") for i in range(_PARTS)))
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(f"h{i}").over(so_far).alias(f"s{i}") for i in range(_PARTS)))
    here = [F.col(f"s{i}") for i in range(_PARTS)]
    above = [F.col(f"s{i}") - F.col(f"h{i}") for i in range(_PARTS)]
    return summed.select("conv_id", "depth", _key(F.col("depth"), here).alias("key"), _key(F.col("depth") - 1, above).alias("parent"), "chars")


def _joined_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending ids of each key joined by
    commas. The digest is sequential by definition; ids stream through it in
    sorted order, so a key of any size takes constant memory."""
    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key), hashes.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie over `turns` (conv_id, pos from 1, digest, chars) of the
    conversations `convs` (conv_id), which may have none: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (characters that members need not repeat, over the subtree), ends_sha256."""
    root = _key(F.lit(0), [F.lit(0)] * _PARTS)
    table = stored(prefixes(turns), "prefixes")
    shared = stored(table.groupBy("key").agg(F.count("*").alias("n"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
                                             F.first("chars").alias("chars")).filter("n > 1").drop("n"), "shared")
    marked = stored(table.join(shared.select("key", F.lit(True).alias("shared")), "key", "left").withColumn("shared", F.coalesce("shared", F.lit(False))), "marked")

    # One row per conversation: where it enters the peeling, as an end or as a tail hanging below.
    last = F.struct("depth", "key")
    entries = marked.groupBy("conv_id").agg(F.max(F.when(F.col("shared"), last)).alias("at"), F.max("depth").alias("length"))
    entries = convs.select("conv_id").join(entries, "conv_id", "left").select(
        "conv_id", F.coalesce("at.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("at.key", root).alias("key"),
        F.coalesce(F.col("length"), F.lit(0)).alias("length"))
    entries = stored(entries.select("conv_id", "depth", "key", (F.col("length") > F.col("depth")).alias("tail"), "length"), "entries")
    rows = entries.select("depth", "key", "conv_id", F.lit(1).cast("long").alias("n"), F.col("tail").cast("long").alias("children"),
                          F.col("tail").cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))

    deepest = shared.agg(F.max("depth")).first()[0] or 0
    levels, survivors = [], None
    for depth in range(deepest, -1, -1):
        level = rows.filter(F.col("depth") == depth).drop("depth")
        level = level if survivors is None else level.unionByName(survivors)
        merged = level.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
        if depth:
            merged = merged.join(shared.filter(F.col("depth") == depth).drop("depth"), "key")
        else:
            merged = merged.withColumn("parent", F.lit(None).cast("binary")).withColumn("chars", F.lit(0).cast("long"))
        merged = merged.select("key", "parent", F.lit(depth).cast("long").alias("depth"), "conv_id", "n", "children", F.greatest("leaves", F.lit(1)).alias("leaves"),
                               (F.col("saved") + (F.col("n") - 1) * F.col("chars")).alias("saved"))
        levels.append(stored(merged, f"level-{depth}"))
        survivors = levels[-1].select(F.col("parent").alias("key"), "conv_id", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")

    peeled = reduce(DataFrame.unionByName, levels)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ends = _joined_digests(entries.filter("not tail"))
    peeled_nodes = peeled.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    lengths = entries.filter("tail").select("conv_id", "length")
    tails = marked.filter("not shared").join(lengths, "conv_id").select(
        "key", "parent", "depth", "conv_id", F.lit(1).cast("long").alias("n"), (F.col("depth") < F.col("length")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"))
    above = peeled.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return peeled_nodes.unionByName(tails).join(above, "parent", "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(ordered_turns(spark.read.parquet(table_path(sf_dir, "conversations"))), "turns")
    return prefix_trie(*share_openings(turns))


ORACLE = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         (list_reduce(list_prepend(4294967295::BIGINT, [ord(s[i + 1])::BIGINT FOR i IN range(length(s))]), lambda crc, b:
            list_reduce(list_prepend(xor(crc, b), [0::BIGINT FOR j IN range(8)]), lambda c, z:
              CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))) AS crc
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM numbered)
), heads AS (
  SELECT conv_id, base, xor(crc, 4294967295::BIGINT) % 6 AS h FROM ids
), rebuilt AS (
  SELECT i.conv_id, n.pos, n.role, n.text FROM heads i JOIN numbered n ON n.conv_id = i.base AND n.pos <= i.h
  UNION ALL
  SELECT i.conv_id, n.pos - i.h + (SELECT count(*) FROM numbered b WHERE b.conv_id = i.base AND b.pos <= i.h), n.role, n.text
  FROM heads i JOIN numbered n ON n.conv_id = i.conv_id AND n.pos > i.h
), paths AS (
  SELECT conv_id, pos AS depth, length(text) AS chars,
         list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
         count(*) OVER (PARTITION BY conv_id) AS size FROM rebuilt
  UNION ALL
  SELECT i.conv_id, 0, 0, []::VARCHAR[], (SELECT count(*) FROM rebuilt r WHERE r.conv_id = i.conv_id) FROM heads i
), nodes AS (
  SELECT sha256(path::VARCHAR) AS node, sha256(path[:-2]::VARCHAR) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         count(*) FILTER (depth < size) AS further,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), under AS (
  SELECT sha256(p.path::VARCHAR) AS top, n.n_convs, n.chars, n.further
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), sums AS (
  SELECT top, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (further = 0) AS leaves FROM under GROUP BY top
), kids AS (
  SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN kids k ON k.parent = n.node
"""
