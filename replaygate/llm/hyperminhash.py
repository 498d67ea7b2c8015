"""Near-duplicate groups by HyperMinHash (operator 6).

A document's set is its distinct word shingles. Documents with the same set form
one class. Each class gets a HyperMinHash sketch: a 64-bit hash of every shingle
chooses a bucket by its first bits; the bucket keeps of its smallest remainder
only the number of leading zeros and a few mantissa bits. Empty buckets borrow
from a full one, found by a fixed permutation per bucket, so that any bucket of
two sketches agrees with a probability close to the Jaccard similarity.

Bands of registers propose candidates, the collision-corrected estimate over all
registers thins them out, and the full sets decide. Links are first sought with
bands' smallest members: each class meets that of its fullest band, then those of
its other bands that it is not yet joined with (linear in the bands' sizes).
Bands that still hold several groups are compared block against block: likely
pairs of different groups are joined to families, and each family's full sets are
compared block against block, so that no link between groups is lost. Both steps
hand on only links that join something new, so their output stays linear too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .words import documents, release, releasing, slices, split_words, stored, unburdened, with_met

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
BUCKET_BITS, ZERO_BITS, MANTISSA_BITS = 7, 6, 10
BUCKETS = 1 << BUCKET_BITS
#: Rows of a band: at similarity 0.75 a pair meets in none of the 42 bands once in 10**10.
BAND_ROWS = 3
#: The estimate over 128 registers has a standard deviation below 0.047 for sets of
#: SURE_SHINGLES and more; a pair is dropped unverified only if it lies 4.8 of them
#: below the threshold. Smaller sets are always compared whole.
ESTIMATE_SLACK = 0.225
SURE_SHINGLES = 8
#: Members, and shingles, in a block that is compared with another at once.
BLOCK, BLOCK_SHINGLES = 512, 400_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_PLACE = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lower-cased, words
    of 0x20 and 0x09-0x0D; fewer words than a shingle count as one, no word as none."""
    off, words = split_words(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)
    n = len(hashes)
    grams = np.zeros(max(0, n - SHINGLE_WORDS + 1), np.uint64)
    for i in range(SHINGLE_WORDS):
        grams += mix(hashes[i : i + len(grams)] + _PLACE[i]) * _PLACE[i]
    grams = mix(grams)
    out = []
    for a, b in zip(off.tolist(), off[1:].tolist()):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(grams[a : b - SHINGLE_WORDS + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(b - a):
                short += mix(hashes[a + i : a + i + 1] + _PLACE[i]) * _PLACE[i]
            out.append(mix(~short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def _borrow_order() -> np.ndarray:
    """For each bucket the order in which it looks for a full one: itself, then a fixed permutation."""
    rng = np.random.Generator(np.random.PCG64(20240601))
    order = np.array([rng.permutation(BUCKETS) for _ in range(BUCKETS)])
    return np.hstack([np.arange(BUCKETS)[:, None], order])


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: leading zeros and mantissa of each bucket's minimum."""
    rest_bits = 64 - BUCKET_BITS
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(rest_bits)
    at = np.searchsorted(hashes, edges)
    full = np.append(at[1:], len(hashes)) > at
    low = hashes[np.minimum(at, len(hashes) - 1)] & np.uint64((1 << rest_bits) - 1)
    length = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bits in the remainder
    length -= (np.uint64(1) << np.maximum(length - 1, 0).astype(np.uint64)) > low  # rounding up to a power of two
    length = np.where(low == 0, 0, length)
    zeros = np.minimum(rest_bits - length, (1 << ZERO_BITS) - 1).astype(np.uint64)
    shift = length - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    register = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    if not full.all():
        order = _borrow_order()
        register = register[order[np.arange(BUCKETS), full[order].argmax(axis=1)]]
    return register


def collision_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two unrelated registers agree, for sets of n and m elements:
    equal numbers of leading zeros, and then equal mantissas."""
    below = np.exp2(-np.arange(0, 41, dtype=float))  # the minimum is under 2**-z with the chance 1-(1-2**-z)**load

    def at_least(size):
        load = np.maximum(np.asarray(size, float) / BUCKETS, 1.0)[:, None]
        return 1 - np.power(1 - below[None, :], load)
    a, b = at_least(n), at_least(m)
    same = ((a[:, :-1] - a[:, 1:]) * (b[:, :-1] - b[:, 1:])).sum(axis=1)
    return same / (1 << MANTISSA_BITS)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate from the number of equal registers."""
    c = collision_chance(n, m)
    return (equal / BUCKETS - c) / (1 - c)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """[document, band] 64-bit keys; BAND_ROWS registers and the band's number make a key."""
    bands = BUCKETS // BAND_ROWS
    parts = sketches[:, : bands * BAND_ROWS].reshape(len(sketches), bands, BAND_ROWS).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.ones((len(sketches), 1), np.uint64)
    for r in range(BAND_ROWS):
        key = (key << np.uint64(ZERO_BITS + MANTISSA_BITS)) | parts[:, :, r]
    return mix(key).view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, n_shingles, digest, sketch) of each row; digest identifies the set, both are null for an empty one."""
    row = F.col(row_col) if row_col else F.lit(None)
    src = df.select(F.col(id_col).cast("long").alias("id"), row.cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "row", "n_shingles", "digest", "sketch"])

    return src.mapInArrow(run, "id long, row long, n_shingles long, digest binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in unburdened(batches):
            if batch.num_rows:
                sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS)
                keys = band_keys(sketches)
                node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, node long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate reaches the threshold less ESTIMATE_SLACK."""
    def side(name):
        return classes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"), F.col("n_shingles").alias(f"{name}_n"))

    def run(batches):
        for batch in unburdened(batches):
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"{x}_sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in "ab")
                n, m = (batch.column(f"{x}_n").to_numpy() for x in "ab")
                keep = (estimate((a == b).sum(axis=1), n, m) >= percent / 100 - ESTIMATE_SLACK) | (np.minimum(n, m) < SURE_SHINGLES)
                keep &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch", "a_n", "b_n").mapInArrow(run, "a long, b long")


@releasing
def _sets_of(nodes: DataFrame, classes: DataFrame, df: DataFrame, key_col: str, text_col: str, name: str) -> DataFrame:
    """(node, shingles) of the given nodes; only the texts of those classes are read again."""
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", "first_key", "digest"), f"{name}-wanted")
    src = df.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    src = with_met(src, F.col("key"), wanted.select("first_key")).filter("__met").drop("__met")
    src = src.join(wanted.select("first_key").distinct(), F.col("key").eqNullSafe(F.col("first_key")), "left_semi")

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text")) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    sets = src.mapInArrow(run, "digest binary, shingles array<long>").join(wanted.select("digest", "node"), "digest")
    return stored(sets.dropDuplicates(["node"]).select("node", "shingles"), f"{name}-sets")


@releasing
def _verify(pairs: DataFrame, classes: DataFrame, df: DataFrame, key_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    pairs = stored(pairs, "star-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(nodes, classes, df, key_col, text_col, "star")
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return joined.filter(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _in_block_pairs(members: DataFrame, key: str, size) -> DataFrame:
    """`members` dealt to blocks of their `key`, `size` of them, and copied to every
    pair of blocks (lo <= hi): each two members of a key meet in one pair."""
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), size))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    return spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).groupBy(key, "lo", "hi")


def _joining(left: np.ndarray, right: np.ndarray, group: dict[int, int]) -> list[int]:
    """Which of the pairs (left[i], right[i]) join two trees of `group`, taken in order."""
    def find(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x
    out = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            group[a] = b
            out.append(i)
    return out


def _likely_joins(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) likely pairs of different groups inside each band, as many as join the band's members."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n_shingles", "block"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        lo, hi = key[1].as_py(), key[2].as_py()
        right, trees, a_out, b_out = np.flatnonzero(block == hi), {}, [], []
        for i in np.flatnonzero(block == lo).tolist():
            js = right[(label[right] != label[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if len(js):
                near = estimate((sketch[js] == sketch[i]).sum(axis=1), n[js], n[i : i + 1]) >= percent / 100 - ESTIMATE_SLACK
                js = js[near | (np.minimum(n[js], n[i]) < SURE_SHINGLES)]
                js = js[_joining(np.full(len(js), i), js, trees)]
                a_out += [node[i]] * len(js)
                b_out += node[js].tolist()
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    return _in_block_pairs(members, "key", blocks).applyInArrow(run, "a long, b long").distinct()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left, right] numbers of common elements; only elements of several sets are counted."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    rows, columns = owner[shared[column]], number[column[shared[column]]]
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(columns, [at, at + 4096]))
        table = np.zeros((len(sets), 4096), np.float32)
        table[rows[part], columns[part] - at] = 1
        out += (table[left] @ table[right].T).astype(np.int64)
    return out


def _family_links(members: DataFrame, percent: int) -> DataFrame:
    """Verified (a, b) links between different groups inside each family, as many as join them."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        sets = [np.asarray(s.values) for s in table.column("shingles")]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        a_out, b_out = [], []
        if len(left) and len(right):
            both = _common(sets, left, right)
            near = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
            i, j = np.nonzero(near)
            keep = _joining(label[left[i]], label[right[j]], {})
            a_out, b_out = node[left[i[keep]]], node[right[j[keep]]]
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    dealt = members.join(stored(sizes, "families"), "family")
    return _in_block_pairs(dealt, "family", F.col("blocks")).applyInArrow(run, "a long, b long")


@releasing
def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT, row_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `df`.

    A row without words or text is linked with nothing: component_id is its own
    id. Rows with equal sets, repeated rows too, share a component; component_id
    is the smallest id reachable, and kept tells whether that is the row's own.
    A null id gets its group's smallest id, or null if none has an id. An empty
    table gives an empty result.

    `row_col` names a column of distinct longs, the same whenever `df` is read; it
    is passed through, and kept is then true for exactly one row of a component,
    the one with the smallest id (a null id is larger than any other) and of
    those the smallest row, and for each row without words or text.
    """
    rows = stored(sketch_documents(df, id_col, text_col, row_col), "sketches")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    found = rows.filter("digest is not null").groupBy("digest").agg(F.min(place).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    found = found.withColumn("first_key", F.col("first.row" if row_col else "first.id"))
    classes = stored(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    key_col = row_col or id_col

    bands = _bands(classes)
    heads = stored(bands.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1"), "heads")
    in_band = stored(bands.join(heads, "key"), "in-band")
    release(heads)
    # first each node against the head of its fullest band, then against the heads it is still apart from
    stars = in_band.filter("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    stars = stored(stars, "stars")  # a head that meets a node in many bands meets it once
    fullest = stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    verified = _verify(_likely(fullest, classes, percent), classes, df, key_col, text_col, percent)
    links = stored(verified, "first-links")
    release(verified)
    labels = components(links, "first-components")
    apart = stars.join(labels.toDF("a", "a_label"), "a", "left").join(labels.toDF("b", "b_label"), "b", "left")
    apart = apart.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    verified = _verify(_likely(apart, classes, percent), classes, df, key_col, text_col, percent)
    links, first = stored(links.union(verified), "links"), links
    release(verified, first, labels, stars)
    labels = components(links)

    # bands whose members other than the head still lie in several groups
    grouped = in_band.filter("n > 2 and node <> head").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    grouped = stored(grouped, "grouped")
    release(in_band)
    mixed = stored(grouped.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key"), "mixed")
    members = grouped.join(mixed, "key").join(classes.select("node", "sketch", "n_shingles"), "node")
    joins = stored(_likely_joins(members, percent), "likely-joins")
    if not joins.isEmpty():
        family = components(joins, "families").select("node", F.col("label").alias("family"))
        sets = _sets_of(family.select("node"), classes, df, key_col, text_col, "family")
        relatives = family.join(labels, "node", "left").join(sets, "node").select("family", "node", F.coalesce("label", "node").alias("label"), "shingles", F.size("shingles").alias("n_shingles"))
        more = stored(_family_links(stored(relatives, "relatives"), percent), "more-links")
        labels = components(links.union(more), "all-components")

    of = classes.join(labels, "node", "left").select("digest", "first", F.coalesce("label", "node").alias("label"))
    of = stored(of, "class-labels")
    smallest = stored(of.groupBy("label").agg(F.min("first").alias("least")), "smallest")
    member = stored(of.join(smallest, "label").select("digest", F.col("least.id").alias("component_id"), F.col("least.row").alias("least_row")), "members")
    out = rows.join(member, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
    if row_col:
        return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("row") == F.col("least_row"), F.lit(True)).alias("kept"), F.col("row").alias(row_col))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
