"""Repeated-passage removal by deep-shallow suffix sorting (operator 8).

Every byte covered by a SPAN-byte string that also starts anywhere else in the
table goes. Sorting all suffixes at once would put each next to its repeats; the
work is cut into groups that can be sorted apart:

1. The SPAN-byte string at every start has one anchor, the gram with the smallest
   hash in it (rightmost among equals). Equal strings have equal anchors at equal
   places, so only starts whose anchor occurs twice or more can repeat.
2. The starts that share one occurrence of an anchor lie next to each other; they
   and the bytes they reach are a context. A context that occurs twice or more is
   repeated as a whole and needs no sorting.
3. The suffixes of the other contexts, cut at SPAN bytes, are sorted deep-shallow:
   multikey quicksort to a shallow depth, eight bytes a step, dropping suffixes
   that are alone; then a blind trie for each group that still shares its prefix.
   The contexts of an anchor held by very many are spread over chunks. Their
   starts are taken in blocks by distance from the anchor: all strings of a block
   hold its core, the bytes common to them. What is alone in its chunk meets the
   others by digest only where another context has the same core.

Texts that occur twice or more are repeated as a whole too, and take part once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hyperminhash import mix
from .words import documents, left_joined, release, releasing, slices, stored, unburdened, with_met

SPAN = 200
GRAM = 32
WINDOW = SPAN - GRAM + 1
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 64
#: Contexts in a sort group on average, and of one anchor in a chunk at most about.
GROUP_CONTEXTS, CHUNK_CONTEXTS = 4000, 2000
#: Starts of a context, by distance from its anchor, that share a core of SPAN + 1 - CORE_STARTS bytes.
CORE_STARTS = 16

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEVELS = tuple(np.uint64(int(x) | 1) for x in mix(np.arange(7, 12, dtype=np.uint64)))
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position, joined from halves."""
    x, size = _BYTES[data], 1
    for factor in _LEVELS:
        x = x[: len(x) - size] * factor + x[size:]
        size *= 2
    return mix(x)


def smallest_in_windows(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of keys[i:i + window] for each i, from running minima inside blocks."""
    n = len(keys) - window + 1
    blocks = np.full(-(-len(keys) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts) of each anchor occurrence in one text."""
    if len(data) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    order = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    at = (_LOW - (smallest_in_windows(order, WINDOW) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[at[first]], first, np.diff(np.append(first, len(at)))


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, depth: int = SHALLOW // 8) -> tuple[np.ndarray, np.ndarray]:
    """(members, group): the indices of `starts` whose first 8 * depth bytes are
    shared, group by group, and the number of the group each is in.

    words[i] holds the bytes from i as a big-endian number. All groups are split
    at once: each round every group parts into smaller, equal and larger words
    than its middle member's; the equal part goes one word deeper.
    """
    members = np.arange(len(starts))
    group, level = np.zeros(len(starts), np.int64), np.zeros(1, np.int64)
    out, out_key = [], []
    while len(members):
        size = np.bincount(group, minlength=len(level))
        begin = np.cumsum(size) - size
        key = words[starts[members] + 8 * level[group]]
        pivot = key[begin + size // 2][group]
        side = (key > pivot).astype(np.int64) - (key < pivot)
        part = 3 * group + side + 1
        order = np.argsort(part, kind="stable")
        members, part = members[order], part[order]
        size = np.bincount(part, minlength=3 * len(level))
        deeper = np.repeat(level, 3) + np.tile([0, 1, 0], len(level))
        done = (size >= 2) & (deeper >= depth)
        if done.any():
            rows = done[part]
            out.append(members[rows])
            out_key.append(part[rows])
        live = (size >= 2) & (deeper < depth)
        rows = live[part]
        number = np.cumsum(live) - 1
        members, group, level = members[rows], number[part[rows]], deeper[live]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, groups, base = [], [], 0
    for m, k in zip(out, out_key):
        _, g = np.unique(k, return_inverse=True)
        found.append(m), groups.append(g + base)
        base += int(g.max()) + 1
    return np.concatenate(found), np.concatenate(groups)


def _first_difference(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(suffixes: list[bytes]) -> list[int]:
    """Class of each suffix (equal ones share a class): a trie whose inner nodes
    hold only the place of the next differing byte. A suffix walks down by those
    bytes alone, is compared once with the leaf it meets, and is entered at the
    first difference."""
    # a node is [place, {byte: child}, any leaf below]; a leaf is its class
    leaves: list[bytes] = [suffixes[0]]
    classes = [0]
    root: list | int = 0
    for s in suffixes[1:]:
        node = root
        while not isinstance(node, int):
            child = node[1].get(s[node[0]])
            node = node[2] if child is None else child
        known = leaves[node]
        if known == s:
            classes.append(node)
            continue
        at, new = _first_difference(known, s), len(leaves)
        leaves.append(s)
        classes.append(new)
        above, byte, node_below = None, None, root
        while not isinstance(node_below, int) and node_below[0] < at:
            above, byte = node_below, s[node_below[0]]
            node_below = node_below[1][byte]
        if not isinstance(node_below, int) and node_below[0] == at:
            node_below[1][s[at]] = new
        else:
            branch = [at, {known[at]: node_below, s[at]: new}, node]
            if above is None:
                root = branch
            else:
                above[1][byte] = branch
    return classes


def repeated_suffixes(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, class head) for the SPAN-byte strings at `starts`: whether an
    equal one is among them, and the index of the first of its class."""
    buffer = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words |= buffer[i : i + len(data)].astype(np.uint64) << np.uint64(56 - 8 * i)
    repeated, head = np.zeros(len(starts), bool), np.arange(len(starts))
    members, group = multikey_quicksort(words, starts)
    cuts = np.flatnonzero(np.diff(group)) + 1
    where = starts.tolist()
    for rows in np.split(members, cuts) if len(members) else []:
        rows = rows.tolist()
        classes = blind_trie([data[where[i] + SHALLOW : where[i] + SPAN] for i in rows])
        first: dict[int, int] = {}
        for i, c in zip(rows, classes):
            j = first.setdefault(c, i)
            if j != i:
                repeated[i] = repeated[j] = True
                head[i] = j
    return repeated, head


def _texts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's whole text with its key: a 64-bit hash and the length in bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)), text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("size"))


def _occurrence(t: int, size: int, k: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{t} {size} {k}") - (1 << 63)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(t, size, hashes) of each text that has an anchor."""
    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                t, size, rows = part.column("t"), part.column("size"), []
                for text in part.column("text"):
                    rows.append(anchors(np.frombuffer(text.as_buffer(), np.uint8))[0].view(np.int64))
                out = pa.RecordBatch.from_arrays([t, size, pa.array(rows, pa.list_(pa.int64()))], names=["t", "size", "hashes"])
                yield out.filter(pa.array([len(r) > 0 for r in rows], pa.bool_()))

    return texts.select("text", "t", "size").mapInArrow(run, "t long, size long, hashes array<long>")


def _contexts(candidates: DataFrame) -> DataFrame:
    """A row for each listed anchor occurrence of each (t, size, text, listed)."""
    names = ["anchor", "c1", "c2", "occurrence", "t", "size", "first", "starts", "content"]

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                cols = [[] for _ in names]
                for t, size, text, listed in zip(part.column("t").to_pylist(), part.column("size").to_pylist(), part.column("text"), part.column("listed").to_pylist()):
                    data = bytes(text.as_buffer())
                    hashes, first, count = anchors(np.frombuffer(data, np.uint8))
                    hashes, first, count = hashes.view(np.int64).tolist(), first.tolist(), count.tolist()
                    for k in listed:
                        content = data[first[k] : first[k] + count[k] - 1 + SPAN]
                        digest = xxhash.xxh3_128_digest(content)
                        row = (hashes[k], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), _occurrence(t, size, k), t, size, first[k], count[k], content)
                        for c, v in zip(cols, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names=names)

    return candidates.select("t", "size", "text", "listed").mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", content binary")


def cores(data: bytes, starts: int) -> list[tuple[int, int, int, bytes]]:
    """(block, low, high, core) of the blocks of a context's starts: the starts low
    to high are those whose distance to the anchor lies in the block, the core are
    the bytes that every string of the block has, at the same place."""
    order = gram_hashes(np.frombuffer(data, np.uint8, SPAN))
    order = (order & ~_LOW) | (_LOW - np.arange(len(order), dtype=np.uint64))
    at = int(_LOW - (order.min() & _LOW))  # the anchor of one start is that of all
    out = []
    for block in range((at - starts + 1) // CORE_STARTS, at // CORE_STARTS + 1):
        near = at - block * CORE_STARTS
        out.append((block, max(0, near - CORE_STARTS + 1), min(near, starts - 1), data[near : near - CORE_STARTS + 1 + SPAN]))
    return out


def _core_rows(contexts: DataFrame) -> DataFrame:
    """(anchor, c1, c2, block, low, high, v1, v2): each context's blocks with their cores' digests."""
    names = ["anchor", "c1", "c2", "block", "low", "high", "v1", "v2"]

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "content"):
                rows = []
                for *ids, starts, data in zip(*(part.column(n).to_pylist() for n in ("anchor", "c1", "c2", "starts", "content"))):
                    for block, low, high, core in cores(data, starts):
                        digest = xxhash.xxh3_128_digest(core)
                        rows.append((*ids, block, low, high, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)

    return contexts.select("anchor", "c1", "c2", "starts", "content").mapInArrow(run, ", ".join(f"{n} long" for n in names))


@releasing
def _shared_cores(chunked: DataFrame) -> DataFrame:
    """(anchor, c1, c2, open): the ranges of starts whose core another context of the anchor has."""
    rows = stored(_core_rows(chunked), "cores")
    core = ["anchor", "block", "v1", "v2"]
    shared = stored(rows.groupBy(*core).agg(F.count("*").alias("n")).filter("n > 1").select(*core), "shared-cores")
    return stored(rows.join(shared, core, "left_semi").groupBy("anchor", "c1", "c2").agg(F.collect_list(F.struct("low", "high")).alias("open")), "open-starts")


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Sorts the suffixes of each `part`. Rows of kind 0 are runs of repeated
    starts in a context; of kind 1, for open starts of chunked anchors, strings that are alone
    in their chunk (start >= 0) or that stand for a class (start -1), with a digest."""
    def run(table: pa.Table) -> pa.Table:
        contents = table.column("content").to_pylist()
        count = table.column("starts").to_numpy()
        known = table.column("repeated").to_numpy()
        ids = [table.column(c).to_numpy() for c in ("anchor", "c1", "c2")]
        base = np.cumsum([0, *map(len, contents)])[:-1]
        owner = np.repeat(np.arange(len(contents)), count)
        begin = np.cumsum(count) - count
        inner = np.arange(len(owner)) - np.repeat(begin, count)
        meets = np.zeros(len(owner), bool)
        for at, ranges in zip(begin.tolist(), table.column("open").to_pylist()):
            for r in ranges or ():
                meets[at + r["low"] : at + r["high"] + 1] = True
        data = b"".join(contents)
        repeated, head = repeated_suffixes(data, base[owner] + inner)
        out = [[] for _ in range(8)]

        def add(rows, start, length, kind, v1, v2):
            for o, v in zip(out, (*(i[rows] for i in ids), start, length, kind, v1, v2)):
                o.append(np.asarray(v, np.int64))

        hit = repeated & ~known[owner]
        edge = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]))
        stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]))
        zero = np.zeros(len(edge), np.int64)
        add(owner[edge], inner[edge], stop - edge + 1, zero, zero, zero)
        meet = np.flatnonzero(meets & (head == np.arange(len(owner))))
        digests = [xxhash.xxh3_128_intdigest(data[p : p + SPAN]) for p in (base[owner[meet]] + inner[meet]).tolist()]
        alone = ~repeated[meet] & ~known[owner[meet]]
        v1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
        v2 = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
        add(owner[meet], np.where(alone, inner[meet], -1), np.ones(len(meet), np.int64), np.ones(len(meet), np.int64), v1, v2)
        return pa.table({n: np.concatenate(o) for n, o in zip(("anchor", "c1", "c2", "start", "length", "kind", "v1", "v2"), out)})

    return contexts.groupBy("part").applyInArrow(run, "anchor long, c1 long, c2 long, start long, length long, kind long, v1 long, v2 long")


@releasing
def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t, size, spans array<struct<a, b>>): byte ranges to remove, which may
    overlap, for each distinct text that has any."""
    texts = _texts(df, id_col, text_col)
    rows = stored(_anchor_rows(texts), "anchors")
    copies = rows.groupBy("t", "size").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes"))
    distinct = stored(copies, "distinct-texts")
    release(rows)
    each = distinct.select("t", "size", F.posexplode("hashes").alias("k", "anchor"))
    counted = stored(each.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    listed = each.join(counted, "anchor").groupBy("t", "size").agg(F.collect_list("k").alias("listed"))
    listed = stored(listed, "listed")
    copied = stored(distinct.filter("n > 1").select("t", "size"), "copied-texts")
    release(distinct, counted)

    joined = with_met(texts.select("text", "t", "size"), F.col("t"), listed.select("t")).filter("__met").join(listed, ["t", "size"])
    contexts = stored(_contexts(joined), "contexts")
    release(listed)
    kinds = contexts.groupBy("anchor", "c1", "c2").agg(F.min("occurrence").alias("low"), F.max("occurrence").alias("high"), F.first("starts").alias("starts"), F.first("content").alias("content"))
    kinds = stored(kinds.withColumn("repeated", F.col("low") < F.col("high")).drop("low", "high"), "kinds")
    places = stored(contexts.select("anchor", "c1", "c2", "t", "size", "first"), "places")
    release(contexts)
    held = kinds.groupBy("anchor").agg(F.count("*").alias("held"), F.min("repeated").alias("all_repeated")).filter("held > 1 and not all_repeated").select("anchor", "held")
    unsorted = kinds.join(stored(held, "unsorted-anchors"), "anchor")
    unsorted = unsorted.withColumn("chunks", F.ceil(F.col("held") / CHUNK_CONTEXTS)).withColumn("chunk", F.pmod(F.xxhash64("c1", "c2"), F.col("chunks")))
    chunked = unsorted.filter("chunks > 1")
    chunked = chunked.join(_shared_cores(chunked), ["anchor", "c1", "c2"], "left")
    alone = unsorted.filter("chunks = 1").withColumn("open", F.lit(None).cast(chunked.schema["open"].dataType))
    groups = max(1, -(-unsorted.count() // GROUP_CONTEXTS))
    unsorted = alone.unionByName(chunked)
    found = stored(_sorted_groups(unsorted.withColumn("part", F.pmod(F.xxhash64("anchor", "chunk"), F.lit(groups)))), "sorted")

    runs = found.filter("kind = 0").select("anchor", "c1", "c2", "start", "length")
    open_ = found.filter("kind = 1")
    met = stored(open_.groupBy("v1", "v2").agg(F.count("*").alias("n")).filter("n > 1").select("v1", "v2"), "met")
    runs = runs.union(open_.filter("start >= 0").join(met, ["v1", "v2"], "left_semi").select("anchor", "c1", "c2", "start", "length"))
    whole = kinds.filter("repeated").select("anchor", "c1", "c2", F.lit(0).cast("long").alias("start"), F.col("starts").alias("length"))
    runs = stored(whole.union(runs), "runs")
    release(kinds, found)
    spans = places.join(runs, ["anchor", "c1", "c2"])
    a = F.col("first") + F.col("start")
    spans = spans.select("t", "size", F.struct(a.alias("a"), (a + F.col("length") - 1 + SPAN).alias("b")).alias("span"))
    all_ = copied.select("t", "size", F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")).alias("span"))
    return stored(spans.union(all_).groupBy("t", "size").agg(F.collect_set("span").alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, keep..., n_bytes, spans array<struct<a, b>>, kept binary, kept_sha256) for each row.

    `spans` are the maximal removed byte ranges of the UTF-8 text, `kept` what
    remains, which may begin or end inside a character; `as_text` gives it as a
    string without such parts of characters. A null text counts as empty. Repeated rows are elsewhere to each other. Columns not in `keep` are
    not read; an empty table gives an empty result.
    """
    spans = repeated_spans(df, id_col, text_col)
    names = ["id", *(f"keep_{i}" for i in range(len(keep)))]
    rows = _texts(df, id_col, text_col, keep)
    spans = spans.withColumnsRenamed({"t": "of_t", "size": "of_size"})
    joined = left_joined(rows, F.col("t"), spans, "of_t", (F.col("t") == F.col("of_t")) & (F.col("size") == F.col("of_size"))).select(*names, "text", "spans")

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                size, ranges, kept, sha = [], [], [], []
                for text, found in zip(part.column("text"), part.column("spans").to_pylist()):
                    data = bytes(text.as_buffer())
                    gone = merged(found or [])
                    at, left = 0, []
                    for a, b in gone:
                        left.append(data[at:a])
                        at = b
                    rest = b"".join([*left, data[at:]])
                    size.append(len(data)), ranges.append([{"a": a, "b": b} for a, b in gone]), kept.append(rest.decode(errors="ignore") if as_text else rest), sha.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(size, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                                                  pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sha, pa.string())], names=[*names, "n_bytes", "spans", "kept", "kept_sha256"])

    own = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in names)
    out = joined.mapInArrow(run, f"{own}, n_bytes long, spans array<struct<a:long,b:long>>, kept {'string' if as_text else 'binary'}, kept_sha256 string")
    return out.withColumnsRenamed({"id": id_col} | {f"keep_{i}": k for i, k in enumerate(keep)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
