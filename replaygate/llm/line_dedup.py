"""Line dedup by a segment-partition edit join (operator 10).

Lines of at least MIN_CHARS characters are compared over the whole table. A line
is removed where it stands if the same line, or one within MAX_EDITS = 1 edits
(insertion, deletion, substitution of a character), stands earlier: in a document
with a smaller id, or higher up in the same one. Shorter lines are left alone, or, with `short_repeats`,
non-blank ones are removed where the same line stands earlier.

Two lines within one edit share one of the shorter's two segments, at a place
that the lengths fix, so every distinct line is entered under its own segments
and looked up under those of its own length and of one less. Lines that meet
under a key are verified by banded bit-parallel edit distance.

A key that more than HOT distinct lines share (lines that differ in a few places
only) is not paired up. Its lines are entered under the hash of each variant
with one character left out: lines with the same variant at the same place are
one substitution apart from each other and are linked to the earliest of them;
a line that equals another's variant is one deletion away. Both are exact, and
their number is linear in the lines' length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hyperminhash import mix
from .words import documents, left_joined, release, releasing, slices, stored, unburdened

MAX_EDITS = 1
MIN_CHARS = 24
#: Characters of which a blank line consists.
BLANK = " \t\n\v\f\r"
#: Distinct lines under a key that are compared pair by pair.
HOT = 32
#: Characters of line pairs verified at once in a task.
VERIFY_CELLS = 4_000_000
#: Rows of line variants handed over at once.
VARIANT_ROWS = 200_000
#: Bits of the map that keeps most unwanted lines out of a shuffle: 2 MB, 24 bits of a digest.
BITMAP_BITS = 1 << 24


def segments(length: int, edits: int = MAX_EDITS) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 segments of nearly equal size, the longer ones last."""
    parts = edits + 1
    small, extra = divmod(length, parts)
    sizes = [small] * (parts - extra) + [small + 1] * extra
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def probes(length: int, other: int, edits: int = MAX_EDITS) -> list[tuple[int, int, int]]:
    """(segment, start, size): the substrings of a line of `length` that can equal
    a segment of a line of `other` <= length characters (multi-match-aware)."""
    delta, out = length - other, []
    for i, (start, size) in enumerate(segments(other, edits)):
        low = max(0, start - i, start + delta - (edits - i))
        high = min(length - size, start + i, start + delta + (edits - i))
        out += [(i, s, size) for s in range(low, high + 1)]
    return out


def line_keys(line: str, edits: int = MAX_EDITS) -> tuple[list[int], list[int]]:
    """(keys under which it is entered, further keys under which it looks)."""
    n = len(line)

    def key(other, seg, start, size):
        return xxhash.xxh3_64_intdigest(f"{other} {seg} {line[start : start + size]}") - (1 << 63)
    entered = [key(n, i, s, size) for i, (s, size) in enumerate(segments(n, edits))]
    looked = {key(o, i, s, size) for o in range(max(1, n - edits), n + 1) for i, s, size in probes(n, o, edits)}
    return entered, sorted(looked - set(entered))


def edit_distances(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """For each pair whose lengths differ by at most `edits`: its edit distance,
    or some number above `edits`. Bit r of a word is row j - edits + r of column
    j; all pairs advance one column a step."""
    if not a:
        return np.zeros(0, np.int64)
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    width, longest = 2 * edits + 1, int(n.max())
    rows = np.full((len(a), longest + 2 * edits + 1), 0xFFFFFFFE, np.uint32)  # a, `edits` places to the right
    cols = np.full((len(a), longest + 1), 0xFFFFFFFF, np.uint32)
    for i, (x, y) in enumerate(zip(a, b)):
        rows[i, edits : edits + len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        cols[i, : len(y)] = np.frombuffer(y.encode("utf-32-le"), np.uint32)
    one, mask = np.uint64(1), np.uint64((1 << width) - 1)
    vp = np.full(len(a), ((1 << width) - 1) & ~((1 << edits) - 1), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    score = np.full(len(a), edits, np.int64)
    last_p, last_n, last_score = vp.copy(), vn.copy(), score.copy()
    for j in range(longest):
        x = np.zeros(len(a), np.uint64)
        for r in range(width):
            x |= (rows[:, j + r] == cols[:, j]).astype(np.uint64) << np.uint64(r)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        score = score + 1 - (d0 >> np.uint64(width - 1)).astype(np.int64)
        down_p, down_n = hn | (~((d0 >> one) | hp) & mask), (d0 >> one) & hp
        ended = n == j + 1
        last_score[ended], last_p[ended], last_n[ended] = score[ended], down_p[ended], down_n[ended]
        vp, vn = down_p, down_n
    # the last column's lowest row is n + edits; walk up to row m. Bit r of the vertical
    # differences is row n + 1 - edits + r, the one above row n + edits is bit width - 2
    out = last_score
    for up in range(2 * edits):
        bit = np.uint64(max(0, width - 2 - up))
        step = ((last_p >> bit) & one).astype(np.int64) - ((last_n >> bit) & one).astype(np.int64)
        out = out - np.where(n + edits - up > m, step, 0)
    return out


def _lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line)


def line_occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False) -> DataFrame:
    """(id, text_hash, line_no, digest, keys): one row per long enough line; the
    first keys are its own segments, the others it looks under only. With
    `short_repeats` also one row, without keys, per shorter line that is not blank."""
    src = _lines_of(df, id_col, text_col)

    def run(batches):
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                owner, number, digest, keys, known = [], [], [], [], {}
                for i, text in enumerate(pc.fill_null(part.column("text"), "").to_pylist()):
                    for k, line in enumerate(text.split("\n")):
                        if len(line) >= MIN_CHARS or (short_repeats and line.strip(BLANK)):
                            if line not in known:
                                entered, looked = line_keys(line) if len(line) >= MIN_CHARS else ([], [])
                                known[line] = (_digest(line), entered + looked)
                            d, ks = known[line]
                            owner.append(i), number.append(k), digest.append(d), keys.append(ks)
                owner = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(owner), part.column("text_hash").take(owner), pa.array(number, pa.int32()),
                                                  pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "line_no", "digest", "keys"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text_hash long, line_no int, digest binary, keys array<long>")


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, one set for the first bits of each wanted digest. Its size
    is fixed, whatever the number of digests; it only spares rows a shuffle."""
    place = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)))
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    for r in words:
        out[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return out


def _texts(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(line, content) of the distinct lines in `wanted` (line, digest), read from the documents again."""
    src = _lines_of(df, id_col, text_col).select("text")
    bitmap = df.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        bits = np.unpackbits(bitmap.value.view(np.uint8), bitorder="little")
        for batch in unburdened(batches):
            for part in slices(batch, "text"):
                lines = {x for text in pc.fill_null(part.column("text"), "").to_pylist() for x in text.split("\n") if len(x) >= MIN_CHARS}
                found = [(d, x) for d, x in ((_digest(x), x) for x in lines) if bits[int.from_bytes(d[:3], "big")]]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], names=["digest", "content"])

    found = src.mapInArrow(run, "digest binary, content string").join(wanted, "digest")
    return stored(found.dropDuplicates(["line"]).select("line", "content"), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def side(name):
        return texts.select(F.col("line").alias(name), F.col("content").alias(f"{name}_text"))

    def run(batches):
        for batch in unburdened(batches):
            a, b = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
            order = sorted(range(len(a)), key=lambda i: len(b[i]))
            keep, at = np.zeros(len(a), bool), 0
            while at < len(order):
                stop = at + 1
                while stop < len(order) and (stop + 1 - at) * len(b[order[stop]]) <= VERIFY_CELLS:
                    stop += 1
                rows = order[at:stop]
                ok = [i for i in rows if abs(len(a[i]) - len(b[i])) <= MAX_EDITS]
                keep[ok] = edit_distances([a[i] for i in ok], [b[i] for i in ok], MAX_EDITS) <= MAX_EDITS
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


_BASES = tuple(int(x) | 1 for x in mix(np.array([101, 202], np.uint64)))


def variant_hashes(line: str) -> tuple[np.ndarray, np.ndarray]:
    """[2, n] hashes of the line without its i-th character, and [2, 1] of the
    whole line; a line's whole hash equals the hash of any variant that is that line."""
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c)
    part, whole = [], []
    for base in _BASES:
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]))
        upto = np.concatenate([[np.uint64(0)], np.cumsum(mix(c + np.uint64(base & 0xFFFF)) * power, dtype=np.uint64)])
        back = np.uint64(pow(base, -1, 1 << 64))
        part.append(mix(upto[:n] + (upto[n] - upto[1:]) * back + np.uint64(n - 1)))
        whole.append(mix(upto[n:] + np.uint64(n)))
    return np.array(part).view(np.int64), np.array(whole).view(np.int64)


@releasing
def _hot_links(hot: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b) links among the lines (line, content) of hot keys."""
    def run(batches):
        for batch in unburdened(batches):
            rows, held = [], 0
            for line, text in zip(batch.column("line").to_pylist(), batch.column("content").to_pylist()):
                part, whole = variant_hashes(text)
                for at in range(0, len(text), VARIANT_ROWS):
                    cut = part[:, at : at + VARIANT_ROWS]
                    rows.append((cut[0], cut[1], np.arange(at, at + cut.shape[1]), np.full(cut.shape[1], line)))
                    held += cut.shape[1]
                    if held >= VARIANT_ROWS:
                        yield pack(rows)
                        rows, held = [], 0
                rows.append((whole[0], whole[1], np.array([-1]), np.array([line])))
            if rows:
                yield pack(rows)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64)) for i in range(4)], names=["v1", "v2", "place", "line"])

    variants = stored(hot.mapInArrow(run, "v1 long, v2 long, place long, line long"), "variants")
    same = variants.filter("place >= 0").groupBy("v1", "v2", "place").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low < high").select("v1", "v2", "place")
    groups = stored(variants.join(stored(same, "same-variant"), ["v1", "v2", "place"]).join(firsts, "line"), "substitutions")
    heads = stored(groups.groupBy("v1", "v2", "place").agg(F.min_by("line", "first").alias("a")), "variant-heads")
    swapped = groups.join(heads, ["v1", "v2", "place"]).select("a", F.col("line").alias("b"))
    short = variants.filter("place < 0").select("v1", "v2", F.col("line").alias("a"))
    dropped = variants.filter("place >= 0").select("v1", "v2", F.col("line").alias("b")).join(short, ["v1", "v2"]).select("a", "b")
    return swapped.union(dropped).filter("a <> b").distinct()


@releasing
def decide_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False) -> DataFrame:
    """(id, text_hash, removed array<int>, n_near) for each document that loses lines.

    `removed` holds line numbers from 0, `n_near` how many of them stand for a
    line that no equal line precedes. Rows with the same id and text get the same
    result; a null id counts as larger than any other. `short_repeats` takes exact
    repeats of non-blank lines under MIN_CHARS characters as well.
    """
    lines = stored(line_occurrences(df, id_col, text_col, short_repeats), "lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "line_no")
    distinct = lines.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    distinct = stored(distinct.withColumn("line", F.monotonically_increasing_id()), "distinct-lines")
    firsts = distinct.select("line", "first")

    keys = distinct.select("line", F.posexplode("keys").alias("rank", "key")).select("line", "key", (F.col("rank") <= MAX_EDITS).alias("entered"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("entered").cast("int")).alias("entered")).filter("n > 1 and entered = 1").select("key", "n")
    shared = stored(shared, "shared-keys")
    members = stored(keys.join(shared, "key"), "key-members")
    release(shared)
    cold = members.filter(F.col("n") <= HOT)
    pairs = (cold.filter("entered").select("key", F.col("line").alias("x")).join(cold.select("key", F.col("line").alias("y")), "key").filter("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    pairs = stored(pairs, "line-pairs")
    hot = stored(members.filter(F.col("n") > HOT).select("line").distinct(), "hot-lines")
    release(members)
    needed = pairs.select(F.col("a").alias("line")).union(pairs.select(F.col("b").alias("line"))).union(hot).distinct()
    wanted = stored(distinct.select("line", "digest").join(needed, "line", "left_semi"), "wanted-lines")
    texts = _texts(df, id_col, text_col, wanted)
    hot_links = _hot_links(texts.join(hot, "line", "left_semi"), firsts)
    links = stored(_verified(pairs, texts).union(hot_links), "line-links")
    release(hot_links, pairs, texts, wanted, hot)

    both = links.union(links.select("b", "a")).toDF("line", "other")
    earliest = both.join(firsts.select(F.col("line").alias("other"), "first"), "other").groupBy("line").agg(F.min("first").alias("before"))
    judged = distinct.join(earliest, "line", "left").select("digest", "first", "n", F.coalesce(F.col("before") < F.col("first"), F.lit(False)).alias("near"))
    judged = stored(judged.filter("n > 1 or near"), "judged-lines")
    release(links, distinct)
    gone = lines.drop("keys").withColumn("here", place).join(judged, "digest").filter(F.col("near") | (F.col("here") != F.col("first")))
    gone = gone.withColumn("only_near", F.col("near") & (F.col("here") == F.col("first")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("line_no").alias("removed"), F.count_distinct(F.when(F.col("only_near"), F.col("line_no"))).alias("n_near"))


@releasing
def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False) -> DataFrame:
    """`df` with the text's repeated lines left out, and n_lines, n_removed, n_near
    in columns named __lines, __removed and __near.

    A null text stays null and has no lines; a text that loses every line is
    empty. Other columns, whatever their names, pass through; an empty table
    gives an empty one.
    """
    gone = stored(decide_lines(df, id_col, text_col, short_repeats), "removed-lines").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__list"), F.col("n_near").alias("__near"))
    text = F.col(text_col).cast("string")
    joined = left_joined(df, F.xxhash64(text), gone, "__hash", F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")))
    lines = F.split(text, "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__list"), i)), "\n")
    return joined.select(
        *(F.when(F.col("__list").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(c) for c in df.columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__lines"), F.coalesce(F.size("__list"), F.lit(0)).cast("long").alias("__removed"),
        F.coalesce("__near", F.lit(0)).cast("long").alias("__near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, those of them with no equal line before, and the digest of what is left.

    Repeats of non-blank lines go whatever their length; lines of MIN_CHARS characters and more are compared with one edit too."""
    docs = drop_lines(documents(spark, sf_dir).select("doc_id", "text"), short_repeats=True)
    return docs.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__near").alias("n_near"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no
  FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT *, length(line) AS size FROM l
  WHERE length(line) >= 24 OR trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), f AS (
  SELECT line, size, min({'d': doc_id, 'n': no}) AS first FROM e GROUP BY line, size
), near AS (
  SELECT DISTINCT a.line FROM (SELECT *, unnest([size - 1, size, size + 1]) AS other FROM f WHERE size >= 24) a
  JOIN f b ON b.size = a.other AND b.first < a.first
  WHERE b.size >= 24 AND levenshtein(a.line, b.line) <= 1
), t AS (
  SELECT l.*, size IS NOT NULL AND near.line IS NOT NULL AND f.first = {'d': doc_id, 'n': no} AS only_near,
         size IS NOT NULL AND (near.line IS NOT NULL OR f.first <> {'d': doc_id, 'n': no}) AS gone
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line
)
SELECT d.doc_id, count(t.no) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (only_near) AS n_near,
       sha256(coalesce(string_agg(t.line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
GROUP BY d.doc_id
"""
