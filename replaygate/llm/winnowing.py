"""Document fingerprints by winnowing (operator 5), in DataFrame functions only.

A text's tokens are its words, words longer than TOKEN_CHARS cut into parts of
that length or, with `fine`, into single characters: a passage inside a long run
without white space then has the same tokens wherever it stands. Every run of
GRAM tokens has a rolling hash, the cyclic polynomial of its tokens' hashes: one
step turns the last hash by a bit, takes the token that leaves out and the one
that enters in. Of every WINDOW consecutive hashes the smallest is chosen, the
rightmost among equal ones, and kept with its position. Two texts that share
GRAM + WINDOW - 1 tokens in a row therefore share a fingerprint, and no shorter
run than GRAM tokens ever matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .words import documents

GRAM, WINDOW, TOKEN_CHARS = 5, 8, 16
#: Low bits of a choice hold its position, counted down so that the rightmost of equal hashes is the smallest.
PLACE_BITS = 24
#: Hashes rolled one from the other before the next is computed afresh; bounds the arrays that grow by one.
STRETCH = 16
#: Range buckets for each shuffle partition when documents are put in id order.
BUCKETS_PER_PARTITION = 4
_PLACES = (1 << PLACE_BITS) - 1


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Words of up to TOKEN_CHARS characters, longer ones cut into parts; and the same, longer ones cut into characters.
_PARTS = rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}"
_FINE = rf"(?<![^\x20\x09-\x0D]){_PARTS}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def turned(x: Column, bits: int) -> Column:
    """x with its 64 bits rotated to the left."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def rolled(h: Column, gram: int = GRAM) -> Column:
    """The cyclic-polynomial hash of each run of `gram` < 64 longs of the array h, which has at least one:
    the exclusive or of its members, the j-th from its end turned by j bits."""
    def afresh(at: Column) -> Column:
        out = turned(F.get(h, at), gram - 1)
        for j in range(1, gram):
            out = out.bitwiseXOR(turned(F.get(h, at + j), gram - 1 - j))
        return out

    def stretch(at: Column) -> Column:
        def step(done: Column, entering: Column) -> Column:
            n = F.size(done)
            last, leaving = F.get(done, n - 1), F.get(h, at + n - 1)
            return F.array_append(done, turned(last, 1).bitwiseXOR(turned(leaving, gram)).bitwiseXOR(entering))
        return F.aggregate(F.slice(h, at + gram + 1, F.lit(STRETCH - 1)), F.array(afresh(at)), step)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - gram, F.lit(STRETCH)), stretch))


def choices(text: Column, gram: int = GRAM, window: int = WINDOW, fine: bool = False) -> Column:
    """Chosen grams in text order, each a long: hash bits above PLACE_BITS place bits.

    A text of fewer tokens than a gram is one gram; one of fewer grams than a
    window is one window; a null text or one without a word has no choice. `fine`
    makes every character of a word over TOKEN_CHARS characters a token. Place
    bits count modulo 2**PLACE_BITS tokens.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FINE if fine else _PARTS), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def placed(h: Column, i: Column) -> Column:
        return h.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.lit(_PLACES) - F.pmod(i, F.lit(_PLACES + 1)))

    def grams(h: Column) -> Column:
        runs = F.transform(rolled(h, gram), placed)
        whole = F.array(placed(F.xxhash64(h), F.lit(0)))
        return F.when(F.size(h) >= gram, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    def minima(g: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(g) - window), lambda i: F.least(*(F.get(g, i + k) for k in range(window))))
        return F.when(F.size(g) >= window, F.array_distinct(all_)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)

    return let(let(hashes, grams), minima)


def choice_hash(choice: Column) -> Column:
    return F.shiftright(choice, PLACE_BITS)


def choice_position(choice: Column) -> Column:
    return F.lit(_PLACES) - choice.bitwiseAND(F.lit(_PLACES))


def fingerprint(chosen: Column) -> Column:
    """array<struct<position, hash>>: the fingerprint with its token positions."""
    return F.transform(chosen, lambda c: F.struct(choice_position(c).alias("position"), choice_hash(c).alias("hash")))


def fingerprint_text(chosen: Column) -> Column:
    """position:hash pairs in text order, the hash in hex."""
    return F.array_join(F.transform(chosen, lambda c: F.concat(choice_position(c).cast("string"), F.lit(":"), F.lower(F.hex(choice_hash(c).bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1)))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' chosen hashes, wherever they stand; 1 if neither has any."""
    def hashes(c):
        return F.array_distinct(F.transform(c, choice_hash))

    def share(x, y):
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))
    return let(hashes(a), lambda x: let(hashes(b), lambda y: share(x, y)))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fine: bool = False) -> DataFrame:
    """(id, fingerprint) of each row's whole text, one output row per input row."""
    return df.select(F.col(id_col), fingerprint(choices(F.col(text_col).cast("string"), fine=fine)).alias("fingerprint"))


def in_id_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, bucket, guest, place): rows dealt to ranges of ids.

    Sorted by (guest, place, tie), every bucket holds a run of the id order and,
    as guests at its end, the first row of the next bucket (the last bucket that
    of the first). Only ids are read for the ranges; their number follows
    spark.sql.shuffle.partitions, so the bounds on the driver do too. A null id
    comes before all others.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    ids = df.select(key.alias("place"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n).alias("at")).first()["at"] or []
    bounds = sorted(set(found))
    steps = [1 << i for i in range(max(1, len(bounds)).bit_length(), -1, -1)]

    def bucket(place: Column) -> Column:
        if not bounds:
            return F.lit(0)
        table = F.array(*map(F.lit, bounds)).cast("array<bigint>")
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.try_element_at(table, at + s) <= place, at + s).otherwise(at))

    firsts = {r["bucket"]: r["first"] for r in ids.groupBy(bucket(F.col("place")).alias("bucket")).agg(F.min("place").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # the first bucket's row goes to the last
    home = F.struct(bucket(F.col("place")).alias("bucket"), F.lit(False).alias("guest"))
    seats = F.array(home)
    if before:
        lookup = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
        guest = F.struct(lookup[F.col("place")].cast("int").alias("bucket"), F.lit(True).alias("guest"))
        seats = F.when(F.col("place").isin(*before), F.array(home, guest)).otherwise(seats)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("place"))
    return rows.withColumn("seat", F.explode(seats)).select("id", "text", "place", "seat.bucket", "seat.guest")


def compare_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fine: bool = False) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last quarter replaced by as many code points from the
    start of the next document in ascending id order (after the last: the first);
    of rows that share an id the order is by a hash of their text, then by the
    text. A null text counts as empty; a table of one row is followed by itself.
    """
    dealt = in_id_order(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    dealt = dealt.repartition("bucket").withColumn("chosen", choices(F.col("text"), fine=fine))
    order = W.partitionBy("bucket").orderBy("guest", "place", F.xxhash64("text"), "text")
    seen = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_chosen", F.lead("chosen").over(order)).filter(~F.col("guest"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    seen = seen.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    seen = seen.withColumn("edited_chosen", choices(F.col("edited"), fine=fine))
    return seen.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint_text(F.col("chosen")).alias("fingerprint"),
        fingerprint_text(F.col("edited_chosen")).alias("edited_fingerprint"), likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_documents(documents(spark, sf_dir), fine=True)
