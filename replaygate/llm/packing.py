"""Packing of documents into fixed-length sequences (operator 3).

Each document is tokenized, closed with an end id, and cut into pieces of at
most `capacity` ids. Pieces go to randomised groups, and each group is packed on
its own by first-fit decreasing; a tournament tree over the bins' free space
finds the first bin that fits in logarithmic time. Groups have a bounded number
of pieces, so their count grows with the input and none waits for another.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .words import RaggedCache, coded_words, documents, held_in_worker, letting_go, next_power, ragged_take, slices, stored

CAPACITY = 2048
END_ID = 1
#: Pieces in a group on average; a group is one task's unit of memory.
GROUP_PIECES = 4096


class WordEncoder:
    """Ids of words by the tokenizers library's own BPE model; bounded memory."""

    def __init__(self, path: str):
        self.vocab = wordbpe.load(path)
        self.pretokens = RaggedCache()

    def encode(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the words."""
        off, codes, distinct = self.vocab.pretokenize(words)
        flat, at = self.pretokens.get(distinct, self.vocab.library_ids)
        ids, at = ragged_take(flat, at, codes)
        return ids, at[off]


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (id, row, start, length, ids_crc32, doc_tokens) of every document.

    `row` tells input rows apart, so that repeated or null ids stay separate. A
    null or empty text is one piece, the end id. Other columns are not read.
    """
    path = vocabulary or wordbpe.vocabulary_path()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        encoder = held_in_worker(f"encoder {path}", lambda: WordEncoder(path))
        for batch in letting_go(batches):
            for part in slices(batch, "text"):
                off, codes, words = coded_words(part.column("text"))
                flat, word_off = encoder.encode(words)
                ids, at = ragged_take(flat, word_off, codes)
                doc_at = at[off]
                owner, start, size, crc, total = [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[doc_at[i] : doc_at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        owner.append(i), start.append(s), size.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes())), total.append(len(own))
                owner = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(owner), part.column("row").take(owner), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                    names=["id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, row long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) for sizes given in descending order, each in
    1..capacity. tree[1] is the largest free space of all bins; a piece walks
    down, to the left child whenever that one has room."""
    full = sum(1 for s in sizes if s == capacity)  # these come first, one bin each
    bins, offsets = list(range(full)), [0] * full
    rest = sizes[full:]
    leaves = next_power(max(1, len(rest)))
    tree = [capacity] * (2 * leaves)
    for s in rest:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        bins.append(full + node - leaves)
        offsets.append(capacity - tree[node])
        tree[node] -= s
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a >= b else b
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place pieces: adds sequence_id, offset and sequence_length (the padded
    length: `capacity`, or the filled length where that is a power of two).

    Ties among equal lengths go by (row, start). An empty input gives no rows.
    """
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # a document's full pieces need no company and are spread, its last piece goes with the document
    key = F.when(F.col("length") == capacity, F.xxhash64("row", "start")).otherwise(F.xxhash64("row"))
    grouped = pieces.withColumn("pack_group", F.pmod(key, F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("start", "ascending")])
        size = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(size.tolist(), capacity)
        used = np.bincount(bins, weights=size).astype(np.int64)
        padded = np.where((used & (used - 1)) == 0, used, capacity)[bins]
        sequence = table.column("pack_group").to_numpy() * 2**32 + np.array(bins, np.int64)
        for name, values in (("sequence_id", sequence), ("offset", np.array(offsets, np.int64)), ("sequence_length", padded)):
            table = table.append_column(name, pa.array(values))
        return table

    schema = grouped.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long, sequence_length long"
    return grouped.groupBy("pack_group").applyInArrow(place, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    placed = pack(token_pieces(df, id_col, text_col, vocabulary, capacity, end_id), capacity, group_pieces)
    return placed.drop("row", "pack_group").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
