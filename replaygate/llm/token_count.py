"""Token counts by rank-synchronous merging (operator 7).

Pre-tokens of a batch are held as ragged numpy arrays; every sequence merges
its lowest-ranked pair in the same round, and the surviving symbols are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .words import RaggedCache, coded_words, documents, held_in_worker, letting_go, row_sums, slices

TOKEN_LIMIT = 2048


class TokenCounter:
    """Counts tokens of words; one per Python worker, with bounded memory."""

    def __init__(self, path: str):
        self.vocab = wordbpe.load(path)
        self.pretokens = RaggedCache()

    def _count(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ones = np.ones(len(pretokens), np.int64)
        plain = np.array([self.vocab.special_id(p) < 0 for p in pretokens], bool)
        rows = [self.vocab.symbols(p) for p, own in zip(pretokens, plain.tolist()) if own]
        counts = ones.copy()
        if rows:
            counts[plain] = wordbpe.merge_all(self.vocab, rows)[1]
        return counts, ones

    def count_words(self, words) -> np.ndarray:
        off, codes, distinct = self.vocab.pretokenize(words)
        return row_sums(self.pretokens.get(distinct, self._count)[0][codes], off)

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        off, codes, words = coded_words(texts)
        if not len(words):
            return np.zeros(len(texts), np.int64)
        return row_sums(self.count_words(words)[codes], off)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of `df`, over its whole text.

    A null or empty text has 0 bytes and 0 tokens; null and repeated ids pass
    through, one output row per input row. Other columns are not read. A word of any
    length takes time in proportion to it, but for sorting.
    """
    path = vocabulary or wordbpe.vocabulary_path()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = held_in_worker(f"counter {path}", lambda: TokenCounter(path))
        for batch in letting_go(batches):
            for part in slices(batch, "text"):
                texts = part.column("text")
                size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(counter.count_texts(texts))],
                                                 names=["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
