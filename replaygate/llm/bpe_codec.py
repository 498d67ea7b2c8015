"""BPE encoding and decoding by speculation and verification (operator 4).

Greedy longest match proposes tokens for each pre-token. A vectorised check
decides for each adjacent pair whether byte-pair merging would ever join across
it; only pre-tokens with a failing pair are merged exactly.

The check: two adjacent tokens stay apart iff no symbol x on the right edge of
the first token's merge tree and y on the left edge of the second's have a merge
(x, y) ranked before x's own merge and not after y's own (of equal pairs the
leftmost merges first). A sequence is the merge result iff all its tokens encode
to themselves and every adjacent pair stays apart.

A failing pre-token is merged by the library's own merging, which takes n log n
steps for one of n characters.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .words import RaggedCache, coded_words, documents, held_in_worker, letting_go, ragged_take, row_sums, slices


class Codec:
    """Encoder and decoder of one vocabulary; memory is bounded by its caches."""

    def __init__(self, path: str):
        v = self.vocab = wordbpe.load(path)
        self.pretokens = RaggedCache()
        self.proposed = self.merged_exactly = 0
        tokens = [(s, i) for s, i in v.ids.items()]
        rows = [self._symbols_of(s) for s, _ in tokens]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
        _, left = wordbpe.merge_synchronously(v, flat, sizes)
        ok = [t for t, n in zip(tokens, left.tolist()) if n == 1]
        self.inner = {s: i for s, i in ok if not s.endswith(v.end)}
        self.final = {s[: -len(v.end)]: i for s, i in ok if s.endswith(v.end)}
        self.longest = max(map(len, (*self.inner, *self.final)))
        part = {int(m): (int(a), int(b)) for a, b, m in zip(v.left, v.right, v.made)}
        self.right_edge = self._edges(part, 1)
        self.left_edge = self._edges(part, 0)

    def _symbols_of(self, token: str) -> list[int]:
        v = self.vocab
        if token.endswith(v.end) and len(token) > len(v.end):
            return v.symbols(token[: -len(v.end)])
        return [v.symbol[c] for c in token]

    def _edges(self, part: dict, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the symbols on one edge of its merge tree, outermost
        first, and the rank at which each is itself merged (padded with -1)."""
        rows = []
        for t in range(self.vocab.size):
            row, x, rank = [], t, int(wordbpe.NO_RANK)
            while True:
                row.append((x, rank))
                if x not in part:
                    break
                rank, x = int(self.vocab.born[x]), part[x][side]
            rows.append(row)
        deep = max(map(len, rows))
        symbols = np.full((len(rows), deep), -1, np.int64)
        until = np.full((len(rows), deep), -1, np.int64)
        for t, row in enumerate(rows):
            symbols[t, : len(row)] = [x for x, _ in row]
            until[t, : len(row)] = [r for _, r in row]
        return symbols, until

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: whether merging leaves it as it is."""
        ok = np.ones(len(a), bool)
        (xs, x_until), (ys, y_until) = self.right_edge, self.left_edge
        for i in range(xs.shape[1]):
            rows = np.flatnonzero(ok & (xs[a, i] >= 0))
            if not len(rows):
                break
            for j in range(ys.shape[1]):
                here = rows[(ys[b[rows], j] >= 0) & ok[rows]]
                if not len(here):
                    break
                rank = self.vocab.ranks(xs[a[here], i], ys[b[here], j])
                ok[here[(rank < x_until[a[here], i]) & (rank <= y_until[b[here], j])]] = False
        return ok

    def propose(self, pretoken: str) -> list[int] | None:
        """Greedy longest match; None if it gets stuck."""
        out, at, n = [], 0, len(pretoken)
        while at < n:
            if n - at <= self.longest and (t := self.final.get(pretoken[at:])) is not None:
                out.append(t)
                return out
            for stop in range(min(n - 1, at + self.longest), at, -1):
                if (t := self.inner.get(pretoken[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
            else:
                return None
        return out

    def encode_pretokens(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes): proposals that pass the check, exact merging for the rest."""
        special = self.vocab.special_id
        guess = [self.propose(p) if p[0] != "\n" else [special(p)] for p in pretokens]
        sizes = np.array([len(g) if g else 0 for g in guess], np.int64)
        flat = np.fromiter((t for g in guess if g for t in g), np.int64, int(sizes.sum()))
        bad = sizes == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(guess)), sizes)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            keys, back = np.unique(flat[inside] * self.vocab.size + flat[inside + 1], return_inverse=True)
            ok = self.apart(keys // self.vocab.size, keys % self.vocab.size)[back]
            bad[owner[inside[~ok]]] = True
        wrong = np.flatnonzero(bad).tolist()
        self.proposed += len(pretokens)
        self.merged_exactly += len(wrong)
        tokenize = self.vocab.library.model.tokenize
        for i in wrong:
            guess[i] = [t.id for t in tokenize(pretokens[i])]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        return np.fromiter(itertools.chain.from_iterable(guess), np.uint32, int(sizes.sum())), sizes

    def encode_words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offsets, codes, word offsets): the ids of the distinct
        pre-tokens, and the pre-tokens of each word."""
        off, codes, distinct = self.vocab.pretokenize(words)
        flat, at = self.pretokens.get(distinct, self.encode_pretokens)
        return flat, at, codes, off

    def encode(self, text: str | None) -> list[int]:
        off, codes, words = coded_words(pa.array([text], pa.string()))
        flat, at, pre, word_off = self.encode_words(words)
        return ragged_take(flat, at, ragged_take(pre, word_off, codes)[0])[0].tolist()

    def decode(self, ids) -> str:
        """The vocabulary has no decoder rule: its strings joined by spaces; unknown ids are skipped."""
        return " ".join(self.vocab.strings[i] for i in ids if i in self.vocab.strings)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row's whole text; a null or empty text has no ids.
    One output row per input row, whatever its id; other columns are not read."""
    path = vocabulary or wordbpe.vocabulary_path()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = held_in_worker(f"codec {path}", lambda: Codec(path))
        for batch in letting_go(batches):
            for part in slices(batch, "text"):
                off, codes, words = coded_words(part.column("text"))
                flat, at, pre, word_off = codec.encode_words(words)
                pre, pre_at = ragged_take(pre, word_off, codes)
                ids, ids_at = ragged_take(flat, at, pre)
                rows = pa.ListArray.from_arrays(pa.array(ids_at[pre_at[off]], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), rows], names=["id", "ids"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def codec_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the encoded ids and
    of their decoded text, without moving the ids out of the task."""
    path = vocabulary or wordbpe.vocabulary_path()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = held_in_worker(f"codec {path}", lambda: Codec(path))
        for batch in letting_go(batches):
            for part in slices(batch, "text"):
                off, codes, words = coded_words(part.column("text"))
                flat, at, pre, word_off = codec.encode_words(words)
                pre, pre_at = ragged_take(pre, word_off, codes)
                bounds, count = pre_at[off], np.diff(at)
                # ids and strings of each distinct pre-token, joined once
                ids, cuts = flat.tolist(), at.tolist()
                shown = np.array([" ".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])], object)
                text = np.array([codec.decode(ids[a:b]) for a, b in zip(cuts, cuts[1:])], object)
                n, enc, dec = row_sums(count[pre], bounds), [], []
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    enc.append(hashlib.sha256(" ".join(shown[pre[a:b]]).encode()).hexdigest())
                    dec.append(hashlib.sha256(" ".join(text[pre[a:b]]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())],
                                                 names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(documents(spark, sf_dir))
