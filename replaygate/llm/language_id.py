"""Language identification by segmentation-marginalised unigrams (operator 9).

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, which the
forward algorithm gets in one pass; a text's is the product over its words.
Pieces are learned by expectation maximisation over the word counts of a bounded
sample of labelled rows; every row is then scored over its whole text.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .words import RaggedCache, coded_words, documents, held_in_worker, letting_go, row_sums, slices, stored

VOCABULARY = "piece_bpe_32k.model"
#: Labelled rows learned from, at most, for each language.
SAMPLE_ROWS = 400
EM_ROUNDS = 3
#: Words of up to so many characters with their start mark are scored together, longer ones
#: one by one with rescaled sums. Learning takes longer words in chunks of this size.
CHUNK = 32
#: Chunks scored at once.
BATCH = 8_192
SMOOTHING = 0.01
UNKNOWN = "und"
WORD_START = "▁"


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[dict[str, int], frozenset[str]]:
    """(piece -> number, all proper prefixes); number 0 stands for any character without a piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {p: i + 1 for i, p in enumerate(dict.fromkeys(names))}
    return pieces, frozenset(p[:k] for p in pieces for k in range(1, len(p)))


@lru_cache(maxsize=2)
def trie_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, target, piece): the pieces as a trie of numbered nodes, the root is 0. A
    step is its node and next character in one number, in rising order; piece is 0 for a
    node that is only a prefix."""
    pieces, prefixes = pieces_of(path)
    node = {"": 0} | {s: i + 1 for i, s in enumerate(sorted(prefixes | pieces.keys()))}
    names = [s for s in node if s]
    steps = np.array([node[s[:-1]] << 21 | ord(s[-1]) for s in names], np.int64)
    order = np.argsort(steps)
    piece = np.array([0, *(pieces.get(s, 0) for s in names)], np.int64)
    return steps[order], np.array([node[s] for s in names], np.int64)[order], piece


def chunks_of(words: list[str]) -> tuple[list[str], np.ndarray]:
    """(chunks, owner): each word with its start mark, cut after every CHUNK characters."""
    chunks, owner = [], []
    for w, word in enumerate(words):
        word = WORD_START + word
        for at in range(0, len(word), CHUNK):
            chunks.append(word[at : at + CHUNK]), owner.append(w)
    return chunks, np.array(owner, np.int64)


class Lattice:
    """All pieces in a list of chunks: arcs from one character position to a later one."""

    def __init__(self, path: str, chunks: list[str]):
        steps, target, piece = trie_of(path)
        self.ends = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(self.ends) - self.ends
        chunk = np.repeat(np.arange(len(chunks)), self.ends)
        begin = np.arange(len(chars)) - first[chunk]
        room = self.ends[chunk] - begin
        # all positions walk down the trie at once; an arc is one number: stop (12 bits), chunk (20), begin (12), piece (20)
        at, node, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        arcs = []
        while len(at):
            step = node << 21 | chars[at + length]
            length += 1
            found = np.minimum(np.searchsorted(steps, step), len(steps) - 1)
            known = steps[found] == step
            node = np.where(known, target[found], 0)
            number = piece[node]  # the root's is 0
            ends = (number > 0) | (length == 1)
            arcs.append(begin[at[ends]] + length << 52 | chunk[at[ends]] << 32 | begin[at[ends]] << 20 | number[ends])
            on = known & (room[at] > length)
            at, node = at[on], node[on]
        packed = np.sort(np.concatenate([np.zeros(0, np.int64), *arcs]))
        self.chunk, self.begin, self.stop, self.piece = packed >> 32 & (1 << 20) - 1, packed >> 20 & 4095, packed >> 52, packed & (1 << 20) - 1
        self.longest = int(self.ends.max(initial=0))
        self.cuts = np.searchsorted(self.stop, np.arange(self.longest + 2))

    def _arcs(self, j: int) -> slice:
        return slice(self.cuts[j], self.cuts[j + 1])

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[chunk, position, language]: probability of the characters before it."""
        alpha = np.zeros((len(self.ends), self.longest + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, self.longest + 1):
            arcs = self._arcs(j)
            rows = self.chunk[arcs]
            term = alpha[rows, self.begin[arcs]] * prob[self.piece[arcs]]
            for k in range(prob.shape[1]):
                alpha[:, j, k] = np.bincount(rows, term[:, k], len(self.ends))
        return alpha

    def log_prob(self, prob: np.ndarray) -> np.ndarray:
        """log P(chunk | language) for each chunk."""
        alpha = self.forward(prob)
        return np.log(np.maximum(alpha[np.arange(len(self.ends)), self.ends], np.finfo(float).tiny))

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece under `prob` (one language) given the chunks' counts."""
        alpha = self.forward(prob[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.ends)), self.ends] = 1
        for j in range(self.longest, 0, -1):  # an arc that ends at j needs beta at j only
            arcs = self._arcs(j)
            np.add.at(beta, (self.chunk[arcs], self.begin[arcs]), beta[self.chunk[arcs], j] * prob[self.piece[arcs]])
        total = np.maximum(alpha[np.arange(len(self.ends)), self.ends], np.finfo(float).tiny)
        weight = alpha[self.chunk, self.begin] * prob[self.piece] * beta[self.chunk, self.stop] * (counts / total)[self.chunk]
        return np.bincount(self.piece, weight, len(prob))


def score_long_word(path: str, prob: np.ndarray, word: str) -> np.ndarray:
    """log P(word | language) of one word of any length: the forward sums of the last
    positions are kept, relative to the last one of each language."""
    pieces, prefixes = pieces_of(path)
    word, longest = WORD_START + word, max(map(len, pieces))
    ending: dict[int, list[tuple[int, int]]] = {}
    sums, log_scale = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            sub = word[i:j]
            p = pieces.get(sub)
            if p is not None or j == i + 1:
                ending.setdefault(j, []).append((i, p or 0))
            if sub not in prefixes:
                break
        # every piece that ends after character i is known now
        total = sum(sums[k - (i + 1)] * prob[p] for k, p in ending.pop(i + 1))
        total = np.maximum(total, np.finfo(float).tiny)
        log_scale += np.log(total)
        sums = [x / total for x in sums[-longest:]] + [np.ones(prob.shape[1])]
    return log_scale


def score_words(path: str, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) over all segmentations, BATCH words at a time."""
    out = np.zeros((len(words), prob.shape[1]))
    long = [w for w, word in enumerate(words) if len(word) >= CHUNK]
    for w in long:
        out[w] = score_long_word(path, prob, words[w])
    chunks, owner = chunks_of(["" if len(word) >= CHUNK else word for word in words] if long else words)
    if long:
        keep = np.ones(len(words), bool)
        keep[long] = False
        chunks, owner = [c for c, o in zip(chunks, owner.tolist()) if keep[o]], owner[keep[owner]]
    for at in range(0, len(chunks), BATCH):
        part = Lattice(path, chunks[at : at + BATCH]).log_prob(prob)
        for k in range(prob.shape[1]):
            out[:, k] += np.bincount(owner[at : at + BATCH], part[:, k], len(words))
    return out


def learn_pieces(path: str, words: list[str], counts: np.ndarray, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation from a uniform start."""
    size = len(pieces_of(path)[0]) + 1
    chunks, owner = chunks_of(words)
    parts = [(Lattice(path, chunks[at : at + BATCH]), counts[owner[at : at + BATCH]]) for at in range(0, len(chunks), BATCH)]
    prob = np.full(size, 1 / size)
    for _ in range(rounds):
        n = sum(lattice.expected(prob, weight) for lattice, weight in parts) + SMOOTHING
        prob = n / n.sum()
    return prob


def sample_ids(df: DataFrame, id_col: str, lang_col: str, rows: int, seed: int = 0) -> DataFrame:
    """At most `rows` ids for each language, those with the smallest hash; only ids and labels are shuffled."""
    marked = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    # the table of languages comes to the ids, so that no language's ids go to one task
    sizes = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    near = marked.withColumn("n", F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")] if sizes else F.lit(0)).filter(F.pmod("h", F.lit(1 << 20)) * F.col("n") <= F.lit((1 << 20) * 4 * rows))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).filter(F.col("rank") <= rows).select("id").distinct()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None,
          sample_rows: int = SAMPLE_ROWS, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probability[piece, language]) learned from rows with text, id and label."""
    path = vocabulary or _path()
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = stored(sample_ids(labelled, id_col, lang_col, sample_rows).withColumnRenamed("id", "sampled"), "sampled-ids")
    rows = labelled.join(ids, F.col(id_col) == F.col("sampled"), "left_semi").select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                off, codes, words = coded_words(part.column("text"))
                lang = np.repeat(np.array(part.column("lang").to_pylist(), object), np.diff(off))
                for name in set(lang):
                    n = np.bincount(codes[lang == name], minlength=len(words))
                    seen = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), words.take(pa.array(seen)).cast(pa.string()), pa.array(n[seen], pa.int64())], names=["lang", "word", "n"])

    counts = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toPandas()
    langs = sorted(counts["lang"].unique())
    learned = []
    for name in langs:
        own = counts[counts["lang"] == name]
        learned.append(learn_pieces(path, own["word"].tolist(), own["n"].to_numpy(float), rounds))
    return langs, np.array(learned).T


def _path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def predict(df: DataFrame, langs: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """(id, keep..., lang_pred, score, per_char): the likeliest language of each whole
    text, its posterior under equal priors, and the text's log-likelihood in it per
    character of its words (0 without any). `und` with score 0 where the text is null or
    has no letter, or nothing was learned. Ties go to the first language by name.

    The model (pieces x languages) travels as a broadcast; its size is fixed by
    the vocabulary and the number of languages.
    """
    path = vocabulary or _path()
    kept = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep) if k != text_col]
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *kept)
    model = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(prob))
    name = uuid.uuid4().hex

    def run(batches):
        def scores(fresh):
            return score_words(path, table, fresh).ravel(), np.full(len(fresh), len(langs))

        table, cache = model.value, held_in_worker(f"words of model {name}", lambda: RaggedCache(300_000, float))
        for batch in letting_go(batches):
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                names, score, per_char = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows)
                off, codes, words = coded_words(texts)
                if len(langs) and len(words):
                    sizes = row_sums(pc.utf8_length(words).to_numpy(zero_copy_only=False)[codes], off)
                    rows = cache.get(words.to_pylist(), scores)[0].reshape(-1, len(langs))
                    total = np.zeros((part.num_rows, len(langs)))
                    for k in range(len(langs)):
                        sums = np.concatenate([[0], np.cumsum(rows[codes, k])])
                        total[:, k] = sums[off[1:]] - sums[off[:-1]]
                    per_char = total.max(axis=1) / np.maximum(sizes, 1)
                    total -= total.max(axis=1, keepdims=True)
                    share = np.exp(total)
                    best = share.argmax(axis=1)
                    names[letters] = np.array(langs, object)[best][letters]
                    score = np.where(letters, 1 / share.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column("text" if k == text_col else f"keep_{i}") for i, k in enumerate(keep)), pa.array(names, pa.string()), pa.array(score), pa.array(per_char)], names=columns)

    columns = ["id", *(f"keep_{i}" for i in range(len(keep))), "lang_pred", "score", "per_char"]
    of = dict(zip(columns[1:], ("text" if k == text_col else f"keep_{i}" for i, k in enumerate(keep)))) | {"id": "id"}
    schema = ", ".join(f"{c} {src.schema[of[c]].dataType.simpleString()}" for c in columns[:-3])
    out = src.mapInArrow(run, f"{schema}, lang_pred string, score double, per_char double").withColumnRenamed("id", id_col)
    for i, k in enumerate(keep):
        out = out.withColumnRenamed(f"keep_{i}", k)
    return out


#: A text of fewer letters is never too unlikely.
FLOOR_LETTERS = 20
FLOOR_MARGIN = 1.25


def letters_of(text_col: str = "text"):
    return F.char_length(F.regexp_replace(F.col(text_col), r"[^\p{L}]", ""))


def least_likely(judged: DataFrame, text_col: str = "text", lang_col: str = "lang", letters: Column | None = None) -> dict[str, float]:
    """For each language the least log-likelihood per character that a text in it
    should have: FLOOR_MARGIN times the least of all labelled rows of `judged` (rows of
    `predict` with their label), where a text without that many letters or taken for
    another language counts not. `letters` is their number where it is known."""
    letters = letters_of(text_col) if letters is None else letters
    told = judged.filter((F.col(lang_col).cast("string") == F.col("lang_pred")) & (letters >= FLOOR_LETTERS))
    least = told.groupBy("lang_pred").agg(F.min("per_char").alias("least")).collect()  # a row a language
    return {r["lang_pred"]: FLOOR_MARGIN * r["least"] for r in least}


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from; a null id counts as one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of `df`; one output row per input row."""
    langs, prob = train(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    out = predict(df, langs, prob, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
