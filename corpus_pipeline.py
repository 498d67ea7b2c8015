"""Corpus pipeline: documents -> packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`, with n_chars kept true to the text. `run`
writes each stage's rows as Parquet below the shared folder and hands the reread
table to the next stage. An empty table passes through every stage. A stage leaves
only those tables in the shared folder that its result reads, and `run` deletes a
stage's result when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replaygate.llm import hyperminhash, language_id, line_dedup, packing, suffix_dedup
from replaygate.llm.words import documents, numbered, release, releasing, stored

#: A document whose best language has a smaller share than this is rejected.
LEAST_SCORE = 0.5
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def _aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...], list]:
    """`docs` with the columns other than `own` under names that no operator uses;
    those names; and what selects the columns of `docs` again."""
    rest = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(rest), tuple(rest.values()), [F.col(rest.get(c, c)).alias(c) for c in docs.columns]


@releasing
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 9): learned from the labelled documents that are not
    held out. Documents without a letter go, those without a clear language, and
    those that are far less likely in their best language than any labelled text of
    it was. Where no label is there to learn from, every document with a letter stays."""
    learn = docs.filter(~language_id.held_out())
    langs, prob = language_id.train(learn)
    if not langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = numbered(docs, "__row")
    letters = rows.select("doc_id", "text", "lang", "__row", language_id.letters_of().alias("letters"))
    judged = stored(language_id.predict(letters, langs, prob, keep=("lang", "__row", "letters")), "judged")  # read for the floors and for the rows that go
    floors = language_id.least_likely(judged.filter(~language_id.held_out()), letters=F.col("letters"))
    floor = F.lit(float("-inf"))
    for lang, least in sorted(floors.items()):
        floor = F.when(F.col("lang_pred") == lang, F.lit(least)).otherwise(floor)
    unlikely = (F.col("per_char") < floor) & (F.col("letters") >= language_id.FLOOR_LETTERS)
    stays = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & ~unlikely
    gone = stored(judged.filter(~F.coalesce(stays, F.lit(False))).select("__row"), "rejected")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


@releasing
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 10): lines that stand earlier go, exact repeats whatever
    their length; a document that loses its last word goes with them."""
    left = line_dedup.drop_lines(docs, short_repeats=True)
    return _with_length(left.filter((F.col("__removed") == 0) | F.col("text").rlike(_HAS_WORD)), docs.columns)


@releasing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (operator 6): of each group one row stays, that with the
    smallest id (rows without an id come last) and of those the first stored row;
    rows without words stay."""
    rows = numbered(docs, "__row")
    gone = stored(hyperminhash.near_duplicates(rows, row_col="__row").filter("not kept").select("__row"), "near-duplicates")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


@releasing
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (operator 8): bytes of passages that repeat go, and what
    is left of a character cut in two; so does a document that loses its last word."""
    aside, rest, back = _aside(docs, ("doc_id", "text"))
    left = suffix_dedup.remove_repeats(aside, keep=rest, as_text=True).withColumnRenamed("kept", "text")
    left = left.filter((F.size("spans") == 0) | F.col("text").rlike(_HAS_WORD))
    return _with_length(left.select(*back), docs.columns)


@releasing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 3): the pieces of the remaining documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Language scores, sketches and BPE have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


@releasing
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        written = stored(left, f"pipeline-{name.replace(' ', '-')}")
        release(left, docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
