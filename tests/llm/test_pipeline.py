"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import test_lines
import test_near
import test_suffix
from replaygate.llm import line_dedup
from replaygate.llm.words import left_joined, numbered, release, releasing, stored, with_met
from replaygate.session import checkpoint_root

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string"
WORDS = {"en": "the of and to in that is was for with they this have from are".split(), "de": "der die und das ist nicht ein mit auf für sich dem den von wird".split()}


def table():
    rng = random.Random(4)

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "en", "ish"]) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
    rows = [(None, None), ("", None), ("123 456", "en"), ("%%% ###", None)]
    passage, line = text("en", 60), text("de", 12)
    for i in range(60):
        lang = ["en", "de"][i % 2]
        body = text(lang, rng.randint(40, 120))
        if i % 6 == 0:
            body += "\n" + line
        if i % 5 == 1:
            body = body[:150] + " " + passage + " " + body[150:]
        rows.append((body, lang if i % 4 else None))
        if i % 10 == 3:
            copy = body.split(" ")
            copy[rng.randrange(len(copy))] = "changed"
            rows += [(" ".join(copy), lang), (body, lang)]
    return [(i, t, lang, "s", len(t) if t else None, "clash") for i, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.createDataFrame(table(), COLUMNS)]
    for name, stage in P.STAGES:
        docs.append(stored(stage(spark, docs[-1], ""), "stage"))
    return docs


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes
        assert all(r.n_chars == len(r.text) for r in df.collect() if r.text)


def test_language_stage_drops_what_has_no_language(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[:2])
    assert set(before) - set(after) == {d for d, t in before.items() if not t or not any(map(str.isalpha, t))}
    assert all(before[d] == t for d, t in after.items())


def test_language_stage_without_labels_keeps_what_has_letters(spark):
    rows = [(i, t, None, "s", None, "x") for i, t in enumerate(["the cat", "1 2 3", None, "é", ""])]
    got = P.identify_language(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 3] and got.columns == spark.createDataFrame(rows, COLUMNS).columns


def test_language_stage_drops_junk_and_keeps_clean_text(spark):
    junk = ["xq zzv kkq wqx jjz qqp vvx"] * 3 + ["qzxv wjkq " * 30]
    docs = spark.createDataFrame(table() + [(1000 + i, t, None, "s", len(t), "x") for i, t in enumerate(junk)], COLUMNS)
    kept = {r.doc_id for r in P.identify_language(spark, docs, "").collect()}
    assert not kept & {1000 + i for i in range(len(junk))}
    assert kept == {d for d, t, *_ in table() if t and any(map(str.isalpha, t))}


def test_line_stage_equals_brute_force(stages):
    want = []
    rows = rows_of(stages[1])
    counts = test_lines.brute(rows)
    for d, t in rows:
        n_lines, removed, _, sha = counts[d, t]
        want.append((d, n_lines - removed, sha))
    got = {d: t for d, t in rows_of(stages[2])}
    import hashlib
    for d, left, sha in want:
        if d in got:
            assert hashlib.sha256(got[d].encode()).hexdigest() == sha
        else:
            assert sha == hashlib.sha256(b"").hexdigest() or left == 0
    assert line_dedup.MIN_CHARS and len(got) < len(rows)


def test_near_stage_equals_brute_force(stages):
    kept = {d for d, _, _, own in test_near.brute(rows_of(stages[2])) if own}
    assert rows_of(stages[3]) == [(d, t) for d, t in rows_of(stages[2]) if d in kept]


def test_suffix_stage_equals_brute_force(stages):
    rows = rows_of(stages[3])
    got = dict(rows_of(stages[4]))
    removed = 0
    for (d, t), (size, gone, runs, _) in zip(rows, test_suffix.brute([t for _, t in rows])):
        removed += gone
        if gone == 0:
            assert got[d] == t
        else:
            assert d not in got or len(got[d].encode()) in (size - gone, size - gone - 1, size - gone - 2)
    assert removed > 0


def test_packing_stage_holds_every_token(stages):
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in rows_of(stages[4])}
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(total.values())
    assert np.array([p.offset + p.length <= 2048 for p in pieces]).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, ""), "stage")
    assert docs.count() == 0


def test_line_stage_drops_short_repeats(spark):
    rows = [(1, "All rights reserved.\nbody one"), (2, "body two\nAll rights reserved."), (3, "All rights reserved."), (4, "\n\nbody four")]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], 29), 2: ("body two", 8), 4: (rows[3][1], 11)}


def test_near_stage_decides_by_row(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(5))
    near = a + " more"
    rows = [(1, a), (7, near), (7, b),              # an id shared by a near copy and by unique text
            (8, c), (8, d), (8, d),                 # two texts to keep under one id, one of them twice
            (None, e), (None, e + " x"), (None, e), # a group without any id
            (None, b), (None, "alone of its kind"), (None, None), (None, " "), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, len(t) if t else None) for i, t in rows], "doc_id long, text string, n_chars long").repartition(4)
    got = P.drop_near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    group = [x for x in got if x[0] is None and (x[1] or "").startswith(e)]
    assert len(group) == 1
    want = [(1, a), (7, b), (8, c), (8, d), *group, (None, "alone of its kind"), (None, None), (None, " "), (9, None), (9, None)]
    assert got == sorted(want, key=str)


def folders(spark):
    root = checkpoint_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def read_by(df):
    return {f.split("/")[-2] for f in df.inputFiles()}


def test_a_stage_leaves_only_tables_that_its_result_reads(spark):
    docs = spark.createDataFrame(table(), COLUMNS)
    for name, stage in P.STAGES:
        before = folders(spark)
        out = stage(spark, docs, "")
        left = folders(spark) - before
        assert left and left == read_by(out) - read_by(docs), name
        docs = stored(out, "stage")


def test_run_leaves_only_tables_that_its_result_reads(spark, tmp_path):
    spark.createDataFrame(table(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    before = folders(spark)
    out = P.run(spark, str(tmp_path))
    assert folders(spark) - before == read_by(out) and out.count() > 0
    assert os.path.isdir(f"{tmp_path}/documents.parquet")


def test_release_deletes_only_what_the_function_stored(spark):
    given = stored(spark.range(5), "given")

    @releasing
    def inner():
        return stored(spark.range(3), "inner")

    @releasing
    def outer(df):
        a, b, c = stored(df, "a"), stored(df, "b"), inner()
        release(a, df)
        with pytest.raises(ValueError):
            fails()
        return b.join(c, "id")

    @releasing
    def fails():
        stored(spark.range(2), "lost")
        raise ValueError

    before = folders(spark)
    out = outer(given)
    assert {x.split("-")[0] for x in folders(spark) - before} == {"b", "inner", "lost"}
    assert given.count() == 5 and out.count() == 3


def test_stored_leaves_no_shuffle_files(spark):
    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if "/shuffle_" in f}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = shuffle_files(), spark.conf.get(setting, None)
    got = stored(spark.range(1000).repartition(3).groupBy("id").count(), "counts")
    for _ in range(40):
        if not shuffle_files() - before:
            break
        time.sleep(0.25)
    assert not shuffle_files() - before and got.count() == 1000
    assert spark.conf.get(setting, None) == kept


def test_a_stage_leaves_no_copy_of_the_texts(spark):
    docs = stored(spark.createDataFrame(table(), COLUMNS), "stage")
    for name, stage in P.STAGES:
        before = folders(spark)
        out = stage(spark, docs, "")
        for left in folders(spark) - before:
            assert "text" not in spark.read.parquet(f"{checkpoint_root(spark)}/{left}").columns, (name, left)
        docs = stored(out, "stage")


def test_numbers_of_rows_are_distinct_and_stay(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    twice = read.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, copied in ((read, False), (twice, True), (spark.range(7).toDF("id"), True), (read.limit(0), True)):
        got = numbered(df, "n")
        rows = sorted((r.id, r.n) for r in got.collect())
        assert got.columns == [*df.columns, "n"] and len({n for _, n in rows}) == len(rows) == df.count()
        assert rows == sorted((r.id, r.n) for r in got.repartition(3).collect())
        assert any(x.startswith("numbered-") for x in read_by(got)) == copied


def test_rows_without_a_partner_are_joined_too(spark):
    left = spark.createDataFrame([(i % 9 if i % 4 else None, f"t{i}") for i in range(60)], "k long, v string")
    keys = spark.createDataFrame([(k, [k or 0]) for k in (1, 3, 3, 77, None)], "of long, w array<long>")
    on = F.col("k").eqNullSafe(F.col("of"))
    got = left_joined(left, F.col("k"), keys, "of", on)
    want = left.join(keys, on, "left")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    met = {r.k: r["__met"] for r in with_met(left, F.col("k"), keys.select("of")).collect()}
    assert met == {k: k in (1, 3, None) for k in met} and len(met) > 5
    empty = left_joined(left, F.col("k"), keys.limit(0), "of", on)
    assert empty.count() == 60 and empty.filter("of is null and w is null").count() == 60
