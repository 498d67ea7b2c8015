"""Operators 2 (quality rules) and 9 (language identification) against brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from replaygate.llm import language_id, quality_rules

SF01 = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "one", "a b c d e f g h " * 5, "a b c d e f g h\n" * 5 + "x", "# $ %" * 20, "WORD " * 40, "é" * 50000 + " ü", "1 2 3"]


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, ["en", None, "de"][i % 3], f"s{i % 2}", "clash", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, kept double")


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = defaultdict(list)
    for i in range(len(words) - 7):
        runs[tuple(words[i:i + 8])].append(i)
    inside = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_floor_is_the_least_of_all_labelled_rows(spark):
    """The one unlikely text among more rows of a language than any sample held counts."""
    rows = [(i, "a text with well over twenty letters", "en", "en", -2.0) for i in range(1500)]
    rows += [(2000, "another text with over twenty letters", "en", "en", -6.0), (2001, "too few letters", "en", "en", -9.0),
             (2002, "a text taken for another language", "en", "de", -8.0), (2003, "a text without any label at all", None, "en", -8.0)]
    judged = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, per_char double")
    assert language_id.least_likely(judged) == {"en": language_id.FLOOR_MARGIN * -6.0}


def test_counts_equal_brute_force(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(150).collect()] + ["same text here"] * 3
    got = quality_rules.apply_rules(frame(spark, texts)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[f] for f in fields) for r in got) == Counter(map(brute_counts, texts))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_sketch_quantiles_are_close_and_merge(spark):
    values = [math.exp(i / 50) for i in range(500)] + [0.0] * 10
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v double")
    whole = quality_rules.quartiles(quality_rules.sketch(df, [], ["v"]), []).collect()[0]
    merged = quality_rules.quartiles(quality_rules.merge(quality_rules.sketch(df, ["g"], ["v"]), []), []).collect()[0]
    assert whole == merged
    assert whole.q1 == pytest.approx(np.quantile(values, 0.25, method="inverted_cdf"), rel=0.021)
    assert whole.q3 == pytest.approx(np.quantile(values, 0.75, method="inverted_cdf"), rel=0.021)


def test_limits_equal_brute_force(spark):
    """The verdict follows fences around the quartiles of each group's own sketch, merged upwards for small groups."""
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = quality_rules._metrics(quality_rules.measure(df)).collect()
    passed = [r for r in rows if not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)]
    got = {(r.group_lang, r.group_source): r for r in quality_rules.limits(spark.createDataFrame(passed), ["group_lang", "group_source"], 20).collect()}
    for (lang, source), r in got.items():
        own = [x for x in passed if (x.group_lang, x.group_source) == (lang, source)]
        own = own if len(own) >= 20 else [x for x in passed if x.group_lang == lang]
        for m, least in quality_rules.METRICS.items():
            q1, q3 = np.quantile([x[m] for x in own], [0.25, 0.75], method="inverted_cdf")
            assert r[f"{m}_high"] == pytest.approx(q3 + 3 * max(q3 - q1, least), rel=0.1)


def test_clean_documents_are_kept(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = quality_rules.apply_rules(spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and r.n_words >= 20]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_forward_sums_all_segmentations():
    path = language_id._path()
    pieces, _ = language_id.pieces_of(path)
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces) + 1, 2))
    prob /= prob.sum(axis=0)

    def total(s, k):
        if not s:
            return 1.0
        return sum((prob[pieces[s[:j]], k] if s[:j] in pieces else prob[0, k] if j == 1 else 0) * total(s[j:], k) for j in range(1, len(s) + 1))
    for word in ("the", "ñandú", "日本", "a", "running"):
        got = language_id.score_words(path, prob, [word])[0]
        assert got == pytest.approx([math.log(total("▁" + word, k)) for k in range(2)])


def test_languages_of_held_out_rows(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = language_id.identify(df).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) >= 0.97


def test_prediction_reads_neither_label_nor_id(spark):
    df = frame(spark, ["der die und das ist nicht gut", "the and of that with", None, "", "123 %%%", "the and of that with", "é" * 40000] * 3)
    langs, prob = language_id.train(df)
    a = language_id.predict(df, langs, prob).select("lang_pred", "score").collect()
    b = language_id.predict(df.selectExpr("doc_id + 5 doc_id", "text", "'zz' lang"), langs, prob).select("lang_pred", "score").collect()
    assert sorted(a) == sorted(b)
    assert [r.lang_pred for r in a].count("und") == 9  # null, empty and letterless texts


def test_empty_tables(spark):
    df = frame(spark, ["x"]).limit(0)
    assert quality_rules.apply_rules(df).count() == 0
    assert language_id.identify(df).count() == 0
    unlabelled = frame(spark, ["some text"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r.lang_pred for r in language_id.identify(unlabelled).collect()] == ["und"]


def test_long_words_are_summed_over_all_segmentations():
    path = language_id._path()
    pieces, _ = language_id.pieces_of(path)
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces) + 1, 2)) / 50
    for word in ("a", "internationalization" * 3, "the" * 15 + "日本語" * 8, "x" * 200):
        marked = language_id.WORD_START + word
        alpha = [np.ones(2)] + [np.zeros(2) for _ in marked]
        for j in range(1, len(marked) + 1):
            for i in range(j):
                p = pieces.get(marked[i:j])
                if p is not None or i == j - 1:
                    alpha[j] = alpha[j] + alpha[i] * prob[p or 0]
        want = np.log(alpha[-1])
        assert np.allclose(language_id.score_long_word(path, prob, word), want)
        assert np.allclose(language_id.score_words(path, prob, [word, "the"])[0], want)


def test_a_very_long_word_takes_linear_time():
    import time
    path = language_id._path()
    prob = np.full((len(language_id.pieces_of(path)[0]) + 1, 4), 1e-4)
    start = time.time()
    assert np.isfinite(language_id.score_words(path, prob, ["etaoinshrdlu" * 9000])).all() and time.time() - start < 10


def test_lattice_has_the_arcs_of_a_walk_through_the_vocabulary():
    path = language_id._path()
    pieces, prefixes = language_id.pieces_of(path)
    words = ["the", "tr\u00e9s", "\u4e2d\u6587\U0001f600x", "internationalization", "a" * 31, "\uffff", "Qzx"]
    chunks, _ = language_id.chunks_of(words)
    want = []
    for c, s in enumerate(chunks):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in pieces or j == i + 1:
                    want.append((j, c, i, pieces.get(s[i:j], 0)))
                if s[i:j] not in prefixes:
                    break
    lattice = language_id.Lattice(path, chunks)
    assert list(zip(*(x.tolist() for x in (lattice.stop, lattice.chunk, lattice.begin, lattice.piece)))) == sorted(want)
    assert len(language_id.Lattice(path, []).stop) == 0


def test_lattice_walks_all_positions_at_once(monkeypatch):
    path, asked = language_id._path(), []
    language_id.Lattice(path, ["\u2581warm"])

    class Watched(dict):
        def get(self, *key):
            asked.append(key)
            return super().get(*key)
    pieces, prefixes = language_id.pieces_of(path)
    monkeypatch.setattr(language_id, "pieces_of", lambda _: (Watched(pieces), prefixes))
    language_id.Lattice(path, ["\u2581" + "word" * 7] * 1000)
    assert not asked  # no look-up per substring
