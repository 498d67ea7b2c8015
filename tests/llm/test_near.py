"""Operator 6 against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from replaygate.llm import hyperminhash as H
from replaygate.llm import words
from replaygate.llm.components import components

SF01 = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """component id per row; rows are (id, text) with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, digest string, node int")


def planted():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "One", "one", "ONE two", "É a", "é a", "a b c d", "a b c d e", "a b c d e f", "x " * 3000]
    for size in (8, 30, 120, 600):
        for _ in range(4):
            base = rng.choices(vocab, k=size)
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 14))):
                    copy[rng.randrange(size)] = rng.choice(vocab)
                texts.append(" ".join(copy[rng.randint(0, 2):]))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [512, 3])
def test_groups_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", block)
    rows = planted()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_parts_of_a_batch_give_the_same_sets(monkeypatch):
    texts = [f"Été ÀB {i} word " * (i % 9) + "É" * (i % 5) + f" end {i}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    monkeypatch.setattr(words, "SLICE_BYTES", 500)
    got = [s for part in words.slices(batch, "text") for s in H.shingle_sets(part.column("text"))]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert all((x == y).all() for x, y in zip(got, H.shingle_sets(batch.column("text"))))


def test_repeated_rows_and_null_ids(spark):
    got = H.near_duplicates(frame(spark, [(4, "a b c"), (4, "a b c"), (None, "a b c"), (None, "zz"), (7, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(4, 4, True), (4, 4, True), (None, 4, False), (None, None, False), (7, 7, True)], key=str)
    assert H.near_duplicates(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for jaccard in (0.3, 0.75, 0.9):
        for size in (4000, 40):
            found = []
            for _ in range(60):
                both, rest = int(size * jaccard), size - int(size * jaccard)
                pool = rng.integers(0, 1 << 63, both + rest, dtype=np.uint64) * np.uint64(2)
                a, b = (np.unique(np.concatenate([pool[:both], x])) for x in (pool[both:both + rest // 2], pool[both + rest // 2:]))
                equal = (H.registers(a) == H.registers(b)).sum()
                found.append(H.estimate(np.array([equal]), np.array([len(a)]), np.array([len(b)]))[0])
            assert np.mean(found) == pytest.approx(jaccard, abs=0.05)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    path = list(range(200))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[i] == 1000 for i in range(1000, 1200)) and 5000 not in got


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    from replaygate.llm import components as C
    sizes, write = {}, words.stored

    def noted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(C, "stored", noted)
    rng = random.Random(4)
    links = [(rng.randrange(100), rng.randrange(100)) for _ in range(2000)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), "x").collect()}
    assert {got[i] for i in range(100)} == {0} and {got[i] for i in range(200, 231)} == {200}
    later = [n for k, n in sizes.items() if re.fullmatch(r"x-l\d+", k)]
    assert later[-1] == 0 and sum(later) < sizes["x-links"] / 10
