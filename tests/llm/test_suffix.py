"""Operator 8 against brute force over every 200-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from replaygate.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, size string, t int")
    got = [(r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), r.kept_sha256, hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256) for r in S.remove_repeats(df).collect()]
    assert sorted(got) == sorted((*x, True) for x in brute([t for _, t in rows]))


def planted():
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choices("abcdefghijklmnop éß", k=n))
    shared = [text(n) for n in (199, 200, 201, 260, 700)]
    out = [None, "", "x", "a" * 199, "a" * 200, "b" * 201, "c" * 900, ("period " * 60), "日本" * 150, shared[3], shared[3], text(3000)]
    for _ in range(40):
        s = rng.choice(shared)
        out.append(text(rng.randint(0, 300)) + s[rng.randint(0, 3):] + text(rng.randint(0, 300)) + rng.choice(["", s, "a" * 250]))
    base = text(1500)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice("XYZ")
        out.append("".join(copy))
    return out


@pytest.mark.parametrize("sizes", [(4000, 2000), (50, 4)])
def test_planted_repeats_equal_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(S, "GROUP_CONTEXTS", sizes[0])
    monkeypatch.setattr(S, "CHUNK_CONTEXTS", sizes[1])
    check(spark, [(i if i % 9 else None, t) for i, t in enumerate(planted())])


def test_strings_of_a_block_hold_its_core():
    rng = random.Random(12)
    data = bytes(rng.choices(range(256), k=4000))
    hashes, first, count = S.anchors(np.frombuffer(data, np.uint8))
    for f, n in zip(first.tolist(), count.tolist()):
        content, seen = data[f:f + n - 1 + 200], []
        for block, low, high, core in S.cores(content, n):
            assert len(core) == 201 - S.CORE_STARTS and all(content[s:s + 200].count(core) == 1 for s in range(low, high + 1))
            seen += range(low, high + 1)
        assert sorted(seen) == list(range(n))


def test_common_passage_in_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_CONTEXTS", 40)
    monkeypatch.setattr(S, "CHUNK_CONTEXTS", 4)
    rng = random.Random(13)

    def text(n):
        return "".join(rng.choices("abcdefgh", k=n))
    passage, edges = text(330), [text(n) for n in (1, 7, 16, 40)]
    rows = [(i, text(250) + rng.choice(["", *edges]) + passage + rng.choice(["", *edges]) + text(250)) for i in range(60)]
    check(spark, rows)


def test_table_equals_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blind_trie_and_quicksort_find_equal_strings():
    rng = random.Random(8)
    strings = [bytes(rng.choices(b"ab", k=12)) for _ in range(400)]
    classes = S.blind_trie(strings)
    assert all((classes[i] == classes[j]) == (strings[i] == strings[j]) for i in range(400) for j in range(i))
    data = bytes(rng.choices(b"ab", k=300)) * 3 + bytes(rng.choices(b"ab", k=900))
    starts = np.arange(len(data) - 200)
    repeated, head = S.repeated_suffixes(data, starts)
    seen = Counter(data[i:i + 200] for i in starts.tolist())
    assert repeated.tolist() == [seen[data[i:i + 200]] > 1 for i in starts.tolist()]
    assert len(set(head[repeated].tolist())) == sum(n > 1 for n in seen.values())
