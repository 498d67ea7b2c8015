"""Operator 10 against brute force over all pairs of lines."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from replaygate.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, times):
    for _ in range(times):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        s = s[:i] + (rng.choice("abé日") if kind else "") + s[i + (kind != 2):]
    return s


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_equals_the_plain_one(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4)) if rng.random() < 0.8 else "".join(rng.choices("abé", k=rng.randint(0, 14)))
        if abs(len(a) - len(b)) <= edits:
            pairs.append((a, b))
    got = L.edit_distances([a for a, _ in pairs], [b for _, b in pairs], edits)
    for (a, b), d in zip(pairs, got.tolist()):
        want = distance(a, b)
        assert d == want if want <= edits else d > edits, (a, b, d, want)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_within_the_edits_share_a_key(edits):
    rng = random.Random(9)
    for _ in range(1500):
        a = "".join(rng.choices("ab", k=rng.randint(4, 16)))
        b = edited(rng, a, rng.randint(1, edits))
        if b and distance(a, b) <= edits:
            short, long = sorted((a, b), key=len)
            assert set(L.line_keys(short, edits)[0]) & set(sum(L.line_keys(long, edits), []))


def brute(rows, short=False):
    """{(id, text): (n_lines, n_removed, n_near, sha256)}; rows have distinct (id, text).
    `short` takes exact repeats of shorter non-blank lines too."""
    at = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if t is not None and (len(line) >= L.MIN_CHARS or (short and line.strip(" \t\v\f\r"))):
                spot = (d is None, d or 0, xxhash.xxh64_intdigest(t.encode(), seed=42), k)
                at.setdefault(line, []).append(spot)
    first = {line: min(spots) for line, spots in at.items()}
    long = [line for line in first if len(line) >= L.MIN_CHARS]
    near = {a for a in long for b in long if first[b] < first[a] and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1}
    out = {}
    for d, t in rows:
        lines, left, removed, only = [] if t is None else t.split("\n"), [], 0, 0
        for k, line in enumerate(lines):
            own = (d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), seed=42), k) == first.get(line)
            if line in first and (line in near or not own):
                removed, only = removed + 1, only + (own and line in near)
            else:
                left.append(line)
        out[d, t] = (len(lines), removed, only, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def rows_of(rng):
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(20, 40))) for _ in range(25)]
    stem = "the same beginning of a line with number "
    lines = base + [edited(rng, b, 1) for b in base for _ in range(3)] + [edited(rng, b, 2) for b in base] + [f"{stem}{i}" for i in range(80)] + [f"{i:03d} then the same end of a line" for i in range(60)]
    rows = [(None, "short\nno id but this line is long enough to count"), (1, None), (2, ""), (3, "\n\n"), (4, "é" * 300 + "\n" + "é" * 299)]
    return rows + [(i + 10, "\n".join(rng.choices(lines, k=rng.randint(1, 9)) + ["tiny"] * rng.randint(0, 2))) for i in range(70)]


@pytest.mark.parametrize("hot, short", [(32, False), (2, False), (32, True), (2, True)])
def test_documents_equal_brute_force(spark, hot, short, monkeypatch):
    monkeypatch.setattr(L, "HOT", hot)
    rows = rows_of(random.Random(21))
    df = spark.createDataFrame([(d, t, "clash", 2) for d, t in rows], "doc_id long, text string, digest string, line int")
    got = L.drop_lines(df, short_repeats=short).collect()
    want = brute(rows, short)
    assert len(got) == len(rows)
    by_id = {d: v for (d, _), v in want.items()}
    for r in got:
        sha = hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (r["__lines"], r["__removed"], r["__near"], sha) == by_id[r.doc_id]
        assert r.digest == "clash" and r.line == 2 and ((r.text is None) == (r.doc_id == 1))


def test_variant_hashes_are_those_of_the_strings():
    line = "abcé日 fgh" * 3
    part, _ = L.variant_hashes(line)
    for i in range(len(line)):
        _, whole = L.variant_hashes(line[:i] + line[i + 1:])
        assert (part[:, i] == whole[:, 0]).all()
    assert len(np.unique(part[0])) <= len(line)


def test_small_and_repeated_tables(spark):
    schema = "doc_id long, text string"
    assert L.drop_lines(spark.createDataFrame([], schema)).count() == 0
    line = "a line of more than enough characters"
    got = L.drop_lines(spark.createDataFrame([(5, line), (5, line), (6, line), (None, line)], schema)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", line), ("5", line), ("6", ""), ("None", "")])


def test_short_lines_that_repeat_go(spark):
    long = "a line of more than enough characters"
    rows = [(1, f"one\n\n{long}\n  "), (2, "two\none\n\n  \none"), (3, f"tw0\nTwo\n{long}\ntwo"), (None, "one\ntwo\nthree"), (4, None)]
    got = {r.doc_id: r for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_repeats=True).collect()}
    assert {d: r.text for d, r in got.items()} == {1: rows[0][1], 2: "two\n\n  ", 3: "tw0\nTwo", None: "three", 4: None}
    assert [got[d]["__removed"] for d in (1, 2, 3, None)] == [0, 2, 2, 2] and all(r["__near"] == 0 for r in got.values())


def test_short_repeats_change_nothing_else(spark):
    rows = [(d, t and t.replace("tiny", f"t{i}")) for i, (d, t) in enumerate(rows_of(random.Random(22))) if t is None or t.count("tiny") < 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = {r.doc_id: (r.text, r["__near"]) for r in L.drop_lines(df).collect()}
    short = {r.doc_id: (r.text, r["__near"]) for r in L.drop_lines(df, short_repeats=True).collect()}

    def long(found):
        return {d: ([x for x in (t or "").split("\n") if len(x) >= L.MIN_CHARS], near) for d, (t, near) in found.items()}
    assert long(alone) == long(short)
