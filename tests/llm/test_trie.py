"""Operator 13 against a trie built turn by turn."""

import hashlib
import random
import zlib

import pytest

from replaygate.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(t[1], t[3]) for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = sorted(c for c in cs if len(convs[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids),
                    sum(not any(q[:-1] == p for q in members if len(q) == len(p) + 1) for p in below),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def built(spark, rows, schema=SCHEMA):
    turns = T.ordered_turns(spark.createDataFrame(rows, schema))
    return rows_of(T.prefix_trie(turns, turns.select("conv_id").distinct())), turns


def test_random_conversations(spark):
    rng = random.Random(0)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice("ua"), rng.choice(["x", "yy", "é日"])) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "u", f"deep {t}") for c in (200, 201) for t in range(12)] + [(202, t, "u", f"deep {t}") for t in range(30)]
    got, turns = built(spark, rows)
    assert got == brute(ordered(rows))
    assert rows_of(T.prefix_trie(*T.share_openings(turns))) == brute(rebuilt(ordered(rows)))


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, None, None, "b"), (1, 0, "u", None), (1, None, "u", "a"), (2, None, None, "b"), (2, 5, "", "x"), (3, 1, "u", "z"), (3, 1, "u", "z"), (3, 1, "t", "z"),
            (None, 0, "u", "lost"), (4, 0, "u:", "q"), (5, 0, "u", ":q"), (6, 0, "", "")]
    got, _ = built(spark, [(*r, "k", 9) for r in rows], SCHEMA + ", key string, pos int")
    assert got == brute(ordered(rows))


def test_one_conversation_copied_many_times(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(400) for t in range(3)] + [(c, 0, "u", "same 0") for c in range(400, 600)] + [(c, 0, "u", f"own {c}") for c in range(600, 650)]
    got, _ = built(spark, rows)
    assert got == brute(ordered(rows))


def test_very_long_conversation_needs_no_round_of_its_own(spark):
    rows = [(1, t, "u", "word " * (t % 7)) for t in range(5000)] + [(2, 0, "u", "")]
    turns = T.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = T.prefix_trie(turns, turns.select("conv_id").distinct())
    assert got.count() == 5001 and got.filter("n_convs = 2").count() == 2
    assert got.filter("depth = 5000").first()["ends_sha256"] == hashlib.sha256(b"1").hexdigest()


def test_turnless_conversations_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(T.prefix_trie(*T.share_openings(T.ordered_turns(empty)))) == []
    # 7 takes h turns of an absent conversation and has no more of its own
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]
    turns = T.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(T.prefix_trie(*T.share_openings(turns))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("c", [0, 7, 100, 12345, -3])
def test_opening_lengths(spark, c):
    from pyspark.sql import functions as F
    got = spark.range(1).select(T.opening_turns(F.lit(c).cast("long")).alias("h")).first()["h"]
    assert got == zlib.crc32(str(c).encode()) % 6
