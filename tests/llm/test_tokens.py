"""Operators 3, 4 and 7 against the tokenizers library and a round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from replaygate.llm import bpe_codec, packing, token_count, wordbpe

SF001 = "/root/testdata/sf0.001"

ODD = [None, "", " \n ", "it's I'LL don'T 's", "x<|endoftext|>y <|startoftext|><|end", "é é é ́x ﬁ İΣ", "y\x1cz \x85q\x0b\xa0r",
       "日本語 👍🏽", "aaaaaaaaaaaaa hahahahaha", "w" * 3000, "½² 12a3 __init__ ---"]


@pytest.fixture(scope="module")
def lib():
    return wordbpe.load(wordbpe.vocabulary_path()).library


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    letters = "aAbcdeioznst'’é́ßΣİfi<|>endoftext0123½²日\x1c\x85 \n\t -!?.#"
    noise = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)]
    real = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()]
    return ODD + noise + real + ["same words here"] * 3


def frame(spark, texts):
    rows = [(i if i % 50 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, row int")


def test_counts_equal_the_library(spark, lib, texts):
    got = sorted((r.n_bytes, r.n_tokens) for r in token_count.count_tokens(frame(spark, texts)).collect())
    want = sorted((len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert got == want


def test_codec_equals_the_library(spark, lib, texts):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = []
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digests(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(want)
    ids = [list(r.ids) for r in bpe_codec.encode_documents(frame(spark, texts)).collect()]
    assert sorted(ids) == sorted(lib.encode(t or "", add_special_tokens=False).ids for t in texts)


def test_check_sends_only_failing_words_to_merging(texts):
    codec = bpe_codec.Codec(wordbpe.vocabulary_path())
    for t in texts:
        codec.encode(t)
    assert 0 < codec.merged_exactly < len(codec.pretokens)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_keeps_every_id_once(spark, lib, texts, capacity):
    df = frame(spark, texts)
    rows = packing.pack_documents(df, capacity=capacity, group_pieces=64).collect()
    by_crc, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_crc.setdefault((r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(r)
    for at in sequences.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    want = {}
    for t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), capacity):
            k = (s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()), len(ids))
            want[k] = want.get(k, 0) + 1
    assert {k: len(v) for k, v in by_crc.items()} == want


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 80))), reverse=True)
        free, bins, offsets = [], [], []
        for s in sizes:
            b = next((i for i, f in enumerate(free) if f >= s), len(free))
            if b == len(free):
                free.append(100)
            bins.append(b), offsets.append(100 - free[b])
            free[b] -= s
        assert packing.first_fit_decreasing(sizes, 100) == (bins, offsets)


def test_empty_table(spark):
    df = frame(spark, ["x"]).limit(0)
    assert token_count.count_tokens(df).count() == 0
    assert bpe_codec.codec_digests(df).count() == 0
    assert packing.pack_documents(df).count() == 0


def test_very_long_words_and_special_strings(spark):
    import time
    rng = random.Random(5)
    vocab = wordbpe.load(wordbpe.vocabulary_path())
    counter, codec = token_count.TokenCounter(wordbpe.vocabulary_path()), bpe_codec.Codec(wordbpe.vocabulary_path())
    words = ["a" * 5000, "".join(rng.choices("etaoinshrdluá", k=100_000)), "ab<|endoftext|>İSTANBUL\u00a0x", "日本" * 900, "x"]
    want = [vocab.library.encode(w, add_special_tokens=False).ids for w in words]
    for w, ids in zip(words, want):
        start = time.time()
        assert counter.count_words([w]).tolist() == [len(ids)] and codec.encode(w) == ids
        assert time.time() - start < 3
    assert counter.count_words(words).tolist() == [len(ids) for ids in want]
