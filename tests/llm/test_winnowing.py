"""Operator 5 against a plain winnowing of the same hashes, and its guarantee."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from replaygate.llm import winnowing as N

ODD = [None, "", " \n", "one", "a b c d", "a b c d e", "a a a a a a a a a a a a a a a a a a", "w" * 1000, "é ü 日本 👍🏽 x y z", "same text of a few words here"] + ["same text of a few words here"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def fold(values):
    """Spark's xxhash64 of several longs: each hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=seed)
    return signed(seed)


def turned(x, bits):
    x &= (1 << 64) - 1
    return (x << bits | x >> 64 - bits) & ((1 << 64) - 1)


def afresh(values):
    """Cyclic polynomial of a whole gram, without rolling."""
    out = 0
    for j, v in enumerate(reversed(values)):
        out ^= turned(v, j)
    return signed(out)


def brute(text):
    """[(position, hash)] by a plain scan of every window."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    h = [xx(t) for t in tokens]
    grams = [afresh(h[i:i + 5]) >> 24 for i in range(len(h) - 4)] if len(h) >= 5 else [fold(h) >> 24] if h else []
    out = []
    for i in range(max(1, len(grams) - 7) if grams else 0):
        window = range(i, min(i + 8, len(grams)))
        at = min(window, key=lambda p: (grams[p], -p))
        if (at, grams[at]) not in out:
            out.append((at, grams[at]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, fingerprint string, n_chars double")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ODD + [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(0, 90))) + rng.choice(["", "\n", " \t"]) for _ in range(60)]


@pytest.mark.parametrize("gram", [1, 2, 5, 8])
def test_rolled_hashes_equal_those_computed_afresh(spark, gram):
    rng = random.Random(gram)
    rows = [(i, [rng.choice([0, -1, 7, signed(rng.getrandbits(64))]) for _ in range(n)]) for i, n in enumerate([gram, gram + 1, gram + 14, gram + 15, gram + 16, gram + 17, 200])]
    got = spark.createDataFrame(rows, "i int, h array<long>").select("h", N.rolled(F.col("h"), gram).alias("r")).collect()
    for r in got:
        assert r.r == [afresh(r.h[i:i + gram]) for i in range(len(r.h) - gram + 1)]


def test_choices_equal_brute_force(spark, texts):
    for r, t in zip(N.fingerprint_documents(frame(spark, enumerate(texts))).collect(), texts):
        assert [(f.position, f.hash) for f in r.fingerprint] == brute(t)


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_documents_equal_brute_force(spark, texts, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i * i - 50 if i else None, t) for i, t in enumerate(texts)]
        got = {r.doc_id: r for r in N.compare_documents(frame(spark, random.Random(1).sample(rows, len(rows)))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited, r = t[:len(t) - q] + following[:q], got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == ",".join(f"{p}:{h & ((1 << 40) - 1):x}" for p, h in brute(t))
        assert r.edited_fingerprint == ",".join(f"{p}:{h & ((1 << 40) - 1):x}" for p, h in brute(edited))
        assert r.near_edited == pytest.approx(jaccard(brute(t), brute(edited))) and r.near_next == pytest.approx(jaccard(brute(t), brute(following)))


def test_shared_run_shares_a_choice(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(12))  # GRAM + WINDOW - 1 tokens
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(rng.randint(0, 40))) + " " + shared + " " + " ".join(f"v{i}x{k}" for k in range(rng.randint(0, 40)))) for i in range(30)]
    found = [{f.hash for f in r.fingerprint} for r in N.fingerprint_documents(frame(spark, rows)).collect()]
    assert all(a & b for a in found for b in found)


def test_small_and_repeated_tables(spark):
    assert N.compare_documents(frame(spark, [(1, "x")]).limit(0)).count() == 0
    one = N.compare_documents(frame(spark, [(1, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(N.compare_documents(frame(spark, [(1, "x y"), (1, "x y"), (2, None), (None, "z")])).collect()) == 4
    plan = N.compare_documents(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan.replace("Scan ExistingRDD", "").replace("LogicalRDD", ""))


def fine_tokens(text):
    return [t for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for t in ([w] if len(w) <= 16 else w)]


def test_passages_inside_long_runs_share_a_choice(spark, tmp_path, texts):
    rng = random.Random(6)
    run, one = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2000)), "function(a,b){return a+b}👍🏽"
    rows = list(enumerate([run, "x" + run, rng.choice(texts) + " abc" + run[700:712] + one, "q" * 17 + run[690:720], "w" * 16 + " " + "w" * 17 + "\n" + one, *texts]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in N.query(spark, str(tmp_path)).collect()}
    assert got[0].near_next > 0.99
    found = {d: {x.split(":")[1] for x in r.fingerprint.split(",") if x} for d, r in got.items()}
    assert found[0] & found[1] and found[0] & found[2] and found[1] & found[3]
    for d, t in rows:  # fine tokens, put apart, are the tokens of a plain scan
        want = ",".join(f"{p}:{h & ((1 << 40) - 1):x}" for p, h in brute(" ".join(fine_tokens(t))))
        assert got[d].fingerprint == want
