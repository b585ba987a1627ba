import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tallyfold.llm import fingerprint as fp

from . import hard


def lines(t):
    return {x for x in t.split("\n") if x}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_match_brute_force(spark):
    got = fp.fingerprint_edits(hard.docs(spark)).collect()
    x = {r["k"]: (r["a"], r["b"]) for r in spark.createDataFrame([(t,) for t in {r[1] or "" for r in hard.rows()}], "k string").select("k", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b")).collect()}
    order = sorted(((i is not None, i or 0, x[t or ""], t or "") for i, t, *_ in hard.rows()))
    want = Counter()
    for k, (known, i, _, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[(i if known else None, len(t), sha, round(jaccard(lines(t), lines(edited)), 9), round(jaccard(lines(t), lines(nxt)), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_equal_texts_have_equal_fingerprints(spark):
    got = fp.fingerprint_edits(hard.docs(spark)).filter("doc_id >= 1000").select("fingerprint").distinct().count()
    assert got == 1


def test_empty_and_single(spark):
    assert fp.fingerprint_edits(hard.empty(spark)).count() == 0
    one = fp.fingerprint_edits(spark.createDataFrame([(7, "a\nb")], "doc_id bigint, text string")).first()
    assert (one.near_next, one.n_chars) == (1.0, 3)


def test_peeling_recovers_differences_of_all_sizes(spark):
    pairs = [(list(range(n)), list(range(n - d, 2 * n - d))) for n, d in ((0, 0), (5, 5), (9, 2), (60, 11), (900, 20), (4000, 3900))]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<bigint>, b array<bigint>")
    mixed = [F.transform(c, lambda x: F.xxhash64(x)) for c in ("a", "b")]
    df = df.select("k", mixed[0].alias("a"), mixed[1].alias("b"))
    found = fp.differing(F.col("a"), F.col("b"), fp.sketch(F.col("a")), fp.sketch(F.col("b")))
    for r in df.select("k", "a", "b", found.alias("f")).collect():
        a, b = set(r.a), set(r.b)
        assert {x["key"] for x in r.f if x["n"] == 1} == a - b
        assert {x["key"] for x in r.f if x["n"] == -1} == b - a


def test_successors_in_groups(spark, monkeypatch):
    monkeypatch.setattr(fp, "ORDERED", 40)
    keys = sorted({(k * 7919) % 1_000_003 - 400_000 for k in range(300)} | {5, 6, 7})
    got = {r["key"]: r["after"] for r in fp.successors(spark.createDataFrame([(k,) for k in keys], "key bigint")).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


def test_groups_stuck_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(fp, "WIDTHS", (0, 0))
    monkeypatch.setattr(fp, "GROUP", 1 << 20)
    a, b = list(range(0, 40)), list(range(10, 55))
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    got = df.select(fp._larger(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert sorted((x["key"], x["n"]) for x in got) == sorted([(k, 1) for k in range(10)] + [(k, -1) for k in range(40, 55)])
