import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import simhash

from . import hard


def fingerprint(t):
    words = hard.SPACED.findall((t or "").translate(hard.LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))


def linked(prints, budget=2):
    """Component of each distinct fingerprint, by comparing all pairs."""
    p = sorted(set(prints))
    up = {x: x for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(p, np.uint64)
    for k in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= budget):
            x, y = root(p[k]), root(p[k + 1 + int(j)])
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in p}


def test_hard_documents_match_brute_force(spark):
    rows = hard.rows()
    got = simhash.near_duplicates(hard.docs(spark)).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    comp = linked(prints)
    low = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            low[comp[p]] = min(i, low.get(comp[p], i))
    want = Counter((i, p, low.get(comp[p])) for (i, *_), p in zip(rows, prints, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(hard.empty(spark)).count() == 0


def clustered(rng, centres=40, each=40):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_trie_finds_exactly_the_near_pairs():
    rng = random.Random(7)
    for seed in range(3):
        p = np.array(clustered(rng, 20, 30 + seed), np.uint64)
        got = {(int(a), int(b)) for i, j in simhash.trie_links(p, None, 2, 0) for a, b in zip(i, j, strict=True)}
        i, j = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None]) <= 2, 1))
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))
        a, b = p[: len(p) // 2] >> np.uint64(4), p[len(p) // 2 :] >> np.uint64(4) | np.uint64(3 << 60)
        a, b = np.unique(a), np.unique(b)
        got = {(int(x), int(y)) for i, j in simhash.trie_links(a, b, 5, 4) for x, y in zip(i, j, strict=True)}
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= 5)
        assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_components_across_top_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 30)
    monkeypatch.setattr(simhash, "MAX_TOP", 8)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    p = clustered(random.Random(9))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in p], "p bigint").repartition(5)
    found = simhash.components(simhash.fingerprint_links(df)).collect()
    got = {r["node"] % (1 << 64): r["least"] % (1 << 64) for r in found}
    want = linked(p)
    groups = {}
    for x in p:
        groups.setdefault(want[x], set()).add(x)
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len({got.get(x, x) for x in p}) == len(groups)


def test_long_chain_settles(spark):
    links = spark.range(300).select((F.col("id") * 7 % 301).alias("u"), ((F.col("id") * 7 + 7) % 301).alias("v"))
    assert {r["least"] for r in simhash.components(links).collect()} == {0}


def test_one_of_each_group_stays(spark):
    docs = hard.docs(spark)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    comp = linked([fingerprint(t) for _, t, *_ in hard.rows()])
    assert Counter(comp[fingerprint(r["text"])] for r in kept.collect()) == Counter(set(comp.values()))
