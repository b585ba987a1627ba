import random

import numpy as np

import corpus_pipeline
from tallyfold.llm import simhash, similar

from . import hard


def shingles(t):
    words = hard.SPACED.findall((t or "").translate(hard.LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """Least id of each component of rows (id, text) linked at similarity 0.8, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(i, low.get(root(k), i))
    return sorted(low.values())


def changed(rng, text, n):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = "changed" + str(rng.random())
    return " ".join(words)


def test_near_copies_go(spark):
    rng = random.Random(4)
    texts = [hard.sentence(rng, rng.randint(100, 250)) for _ in range(60)]
    texts += [changed(rng, t, rng.randint(1, 6)) for t in texts[:40] for _ in range(3)]
    # Chains, whose ends are less alike than 0.8, and one large group.
    for _ in range(5):
        chain = [hard.sentence(rng, 150)]
        for _ in range(6):
            chain.append(changed(rng, chain[-1], 3))
        texts += chain
    texts += [changed(rng, texts[0], 2) for _ in range(150)] + ["", None, " ", "a b", "A  b", "a b c", "b a"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept(rows)


def test_blocks_dealt_to_several_tasks(spark):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, 60)) for _ in range(40)]
    sets += [np.unique(np.concatenate([x[int(rng.integers(0, 9)) :], rng.integers(0, 1 << 62, int(rng.integers(0, 9)))])) for x in sets for _ in range(2)]
    rows = []
    for band in (1, 2):
        for p, x in enumerate(sets):
            rows.append((band, band - 1, len(sets), p, similar.simhash(x.view(np.uint64)), p % 40 if p < 60 else p, [7, 8 + p % 2], x.tolist()))
    df = spark.createDataFrame(rows, "band bigint, k int, n bigint, p bigint, print bigint, c bigint, bands array<bigint>, own array<bigint>").repartition(3)
    want = linked_pairs(sets)
    assert want
    for block_rows in (11, 50, 1000):
        got = {tuple(r) for r in similar.open_links(df, block_rows=block_rows).collect()}
        assert got <= want
        start = [(p, p % 40) for p in range(60)]
        assert groups(len(sets), [*start, *got]) == groups(len(sets), [*start, *want])


def linked_pairs(sets):
    return {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 5 * (both := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - both)}


def groups(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        up[root(i)] = root(j)
    return {frozenset(k for k in range(n) if root(k) == r) for r in {root(k) for k in range(n)}}


def test_alike_but_not_enough(spark):
    rng = random.Random(8)
    base = hard.sentence(rng, 60)
    texts = [changed(rng, base, 4) for _ in range(120)] + [base]
    rows = list(enumerate(texts + [changed(rng, t, 1) for t in texts[:20]]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept(rows)


def test_hard_documents(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(hard.rows())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept(rows)
    assert corpus_pipeline.near_duplicates(spark, hard.empty(spark), "").count() == 0
    clash = corpus_pipeline.near_duplicates(spark, hard.docs(spark), "")
    assert clash.columns == hard.docs(spark).columns and clash.count() == len(kept(rows))


def test_stage_on_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == kept(rows)


def test_walk_of_a_trie_prunes(monkeypatch):
    rng = np.random.default_rng(2)
    hi, lo = (np.sort(rng.integers(0, 1 << 64, 3000, np.uint64)) for _ in range(2))
    seen = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x):
            seen.append(np.size(x))
            return np.bitwise_count(x)

    monkeypatch.setattr(simhash, "np", Counting())
    list(similar.trie_pairs(hi, lo, None, 0, np.arange(len(hi))))
    assert 0 < sum(seen) < 3000 * 2999 // 2 // 10


def test_tries_join_what_is_similar(spark):
    rng = np.random.default_rng(3)

    def some(n):
        return rng.integers(0, 1 << 64, n, np.uint64)

    def grown(x, less, more):
        return np.unique(np.concatenate([x[less:], some(more)]))

    sets = []
    # Pairs of similarity 0.8, or just above in small sets, and one large group.
    for n, less, more in ((4, 0, 1), (5, 0, 1), (9, 1, 1), (8, 0, 2), (90, 10, 10), (270, 30, 30)):
        for _ in range(8):
            sets.append(np.unique(some(n)))
            sets.append(grown(sets[-1], less, more))
    base = np.unique(some(200))
    sets += [grown(base, 6, 6) for _ in range(150)] + [np.unique(some(int(n))) for n in rng.integers(1, 60, 300)]
    rows = []
    for p, x in enumerate(sets):
        words = similar.fingerprint(x, (2 if len(x) <= similar.SHORT else 1) * similar.WORDS)
        rows.append((p, words.view(np.int64).tolist()))
    classes = spark.createDataFrame(rows, "p bigint, print array<bigint>").repartition(3)
    want = groups(len(sets), linked_pairs(sets))
    for tops in (0, 3):
        got = groups(len(sets), [tuple(r) for r in similar.trie_stars(similar.trie_rows(classes), tops=tops).collect()])
        # Clusters may be larger than components, but tell different texts apart.
        assert all(any(c <= g for g in got) for c in want)
        assert len(got) >= len(want) - 5
