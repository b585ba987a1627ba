import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import decontam

from . import hard

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(hard.LOWER))


def brute(items, t, window=10):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    w = words(t)
    hit, found, longest = set(), set(), 0
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            own = windows.get(tuple(w[k : k + n]))
            if own:
                hit.update(range(k, k + n))
                found |= own
    for _, text in items:
        own = words(text)
        for n in range(1, len(own) + 1):
            grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                longest = max(longest, n)
    return len(w), len(hit), sorted(found), longest


def cases():
    rng = random.Random(11)
    items = [(k, hard.sentence(rng, n).replace(" ", rng.choice([" ", ", ", "-"]))) for k, n in enumerate([25, 12, 10, 9, 3, 1, 40, 11])]
    items += [(2, items[0][1]), (8, None), (9, ""), (10, "?!"), (None, hard.sentence(rng, 14)), (11, items[6][1])]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = words(rng.choice(items)[1]) or ["x"]
            a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
            parts.append(rng.choice([" ", "\n", "; "]).join(w[a:b]) if rng.random() < 0.7 else hard.sentence(rng, rng.randint(1, 20)).upper())
        texts.append(" ".join(parts))
    return items, texts + hard.texts()


@pytest.mark.parametrize("options", [{}, {"block_bytes": 150}, {"shard_words": 16}])
def test_matches_brute_force(spark, options):
    items, texts = cases()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, leak string").repartition(3)
    out, m = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), **options)
    rows = out.select("doc_id", f"{m}.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(items, texts[r["doc_id"]])
        got = (r["n_words"], r["n_hit"], r["items"], r["longest"])
        assert got[:3] == want[:3], (r["doc_id"], got, want)
        assert got[3] == want[3]


def test_where_the_longest_match_is(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"a b c {item[:40]} d {item}")], "doc_id bigint, text string")
    out, m = decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    r = out.select(f"{m}.*").first()
    assert (r["longest"], words(docs.first()["text"])[r["longest_at"] : r["longest_at"] + 30]) == (30, item.split())


def test_texts_that_repeat_themselves(spark):
    docs = spark.createDataFrame([(1, "ha " * 60_000), (2, "ho ha"), (3, "ab " * 9)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "ha " * 5_000), (2, "ab " * 200)], "item_id bigint, text string")
    out, m = decontam.decontaminate(docs, items)
    rows = {r["doc_id"]: r for r in out.select("doc_id", f"{m}.*").collect()}
    assert [(rows[k]["n_words"], rows[k]["n_hit"], rows[k]["items"], rows[k]["longest"], rows[k]["longest_at"]) for k in (1, 2, 3)] == [
        (60_000, 60_000, ["1"], 5_000, 0), (2, 0, [], 1, 1), (9, 0, [], 9, 0),
    ]


def test_long_texts_are_cut_into_overlapping_shards(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 40)
    items, texts = cases()
    whole = " ".join(t or "" for t in texts[:120])
    index = decontam.BenchmarkIndex.of([(str(i), t or "") for i, t in items])
    for shard_words in (1, 90, 1 << 20):
        r = decontam._search(lambda: iter([index]), index.longest, decontam.pa.array([whole, "x", whole + "y"]), shard_words).to_pylist()
        for got, text in zip(r, (whole, "x", whole + "y"), strict=True):
            want = brute([(str(i), t) for i, t in items], text)
            assert (got["n_words"], got["n_hit"], got["items"], got["longest"]) == want


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(3)
    for n, v in ((0, 2), (1, 2), (300, 2), (500, 3), (400, 70_000)):
        words = rng.integers(0, v, n).astype(np.uint32)
        words[rng.random(n) < 0.02] = 0
        array, size, _ = decontam.suffix_array(words, n, v)
        own = [tuple(words[k : k + size[k]].tolist()) for k in range(n)]
        assert [own[k] for k in array] == sorted(x for x in own if x)


def test_edges(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out, m = decontam.decontaminate(hard.docs(spark), none)
    assert Counter(r[0] for r in out.select(f"{m}.n_words").collect()) == Counter(len(words(t)) for _, t, *_ in hard.rows())
    assert out.columns[:-1] == hard.docs(spark).columns and m not in hard.docs(spark).columns
    out, m = decontam.decontaminate(hard.empty(spark), none)
    assert out.count() == 0


def test_words_of_neighbouring_texts_are_kept_apart():
    data = b"abc" + b"def ghi" + b"" + b"jkl"
    hashes, at = decontam.word_hashes(np.frombuffer(data, np.uint8), np.array([0, 3, 10, 10, 13]))
    assert list(np.diff(at)) == [1, 2, 0, 1] and len(set(hashes.tolist())) == 4
    again, _ = decontam.word_hashes(np.frombuffer(b"  JKL abc", np.uint8), np.array([0, 9]))
    assert set(again.tolist()) == {int(hashes[3]), int(hashes[0])}
