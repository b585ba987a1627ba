import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyfold.llm import language

from . import hard

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "en", "ung"], "cc": ["eau", "tion", "qu"], "dd": ["rr", "os", "ción"]}


def corpus(n=600):
    rng = random.Random(1)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[g], k=rng.randint(2, 4))) for _ in range(rng.randint(1, 40))), g) for i in range(n) for g in [rng.choice(sorted(SYLLABLES))]]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string")
    out, m = language.identify(docs, language.fit(docs))
    rows = out.select("doc_id", "lang", language.held_out(F.col("doc_id")).alias("held"), f"{m}.*").collect()
    for r in rows:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held"]]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id bigint, text string, lang string")
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(spoiled)
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def test_undetermined_and_edges(spark):
    docs = hard.docs(spark)
    out, m = language.identify(docs, language.fit(docs))
    for r in out.select("text", f"{m}.*").collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert out.select(*docs.columns).columns == docs.columns
    nothing, m = language.identify(docs, language.fit(hard.empty(spark)))
    assert {r[0] for r in nothing.select(f"{m}.lang_pred").collect()} == {"und"}
    out, m = language.identify(hard.empty(spark), language.fit(docs))
    assert out.count() == 0


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(3, language.FEATURES, 2)).astype(np.float32)
    long = "".join(rng.choice(list("abc de"), language.CHUNK_BYTES * 2 + 77))
    texts = ["short one", long, None, "x", "abc de"]
    got = language.mean_answers(pa.array(texts), weights)
    for row, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        parts = [language._features(data, n) for n in language.ORDERS]
        n = sum(map(len, parts))
        want = sum(weights[k][h].sum(0, dtype=float) for k, h in enumerate(parts)) / max(n, 1)
        assert np.allclose(got[row], want, atol=1e-6)


def test_codes_correct_errors():
    for n in (2, 3, 4, 6, 40):
        code = language.codewords(n)
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= {2: 1, 3: 2, 4: 4, 6: 16, 40: 12}[n]
