import random

from tallyfold.llm import pii

COMMON = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "of", "to", "7"]


def flagged(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {}
    for r in pii.find_personal_data(docs).collect():
        out[r["doc_id"]] = {texts[r["doc_id"]][s["start"] : s["stop"]]: s["kind"] for s in r["spans"] if s["rank"] >= 4}
    return out


def test_short_terms_and_numbers_disclose(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(COMMON, k=12)) for _ in range(200)]
    for k in range(0, 40, 10):
        texts[k] += " Ann 李四 b4711 of u@mail.example.com"
    got = flagged(spark, texts)
    assert all(got[k] == ({"Ann": "term_remove", "李四": "term_remove", "b4711": "term_remove"} if k in (0, 10, 20, 30) else {}) for k in got)


def test_terms_of_frequent_entities_disclose(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(COMMON, k=12)) for _ in range(300)]
    for k in range(0, 300, 3):
        texts[k] += " hot@mail.example.com" + (" gardener" if k % 30 == 0 else "")
    got = flagged(spark, texts)
    assert all(got[k] == ({"gardener": "term_remove"} if k % 30 == 0 else {}) for k in got)
    small = [" ".join(rng.choices(COMMON, k=12)) for _ in range(30)]
    small[3] += " gardener u@mail.example.com"
    small[9] += " gardener u@mail.example.com"
    assert flagged(spark, small)[3] == {"gardener": "term_remove"}
