import random

from tallyfold.llm import license as lic

from . import hard


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["matches"] for r in lic.scan_licenses(docs, **options).collect()}


def brute(text, own, spare=0):
    """The best containment of a template's shingles in any stretch of the text as long as it, stretched."""
    every, n = lic.template_shingles(text), len(own)
    slack = lic._slack(n) + spare
    return max((len(set(own) & set(every[max(0, k - slack) : k + n + slack])) / len(set(own)) for k in range(-n, len(every))), default=0.0)


def corpus():
    rng = random.Random(4)
    texts = []
    for t in lic.TEMPLATES:
        words = t.text.split()
        for shift in range(6):
            texts.append(f"{hard.sentence(rng, shift)} {t.text.upper() if shift % 2 else t.text}\n{hard.sentence(rng, rng.randint(0, 40))}")
        for _ in range(6):  # words changed, dropped, added
            edited = list(words)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(edited))
                edited[k : k + rng.randint(0, 1)] = [hard.sentence(rng, 1)] * rng.randint(0, 2)
            texts.append(f"{hard.sentence(rng, rng.randint(0, 9))} {' '.join(edited)} {hard.sentence(rng, 9)}")
        texts.append(" ".join(words[: len(words) // 2]))
        texts.append("text " * 300 + t.text + " text" * 300 + " " + rng.choice(lic.TEMPLATES).text)
    return texts


def test_against_brute_force_over_all_places(spark):
    texts = corpus()
    got = found(spark, texts)
    shingles = [lic.template_shingles(t.text) for t in lic.TEMPLATES]
    want = {(k, n): c for k, text in enumerate(texts) for n, own in enumerate(shingles) if (c := brute(text, own)) >= lic.CONTAINMENT}
    have = {(k, m["template"]): m["containment"] for k in got for m in got[k]}
    assert len(want) > 300
    # A template of one or two shingles may be missed, with a probability below 0.001.
    missed = [x for x in want if x not in have]
    assert len(missed) <= 2 and all(len(shingles[n]) < 5 for _, n in missed)
    for (k, n), c in have.items():
        assert c <= brute(texts[k], shingles[n], lic.WINDOW) + 1e-9 and c >= want.get((k, n), 0) - 1e-9


def test_a_notice_repeated_very_often(spark):
    got = found(spark, [f"{lic.TEMPLATES[5].text}\n" * 2000, "x"])
    assert {m["template"] for m in got[0]} == {5} and got[0][0]["at"] == 0 and not got[1]


def test_clean_and_hard_documents(spark):
    got = lic.scan_licenses(hard.docs(spark))
    assert got.count() == len(hard.rows())
    assert got.filter("size(matches) > 0").count() == 0
    assert lic.scan_licenses(hard.empty(spark)).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, lic.TEMPLATES[0].text)] * 3 + [(None, lic.TEMPLATES[0].text)], "doc_id bigint, text string")
    assert [len(r["matches"]) for r in lic.scan_licenses(docs).collect()] == [1] * 4
