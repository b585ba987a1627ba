"""Secrets and personal data against plain scans, on texts made to be awkward."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import pii, secrets
from tallyfold.llm.common import match_spans

from . import hard

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return "".join(c for c in m if c.isdigit())


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def base_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def fuzz(pieces, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


SECRET_PIECES = ["password", "PassWd", "token", "secret=", "api_key", "apikey", ": ", "=", '"', "'", "abcdefgh", "12345678", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "f" * 16, " ", "\n", "é", "😀", "abc", "Token:", "/+"]
PII_PIECES = ["joe", "@", "mail", ".com", ".", "-", "_", "+1", " (555) ", "555-0100", "1.2.3.4", "255.", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "9", " ", "\n", "é", "😀", "a@b.c", "007.", "+44 20 7946 0958", "%"]


def test_base_secrets_on_fuzz(spark):
    texts = fuzz(SECRET_PIECES, 1500, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secrets.find_secrets(docs, rules=secrets.BASE).collect():
        assert [(s["start"], s["rank"], s["kind"], s["stop"]) for s in r["spans"]] == base_secrets(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_more_secrets_leave_base_spans(spark):
    texts = ["x ghp_" + "a1B2" * 10, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "token = 'ghp_" + "Z" * 36 + "'", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert [[s["kind"] for s in got[k]] for k in range(5)] == [["forge_token"], ["chat_token"], ["private_key"], ["assign", "forge_token"], []]
    for k, t in enumerate(texts):
        assert [(s["start"], s["rank"], s["kind"], s["stop"]) for s in got[k] if s["rank"] < 3] == base_secrets(t)


MORE_PIECES = ["gh", "ghp_", "gho_", "xox", "oxb-", "xoxb-", "rk_live_", "sk_li", "ve_", "AIza", "iza", "eyJ", ".eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "PRIVATE KE", "a1B2" * 5, "Z9" * 18, "k" * 35, " ", "é"]


def test_all_kinds_on_fuzz_and_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(7)
    texts = ["".join(rng.choices(MORE_PIECES + SECRET_PIECES, k=rng.randint(1, 14))) for _ in range(1500)]
    texts += [a + b for a in MORE_PIECES for b in MORE_PIECES]
    texts += ["eyJ" + "aB3_" * n + ".eyJ" + "c-4D" * m + tail for n in (1, 2) for m in (1, 2) for tail in ("", ".", ".signature", ".Eight888")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.find_secrets(docs).persist()
    fired = Counter()
    for r in found.collect():
        want = [(s, k, rule.kind, e) for k, rule in enumerate(secrets.RULES[3:], 3) for s, e in (m.span() for m in re.finditer(rule.pattern, texts[r["doc_id"]]))]
        want = sorted(want + base_secrets(texts[r["doc_id"]]))
        assert [(s["start"], s["rank"], s["kind"], s["stop"]) for s in r["spans"]] == want, texts[r["doc_id"]]
        fired.update(k for _, _, k, _ in want)
    assert set(fired) == {rule.kind for rule in secrets.RULES}
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = sorted(map(tuple, secrets.span_report(found, ["assign", "access", "hex"]).select(*names).collect()))
    documents = docs.toPandas()  # what DuckDB reads by its name
    assert len(documents) and got == sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({secrets.SECRETS_SQL})").fetchall())


def test_trigram_queries_hold_for_every_match():
    rng = random.Random(0)
    samples = {"assign": ["password=", "PASSWD: ", "api_key='", "apikey =", "token:", "secret=\""], "access": ["AKIA"], "forge_token": ["ghp_", "gho_"], "chat_token": ["xoxb-", "xoxs-"]}
    for rule in secrets.RULES:
        terms = secrets.trigram_query(rule.pattern)
        for s in samples.get(rule.kind, []):
            t = (s + "".join(rng.choices("ABCDEFGHJK234567", k=40))).lower()
            assert any(all(g in t for g in term) for term in terms), (rule.kind, t)
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("ab|abcd") is None
    assert secrets.trigram_query("(abc|bcd)x*yzw") == [frozenset(("abc", "yzw")), frozenset(("bcd", "yzw"))]


def test_base_pii_on_fuzz(spark):
    texts = fuzz(PII_PIECES, 2500, 2) + ["a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x" * 200_000 + "@", "9" * 100_000, "1." * 30_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find_personal_data(docs).collect():
        base = [(s["start"], s["rank"], s["kind"], s["stop"]) for s in r["spans"] if s["rank"] < 4]
        assert base == base_pii(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def terms(t, spans):
    """(word, start, stop) of words in lines with entities, beside which entities they stand."""
    for line in re.finditer("[^\n]+", t):
        own = [s for s in spans if s[0] < line.end() and s[3] > line.start()]
        for w in re.finditer(r"[^\W\d_]{4,}", line[0]):
            a, b = line.start() + w.start(), line.start() + w.end()
            if own and not any(s[0] < b and s[3] > a for s in own):
                yield w[0].lower(), a, b, {(s[2], t[s[0] : s[3]].lower()) for s in own}


def test_disclosing_terms_match_brute_force(spark):
    import math

    rng = random.Random(8)
    common = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna"]
    texts = []
    for k in range(300):
        line = " ".join(rng.choices(common, k=12))
        if k % 10 == 0:
            line += f" gardener{'x' * (k % 3)} wrote from u{k % 30}@mail.example.com today"
        texts.append(line + "\n" + " ".join(rng.choices([*common, "gardener" if k % 50 == 7 else "amet"], k=9)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    both, holds, df = Counter(), Counter(), Counter()
    for t in texts:
        spans = base_pii(t)
        holds.update({(s[2], t[s[0] : s[3]].lower()) for s in spans})
        df.update(set(re.findall(r"[^\W\d_]{4,}", t.lower())))
        both.update({(w, e) for w, _, _, own in terms(t, spans) for e in own})
    told = {}
    for (w, e), n in both.items():
        p = n / df[w]
        if n >= pii.SUPPORT and p >= pii.PROBABILITY and math.log2(p * len(texts) / holds[e]) >= pii.BITS:
            told[w] = told.get(w, False) or p >= pii.REMOVE
    seen = 0
    for k, t in enumerate(texts):  # wherever they occur, in texts without an identifier too
        spans = base_pii(t)
        want = {m.span(): told[m[0].lower()] for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told and not any(s[0] < m.end() and s[3] > m.start() for s in spans)}
        assert {(s["start"], s["stop"]): s["kind"] == "term_remove" for s in got[k] if s["rank"] >= 4} == want
        seen += len(want)
    assert seen and any(base_pii(t) == [] and any(s["rank"] >= 4 for s in got[k]) for k, t in enumerate(texts))


def test_a_line_of_very_many_entities_and_words(spark):
    line = " ".join(f"w{k}" for k in range(50_000)) + " " + " ".join(f"u{k}@x.org" for k in range(5_000))
    docs = spark.createDataFrame([(1, line), (2, line), *[(k, "plain words of no one") for k in range(3, 60)]], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["n"] for r in pii.find_personal_data(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {k: 55_000 if k < 3 else 0 for k in range(1, 60)}


def test_base_columns_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256"]
    got = sorted(map(tuple, pii.span_report(pii.find_personal_data(docs), pii.KINDS).select(*names).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({pii.BASE_SQL})").fetchall())


def test_sanitised(spark):
    text = "ask joe@x.org or call +1 (555) 555-0100 today"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    out = docs.join(pii.find_personal_data(docs), "doc_id").select("doc_id", pii.sanitised(F.coalesce("text", F.lit("")), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {1: "ask <email> or call <phone> today", 2: ""}


def test_hard_documents(spark):
    for find, base in ((secrets.find_secrets, base_secrets), (pii.find_personal_data, base_pii)):
        got = find(hard.docs(spark)).select("doc_id", F.size("spans").alias("n")).collect()
        assert Counter((r["doc_id"], r["n"]) for r in got) == Counter((i, len(base(t or ""))) for i, t, *_ in hard.rows())
        assert find(hard.empty(spark)).count() == 0


def test_match_spans_over_many_matches(spark):
    t = "ab,é;" * 2000 + "zz"
    got = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(match_spans(F.col("t"), "[a-z]+").alias("s")).collect()
    assert [(x["start"], x["stop"], x["match"]) for x in got[0]["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z]+", t)]
    assert not got[1]["s"] and not got[2]["s"]
