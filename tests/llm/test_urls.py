import random

import duckdb
from pyspark.sql import functions as F

from tallyfold.llm import queries, urls


def test_query_matches_sql(spark, sf_dir):
    got = queries.op4_url_filter(spark, sf_dir).toPandas().sort_values("page_id", ignore_index=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op4_url_filter"]).df().sort_values("page_id", ignore_index=True)
    assert got.fillna("").astype(str).equals(want[got.columns].fillna("").astype(str))


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rest[:cut].translate(str.maketrans(up, up.lower())), path


def canonical(host):
    name = host.rsplit("@", 1)[-1]
    head, colon, port = name.rpartition(":")
    return (head if colon and not port.strip("0123456789") else name).rstrip(".")


def judged(url, listed):
    host, path = parts(url)
    name = canonical(host)
    fits = [(r, -len(h + p), h + p, v) for h, p, v, r in listed for own in [name if r else host] if own and (own == h or own.endswith("." + h)) and path.startswith(p)]
    return min(fits)[2:] if fits else (None, None)


def test_brute_force(spark):
    rng = random.Random(2)
    hosts = ["Example.ORG", "a.example.org", "org", "x.com", "com", "notexample.org", "example.org.", "", "É.com", "a..b.org", "example.org:80", "deep.er.spam.net", "spam.net.", "me@Spam.net", "a:b@c@x.spam.net.:8080", "spam.net:", "spam.net:8a", "@", ":80", "x.com\n"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/19", "/fr/x", "/de/", "/de/?a=://b", "?q=/es/", "#/fr/", "/en/1/é"]
    found = [f"{s}{h}{p}" for s in ("http://", "https://", "", "x://y://") for h in hosts for p in paths] + [None, "", "://", "no scheme"]
    found += rng.choices(found, k=200)
    listed = [(*r, 0) for r in urls.RULES] + [("spam.net", "", "block", 1), ("x.com", "/en/", "block", 1), ("x.com", "/en/", "block", 1), (None, "/", "block", 1)]
    listed += [("", "", "block", 1), ("...:1", "/", "block", 1), ("", "/es/", "block", 0)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(found)], "page_id bigint, url string, host string")
    got = urls.filter_urls(pages, spark.createDataFrame(listed, "host string, path string, verdict string, rank int")).select("page.page_id", "page.url", "host", "path", "entry", "verdict").collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(found)))
    good = [x for x in listed if x[0] and canonical(x[0])]
    for r in got:
        assert (r["host"], r["path"]) == parts(r["url"]), r
        assert (r["entry"], r["verdict"]) == judged(r["url"], good), r


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    bits = urls.bloom_filter(keys, 140)
    assert bits.count() <= 140
    asked = keys.union(spark.range(3000, 9000).select(F.concat(F.lit("h"), "id"))).withColumn("block", urls.bloom_block(F.col("key"), 140)).join(bits, "block")
    for k, b in enumerate(urls.bloom_bits(F.col("key"))):
        asked = asked.filter(F.col(f"w{k}").bitwiseAND(b) != 0)
    passed = asked.select(F.substring("key", 2, 9).cast("int").alias("n"))
    assert passed.filter("n < 3000").count() == 3000
    assert passed.filter("n >= 3000").count() < 60


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string, rank int")
    assert urls.filter_urls(pages, none).count() == 0
    assert urls.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string"), none).first()["entry"] is None


def test_canonical_hosts_against_sql(spark, tmp_path):
    rng = random.Random(5)
    ends = ["", "/", "/es/1", "/en/1", "/fr/", "/de/x?q", "#a"]
    hosts = [*urls.LISTED_SITES, "example.org", "www.example.org", "b.com", "example.org.", "é.net", ""]
    sites = [f"{rng.choice(['', 'u@', 'a.', 'U:p@B.'])}{h}{rng.choice(['', '.', ':80', '.:1', ':x', '..'])}" for h in hosts for _ in range(6)]
    found = [f"http://{h}{rng.choice(ends)}" for h in sites] + [None, "", "x"]
    spark.createDataFrame(list(enumerate(found)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op4_url_filter(spark, str(tmp_path))
    got = [tuple(r) for r in rows.collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(rows.columns)} FROM ({urls.URLS_SQL})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(found)
    assert {r[-1] for r in got} >= {s for s in urls.LISTED_SITES if not s.endswith(("com", "org"))}
