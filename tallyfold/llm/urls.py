"""URL filtering: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed entry is a host and a path prefix; it fits that host and its subdomains.
A URL is looked up under every suffix of its host with every path length the
list has.  The filter is a table of 512-bit blocks keyed by block number, so a
lookup is an equi-join on the block, then a test of eight bits; only keys that
pass go on to the exact join, which removes the filter's false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, small_side

#: Filter bits per listed entry, and words of 64 bits in a block.
BITS_PER_KEY = 24
WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


#: What is not part of a host's name: user info, a port, and dots at the end. The same in Java and in DuckDB.
_BESIDE_HOST = ["(?s)^.*@", ":[0-9]*\\z", "\\.+\\z"]


def canonical_host(host: Column) -> Column:
    """A lower-cased host without user info, port and dots at the end."""
    return reduce(lambda h, p: F.regexp_replace(h, p, ""), _BESIDE_HOST, host)


def bloom_bits(key: Column) -> list[Column]:
    """The bit of each word of its block that stands for a key."""
    h = F.xxhash64(F.lit(1), key)
    bits = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w7`` of the filter over column ``key``."""
    marked = keys.select(bloom_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bloom_bits(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def lookups(url: Column, host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys, ``host suffix + path prefix``, under which a URL might be listed."""
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))


#: Rank from which entries are listed under canonical hosts; entries of less are compared with the host as it is written.
CANONICAL_FROM = 1


def filter_urls(pages: DataFrame, listed: DataFrame, *, url: str = "url") -> DataFrame:
    """Every row's ``host``, ``path`` and the listed entry that decides over it.

    ``listed`` has ``host, path, verdict, rank``: among the entries that fit, the
    least rank decides, then the longest, then the least by code point; entries
    listed twice count once, and null fields make an entry unusable.  Entries of
    rank 0 are compared with the URL's host as it is, those of rank 1 and more with its
    canonical host; these are made canonical themselves, and those left without a
    host are unusable.  Result: all columns of ``pages`` under ``page``, and
    ``host, path, entry, verdict, rank`` (the last three null where nothing listed
    fits).  A null URL, or one without ``://``, has empty host and path and fits no
    entry.  Repeated URLs are judged once and each row gets the verdict.  A URL is
    looked up once per label of its host and length of a listed path, however long it
    is.  Of ``pages`` any columns may be there; they are carried in a struct.
    """
    listed = listed.dropna(subset=["host", "path", "verdict", "rank"])
    as_canonical = F.col("rank") >= CANONICAL_FROM
    listed = listed.withColumn("host", F.when(as_canonical, canonical_host(ascii_lower(F.col("host")))).otherwise(F.col("host"))).filter("host <> ''")
    key = F.concat(F.when(as_canonical, "c").otherwise("r"), F.col("host"), F.lit("\n"), F.col("path"))
    entries = listed.groupBy(key.alias("key")).agg(F.min(F.struct("rank", "verdict")).alias("way"))
    entries = checkpointed(entries.select("key", "way.rank", "way.verdict"))
    n = entries.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    found = entries.select(F.left("key", F.lit(1)), F.length(F.substring_index("key", "\n", -1))).distinct().collect()  # twice as many as the longest URL has characters, at most
    lengths = {tag: sorted(n for t, n in found if t == tag) for tag in "rc"}
    host, path = host_and_path(F.col("url"))
    distinct = pages.select(F.col(url).alias("url")).filter("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    raw = F.transform(lookups(F.col("url"), F.col("host"), F.col("path"), lengths["r"]), lambda k: F.concat(F.lit("r"), k))
    canonical = F.transform(lookups(F.col("url"), canonical_host(F.col("host")), F.col("path"), lengths["c"]), lambda k: F.concat(F.lit("c"), k))
    keys = distinct.filter("host <> ''").select("url", F.explode(F.array_distinct(F.concat(raw, canonical))).alias("key"))
    bits = small_side(bloom_filter(entries.select("key"), blocks))
    probe = keys.withColumn("block", bloom_block(F.col("key"), blocks)).join(bits, "block")
    passed = probe.filter(reduce(Column.__and__, [F.col(f"w{k}").bitwiseAND(b) != 0 for k, b in enumerate(bloom_bits(F.col("key")))])).select("url", "key")
    exact = passed.join(small_side(entries), "key")
    entry = F.replace(F.substr("key", F.lit(2)), F.lit("\n"), F.lit(""))
    best = exact.groupBy("url").agg(F.min(F.struct("rank", (-F.length("key")).alias("short"), entry.alias("entry"), "verdict")).alias("best"))
    judged = best.select(F.col("url").alias("judged"), "best.entry", "best.verdict", "best.rank")
    rows = pages.select(F.struct(*pages.columns).alias("page"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    return rows.join(judged, rows["url"] == judged["judged"], "left").drop("judged", "url")


#: The rules that the query judges by, longest first of those that fit.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Sites that the query blocks where no rule fits, whatever the path.
LISTED_SITES = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

_PARSED = """
SELECT page_id, lower_host AS host, path FROM (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))
"""
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SITES = ", ".join(f"('{s}')" for s in LISTED_SITES)
_CANONICAL = reduce(lambda h, p: f"regexp_replace({h}, '{p}', '')", _BESIDE_HOST, "host")
URLS_SQL = f"""
WITH parsed AS (SELECT *, {_CANONICAL} AS name FROM ({_PARSED})),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
sites(site) AS (VALUES {_SITES}),
fits AS (
  SELECT page_id, host, path,
    max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parsed)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN s.site IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN f.rule IS NULL THEN s.site END AS listed
FROM parsed p LEFT JOIN fits f USING (page_id, host, path)
LEFT JOIN sites s ON p.name = s.site OR ends_with(p.name, '.' || s.site)
"""
