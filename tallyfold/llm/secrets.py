"""Secret scanning behind a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: an
OR of ANDs that every matching text satisfies.  Documents are indexed by the
trigrams that queries use, postings are intersected, and only candidates are
verified with the regular expression.  A rule without mandatory trigrams is
scanned over every document.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, exploded, match_spans, small_side, text_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more.

    ``quick`` is a cheaper pattern that each text with such a match contains.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None


#: The base rules.
BASE = [
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
]
#: Prefixes and shapes of well-known credentials, in addition to the base rules.
MORE = [
    Rule("forge_token", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", "[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
]
RULES = BASE + MORE

#: Strings and trigram sets that a query may hold while it is derived; beyond, a part counts as anything.
EXACT, TERMS = 64, 64
#: Characters that a class may have to be spelled out.
SPELLED = 6


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams; each text with a match contains all of one set. None: no trigram is mandatory."""

    def of(strings: set[str]) -> list[frozenset[str]] | None:
        if any(len(s) < 3 for s in strings):
            return None
        return _least([frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings])

    def both(a, b):
        if a is None or b is None:
            return a if b is None else b
        return _least([x | y for x, y in product(a, b)]) if len(a) * len(b) <= TERMS else a

    def walk(tree) -> tuple[set[str] | None, list[frozenset[str]] | None]:
        """All strings a part can be, or None and the query for it."""
        exact, query, mixed = {""}, None, False
        for op, arg in tree:
            own, more = step(op, arg)
            if own is not None and len(exact) * len(own) <= EXACT:
                exact = {a + b for a, b in product(exact, own)}
            else:  # what came before is a term of its own, and what follows begins anew
                query, mixed = both(both(query, of(exact)), more), True
                exact = {""} if own is None else own
        return (None, both(query, of(exact))) if mixed else (exact, None)

    def step(op, arg):
        if op is kinds.LITERAL:
            return {chr(arg).lower()}, None
        if op is kinds.IN:
            chars = set()
            for kind, x in arg:
                if kind is kinds.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is kinds.RANGE and x[1] - x[0] < SPELLED:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars if len(chars) <= SPELLED else None), None
        if op is kinds.SUBPATTERN:
            return walk(arg[-1])
        if op is kinds.BRANCH:
            parts = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*[s for s, _ in parts]), None
            terms = [of(s) if s is not None else q for s, q in parts]
            return None, None if any(t is None for t in terms) else _least([x for t in terms for x in t])
        if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, inner = arg
            s, q = walk(inner)
            if s is not None and (low, high) == (0, 1):
                return s | {""}, None
            if s is not None and low == high and len(s) == 1:
                return {next(iter(s)) * low}, None
            return None, (of(s) if s is not None else q) if low else None
        return None, None

    exact, query = walk(parser.parse(pattern))
    return query if exact is None else of(exact)


def _least(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without repeats and without sets that contain another one."""
    return sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)


#: Letters of English text, the most frequent first.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def lead(terms: frozenset[str]) -> str:
    """The trigram of a conjunction that seems rarest by its letters; the least of several."""
    return min(terms, key=lambda g: (-sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in g), g))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``key, mask``: documents that satisfy trigram queries, bit k standing for rule k.

    A conjunction's trigrams are posted only where its rarest one occurs, since nothing else can satisfy it: a
    text is searched for all trigrams of a conjunction only after that one was found.
    """
    queries = [(k, terms) for k, rule in enumerate(rules) for terms in trigram_query(rule.pattern) or []]
    number = {g: k for k, g in enumerate(sorted({g for _, terms in queries for g in terms}))}
    led: dict[str, set[str]] = {}
    for _, terms in queries:
        led.setdefault(lead(terms), set()).update(terms)
    low = docs.select("key", F.lower("text").alias("low"))

    def present(first: str) -> Column:
        rest = [F.when(F.contains("low", F.lit(g)), F.lit(number[g])) for g in sorted(led[first] - {first})]
        return F.when(F.contains("low", F.lit(first)), F.array_compact(F.array(F.lit(number[first]), *rest))).otherwise(F.array().cast("array<int>"))

    postings = exploded(low, F.flatten(F.array(*[present(first) for first in sorted(led)])), "gram", "key")
    rows = [(c, rule, number[g], 1 << at, (1 << len(terms)) - 1) for c, (rule, terms) in enumerate(queries) for at, g in enumerate(sorted(terms))]
    uses = docs.sparkSession.createDataFrame(rows, "term int, rule int, gram int, bit bigint, every bigint")  # bounded by the rules
    met = postings.join(F.broadcast(uses), "gram").groupBy("key", "term").agg(F.bit_or("bit").alias("bits"), F.first("every").alias("every"), F.first("rule").alias("rule"))
    met = met.filter("bits = every").select("key", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("rule")).alias("mask"))
    return met.groupBy("key").agg(F.bit_or("mask").alias("mask"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, rank, stop, kind>>`` without the rank: matches that are long enough."""
    spans = match_spans(text, rule.pattern)
    if rule.group:
        kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
        spans = F.filter(F.zip_with(spans, kept, lambda s, k: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), k.alias("kept"))), lambda s: s["kept"])
    elif rule.least > 1:
        spans = F.filter(spans, lambda s: s["stop"] - s["start"] >= rule.least)
    return spans


def named(spans: Column, rank: int, kind: str) -> Column:
    """Spans with their kind and its place among kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id`` and ``spans``, ``array<struct<start, rank, stop, kind>>``, for every row of ``docs``.

    Spans are in code points with an exclusive end, ordered by start, then by
    the rule's place in ``rules``.  A null or empty text has none.  Rows that
    repeat an id and a text each get their row; other columns are not read; an
    empty table gives an empty result.

    The index pass and the verifying pass each read the texts once.  Candidates
    are broadcast if they are few, else joined by a shuffle on a hash of id and
    text; a collision there only makes one more candidate.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("doc_id"), F.col("text")))
    indexed = [k for k, rule in enumerate(rules) if trigram_query(rule.pattern)]
    if indexed:
        found = small_side(checkpointed(candidates(rows.select("key", "text"), rules)))
        rows = rows.join(found.withColumnRenamed("key", "found"), F.col("key") == F.col("found"), "left")
    else:
        rows = rows.withColumn("mask", F.lit(None).cast("bigint"))
    kind = "array<struct<start:int,rank:int,stop:int,kind:string>>"
    parts = []
    for k, rule in enumerate(rules):
        test = F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 if k in indexed else F.lit(True)
        if rule.quick:
            test = test & F.col("text").rlike(rule.quick)
        spans = named(rule_spans(F.col("text"), rule), k, rule.kind)
        parts.append(F.when(test, spans).otherwise(F.array().cast(kind)))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def n_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def span_report(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [n_of(b).alias(f"n_{b}") for b in base]
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def spans_sql(kinds_: list[tuple[str, str, str]], more: list[tuple[str, str, str]] = ()) -> str:
    """DuckDB SQL for the report: ``(kind, pattern, condition on m)``, m being a match's text, g2 its second group.

    Kinds of ``more`` are among the spans, but not counted and not in the digest.
    """
    parts = []
    for rank, (kind, pattern, condition) in enumerate([*kinds_, *more]):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT n, {rank} AS rank, '{kind}' AS kind, first AS start, first + length(m) AS stop FROM (
    SELECT n, m, g2, sum(length(gap) + length(m)) OVER (PARTITION BY n ORDER BY k) - length(m) AS first FROM (
      SELECT n, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS m,
        unnest(regexp_extract_all(text, '{p}', {2 if "g2" in condition else 0})) AS g2, generate_subscripts(string_split_regex(text, '{p}'), 1) AS k
      FROM docs WHERE regexp_matches(text, '{p}')) WHERE m IS NOT NULL)
  WHERE {condition}""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds_)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({union})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(kinds_)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM docs LEFT JOIN spans USING (n) GROUP BY n, doc_id
"""


SECRETS_SQL = spans_sql(
    [("assign", BASE[0].pattern, "length(g2) >= 8"), ("access", BASE[1].pattern, "length(m) >= 16"), ("hex", BASE[2].pattern, "length(m) >= 32")],
    [(rule.kind, rule.pattern, f"length(m) >= {rule.least}") for rule in MORE],
)
