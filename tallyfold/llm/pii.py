"""Personal data: patterned identifiers, and terms that give them away.

Identifiers (e-mail addresses, IP addresses, card and phone numbers) come from
patterns.  They are the protected entities.  The corpus then tells which other
terms reveal them: for each entity and each term beside it in a line, the
documents that have the pair are set against those that have the term at all and
those that have the entity.  Terms that disclose an entity beyond the thresholds
become spans too, wherever they occur, to be generalised or, if they all but name
it, removed.

Entities that occur in the same lines throughout are one class, so that a line of
very many entities makes few pairs; and only terms and entities that occur often
enough, and in proportion, are paired at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, exploded, let, match_spans, small_side, text_key
from .secrets import span_report, spans_sql

__all__ = ["find_personal_data", "sanitised", "span_report"]

#: Documents that must have entity and term together.
SUPPORT = 2
#: Bits of pointwise mutual information, and probability of the entity given the term, from which a term discloses.
#: From the probability REMOVE on, the bits may be those of all documents with both.
BITS, PROBABILITY = 4.0, 0.5
#: Probability from which a disclosing term is removed rather than generalised.
REMOVE = 0.9
#: Terms are runs of letters and digits, lower-cased.
TERM = "[\\p{L}\\p{N}]+"

# The same languages as the contract's patterns. A run is entered at its start or where the last match ended, and
# nothing is given back, so that no text makes matching slow: each of these runs is followed by a character it can't hold.
_EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "[0-9](?:[\\x20-]?[0-9])++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(d: Column, k: Column) -> Column:
        n = d.cast("int")
        return F.when(k % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    each = F.transform(F.split(F.reverse(number), ""), worth)
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # leading zeros don't count
        return ~F.exists(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.substring(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), 1, 3) > "255"))
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    return F.length(digits(m)).between(10, 15)


def _entities(text: Column) -> Column:
    """``array<struct<start, rank, stop, kind, value>>`` of the patterned kinds."""
    quick = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]\\.[0-9]++\\.[0-9]"), "card": text.rlike("[0-9](?:[\\x20-]?[0-9]){13}"), "phone": text.rlike("\\+[0-9]")}
    kind_type = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"
    parts = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True)):
        parts.append(F.when(quick[kind], _of_kind(text, rank, kind, pattern)).otherwise(F.array().cast(kind_type)))
    return F.array_sort(F.concat(*parts))


def _of_kind(text: Column, rank: int, kind: str, pattern: str) -> Column:
    valid = F.filter(match_spans(text, pattern), lambda s: _valid(kind, s["match"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["match"].alias("value")))


#: Stands for what lies in an identifier; in texts themselves it gives way to another character that is in no term.
_MARK = "\x01"


def _masked(text: Column, entities: Column, put) -> Column:
    """The text with ``put(start, stop, number)`` for each entity; of overlapping ones the later begins where the other ends."""
    numbered = F.transform(entities, lambda e, k: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), k.alias("k")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def of(plain: Column) -> Column:
        def step(a: Column, e: Column) -> Column:
            first = F.greatest(e["start"], a["at"])
            piece = F.concat(F.substring(plain, a["at"] + 1, first - a["at"]), put(first, F.greatest(e["stop"], first), e["k"]))
            return F.struct(F.greatest(a["at"], e["stop"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

        return F.aggregate(numbered, none, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(plain, a["at"] + 1, F.length(plain))))

    return let(F.translate(text, _MARK, "\x02"), of)


def _masked_lines(text: Column, entities: Column) -> Column:
    """``array<struct<line, own, terms>>`` of lines that hold entities: those entities' values and the distinct terms beside them."""
    masked = _masked(text, entities, lambda first, stop, k: F.concat(F.lit(_MARK), k.cast("string"), F.lit(_MARK)))
    lines = F.filter(F.transform(F.split(masked, "\n"), lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda x: F.contains(x["x"], F.lit(_MARK)))

    def parts(x: Column) -> Column:
        own = F.transform(F.regexp_extract_all(x["x"], F.lit("\x01([0-9]+)\x01"), F.lit(1)), lambda k: F.get(entities, k.cast("int")))
        own = F.array_distinct(F.transform(own, lambda e: F.concat_ws(":", e["kind"], F.lower(e["value"]))))
        # A word that reaches into an entity is no term.
        plain = F.lower(F.regexp_replace(x["x"], "[\\p{L}\\p{N}]*+\\x01[0-9]++\\x01[\\p{L}\\p{N}]*+", " "))
        return F.struct(x["k"].alias("line"), own.alias("own"), F.array_distinct(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("terms"))

    return F.transform(lines, parts)


def _told(found: DataFrame, spread: DataFrame, n: int, support: int, bits: float, probability: float) -> DataFrame:
    """``hash, remove``: the terms that disclose an entity, each once."""
    line = found.filter("lines is not null").select("key", F.explode("lines").alias("x")).select("key", "x.line", "x.own", "x.terms")
    place = F.xxhash64("key", "line")
    each = exploded(line, F.col("own"), "entity", "key", "line").select("key", "entity", place.alias("place"))
    # Entities of the same lines are told by the same terms: one of each class stands for all.
    held = each.groupBy("entity").agg(
        F.count_distinct("key").alias("n_entity"), F.count(F.lit(1)).alias("n_lines"), F.bit_xor("place").alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "place")).alias("y")
    )
    held = held.filter(F.col("n_entity") >= support).groupBy("n_entity", "n_lines", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    held = checkpointed(held)
    side = small_side(held)
    kept = each.join(side, "entity").groupBy("key", "place").agg(F.collect_list(F.struct("entity", "n_entity")).alias("own"), F.max("n_entity").alias("most"))
    term = exploded(line, F.col("terms"), "term", "key", "line").select("key", F.xxhash64("key", "line").alias("place"), F.xxhash64("term").alias("hash"))
    # A term must occur with an entity in so many documents, and these must be such a share of its own.
    often = spread.filter(F.col("n_term") >= support)
    term = term.join(kept, ["key", "place"]).join(often, "hash").filter(F.col("most") >= F.col("n_term") * probability)
    pair = term.select("key", "hash", "n_term", F.explode(F.filter("own", lambda e: e["n_entity"] >= F.col("n_term") * probability)).alias("e")).select("key", "hash", "n_term", "e.*")
    both = pair.distinct().groupBy("hash", "entity", "n_term", "n_entity").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    given = F.col("both") / F.col("n_term")
    information = F.log2(given * F.lit(float(n)) / F.col("n_entity"))
    # All but certain terms of a frequent entity have few bits a document; all their documents together must have them.
    enough = (information >= bits) | ((given >= REMOVE) & (F.col("both") * information >= bits))
    return both.filter((given >= probability) & enough).groupBy("hash").agg(F.max(given >= REMOVE).alias("remove"))


def find_personal_data(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, bits: float = BITS, probability: float = PROBABILITY,
) -> DataFrame:
    """``doc_id`` and ``spans``, ``array<struct<start, rank, stop, kind>>``, for every row of ``docs``.

    Kinds are email, ip, card, phone, then ``term_general`` and ``term_remove``;
    spans are in code points, end exclusive, by start, then by kind in that
    order.  A disclosing term's spans are all of its occurrences in the table but
    those that overlap an identifier.  Counts are of rows, over the whole table.
    A null or empty text has no spans.  Repeated rows each count and each keep a
    row.  Other columns are not read.  An empty table gives an empty result.
    A very long text is held by one row.  Terms are compared by 64-bit hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), text_key(F.col(doc_id), body).alias("th"))
    found = rows.withColumn("entities", _entities(F.col("text")))
    lines = F.when(F.size("entities") > 0, _masked_lines(F.col("text"), F.col("entities")))
    found = checkpointed(found.select("doc_id", "th", "entities", lines.alias("lines"))).withColumn("key", F.monotonically_increasing_id())

    # Documents of each term, over all texts: counted before any join, by a 64-bit hash that stands for the term.
    hashes = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda x: F.xxhash64(x)))
    spread = exploded(rows, hashes, "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("n_term"))
    told = small_side(checkpointed(_told(found, spread, found.count(), support, bits, probability)))

    # Texts with a disclosing term, then its places in these.
    asked = exploded(rows, hashes, "hash", "th").join(told, "hash", "left_semi").select(F.col("th").alias("asked")).distinct()
    asked = small_side(checkpointed(asked))
    words = rows.join(asked, F.col("th") == F.col("asked"), "left_semi").select("th", "text", _entities(F.col("text")).alias("entities"))
    # Words that reach into an entity hold marks, and so are no known terms.
    masked = _masked(F.col("text"), F.col("entities"), lambda first, stop, k: F.repeat(F.lit(_MARK), stop - first))
    words = exploded(words.select("th", masked.alias("masked")), match_spans(F.col("masked"), "[\\p{L}\\p{N}\\x01]+"), "w", "th")
    words = words.select("th", "w.start", "w.stop", F.xxhash64(F.lower("w.match")).alias("hash"))
    hits = words.join(told, "hash").select("th", "start", "stop", "remove").distinct()
    rank = F.when(F.col("remove"), len(KINDS) + 1).otherwise(len(KINDS))
    kind = F.when(F.col("remove"), F.lit("term_remove")).otherwise(F.lit("term_general"))
    hits = hits.groupBy(F.col("th").alias("hit")).agg(F.collect_list(F.struct("start", rank.alias("rank"), "stop", kind.alias("kind"))).alias("terms"))
    out = found.select("doc_id", "th", "entities").join(small_side(checkpointed(hits)), F.col("th") == F.col("hit"), "left")
    plain = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["rank"].alias("rank"), e["stop"].alias("stop"), e["kind"].alias("kind")))
    return out.select("doc_id", F.array_sort(F.concat(plain, F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")))).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with identifiers and disclosing terms replaced.

    Identifiers become ``<email>`` and so on, generalised terms their first
    letter and an ellipsis, removed terms nothing.  A span that begins inside an
    earlier one is covered by it.
    """

    def step(a: Column, s: Column) -> Column:
        put = F.when(s["kind"] == "term_remove", F.lit("")).when(s["kind"] == "term_general", F.concat(F.substring(text, s["start"] + 1, F.lit(1)), F.lit("…"))).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), put)
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, none, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"
BASE_SQL = spans_sql([
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))"),
    ("card", "[0-9]([\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
])
