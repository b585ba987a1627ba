"""SimHash near-duplicates by a self-join of binary tries.

1. Fingerprints are summed in the JVM: a row per shingle, hashed, and 64 bit
   counters packed two to a long, so that partial sums happen before the shuffle.
2. Distinct fingerprints are dealt out by their first bits, the top nodes of a
   binary trie.  Each pair of top nodes within the error budget is one task that
   walks both tries together, carries the differing bits so far and drops a pair
   of nodes as soon as the budget is exceeded.
3. Links of each task are cut to a spanning star per component; components over
   all tasks come from alternating large-star and small-star joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, free_name, small_side, space_words

SHINGLE = 3
BUDGET = 2
#: Distinct fingerprints that one top node of the trie may hold before the top gets more levels.
NODE_ROWS = 200_000
#: Links whose components one task finds; more of them take rounds of joins.
ONE_TASK = 1 << 18
#: Pairs of nodes that a task expands at once.
FRONTIER = 1 << 18
#: A pair of nodes with so few pairs of fingerprints is compared outright.
LEAF_PAIRS = 8
#: The top of the trie has at least MIN_TOP and at most MAX_TOP levels.
MIN_TOP, MAX_TOP = 4, 20

_LOW, _HALF = 0x0000000100000001, 0xFFFFFFFF


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, into: str = "simhash") -> tuple[DataFrame, str]:
    """All rows of ``docs`` without the text, with a 64-bit fingerprint, and that column's name.

    A null text, or one without words, has fingerprint zero.  A text of fewer
    words than a shingle is one shingle.  Repeated rows each keep a row.  Rows
    are told apart by their place, so ``docs`` should be files or a checkpoint,
    whose rows keep their places when a lost part is read again.
    """
    name = free_name(docs, into)
    keep = [c for c in docs.columns if c != text]
    words = space_words(ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"), words.alias("words"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    starts = F.when(F.size("words") >= shingle, F.sequence(F.lit(0), F.size("words") - shingle)).when(F.size("words") > 0, F.array(F.lit(0)))
    each = rows.select("row", "kept", "words", F.explode_outer(starts).alias("at"))
    parts = [x for k in range(shingle) for x in ((F.lit(" "), F.get("words", F.col("at") + k)) if k else (F.get("words", F.col("at")),))]
    whole = F.when(F.size("words") >= shingle, F.concat(*parts)).otherwise(F.array_join("words", " "))
    each = each.select("row", "kept", F.when(F.col("at").isNotNull(), F.xxhash64(whole)).alias("h"))
    packed = [F.coalesce(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LOW))), F.lit(0)).alias(f"s{k}") for k in range(32)]
    # The row's own columns are keys too: as values they would make this a sort of all shingles.
    sums = each.groupBy("row", "kept").agg(F.count("h").alias("n"), *packed)

    def bit(k: int) -> Column:
        lanes = F.col(f"s{k % 32}")
        count = lanes.bitwiseAND(F.lit(_HALF)) if k < 32 else F.shiftrightunsigned(lanes, 32)
        value = (1 << k) - (1 << 64 if k == 63 else 0)
        return F.when(count * 2 > F.col("n"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    bits = reduce(Column.bitwiseOR, [bit(k) for k in range(64)])
    return sums.select(*([F.col("kept")[c].alias(c) for c in keep]), bits.alias(name)), name


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def trie_links(
    a: np.ndarray, b: np.ndarray | None, budget: int, top: int, *, depth: int = 64, label: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the sorted ``a`` and ``b`` (None: ``a`` with itself) of fingerprints within the budget.

    All of ``a`` share their first ``top`` bits, and so do all of ``b``.  Bits
    after the first ``depth`` are zero.  ``label`` has the components so far of
    ``a`` and ``b`` and may change between links: pairs of nodes that are in one
    component are dropped.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return

    def ones(x: np.ndarray) -> list[np.ndarray]:
        """For each level, how many of the first fingerprints go to the right."""
        return [np.concatenate(([0], np.cumsum((x >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int32))) for d in range(top, depth)]

    def last(x: np.ndarray) -> np.ndarray:
        """For each place, where its run of equal labels ends."""
        edge = np.append(np.flatnonzero(np.diff(x)) + 1, len(x))
        return np.repeat(edge, np.diff(edge, prepend=0))

    right_a = ones(a)
    right_b = right_a if own else ones(b)
    start = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - top))) if top else 0
    stack = [(top, *(np.array([x], np.int32) for x in (0, len(a), 0, len(b), start)))]
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if label is not None:
            x, y = label
            apart = (x[al] != y[bl]) | (last(x)[al] < ah) | (last(y)[bl] < bh)
            al, ah, bl, bh, diff = al[apart], ah[apart], bl[apart], bh[apart], diff[apart]
        small = (ah - al).astype(np.int64) * (bh - bl) <= LEAF_PAIRS
        if d == depth:
            small[:] = True
        if small.any():
            x, y, w = al[small], bl[small], (bh - bl)[small]
            n = (ah - al)[small].astype(np.int64) * w
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, x, y = np.repeat(w, n), np.repeat(x, n), np.repeat(y, n)
            i, j = x + k // w, y + k % w
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            yield i[near], j[near]
        go = ~small
        if not go.any():
            continue
        al, ah, bl, bh, diff = al[go], ah[go], bl[go], bh[go], diff[go]
        ra, rb = right_a[d - top], right_b[d - top]
        am, bm = ah - (ra[ah] - ra[al]), bh - (rb[bh] - rb[bl])
        # Of a node with itself, left-right and right-left are the same pairs.
        kids = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am, ah, bl, bm, diff + 1)]
        nodes = [np.concatenate(x) for x in zip(*kids, strict=True)]
        if own:
            same = (al == bl) & (ah == bh)
            skip = np.concatenate([np.zeros(3 * len(al), bool), same])
        else:
            skip = np.zeros(len(nodes[0]), bool)
        keep = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget) & ~skip
        nodes = [x[keep] for x in nodes]
        for k in range(0, len(nodes[0]), FRONTIER):
            stack.append((d + 1, *(x[k : k + FRONTIER] for x in nodes)))


def _stars(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place and its component's least place, for all in a component but the least; links come in blocks.

    ``label``: places in order, which become those of the components so far.
    """
    label = np.arange(n) if label is None else label
    for i, j in links:
        while len(i):
            x, y = label[i], label[j]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low < high
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label != (up := label[label])).any():
                label[:] = up
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def fingerprint_links(prints: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """Links ``(u, v)`` among the distinct fingerprints in column ``p``: of each task, a star per component."""
    tops = range(MIN_TOP, MAX_TOP + 1, 2)
    fullest = {}
    for top in tops:
        fullest[top] = prints.groupBy(F.shiftrightunsigned("p", 64 - top).alias("node")).count().agg(F.max("count")).first()[0] or 0
        if fullest[top] <= NODE_ROWS:
            break
    top = next((t for t in tops if fullest.get(t, NODE_ROWS + 1) <= NODE_ROWS), MAX_TOP)
    flips = [0] + [1 << i for i in range(top)]
    if budget >= 2:
        flips += [(1 << i) | (1 << j) for i in range(top) for j in range(i)]
    if budget > 2:
        flips = [f for f in range(1 << top) if f.bit_count() <= budget] if top <= 12 else None
        if flips is None:
            raise ValueError("a budget above 2 needs at most 12 levels at the top")
    node = F.shiftrightunsigned("p", 64 - top)
    dealt = prints.select("p", node.alias("node"), F.explode(F.array(*[F.lit(f).cast("bigint") for f in flips])).alias("flip"))
    other = F.col("node").bitwiseXOR(F.col("flip"))
    dealt = dealt.select("p", F.least("node", other).alias("a"), F.greatest("node", other).alias("b"), (F.col("node") <= other).alias("first"))

    def join(group: pa.Table) -> pa.Table:
        p = group["p"].to_numpy().view(np.uint64)
        first = group["first"].to_numpy()
        if group["a"][0].as_py() == group["b"][0].as_py():
            both = np.sort(p)
            member, least = _stars(len(both), trie_links(both, None, budget, top))
        else:
            a, b = np.sort(p[first]), np.sort(p[~first])
            both = np.concatenate([a, b])
            member, least = _stars(len(both), ((i, j + len(a)) for i, j in trie_links(a, b, budget, top)))
        return pa.table({"u": both[member].view(np.int64), "v": both[least].view(np.int64)})

    return dealt.groupBy("a", "b").applyInArrow(join, "u bigint, v bigint")


def components(links: DataFrame, *, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, least)``: every linked node with the least node of its component.

    Up to ``one_task`` links, counted, go to one task that labels them.  More take
    alternating large-star and small-star joins until nothing changes: each step
    is a grouped minimum, joined back; a node with very many links is split by
    the skew-join rule, and its minimum is taken before the shuffle.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([b["u"].to_numpy(), b["v"].to_numpy()]) for b in batches if b.num_rows]
        if found:
            nodes, at = np.unique(np.concatenate(found, 1), return_inverse=True)
            at = at.reshape(2, -1)
            member, least = _stars(len(nodes), iter([(at[0], at[1])]))
            label = np.arange(len(nodes))
            label[member] = least
            yield pa.record_batch({"node": nodes, "least": nodes[label]})

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            by = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            by = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = by.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        joined = by.join(low, by["u"] == low["c"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).alias("mark")
    edges, before = checkpointed(links.select("u", "v").distinct()), None
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(labelled, "node bigint, least bigint")
    while True:  # settles: each step moves links to lesser nodes
        edges = checkpointed(star(star(edges, True), False))
        now = edges.agg(mark).first()[0]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        before = now


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``fingerprint`` (signed long) and ``component_id`` for every row of ``docs``.

    Fingerprints within ``budget`` differing bits are linked, equal ones too;
    ``component_id`` is the least doc_id that links reach.  Null and wordless
    texts have fingerprint zero and are linked like others.  Null ids are passed
    over in the minimum; a component of null ids only has a null component_id.
    Repeated rows keep a row each, other columns are not read, and an empty
    table gives an empty result.
    """
    prints, name = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle)
    prints = checkpointed(prints.select("doc_id", F.col(name).alias("p")))
    classes = checkpointed(prints.groupBy("p").agg(F.min("doc_id").alias("low")))
    found = components(fingerprint_links(classes.select("p"), budget=budget))
    named = classes.join(found, classes["p"] == found["node"], "left").select("p", "low", F.coalesce("least", "p").alias("least"))
    lows = named.groupBy("least").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "least").select(F.col("p").alias("q"), "component_id")
    return prints.join(named, prints["p"] == named["q"]).select("doc_id", F.col("p").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: the one of least id, then of least text hash.

    ``find`` tells the components and takes ``options``.  All columns stay.  Of
    rows equal in id and text any one stays.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))
    name = free_name(docs, "row_key")
    # The key stands in for the id, so that a component's least key names its keeper.
    thin = docs.select(key.alias(name), F.col(text).alias("text"))
    rows = find(thin, doc_id=name, **options)
    # Rows to drop are fewer than rows to keep, so texts are joined with those: without a shuffle where they are few.
    state = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("doc_id") == F.col("component_id"))).alias("keeper"))
    state = checkpointed(state.filter("n > 1 or not keeper").select(F.col("doc_id.id").alias("i"), F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b"), "keeper"))
    keyed = docs.withColumn(name, key)

    def of(keys: DataFrame, how: str) -> DataFrame:
        keys = small_side(keys)
        same = F.col(f"{name}.a").eqNullSafe(keys["a"]) & (F.col(f"{name}.b") == keys["b"]) & F.col(f"{name}.id").eqNullSafe(keys["i"])
        return keyed.join(keys, same, how)

    repeated = state.filter("keeper")
    out = of(state, "left_anti")
    if repeated.take(1):
        out = out.union(of(repeated, "left_semi").dropDuplicates([name]))
    return out.drop(name)
