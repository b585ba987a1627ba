"""Benchmark decontamination with suffix arrays over shards of the training text.

Each executor cuts its documents into shards and builds the suffix array of a
shard's words.  Every suffix of the benchmark is binary-searched in it, which
gives its longest verbatim match and the place; suffixes that match a whole
window are searched for the range of all its occurrences.  Of the merged order
each training suffix has a benchmark suffix before and after it, and the longer
of their common prefixes is the longest match that begins there.

Occurrences stay ranges of the suffix array until they are marked, so that a
text that repeats itself costs no more than another one.  Training words that
the benchmark hasn't end a suffix.  Words are compared by a 64-bit hash of their
bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

WINDOW = 10
#: Benchmark bytes of a block. Blocks are made, sent and searched one after the other.
BLOCK_BYTES = 8 << 20
#: Words in a shard, about. A longer document is cut into shards that overlap by the longest benchmark item.
SHARD_WORDS = 1 << 17
#: Text bytes whose words are hashed at once.
CHUNK_BYTES = 1 << 19
#: Pairs of document and item that are held at once before repeated ones go.
PAIRS = 1 << 20

RESULT = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, stop: bigint>>, longest: bigint, longest_at: bigint>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in ``data``, A-Z lower-cased, and at each text's start the number of words before it.

    ``starts`` holds the byte at which each text begins and, last, the length;
    ``word`` tells of each byte whether it is in words.
    """
    n = len(data)
    low = _LOWER[data]
    inside = word[low]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[low] * _power(_BASE, n)[:n], out=total[1:])
    hashes = (total[end] - total[begin]) * _power(_INVERSE, n + 1)[begin]
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(begin, starts)


def suffix_array(words: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of ``words`` up to ``most``, how many words each place's suffix has, and its first words (see :func:`packed`).

    A suffix ends before the next 0; places of 0 have none.  Suffixes are
    ordered by their first ``depth`` words at least, by doubling: those not told
    apart by h words are sorted by the rank of what follows these.
    """
    n = len(words)
    zero = np.flatnonzero(words == 0)
    ends = np.append(zero, n)
    size = ends[np.searchsorted(zero, np.arange(n), "left")] - np.arange(n)
    at = np.flatnonzero(words)
    firsts, h = packed(words, size, most)
    key = firsts[at]
    order = np.argsort(key, kind="stable")
    array, key = at[order], key[order]
    # A place's rank is one more than how many suffixes lie before its group.
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.zeros(0, int)
    rank = np.zeros(n + 1, np.int64)
    rank[array] = first + 1
    open_ = np.arange(len(array))
    while h < depth and len(open_):
        own = rank[array[open_]]
        # Groups of one, and groups that end within h words, are done.
        head = np.concatenate(([True], own[1:] != own[:-1]))
        group = np.cumsum(head) - 1
        count = np.bincount(group)
        longest = np.maximum.reduceat(size[array[open_]], np.flatnonzero(head))
        open_ = open_[((count > 1) & (longest > h))[group]]
        if not len(open_):
            break
        place = array[open_]
        own = rank[place]
        after = np.where(size[place] > h, rank[np.minimum(place + h, n)], 0)
        by = np.lexsort((after, own))
        place, own, after = place[by], own[by], after[by]
        array[open_] = place
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
        rank[place] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))] + 1
        h *= 2
    return array, size, firsts


def _width(most: int) -> tuple[int, int]:
    """Bits of a word up to ``most``, and how many words a number holds."""
    bits = max(1, most.bit_length())
    return bits, min(63 // bits, 8)


def packed(words: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Some words from each place on in one number that sorts as they do, zeros behind a suffix's end, and how many words that is."""
    bits, width = _width(most)
    key = words.astype(np.uint64)
    for k in range(1, width):
        key <<= np.uint64(bits)
        ahead = np.zeros_like(key)
        ahead[: max(0, len(words) - k)] = words[k:]
        ahead[size <= k] = 0
        key |= ahead
    return key, width


@dataclass(frozen=True)
class BenchmarkIndex:
    """A block of benchmark items: their words' numbers, items apart by a 0, and their suffixes in order.

    ``vocabulary`` holds the sorted hashes of the words, ``item`` each place's
    item, ``size`` how many words are left of it, ``window`` how many words its
    window has (0: none begins there), ``order`` the suffix array, ``firsts`` the
    first words of each suffix.
    """

    vocabulary: np.ndarray
    names: list[str]
    words: np.ndarray
    item: np.ndarray
    size: np.ndarray
    window: np.ndarray
    order: np.ndarray
    firsts: np.ndarray
    longest: int

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> BenchmarkIndex:
        texts = [t.encode() for _, t in items]
        starts = np.cumsum([0, *map(len, texts)])
        hashes, at = word_hashes(np.frombuffer(b"".join(texts), np.uint8), starts)
        vocabulary, ids = np.unique(hashes, return_inverse=True)
        names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(names)}
        n_words = np.diff(at)
        own = np.repeat(np.arange(len(items)), n_words)
        place = np.arange(len(hashes)) + own
        words = np.zeros(len(hashes) + len(items), np.uint32)
        words[place] = ids + 1
        item = np.zeros(len(words), np.int64)
        item[place] = np.array([number[name] for name, _ in items], np.int64)[own]
        longest = int(n_words.max(initial=0))
        order, size, firsts = suffix_array(words, longest, len(vocabulary))
        least = np.zeros(len(words), np.int64)
        least[place] = np.minimum(window, n_words)[own]
        return cls(vocabulary, names, words, item, size, np.where(size >= least, least, 0), order, firsts, longest)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary from 1 on; 0 if it isn't there."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


class Matcher:
    """A shard's suffix array beside the benchmark's words."""

    def __init__(self, index: BenchmarkIndex, words: np.ndarray) -> None:
        most = len(index.vocabulary)
        self.bits, self.width = _width(most)
        self.array, self.size, self.mine = suffix_array(words, index.longest, most)
        self.theirs, self.left = index.firsts, index.size
        self.ordered = self.mine[self.array]

    def common(self, apart: np.ndarray) -> np.ndarray:
        """How many whole words lie ahead of the highest bit of each difference of packed words."""
        limits = np.uint64(1) << (np.arange(self.width, dtype=np.uint64) * np.uint64(self.bits))
        return self.width - np.searchsorted(limits, apart, "right")

    def compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words of training suffixes ``i`` and the first ``most`` words of benchmark suffixes ``j``, and whether ``i`` comes first.

        ``known``: so many are known to agree.
        """
        common = known.copy()
        less = np.zeros(len(i), bool)
        todo = np.arange(len(i))
        while len(todo):
            a, b, c = i[todo], j[todo], common[todo]
            least = np.minimum(self.size[a], most[todo])
            ended = c >= least
            less[todo[ended]] = self.size[a[ended]] < most[todo[ended]]
            common[todo[ended]] = least[ended]
            go = ~ended
            todo, a, b, c, least = todo[go], a[go], b[go], c[go], least[go]
            x, y = self.mine[a + c], self.theirs[b + c]
            apart = x != y
            at = todo[apart]
            same = c[apart] + self.common(x[apart] ^ y[apart])
            cut = same >= least[apart]
            common[at] = np.minimum(same, least[apart])
            less[at] = np.where(cut, self.size[a[apart]] < most[at], x[apart] < y[apart])
            todo = todo[~apart]
            common[todo] += self.width
        return common, less

    def search(self, j: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search of benchmark suffixes, cut to ``most`` words: how many training suffixes come before.

        With ``after`` the training suffixes that begin with all of them count as before.
        """
        # By the first words at once; then, where these don't decide, by all.
        key = self.theirs[j]
        spare = np.uint64(self.bits) * np.maximum(self.width - most, 0).astype(np.uint64)
        floor = key >> spare << spare
        low = np.searchsorted(self.ordered, floor, "left")
        high = np.searchsorted(self.ordered, floor | ((np.uint64(1) << spare) - np.uint64(1)), "right")
        with_low, with_high = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
        todo = np.arange(len(j))
        while len(todo := todo[low[todo] < high[todo]]):
            middle = (low[todo] + high[todo]) >> 1
            common, less = self.compare(self.array[middle], j[todo], most[todo], np.minimum(with_low[todo], with_high[todo]))
            if after:
                less |= common == most[todo]
            low[todo[less]] = middle[less] + 1
            with_low[todo[less]] = common[less]
            high[todo[~less]] = middle[~less]
            with_high[todo[~less]] = common[~less]
        return low


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] numbers for each k."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


@dataclass
class Found:
    """Of one document: hit word ranges, items, and the longest match as (words, -first word)."""

    spans: list[tuple[int, int]]
    items: set[str]
    longest: tuple[int, int] = (0, 0)

    def add(self, other: Found, shift: int) -> None:
        self.spans += [(a + shift, b + shift) for a, b in other.spans]
        self.items |= other.items
        if other.longest[0]:
            self.longest = max(self.longest, (other.longest[0], other.longest[1] - shift))


def search_shard(index: BenchmarkIndex, texts: list[np.ndarray]) -> dict[int, Found]:
    """What is found in each text, given as its words' hashes; texts without any word in common are left out."""
    base = np.cumsum([0, *(len(x) + 1 for x in texts)])
    words = np.zeros(base[-1], np.uint32)
    text_of = np.repeat(np.arange(len(texts)), np.diff(base))
    inside = np.ones(len(words), bool)
    inside[base[1:] - 1] = False
    words[inside] = index.number(np.concatenate([np.zeros(0, np.uint64), *texts]))
    if not words.any() or not len(index.order):
        return {}
    m = Matcher(index, words)
    test = index.order
    before = m.search(test, index.size[test])
    found: dict[int, Found] = {}

    # The longest match from each training place: with the last benchmark suffix before it or the first one after it.
    n = len(m.array)
    nth = np.cumsum(np.bincount(before, minlength=n + 1))[:n]
    firsts = np.concatenate(([~np.uint64(0)], index.firsts[test], [~np.uint64(0)]))  # none at either end
    best = np.minimum(m.common(np.minimum(m.ordered ^ firsts[nth], m.ordered ^ firsts[nth + 1])), m.size[m.array])
    far = np.flatnonzero((best == m.width) & (m.size[m.array] > m.width))
    for k in (nth[far] - 1, nth[far]):
        own = (k >= 0) & (k < len(test))
        j = test[k[own]]
        got, _ = m.compare(m.array[far[own]], j, index.size[j], np.zeros(len(j), np.int64))
        best[far[own]] = np.maximum(best[far[own]], got)
    value = np.zeros(len(words), np.int64)
    value[m.array] = np.where(best > 0, best << 32 | (len(words) - m.array), 0)
    for t, x in enumerate(np.maximum.reduceat(value, base[:-1]).tolist()):
        if x:
            found[t] = Found([], set(), (x >> 32, int(base[t]) + (x & 0xFFFFFFFF) - len(words)))

    j = test[index.window[test] > 0]
    long = index.window[j]
    lo, hi = m.search(j, long), m.search(j, long, after=True)
    some = lo < hi
    j, long, lo, hi = j[some], long[some], lo[some], hi[some]
    if not len(j):
        return found
    cover = np.zeros(len(words) + 1, np.int64)
    for size in np.unique(long):
        own = long == size
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, lo[own], 1)
        np.add.at(marks, hi[own], -1)
        where = m.array[np.cumsum(marks[:-1]) > 0]
        cover[where] += 1
        cover[where + size] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    for a, b in edges.reshape(-1, 2):
        t = int(text_of[a])
        found[t].spans.append((int(a - base[t]), int(b - base[t])))

    # Windows of the same words have the same range. Its texts and its items, each once, make the pairs.
    ranges, which = np.unique(np.stack([lo, hi, long], 1), axis=0, return_inverse=True)
    which = which.ravel()
    items = np.unique(np.stack([which, index.item[j]], 1), axis=0)
    first = np.searchsorted(items[:, 0], np.arange(len(ranges) + 1))
    width = ranges[:, 1] - ranges[:, 0]
    rows = np.stack([np.repeat(np.arange(len(ranges)), width), text_of[m.array[_spread(ranges[:, 0], width)]]], 1)
    rows = np.unique(rows, axis=0)
    uses = (first[1:] - first[:-1])[rows[:, 0]]
    group = np.cumsum(uses) // PAIRS
    for g in np.unique(group):
        own = group == g
        pairs = np.stack([np.repeat(rows[own, 1], uses[own]), items[_spread(first[rows[own, 0]], uses[own]), 1]], 1)
        for t, k in np.unique(pairs, axis=0):
            found[int(t)].items.add(index.names[k])
    return found


def hashed_texts(texts: pa.Array, word: np.ndarray = _WORD) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Row, hashes of words, and whether the row ends there; long texts come in several parts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        if b == a + 1 and offsets[b] - offsets[a] > CHUNK_BYTES:
            lo, end = int(offsets[a]), int(offsets[b])
            while lo < end:  # cut before a byte that is in no word
                hi = min(end, lo + CHUNK_BYTES)
                while hi < end and word[_LOWER[data[hi]]]:
                    ahead = np.flatnonzero(~word[_LOWER[data[hi : min(end, hi + CHUNK_BYTES)]]])
                    hi = hi + int(ahead[0]) if len(ahead) else min(end, hi + CHUNK_BYTES)
                yield a, word_hashes(data[lo:hi], np.array([0, hi - lo]), word)[0], hi == end
                lo = hi
        else:
            hashes, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], word)
            for k in range(b - a):
                yield a + k, hashes[at[k] : at[k + 1]], True
        a = b


def _search(blocks: Callable[[], Iterator[BenchmarkIndex]], overlap: int, texts: pa.Array, shard_words: int) -> pa.Array:
    """RESULT for each text; ``overlap``: words of the longest item of any block."""
    n = len(texts)
    n_words = np.zeros(n, np.int64)
    found: dict[int, Found] = {}
    shard: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        for index in blocks():
            for k, own in search_shard(index, [h for _, _, h in shard]).items():
                row, shift, _ = shard[k]
                found.setdefault(row, Found([], set())).add(own, shift)
        shard.clear()

    held, kept, most = 0, np.zeros(0, np.uint64), max(shard_words, 2 * overlap)
    for row, hashes, last in hashed_texts(texts):
        # ``kept`` are a long text's words that its next shard begins with.
        hashes = np.concatenate([kept, hashes]) if len(kept) else hashes
        begin = n_words[row] - len(kept)
        n_words[row] = begin + len(hashes)
        kept = np.zeros(0, np.uint64)
        while len(hashes) > most:
            shard.append((row, int(begin), hashes[:most]))
            flush()
            held = 0
            begin += most - overlap
            hashes = hashes[most - overlap :]
        if last:
            shard.append((row, int(begin), hashes))
            held += len(hashes)
            if held >= shard_words:
                flush()
                held = 0
        else:
            kept = hashes
    flush()
    rows = []
    for t in range(n):
        own = found.get(t)
        spans: list[list[int]] = []
        for a, b in sorted(own.spans) if own else ():
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        longest = own.longest if own else (0, 0)
        rows.append((int(n_words[t]), sum(b - a for a, b in spans), sorted(own.items) if own else [], [{"start": a, "stop": b} for a, b in spans], longest[0], -longest[1] if longest[0] else None))
    names = ["n_words", "n_hit", "items", "spans", "longest", "longest_at"]
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, into: str = "leak",
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column about verbatim benchmark matches, and that column's name.

    The struct holds ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``items`` (ids of items with occurring windows, sorted as strings),
    ``spans`` (covered word ranges, end exclusive; neighbours are one),
    ``longest`` and ``longest_at`` (words and first word of the longest verbatim
    match with any item, the first one of equal length; 0 and null without a
    common word).

    A null or empty text has no words and no hits.  An item that is null, empty
    or without words has no windows; a null id counts as the empty string, and
    rows that repeat an id count as one item.  Repeated documents each get their
    row.  A very long text is searched in shards that overlap by the longest
    item.  An empty table gives an empty result.  The column takes the name
    ``into`` with underscores appended if ``docs`` has such a column; other
    columns pass through untouched.

    No shuffle, and one pass over the texts: the benchmark goes to every
    executor's disk in blocks of about ``block_bytes``.  The driver makes one
    block at a time, and a worker reads one at a time.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 16)).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    sent, overlap = [], 0
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        index = BenchmarkIndex.of([tuple(r) for r in block.collect()], window)  # about block_bytes
        overlap = max(overlap, index.longest)
        # Broadcast as plain values, which executors without this package can read.
        sent.append(docs.sparkSession.sparkContext.broadcast(vars(index)))

    def blocks() -> Iterator[BenchmarkIndex]:
        for part in sent:
            yield BenchmarkIndex(**part.value)
            if len(sent) > 1:
                vars(part).pop("_value", None)  # the next one takes its place

    @F.arrow_udf(RESULT)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _search(blocks, overlap, texts, shard_words)

    name = free_name(docs, into)
    return docs.withColumn(name, match(F.col(text))), name
