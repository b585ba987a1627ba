"""Language identification by error-correcting output codes.

Each language has a codeword.  For every bit of the code a binary classifier
over hashed byte n-grams tells the languages with a 1 from those with a 0: its
weights are log odds of the n-grams, its answer their mean over the whole text.
Decoding adds up each codeword's losses, weighted by how far a bit's classifier
keeps the languages of its training texts from the wrong side, and takes the
codeword with the least; a small lead over the next one flags the document as
ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Labelled documents that the classifiers are fitted on, about; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Hashed n-grams of bytes, of each length in ORDERS.
FEATURES = 1 << 15
ORDERS = (2, 3, 4)
#: Bits of the code for more languages than an exhaustive code allows.
LONG_CODE = 63
EXHAUSTIVE = 6
#: Leads of the best codeword's share below this are ambiguous.
AMBIGUOUS = 0.05
#: Text bytes whose n-grams are held at once.
CHUNK_BYTES = 1 << 18
#: Labelled documents, about, whose losses tell how large a loss is too large; and the share of them that is taken as typical.
BOUND_ROWS, TYPICAL = 4_000, 0.999
UNDETERMINED = "und"

RESULT = "struct<lang_pred: string, score: double, ambiguous: boolean>"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def codewords(n: int) -> np.ndarray:
    """A row of bits per class: all splits in two for few classes, else random splits at a fixed seed."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))  # the last class has a 0 throughout
        return np.array([(splits >> k) & 1 for k in range(n)], np.int8)
    random = np.random.default_rng(n)
    best, distance = None, -1
    for _ in range(64):
        code = random.integers(0, 2, (n, LONG_CODE)).astype(np.int8)
        code[random.integers(0, n, LONG_CODE), np.arange(LONG_CODE)] ^= 1
        apart = (code[:, None] != code[None]).sum(2) + LONG_CODE * np.eye(n, dtype=int)
        if apart.min() > distance and (code.min(0) != code.max(0)).all():
            best, distance = code, apart.min()
    return best


def _lowered() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    low[:65] = low[91:97] = low[123:128] = 32  # what isn't a letter separates, all alike
    return low


_LOWER = _lowered()


def _features(data: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram that starts at each byte but the last ones."""
    x = _LOWER[data].astype(np.uint32)
    n = len(x) - order + 1
    h = np.zeros(max(n, 0), np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) + x[k : k + n]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes and starts of runs of texts, and how many bytes n-grams may begin at.

    A long text is cut into runs that name the same row; each ends with the
    first bytes of the next one, in which none of its n-grams begins.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        lo, hi = offsets[a], offsets[b]
        if b == a + 1 and hi - lo > CHUNK_BYTES:
            for at in range(lo, hi, CHUNK_BYTES):
                stop = min(hi, at + CHUNK_BYTES + max(ORDERS) - 1)
                yield a, data[at:stop], np.array([0, stop - at]), CHUNK_BYTES
        else:
            yield a, data[lo:hi], offsets[a : b + 1] - lo, hi - lo
        a = b


def _inside(starts: np.ndarray, order: int, n: int) -> np.ndarray:
    """Whether the n-gram at each byte ends in the text it begins in."""
    ok = np.ones(max(n, 0), bool)
    for k in range(1, order):
        at = starts[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def mean_answers(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text the mean over its n-grams of each classifier's weight. weights: orders x features x bits."""
    total = np.zeros((len(texts), weights.shape[2]))
    count = np.zeros(len(texts))
    for row, data, starts, limit in _chunks(texts):
        m = len(starts) - 1
        for k, order in enumerate(ORDERS):
            h = _features(data, order)[:limit]
            ok = _inside(starts, order, len(h))
            own = np.minimum(starts, len(h))
            kept = np.concatenate(([0], np.cumsum(ok)))[own]
            count[row : row + m] += np.diff(kept)
            h = h[ok]
            full = np.diff(kept) > 0
            if len(h):
                for bit in range(weights.shape[2]):
                    sums = np.add.reduceat(weights[k, :, bit][h], kept[:-1][full], dtype=np.float64)
                    total[row : row + m, bit][full] += sums
    return total / np.maximum(count, 1)[:, None]


@dataclass
class LanguageModel:
    """What :func:`fit` learned: languages, their codewords, the bits' weights and reliabilities."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    reliability: np.ndarray

    def losses(self, answers: np.ndarray) -> np.ndarray:
        """Documents x languages: the weighted logistic loss of each codeword."""
        margin = answers / self.scale
        sign = 2 * self.code.astype(float) - 1
        each = np.logaddexp(0, -margin[:, None, :] * sign[None])
        return (each * self.reliability).sum(2) / max(self.reliability.sum(), 1e-9)

    def predict(self, texts: pa.Array, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the language's number (-1 with share 0: all lose more than the bound), its share, and whether its lead is small."""
        losses = self.losses(mean_answers(texts, self.weights))
        if losses.shape[1] == 0:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
        odds = np.exp(-4 * (losses - losses.min(1, keepdims=True)))
        share = odds / odds.sum(1, keepdims=True)
        best = losses.argmin(1)
        top = share[np.arange(len(best)), best]
        share[np.arange(len(best)), best] = 0
        lost = losses.min(1) > bound
        return np.where(lost, -1, best), np.where(lost, 0, np.clip(top, 0, 1)), lost | (top - share.max(1) < AMBIGUOUS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language of all texts in a partition, each text weighing the same."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in batch["lang"].unique().to_pylist():
            own = batch.filter(pa.compute.equal(batch["lang"], lang))
            into = sums.setdefault(lang, np.zeros((len(ORDERS), FEATURES)))
            for text in own["text"]:
                one = np.zeros_like(into)
                for _, data, _, limit in _chunks(pa.array([text.as_py()], pa.string())):
                    for k, order in enumerate(ORDERS):
                        one[k] += np.bincount(_features(data, order)[:limit], minlength=FEATURES)
                into += one / max(1.0, one.sum())
    for lang, own in sums.items():
        order, feature = np.nonzero(own)
        at = order * FEATURES + feature
        yield pa.record_batch({"lang": [lang] * len(at), "at": pa.array(at, pa.int64()), "n": own[order, feature]})


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Classifiers from about ``sample_rows`` labelled documents that aren't held out.

    Rows with a null label or text don't count.  The driver gets one row per
    language and n-gram, so it is bounded by languages times n-grams.
    """
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = labelled.select("lang").count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = labelled.filter("text is not null")
    if n > sample_rows:
        sample = sample.filter(place < int((1 << 30) * sample_rows / n))
    counted = sample.select("lang", "text").mapInArrow(_counts, "lang string, at bigint, n double")
    counted = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    share = np.zeros((len(languages), len(ORDERS) * FEATURES))
    share[[number[x] for x in counted["lang"].to_pylist()], counted["at"].to_numpy()] = counted["n"].to_numpy()
    share = share.reshape(len(languages), len(ORDERS), FEATURES)
    share /= np.maximum(share.sum(2, keepdims=True), 1e-12)
    share = 0.98 * share + 0.02 / FEATURES
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.zeros((len(ORDERS), FEATURES, bits), np.float32)
    spread, right = np.ones(bits), np.ones(bits)
    for bit in range(bits):
        one = code[:, bit] == 1
        if one.any() and (~one).any():
            weights[:, :, bit] = np.log(share[one].mean(0) / share[~one].mean(0))
            # What a typical text of each language answers, and how far the nearest one is from the wrong side.
            answers = (share * weights[None, :, :, bit]).sum(2).mean(1)
            signed = np.where(one, answers, -answers)
            spread[bit] = max(np.abs(answers).mean() / 2, 1e-6)
            right[bit] = max(signed.min() / spread[bit], 0.05)
    return LanguageModel(languages, code, weights, spread, right)


def loss_bound(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = BOUND_ROWS) -> float:
    """The least loss that speaks for no learned language at all.

    Classifiers that know nothing of a text answer zero, a loss of log 2 for
    every codeword.  The bound is midway between that and what about
    ``sample_rows`` labelled texts with a letter lose, or even mixes of two
    languages in equal parts.  No bound without such texts, or with fewer than two languages.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}") & ~held_out(F.col(doc_id)))
    n = labelled.count()
    if n == 0 or len(model.languages) < 2:
        return np.inf
    if n > sample_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64(doc_id, F.lit("bound")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    parts = docs.sparkSession.sparkContext.broadcast(vars(model))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**parts.value)
        for batch in batches:
            each = mean_answers(batch["text"], own.weights)
            yield pa.record_batch({"lang": batch["lang"], "answers": pa.array(each.tolist(), pa.list_(pa.float64()))})

    found = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(answers, "lang string, answers array<double>").toArrow()
    if not len(found):
        return np.inf
    each, of = np.array(found["answers"].to_pylist()), np.array(found["lang"].to_pylist())
    typical = np.quantile(model.losses(each).min(1), TYPICAL)
    means = [each[of == x].mean(0) for x in sorted(set(of))]
    mixes = [(a + b) / 2 for k, a in enumerate(means) for b in means[:k]]
    if mixes:
        typical = max(typical, model.losses(np.array(mixes)).min(1).max())
    return float((typical + np.log(2)) / 2) if typical < np.log(2) else np.inf


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", into: str = "language", bound: float = np.inf) -> tuple[DataFrame, str]:
    """``docs`` with a struct column ``lang_pred, score, ambiguous``, and that column's name.

    ``und`` with score 0 where the text is null or has no letter, where no
    language was learned, or where every codeword loses more than ``bound``.  Only the text is read.  No shuffle: the model, of a
    size fixed by n-grams and code, is broadcast.  Repeated rows each keep a
    row; the column gets another name if ``docs`` has one like it.
    """
    # Broadcast as plain values, which executors without this package can read.
    parts = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = LanguageModel(**parts.value)
        names = np.array([*own.languages, UNDETERMINED], object)
        for texts in batches:
            best, score, close = own.predict(texts, bound)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(close)], ["lang_pred", "score", "ambiguous"])

    name = free_name(docs, into)
    raw = free_name(docs, name + "_raw")
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return docs.withColumn(raw, predict(F.col(text))).withColumn(name, F.when(lettered, F.col(raw)).otherwise(none)).drop(raw), name
