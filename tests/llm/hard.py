"""Documents that operators must get through, and the plain words that brute-force versions use."""

import random
import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Columns that an operator might be tempted to name its own.
    *[T.StructField(n, T.StringType()) for n in ("key", "row", "kept", "words", "spans", "size", "leak", "mix", "language", "simhash", "bucket", "shard", "at", "found", "row_key", "component_id")],
])


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "tu", "mé", "so"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts():
    rng = random.Random(5)
    plain = ["\n".join(sentence(rng, rng.randint(3, 30)).capitalize() + "." for _ in range(rng.randint(1, 12))) for _ in range(24)]
    near = [plain[0] + " tail", plain[1].replace("ba", "ri", 1), plain[2].upper(), "\n".join(plain[3].split("\n")[::-1])]
    odd = [None, "", " ", "\n\n", "a", "É", "\x00", "??? !!!", "😀 smile 😀", "\t tabs\x0b\x0c\r", "x" * 3000, "word " * 40_000, "İstanbul ß ſ K"]
    return plain + near + odd


def rows():
    """(doc_id, text, lang, source, n_chars): texts above, ids with gaps, ties and nulls, and repeated rows."""
    out = [(i * 3 - 20, t, ["en", "fr", None][i % 3], ["b", "a", None, "é"][i % 4], i) for i, t in enumerate(texts())]
    out += [out[0], out[0], (out[1][0], "another text for a used id", "en", "a", 1), (None, "text of no id", "en", None, None), (None, None, None, None, None)]
    out += [(1000 + i, "copied text of many rows", "en", "b", 3) for i in range(60)]
    return out


def docs(spark):
    return spark.createDataFrame([(*r, *["clash"] * 16) for r in rows()], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
