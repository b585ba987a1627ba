import pytest
from pyspark.sql import functions as F

from tallyfold.llm import mixing

from . import hard


def targets(sizes, weights=(5, 2, 1)):
    """Water-filling, one source at its limit after another."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            open_.discard(s)
    return out


def test_sizes_and_targets(spark):
    out, m = mixing.mix(hard.docs(spark))
    rows = out.select("doc_id", "source", "text", f"{m}.*").collect()
    assert len(rows) == len(hard.rows())
    sizes, own = {}, {}
    for r in rows:
        assert r["size"] == len(hard.SPACED.findall(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        own[r["source"]] = (r["source_size"], r["target"])
    want = targets(sizes)
    for s, n in sizes.items():
        assert own[s][0] == n and own[s][1] == pytest.approx(want[s])


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(4))).alias("source"))
    runs = []
    for parts in (3, 7):
        out, m = mixing.mix(docs.repartition(parts))
        runs.append({r["doc_id"]: r for r in out.select("doc_id", "source", f"{m}.*").collect()})
    assert {k: r["copies"] for k, r in runs[0].items()} == {k: r["copies"] for k, r in runs[1].items()}
    taken, aim = {}, {}
    for r in runs[0].values():
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        aim[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - aim[s]) <= 16


def test_larger_budgets_take_more(spark):
    hashed = spark.range(5000).select(F.lit("s").alias("source"), (F.col("id") % 5).alias("size"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h"))
    below = [mixing.thresholds(hashed, spark.createDataFrame([("s", float(b))], "source string, rest double")).first()["below"] for b in (0, 10, 500, 5000, 9999, 10_000)]
    assert below == sorted(below)
    for b, x in zip((0, 10, 500, 5000, 9999), below, strict=False):
        assert abs((hashed.filter(F.col("h") < x).agg(F.sum("size")).first()[0] or 0) - b) <= 4


def test_edges(spark):
    out, m = mixing.mix(hard.empty(spark))
    assert out.count() == 0
    assert mixing.mixed(hard.docs(spark)).columns == hard.docs(spark).columns
    none, m = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string"))
    assert {(r["size"], r["target"]) for r in none.select(f"{m}.*").collect()} == {(0, 0.0)}
