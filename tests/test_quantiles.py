"""Exact quantiles by rounds of histograms against numpy, and shards that are split and replaced."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlens.operators.quantiles import quantiles
from kmerlens.streaming import shards

AT = {"least": 0.0, "tenth": 0.1, "third": 1 / 3, "median": 0.5, "high": 0.99, "greatest": 1.0}


def plain(values):
    values = np.sort(np.asarray(values, float))
    out = []
    for q in AT.values():
        x = q * (len(values) - 1)
        a, b = values[math.floor(x)], values[math.ceil(x)]
        out.append(a if a == b else a * (math.ceil(x) - x) + b * (x - math.floor(x)))
    return out


@pytest.mark.parametrize("bins, small", [(4, 3), (16, 1), (4096, 65536)])
def test_quantiles(spark, bins, small):
    rng = np.random.default_rng(5)
    groups = {
        "spread": rng.normal(0, 3, 400),
        "ties": rng.integers(0, 4, 300),
        "powers": np.concatenate([10.0 ** rng.integers(-20, 20, 60), -(10.0 ** rng.integers(-20, 20, 60))]),
        "extreme": [-1.7e308, 1.7e308, 5e-324, 0.0, -0.0],
        "infinite": [float("-inf"), float("inf"), 1.0, 2.0, float("inf")],
        "one": [7.0],
        None: [1.0, 2.0],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None), ("one", float("nan")), ("nothing", None)]
    got = {r[0]: r[1:] for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", AT, bins=bins, small=small).collect()}
    assert set(got) == {*groups, "nothing"} and got["nothing"] == (None,) * len(AT)
    for g, values in groups.items():
        assert got[g] == pytest.approx(plain(values), rel=1e-12, nan_ok=True), g


def test_weighted_quantiles_and_one_group(spark):
    rows = [(5.0, 3), (1.0, 997), (9.0, 0), (8.0, None), (2.0, 500)]
    df = spark.createDataFrame(rows, "v double, n long")
    got = quantiles(df, [], "v", AT, weight="n", bins=2, small=1).collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(plain([5.0] * 3 + [1.0] * 997 + [2.0] * 500)))]
    assert quantiles(df.withColumn("g", F.lit(1)).limit(0), ["g"], "v", AT).collect() == []
    assert [tuple(r) for r in quantiles(df.limit(0), [], "v", AT).collect()] == [(None,) * len(AT)]


def _pool(spark, out):
    return {(r["region"], r["code"]): (r["pooled"], r["haps"], r["largest"]) for r in shards.pooled(spark, out).collect()}


def test_shards_split_repeated_and_replaced(spark, tmp_path):
    rows, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def take(*new, every=100):
        spark.createDataFrame([(h, "c", "r", 0, code, n, s, v) for h, s, v, code, n in new], shards.SHARDS).write.mode("append").parquet(rows)
        shards.maintain(spark, rows, out, mark, "ref", compact_every=every).awaitTermination()
        return _pool(spark, out)

    assert take(("a", "1", 1, 5, 10), ("ref", "1", 1, 5, 99)) == {("r", 5): (10, 1, 10)}
    # another shard of the same hap in another batch: one hap, with the sum of both
    assert take(("a", "2", 1, 5, 4), ("b", "1", 1, 5, 3)) == {("r", 5): (17, 2, 14)}
    # the same rows again
    assert take(("a", "1", 1, 5, 10)) == {("r", 5): (17, 2, 14)}
    # a newer version without k-mer 5 takes the largest count back
    assert take(("a", "1", 2, 6, 1)) == {("r", 5): (7, 2, 4), ("r", 6): (1, 1, 1)}
    # an older one that comes late changes nothing; then everything is compacted
    assert take(("a", "1", 1, 5, 10), every=1) == {("r", 5): (7, 2, 4), ("r", 6): (1, 1, 1)}
    assert shards.through(spark, out) == 4 and spark.read.parquet(f"{out}/base/through=4").count() == 3
    # an empty version after the base
    assert take(("b", "1", 7, None, 0)) == {("r", 5): (4, 1, 4), ("r", 6): (1, 1, 1)}
    assert shards.compact(spark, out) == 5 and _pool(spark, out) == {("r", 5): (4, 1, 4), ("r", 6): (1, 1, 1)}
    assert shards.compact(spark, out) == 5


def test_base_without_its_mark_is_not_read(spark, tmp_path):
    rows, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("a", "c", "r", 0, 5, 10, None, None)], shards.SHARDS).write.parquet(rows)
    shards.maintain(spark, rows, out, mark, "ref").awaitTermination()
    # as a writer leaves it that ended between the base and its mark
    spark.read.parquet(f"{out}/deltas/batch=0").limit(0).write.parquet(f"{out}/base/through=0")
    assert _pool(spark, out) == {("r", 5): (10, 1, 10)}
    assert shards.compact(spark, out) == 0 and _pool(spark, out) == {("r", 5): (10, 1, 10)}


def test_no_shards_yet(spark, tmp_path):
    assert _pool(spark, str(tmp_path / "none")) == {} and shards.compact(spark, str(tmp_path / "none")) == -1
