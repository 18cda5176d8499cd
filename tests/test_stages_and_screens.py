import glob
import os

import pytest
from pyspark.sql import functions as F

from kmerlens.operators import screens
from kmerlens.plans.stages import Pipeline, StageError, incomplete, published


def test_finished_stages_are_reused(spark, tmp_path):
    made = []

    def build(n):
        return lambda s, done: made.append(n) or s.range(n)

    def run(settings, version="1"):
        p = Pipeline(spark, f"file://{tmp_path}", settings)
        p.run("a", build(3), version=version)
        p.run("b", lambda s, done: made.append("b") or done["a"].withColumn("x", F.col("id") * 2), needs=("a",))
        return p

    assert run({"k": 16}).reused == [] and made == [3, "b"]
    assert run({"k": 16}).reused == ["a", "b"] and made == [3, "b"]
    assert run({"k": 16}, "2").reused == [] and run({"k": 17}).reused == []
    p = Pipeline(spark, f"file://{tmp_path}", {})
    with pytest.raises(StageError):
        p.run("c", build(2), checks=(lambda t: t.where("id = 1"),))
    q = Pipeline(spark, f"file://{tmp_path}", {})
    q.run("c", build(2))
    assert q.reused == []


def test_changed_inputs_run_again(spark, tmp_path):
    shards, made = f"file://{tmp_path}/in", []

    def run(stage=None):
        p = Pipeline(spark, f"file://{tmp_path}/out", {})
        table = p.run("a", stage or (lambda s, _: made.append(1) or s.read.parquet(shards)), reads=(shards,))
        p.run("b", lambda s, done: done["a"].select((F.col("id") + 1).alias("id")), needs=("a",))
        return p.reused, table.count()

    spark.range(3).write.parquet(shards)
    assert run() == ([], 3) and run() == (["a", "b"], 3)
    spark.range(2).write.mode("append").parquet(shards)
    assert run() == ([], 5) and len(made) == 2  # what needs a changed stage runs too
    spark.range(5).write.mode("overwrite").parquet(shards)
    assert run() == ([], 5)

    def meanwhile(s, _):
        s.range(1).write.mode("append").parquet(shards)
        return s.range(9)

    spark.range(7).write.mode("append").parquet(shards)
    with pytest.raises(StageError, match="changed while"):
        run(meanwhile)
    assert run() == ([], 13)


def test_a_killed_writer_leaves_nothing_to_reuse(spark, tmp_path):
    root = f"file://{tmp_path}"

    def run(n):
        p = Pipeline(spark, root, {})
        p.run("a", lambda s, _: s.range(n))
        return p

    run(4)
    [mark] = glob.glob(f"{tmp_path}/a/*/_SUCCESS")
    os.remove(mark)
    os.remove(glob.glob(f"{tmp_path}/a/*/part-*")[0])
    p = run(4)
    assert p.reused == [] and p.done["a"].count() == 4
    # killed while it published: only a temporary folder
    os.makedirs(f"{tmp_path}/published/a/version=1/_temporary/0")
    with pytest.raises(StageError):
        published(spark, root, "a")
    assert p.publish("a") == 1 and p.publish("a") == 1 and published(spark, root, "a").count() == 4


def test_versions_keep_their_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in (4, 6):
        p = Pipeline(spark, root, {"n": n})
        p.run("a", lambda s, _, n=n: s.range(n))
        assert p.publish("a") == n // 2 - 1
    assert [published(spark, root, "a", v).count() for v in (1, 2, None)] == [4, 6, 6]
    with pytest.raises(StageError, match="not published"):
        published(spark, root, "a", 3)
    spark.range(50).write.mode("append").parquet(f"{root}/a/{p.prints['a']}")  # not of any version
    assert published(spark, root, "a").count() == 6 and incomplete(spark, root, "a", 2).isEmpty()
    lost = spark.read.parquet(f"{root}/published/a/version=2").first()["path"]
    os.remove(lost.removeprefix("file:"))
    with pytest.raises(StageError, match="not whole"):
        published(spark, root, "a", 2)
    assert published(spark, root, "a", 1).count() == 4


def test_dispatch_and_radius(spark):
    rows = [(1, "pan_HSat2", d) for d in range(3)] + [(2, "chromosome_3", d) for d in range(3)] + [(3, "9_G2_specific", d) for d in range(3)]
    df = spark.createDataFrame(rows, "query long, category string, d int")
    pan = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query long, d int")
    chrom = spark.createDataFrame([(2, 0, 3), (2, 2, 3), (2, 1, 4)], "query long, d int, chrom int")
    df = df.unionByName(spark.createDataFrame([(4, "9_G2_enriched", d) for d in range(3)] + [(5, "8_G2_specific", d) for d in range(3)], df.schema))
    group = spark.createDataFrame([(q, d, 9, "G2", True, q == 3 or d == 0) for q in (3, 4, 5) for d in range(3)] + [(1, 2, 9, "G2", True, True), (3, 2, 9, "G1", False, False)], "query long, d int, chrom int, grp string, enriched boolean, specific boolean")
    got = screens.dispatch(df, pan, chrom, group)
    assert {r["query"]: r["radius"] for r in screens.largest_radius(got, ["query"]).collect()} == {1: 1, 2: 0, 3: 2, 4: 2, 5: None}


def test_undefined_fails(spark):
    df = spark.createDataFrame([(1.0, 11.0, 11.0, 5), (None, 11.0, 11.0, 5), (1.0, 11.0, 10.0, 5), (1.0, 11.0, 11.0, 4)], "s double, f double, b double, h int")
    rule = screens.strict(F.col("s"), F.col("f"), F.col("b"), F.col("h"), 5)
    assert [r[0] for r in df.select(rule).collect()] == [True, False, False, False]
    flags = screens.funnel(df, {"x": F.col("s") > 0, "y": F.col("h") == 5})
    assert {r["step"]: r["kmers"] for r in screens.funnel_counts(flags, ["x", "y"]).collect()} == {"x": 3, "y": 2}


def test_audit_reads_its_counts_once(spark):
    """All checks of the counts read one table of them; only the totals by code go back to the source."""
    from kmerlens.plans import count_queries

    files = count_queries.audit_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [str(files.apply(i).relation().location().rootPaths().mkString()) for i in range(files.size())]
    assert sum("lineitem" in f for f in files) == 1
