import random

from kmerlens.operators import audit, intervals
from kmerlens.plans import interval_queries


def frame(spark, rows, label=None):
    schema = "chromosome long, start long, end long" + (", label string" if label else "")
    return spark.createDataFrame([(0, a, b, *label) for a, b in rows] if label else [(0, a, b) for a, b in rows], schema)


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_literal(spark):
    a, b = frame(spark, [(2, 10), (8, 20), (20, 22)]), frame(spark, [(18, 30)])
    merged = intervals.merge(a)
    lengths = spark.createDataFrame([(0, 40)], "chromosome long, length long")
    assert spans(merged) == [(2, 22)]
    assert spans(intervals.intersect(merged, b)) == [(18, 22)]
    assert spans(intervals.subtract(merged, b)) == [(2, 18)]
    assert spans(intervals.complement(intervals.merge(a.unionByName(b)), lengths)) == [(0, 2), (30, 40)]


def test_complement_without_intervals(spark):
    none = frame(spark, [])
    lengths = spark.createDataFrame([(0, 7), (1, 0)], "chromosome long, length long")
    assert spans(intervals.complement(none, lengths)) == [(0, 7)]


def test_random_sets_of_bases(spark):
    rng = random.Random(3)
    for width in (3, 16, 1000):
        a = [(s := rng.randrange(150), s + rng.randrange(1, 30)) for _ in range(12)]
        b = [(s := rng.randrange(150), s + rng.randrange(1, 30)) for _ in range(12)]
        rows = frame(spark, a, ["HSat2"]).unionByName(frame(spark, b, ["HSat3"]))
        lengths = spark.createDataFrame([(0, 200)], "chromosome long, length long")
        parts = intervals.region_partition(rows, lengths, width=width)
        bases = {}
        for r in parts.collect():
            bases.setdefault(r["region"], set()).update(range(r["start"], r["end"]))
        sa = {x for s, e in a for x in range(s, e)}
        sb = {x for s, e in b for x in range(s, e)}
        assert bases.get("HSat2", set()) == sa - sb and bases.get("HSat3", set()) == sb - sa
        assert bases.get("ambiguous", set()) == sa & sb and bases["HSat23"] == sa | sb
        assert bases["background"] == set(range(200)) - sa - sb
        assert audit.partition_identity(parts, lengths, ["chromosome"]).isEmpty()
        hits = [(i, s := rng.randrange(180), s + 5) for i in range(40)]
        h = spark.createDataFrame([(0, *x) for x in hits], "chromosome long, id long, start long, end long")
        want = sorted(i for i, s, e in hits if any(x <= s and e <= y for x, y in a))
        assert sorted(r["id"] for r in intervals.inside(h, frame(spark, a), width=width).collect()) == want
        pairs = intervals.overlap_join(frame(spark, a), frame(spark, b), width=width).count()
        assert pairs == sum(s < y and x < e for s, e in a for x, y in b)
        labels = {r["id"]: r["label"] for r in intervals.priority_label(h, rows, ("HSat3", "HSat2"), "id", width=width).collect()}
        assert labels == {i: next((n for n, v in (("HSat3", b), ("HSat2", a)) if any(x <= s and e <= y for x, y in v)), "outside") for i, s, e in hits}


def test_scans_over_many_bins(spark):
    rng = random.Random(4)
    rows = [(k, s := rng.randrange(400), s + rng.randrange(1, 60 if rng.random() < 0.1 else 6)) for k in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "chromosome long, start long, end long")
    want = {k: sorted(set().union(*({*range(s, e)} for c, s, e in rows if c == k))) for k in (0, 1)}
    ends = {(k, s): max(e for c, x, e in rows if (c, x) == (k, s)) for k, s, _ in rows}
    hits = [(i % 2, i, rng.randrange(500)) for i in range(80)]
    h = spark.createDataFrame([(k, i, s, s + 3) for k, i, s in hits], "chromosome long, id long, start long, end long")
    for width in (1, 7, 64, 10**6):
        got = sorted(map(tuple, intervals.merge(df, width=width).collect()))
        assert [(k, x) for k, s, e in got for x in range(s, e)] == [(k, x) for k in (0, 1) for x in want[k]]
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:], strict=False))
        found = {r["id"]: (r["i_start"], r["i_end"]) for r in intervals.asof(h, df, width=width).collect()}
        for k, i, s in hits:
            at = max((x for c, x in ends if c == k and x <= s), default=None)
            assert found[i] == (at, ends.get((k, at)))


def test_asof(spark):
    i = frame(spark, [(5, 9), (5, 20), (30, 31)])
    h = spark.createDataFrame([(0, 4, 6), (0, 5, 7), (0, 29, 33), (1, 5, 6)], "chromosome long, start long, end long")
    got = {(r["chromosome"], r["start"]): (r["i_start"], r["i_end"]) for r in intervals.asof(h, i).collect()}
    assert got == {(0, 4): (None, None), (0, 5): (5, 20), (0, 29): (5, 20), (1, 5): (None, None)}


def test_partition_of_overhanging_and_touching_intervals(spark):
    """Families on axes without a length, beyond its ends or side by side stay whole; the background does not."""
    rows = spark.createDataFrame([(0, -5, 3, "HSat2"), (0, 3, 6, "HSat3"), (0, 6, 9, "HSat3"), (0, 30, 50, "HSat3"), (2, 1, 4, "HSat2")], "chromosome long, start long, end long, label string")
    lengths = spark.createDataFrame([(0, 40), (1, 7), (3, 0), (4, None)], "chromosome long, length long")
    want = [(0, "HSat2", -5, 3), (0, "HSat23", -5, 9), (0, "HSat23", 30, 50), (0, "HSat3", 3, 9), (0, "HSat3", 30, 50), (0, "background", 9, 30), (1, "background", 0, 7), (2, "HSat2", 1, 4), (2, "HSat23", 1, 4)]
    for width in (1, 4, 1000):
        assert sorted(map(tuple, intervals.region_partition(rows, lengths, width=width).collect())) == want


def test_sets_differ_counts_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "i long, s string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z")], "i long, s string")
    assert sorted(map(tuple, audit.sets_differ(a, b).collect()), key=str) == [(1, "x"), (1, "x"), (2, None), (3, "z"), (4, "z")]
    assert audit.sets_differ(a, a).isEmpty()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_differ_reads_each_table_once(spark):
    a = spark.range(3).withColumnRenamed("id", "i")
    assert _plan(audit.sets_differ(a, spark.range(5).withColumnRenamed("id", "i"))).count("Range (0, 3") == 1


def test_interval_audit_reads_annotation_once(spark, monkeypatch):
    calls, read = [], interval_queries.fx.intervals
    monkeypatch.setattr(interval_queries.fx, "intervals", lambda *a: calls.append(1) or read(*a))
    got = interval_queries.audit_intervals(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and "lineitem" not in str(got.inputFiles())
    assert {r["check"]: r["violations"] for r in got.collect()} == {"partition": 0, "overlay_sums": 0, "containment_agrees": 0}


def test_interval_audit_tells_broken_partitions(spark, monkeypatch):
    """A partition that loses its background is told, so the shared tables hide nothing."""
    whole = intervals.partition_merged
    monkeypatch.setattr(intervals, "partition_merged", lambda *a, **k: whole(*a, **k).where("region <> 'background'"))
    got = {r["check"]: r["violations"] for r in interval_queries.audit_intervals(spark, "/root/testdata/sf0.001").collect()}
    assert got["partition"] > 0 and got["overlay_sums"] == got["containment_agrees"] == 0
