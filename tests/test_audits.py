"""Audits over sequences: each check works on what is written or shuffled once, and still tells what is broken."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerlens.functions import kmer as K
from kmerlens.operators import audit, counting
from kmerlens.plans import ranking_queries, report_queries, sequence_queries

SF = "/root/testdata/sf0.001"
COMP = str.maketrans("ACGT", "TGCA")


def canonical_windows(seq, k):
    found = (seq[i : i + k] for i in range(len(seq or "") - k + 1))
    return Counter(min(w, w[::-1].translate(COMP)) for w in found if not set(w) - set("ACGT"))


@pytest.mark.parametrize(("hold", "segment"), [(1 << 22, 1 << 20), (60, 40)])
def test_counted_twice_against_loops(spark, monkeypatch, hold, segment):
    """Sums by key, and what the union was counted more or less often than its parts, whatever is held at once."""
    monkeypatch.setattr(counting, "HOLD", hold)
    monkeypatch.setattr(counting, "SEGMENT", segment)
    rng, k = random.Random(5), 4
    rows = [(rng.choice(["x", "y", None]), rng.choice(["a", "b", "c", None]), "".join(rng.choice("ACGTN\n" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randrange(90)))) for _ in range(40)]
    rows += [("z", "a", None), ("z", "a", ""), (None, "b", "ACG")]
    df = spark.createDataFrame(rows, "hap string, region string, seq string").coalesce(1)
    got = counting.counted_twice(df, ["hap"], F.col("region").isin("a", "c"), F.col("region").isin("a", "b"), k)
    totals, net = Counter(), Counter()
    for hap, region, seq in rows:
        counts = canonical_windows(seq, k)
        totals[hap, region] += sum(counts.values())
        for w, n in counts.items():
            net[hap, w] += n * ((region in ("a", "c")) - (region in ("a", "b")))
    sums = got.where("code is null").groupBy("hap", "region").agg(F.sum("n").alias("n")).collect()
    assert {(r["hap"], r["region"]): r["n"] for r in sums} == {key: n for key, n in totals.items() if n}
    more = got.where("code is not null").withColumn("kmer", K.decode(F.col("code"), k))
    found = {(r["hap"], r["kmer"]): r["n"] for r in more.groupBy("hap", "kmer").agg(F.sum("net").alias("n")).where("n <> 0").collect()}
    assert found == {key: n for key, n in net.items() if n}
    below = {(r["hap"], r["code"]) for r in audit.below_zero(got.where("code is not null"), ["hap", "code"]).collect()}
    assert len(below) == sum(n < 0 for n in net.values()) > 0
    # what agrees is not given on
    same = counting.counted_twice(df, ["hap"], F.col("region").isin("a", "b"), F.col("region").isin("a", "b"), k)
    assert same.where("code is not null").isEmpty()


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 9, 16, 17, 24, 31])
def test_windows_of_every_length(spark, k):
    rng = random.Random(k)
    rows = [(i, "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(rng.randrange(3 * k + 9)))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = Counter()
    for r in counting.windows(df, k, ["id"]).withColumn("kmer", K.decode(F.col("code"), k)).collect():
        got[r["id"], r["kmer"]] += r["n"]
    assert got == Counter({(i, w): n for i, seq in rows for w, n in canonical_windows(seq, k).items()})


def test_sequence_audit_makes_the_sequences_once(spark, monkeypatch):
    calls, read = [], sequence_queries.fx.sequences
    monkeypatch.setattr(sequence_queries.fx, "sequences", lambda *a: calls.append(1) or read(*a))
    got = sequence_queries.audit_sequences(spark, SF)
    assert len(calls) == 1 and "documents" not in str(got.inputFiles())
    assert {r["check"]: r["violations"] for r in got.collect()} == dict.fromkeys(("stats_bounds", "counts_match_starts", "distance_zero", "position_weights", "scan_matches_counts", "union_covers_parts"), 0)


def test_sequence_audit_tells_lost_windows(spark, monkeypatch):
    whole = counting.counted_twice
    monkeypatch.setattr(counting, "counted_twice", lambda df, by, union, part: whole(df.where("chrom <> 2"), by, union & (F.col("hap") != "src1"), part))
    got = {r["check"]: r["violations"] for r in sequence_queries.audit_sequences(spark, SF).collect()}
    assert got["counts_match_starts"] > 0 and got["union_covers_parts"] > 0 and got["distance_zero"] == got["stats_bounds"] == 0


@pytest.mark.parametrize(("k", "segment"), [(6, 1 << 20), (6, 40), (16, 1 << 20), (19, 50)])
def test_near_against_loops(spark, monkeypatch, k, segment):
    monkeypatch.setattr(counting, "SEGMENT", segment)
    rng = random.Random(6)
    asked = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(3)]

    def text():
        parts = [list(rng.choice(asked + [a[::-1].translate(COMP) for a in asked])) for _ in range(rng.randrange(6))]
        for p in parts:
            for _ in range(rng.randrange(4)):
                p[rng.randrange(k)] = rng.choice("ACGTN")
        return "".join("".join(p) + rng.choice(["", "A", "CG\n"]) for p in parts)

    rows = [(rng.choice(["x", None]), text()) for _ in range(30)] + [("x", None), ("x", "")]
    df = spark.createDataFrame(rows, "hap string, seq string")
    codes = {int(a.translate(str.maketrans("ACGT", "0123")), 4): a for a in asked}
    want = Counter()
    for hap, seq in rows:
        for w, n in canonical_windows(seq, k).items():
            for code, a in codes.items():
                d = min(sum(x != y for x, y in zip(a, v, strict=True)) for v in (w, w[::-1].translate(COMP)))
                if d <= 2:
                    want[code, hap, d] += n
    assert {(r["query"], r["hap"], r["d"]): r["n"] for r in counting.near(df, list(codes), k, ["hap"]).collect()} == want


def test_screen_audit_shuffles_no_windows(spark, monkeypatch):
    """The spectra of the haps are not made: their windows are held against the queries where they are encoded."""
    calls, read = [], report_queries.fx.sequences
    monkeypatch.setattr(report_queries.fx, "sequences", lambda *a: calls.append(1) or read(*a))
    monkeypatch.setattr(ranking_queries, "cluster_cases", lambda spark, sf: spark.createDataFrame([], "region string, chrom long, hap string, grp string, k int, silhouette double, status string"))
    got = report_queries.audit_screens(spark, SF)
    assert len(calls) == 1 and "documents" not in str(got.inputFiles())
    assert "code" not in str([line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "hap" in line])
    assert {r["check"]: r["violations"] for r in got.collect()} == dict.fromkeys(("neighbourhoods", "variant_sums", "plain_scan_agrees", "clusters"), 0)
    whole = counting.near
    monkeypatch.setattr(counting, "near", lambda *a, **k: whole(*a, **k).where("d <> 1 or region <> 'background'"))
    lost = {r["check"]: r["violations"] for r in report_queries.audit_screens(spark, SF).collect()}
    assert lost.pop("variant_sums") > 0 and not any(lost.values())


def test_profiles_count_lineitem_once(spark, monkeypatch):
    calls, read = [], ranking_queries.fx.counts
    monkeypatch.setattr(ranking_queries.fx, "counts", lambda *a: calls.append(1) or read(*a))
    rows = ranking_queries._profiles(spark, SF)
    assert len(calls) == 1 and "lineitem" not in str(rows.inputFiles())


class Asked(dict):
    """Counts how often a key is looked up."""

    asked = 0

    def setdefault(self, *a):
        self.asked += 1
        return super().setdefault(*a)


@pytest.mark.parametrize("most", [4, 10**6])
def test_rows_are_numbered_by_their_keys(most):
    """Keys are looked up once for each that occurs in a batch, not for each row."""
    rng = random.Random(7)
    known, want = Asked(), {}
    for size in (5000, 1, 3000, 0):
        rows = [(rng.choice(["x", "y", None, ""]), rng.randrange(most) if rng.random() < 0.9 else None, rng.random() < 0.5) for _ in range(size)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
        before = known.asked
        got = counting._numbered(columns, size, known).tolist()
        assert known.asked - before == len(set(rows))
        assert all(want.setdefault(r, i) == i for r, i in zip(rows, got, strict=True))
    assert len(set(want.values())) == len(want) == len(known)
    assert counting._numbered([], 3, {}).tolist() == [0, 0, 0]


@pytest.mark.parametrize("most", [1, 500, 1 << 40])
def test_counts_stay_beside_their_keys(most):
    rng = np.random.default_rng(8)
    key = rng.integers(0, 50, 2000).astype(np.uint64) << np.uint64(30) | rng.integers(0, 9, 2000).astype(np.uint64)
    n = rng.integers(0, most + 1, 2000)
    a, b = counting._in_order(key, n, 40)
    assert a.tolist() == sorted(key.tolist()) and sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(key.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize(("k", "most"), [(6, 3), (16, 3), (16, 1 << 40), (31, 3)])
def test_tallies_of_counts_add_up(spark, monkeypatch, k, most):
    monkeypatch.setattr(counting, "HOLD", 50)
    rng = random.Random(k)
    codes = [rng.randrange(4**k) for _ in range(40)]
    rows = [(rng.choice(["a", None]), rng.choice(["x", "y", "z"]), rng.choice(codes), rng.randrange(1, most + 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "region string, hap string, code long, n long")

    def reduce(t):
        at = t.firsts(t.kind)
        return t.rows(at, code=t.code[at], n=np.add.reduceat(t.n, at))

    want = Counter()
    for region, hap, code, n in rows:
        want[region, hap, code] += n
    got = counting.tallied(df, reduce, "region string, hap string, code long, n long", k).collect()
    assert {(r["region"], r["hap"], r["code"]): r["n"] for r in got} == want and len(got) == len(want)
