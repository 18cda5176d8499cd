import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlens.functions import kmer as K
from kmerlens.operators import counting, enrichment, mismatch
from kmerlens.sources import files

COMP = str.maketrans("ACGT", "TGCA")


def brute(seqs, k=16):
    out = Counter()
    for key, s in seqs:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                rc = w[::-1].translate(COMP)
                out[key, min(w, rc), int(w > rc)] += 1
    return out


def test_windows_against_brute_force(spark):
    rng = random.Random(81)
    seqs = [(1, "a" * 300), (2, "T" * 50), (3, "ACGT" * 4), (4, "GATTACA" * 10 + "N" + "ccgat" * 20), (5, "AAAA"), (6, "T" * 12), (7, None), (8, ""), (9, "".join(rng.choice("ACGTNacgt") for _ in range(900)))]
    df = spark.createDataFrame(seqs, "id long, seq string")
    for k in (16, 5, 21, 31):
        got = counting.spectrum(df, k, strands=True).select("id", K.decode(F.col("code"), k).alias("kmer"), "strand", "n").collect()
        assert {(r["id"], r["kmer"], r["strand"]): r["n"] for r in got} == dict(brute(seqs, k))


def test_positions(spark):
    df = spark.createDataFrame([(1, "ACGTNACGTA")], "id long, seq string")
    got = sorted(r["start"] for r in counting.windows(df, 4, positions=True).collect())
    assert got == [0, 5, 6]


def test_region_stats(spark):
    df = spark.createDataFrame([("A" * 16 + "N" + "c" * 17 + "R" + "T" * 15,), ("A" * 8,), ("",)], "seq string")
    got = [tuple(r) for r in counting.region_stats(df).collect()]
    assert got == [(50, 48, 2, 3), (8, 8, 0, 0), (0, 0, 0, 0)]


def test_chunks_keep_every_window(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, "".join(rng.choice("ACGT") for _ in range(1000)))], "id long, seq string")
    whole = counting.spectrum(df, keys=["id"]).select("code", "n")
    cut = counting.spectrum(files.chunks(df, 100), keys=["id"]).select("code", "n")
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_pool(spark):
    df = spark.createDataFrame([("h1", 0, 5), ("h1", 1, 500), ("h1", 2, 9), ("h2", 0, 5)], "hap string, code long, n long")
    assert sorted(r["code"] for r in counting.pool(df, 10, 500).collect()) == [0, 1]
    assert sorted(r["code"] for r in counting.pool(df, 100, 10).collect()) == [1]
    with pytest.raises(KeyError):
        counting.lookup(df, "code", 9, df)


def test_strict_threshold(spark):
    """E above the threshold, counts at least the minimum."""
    counts = spark.createDataFrame([("h", "HSat2", i, t) for i, t in enumerate([9, 10, 500, 499])], "hap string, region string, code long, n long")
    den = spark.createDataFrame([("h", "HSat2", 1000), ("h", "background", 1000)], "hap string, region string, valid_starts long")
    p = enrichment.pooled_enrichment(counts, den, F.col("hap") == "ref", 10, 10.0)
    assert {r["code"]: r["pooled_pass"] for r in p.collect()} == {0: False, 1: True, 2: True, 3: True}
    h = enrichment.hap_enrichment(counts, den, 500, 10.0)
    assert {r["code"]: r["hap_pass"] for r in h.collect()} == {0: False, 1: False, 2: True, 3: False}
    e = {r["code"]: r["e"] for r in p.collect()}[1]
    at = enrichment.pooled_enrichment(counts, den, F.col("hap") == "ref", 10, e)
    assert not {r["code"]: r["pooled_pass"] for r in at.collect()}[1]


def test_missing_denominator_is_undefined(spark):
    counts = spark.createDataFrame([("h", "HSat2", 1, 50)], "hap string, region string, code long, n long")
    den = spark.createDataFrame([("h", "HSat2", 1000)], "hap string, region string, valid_starts long")
    row = enrichment.hap_enrichment(counts, den, 1, 0.0).first()
    assert row["e"] is None and row["hap_pass"] is False


def _texts(spark, n=60, size=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("ACGTN\n", [40, 20, 20, 40, 1, 1], k=size))) for i in range(n)] + [(None, None), (n, "acgt"), (n, "A" * 5000)]
    return spark.createDataFrame(rows, "doc long, seq string")


@pytest.mark.parametrize("limits", [{}, {"exact": 10}, {"exact": 10, "bits": 18}, {"exact": 10, "bits": 15}])
def test_seeded_counts_equal_the_restricted_spectrum(spark, limits):
    seqs = _texts(spark)
    full = counting.spectrum(seqs, keys=["doc"], strands=True)
    seeds = full.select("code").distinct().where("code % 23 = 1 or code = 0").unionByName(spark.createDataFrame([(None,), (5,), (5,), ((1 << 32) - 1,)], "code long"))
    rows = lambda df: sorted((tuple(r) for r in df.select("doc", "code", "strand", "n").collect()), key=str)
    want = rows(full.join(seeds.where("code is not null").distinct(), "code"))
    assert len(want) > 1000 and rows(counting.seeded(seqs, seeds, keys=["doc"], strands=True, **limits)) == want


def test_only_candidates_leave_the_scan(spark):
    seqs = _texts(spark)
    every = counting.windows(seqs, keys=["doc"], positions=True)
    seeds = every.select("code").distinct().where("code % 50 = 3")
    true = every.join(seeds, "code", "left_semi").count()
    exact = counting.windows(seqs, keys=["doc"], positions=True, only=counting.prefilter(seeds)).count()
    rough = counting.windows(seqs, keys=["doc"], positions=True, only=counting.prefilter(seeds, exact=100)).count()
    assert exact == true > 0
    # 3,000 marks of 134 million: one window in 40,000 passes by chance
    assert true <= rough <= true + 0.01 * every.count()
    assert counting.prefilter(seeds, exact=100, bits=15) is not None or seeds.count() > 1 << 13
    assert counting.prefilter(every, exact=100, bits=15) is None
    nothing = counting.prefilter(seeds.limit(0))
    assert counting.windows(seqs, keys=["doc"], only=nothing).isEmpty() and counting.seeded(seqs, seeds.limit(0), keys=["doc"]).isEmpty()


def test_counts_in_a_radius_equal_the_join(spark):
    seqs = _texts(spark, 30)
    queries = counting.spectrum(seqs, keys=[]).orderBy(F.desc("n"), "code").limit(4).select("code")
    by_join = mismatch.radius_join(queries, counting.spectrum(seqs, keys=["doc"]))
    rows = lambda df: sorted((tuple(r) for r in df.select("query", "d", "code", "doc", "n").collect()), key=str)
    assert rows(mismatch.radius_counts(queries, seqs, ["doc"])) == rows(by_join) != []


def test_plain_search_in_a_long_text(spark):
    import time

    motif = "ACGTACGTACGTACGA"
    text = ("ACGT" * 8 + "A" * 5) * 8000  # 296,000 bases, 8,000 of them starts of hits
    text = text.replace("ACGTAAAAA", motif + "AAAA")
    df = spark.createDataFrame([(1, text), (2, None), (3, "ACG"), (4, "A" * 18)], "id long, seq string")
    began = time.time()
    got = sorted(map(tuple, counting.substring_hits(df, [motif, "A" * 16], ["id"]).collect()))
    assert time.time() - began < 20  # a search that walks to each place from the start takes minutes
    want = [(1, motif, i) for i in range(len(text)) if text.startswith(motif, i)] + [(4, "A" * 16, i) for i in range(3)]
    assert got == sorted(want) and len(want) > 8000


def test_most_frequent_is_exact(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGT", k=3000)) for _ in range(6)] + ["ACGTTGCAAC" * 30, "GATTACAT" * 20, "ACGTNACGT", None]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    whole = counting.spectrum(df, keys=[]).orderBy(F.desc("n"), "code")
    for most in (1, 5, 60):
        assert counting.most_frequent(df, most, bits=15).collect() == whole.limit(most).select("code", "n").collect()
    assert counting.most_frequent(df.where("length(seq) < 20"), 3, bits=15).isEmpty()
    few = df.where("length(seq) = 160")
    assert counting.most_frequent(few, 1000, bits=15).count() == counting.spectrum(few, keys=[]).count()


def test_tallies_are_those_of_single_windows(spark, monkeypatch):
    """Windows that are dealt as sorted runs of codes come out as if each were a row, whatever the buckets and
    the runs; null and many keys, long rows and other lengths of k-mers too."""
    rng = random.Random(4)
    unit = "".join(rng.choice("ACGT") for _ in range(37))
    texts = [unit * 9, unit[5:] * 4, None, "", "ACGTN" * 30, "".join(rng.choice("ACGTacgtN") for _ in range(3000)), "A" * 500]
    rows = [(None if i % 5 == 0 else f"h{i % 3}", None if i % 7 == 6 else i % 2, texts[i % len(texts)]) for i in range(40)]
    df = spark.createDataFrame(rows, "hap string, region int, seq string").repartition(3)
    monkeypatch.setattr(counting, "HOLD", 700)
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    for k in (1, 5, 16, 21, 31):
        single = counting.windows(df, k).groupBy("hap", "region", "code", "strand").agg(F.sum("n").alias("n"))
        want = key(single)
        for bases in (0, 1 << 26):
            assert key(counting.spectrum(df, k, strands=True, bases=bases)) == want
    pool = counting.pool(single, 60, 30)
    assert 0 < pool.count() < single.select("code").distinct().count()
    assert key(counting.sequence_pool(df, 60, 30, k=31)) == key(pool)
    assert key(counting.pooled_counts(df, 60, 30, ["hap", "region"], k=31, bases=1 << 26)) == key(counting.restrict(single, pool).select("hap", "region", "code", "strand", "n"))
    # counts that are rows already
    again = counting.tallied(single.drop("strand"), lambda t: t.rows(at := t.firsts(t.kind), code=t.code[at], n=np.add.reduceat(t.n, at)), "hap string, region int, code long, n long", 31)
    assert key(again) == key(counting.spectrum(df, 31))
