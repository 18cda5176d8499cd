import pytest
from pyspark.sql import functions as F

from kmerlens.functions import kmer as K
from kmerlens.functions import measures as M
from kmerlens.functions import sql as functions
from kmerlens.schema import SchemaError, chrom_ord, require_columns
from kmerlens.settings import Settings


def rows(spark, kmers, **exprs):
    df = spark.createDataFrame([(k,) for k in kmers], "k string")
    return [tuple(r) for r in df.select(*(e.alias(n) for n, e in exprs.items())).collect()]


def test_codes(spark):
    k = F.col("k")
    got = rows(spark, ["A" * 16, "T" * 16, "ACGT" * 4, "GATTACAGATTACAGA", "acgtACGTacgtACGT", "ACGN", None], code=K.encode(k), back=K.decode(K.encode(k)))
    assert got[0] == (0, "A" * 16) and got[1] == (4294967295, "T" * 16)
    assert got[3][1] == "GATTACAGATTACAGA" and got[4][1] == "ACGT" * 4
    assert got[5] == (None, None) and got[6] == (None, None)


def test_reverse_complements_agree(spark):
    k = F.col("k")
    seqs = ["ACGTTGCAATGCCGTA", "GATTACAGATTACAGA", "C" * 16, "ACGT" * 4]
    got = rows(spark, seqs, rc=K.reverse_complement(k), by_code=K.decode(K.reverse_complement_code(K.encode(k))), pal=K.is_palindrome(k), can=K.canonical(k))
    for s, (rc, by_code, pal, can) in zip(seqs, got, strict=True):
        want = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert rc == by_code == want and pal == (s == want) and can == min(s, want)


def K_RC(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_stem(s):
    best = 0
    pair = dict(zip("ACGT", "TGCA", strict=True))
    for i in range(16):
        for j in range(i + 4, 16):
            n = 0
            while i + n < j - n and pair[s[i + n]] == s[j - n]:
                n += 1
            best = max(best, n)
    return best


def test_features(spark):
    k = F.col("k")
    seqs = ["AAAACCCCGGGGTTTT", "GATTACAGATTACAGA", "GCGCGCGCGCGCGCGC", "A" * 16]
    got = rows(spark, seqs, gc=K.gc_percent(k), run=K.max_run(k), h=K.base_entropy(k), stem=K.stem(k), name=K.kmer_id(K.encode(k)))
    assert got[0][:3] == (50.0, 4, 2.0) and got[3][:3] == (0.0, 16, 0.0)
    assert [g[3] for g in got] == [brute_stem(s) for s in seqs]
    assert got[3][4] == "k16_00000000"


def test_stems_are_fast(spark):
    import random
    import time

    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGT", k=16)) for _ in range(300)] + [a + "ACGT" + K_RC(a) for a in ("AACCGG", "GATTAC", "AAAAAA")]
    assert [r[0] for r in rows(spark, seqs, stem=K.stem(F.col("k")))] == [brute_stem(s) for s in seqs]
    many = spark.range(20_000, numPartitions=1).select(K.decode((F.col("id") * 2654435761) % (1 << 32)).alias("k"))
    began = time.time()
    assert many.where(K.stem(F.col("k")) > 8).isEmpty()
    assert time.time() - began < 8  # by start pairs and steps it took more than twice as long


def test_hamming(spark):
    df = spark.createDataFrame([("ACGTTGCAATGCCGTA", "ACGTTGCAATGCCGTT"), ("AAAAAAAAAAAAAAAA", "TTTTTTTTTTTTTTTA")], "a string, b string")
    a, b = K.encode(F.col("a")), K.encode(F.col("b"))
    got = df.select(K.hamming_code(a, b), K.hamming_either(a, b), K.mismatch_positions(F.col("a"), F.col("b")), K.shares_substring(F.col("a"), F.col("b"))).collect()
    assert tuple(got[0]) == (1, 1, [16], True)
    assert tuple(got[1][:2]) == (15, 1) and got[1][3]


def test_undefined_is_null(spark):
    df = spark.createDataFrame([(5, 10, 1, 0), (5, 10, 1, 10), (0, 10, 0, 10)], "t long, dt long, b long, db long")
    e = [r[0] for r in df.select(M.enrichment(*(F.col(c) for c in ("t", "dt", "b", "db")))).collect()]
    assert e[0] is None and e[1] == pytest.approx(2.3219, abs=1e-3) and e[2] == 0.0


def test_tiers(spark):
    df = spark.createDataFrame([(True, True, True), (True, True, False), (True, False, False), (False, False, False)], "p0 boolean, p1 boolean, p2 boolean")
    assert [r[0] for r in df.select(M.tier([F.col("p0"), F.col("p1"), F.col("p2")])).collect()] == ["A_le2mm", "B_le1mm", "C_exact", "D_none"]


def test_schema_and_settings(spark):
    df = spark.createDataFrame([("chr2",), ("X",), ("chrY",), ("M",)], "c string")
    assert [r[0] for r in df.select(chrom_ord(F.col("c"))).collect()] == [2, 23, 24, 99]
    with pytest.raises(SchemaError):
        require_columns(df, ["c", "d"])
    with pytest.raises(ValueError):
        Settings(k=40)
    with pytest.raises(ValueError):
        Settings.of(kk=3)
    assert Settings.of(pooled_min=3).pooled_min == 3


def test_sql_functions_equal_the_columns(spark):
    functions.register(spark)
    functions.register(spark)  # again does no harm
    rows = spark.createDataFrame([("ACGTACGTACGTTTTT", "AAAAACGTACGTACGA", 5, 10, 2, 40), ("GATTACAGATTACAGA", "CATTACAGATTACAGA", 0, 10, 0, 0), (None, "A", None, None, None, None), ("acgN", "acgt", 1, 0, 1, 1)], "a string, b string, t long, dt long, g long, dg long")
    sql = "SELECT kmer_rc(a) rc, kmer_canonical(a) can, kmer_encode(a) code, kmer_decode(kmer_encode(a), 16) back, kmer_gc(a) gc, kmer_distance_either(a, b) d, density(t, dt) x, log_enrichment(t, dt, g, dg) e FROM {r}"
    got = spark.sql(sql, r=rows)
    want = rows.select(
        K.reverse_complement(F.col("a")).alias("rc"), K.canonical(F.col("a")).alias("can"), K.encode(F.col("a")).alias("code"), K.decode(K.encode(F.col("a"))).alias("back"), K.gc_percent(F.col("a")).alias("gc"),
        F.least(F.size(K.mismatch_positions(F.col("a"), F.col("b"), 16)), F.size(K.mismatch_positions(F.col("a"), K.reverse_complement(F.col("b")), 16))).alias("d"),
        M.density(F.col("t"), F.when(F.col("dt") > 0, F.col("dt"))).alias("x"), M.enrichment(F.col("t"), F.col("dt"), F.col("g"), F.col("dg")).alias("e"),
    )
    first = lambda df: [tuple(r) for r in df.collect()]
    assert first(got)[:2] == first(want)[:2]
    assert all(v is None for v in first(got)[2]) and first(got)[3][2] is None and first(got)[3][6] is None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
