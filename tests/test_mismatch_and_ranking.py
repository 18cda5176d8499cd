import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kmerlens.functions import kmer as K
from kmerlens.operators import audit, cluster, counting, landscape, mismatch, ranking

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMP)


def dist(a, b):
    return min(sum(x != y for x, y in zip(a, t, strict=True)) for t in (b, rc(b)))


def test_neighbourhood(spark):
    q = min("ACGTTGCAATGCCGTA", rc("ACGTTGCAATGCCGTA"))
    df = spark.createDataFrame([(q,)], "k string").select(K.encode(F.col("k")).alias("code"))
    got = mismatch.neighbours(df).select(K.decode(F.col("variant")).alias("v"), "d").collect()
    assert len(got) == len({r["v"] for r in got}) == 1129
    assert all(dist(q, r["v"]) == r["d"] and r["v"] <= rc(r["v"]) for r in got)


def test_sums_and_positions(spark):
    rng = random.Random(5)
    q = "ACGTTGCAATGCCGTA"
    q = min(q, rc(q))
    near = [q] * 3
    for _ in range(40):
        s = list(q)
        for i in rng.sample(range(16), rng.randrange(4)):
            s[i] = rng.choice("ACGT")
        near.append("".join(s) if rng.random() < 0.5 else rc("".join(s)))
    seqs = spark.createDataFrame([(1, "N".join(near))], "id long, seq string")
    counts = counting.spectrum(seqs).drop("id")
    query = spark.createDataFrame([(q,)], "k string").select(K.encode(F.col("k")).alias("code"))
    m = mismatch.radius_join(query, counts)
    got = {r["d"]: (r["n"], r["cumulative"]) for r in mismatch.by_distance(m, []).collect()}
    want = Counter(d for s in near if (d := dist(q, s)) <= 2)
    assert got == {d: (want[d], sum(want[x] for x in range(d + 1))) for d in range(3)}
    w = mismatch.position_weights(m, []).groupBy("d").agg(F.sum("weight")).collect()
    assert {r[0]: r[1] for r in w} == {d: d * want[d] for d in (1, 2) if want[d]}


def test_percentiles_break_ties_by_order(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "id long, v long").withColumn("g", F.lit(1))
    got = {r["id"]: r["p"] for r in df.withColumn("p", ranking.percentile(F.col("v"), ["g"], F.col("id"))).collect()}
    assert got == {3: 0.0, 1: 0.5, 2: 1.0}
    one = df.where("id = 1").withColumn("p", ranking.percentile(F.col("v"), ["g"], F.col("id"))).first()["p"]
    assert one == 0.0


def reference_pool(n, width):
    order = sorted(range(len(n)), key=lambda i: (-n[i], i))
    pos = [i for i in order if n[i] > 0]
    common = pos[: width // 2]
    rest = pos[len(common) :]
    k = min(min(width, len(n)) - len(common), len(rest))
    picked = [rest[int(j * (len(rest) - 1) / (k - 1)) if k > 1 else 0] for j in range(k)] if k else []
    chosen = list(dict.fromkeys(common + picked))
    for i in order:
        if len(chosen) >= min(width, len(n)):
            break
        if i not in chosen:
            chosen.append(i)
    return set(chosen)


@pytest.mark.parametrize("width", [4, 6, 11, 40])
def test_systematic_pool(spark, width):
    n = [9, 7, 7, 5, 4, 4, 3, 2, 2, 1, 0, 0, 0, 8, 6, 1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "id long, n long").withColumn("g", F.lit(0))
    got = ranking.systematic_pool(df, ["g"], width, [F.desc("n"), F.asc("id")]).collect()
    assert {r["id"] for r in got} == reference_pool(n, width)


def like(a, b):
    """The rule itself: within 2 bases in either orientation, or 12 bases in a row shared."""
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return min(sum(x != y for x, y in zip(a, t, strict=True)) for t in (b, rc)) <= 2 or any(a[i : i + 12] in t for i in range(5) for t in (b, rc))


def test_picks_follow_the_rule():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ACGT"), 16)) for _ in range(30)]
    texts = []
    for s in base:
        rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        texts += [s, s[:3] + "A" + s[4:9] + "C" + s[10:], s[2:14] + "GATT", "GAT" + rc[1:13] + "C", s[:8] + rc[:8]]
    for a in texts[:40]:
        picks = ranking.Picks()
        picks.add(a)
        assert [picks.admits(b) for b in texts] == [not like(b, a) for b in texts]


def test_selections(spark):
    assert ranking.round_robin([[("a", "A" * 16), ("b", "C" * 8 + "A" * 8)], [("a", "A" * 16), ("c", "GATTACAGATTACAGA")]]) == ["a", "b", "c"]
    assert ranking.balanced_fill(["a"], {"x": [("a", "A" * 16), ("b", "GATTACAGATTACAGA")], "y": []}, 5) == ["a", "b"]
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("ACGT"), 16)) for _ in range(60)]
    queues = [[(int(i), names[i]) for i in rng.permutation(60)[:20]] for _ in range(4)]
    for taken, rounds, most in (([], 3, 24), ([1, 5], None, 30), ([1, 5], None, 99), ([], 3, 5)):
        got, own = list(taken), [[] for _ in queues]
        for _ in range(rounds or 99):
            for q, picks in zip(queues, own, strict=True):
                free = [(i, s) for i, s in q if i not in got and not any(like(s, p) for p in picks)]
                if free and len(got) < most:
                    got.append(free[0][0])
                    picks.append(free[0][1])
        assert ranking.interleaved(queues, taken, most, rounds) == sorted(got)


@pytest.mark.parametrize("ahead", [2, 256])
def test_shortlists(spark, tmp_path, ahead):
    seen = []

    def keep(df):
        seen.append(1)
        df.write.parquet(str(tmp_path / f"t{len(seen)}"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / f"t{len(seen)}"))

    rng = np.random.default_rng(4)
    rows = [("f", "pan", "A" * 16, 3.0), ("f", "pan", "A" * 15 + "C", 2.0), ("f", "pan", "GATTACAGATTACAGA", 1.0)]
    rows += [("f", "chromosome_1", "ACGT" * 3 + "".join(rng.choice(list("ACGT"), 4)), float(i)) for i in range(30)] + [("f", "chromosome_1", "".join(rng.choice(list("ACGT"), 16)), -float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "family string, category string, kmer string, score double")
    got = {}
    for r in ranking.greedy_shortlist(df, ["family", "category"], keep, ahead=ahead).orderBy("category_rank").collect():
        got.setdefault(r["category"], []).append(r["kmer"])
    assert got["pan"] == ["A" * 16, "GATTACAGATTACAGA"]
    want = []
    for _, _, s, _ in sorted((r for r in rows if r[1] != "pan"), key=lambda r: (-r[3], r[2])):
        if len(want) < 5 and not any(like(s, p) for p in want):
            want.append(s)
    assert got["chromosome_1"] == want


def test_contrast_counts_zeros(spark):
    rng = np.random.default_rng(5)
    haps = [(c, h, f"G{h % 3}") for c in (1, 2) for h in range(10 + c)]
    rows = [(k, c, h, g, int(n), float(n) / 3) for k in range(6) for c, h, g in haps if (n := rng.integers(0, 30) * (rng.random() < 0.5)) > 0]
    df = spark.createDataFrame(rows, "code long, chrom long, hap long, grp string, n long, density double")
    got = landscape.group_contrast(df, spark.createDataFrame(haps, "chrom long, hap long, grp string"), ["code"], "grp", within=["chrom"]).collect()
    full = {(k, c, h): (0, 0.0) for k, c in {r[:2] for r in rows} for cc, h, _ in haps if cc == c} | {(k, c, h): (n, d) for k, c, h, _, n, d in rows}
    assert len(got) == 3 * len({r[:2] for r in rows})
    for r in got:
        side = {True: [], False: []}
        for (k, c, h), v in full.items():
            if (k, c) == (r["code"], r["chrom"]):
                side[f"G{h % 3}" == r["grp"]].append(v)
        for inside, a, b in ((True, "in_presence", "in_median"), (False, "out_presence", "out_median")):
            assert r[a] == pytest.approx(np.mean([n >= 10 for n, _ in side[inside]])) and r[b] == pytest.approx(np.median([d for _, d in side[inside]]))


def test_components(spark, tmp_path):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(6, 5), (5, 4), (4, 3), (1, 2)], "a long, b long")
    seen = []

    def keep(df):
        path = str(tmp_path / f"s{len(seen)}")
        seen.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {r["node"]: r["component"] for r in ranking.min_label_components(edges, nodes, keep).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7}


@pytest.mark.parametrize(("a", "b", "want"), [("1122", "9933", 1.0), ("1122", "1212", -0.5), ("1111", "1111", 1.0)])
def test_rand_index(spark, a, b, want):
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")
    assert cluster.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(want)
    codes = [np.unique(list(x), return_inverse=True)[1] for x in (a, b)]
    assert cluster.rand_index(*codes) == pytest.approx(want)


def test_cluster_cases(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        x = rng.normal(0, 0.1, 12) + (np.arange(12) % 2) * (3 if i % 2 else -3)
        rows.append(("HSat2", 1, f"h{i:02d}", x.tolist()))
    rows += [("HSat2", 1, "ref", rows[1][3]), ("HSat3", 1, "h00", [0.0] * 12)]
    df = spark.createDataFrame(rows, "family string, chromosome long, hap string, features array<double>")
    got = cluster.cluster_cases(df, ["family", "chromosome"], "ref", least_haps=50, reps=5).collect()
    own = {r["hap"]: r for r in got if r["family"] == "HSat2"}
    assert own["h01"]["status"] == "stable_partition" and own["h01"]["k"] == 2
    assert len({own[f"h{i:02d}"]["grp"] for i in range(0, 60, 2)}) == 1 and own["h00"]["grp"] != own["h01"]["grp"]
    assert own["ref"]["status"] == "reference_projection_only" and own["ref"]["grp"].startswith(own["h01"]["grp"])
    assert [r["status"] for r in got if r["family"] == "HSat3"] == ["insufficient_measurable_haps"]


def test_case_details(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6))
    x[:, 3] = 2 * x[:, 0] + 0.01 * rng.normal(size=12)
    x[:, 5] = 1.0
    rows = [("HSat2", f"h{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("HSat2", "ref", [0.0] * 6), ("HSat3", "h00", [1.0] * 6)]
    df = spark.createDataFrame(rows, "family string, hap string, features array<double>")
    got = cluster.case_details(df, ["family"], "ref", least_haps=5).collect()
    assert {r["family"] for r in got} == {"HSat2"} and {r["detail"] for r in got if r["hap"] == "ref"} == {"reference_axis", "reference_group"}
    by = {d: [r for r in got if r["detail"] == d] for d in ("axis", "variance", "partition", "feature")}
    assert {r["number"]: r["text"] for r in by["feature"]} == {0: "3", 1: "1", 2: "2", 3: "3", 4: "4"}
    assert all(r["value"] == pytest.approx(np.corrcoef(x[:, r["number"]], x[:, int(r["text"])])[0, 1]) for r in by["feature"])
    kept = x[:, [3, 1, 2, 4]]
    values = np.linalg.svd(kept - kept.mean(0), compute_uv=False) ** 2
    assert [r["value"] for r in sorted(by["variance"], key=lambda r: r["number"])] == pytest.approx(list(values / values.sum()))
    for a in range(1, 5):
        assert sum(r["value"] ** 2 for r in by["axis"] if r["number"] == a) == pytest.approx(values[a - 1])
    assert all(len({r["text"] for r in by["partition"] if r["number"] == k}) == k for k in range(2, 9))
    # the reference on the same axes: all of them together keep its distance to the mean
    on_axes = [r["value"] for r in got if r["detail"] == "reference_axis"]
    assert len(on_axes) == 4 and sum(v * v for v in on_axes) == pytest.approx((kept.mean(0) ** 2).sum())
    value = {(r["hap"], r["number"]): r["value"] for r in by["axis"]}
    axis = np.linalg.lstsq(np.array([[value[f"h{i:02d}", a] for a in range(1, 5)] for i in range(12)]), kept - kept.mean(0), rcond=None)[0]
    assert on_axes == pytest.approx(list(axis @ -kept.mean(0)))
    for r in (r for r in got if r["detail"] == "reference_group"):
        groups = {}
        for p in by["partition"]:
            if p["number"] == r["number"]:
                groups.setdefault(p["text"], []).append(kept[int(p["hap"][1:])])
        centres = {g: np.linalg.norm(np.mean(v, 0)) for g, v in groups.items()}
        nearest = min(centres, key=centres.get)
        far = r["value"] > np.quantile(np.linalg.norm(np.array(groups[nearest]) - np.mean(groups[nearest], 0), axis=1), 0.95)
        assert r["value"] == pytest.approx(centres[nearest]) and r["text"] == nearest + "?" * bool(far)


def test_cover_and_silhouette_by_hand():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 30))
    x[:, 10:20] = x[:, :10] * rng.choice([-3, 2], 10) + 0.05 * rng.normal(size=(40, 10))
    chosen, group = cluster.cover(x)
    c, free, want = np.abs(np.corrcoef(x.T)), set(range(30)), []
    for i in range(30):
        if i in free:
            want.append(i)
            free -= {j for j in free if c[i, j] >= 0.95} | {i}
    assert chosen.tolist() == want and all(c[i, g] >= 0.95 for i, g in enumerate(group))
    label = rng.integers(0, 3, 40)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    values = []
    for i in range(40):
        mean = [d[i, (label == g) & (np.arange(40) != i)].mean() for g in range(3)]
        a, b = mean[label[i]], min(m for g, m in enumerate(mean) if g != label[i])
        values.append((b - a) / max(a, b))
    assert cluster.silhouette(x, label) == pytest.approx(np.mean(values))


def test_centroids_in_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), int(i % 7)) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label long")
    whole, parts = ({tuple(r) for r in cluster.nearest_centroid(df, df, "id", "v", "label", n).collect()} for n in (1000, 2))
    assert whole == parts and len(whole) == 70


def test_audits_find_what_is_wrong(spark):
    near = mismatch.neighbours(spark.createDataFrame([(0x1B1B1B1B,), (0x00FF00FF,), (5,)], "code long"))
    assert audit.neighbourhood_differs(near).isEmpty()
    assert audit.neighbourhood_differs(near.where("not (query = 5 and variant = 4)")).first()["query"] == 5
    assert audit.neighbourhood_differs(near.withColumn("d", F.when(F.col("query") == 5, F.lit(2)).otherwise(F.col("d")))).count() == 1
    counts = spark.createDataFrame([(1, "HSat2", 5), (1, "HSat3", 2), (1, "background", 9), (2, "HSat3", 4), (3, "HSat2", 1)], "code long, region string, n long")
    union = spark.createDataFrame([(1, 6), (2, 4), (2, 1)], "code long, n long")
    assert sorted(r["code"] for r in audit.union_below_parts(union, counts, ["code"]).collect()) == [1, 3]
    cases = spark.createDataFrame([("a", f"h{i}", "G1" if i < 12 else "G2", 2, 0.5, "stable_partition") for i in range(30)] + [("b", "x", "G1", None, None, "insufficient_measurable_haps")], "family string, hap string, grp string, k int, silhouette double, status string")
    assert audit.clusters_break_rules(cases.where("family = 'a'"), ["family"]).isEmpty()
    assert {r[0] for r in audit.clusters_break_rules(cases, ["family"]).collect()} == {"b"}
    assert {r[0] for r in audit.clusters_break_rules(cases.where("hap not in ('h0', 'h1', 'h2')"), ["family"]).collect()} == {"a", "b"}


def test_selections_that_must_be_there(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "x long")
    assert [r[0] for r in ranking.exactly(df, 2, [F.desc("x")]).collect()] == [2, 1]
    with pytest.raises(ValueError, match="4 rows are asked for"):
        ranking.exactly(df, 4, [F.desc("x")])


def test_ward_heights():
    tree = cluster.ward(np.array([[0.0], [1.0], [10.0], [12.0]]))
    assert tree[:, 2] == pytest.approx([1.0, 2.0, 14.849242404917497])
    assert cluster.cut(tree, 2).tolist() == [0, 0, 1, 1] and cluster.leaf_order(tree) == [0, 1, 2, 3]


def test_histogram_and_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.999,), (1.0,), (None,)], "x double")
    got = {r["bin"]: r["n"] for r in landscape.histogram(df, "x", 0.0, 1.0, 20).collect()}
    assert len(got) == 20 and got[1] == 1 and got[2] == 1 and got[20] == 2 and got[10] == 0
    hits = spark.createDataFrame([("a", 5, "+"), ("a", 35, "-")], "kmer string, start long, strand string")
    filled = landscape.gap_filled(landscape.bins(hits, 10, ["kmer"]), 10, ["kmer"])
    assert sorted((r["bin_start"], r["n"]) for r in filled.collect()) == [(0, 1), (10, 0), (20, 0), (30, 1)]


def test_cluster_query_uses_all_of_its_operator(spark, monkeypatch):
    import inspect

    from kmerlens.plans import ranking_queries

    seen = {}

    def spy(name):
        real = getattr(cluster, name)

        def call(*a, **kw):
            bound = inspect.signature(real).bind(*a, **kw)
            bound.apply_defaults()
            seen.update(bound.arguments)
            return real(*a, **kw)

        monkeypatch.setattr(cluster, name, call)

    spy("variable_features")
    spy("cluster_cases")
    ranking_queries.cluster_cases(spark, "/root/testdata/sf0.001")
    assert seen["most"] == 3000 and seen["reps"] == 20


@pytest.mark.parametrize("ranges", [1, 3, 17])
@pytest.mark.parametrize("broadcast", [True, False])
def test_numbers_by_ranges_equal_a_window(spark, ranges, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ranking, "BROADCAST_PARTS", -1)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, (F.col("id") % 11).cast("string")).alias("g"), (F.col("id") % 2).alias("h"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 101).alias("v"))
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    for by in ([], ["g"], ["g", "h"]):
        w = Window.partitionBy(*by)
        want = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
        got = ranking.numbered(rows, by, order, "place", "n", ranges)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert ranking.numbered(rows.limit(0), ["g"], order).count() == 0


def test_a_hot_group_is_many_ranges(spark, tmp_path, monkeypatch):
    seen = []
    real = ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 20_000).alias("v"))
    out = ranking.numbered(rows, ["g"], [F.col("v")], ranges=16)
    assert out.where("place <> v + 1").isEmpty()
    sizes = [r["count"] for r in dict(seen)["ranges"].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]


def test_composite_equals_percentiles(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 > 0).alias("g"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("a"), (F.col("id") % 4 / 3).alias("b"))
    got = ranking.composite(rows, ["a", "b"], ["g"], F.col("id"), (0.3, 0.7))
    want = rows.withColumn("pct_a", ranking.percentile(F.col("a"), ["g"], F.col("id"))).withColumn("pct_b", ranking.percentile(F.col("b"), ["g"], F.col("id")))
    want = want.withColumn("score", F.lit(0.0) + F.col("pct_a") * 0.3 + F.col("pct_b") * 0.7)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("k", "radius", "blocks", "pairs"), [(16, 2, None, 1 << 22), (16, 2, 3, 50), (16, 1, None, 1 << 22), (11, 3, 4, 200), (7, 2, None, 1 << 22)])
def test_index_finds_all_neighbours(spark, k, radius, blocks, pairs):
    rng = random.Random(k * 10 + radius)
    canonical = lambda c: min(c, int("".join("3210"[int(x)] for x in reversed(np.base_repr(c, 4).zfill(k))), 4))
    queries = [canonical(rng.randrange(4**k)) for _ in range(25)] + [0, canonical(int("01" * k, 4) % 4**k)]
    near = []
    for q in queries:
        for _ in range(30):  # up to radius + 1 changes
            c = q
            for i in rng.sample(range(k), rng.randrange(radius + 2)):
                c ^= rng.randrange(4) << 2 * i
            near.append(canonical(c))
    codes = near + [canonical(rng.randrange(4**k)) for _ in range(500)]
    q = spark.createDataFrame([(c,) for c in [*queries, queries[0], None]], "code long")
    counts = spark.createDataFrame([(c, h, 1 + h) for c in set(codes) for h in (1, 2)] + [(None, 1, 1)], "code long, hap int, n int")
    rows = lambda df: sorted((r["query"], r["code"], r["d"], r["hap"], r["n"]) for r in df.collect())
    want = rows(mismatch.radius_join(q.where("code is not null").distinct(), counts, k, radius))
    got = rows(mismatch.index_join(q, counts, k, radius, blocks=blocks, pairs=pairs))
    assert len(want) > 300 and got == want
    assert mismatch.index_pairs(q.limit(0), counts, k, radius).isEmpty() and mismatch.index_pairs(q, counts.limit(0), k, radius).isEmpty()
