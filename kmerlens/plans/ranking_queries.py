"""Queries on ranked candidates, similarity classes and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmer as K
from ..functions import measures as M
from ..operators import cluster, ranking, specificity
from . import fixtures as fx
from . import sequence_sql as Q
from .count_queries import _FAM
from .registry import query, rounded
from .written import written

MIX = 2654435761


def _code(x):
    """A 16-mer code from a number, spread over all codes."""
    return (x.cast("long") * F.lit(MIX)) % F.lit(1 << 32)


def _candidates(spark, sf) -> DataFrame:
    """One row per k-mer: family, type, measures and sequence."""
    c, d = fx.counts(spark, sf).where("hap <> 0"), fx.den(spark, sf).where("hap <> 0")
    m = specificity.family_metrics(c, d).select("code", "n_h2", "n_h3", "family_log2", "prevalence")
    b = c.where("region = 'background'").groupBy("code").agg(F.sum("n").alias("b"))
    rows = m.join(b, "code", "left").fillna(0, ["b"])
    kmer = K.decode(_code(F.col("code")))
    return rows.select("code", F.when(F.col("n_h2") >= F.col("n_h3"), "HSat2").otherwise("HSat3").alias("family"), (F.col("code") % 3).alias("type"), (F.col("n_h2") + F.col("n_h3")).alias("target"), "b", F.abs("family_log2").alias("contrast"), "prevalence", kmer.alias("kmer"))


_KMER = "list_aggregate(list_transform(range(16), lambda i: substr('ACGT', CAST(((CAST({x} AS BIGINT) * 2654435761) % 4294967296) // pow(4, 15 - i)::BIGINT % 4 AS INT) + 1, 1)), 'string_agg', '')"
_CAND = _FAM + ", al2 AS (SELECT * FROM al), fm AS (SELECT code, sum(n0) AS n2, sum(n1) AS n3, log2((CAST(sum(n0) AS DOUBLE) / a0 + 1e-9) / (CAST(sum(n1) AS DOUBLE) / a1 + 1e-9)) AS fl, count(*) AS prevalence FROM le, al2 GROUP BY code, a0, a1), bb AS (SELECT code, sum(n) AS b FROM c WHERE hap <> 0 AND region = 'background' GROUP BY code), cd AS (SELECT fm.code, CASE WHEN n2 >= n3 THEN 'HSat2' ELSE 'HSat3' END AS family, fm.code % 3 AS type, CAST(n2 + n3 AS BIGINT) AS target, CAST(coalesce(b, 0) AS BIGINT) AS b, abs(fl) AS contrast, prevalence, " + _KMER.format(x="fm.code") + " AS kmer FROM fm LEFT JOIN bb USING (code))"


@query("candidate_sequences", fx.sql("c d", _CAND + " SELECT code, family, type, target, b, round(contrast, 6) AS contrast, prevalence, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS reverse_complement, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canonical, 'k16_' || lpad(lower(printf('%x', (code * 2654435761) % 4294967296)), 8, '0') AS kmer_id FROM cd"))
def candidate_sequences(spark, sf):
    k = F.col("kmer")
    return rounded(_candidates(spark, sf), "contrast").withColumns({"reverse_complement": K.reverse_complement(k), "canonical": K.canonical(k), "kmer_id": K.kmer_id(K.encode(k))})


def _scored(spark, sf):
    rows = _candidates(spark, sf).withColumns({"m1": F.round(F.log1p("target"), 9), "m2": F.round("contrast", 9), "m3": F.round(F.log1p(F.col("target")) - F.log1p(F.col("b")), 9), "m4": F.col("prevalence"), "m5": F.round(-F.log1p("b"), 9), "m6": F.round(K.base_entropy(F.col("kmer")), 9)})
    return ranking.composite(rows, [f"m{i}" for i in range(1, 7)], ["family"], F.col("code"))


_ENT = "round(list_sum(list_transform(['A', 'C', 'G', 'T'], lambda x: CASE WHEN contains(kmer, x) THEN -(16 - length(replace(kmer, x, ''))) / 16.0 * log2((16 - length(replace(kmer, x, ''))) / 16.0) ELSE 0 END)), 9)"
_SCORE = _CAND + f", ms AS (SELECT *, round(ln(1 + target), 9) AS m1, round(contrast, 9) AS m2, round(ln(1 + target) - ln(1 + b), 9) AS m3, prevalence AS m4, round(-ln(1 + b), 9) AS m5, {_ENT} AS m6 FROM cd), sc AS (SELECT *, " + " + ".join(f"{w} * ((row_number() OVER (PARTITION BY family ORDER BY m{i} NULLS FIRST, code) - 1) / greatest(1, count(*) OVER (PARTITION BY family) - 1))" for i, w in enumerate(ranking.WEIGHTS, 1)) + " AS score FROM ms)"


@query("percentile_composite", fx.sql("c d", _SCORE + " SELECT code, family, round(score, 6) AS score FROM sc"))
def percentile_composite(spark, sf):
    return rounded(_scored(spark, sf).select("code", "family", "score"), "score")


@query("rank_within_type", fx.sql("c d", _SCORE + " SELECT code, family, type, row_number() OVER (PARTITION BY family, type ORDER BY round(score, 9) DESC, code) AS rank FROM sc"))
def rank_within_type(spark, sf):
    rows = _scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.rank_within(rows, ["family", "type"], [F.desc("score"), F.asc("code")]).select("code", "family", "type", F.col("rank").cast("long").alias("rank"))


@query("topk_per_group", fx.sql("c d", _SCORE + ", rk AS (SELECT *, row_number() OVER (PARTITION BY family, type ORDER BY round(score, 9) DESC, code) AS rank FROM sc) SELECT code, family, type, rank FROM rk WHERE rank <= 20"))
def topk_per_group(spark, sf):
    rows = _scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.top_k(rows, ["family", "type"], [F.desc("score"), F.asc("code")], 20).select("code", "family", "type", F.col("rank").cast("long").alias("rank"))


_TIER = _SCORE + ", tr AS (SELECT *, CASE WHEN prevalence >= 14 THEN 'A_le2mm' WHEN prevalence >= 12 THEN 'B_le1mm' WHEN prevalence >= 9 THEN 'C_exact' ELSE 'D_none' END AS tier, 0.30 * least(1, greatest(0, m3 / 10)) + 0.25 * least(1, greatest(0, m2 / 10)) + 0.20 * least(1, greatest(0, (0.95 - 0.9) / 0.1)) + 0.25 * least(1, greatest(0, CAST(prevalence AS DOUBLE) / 20)) AS mm FROM sc)"


def _tiers(spark, sf):
    p = F.col("prevalence")
    rows = _scored(spark, sf).withColumn("tier", M.tier([p >= 9, p >= 12, p >= 14]))
    return rows.withColumn("mm", M.mismatch_score(F.col("m3"), F.col("m2"), F.lit(0.95), p, F.lit(20)))


@query("robustness_tier", fx.sql("c d", _TIER + " SELECT code, tier, round(mm, 6) AS mismatch, round(0.55 * score + 0.35 * mm + 0.10 * CASE tier WHEN 'A_le2mm' THEN 1.0 WHEN 'B_le1mm' THEN 0.6 WHEN 'C_exact' THEN 0.3 ELSE 0 END, 6) AS final FROM tr"))
def robustness_tier(spark, sf):
    rows = _tiers(spark, sf)
    return rounded(rows.select("code", "tier", F.col("mm").alias("mismatch"), M.final_score(F.col("score"), F.col("mm"), F.col("tier")).alias("final")), "mismatch", "final")


@query("tier_by_family", fx.sql("c d", _TIER + " SELECT t.x AS tier, " + ", ".join(f"count(*) FILTER (family = '{f}') AS \"{f}\"" for f in ("HSat2", "HSat3")) + " FROM (SELECT unnest(['A_le2mm', 'B_le1mm', 'C_exact', 'D_none']) AS x) t LEFT JOIN tr ON tr.tier = t.x GROUP BY t.x"))
def tier_by_family(spark, sf):
    levels = spark.createDataFrame([(t,) for t in ("A_le2mm", "B_le1mm", "C_exact", "D_none")], "tier string")
    table = _tiers(spark, sf).groupBy("tier").pivot("family", ["HSat2", "HSat3"]).count()
    return levels.join(table, "tier", "left").fillna(0)


_GATE = Q.gate("kmer")


def _gated(df: DataFrame) -> DataFrame:
    k = F.col("kmer")
    return df.where(K.gc_percent(k).between(25, 75) & (K.max_run(k) <= 5)).where(K.stem(k) <= 5)


@query("sequence_gate", fx.sql("c d", _CAND + f" SELECT code FROM cd WHERE {_GATE}"))
def sequence_gate(spark, sf):
    # written first: a filter on keys would go below the groups and gate each of their rows
    return _gated(written(_candidates(spark, sf).select("code", "kmer"), "candidates")).select("code")


@query("sequence_quality", fx.sql("c d", _CAND + f" SELECT code, {Q.stem('kmer')} AS stem, {Q.quality('kmer')} AS quality FROM cd"))
def sequence_quality(spark, sf):
    return _candidates(spark, sf).select("code", K.stem(F.col("kmer")).alias("stem"), F.round(K.quality(F.col("kmer")), 6).alias("quality"))


_CAT = "cat AS (SELECT DISTINCT l_partkey AS code, CASE l_returnflag WHEN 'R' THEN 'HSat2' WHEN 'A' THEN 'HSat3' ELSE 'background' END || '_' || CASE WHEN l_linestatus = 'O' THEN 'pan' ELSE 'chromosome_' || l_linenumber END AS category FROM lineitem)"


def _categories(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    family = F.when(F.col("l_returnflag") == "R", "HSat2").when(F.col("l_returnflag") == "A", "HSat3").otherwise("background")
    kind = F.when(F.col("l_linestatus") == "O", F.lit("pan")).otherwise(F.concat(F.lit("chromosome_"), F.col("l_linenumber")))
    return li.select(F.col("l_partkey").alias("code"), F.concat_ws("_", family, kind).alias("category"))


@query("category_collect", f"WITH {_CAT} SELECT code, string_agg(category, ';' ORDER BY category) AS categories FROM cat GROUP BY code")
def category_collect(spark, sf):
    return ranking.collect_categories(_categories(spark, sf), "code", "category")


@query("category_explode", f"WITH {_CAT} SELECT code, category, CASE WHEN category LIKE '%pan' THEN 'pan' ELSE 'chromosome' END AS kind, regexp_extract(category, 'chromosome_([0-9]+)', 1) AS expected FROM cat")
def category_explode(spark, sf):
    rows = ranking.explode_categories(ranking.collect_categories(_categories(spark, sf), "code", "category"))
    return rows.select("code", "category", F.when(F.col("category").endswith("pan"), "pan").otherwise("chromosome").alias("kind"), F.regexp_extract("category", "chromosome_([0-9]+)", 1).alias("expected"))


def _final(spark, sf, n: int = 72):
    rows = _scored(spark, sf).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "code").limit(n)
    return rows.select("code", "kmer", K.encode(F.col("kmer")).alias("bits"))


_TOP72 = _SCORE + ", tp AS (SELECT code, kmer FROM sc ORDER BY round(score, 9) DESC, code LIMIT 72), ed AS (SELECT a.code AS a, b.code AS b, least(hamming(a.kmer, b.kmer), hamming(a.kmer, reverse(translate(b.kmer, 'ACGT', 'TGCA')))) AS d FROM tp a JOIN tp b ON a.code < b.code WHERE least(hamming(a.kmer, b.kmer), hamming(a.kmer, reverse(translate(b.kmer, 'ACGT', 'TGCA')))) <= 6 OR " + Q.shared("a.kmer", "b.kmer") + ")"


def _edges(spark, sf):
    """Pairs of the 72 finalists within distance 6, or that share 12 bases in a row: so few rows by
    definition, compared in all."""
    t = _final(spark, sf)
    o = t.select(F.col("code").alias("b"), F.col("bits").alias("b_bits"), F.col("kmer").alias("b_kmer"))
    pairs = t.withColumnRenamed("code", "a").join(F.broadcast(o), F.col("a") < F.col("b"))
    pairs = pairs.withColumn("d", K.hamming_either(F.col("bits"), F.col("b_bits")))
    return pairs.where((F.col("d") <= 6) | K.shares_substring(F.col("kmer"), F.col("b_kmer")))


@query("similar_pairs", fx.sql("c d", _TOP72 + " SELECT a, b, d FROM ed"))
def similar_pairs(spark, sf):
    return _edges(spark, sf).select("a", "b", F.col("d").cast("long").alias("d"))


@query("similarity_components", "WITH RECURSIVE " + fx.sql("c d", _TOP72).removeprefix("WITH ") + ", bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), rc AS (SELECT code AS node, code AS reach FROM tp UNION SELECT rc.node, bo.b FROM rc JOIN bo ON bo.a = rc.reach), lb AS (SELECT node, min(reach) AS component FROM rc GROUP BY node) SELECT node, component, 'SC' || lpad(CAST(dense_rank() OVER (ORDER BY component) AS VARCHAR), 3, '0') AS label FROM lb")
def similarity_components(spark, sf):
    nodes = written(_final(spark, sf).select(F.col("code").alias("node")))
    labels = ranking.min_label_components(written(_edges(spark, sf).select("a", "b")), nodes, written)
    place = F.dense_rank().over(Window.orderBy("component"))
    return labels.select("node", "component", F.concat(F.lit("SC"), F.lpad(place.cast("string"), 3, "0")).alias("label"))


_LIKE = "len(list_filter(ch, lambda x: least(hamming(x, p.kmer), hamming(x, reverse(translate(p.kmer, 'ACGT', 'TGCA')))) <= 2 OR " + Q.shared("p.kmer", "x") + ")) > 0"
_GREEDY = _SCORE + f", gt AS (SELECT * FROM sc WHERE {_GATE}), pl AS (SELECT family, CASE WHEN type = 0 THEN 'pan' ELSE 'chromosome_' || type END AS category, code, kmer, row_number() OVER (PARTITION BY family, type ORDER BY round(score, 9) DESC, kmer) AS i FROM gt), st AS (SELECT DISTINCT family, category, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ch FROM pl UNION ALL SELECT p.family, p.category, p.i, CASE WHEN len(ch) = CASE WHEN p.category = 'pan' THEN 20 ELSE 5 END OR {_LIKE} THEN ch ELSE list_append(ch, p.kmer) END FROM st JOIN pl p ON p.family = st.family AND p.category = st.category AND p.i = st.i + 1), fin AS (SELECT family, category, arg_max(ch, i) AS ch FROM st GROUP BY 1, 2), un AS (SELECT family, category, unnest(ch) AS kmer, unnest(range(1, len(ch) + 1)) AS category_rank FROM fin)"


@query("greedy_shortlist", "WITH RECURSIVE " + fx.sql("c d", _GREEDY).removeprefix("WITH ") + " SELECT family, category, code, kmer, category_rank FROM un JOIN pl USING (family, category, kmer)")
def greedy_shortlist(spark, sf):
    rows = _gated(_scored(spark, sf)).withColumn("score", F.round("score", 9)).withColumn("category", F.when(F.col("type") == 0, "pan").otherwise(F.concat(F.lit("chromosome_"), F.col("type"))))
    out = ranking.greedy_shortlist(rows.select("code", "family", "category", "kmer", "score"), ["family", "category"], written)
    return out.select("family", "category", "code", "kmer", F.col("category_rank").cast("long").alias("category_rank"))


@query("balanced_queries")
def balanced_queries(spark, sf):
    rows = ranking.top_k(_scored(spark, sf), ["family", "type"], [F.desc("score"), F.asc("code")], 50)
    found = rows.orderBy("family", "type", "rank").select("family", "type", "code", "kmer").collect()  # six buckets of 50
    buckets: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        buckets.setdefault(f"{r['family']}/{r['type']}", []).append((r["code"], r["kmer"]))
    seeds = ranking.round_robin(list(buckets.values()))
    return spark.createDataFrame([(c,) for c in ranking.balanced_fill(seeds, buckets)], "code long")


def _points(spark, sf):
    return fx.table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("hap"), "embedding", F.col("label").cast("long").alias("label"))


@query("ari_contingency", "WITH t AS (SELECT label, vec_id % 10 AS other, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM t GROUP BY label)) AS sa, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM t GROUP BY other)) AS sb, (SELECT sum(n) FROM t) AS n) SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM x")
def ari_contingency(spark, sf):
    return rounded(cluster.adjusted_rand(_points(spark, sf).withColumn("other", F.col("hap") % 10), "label", "other"), "ari")


@query("best_match_jaccard", "WITH t AS (SELECT CAST(label AS BIGINT) AS label, vec_id % 10 AS other, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2) SELECT label, round(max(n / CAST(na + nb - n AS DOUBLE)), 6) AS jaccard FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS na, sum(n) OVER (PARTITION BY other) AS nb FROM t) GROUP BY label")
def best_match_jaccard(spark, sf):
    return rounded(cluster.best_jaccard(_points(spark, sf).withColumn("other", F.col("hap") % 10), "label", "other"), "jaccard")


@query("centroid_assign", "WITH p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY 1, 2), d AS (SELECT p.vec_id, c.label, sqrt(sum(pow(x - c, 2))) AS d FROM p JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id AS hap, arg_min(label, d) AS assigned, round(min(d), 6) AS distance FROM d GROUP BY vec_id")
def centroid_assign(spark, sf):
    p = _points(spark, sf)
    return rounded(cluster.nearest_centroid(p, p, "hap", "embedding", "label"), "distance")


def _profiles(spark, sf) -> DataFrame:
    """(region, chrom, hap, features): densities of the most variable k-mers of each case."""
    by = ["region", "chrom"]
    # read twice each; those of the chosen k-mers alone meet the grid
    c = written(fx.counts(spark, sf).where("region <> 'background'").select(*by, F.col("hap").cast("string").alias("hap"), "code", "n"), "counts", "zstd")
    haps = written(fx.den(spark, sf).where("region <> 'background' and valid_starts > 0").select(*by, F.col("hap").cast("string").alias("hap"), "valid_starts"), "haps")
    chosen = written(cluster.variable_features(c.where("hap <> '0'"), haps.where("hap <> '0'"), by, presence=0.01).select(*by, "code", "rank"), "features")
    grid = haps.join(chosen, by)
    own = c.join(chosen.drop("rank"), [*by, "code"])
    x = F.log1p(F.coalesce("n", F.lit(0)) / F.col("valid_starts") * 1e6)
    rows = grid.join(own, [*by, "hap", "code"], "left").groupBy(*by, "hap").agg(F.sort_array(F.collect_list(F.struct("rank", x.alias("x")))).alias("f"))
    return rows.select(*by, "hap", F.col("f.x").alias("features"))


@query("cluster_cases")
def cluster_cases(spark, sf):
    """Haps by family and chromosome, clustered on the densities of the most variable k-mers.
    The given tables have fewer haps in a case than the operator's 100, so 50 are enough here."""
    return cluster.cluster_cases(_profiles(spark, sf), ["region", "chrom"], reference="0", least_haps=50)


@query("cluster_details")
def cluster_details(spark, sf):
    """Axes, shares of variance, partitions and feature groups of the same cases, of 50 haps as there."""
    return cluster.case_details(_profiles(spark, sf), ["region", "chrom"], reference="0", least_haps=50)
