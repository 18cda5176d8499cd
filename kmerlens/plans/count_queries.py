"""Queries on k-mer counts: pools, enrichment, selection, sweeps, specificity, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import audit, cluster, counting, enrichment, landscape, ranking, specificity
from . import fixtures as fx
from .registry import query, rounded
from .written import written

LEVELS = [0.0, 0.5, 1.0, 1.5, 2.0]


def _pe(spark, sf):
    return enrichment.pooled_enrichment(fx.counts(spark, sf), fx.den(spark, sf), F.col("hap") == fx.REFERENCE_HAP, fx.POOLED_MIN, fx.THRESHOLD)


def _he(spark, sf):
    return enrichment.hap_enrichment(fx.counts(spark, sf), fx.den(spark, sf), fx.HAP_MIN, fx.THRESHOLD)


def _nonref(df: DataFrame) -> DataFrame:
    return df.where(F.col("hap") != fx.REFERENCE_HAP)


def _haps(spark, sf) -> DataFrame:
    return _nonref(fx.den(spark, sf).select("hap").distinct())


@query("pool_having", fx.sql("c", "SELECT code, CAST(sum(n) AS BIGINT) AS pooled, max(n) AS largest FROM (SELECT code, hap, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2) GROUP BY code HAVING sum(n) >= 800 OR max(n) >= 110"))
def pool_having(spark: SparkSession, sf: str) -> DataFrame:
    return counting.pool(fx.counts(spark, sf), 800, 110)


@query("candidate_semi_join", fx.sql("c", ", p AS (SELECT code FROM (SELECT code, hap, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY code HAVING sum(n) >= 800 OR max(n) >= 110) SELECT hap, region, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT code) AS kmers FROM c WHERE code IN (SELECT code FROM p) GROUP BY 1, 2"))
def candidate_semi_join(spark, sf):
    c = fx.counts(spark, sf)
    return counting.restrict(c, counting.pool(c, 800, 110)).groupBy("hap", "region").agg(F.sum("n").alias("n"), F.count_distinct("code").alias("kmers"))


@query("denominator_rollup", fx.sql("d", "SELECT hap, region, CAST(sum(valid_starts) AS BIGINT) AS valid_starts FROM d GROUP BY 1, 2"))
def denominator_rollup(spark, sf):
    return fx.den(spark, sf).groupBy("hap", "region").agg(F.sum("valid_starts").alias("valid_starts"))


@query("enrichment_pooled", fx.sql("c d tb", f"SELECT code, t, b, den_t, den_b, round(e, 6) AS e, round(pow(2, e), 6) AS fold, t >= {fx.POOLED_MIN} AND e > {fx.THRESHOLD} AS pooled_pass FROM pe"))
def enrichment_pooled(spark, sf):
    p = _pe(spark, sf).withColumn("fold", M.fold_change(F.col("e")))
    return rounded(p, "e", "fold")


@query("enrichment_by_hap", fx.sql("c d tb", f"SELECT code, hap, t, b, den_t, den_b, round(e, 6) AS e, t >= {fx.HAP_MIN} AND e > {fx.THRESHOLD} AS hap_pass FROM he"))
def enrichment_by_hap(spark, sf):
    return rounded(_he(spark, sf), "e")


_SEL = f""", q AS (SELECT code, count_if(t > 0) AS prevalence, count_if(t >= {fx.HAP_MIN} AND e > {fx.THRESHOLD}) AS qualifying_haps, sum(e) AS es, min(e) AS e0, max(e) AS e1, count(e) AS en FROM he WHERE hap <> 0 GROUP BY code),
mh AS (SELECT count(*) AS m FROM dt WHERE hap <> 0 AND den_t > 0 AND den_b > 0),
sel AS (SELECT pe.code, pe.t, pe.b, pe.e, t >= {fx.POOLED_MIN} AND e > {fx.THRESHOLD} AS pooled_pass, coalesce(prevalence, 0) AS prevalence, coalesce(prevalence, 0) / m AS prevalence_fraction, coalesce(qualifying_haps, 0) AS qualifying_haps, coalesce(es, 0) / m AS mean_hap_e,
  least(e0, CASE WHEN m > coalesce(en, 0) THEN 0 END) AS min_hap_e, greatest(e1, CASE WHEN m > coalesce(en, 0) THEN 0 END) AS max_hap_e FROM pe LEFT JOIN q USING (code), mh),
fin AS (SELECT *, pooled_pass OR qualifying_haps > 0 AS selected, CASE WHEN pooled_pass AND qualifying_haps > 0 THEN 'pooled_and_hap' WHEN pooled_pass THEN 'pooled' WHEN qualifying_haps > 0 THEN 'hap' ELSE 'not_selected' END AS selection_reason FROM sel)"""


def _selected(spark, sf):
    return enrichment.selection(_pe(spark, sf), _he(spark, sf), fx.den(spark, sf), F.col("hap") == fx.REFERENCE_HAP)


@query("selection", fx.sql("c d tb", _SEL + " SELECT code, t, b, round(e, 6) AS e, pooled_pass, prevalence, round(prevalence_fraction, 6) AS prevalence_fraction, qualifying_haps, round(mean_hap_e, 6) AS mean_hap_e, round(min_hap_e, 6) AS min_hap_e, round(max_hap_e, 6) AS max_hap_e, selected, selection_reason FROM fin"))
def selection(spark, sf):
    return rounded(_selected(spark, sf).drop("den_t", "den_b"), "e", "prevalence_fraction", "mean_hap_e", "min_hap_e", "max_hap_e")


@query("selection_reasons", fx.sql("c d tb", _SEL + " SELECT selection_reason, count(*) AS kmers, count_if(prevalence >= 10) AS prevalent FROM fin GROUP BY 1"))
def selection_reasons(spark, sf):
    return _selected(spark, sf).groupBy("selection_reason").agg(F.count("*").alias("kmers"), F.count_if(F.col("prevalence") >= 10).alias("prevalent"))


@query("broad_flags", fx.sql("c d tb", _SEL + ", nh AS (SELECT count(*) AS n FROM dt WHERE hap <> 0) SELECT code, pooled_pass, qualifying_haps, pooled_pass AND qualifying_haps >= ceil(0.05 * n) AS broad FROM fin, nh"))
def broad_flags(spark, sf):
    haps = _haps(spark, sf).count()
    return enrichment.broad(_selected(spark, sf), haps, 0.05).select("code", "pooled_pass", "qualifying_haps", "broad")


_LV = "(SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS threshold)"
_SWEEP = f""", lo AS (SELECT code, threshold, count(*) AS haps FROM he, {_LV} WHERE hap <> 0 AND t >= {fx.HAP_MIN} AND e > threshold GROUP BY 1, 2),
pr AS (SELECT pe.code, t, b, e, l.threshold, coalesce(haps, 0) AS haps, t >= {fx.POOLED_MIN} AND e > l.threshold AS p, coalesce(haps, 0) > 0 AS h FROM pe CROSS JOIN {_LV} l LEFT JOIN lo ON lo.code = pe.code AND lo.threshold = l.threshold),
rt AS (SELECT *, 'pooled' AS route FROM pr WHERE p UNION ALL SELECT *, 'hap_only' FROM pr WHERE h AND NOT p UNION ALL SELECT *, 'union' FROM pr WHERE p OR h)"""


def _sweep(spark, sf):
    return enrichment.sweep(_pe(spark, sf), _nonref(_he(spark, sf)), LEVELS, fx.POOLED_MIN, fx.HAP_MIN, 3)


@query("threshold_sweep", fx.sql("c d tb", _SWEEP + " SELECT threshold, route, count(*) AS kmers, count_if(b = 0) AS zero_background, count_if(haps >= 3) AS broad, round(quantile_cont(t, 0.5), 6) AS median_target, round(quantile_cont(e, 0.5), 6) AS median_e FROM rt GROUP BY 1, 2"))
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf), "median_target", "median_e")


@query("local_threshold_counts", fx.sql("c d tb", f"SELECT code, threshold, count(*) AS haps FROM he, {_LV} WHERE hap <> 0 AND t >= {fx.HAP_MIN} AND e > threshold GROUP BY 1, 2"))
def local_threshold_counts(spark, sf):
    return enrichment.local_counts(_nonref(_he(spark, sf)), LEVELS, fx.HAP_MIN)


@query("matrix_a", fx.sql("c d", ", v AS (SELECT hap, sum(valid_starts) AS v FROM d WHERE region <> 'background' GROUP BY hap) SELECT code, hap, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n) AS DOUBLE) / any_value(v) * 1e6, 6) AS density FROM c JOIN v USING (hap) WHERE region <> 'background' GROUP BY 1, 2"))
def matrix_a(spark, sf):
    return rounded(specificity.matrix_a(fx.counts(spark, sf), fx.den(spark, sf)), "density")


@query(
    "matrix_b_pivot",
    fx.sql("c d", ", v AS (SELECT hap, region, sum(valid_starts) AS v FROM d WHERE region <> 'background' GROUP BY 1, 2), g AS (SELECT code, hap, region, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS DOUBLE) / any_value(v) * 1e6 AS dens FROM c JOIN v USING (hap, region) GROUP BY 1, 2, 3) SELECT code, hap, CAST(sum(n) FILTER (region = 'HSat2') AS BIGINT) AS \"HSat2_n\", round(sum(dens) FILTER (region = 'HSat2'), 6) AS \"HSat2_density\", CAST(sum(n) FILTER (region = 'HSat3') AS BIGINT) AS \"HSat3_n\", round(sum(dens) FILTER (region = 'HSat3'), 6) AS \"HSat3_density\" FROM g GROUP BY 1, 2"),
)
def matrix_b_pivot(spark, sf):
    return rounded(specificity.matrix_b(fx.counts(spark, sf), fx.den(spark, sf)), "HSat2_density", "HSat3_density")


_CELLS = [(r, s) for r in ("HSat2", "HSat3", "background") for s in (0, 1)]


@query("wide_export", fx.sql("c d", ", wv AS (SELECT region, sum(valid_starts) AS v FROM d WHERE hap = 1 GROUP BY region) SELECT code, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (region = '{r}' AND chrom % 2 = {s}), 0) AS BIGINT) AS {r.lower()}_{s}" for r, s in _CELLS) + ", " + ", ".join(f"round(coalesce(sum(n) FILTER (region = '{r}'), 0) / CAST((SELECT v FROM wv WHERE region = '{r}') AS DOUBLE) * 1e6, 6) AS {r.lower()}_density" for r in ("HSat2", "HSat3", "background")) + " FROM c WHERE hap = 1 GROUP BY code"))
def wide_export(spark, sf):
    """One hap's counts by region and strand, and densities by region, as one wide row for each k-mer."""
    rows = fx.counts(spark, sf).where("hap = 1").withColumn("cell", F.concat(F.lower("region"), F.lit("_"), F.col("chrom") % 2))
    wide = rows.groupBy("code").pivot("cell", [f"{r.lower()}_{s}" for r, s in _CELLS]).sum("n").fillna(0)
    starts = fx.den(spark, sf).where("hap = 1").groupBy().pivot("region", ["HSat2", "HSat3", "background"]).sum("valid_starts")
    starts = starts.select(*(F.col(r).alias(f"v_{r.lower()}") for r in ("HSat2", "HSat3", "background")))
    per = [F.round(M.per_million(F.col(f"{r}_0") + F.col(f"{r}_1"), F.col(f"v_{r}")), 6).alias(f"{r}_density") for r in ("hsat2", "hsat3", "background")]
    return wide.crossJoin(F.broadcast(starts)).select(*wide.columns, *per)  # one row


_FAM = """, lv AS (SELECT hap, sum(valid_starts) FILTER (region = 'HSat2') AS v0, sum(valid_starts) FILTER (region = 'HSat3') AS v1 FROM d WHERE hap <> 0 GROUP BY hap),
al AS (SELECT sum(v0) AS a0, sum(v1) AS a1 FROM lv),
lc AS (SELECT code, hap, coalesce(sum(n) FILTER (region = 'HSat2'), 0) AS n0, coalesce(sum(n) FILTER (region = 'HSat3'), 0) AS n1 FROM c WHERE hap <> 0 GROUP BY 1, 2 HAVING coalesce(sum(n) FILTER (region <> 'background'), 0) > 0),
le AS (SELECT lc.*, v0, v1, n0 + n1 AS t, log2((CAST(n0 AS DOUBLE) / CASE WHEN v0 > 0 THEN v0 END + 1e-9) / (CAST(n1 AS DOUBLE) / CASE WHEN v1 > 0 THEN v1 END + 1e-9)) AS e FROM lc LEFT JOIN lv USING (hap))"""


@query(
    "family_metrics",
    fx.sql("c d", _FAM + " SELECT code, CAST(sum(n0) AS BIGINT) AS n_h2, CAST(sum(n1) AS BIGINT) AS n_h3, round(CAST(sum(n0) AS DOUBLE) / sum(n0 + n1), 6) AS share_h2, round(CAST(sum(n0) AS DOUBLE) / a0 * 1e6, 6) AS density_h2, round(CAST(sum(n1) AS DOUBLE) / a1 * 1e6, 6) AS density_h3, round(log2((CAST(sum(n0) AS DOUBLE) / a0 + 1e-9) / (CAST(sum(n1) AS DOUBLE) / a1 + 1e-9)), 6) AS family_log2, count(*) AS prevalence, count_if(t >= 10) AS prevalence_10, count_if(t >= 100) AS prevalence_100, count_if(n0 > 0) AS prevalence_h2, count_if(n1 > 0) AS prevalence_h3, count_if(v0 > 0 AND v1 > 0) AS informative, count_if(e > 0) AS favored_h2, count_if(e < 0) AS favored_h3 FROM le, al GROUP BY code, a0, a1"),
)
def family_metrics(spark, sf):
    out = specificity.family_metrics(_nonref(fx.counts(spark, sf)), _nonref(fx.den(spark, sf)))
    return rounded(out, "share_h2", "density_h2", "density_h3", "family_log2")


def _targets(spark, sf):
    return specificity.matrix_a(_nonref(fx.counts(spark, sf)), _nonref(fx.den(spark, sf)))


_GRID = ", v AS (SELECT hap, sum(valid_starts) AS v FROM d WHERE region <> 'background' AND hap <> 0 GROUP BY hap), nh AS (SELECT DISTINCT hap FROM d WHERE hap <> 0), t AS (SELECT code, hap, CAST(sum(n) AS BIGINT) AS n FROM c WHERE region <> 'background' AND hap <> 0 GROUP BY 1, 2), ts AS (SELECT t.code, t.hap, n, CAST(n AS DOUBLE) / v * 1e6 AS dens FROM t JOIN v USING (hap)), g AS (SELECT k.code, nh.hap, coalesce(ts.n, 0) AS n, coalesce(ts.dens, 0) AS dens FROM (SELECT DISTINCT code FROM t) k CROSS JOIN nh LEFT JOIN ts ON ts.code = k.code AND ts.hap = nh.hap)"


@query("count_quantiles", fx.sql("c d", _GRID + " SELECT code, round(quantile_cont(n, 0.1), 6) AS q10, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.9), 6) AS q90 FROM g GROUP BY code"))
def count_quantiles(spark, sf):
    values = _targets(spark, sf).select("code", "hap", F.col("n").alias("value"))
    return rounded(specificity.quantiles(values, _haps(spark, sf)), "q10", "q50", "q90")


@query("density_cv", fx.sql("c d", _GRID + " SELECT code, round(avg(dens), 6) AS mean_density, round(stddev_pop(dens) / avg(dens), 6) AS cv FROM g GROUP BY code"))
def density_cv(spark, sf):
    values = _targets(spark, sf).select("code", "hap", F.col("density").alias("value"))
    return rounded(specificity.density_cv(values, _haps(spark, sf)), "mean_density", "cv")


_DOM = """, pn AS (SELECT code, region, chrom, CAST(sum(n) AS BIGINT) AS n FROM u WHERE hap <> 0 GROUP BY 1, 2, 3), pv AS (SELECT region, chrom, sum(valid_starts) AS v FROM ud WHERE hap <> 0 GROUP BY 1, 2),
pr AS (SELECT pn.*, CAST(n AS DOUBLE) / CASE WHEN v > 0 THEN v END * 1e6 AS dens FROM pn LEFT JOIN pv USING (region, chrom)),
pm AS (SELECT *, max(n) OVER w AS mn, sum(n) OVER w AS tn, max(dens) OVER w AS md, sum(dens) OVER w AS td FROM pr WINDOW w AS (PARTITION BY code, region)),
dm AS (SELECT code, region, min(chrom) FILTER (n = mn) AS best, count_if(n = mn) > 1 AS tied FROM pm GROUP BY 1, 2)"""


@query(
    "chromosome_specificity",
    fx.sql("c d u", _DOM + " SELECT code, region, min(chrom) FILTER (n = mn) AS count_chrom, count_if(n = mn) > 1 AS count_tied, round(CAST(max(n) AS DOUBLE) / any_value(tn), 6) AS count_share, CAST(any_value(tn) AS BIGINT) AS total, min(chrom) FILTER (dens = md) AS density_chrom, count_if(dens = md) > 1 AS density_tied, round(max(dens) / any_value(td), 6) AS density_share, round(0 - sum(CAST(n AS DOUBLE) / tn * log2(CAST(n AS DOUBLE) / tn)), 6) AS entropy FROM pm GROUP BY 1, 2"),
)
def chromosome_specificity(spark, sf):
    out = specificity.chromosome_specificity(_nonref(fx.counts(spark, sf)), _nonref(fx.den(spark, sf)), F.col("chrom"))
    return rounded(out, "count_share", "density_share", "entropy")


@query(
    "chromosome_recurrence",
    fx.sql("c d u", _DOM + ", hn AS (SELECT code, region, hap, chrom, n, max(n) OVER (PARTITION BY code, region, hap) AS m FROM u WHERE hap <> 0), ho AS (SELECT code, region, hap, CASE WHEN count_if(n = m) = 1 THEN min(chrom) FILTER (n = m) END AS own FROM hn GROUP BY 1, 2, 3), ms AS (SELECT hap, region, chrom FROM ud WHERE hap <> 0 AND valid_starts > 0), mc AS (SELECT hap, region, count(*) AS k FROM ms GROUP BY 1, 2), j AS (SELECT ho.code, ho.region, ho.own, dm.best, (ms.hap IS NOT NULL) AND mc.k >= 2 AND NOT dm.tied AS inf FROM ho JOIN dm USING (code, region) JOIN mc ON mc.hap = ho.hap AND mc.region = ho.region LEFT JOIN ms ON ms.hap = ho.hap AND ms.region = ho.region AND ms.chrom = dm.best) SELECT code, region, count_if(inf) AS informative, count_if(inf AND coalesce(own = best, FALSE)) AS support, round(CASE WHEN count_if(inf) > 0 THEN CAST(count_if(inf AND coalesce(own = best, FALSE)) AS DOUBLE) / count_if(inf) END, 6) AS recurrence FROM j GROUP BY 1, 2"),
)
def chromosome_recurrence(spark, sf):
    return rounded(specificity.recurrence(_nonref(fx.counts(spark, sf)), _nonref(fx.den(spark, sf)), F.col("chrom")), "recurrence")


@query("coverage", fx.sql("d", "SELECT chrom, count(DISTINCT hap) AS available, count(DISTINCT hap) FILTER (region = 'HSat2' AND valid_starts > 0) AS measurable_h2, count(DISTINCT hap) FILTER (region = 'HSat3' AND valid_starts > 0) AS measurable_h3 FROM d GROUP BY chrom"))
def coverage(spark, sf):
    return specificity.coverage(fx.den(spark, sf))


def _grid(spark, sf):
    d = fx.den(spark, sf)
    haps = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hap"))
    return specificity.availability_grid(d, haps, d.select("chrom").distinct())


_AV = ", g AS (SELECT s_suppkey AS hap, chrom, region FROM supplier, (SELECT DISTINCT chrom FROM d), (SELECT unnest(['HSat2', 'HSat3']) AS region)), a AS (SELECT DISTINCT hap, chrom FROM d), gr AS (SELECT g.hap, g.chrom, g.region, CASE WHEN a.hap IS NULL THEN 0 ELSE 1 END AS available, CASE WHEN a.hap IS NOT NULL THEN coalesce(d.valid_starts, 0) END AS valid_starts FROM g LEFT JOIN a ON a.hap = g.hap AND a.chrom = g.chrom LEFT JOIN d ON d.hap = g.hap AND d.chrom = g.chrom AND d.region = g.region)"


@query("availability_grid", fx.sql("d", _AV + " SELECT * FROM gr"))
def availability_grid(spark, sf):
    return _grid(spark, sf)


@query("point_lookup", fx.sql("c d", _AV + " SELECT gr.hap, gr.chrom, gr.region, available, valid_starts, CASE WHEN available = 1 THEN coalesce(n, 0) END AS n, round(CASE WHEN valid_starts > 0 THEN coalesce(n, 0) / CAST(valid_starts AS DOUBLE) * 1e6 END, 6) AS density FROM gr LEFT JOIN (SELECT * FROM c WHERE code = 7) k ON k.hap = gr.hap AND k.chrom = gr.chrom AND k.region = gr.region"))
def point_lookup(spark, sf):
    c = fx.counts(spark, sf)
    return rounded(specificity.export_rows(_grid(spark, sf), counting.lookup(c, "code", 7, c), 7), "density")


@query("hap_qc", fx.sql("c", "SELECT hap, hap = 0 AS is_reference, count(DISTINCT chrom) AS chromosomes, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - coalesce(sum(n) FILTER (region = 'HSat2'), 0) - coalesce(sum(n) FILTER (region = 'HSat3'), 0) AS BIGINT) AS residual FROM c GROUP BY hap"))
def hap_qc(spark, sf):
    part = lambda r: F.coalesce(F.sum(F.when(F.col("region") == r, F.col("n"))), F.lit(0))
    return fx.counts(spark, sf).groupBy("hap").agg((F.first("hap") == 0).alias("is_reference"), F.count_distinct("chrom").alias("chromosomes"), F.sum("n").alias("total"), (F.sum("n") - part("HSat2") - part("HSat3")).alias("residual"))


@query("hap_totals", fx.sql("c d tb", "SELECT hap, CAST(sum(t) AS BIGINT) AS hits, any_value(den_t) AS windows, round(CAST(sum(t) AS DOUBLE) / any_value(den_t) * 1e6, 6) AS density, CAST(sum(t) + sum(b) AS BIGINT) AS union_and_background FROM he GROUP BY hap"))
def hap_totals(spark, sf):
    out = _he(spark, sf).groupBy("hap").agg(F.sum("t").alias("hits"), F.first("den_t").alias("windows"), (F.sum("t") + F.sum("b")).alias("union_and_background"))
    return rounded(out.withColumn("density", M.per_million(F.col("hits"), F.col("windows"))), "density")


@query("hap_order", fx.sql("d", "SELECT hap, row_number() OVER (ORDER BY hap = 0, hap) AS place FROM (SELECT DISTINCT hap FROM d)"))
def hap_order(spark, sf):
    from pyspark.sql import Window

    return fx.den(spark, sf).select("hap").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col("hap") == 0, "hap")).cast("long"))


_GROUP = ", gg AS (SELECT code, hap, hap % 3 AS grp, n, dens FROM g)"


def _contrast(spark, sf):
    """Each third of the haps against the others, on the counts that occur."""
    rows = _targets(spark, sf).withColumn("grp", F.col("hap") % 3)
    return landscape.group_contrast(rows, _haps(spark, sf).select((F.col("hap") % 3).alias("grp")), ["code"], "grp")


@query(
    "group_contrast",
    fx.sql("c d", _GRID + _GROUP + ", gs AS (SELECT DISTINCT grp AS k FROM gg), r AS (SELECT code, k AS grp, avg(CAST(n >= 10 AS INT)) FILTER (grp = k) AS ip, avg(CAST(n >= 10 AS INT)) FILTER (grp <> k) AS op, quantile_cont(dens, 0.5) FILTER (grp = k) AS im, quantile_cont(dens, 0.5) FILTER (grp <> k) AS om FROM gg, gs GROUP BY 1, 2) SELECT code, grp, round(ip, 6) AS in_presence, round(op, 6) AS out_presence, round(im, 6) AS in_median, round(om, 6) AS out_median, round(log2((im + 0.001) / (om + 0.001)), 6) AS log2_contrast FROM r"),
)
def group_contrast(spark, sf):
    return rounded(_contrast(spark, sf), "in_presence", "out_presence", "in_median", "out_median", "log2_contrast")


@query(
    "group_markers",
    fx.sql("c d", _GRID + _GROUP + ", gs AS (SELECT DISTINCT grp AS k FROM gg), r AS (SELECT code, k AS grp, avg(CAST(n >= 10 AS INT)) FILTER (grp = k) AS ip, avg(CAST(n >= 10 AS INT)) FILTER (grp <> k) AS op, quantile_cont(dens, 0.5) FILTER (grp = k) AS im, quantile_cont(dens, 0.5) FILTER (grp <> k) AS om FROM gg, gs GROUP BY 1, 2), fo AS (SELECT code FROM c WHERE hap <> 0 AND region IN ('HSat2', 'HSat3') GROUP BY code HAVING CAST(coalesce(sum(n) FILTER (region = 'HSat2'), 0) AS DOUBLE) / sum(n) >= 0.5) SELECT code, grp, CASE WHEN op <= 0.2 THEN 'specific' ELSE 'enriched' END AS kind FROM r WHERE ip >= 0.2 AND log2((im + 0.001) / (om + 0.001)) >= 0 AND code IN (SELECT code FROM fo)"),
)
def group_markers(spark, sf):
    family = _share(spark, sf).where("share_h2 >= 0.5").select("code")
    return landscape.markers(_contrast(spark, sf), family, presence=0.2, log2=0.0).select("code", "grp", "kind")


@query("group_chromosome_summary", fx.sql("c d", ", t AS (SELECT hap, chrom, CAST(sum(n) AS BIGINT) AS n FROM c WHERE region <> 'background' AND hap <> 0 GROUP BY 1, 2), v AS (SELECT hap, chrom, sum(valid_starts) AS v FROM d WHERE region <> 'background' AND hap <> 0 GROUP BY 1, 2), j AS (SELECT v.hap % 3 AS grp, v.chrom, coalesce(n, 0) AS n, v, CAST(coalesce(n, 0) AS DOUBLE) / v * 1e6 AS dens FROM v LEFT JOIN t USING (hap, chrom)) SELECT grp, chrom, count(*) AS haps, round(quantile_cont(dens, 0.5), 6) AS median_density, round(avg(dens), 6) AS mean_density, round(CAST(sum(n) AS DOUBLE) / sum(v) * 1e6, 6) AS pooled_density, round(avg(CAST(n >= 10 AS INT)), 6) AS presence FROM j GROUP BY 1, 2"))
def group_chromosome_summary(spark, sf):
    targets = lambda df, n: _nonref(df).where("region <> 'background'").groupBy("hap", "chrom").agg(F.sum(n).alias(n))
    rows = targets(fx.den(spark, sf), "valid_starts").join(targets(fx.counts(spark, sf), "n"), ["hap", "chrom"], "left").fillna(0, ["n"]).withColumn("grp", F.col("hap") % 3)
    return rounded(landscape.group_summary(rows, ["grp", "chrom"]), "median_density", "mean_density", "pooled_density", "presence")


_SHARE = _FAM + ", sh AS (SELECT code, CAST(sum(n0) AS DOUBLE) / sum(n0 + n1) AS v FROM le GROUP BY code)"


def _share(spark, sf):
    return specificity.family_metrics(_nonref(fx.counts(spark, sf)), _nonref(fx.den(spark, sf)))


@query("histogram_share", fx.sql("c d", _SHARE + ", b AS (SELECT CAST(least(floor((v - 0) / ((1.0 - 0) / 20))::INT + 1, 20) AS INT) AS bin, count(*) AS n FROM sh GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, round((r.range - 0.5) * 0.05, 6) AS midpoint, coalesce(n, 0) AS n FROM range(1, 21) r LEFT JOIN b ON b.bin = r.range"))
def histogram_share(spark, sf):
    return rounded(landscape.histogram(_share(spark, sf), "share_h2", 0.0, 1.0, 20), "midpoint")


@query("histogram_data_driven", fx.sql("c d tb", ", lim AS (SELECT floor(min(e)) AS lo, ceil(max(e)) + 1e-6 AS hi FROM pe), b AS (SELECT CAST(least(floor((e - lo) / ((hi - lo) / 100))::INT + 1, 100) AS INT) AS bin, count(*) AS n FROM pe, lim GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, round(lo + (r.range - 0.5) * ((hi - lo) / 100), 6) AS midpoint, coalesce(n, 0) AS n FROM range(1, 101) r CROSS JOIN lim LEFT JOIN b ON b.bin = r.range"))
def histogram_data_driven(spark, sf):
    p = _pe(spark, sf)
    lim = p.agg(F.floor(F.min("e")), F.ceil(F.max("e"))).first()
    return rounded(landscape.histogram(p, "e", float(lim[0]), float(lim[1]) + 1e-6, 100), "midpoint")


@query("scatter_sample", fx.sql("c d tb", "SELECT code, round(log10(CAST(t AS DOUBLE) / den_t + 1e-9), 6) AS target, round(log10(CAST(b AS DOUBLE) / den_b + 1e-9), 6) AS background FROM pe ORDER BY md5(CAST(code AS VARCHAR) || ':42'), code LIMIT 500"))
def scatter_sample(spark, sf):
    s = landscape.sample(_pe(spark, sf), "code", 500)
    log = lambda n, d: F.log10(M.density(F.col(n), F.col(d)) + 1e-9)
    return rounded(s.select("code", log("t", "den_t").alias("target"), log("b", "den_b").alias("background")), "target", "background")


@query("summary_key_values", fx.sql("c d tb", "SELECT 'kmers' AS key, count(*) AS value FROM pe UNION ALL SELECT 'target', CAST(sum(t) AS BIGINT) FROM pe UNION ALL SELECT 'background', CAST(sum(b) AS BIGINT) FROM pe"))
def summary_key_values(spark, sf):
    one = _pe(spark, sf).agg(F.count("*").alias("kmers"), F.sum("t").alias("target"), F.sum("b").alias("background"))
    return one.unpivot([], ["kmers", "target", "background"], "key", "value")


@query("heatmap_pivot", fx.sql("d", "SELECT hap, " + ", ".join(f"round(log10(1 + sum(valid_starts) FILTER (chrom = {c} AND region = 'HSat2')), 6) AS \"{c}\"" for c in range(1, 8)) + " FROM d GROUP BY hap"))
def heatmap_pivot(spark, sf):
    rows = fx.den(spark, sf).withColumn("v", F.when(F.col("region") == "HSat2", F.col("valid_starts")))
    wide = rows.groupBy("hap").pivot("chrom", list(range(1, 8))).sum("v")
    return wide.select("hap", *(F.round(F.log10(1 + F.col(str(c))), 6).alias(str(c)) for c in range(1, 8)))


@query("top_profiles", fx.sql("c", ", p AS (SELECT region, code, CAST(sum(n) AS BIGINT) AS n FROM c WHERE hap <> 0 AND region <> 'background' GROUP BY 1, 2), t AS (SELECT DISTINCT code FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, code) AS r FROM p) WHERE r <= 15), q AS (SELECT code, chrom, CAST(sum(n) AS BIGINT) AS n FROM c WHERE hap <> 0 AND region <> 'background' AND code IN (SELECT code FROM t) GROUP BY 1, 2) SELECT code, chrom, n, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY code), 6) AS scaled FROM q"))
def top_profiles(spark, sf):
    from pyspark.sql import Window

    c = _nonref(fx.counts(spark, sf)).where("region <> 'background'")
    best = ranking.top_k(c.groupBy("region", "code").agg(F.sum("n").alias("n")), ["region"], [F.desc("n"), F.asc("code")], 15).select("code").distinct()
    rows = counting.restrict(c, best).groupBy("code", "chrom").agg(F.sum("n").alias("n"))
    return rounded(rows.withColumn("scaled", M.ratio(F.col("n"), F.max("n").over(Window.partitionBy("code")))), "scaled")


@query("feature_variance", fx.sql("c d", ", v AS (SELECT hap, sum(valid_starts) AS v FROM d WHERE region = 'HSat2' AND hap <> 0 GROUP BY hap), h AS (SELECT count(*) AS k FROM v), t AS (SELECT code, hap, sum(n) AS n FROM c WHERE region = 'HSat2' AND hap <> 0 GROUP BY 1, 2), x AS (SELECT code, n, ln(1 + CAST(n AS DOUBLE) / v * 1e6) AS x FROM t JOIN v USING (hap)), r AS (SELECT code, CAST(count_if(n >= 10) AS DOUBLE) / k AS presence, sum(x * x) / k - pow(sum(x) / k, 2) AS variance FROM x, h GROUP BY code, k) SELECT code, round(presence, 6) AS presence, round(variance, 6) AS variance FROM r WHERE presence >= 0.05 AND variance > 1e-4"))
def feature_variance(spark, sf):
    c = _nonref(fx.counts(spark, sf)).where("region = 'HSat2'").groupBy("region", "code", "hap").agg(F.sum("n").alias("n"))
    haps = _nonref(fx.den(spark, sf)).where("region = 'HSat2'").groupBy("region", "hap").agg(F.sum("valid_starts").alias("valid_starts"))
    return rounded(cluster.variable_features(c, haps, ["region"], most=10**9).select("code", "presence", "variance"), "presence", "variance")


@query("feature_pool", fx.sql("c", ", p AS (SELECT region, code, CAST(sum(n) AS BIGINT) AS n FROM c WHERE hap <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, code) - 1 AS r, count(*) OVER (PARTITION BY region) AS m FROM p), js AS (SELECT range AS j FROM range(0, 50)), sy AS (SELECT DISTINCT region, 50 + CAST(floor(j * ((m - 50 - 1) / 49.0) + 1e-9) AS BIGINT) AS r FROM (SELECT DISTINCT region, m FROM r), js) SELECT region, code, n, CASE WHEN r.r < 50 THEN 'common' ELSE 'systematic' END AS route FROM r WHERE r.r < 50 OR EXISTS (SELECT 1 FROM sy WHERE sy.region = r.region AND sy.r = r.r)"))
def feature_pool(spark, sf):
    p = _nonref(fx.counts(spark, sf)).groupBy("region", "code").agg(F.sum("n").alias("n"))
    return ranking.systematic_pool(p, ["region"], 100, [F.desc("n"), F.asc("code")])


@query(
    "audit_counts",
    fx.sql("c d tb", _SWEEP + ", k AS (SELECT threshold, route, count(*) AS n FROM rt GROUP BY 1, 2), mo AS (SELECT *, lag(n) OVER (PARTITION BY route ORDER BY threshold) AS b FROM k WHERE route <> 'hap_only') SELECT 'sweep_monotonic' AS \"check\", count_if(n > b) AS violations FROM mo UNION ALL SELECT 'unique_keys', (SELECT count(*) FROM (SELECT code, hap, chrom, region FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)) UNION ALL SELECT 'code_totals', (SELECT count(*) FROM (SELECT code, sum(n) AS n FROM c GROUP BY code) a FULL JOIN (SELECT l_partkey AS code, sum(l_quantity) AS n FROM lineitem GROUP BY 1) b USING (code) WHERE a.n IS DISTINCT FROM b.n) UNION ALL SELECT 'pool_recomputed', (SELECT count(*) FROM (SELECT code FROM (SELECT code, hap, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY code HAVING sum(n) >= 800 OR max(n) >= 110) a FULL JOIN (SELECT DISTINCT code FROM (SELECT code, sum(n) OVER (PARTITION BY code) AS p, sum(n) OVER (PARTITION BY code, hap) AS h FROM c) WHERE p >= 800 OR h >= 110) b USING (code) WHERE a.code IS NULL OR b.code IS NULL) UNION ALL SELECT 'selection_recomputed', 0 UNION ALL SELECT 'matrix_recomputed', 0 UNION ALL SELECT 'union_covers_parts', (SELECT count(*) FROM (SELECT code, hap, coalesce(sum(n) FILTER (region <> 'background'), 0) AS u, coalesce(sum(n) FILTER (region = 'HSat2'), 0) + coalesce(sum(n) FILTER (region = 'HSat3'), 0) AS p FROM c GROUP BY 1, 2) WHERE u < p) UNION ALL SELECT 'shards_complete', (SELECT count(*) FROM (SELECT DISTINCT hap FROM d) a WHERE hap NOT IN (SELECT hap FROM c))"),
)
def audit_counts(spark, sf):
    # read by all checks; what the sweep tells beside the number of k-mers, none of them asks for
    c, d = written(fx.counts(spark, sf), "counts"), written(fx.den(spark, sf), "den")
    pooled = enrichment.pooled_enrichment(c, d, F.col("hap") == fx.REFERENCE_HAP, fx.POOLED_MIN, fx.THRESHOLD)
    by_hap = written(enrichment.hap_enrichment(c, d, fx.HAP_MIN, fx.THRESHOLD), "by-hap")
    routes = enrichment.sweep_routes(pooled, _nonref(by_hap), LEVELS, fx.POOLED_MIN, fx.HAP_MIN)
    kmers = routes.groupBy("threshold", "route").agg(F.count("*").alias("kmers"))
    return audit.violations(
        {
            "sweep_monotonic": audit.not_monotonic(kmers.where("route <> 'hap_only'"), ["route"], "threshold", "kmers"),
            "unique_keys": audit.repeated_keys(c, ["code", "hap", "chrom", "region"]),
            # the table against its source, and each result against a plan of another shape
            "code_totals": audit.totals_differ(c, fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_quantity").cast("long").alias("n")), ["code"]),
            "pool_recomputed": audit.sets_differ(counting.pool(c, 800, 110).select("code"), audit.pool_by_windows(c, 800, 110).select("code")),
            "selection_recomputed": audit.sets_differ(by_hap.where("hap_pass").select("code", "hap"), audit.enriched_by_logs(c, d, fx.HAP_MIN, fx.THRESHOLD)),
            "matrix_recomputed": audit.sets_differ(specificity.matrix_a(_nonref(c), _nonref(d)).select("code", "hap", F.col("n").cast("long")), _nonref(c).where("region <> 'background'").rollup("code", "hap").agg(F.sum("n").alias("n")).where("hap is not null")),
            "union_covers_parts": audit.union_below_parts(specificity.with_union(c).where("region = 'HSat23'"), c, ["code", "hap"]),
            "shards_complete": audit.missing_shards(d.select("hap").distinct(), c),
        }
    )
