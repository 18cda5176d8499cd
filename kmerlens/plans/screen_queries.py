"""Queries that screen candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screens, specificity
from . import fixtures as fx
from .count_queries import _DOM, _FAM, _pe
from .registry import query

#: All haps but the reference.
OTHERS = f"hap <> {fx.REFERENCE_HAP}"


def _family(spark, sf):
    m = specificity.family_metrics(fx.counts(spark, sf).where(OTHERS), fx.den(spark, sf).where(OTHERS))
    return m.join(_pe(spark, sf).select("code", "t", "b", "e"), "code")


_F = _FAM + ", fm AS (SELECT code, CAST(sum(n0) AS DOUBLE) / sum(n0 + n1) AS share, log2((CAST(sum(n0) AS DOUBLE) / a0 + 1e-9) / (CAST(sum(n1) AS DOUBLE) / a1 + 1e-9)) AS fl, count_if(t >= 10) AS h10 FROM le, al GROUP BY code, a0, a1), fe AS (SELECT fm.*, pe.t AS pt, pe.b, pe.e FROM fm JOIN pe USING (code))"


@query("family_screen", fx.sql("c d tb", _F + " SELECT code, coalesce(share >= 0.6 AND fl > 0.5 AND e > 0.2, FALSE) AS family_ok, coalesce(share >= 0.7 AND fl > 0.4 AND e > 0.4 AND h10 >= 8, FALSE) AS strict FROM fe"))
def family_screen(spark, sf):
    c = F.col
    ok = screens.family_ok(c("share_h2"), c("family_log2"), c("e"), 0.6, 0.5, 0.2)
    strict = screens.strict(c("share_h2"), c("family_log2"), c("e"), c("prevalence_10"), 8, 0.7, 0.4)
    return _family(spark, sf).select("code", ok.alias("family_ok"), strict.alias("strict"))


@query("selective_funnel", fx.sql("c d tb", _F + ", fl AS (SELECT pt >= 100 AND e > 0 AS p, h10 >= 6 AS q, share >= 0.6 AS r FROM fe) SELECT 'pooled' AS step, count_if(coalesce(p, FALSE)) AS kmers FROM fl UNION ALL SELECT 'broad', count_if(coalesce(p AND q, FALSE)) FROM fl UNION ALL SELECT 'strict', count_if(coalesce(p AND q AND r, FALSE)) FROM fl"))
def selective_funnel(spark, sf):
    c = F.col
    rows = screens.funnel(_family(spark, sf), {"pooled": (c("t") >= 100) & (c("e") > 0), "broad": c("prevalence_10") >= 6, "strict": c("share_h2") >= 0.6})
    return screens.funnel_counts(rows, ["pooled", "broad", "strict"])


@query("chromosome_screen", fx.sql("c d u", _DOM + ", hn AS (SELECT code, region, hap, chrom, n, max(n) OVER (PARTITION BY code, region, hap) AS m FROM u WHERE hap <> 0), ho AS (SELECT code, region, hap, CASE WHEN count_if(n = m) = 1 THEN min(chrom) FILTER (n = m) END AS own FROM hn GROUP BY 1, 2, 3), ms AS (SELECT hap, region, chrom FROM ud WHERE hap <> 0 AND valid_starts > 0), mc AS (SELECT hap, region, count(*) AS k FROM ms GROUP BY 1, 2), j AS (SELECT ho.code, ho.region, ho.own, dm.best, (ms.hap IS NOT NULL) AND mc.k >= 2 AND NOT dm.tied AS inf FROM ho JOIN dm USING (code, region) JOIN mc ON mc.hap = ho.hap AND mc.region = ho.region LEFT JOIN ms ON ms.hap = ho.hap AND ms.region = ho.region AND ms.chrom = dm.best), rr AS (SELECT code, region, count_if(inf) AS i, count_if(inf AND coalesce(own = best, FALSE)) AS s FROM j GROUP BY 1, 2), sp AS (SELECT code, region, CAST(max(n) AS DOUBLE) / any_value(tn) AS sh, count_if(n = mn) > 1 AS ti, min(chrom) FILTER (n = mn) AS chrom FROM pm GROUP BY 1, 2) SELECT code, region, chrom FROM sp JOIN rr USING (code, region) WHERE sh >= 0.4 AND NOT ti AND i >= 3 AND CAST(s AS DOUBLE) / i >= 0.4"))
def chromosome_screen(spark, sf):
    c, d = fx.counts(spark, sf).where(OTHERS), fx.den(spark, sf).where(OTHERS)
    order = F.col("chrom")
    return screens.chromosome_screen(specificity.chromosome_specificity(c, d, order), specificity.recurrence(c, d, order), 0.4, 0.4, 3)
