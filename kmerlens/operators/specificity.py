"""Family, chromosome and prevalence metrics of selected k-mers.

counts: (hap, chrom, region, code, n) without rows for zeros. den: (hap, chrom, region,
valid_starts); a missing row means unavailable, not zero. All metrics leave out the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import log2_ratio, ratio

FAMILIES = ("HSat2", "HSat3")


def _sum_of(region: str, n: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(F.col("region") == region, F.col(n))), F.lit(0))


def matrix_a(counts: DataFrame, den: DataFrame, targets: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(code, hap, n, density): target counts of every hap over its target starts."""
    d = den.where(F.col("region").isin(*targets)).groupBy("hap").agg(F.sum("valid_starts").alias("valid"))
    n = counts.where(F.col("region").isin(*targets)).groupBy("code", "hap").agg(F.sum("n").alias("n"))
    return n.join(d, "hap").select("code", "hap", "n", (ratio(F.col("n"), F.col("valid")) * 1e6).alias("density"))


def matrix_b(counts: DataFrame, den: DataFrame) -> DataFrame:
    """(code, hap, n and density per family), pivoted by family."""
    d = den.where(F.col("region").isin(*FAMILIES)).groupBy("hap", "region").agg(F.sum("valid_starts").alias("valid"))
    rows = counts.where(F.col("region").isin(*FAMILIES)).groupBy("code", "hap", "region").agg(F.sum("n").alias("n")).join(d, ["hap", "region"])
    rows = rows.withColumn("density", ratio(F.col("n"), F.col("valid")) * 1e6)
    return rows.groupBy("code", "hap").pivot("region", list(FAMILIES)).agg(F.sum("n").alias("n"), F.sum("density").alias("density"))


def family_metrics(counts: DataFrame, den: DataFrame) -> DataFrame:
    """Pooled share, densities and log ratio of the families, and hap counts per k-mer: prevalence at
    1, 10 and 100, prevalence per family, haps that are informative or favour one family. Ties and
    undefined local ratios favour neither."""
    d = den.groupBy("hap").agg(*(F.sum(F.when(F.col("region") == f, F.col("valid_starts"))).alias(f"v{i}") for i, f in enumerate(FAMILIES)))
    all_d = d.agg(F.sum("v0").alias("all0"), F.sum("v1").alias("all1"))
    local = counts.groupBy("code", "hap").agg(*(_sum_of(f).alias(f"n{i}") for i, f in enumerate(FAMILIES))).where("n0 + n1 > 0").join(d, "hap", "left")
    r = [ratio(F.col(f"n{i}"), F.when(F.col(f"v{i}") > 0, F.col(f"v{i}"))) for i in (0, 1)]
    local = local.withColumn("e", log2_ratio(r[0], r[1])).withColumn("t", F.col("n0") + F.col("n1"))
    out = local.groupBy("code").agg(
        F.sum("n0").alias("n_h2"), F.sum("n1").alias("n_h3"), F.count("*").alias("prevalence"), F.count_if(F.col("t") >= 10).alias("prevalence_10"), F.count_if(F.col("t") >= 100).alias("prevalence_100"),
        F.count_if(F.col("n0") > 0).alias("prevalence_h2"), F.count_if(F.col("n1") > 0).alias("prevalence_h3"), F.count_if((F.col("v0") > 0) & (F.col("v1") > 0)).alias("informative"),
        F.count_if(F.col("e") > 0).alias("favored_h2"), F.count_if(F.col("e") < 0).alias("favored_h3"),
    ).crossJoin(F.broadcast(all_d))  # fmt: skip  one row
    d2, d3 = ratio(F.col("n_h2"), F.col("all0")), ratio(F.col("n_h3"), F.col("all1"))
    return out.select("code", "n_h2", "n_h3", ratio(F.col("n_h2"), F.col("n_h2") + F.col("n_h3")).alias("share_h2"), (d2 * 1e6).alias("density_h2"), (d3 * 1e6).alias("density_h3"), log2_ratio(d2, d3).alias("family_log2"), *out.columns[3:-2])


def with_zeros(values: DataFrame, haps: DataFrame, by: str = "code") -> DataFrame:
    """(by, value, weight): values (by, hap, value) and one row per key for the haps without one,
    worth 0 as often as there are such haps: exact quantiles without a dense grid."""
    total = haps.agg(F.count("*").alias("haps"))
    zeros = values.groupBy(by).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where("haps > n").select(by, F.lit(0.0).alias("value"), (F.col("haps") - F.col("n")).alias("weight"))  # one row
    return values.select(by, F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("weight")).unionByName(zeros)


def quantiles(values: DataFrame, haps: DataFrame, probabilities: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(code, q10, q50, q90): exact quantiles over all haps, zeros included."""
    rows = with_zeros(values, haps)
    return rows.groupBy("code").agg(*(F.percentile("value", F.lit(p), F.col("weight")).alias(f"q{round(100 * p)}") for p in probabilities))


def density_cv(values: DataFrame, haps: DataFrame) -> DataFrame:
    """(code, mean_density, cv): population deviation over the mean, zeros included; null where any
    hap's density is undefined."""
    total = haps.agg(F.count("*").alias("haps"))
    sums = values.groupBy("code").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count_if(F.col("value").isNull()).alias("undefined")).crossJoin(F.broadcast(total))  # one row
    mean = F.when(F.col("undefined") == 0, F.col("s") / F.col("haps"))
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("haps") - mean * mean)
    return sums.select("code", mean.alias("mean_density"), F.try_divide(F.sqrt(var), mean).alias("cv"))


def with_union(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts with the two families summed as a third region, HSat23."""
    keys = [c for c in counts.columns if c not in ("region", n)]
    union = counts.where(F.col("region").isin(*FAMILIES)).groupBy(*keys).agg(F.sum(n).alias(n)).withColumn("region", F.lit("HSat23"))
    return counts.where(F.col("region").isin(*FAMILIES)).unionByName(union)


def dominant(rows: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """(by, best, tied, top, total): the chromosome with the largest value (the first in ``order`` of
    equals), whether others equal it, its value and the sum."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("top", F.max(value).over(w)).withColumn("total", F.sum(value).over(w))
    at_top = ranked.where(F.col(value) == F.col("top"))
    return at_top.groupBy(*by).agg(F.min(F.struct(order.alias("o"), "chrom")).alias("b"), (F.count("*") > 1).alias("tied"), F.max("top").alias("top"), F.max("total").alias("total")).select(*by, F.col("b.chrom").alias("best"), "tied", "top", "total")


def chromosome_specificity(counts: DataFrame, den: DataFrame, order: Column) -> DataFrame:
    """Per (code, region): dominant chromosome by count and by density, ties, shares and entropy."""
    by = ["code", "region"]
    n = with_union(counts).groupBy("code", "region", "chrom").agg(F.sum("n").alias("n")).where("n > 0")
    d = with_union(den, "valid_starts").groupBy("region", "chrom").agg(F.sum("valid_starts").alias("valid"))
    rows = n.join(d, ["region", "chrom"], "left").withColumn("density", ratio(F.col("n"), F.col("valid")) * 1e6)
    c = dominant(rows, by, "n", order).select(*by, F.col("best").alias("count_chrom"), F.col("tied").alias("count_tied"), ratio(F.col("top"), F.col("total")).alias("count_share"), "total")
    e = dominant(rows.where("density is not null"), by, "density", order).select(*by, F.col("best").alias("density_chrom"), F.col("tied").alias("density_tied"), ratio(F.col("top"), F.col("total")).alias("density_share"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    h = rows.withColumn("p", p).groupBy(*by).agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return c.join(e, by, "left").join(h, by)


def recurrence(counts: DataFrame, den: DataFrame, order: Column) -> DataFrame:
    """Per (code, region): haps that inform on the pooled dominant chromosome (k-mer present, that
    chromosome and one more measurable, no pooled tie), those whose own dominant agrees, and their
    ratio. A hap's own tie agrees with nothing."""
    by = ["code", "region"]
    n = with_union(counts).groupBy("code", "region", "hap", "chrom").agg(F.sum("n").alias("n")).where("n > 0")
    pooled = dominant(n.groupBy(*by, "chrom").agg(F.sum("n").alias("n")), by, "n", order).select(*by, "best", F.col("tied").alias("pooled_tied"))
    own = dominant(n, [*by, "hap"], "n", order).select(*by, "hap", F.when(~F.col("tied"), F.col("best")).alias("own"))
    measurable = with_union(den, "valid_starts").groupBy("hap", "region", "chrom").agg(F.sum("valid_starts").alias("v")).where("v > 0")
    n_chrom = measurable.groupBy("hap", "region").agg(F.count("*").alias("chroms"))
    rows = own.join(pooled, by).join(n_chrom, ["hap", "region"]).join(measurable.select("hap", "region", F.col("chrom").alias("best"), F.lit(True).alias("seen")), ["hap", "region", "best"], "left")
    informative = F.coalesce("seen", F.lit(False)) & (F.col("chroms") >= 2) & ~F.col("pooled_tied")
    agrees = informative & F.coalesce(F.col("own") == F.col("best"), F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(informative).alias("informative"), F.count_if(agrees).alias("support")).withColumn("recurrence", ratio(F.col("support"), F.col("informative")))


def coverage(den: DataFrame) -> DataFrame:
    """Per chromosome: haps that have it, and haps with valid starts in each family."""
    per = den.groupBy("hap", "chrom").agg(*(F.sum(F.when(F.col("region") == f, F.col("valid_starts"))).alias(f"v{i}") for i, f in enumerate(FAMILIES)))
    return per.groupBy("chrom").agg(F.count("*").alias("available"), F.count_if(F.col("v0") > 0).alias("measurable_h2"), F.count_if(F.col("v1") > 0).alias("measurable_h3"))


def availability_grid(den: DataFrame, haps: DataFrame, chroms: DataFrame) -> DataFrame:
    """Every (hap, chrom, family): available, and its valid starts (null: unavailable)."""
    families = F.explode(F.array(*map(F.lit, FAMILIES))).alias("region")
    grid = haps.select("hap").crossJoin(F.broadcast(chroms.select("chrom"))).select("hap", "chrom", families)  # chromosomes: at most a few dozen rows
    seen = den.select("hap", "chrom").distinct().withColumn("available", F.lit(1))
    v = den.where(F.col("region").isin(*FAMILIES)).groupBy("hap", "chrom", "region").agg(F.sum("valid_starts").alias("v"))
    rows = grid.join(seen, ["hap", "chrom"], "left").join(v, ["hap", "chrom", "region"], "left")
    return rows.select("hap", "chrom", "region", F.coalesce("available", F.lit(0)).alias("available"), F.when(F.col("available") == 1, F.coalesce("v", F.lit(0))).alias("valid_starts"))


def export_rows(grid: DataFrame, counts: DataFrame, code) -> DataFrame:
    """One k-mer over the grid: n and density null where unavailable, density null without starts."""
    n = counts.where(F.col("code") == code).groupBy("hap", "chrom", "region").agg(F.sum("n").alias("n"))
    rows = grid.join(n, ["hap", "chrom", "region"], "left").withColumn("n", F.when(F.col("available") == 1, F.coalesce("n", F.lit(0))))
    return rows.withColumn("density", F.when(F.col("valid_starts") > 0, F.col("n") / F.col("valid_starts") * 1e6))
