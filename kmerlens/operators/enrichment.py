"""Enrichment of k-mers in target regions against the background, selection and sweeps.

counts: (hap, region, code, n) at any finer grain. den: (hap, region, valid_starts). The reference
hap takes no part in anything pooled. Denominators that are missing or zero leave E null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import density, enrichment
from ..plans.written import written
from .quantiles import quantiles

TARGETS = ("HSat2", "HSat3")


def target_background(counts: DataFrame, targets: tuple[str, ...] = TARGETS, by: tuple[str, ...] = ("code", "hap"), n: str = "n") -> DataFrame:
    """(by, t, b): sums over target regions and over the background."""
    is_target = F.col("region").isin(*targets)
    return counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(is_target, F.col(n))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("region") == "background", F.col(n))), F.lit(0)).alias("b"))


def denominators(den: DataFrame, targets: tuple[str, ...] = TARGETS, by: tuple[str, ...] = ("hap",)) -> DataFrame:
    out = target_background(den, targets, by or (F.lit(0).alias("all"),), "valid_starts")
    return out.withColumnsRenamed({"t": "den_t", "b": "den_b"})


def pooled_enrichment(counts: DataFrame, den: DataFrame, reference: Column, pooled_min: int, threshold: float, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """(code, t, b, den_t, den_b, e, pooled_pass) over all haps but the reference."""
    d = denominators(den.where(~reference), targets, by=()).drop("all")
    rows = target_background(counts.where(~reference), targets, by=("code",)).crossJoin(F.broadcast(d))  # d is one row
    e = enrichment(F.col("t"), F.col("den_t"), F.col("b"), F.col("den_b"))
    return rows.withColumn("e", e).withColumn("pooled_pass", F.coalesce((F.col("t") >= pooled_min) & (F.col("e") > threshold), F.lit(False)))


def hap_enrichment(counts: DataFrame, den: DataFrame, hap_min: int, threshold: float, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """(code, hap, t, b, den_t, den_b, e, hap_pass) of the pairs that occur."""
    rows = target_background(counts, targets).join(denominators(den, targets), "hap")
    e = enrichment(F.col("t"), F.col("den_t"), F.col("b"), F.col("den_b"))
    return rows.withColumn("e", e).withColumn("hap_pass", F.coalesce((F.col("t") >= hap_min) & (F.col("e") > threshold), F.lit(False)))


def selection(pooled: DataFrame, by_hap: DataFrame, den: DataFrame, reference: Column, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """pooled with qualifying_haps, prevalence, mean / min / max of E over haps, selected and
    selection_reason. E of a hap without the k-mer is that of two zero counts, 0, and enters the
    mean; so sums over the pairs that occur and the number of measurable haps give all of them."""
    own = by_hap.where(~reference)
    measurable = denominators(den.where(~reference), targets).where("den_t > 0 and den_b > 0").agg(F.count("*").alias("measurable_haps"))
    stats = own.groupBy("code").agg(
        F.count_if(F.col("t") > 0).alias("prevalence"), F.count_if("hap_pass").alias("qualifying_haps"), F.sum("e").alias("e_sum"), F.min("e").alias("e_min"), F.max("e").alias("e_max"), F.count("e").alias("e_n")
    )
    rows = pooled.join(stats, "code", "left").crossJoin(F.broadcast(measurable))  # one row
    rest = F.col("measurable_haps") > F.coalesce("e_n", F.lit(0))
    rows = rows.withColumn("any_hap", F.coalesce(F.col("qualifying_haps") > 0, F.lit(False)))
    reason = F.when(F.col("pooled_pass") & F.col("any_hap"), "pooled_and_hap").when(F.col("pooled_pass"), "pooled").when(F.col("any_hap"), "hap").otherwise("not_selected")
    zero = F.when(rest, F.lit(0.0))
    return rows.select(
        *pooled.columns,
        F.coalesce("prevalence", F.lit(0)).alias("prevalence"),
        F.try_divide(F.coalesce("prevalence", F.lit(0)), F.col("measurable_haps")).alias("prevalence_fraction"),
        F.coalesce("qualifying_haps", F.lit(0)).alias("qualifying_haps"),
        F.try_divide(F.coalesce("e_sum", F.lit(0.0)), F.col("measurable_haps")).alias("mean_hap_e"),
        F.least("e_min", zero).alias("min_hap_e"),
        F.greatest("e_max", zero).alias("max_hap_e"),
        (F.col("pooled_pass") | F.col("any_hap")).alias("selected"),
        reason.alias("selection_reason"),
    )


def broad(selected: DataFrame, haps: int, fraction: float) -> DataFrame:
    """selected with ``broad``: pooled, and qualifying in at least ceil(fraction * haps) haps."""
    return selected.withColumn("broad", F.col("pooled_pass") & (F.col("qualifying_haps") >= F.ceil(F.lit(fraction * haps))))


def sweep_routes(pooled: DataFrame, by_hap: DataFrame, thresholds: list[float], pooled_min: int, hap_min: int) -> DataFrame:
    """(threshold, route, b, haps, t, e) of each k-mer under each threshold (a literal array, exploded) and
    route (pooled, hap_only, union) that selects it."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    local = by_hap.where((F.col("t") >= hap_min) & F.col("e").isNotNull()).select("code", "hap", "e", levels).where("e > threshold").groupBy("code", "threshold").agg(F.count("*").alias("haps"))
    rows = pooled.select("code", "t", "b", "e", levels).join(local, ["code", "threshold"], "left").fillna(0, ["haps"])
    rows = rows.withColumn("p", F.coalesce((F.col("t") >= pooled_min) & (F.col("e") > F.col("threshold")), F.lit(False))).withColumn("h", F.col("haps") > 0)
    routes = F.array(F.when(F.col("p"), "pooled"), F.when(F.col("h") & ~F.col("p"), "hap_only"), F.when(F.col("p") | F.col("h"), "union"))
    rows = rows.withColumn("route", F.explode(F.filter(routes, lambda r: r.isNotNull())))
    return rows.select("threshold", "route", "b", "haps", "t", "e")


def sweep(pooled: DataFrame, by_hap: DataFrame, thresholds: list[float], pooled_min: int, hap_min: int, broad_haps: int) -> DataFrame:
    """For each threshold and route: k-mers, those without background, broad ones, and the median target
    count and E. Medians are exact and no task holds a route."""
    rows = written(sweep_routes(pooled, by_hap, thresholds, pooled_min, hap_min), "routes")
    counts = rows.groupBy("threshold", "route").agg(F.count("*").alias("kmers"), F.count_if(F.col("b") == 0).alias("zero_background"), F.count_if(F.col("haps") >= broad_haps).alias("broad"))
    both = rows.select("threshold", "route", F.posexplode(F.array(F.col("t").cast("double"), "e")).alias("which", "value"))
    middle = quantiles(both, ["threshold", "route", "which"], "value", {"median": 0.5}).groupBy("threshold", "route").agg(*(F.max(F.when(F.col("which") == i, F.col("median"))).alias(n) for i, n in enumerate(("median_target", "median_e"))))
    return counts.join(middle, ["threshold", "route"])


def local_counts(by_hap: DataFrame, thresholds: list[float], hap_min: int) -> DataFrame:
    """(code, threshold, haps): haps in which the k-mer passes each threshold."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return by_hap.where(F.col("t") >= hap_min).select("code", "hap", "e", levels).where("e > threshold").groupBy("code", "threshold").agg(F.count("*").alias("haps"))


__all__ = ["broad", "denominators", "density", "hap_enrichment", "local_counts", "pooled_enrichment", "selection", "sweep", "target_background"]
