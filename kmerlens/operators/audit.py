"""Invariants as queries: each gives the rows that break one, and should give none."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of named tables of broken rows."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def partition_identity(regions: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Union and background must tile every axis; the families and the overlap must tile the union."""
    size = F.col("end") - F.col("start")
    bp = lambda name: F.coalesce(F.sum(F.when(F.col("region") == name, size)), F.lit(0)).alias(name)
    sums = regions.groupBy(*keys).agg(*map(bp, ("HSat2", "HSat3", "HSat23", "ambiguous", "background")))
    rows = lengths.where("length > 0").join(sums, keys, "left")
    return rows.where("coalesce(HSat23, 0) + coalesce(background, 0) <> length or coalesce(HSat2, 0) + coalesce(HSat3, 0) + coalesce(ambiguous, 0) <> coalesce(HSat23, 0)")


def stats_bounds(stats: DataFrame) -> DataFrame:
    return stats.where("bp < 0 or acgt_bp < 0 or non_acgt_bp < 0 or bp <> acgt_bp + non_acgt_bp or valid_starts > acgt_bp or valid_starts < 0")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def counts_match_starts(spectrum: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """All windows must be counted: sums of counts equal valid starts."""
    n = spectrum.groupBy(*keys).agg(F.sum("n").alias("n"))
    v = stats.groupBy(*keys).agg(F.sum("valid_starts").alias("v"))
    return v.join(n, keys, "full").where("coalesce(n, 0) <> coalesce(v, 0)")


def totals_differ(fine: DataFrame, coarse: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Keys where sums of the finer table are not the coarser one's."""
    a = fine.groupBy(*keys).agg(F.sum(n).alias("a"))
    b = coarse.groupBy(*keys).agg(F.sum(n).alias("b"))
    return a.join(b, keys, "full").where("not (a <=> b)")


def hits_add_up(overlay: DataFrame, fine: list[str]) -> DataFrame:
    return overlay.where((F.col("total") != F.col("inside") + F.col("outside")) | (F.col("total") != sum((F.col(c) for c in fine), F.lit(0))))


def not_monotonic(sweep: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value grows where the threshold does."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return sweep.withColumn("before", before).where(F.col(value) > F.col("before"))


def sets_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted with repeats. Each table is read once."""
    both = a.withColumn("_n", F.lit(1)).union(b.withColumn("_n", F.lit(-1)))
    more = both.groupBy(*a.columns).agg(F.abs(F.sum("_n")).alias("_n")).where("_n > 0")
    return more.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*a.columns)


def not_subset(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    return inner.join(outer, key, "left_anti")


def distance_zero_differs(by_distance: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Sums at distance 0 must be the exact counts."""
    a = by_distance.where("d = 0").groupBy(*keys).agg(F.sum("n").alias("a"))
    b = exact.groupBy(*keys).agg(F.sum("n").alias("b"))
    return a.join(b, keys, "full").where("coalesce(a, 0) <> coalesce(b, 0)")


def weights_differ(positions: DataFrame, by_distance: DataFrame, keys: list[str]) -> DataFrame:
    """Position weights of a distance must sum to the distance times its count."""
    w = positions.groupBy(*keys, "d").agg(F.sum("weight").alias("w"))
    return by_distance.where("d > 0 and n > 0").join(w, [*keys, "d"], "left").where("abs(coalesce(w, 0) - d * n) > 1e-6")


def missing_shards(manifest: DataFrame, table: DataFrame, key: str = "hap") -> DataFrame:
    return manifest.select(key).join(table.select(key).distinct(), key, "left_anti")


def pool_by_windows(counts: DataFrame, pooled_min: int, hap_min: int) -> DataFrame:
    """The codes that counting.pool keeps, found by sums over windows instead of two groupings."""
    rows = counts.withColumn("p", F.sum("n").over(Window.partitionBy("code"))).withColumn("h", F.sum("n").over(Window.partitionBy("code", "hap")))
    return rows.where((F.col("p") >= pooled_min) | (F.col("h") >= hap_min)).select("code").distinct()


def enriched_by_logs(counts: DataFrame, den: DataFrame, hap_min: int, threshold: float, epsilon: float = 1e-9) -> DataFrame:
    """(code, hap) of enough target hits that are enriched, by differences of natural logarithms of
    sums that are made apart for targets and background."""
    own = lambda df, n, name, flag: df.where(f"region {flag} 'background'").groupBy(*(c for c in ("code", "hap") if c in df.columns)).agg(F.sum(n).alias(name))
    rows = own(counts, "n", "t", "<>").where(F.col("t") >= hap_min).join(own(counts, "n", "b", "="), ["code", "hap"], "left")
    rows = rows.join(own(den, "valid_starts", "vt", "<>").where("vt > 0"), "hap").join(own(den, "valid_starts", "vb", "=").where("vb > 0"), "hap")
    e = (F.log(F.col("t") / F.col("vt") + epsilon) - F.log(F.coalesce("b", F.lit(0)) / F.col("vb") + epsilon)) / F.log(F.lit(2.0))
    return rows.where(e > threshold).select("code", "hap")


def union_below_parts(union: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count in the union of the families (keys, n), counted on its own, is less than those of
    the families together: windows over a border are of the union alone, never of a family alone."""
    parts = counts.where(F.col("region").isin("HSat2", "HSat3")).select(*keys, F.col("n").alias("p"), F.lit(0).alias("u"))
    both = parts.unionByName(union.select(*keys, F.lit(0).alias("p"), F.col("n").alias("u")))
    return both.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("u < p")


def below_zero(net: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose sum of ``net`` (counting.counted_twice) is negative: counted less often in the union than in its parts."""
    return net.groupBy(*keys).agg(F.sum("net").alias("net")).where("net < 0")


def neighbourhood_differs(near: DataFrame, k: int = 16, radius: int = 2) -> DataFrame:
    """Queries whose neighbourhood (query, variant, d) is not whole: every variant once, in canonical
    form, at its distance, and as many oriented strings behind the variants as there are ways to
    change up to ``radius`` bases."""
    from ..functions import kmer as K

    rc = K.reverse_complement_code(F.col("variant"), k)
    bad = (F.col("variant") > rc) | (K.hamming_either(F.col("query"), F.col("variant"), k) != F.col("d")) | (F.col("d") > radius)
    # a string within the radius of the query is a variant or the reverse complement of one
    strings = F.when(K.hamming_code(F.col("query"), F.col("variant")) <= radius, 1).otherwise(0) + F.when((rc != F.col("variant")) & (K.hamming_code(F.col("query"), rc) <= radius), 1).otherwise(0)
    whole = sum(math.comb(k, d) * 3**d for d in range(radius + 1))
    rows = near.withColumn("bad", bad).withColumn("strings", strings)
    return rows.groupBy("query").agg(F.sum("strings").alias("strings"), F.count_if("bad").alias("bad"), (F.count("*") - F.count_distinct("variant")).alias("again")).where((F.col("strings") != whole) | (F.col("bad") > 0) | (F.col("again") > 0))


def clusters_break_rules(assigned: DataFrame, by: list[str], least: int = 10, silhouette: float = 0.25) -> DataFrame:
    """Rows of cluster cases that break a rule: references and unmeasured haps without a group of their
    own, groups of a stable partition as many as selected, large enough and apart enough."""
    own = assigned.where("status = 'stable_partition'")
    sizes = own.groupBy(*by, "grp").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.min("silhouette").alias("s"))
    small = sizes.where((F.col("n") < least) | (F.col("s") < silhouette)).select(*by)
    count = sizes.groupBy(*by).agg(F.count("*").alias("groups"), F.first("k").alias("k")).where("groups <> k").select(*by)
    lost = assigned.where("status like 'insufficient%' and grp is not null").select(*by)
    return small.unionByName(count).unionByName(lost)


def inputs_changed(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Paths whose fingerprints (sources.files.fingerprint) are not the same in both runs."""
    columns = [c for c in before.columns if c != key]
    other = now.select(key, *(F.col(c).alias(f"now_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return before.join(other, key, "full").where(~same).select(key)
