"""Positions of hits: scans, bins, overlays, histograms and group views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import prefilter, restrict, windows
from .ranking import numbered


def scan(sequences: DataFrame, patterns: DataFrame, k: int = 16, keys: list[str] | None = None) -> DataFrame:
    """(keys, code, start, end, strand) of every window of sequences that is one of patterns (code,
    canonical), in either orientation. One pass for all patterns; windows that are none of them stay
    in Python as far as the patterns fit a prefilter."""
    only = prefilter(patterns)
    hits = windows(sequences, k, keys, positions=True, only=only)
    if only is None or not only.value.exact:
        hits = restrict(hits, patterns)
    return hits.withColumn("end", F.col("start") + k).withColumn("strand", F.when(F.col("strand") == 0, "+").otherwise("-"))


def bins(hits: DataFrame, width: int, by: list[str]) -> DataFrame:
    """(by, bin_start, bin_end, n, forward, reverse) of hits by start."""
    at = (F.floor(F.col("start") / width) * width).cast("long")
    return hits.withColumn("bin_start", at).groupBy(*by, "bin_start").agg((F.first("bin_start") + width).alias("bin_end"), F.count("*").alias("n"), F.count_if(F.col("strand") == "+").alias("forward"), F.count_if(F.col("strand") == "-").alias("reverse"))


def gap_filled(binned: DataFrame, width: int, by: list[str]) -> DataFrame:
    """(by, bin_start, n) for every bin from the first to the last of each group; 0 where none fell."""
    ends = binned.groupBy(*by).agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    grid = ends.select(*by, F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("bin_start"))
    return grid.join(binned.select(*by, "bin_start", "n"), [*by, "bin_start"], "left").fillna(0, ["n"])


def dominant_series(binned: DataFrame, width: int, name: str, chromosome: str, margin: int = 0) -> DataFrame:
    """(name, chromosome, bin_start, n) along the chromosome that has most hits of each name (the first
    of equals): every bin from the first to the last and ``margin`` bins on both sides, not below 0."""
    sums = binned.groupBy(name, chromosome).agg(F.sum("n").alias("hits"), F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    first = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("hits"), chromosome))
    most = sums.withColumn("r", first).where("r = 1")
    ends = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("lo") - margin * width), F.col("hi") + margin * width, F.lit(width).cast("long"))
    grid = most.select(name, chromosome, F.explode(ends).alias("bin_start"))
    return grid.join(binned.select(name, chromosome, "bin_start", "n"), [name, chromosome, "bin_start"], "left").fillna(0, ["n"])


def overlay_counts(hits: DataFrame, by: list[str], broad: Column, fine: Column, labels: tuple[str, ...]) -> DataFrame:
    """(by, total, inside, outside, fine_<label>...): broad tells inside, fine names the label."""
    sums = [F.count_if(fine == x).alias(f"fine_{x.lower()}") for x in labels]
    return hits.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(broad).alias("inside"), F.count_if(~broad).alias("outside"), *sums)


def dense(counts: DataFrame, rows: DataFrame, columns: DataFrame, values: list[str]) -> DataFrame:
    """counts on the grid of rows by columns (a short dimension), 0 where nothing was counted."""
    grid = rows.crossJoin(F.broadcast(columns))  # columns: chromosomes, a few dozen rows
    return grid.join(counts, [*rows.columns, *columns.columns], "left").fillna(0, values)


def histogram(df: DataFrame, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """(bin, midpoint, n) of n equal bins; the last is closed on the right, undefined values are left
    out, and empty bins are listed."""
    binned = df.where(F.col(value).isNotNull() & (F.col(value) >= lo) & (F.col(value) <= hi))
    place = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / n)).cast("int") + 1, F.lit(n))
    counts = binned.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    mid = F.lit(lo) + (F.col("bin") - 0.5) * ((hi - lo) / n)
    return grid.join(counts, "bin", "left").select("bin", mid.alias("midpoint"), F.coalesce("n", F.lit(0)).alias("n"))


def group_summary(df: DataFrame, by: list[str], n: str = "n", valid: str = "valid_starts", least: int = 10) -> DataFrame:
    """Per group of haps: size, median and mean density, pooled density and the share of haps with at
    least ``least`` hits."""
    d = F.try_divide(F.col(n), F.col(valid)) * 1e6
    rows = df.withColumn("_d", d)
    return rows.groupBy(*by).agg(F.count("*").alias("haps"), F.percentile("_d", F.lit(0.5)).alias("median_density"), F.avg("_d").alias("mean_density"), (F.try_divide(F.sum(n), F.sum(valid)) * 1e6).alias("pooled_density"), F.avg((F.col(n) >= least).cast("double")).alias("presence"))


def _median_with_zeros(values: Column, size: Column) -> Column:
    """The median of ``size`` numbers: the sorted array ``values`` of those above 0, and zeros."""
    def at(i: Column) -> Column:
        return F.coalesce(F.get(values, (i - (size - F.size(values))).cast("int")), F.lit(0.0))

    low = F.floor((size - 1) / 2)
    return F.when(size > 0, (at(low) + at(F.ceil((size - 1) / 2))) / 2)


def group_contrast(df: DataFrame, haps: DataFrame, key: list[str], group: str, n: str = "n", density: str = "density", least: int = 10, epsilon: float = 0.001, within: list[str] | None = None) -> DataFrame:
    """(key, within, group, in_presence, out_presence, in_median, out_median, log2_contrast): each
    group of haps against all others, apart for each value of ``within``, such as a chromosome.

    df has the counts that are above 0, one row for each key, within and hap, with the hap's group; haps
    has (within, group) once for each hap, also of those without counts. Zeros are not written out:
    sizes of the groups tell how many there are. A key's counts, at most one per hap, meet in one
    array; the only rows made beside are one for each key and group, which is the result.
    """
    within = within or []
    sizes = haps.groupBy(*within, F.col(group).alias("g")).agg(F.count("*").alias("size"))
    every = sizes.groupBy(*within).agg(F.sort_array(F.collect_list(F.struct("g", "size"))).alias("groups"), F.sum("size").alias("all_haps"))
    values = F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(density), F.lit(0.0)).alias("d"), F.col(n).alias("n"), F.col(group).alias("g")))).alias("v")
    met = df.groupBy(*key, *within).agg(values)
    # one row for each value of within (families by chromosomes), as long as there are groups of haps
    rows = met.join(F.broadcast(every), within) if within else met.crossJoin(F.broadcast(every))
    rows = rows.select(*key, *within, "v", "all_haps", F.explode("groups").alias("of"))
    rows = rows.select(*key, *within, F.col("of.g").alias(group), F.col("of.size").alias("size"), (F.col("all_haps") - F.col("of.size")).alias("others"), F.filter("v", lambda x: x["g"] == F.col("of.g")).alias("inside"), F.filter("v", lambda x: x["g"] != F.col("of.g")).alias("outside"))
    part = lambda side, size: F.try_divide(F.size(F.filter(side, lambda x: x["n"] >= least)).cast("double"), F.col(size))
    median = lambda side, size: _median_with_zeros(F.filter(F.col(f"{side}.d"), lambda x: x > 0), F.col(size))
    out = rows.select(*key, *within, group, part("inside", "size").alias("in_presence"), part("outside", "others").alias("out_presence"), median("inside", "size").alias("in_median"), median("outside", "others").alias("out_median"))
    return out.withColumn("log2_contrast", F.log2((F.col("in_median") + epsilon) / (F.col("out_median") + epsilon)))


def markers(contrast: DataFrame, family_ok: DataFrame, key: str = "code", presence: float = 0.8, log2: float = 2.0, specific: float = 0.2) -> DataFrame:
    """The keys of contrast that mark a group: of those in family_ok (key), which the family screen
    lets pass, with ``kind``: specific where few haps of other groups have them, else enriched."""
    kept = contrast.where((F.col("in_presence") >= presence) & (F.col("log2_contrast") >= log2)).join(family_ok.select(key).distinct(), key, "left_semi")
    return kept.withColumn("kind", F.when(F.col("out_presence") <= specific, "specific").otherwise("enriched"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest seeded hashes of key: a random sample that reruns alike."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def even_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows evenly spaced in the order, first and last included."""
    ranked = numbered(df, [], [F.col(order)], "r", "rows").withColumn("r", F.col("r") - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("rows") - 1) / F.lit(max(1, n - 1))))
    return ranked.where(F.array_contains(places, F.col("r").cast("long"))).drop("r", "rows")
