"""Screens of candidates: family, pan, chromosome and group rules, and the funnel of selective ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fails_undefined(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def family_ok(share: Column, e_family: Column, e_background: Column, least_share: float = 0.99, least_family: float = 6.0, least_background: float = 10.0) -> Column:
    """Share of the own family at least, and both enrichments above, their bounds; undefined fails."""
    return _fails_undefined((share >= least_share) & (e_family > least_family) & (e_background > least_background))


def strict(share: Column, e_family: Column, e_background: Column, haps: Column, broad_min: int, least_share: float = 0.999, threshold: float = 10.0) -> Column:
    return _fails_undefined((share >= least_share) & (e_family > threshold) & (e_background > threshold) & (haps >= broad_min))


def chromosome_screen(specificity: DataFrame, recurrence: DataFrame, fraction: float = 0.9, recurrent: float = 0.8, informative: int = 100) -> DataFrame:
    """(code, region, chrom) that one chromosome dominates, in nearly all informative haps."""
    rows = specificity.join(recurrence, ["code", "region"])
    return rows.where((F.col("count_share") >= fraction) & ~F.col("count_tied") & (F.col("recurrence") >= recurrent) & (F.col("informative") >= informative)).select("code", "region", F.col("count_chrom").alias("chrom"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """df with one flag per step; each step holds only where all before it do."""
    passed = F.lit(True)
    for name, rule in steps.items():
        passed = passed & _fails_undefined(rule)
        df = df.withColumn(name, passed)
    return df


def funnel_counts(df: DataFrame, steps: list[str]) -> DataFrame:
    one = df.agg(*(F.count_if(s).alias(s) for s in steps))
    return one.unpivot([], steps, "step", "kmers")


def dispatch(df: DataFrame, pan: DataFrame, chromosomes: DataFrame, groups: DataFrame) -> DataFrame:
    """df (query, category, d, ...) with ``kind`` and ``passes`` by the rule of its category: ``pan...``
    by the pan table, ``chromosome_<name>`` where that very chromosome passes, and
    ``<chromosome>_G<n>_specific`` or ``..._enriched`` where that group of haps passes that screen on
    that chromosome. Tables are (query, d) and (query, d, chrom) of what passes, and (query, d, chrom,
    grp, enriched, specific)."""
    kind = F.when(F.col("category").startswith("pan"), "pan").when(F.col("category").startswith("chromosome_"), "chromosome").otherwise("group")
    name = F.when(kind == "chromosome", F.regexp_extract("category", "^chromosome_(.+)$", 1)).when(kind == "group", F.regexp_extract("category", r"^(.+)_G\d+", 1))
    rows = df.withColumn("kind", kind).withColumn("expected", name).withColumn("expected_group", F.when(kind == "group", F.regexp_extract("category", r"_(G\d+)", 1)))
    p = pan.select("query", "d").distinct().withColumn("in_pan", F.lit(True))
    c = chromosomes.select("query", "d", F.col("chrom").cast("string").alias("expected")).distinct().withColumn("in_chrom", F.lit(True))
    g = groups.groupBy("query", "d", F.col("chrom").cast("string").alias("expected"), F.col("grp").cast("string").alias("expected_group")).agg(F.max("enriched").alias("enriched"), F.max("specific").alias("specific"))
    rows = rows.join(p, ["query", "d"], "left").join(c, ["query", "d", "expected"], "left").join(g, ["query", "d", "expected", "expected_group"], "left")
    in_group = F.when(F.col("category").contains("specific"), F.col("specific")).otherwise(F.col("enriched"))
    passes = F.when(F.col("kind") == "pan", F.col("in_pan")).when(F.col("kind") == "chromosome", F.col("in_chrom")).otherwise(in_group)
    return rows.select(*df.columns, "kind", _fails_undefined(passes).alias("passes"))


def group_screens(contrast: DataFrame, presence: float = 0.8, log2: float = 2.0, specific: float = 0.2) -> DataFrame:
    """contrast (of landscape.group_contrast) with ``enriched`` (nearly all haps of the group have the
    k-mer, and more of it than the others) and ``specific`` (and few of the others have it)."""
    rich = (F.col("in_presence") >= presence) & (F.col("log2_contrast") >= log2)
    return contrast.withColumn("enriched", _fails_undefined(rich)).withColumn("specific", _fails_undefined(rich & (F.col("out_presence") <= specific)))


def largest_radius(passed: DataFrame, by: list[str]) -> DataFrame:
    """(by, radius): the largest d up to which every d passes; null if 0 fails."""
    flags = passed.groupBy(*by).agg(*(F.max(F.when(F.col("d") == d, F.col("passes"))).alias(f"p{d}") for d in range(3)))
    p = [F.coalesce(F.col(f"p{d}"), F.lit(False)) for d in range(3)]
    return flags.select(*by, F.when(p[0] & p[1] & p[2], 2).when(p[0] & p[1], 1).when(p[0], 0).alias("radius"))
