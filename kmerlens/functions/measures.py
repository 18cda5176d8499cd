"""Ratios that keep undefined apart from zero: null where a denominator is missing or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def density(n: Column, valid_starts: Column) -> Column:
    return ratio(n, valid_starts)


def per_million(n: Column, valid_starts: Column) -> Column:
    return density(n, valid_starts) * 1e6


def log2_ratio(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.log2((a + epsilon) / (b + epsilon))


def enrichment(target: Column, target_starts: Column, background: Column, background_starts: Column) -> Column:
    """log2 of the ratio of densities; null if either denominator is not above 0."""
    defined = (target_starts > 0) & (background_starts > 0)
    return F.when(defined, log2_ratio(density(target, target_starts), density(background, background_starts)))


def fold_change(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def mismatch_score(e_background: Column, e_other: Column, share: Column, haps: Column, broad_min: Column) -> Column:
    return 0.30 * clamp01(e_background / 10) + 0.25 * clamp01(e_other / 10) + 0.20 * clamp01((share - 0.9) / 0.1) + 0.25 * clamp01(ratio(haps, broad_min))


def tier(passes: list[Column], names: tuple[str, ...] = ("C_exact", "B_le1mm", "A_le2mm"), none: str = "D_none") -> Column:
    """Name of the largest radius that passes, from the passes of radius 0, 1, 2."""
    out = F.lit(none)
    for p, name in zip(passes, names, strict=True):
        out = F.when(p, F.lit(name)).otherwise(out)
    return out


def tier_bonus(tier: Column) -> Column:
    return F.when(tier == "A_le2mm", 1.0).when(tier == "B_le1mm", 0.6).when(tier == "C_exact", 0.3).otherwise(0.0)


def final_score(exact: Column, mismatch: Column, tier: Column) -> Column:
    return 0.55 * exact + 0.35 * mismatch + 0.10 * tier_bonus(tier)


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


def valid_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$")
