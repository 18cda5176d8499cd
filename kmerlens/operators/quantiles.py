"""Exact quantiles of large groups, by rounds of finer histograms that add up across tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import written

BINS = 1 << 12
#: Rows of a bin that may be sorted in one task; a bin with more is cut again.
SMALL = 1 << 16
#: Rows of chosen bins that are broadcast: a few numbers each.
BROADCAST_BINS = 100_000


def _broadcastable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_BINS else df


def _inside(rows: DataFrame, chosen: DataFrame, by: list[str], bins: int) -> DataFrame:
    """rows of the chosen bins, each with its part (0 to bins - 1) of the bin that it lies in. The part
    never falls as the value grows, which is all that the counts need."""
    named = chosen.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_lo", "_hi").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")]
    inside = rows.join(_broadcastable(named), same).drop(*(f"_by_{c}" for c in by))
    # halves, so that the difference of large values of both signs is a number
    share = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
    part = F.when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins)))
    return inside.withColumn("_part", part.cast("int"))


def _before(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """counts with ``_before``: the weight of the rows of the same keys that come earlier."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))


def _holding(counts: DataFrame, sought: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The row of counts (within its keys) that holds each rank sought. ``_rank`` counts from the start
    of the bin (_lo, _hi)."""
    keys = [*by, "_lo", "_hi"]
    left, right = counts.alias("c"), sought.alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    here = (F.col("s._rank") >= F.col("c._before")) & (F.col("s._rank") < F.col("c._before") + F.col("c._w"))
    picked = left.join(right, same & here)
    return picked.select(*(F.col(f"s.{c}").alias(c) for c in (*by, "_at")), (F.col("s._rank") - F.col("c._before")).alias("_rank"), *(F.col(f"c.{c}") for c in columns))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], weight: str | None = None, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """One row for each group, with the quantiles ``at`` (name to fraction) of ``value``, between two
    neighbours in proportion, as ``percentile`` gives them. ``weight`` is a column of whole numbers: a
    row counts that often (null or below 1: not at all).

    No task gathers a group: the first pass takes ends and sizes, each further one counts rows by parts
    of the bins that hold the ranks sought. A bin that holds one value is done; one of at most ``small``
    rows is counted by value in the last pass. So three passes do for groups of up to bins * small rows
    whose values are spread, and few more for others. The rows are written once and read in each pass.

    Nulls and NaN are left out; a group without any other value has null quantiles. Infinite values have
    their place at the ends. -0.0 is 0.0. No rows give no rows."""
    v = F.col(value).cast("double")
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    rows = df.select(*by, F.when(~F.isnan(v), v + F.lit(0.0)).alias("_v"), w.alias("_w"))
    rows = written(rows, "values")
    groups = rows.select(*by).distinct() if by else df.sparkSession.range(1).select()
    rows = rows.where("_v is not null and _w > 0")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    ends = rows.groupBy(*by).agg(F.sum("_w").alias("_n"), F.sum(F.when(F.col("_v") == float("-inf"), F.col("_w")).otherwise(0)).alias("_low"), F.sum(F.when(F.abs("_v") < float("inf"), F.col("_w")).otherwise(0)).alias("_in"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    ends = written(ends.where("_n > 0"), "ends")

    # the two ranks around each quantile, from 0
    fractions = sorted(set(at.values()))
    place = F.explode(F.array(*map(F.lit, fractions))).alias("_q")
    ranks = ends.select("*", place).withColumn("_x", F.col("_q") * (F.col("_n") - 1))
    around = ranks.select("*", F.explode(F.array(F.floor("_x"), F.ceil("_x"))).alias("_at"))
    sought = around.select(*by, "_at", "_low", "_in", "_lo", "_hi", (F.col("_at") - F.col("_low")).alias("_rank")).distinct()
    outer = F.when(F.col("_rank") < 0, F.lit(float("-inf"))).when(F.col("_rank") >= F.col("_in"), F.lit(float("inf"))).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    sought = sought.withColumn("_found", outer)
    done = sought.where("_found is not null").select(*by, "_at", F.col("_found").alias("_value"))
    sought = written(sought.where("_found is null").select(*by, "_at", "_lo", "_hi", "_rank", F.col("_in").alias("_rows")), "sought")
    found = [done]
    inner = rows.where(F.abs("_v") < float("inf"))
    while not (large := sought.where(F.col("_rows") > small)).isEmpty():
        parts = _inside(inner, large, by, bins).groupBy(*by, "_lo", "_hi", "_part").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        parts = _before(parts, [*by, "_lo", "_hi"], "_part")
        cut = written(_holding(parts, large, by, ["_w", "_min", "_max"]), "cut")
        found.append(cut.where("_min = _max").select(*by, "_at", F.col("_min").alias("_value")))
        rest = sought.where(F.col("_rows") <= small).unionByName(cut.where("_min < _max").select(*by, "_at", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "_rank", F.col("_w").alias("_rows")))
        sought = written(rest, "sought")
    if not sought.isEmpty():
        values = _inside(inner, sought, by, 1).groupBy(*by, "_lo", "_hi", "_v").agg(F.sum("_w").alias("_w"))
        values = _before(values, [*by, "_lo", "_hi"], "_v")
        found.append(_holding(values, sought, by, ["_v"]).select(*by, "_at", F.col("_v").alias("_value")))
    known = written(reduce(DataFrame.unionByName, found), "found")

    at_rank = F.map_from_entries(F.collect_list(F.struct("_at", "_value"))).alias("_values")  # two for each fraction
    table = known.groupBy(*by).agg(at_rank)
    sizes = ends.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_n")
    out = table.join(sizes, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] or F.lit(True))

    def between(q: float):
        x = F.lit(float(q)) * (F.col("_n") - 1)
        a, b = (F.element_at("_values", f(x)) for f in (F.floor, F.ceil))
        return F.when(a == b, a).otherwise(a * (F.ceil(x) - x) + b * (x - F.floor(x)))

    out = out.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(between(q).alias(name) for name, q in at.items()))
    whole = groups.join(out, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] or F.lit(True), "left")
    return whole.select(*by, *at)
