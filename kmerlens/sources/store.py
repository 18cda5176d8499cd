"""A store of counts for lookups of few k-mers: Parquet clustered by code, so that statistics and Bloom
filters of row groups tell what need not be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes that are asked for as equalities, which Spark hands to the Parquet reader; more are joined.
FEW = 200
#: Rows of a join side that are broadcast: one number each.
BROADCAST_CODES = 1_000_000


def write_store(counts: DataFrame, path: str, key: str = "code", then: tuple[str, ...] = ("hap",), files: int | None = None, group_bytes: int = 8 << 20, mode: str = "error") -> None:
    """counts as files by ranges of (key, then), sorted inside, in row groups of about ``group_bytes``.
    A key of very many rows spreads over files, since ranges cut it by ``then``. Sorted codes have narrow
    minima and maxima; the Bloom filter tells codes apart that lie between two neighbours."""
    n = files or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [key, *then]
    rows = counts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows.write.mode(mode).option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true").parquet(path)


def one_of(key: str, codes: list[int]) -> Column:
    """Equalities joined by OR: a long list would reach the reader as its least and greatest value only."""
    return reduce(Column.__or__, [F.col(key) == c for c in codes], F.lit(False))


def lookup(store: DataFrame, codes: list[int] | DataFrame, key: str = "code") -> DataFrame:
    """The rows of the store with one of the codes: a list, or the distinct values of a table's key. Codes
    that are not in the store, and nulls, give no row. Up to FEW codes read the row groups that may hold
    them; more read the whole store once."""
    if isinstance(codes, list):
        codes = sorted({c for c in codes if c is not None})
        if len(codes) <= FEW:
            return store.where(one_of(key, codes))
        codes = store.sparkSession.createDataFrame([(c,) for c in codes], f"`{key}` long")
    asked = codes.select(key).where(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in asked.limit(FEW + 1).collect()]  # a bounded list
    if len(some) <= FEW:
        return store.where(one_of(key, some))
    if asked.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        asked = F.broadcast(asked)
    return store.join(asked, key, "left_semi")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
