"""Pooled counts kept up to date as shards of new haps arrive.

Sums, prevalence and largest counts only ever add up, so each micro-batch is reduced to one row per
k-mer and appended as a delta; readers sum the deltas. Replays of a batch overwrite its own delta
(the folder is named by the batch), so the result is exactly once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counting
from ..schema import COUNTS


def delta(counts: DataFrame, reference: str) -> DataFrame:
    """(code, region, pooled, haps, largest) of whole hap shards, the reference left out."""
    by_hap = counts.where(F.col("hap") != reference).groupBy("code", "region", "hap").agg(F.sum("n").alias("n"))
    return by_hap.groupBy("code", "region").agg(F.sum("n").alias("pooled"), F.count_if(F.col("n") > 0).alias("haps"), F.max("n").alias("largest"))


def pooled(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("code long, region string, pooled long, haps long, largest long").parquet(f"{path}/batch=*")
    return rows.groupBy("code", "region").agg(F.sum("pooled").alias("pooled"), F.sum("haps").alias("haps"), F.max("largest").alias("largest"))


def maintain(spark: SparkSession, shards: str, path: str, checkpoint: str, reference: str) -> StreamingQuery:
    """Follows a folder of Parquet shards (COUNTS; a hap is in one file) into deltas under path, and
    ends when all that is there has been taken."""

    def write(batch: DataFrame, number: int) -> None:
        delta(batch, reference).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = spark.readStream.schema(COUNTS).parquet(shards)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_hap(counts: DataFrame, reference: str) -> DataFrame:
    """(code, region, hap, n) of any part of a hap's counts, the reference left out: deltas of these may
    come from several files or batches of one hap, and ``pool_by_region`` sums what comes in several rows."""
    return counts.where(F.col("hap") != reference).select("code", "region", "hap", "n")


def pool_by_region(deltas: DataFrame, pooled_min: int, hap_min: int, k: int = 16) -> DataFrame:
    """(code, region, pooled, haps, largest) of deltas by hap: k-mers whose sum over haps or largest count
    in one hap is enough. A hap counts once, however many deltas it has. All counts of a k-mer meet in one
    bucket, and only those that are enough leave it."""

    def reduce(t: counting.Tally) -> pa.Table:
        regions = t.kinds.column("region").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        own = t.firsts(t.kind)
        region = regions[t.kind[own]]
        n = np.add.reduceat(t.n, own)
        at = np.flatnonzero(np.append(True, (t.code[own][1:] != t.code[own][:-1]) | (region[1:] != region[:-1])))
        pooled, largest = np.add.reduceat(n, at), np.maximum.reduceat(n, at)
        keep = (pooled >= pooled_min) | (largest >= hap_min)
        haps = np.diff(np.append(at, len(own)))
        first = own[at[keep]]
        return pa.table({"code": t.code[first], "region": t.rows(first).column("region"), "pooled": pooled[keep], "haps": haps[keep], "largest": largest[keep]})

    rows = deltas.select("region", "hap", "code", "n")
    return counting.tallied(rows, reduce, "code long, region string, pooled long, haps long, largest long", k)
