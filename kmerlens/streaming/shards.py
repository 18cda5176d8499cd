"""Pooled counts of shards that are split, repeated and replaced, kept up to date by a file stream.

A shard is a named part of a hap's counts and has a version. Its rows may come in any number of files
and batches; the same row of the same version that comes again is a repeat and counts once. The greatest
version of a shard counts alone, so a newer one takes the older one's counts back, also those of k-mers
that it no longer has; an older one that comes late changes nothing. A hap with several shards counts
once in ``haps`` and with the sum of its shards in ``largest``.

    OUT/deltas/batch=N/      rows of one micro-batch; a replay overwrites its own folder
    OUT/versions/batch=N/    (hap, shard, version) seen in the batch
    OUT/base/through=N/      rows that count of all batches up to N
    OUT/compacted/through=N/ one row, written once the base of that number is whole

Sums and largest counts can't be taken back from a finished pool, so rows are kept by shard and pooled
when they are read; compaction drops what no longer counts and keeps reads to one base and few deltas.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import COUNTS

#: Rows of a shard. A row whose code is null only tells that the version exists, which may be empty.
SHARDS = T.StructType([*COUNTS.fields, T.StructField("shard", T.StringType()), T.StructField("version", T.LongType())])
KEY = ("hap", "shard", "version", "chromosome", "region", "strand", "code")
BATCH = T.StructType([T.StructField("batch", T.LongType())])
THROUGH = T.StructType([T.StructField("through", T.LongType())])
#: Newest versions that are broadcast: three short values each.
BROADCAST_SHARDS = 200_000


def _table(spark: SparkSession, path: str, fields: list[T.StructField], parts: T.StructType) -> DataFrame:
    """The Parquet table at path with its folder column; no rows where nothing has been written yet."""
    schema = T.StructType([*fields, *parts.fields])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def once(rows: DataFrame) -> DataFrame:
    """Each row of a shard's version once. Repeats that differ in n are one row, of the greatest n."""
    return rows.groupBy(*KEY).agg(F.max("n").alias("n"))


def newest(rows: DataFrame) -> DataFrame:
    """(hap, shard, version): the greatest version of each shard."""
    return rows.groupBy("hap", "shard").agg(F.max("version").alias("version"))


def through(spark: SparkSession, out: str) -> int:
    """The last batch that the base holds, -1 where there is none."""
    last = _table(spark, f"{out}/compacted", [T.StructField("at", T.LongType())], THROUGH).agg(F.max("through")).first()[0]
    return -1 if last is None else last


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The rows (KEY, n) that count now; repeats that lie in several deltas are still there."""
    at = through(spark, out)
    fields = [T.StructField(c, SHARDS[c].dataType) for c in (*KEY, "n")]
    base = _table(spark, f"{out}/base", fields, THROUGH).where(F.col("through") == at).drop("through")
    rows = base.unionByName(_table(spark, f"{out}/deltas", fields, BATCH).where(F.col("batch") > at).drop("batch"))
    last = newest(_table(spark, f"{out}/versions", [SHARDS[c] for c in ("hap", "shard", "version")], BATCH))
    if last.count() <= BROADCAST_SHARDS:
        last = F.broadcast(last)
    # shards and versions may be null: such rows are of one shard of that hap
    same = [rows[c].eqNullSafe(last[c]) for c in ("hap", "shard", "version")]
    return rows.join(last, same, "left_semi")


def compact(spark: SparkSession, out: str) -> int:
    """Writes the rows that count as a new base, sorted by region and code, and gives the batch that it
    goes through. Readers take the former base until the new one is whole."""
    last = _table(spark, f"{out}/versions", [SHARDS[c] for c in ("hap", "shard", "version")], BATCH).agg(F.max("batch")).first()[0]
    at = through(spark, out)
    if last is None or last <= at:
        return at
    rows = once(counted(spark, out)).repartitionByRange("region", "code").sortWithinPartitions("region", "code")
    rows.write.mode("overwrite").parquet(f"{out}/base/through={last}")
    spark.range(1).select(F.lit(last).cast("long").alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{out}/compacted/through={last}")
    return last


def maintain(spark: SparkSession, shards: str, out: str, checkpoint: str, reference: str, files_per_batch: int = 1000, compact_every: int = 20) -> StreamingQuery:
    """Follows a folder of Parquet files (SHARDS) and ends when all that is there has been taken. Every
    ``compact_every`` batches all that counts becomes the new base."""

    def write(batch: DataFrame, number: int) -> None:
        mine = batch.where(~F.col("hap").eqNullSafe(F.lit(reference)))
        once(mine.where("code is not null")).write.mode("overwrite").parquet(f"{out}/deltas/batch={number}")
        newest(mine).coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, out)

    stream = spark.readStream.schema(SHARDS).option("maxFilesPerTrigger", files_per_batch).parquet(shards)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pooled(spark: SparkSession, out: str) -> DataFrame:
    """(code, region, pooled, haps, largest) as they stand. One shuffle by region and code serves repeats,
    haps and k-mers; a frequent k-mer has a row for each shard, chromosome and strand at most."""
    rows = once(counted(spark, out).repartition("region", "code"))
    by_hap = rows.groupBy("region", "code", "hap").agg(F.sum("n").alias("n"))
    pool = by_hap.groupBy("region", "code").agg(F.sum("n").alias("pooled"), F.count_if(F.col("n") > 0).alias("haps"), F.max("n").alias("largest"))
    return pool.select("code", "region", "pooled", "haps", "largest")
