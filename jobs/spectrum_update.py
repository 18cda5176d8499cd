"""Keeps the candidate k-mers of each region up to date as files of sequences arrive.

    spark-submit jobs/spectrum_update.py --documents PATH --out PATH --checkpoint PATH [--settings FILE]

On a cluster, ship the packages ``jobs`` and ``kmerlens`` with --py-files.

A run takes the files that are new since the last one (Spark's file stream remembers them in the
checkpoint), counts their k-mers by region and hap, and writes one delta for each batch:

    OUT/deltas/batch=N/region=R/      code, hap, n
    OUT/candidates/region=R/          code, kmer, pooled, haps, largest
    OUT/marks/region=R/               through: the last batch that the region's candidates are made from
    OUT/settings/                     what the tables were made with

Then the candidates of regions that have deltas beyond their mark are made again from all deltas of the
region; other regions keep their files. A batch that is replayed after a
failure overwrites its own delta, and a run that ended between deltas and candidates is made good by the
next one, so runs may be repeated at any time. A file is taken once, by its name, and read for the columns
inside it (not for those that folder names give). Other settings that change counts or rules need another
OUT and checkpoint; the job refuses to mix them.
"""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import os
import sys

if __name__ == "__main__":  # as a script: find the packages beside this folder, here and in local workers
    _HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, _HERE)
    os.environ["PYTHONPATH"] = os.pathsep.join([_HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import load
from kmerlens.functions import kmer as K
from kmerlens.operators import counting
from kmerlens.streaming import pooled

log = logging.getLogger("jobs.spectrum_update")
DELTAS = "code long, hap string, n long, batch int, region string"
CANDIDATES = "code long, kmer string, pooled long, haps long, largest long, region string"
MARKS = "through int, region string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same_settings(spark: SparkSession, out: str, settings: dict) -> None:
    made = json.dumps({k: v for k, v in settings.items() if k != "files_per_batch"}, sort_keys=True)
    known = [r["made"] for r in _table(spark, f"{out}/settings", "made string").limit(2).collect()]
    if not known:
        spark.range(1).select(F.lit(made).alias("made")).write.mode("overwrite").parquet(f"{out}/settings")
    elif known != [made]:
        raise ValueError(f"{out} was made with other settings: {known[0]}")


def _pattern(path: str) -> str:
    """path as a pattern that only it matches: a file stream takes plain paths for folders, a pattern may
    name a file as well."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


@contextlib.contextmanager
def _writers(spark: SparkSession, most: int = 16):
    """A task keeps the files of up to ``most`` regions open, so rows need no sort by region before they are
    written; beyond that Spark sorts."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def take_new(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: dict) -> int:
    """Counts the new files into deltas, and gives the number of batches (of the last 100 that Spark reports)."""
    of = settings["sequences"]

    def write(batch: DataFrame, number: int) -> None:
        sequences = counting.spread(batch).select(*(F.expr(of[c]).alias(c) for c in ("hap", "region", "seq")))
        others = sequences.where(F.col("hap") != settings["reference"])
        # the stream counts what is read of a batch, so its size is told by the files that are there
        size = batch.sparkSession.read.format("binaryFile").load(_pattern(documents)).agg(F.sum("length")).first()[0] or 0
        counts = pooled.by_hap(counting.spectrum(others, settings["k"], ["region", "hap"], bases=4 * size), settings["reference"])
        path = f"{out}/deltas/batch={number}"
        with _writers(batch.sparkSession):
            counts.write.mode("overwrite").partitionBy("region").parquet(path)
        log.info("batch %d: wrote %d counts to %s", number, batch.sparkSession.read.schema(counts.schema).parquet(path).count(), path)

    stream = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(_pattern(documents))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    for number, rows in taken:
        log.info("batch %d: read %d rows of %s", number, rows, documents)
    return len(taken)


def refresh(spark: SparkSession, out: str, settings: dict) -> list[str]:
    """Makes the candidates of regions with newer deltas again, and gives the names of these regions."""
    deltas = _table(spark, f"{out}/deltas", DELTAS)
    there = deltas.groupBy("region").agg(F.max("batch").alias("newest"))
    done = _table(spark, f"{out}/marks", MARKS)
    # one row for each region: a handful
    stale = [(r["newest"], r["region"]) for r in there.join(done, "region", "left").where("through is null or through < newest").collect()]
    if stale:
        mine = deltas.where(F.col("region").isin([region for _, region in stale]))
        pool = pooled.pool_by_region(mine, settings["pooled_min"], settings["hap_min"], settings["k"])
        rows = pool.select("code", K.decode(F.col("code"), settings["k"]).alias("kmer"), "pooled", "haps", "largest", "region")
        for df, name in ((rows, "candidates"), (spark.createDataFrame(stale, MARKS), "marks")):
            with _writers(spark):
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(f"{out}/{name}")
    return sorted(region for _, region in stale)


def candidates(spark: SparkSession, out: str) -> DataFrame:
    return _table(spark, f"{out}/candidates", CANDIDATES).select("region", "kmer", "pooled", "haps", "largest")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Takes what is new in the folder (or file) ``documents`` and gives all candidates as they stand."""
    settings, out = settings or load("spectrum_update"), out.rstrip("/")
    _same_settings(spark, out, settings)
    batches = take_new(spark, documents, out, checkpoint, settings)
    regions = refresh(spark, out, settings)
    result = candidates(spark, out)
    log.info("%d new batches; candidates of %s made again; %d candidates in %s", batches, ", ".join(regions) or "no region", result.count(), out)
    return result


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--documents", required=True, help="folder of Parquet files that grows")
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--settings", help="TOML file; keys that it lacks are as in spectrum_update.toml")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("spectrum_update").getOrCreate()
    try:
        run(spark, given.documents, given.out, given.checkpoint, load("spectrum_update", given.settings))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
