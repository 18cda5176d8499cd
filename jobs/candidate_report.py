"""Selects enriched k-mers from a table of occurrences and reports where each of them lies.

    spark-submit jobs/candidate_report.py --occurrences PATH --out PATH [--settings FILE]

On a cluster, ship the packages ``jobs`` and ``kmerlens`` with --py-files.

Occurrences are summed to counts by k-mer, hap, chromosome and region and to denominators; the k-mers
that are enriched in the targets (over all haps, or in some) get their prevalence, the spread of E over
haps, and the chromosome that holds most of their target hits:

    OUT/counts/region=R/                  code, hap, chrom, n
    OUT/denominators/                     hap, chrom, region, valid_starts
    OUT/selected/selection_reason=X/      one row for each selected k-mer
    OUT/summary/                          tab-separated: reason, k-mers, targets, median prevalence

Every table is written whole in place of the last one, so a run may be repeated, also after one that
was stopped; the same occurrences give the same tables.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

if __name__ == "__main__":  # as a script: find the packages beside this folder, here and in local workers
    _HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, _HERE)
    os.environ["PYTHONPATH"] = os.pathsep.join([_HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import load
from kmerlens.operators import counting, enrichment, specificity

log = logging.getLogger("jobs.candidate_report")


def _write(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df as Parquet in place of what was there, read again with the types that it had."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("wrote %d rows to %s", out.count(), path)
    return out


def dominant_chromosome(counts: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """(code, chrom, chrom_share, chrom_tied): where most target hits of all haps lie, the first of equals."""
    per = counts.where(F.col("region").isin(*targets)).groupBy("code", "chrom").agg(F.sum("n").alias("n"))
    best = specificity.dominant(per, ["code"], "n", F.col("chrom"))
    return best.select("code", F.col("best").alias("chrom"), (F.col("top") / F.col("total")).alias("chrom_share"), F.col("tied").alias("chrom_tied"))


def run(spark: SparkSession, occurrences: str, out: str, settings: dict | None = None) -> DataFrame:
    """Writes all tables and gives the selected k-mers as they were written."""
    settings, out = settings or load("candidate_report"), out.rstrip("/")
    col, reference, targets = settings["columns"], F.col("hap") == settings["reference"], tuple(settings["targets"])
    rows = spark.read.parquet(occurrences)
    log.info("reading %d occurrences of %s", rows.count(), occurrences)
    by = [F.expr(col[c]).alias(c) for c in ("hap", "chrom", "region")]
    # one pass: occurrences are read once, and what is summed by k-mer is summed further without them
    sums = rows.select(F.expr(col["code"]).alias("code"), *by, F.expr(col["n"]).alias("n"), F.expr(col["valid_starts"]).alias("v"))
    counts = _write(sums.groupBy("code", "hap", "chrom", "region").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), f"{out}/counts", "region")
    den = _write(counts.groupBy("hap", "chrom", "region").agg(F.sum("v").alias("valid_starts")), f"{out}/denominators")

    pooled = enrichment.pooled_enrichment(counts, den, reference, settings["pooled_min"], settings["threshold"], targets)
    local = enrichment.hap_enrichment(counts, den, settings["hap_min"], settings["threshold"], targets)
    chosen = enrichment.selection(pooled, local, den, reference, targets).where("selected")
    where = dominant_chromosome(counts.where(~reference), targets)
    table = chosen.join(where, "code", "left").select("code", "t", "b", "e", "prevalence", "prevalence_fraction", "qualifying_haps", "mean_hap_e", "min_hap_e", "max_hap_e", "chrom", "chrom_share", "chrom_tied", "selection_reason")
    selected = _write(table, f"{out}/selected", "selection_reason")
    brief = selected.groupBy("selection_reason").agg(F.count("*").alias("kmers"), F.sum("t").alias("targets"), F.expr("percentile_approx(prevalence, 0.5)").alias("median_prevalence"))
    brief.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{out}/summary")
    return selected


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--occurrences", required=True, help="Parquet table or folder")
    parser.add_argument("--out", required=True)
    parser.add_argument("--settings", help="TOML file; keys that it lacks are as in candidate_report.toml")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("candidate_report").getOrCreate()
    try:
        run(spark, given.occurrences, given.out, load("candidate_report", given.settings))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
