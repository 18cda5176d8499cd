"""Counts of one hap or one k-mer from a count table, as tab-separated text.

    python -m kmerlens.cli --counts counts.parquet --kmer ACGTACGTACGTACGT
    python -m kmerlens.cli --counts counts.parquet --hap sample_1 --pilot 3

The table has the columns hap, code and n, and may have others. --kmer takes either orientation; an
unknown k-mer or hap is an error. --pilot keeps the first haps only.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kmer as K
from .operators import counting


def select(counts: DataFrame, kmer: str | None, hap: str | None, first: int | None = None, k: int = 16) -> DataFrame:
    rows = counts
    if first is not None:
        rows = rows.join(counting.pilot(counts.select("hap").distinct(), first), "hap")
    if hap is not None:
        rows = counting.lookup(rows, "hap", hap, counts.select(F.col("hap").cast("string").alias("hap")))
    if kmer is not None:
        rows = counting.lookup_kmer(rows, kmer, counts.select("code"), k)
    return rows.withColumn("kmer", K.decode(F.col("code"), k)).drop("code").orderBy("hap", "kmer")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--counts", required=True)
    parser.add_argument("--kmer")
    parser.add_argument("--hap")
    parser.add_argument("--pilot", type=int)
    parser.add_argument("-k", type=int, default=16)
    given = parser.parse_args(arguments)
    if given.kmer is None and given.hap is None:
        parser.error("give --kmer, --hap or both")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        rows = select(spark.read.parquet(given.counts), given.kmer, given.hap, given.pilot, given.k)
    except (KeyError, ValueError) as error:
        print(error.args[0], file=sys.stderr)
        return 2
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("NA" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
