"""Scalar SQL functions of k-mers and measures, for queries written in SQL.

Their bodies are SQL, so Spark puts them into plans in place: nothing is called row by row. NULL in
gives NULL out, and a ratio without a positive denominator is NULL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, type, body; later ones may use earlier ones.
FUNCTIONS = [
    ("kmer_rc", "kmer STRING", "STRING", "reverse(translate(kmer, 'ACGT', 'TGCA'))"),
    ("kmer_canonical", "kmer STRING", "STRING", "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"),
    ("kmer_encode", "kmer STRING", "BIGINT", "CASE WHEN upper(kmer) RLIKE '^[ACGT]{1,31}$' THEN CAST(conv(translate(upper(kmer), 'ACGT', '0123'), 4, 10) AS BIGINT) END"),
    ("kmer_decode", "code BIGINT, k INT", "STRING", "translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT')"),
    ("kmer_gc", "kmer STRING", "DOUBLE", "100.0D * length(translate(kmer, 'AT', '')) / length(kmer)"),
    ("kmer_distance", "a STRING, b STRING", "INT", "size(filter(sequence(1, length(a)), i -> substring(a, i, 1) <> substring(b, i, 1)))"),
    ("kmer_distance_either", "a STRING, b STRING", "INT", "least(kmer_distance(a, b), kmer_distance(a, kmer_rc(b)))"),
    ("density", "n DOUBLE, starts DOUBLE", "DOUBLE", "CASE WHEN starts > 0 THEN n / starts END"),
    ("log_enrichment", "t DOUBLE, den_t DOUBLE, b DOUBLE, den_b DOUBLE", "DOUBLE", "log2((density(t, den_t) + 1e-9D) / (density(b, den_b) + 1e-9D))"),
]


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session's SQL."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
