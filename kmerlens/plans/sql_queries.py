"""Queries written in SQL alone, over the library's SQL functions."""

from __future__ import annotations

from ..functions import sql as functions
from . import fixtures as fx
from .registry import query

_ENRICHED = """
WITH t AS (SELECT code, sum(n) FILTER (WHERE region <> 'background') AS t, sum(n) FILTER (WHERE region = 'background') AS b FROM {c} WHERE hap <> 0 GROUP BY code),
d AS (SELECT sum(valid_starts) FILTER (WHERE region <> 'background') AS den_t, sum(valid_starts) FILTER (WHERE region = 'background') AS den_b FROM {d} WHERE hap <> 0)
SELECT /*+ BROADCAST(d) */ code, coalesce(t, 0) AS t, coalesce(b, 0) AS b, round(log_enrichment(coalesce(t, 0), den_t, coalesce(b, 0), den_b), 6) AS e, round(1e6 * density(coalesce(t, 0), den_t), 6) AS per_million
FROM t CROSS JOIN d
"""


@query("sql_enrichment", fx.sql("c d tb", "SELECT code, t, b, round(e, 6) AS e, round(CAST(t AS DOUBLE) / den_t * 1e6, 6) AS per_million FROM pe"))
def sql_enrichment(spark, sf):
    functions.register(spark)
    return spark.sql(_ENRICHED, c=fx.counts(spark, sf), d=fx.den(spark, sf))


_FEATURES = """
WITH k AS (SELECT p_partkey, kmer_decode((p_partkey * 2654435761) % 4294967296, 16) AS kmer FROM {p})
SELECT p_partkey, kmer, kmer_rc(kmer) AS reverse_complement, kmer_canonical(kmer) AS canonical, kmer_encode(kmer_canonical(kmer)) AS code, kmer_gc(kmer) AS gc,
  CAST(kmer_distance_either(kmer, 'ACGTACGTACGTTTTT') AS BIGINT) AS distance FROM k
"""
_KMER = "list_aggregate(list_transform(range(16), lambda i: substr('ACGT', CAST(((p_partkey * 2654435761) % 4294967296) // pow(4, 15 - i)::BIGINT % 4 AS INT) + 1, 1)), 'string_agg', '')"


@query("sql_kmer_features", f"WITH k AS (SELECT p_partkey, {_KMER} AS kmer FROM part), r AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM k) SELECT p_partkey, kmer, rc AS reverse_complement, least(kmer, rc) AS canonical, CAST(list_sum(list_transform(range(16), lambda i: CAST(strpos('ACGT', substr(least(kmer, rc), i + 1, 1)) - 1 AS BIGINT) << (2 * (15 - i)))) AS BIGINT) AS code, 100.0::DOUBLE * length(translate(kmer, 'AT', '')) / 16 AS gc, CAST(least(hamming(kmer, 'ACGTACGTACGTTTTT'), hamming(kmer, 'AAAAACGTACGTACGT')) AS BIGINT) AS distance FROM r")
def sql_kmer_features(spark, sf):
    functions.register(spark)
    return spark.sql(_FEATURES, p=fx.table(spark, sf, "part"))
