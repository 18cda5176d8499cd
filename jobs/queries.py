"""The jobs as queries: each runs twice into one new folder and gives the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kmerlens.plans import fixtures as fx
from kmerlens.plans.registry import rounded
from kmerlens.plans.written import shared_folder

from . import candidate_report, spectrum_update


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_spectrum_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        out = spectrum_update.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        out = candidate_report.run(spark, f"{sf_dir}/lineitem.parquet", at)
    return rounded(out, "e", "prevalence_fraction", "mean_hap_e", "min_hap_e", "max_hap_e", "chrom_share")


QUERIES = {"job1_spectrum_update": job1_spectrum_update, "job2_candidate_report": job2_candidate_report}

ORACLE_SQL = {
    "job1_spectrum_update": fx.sql("s w", "SELECT region, kmer, CAST(sum(n) AS BIGINT) AS pooled, count(*) AS haps, max(n) AS largest FROM (SELECT region, kmer, hap, count(*) AS n FROM w WHERE hap <> 'src0' GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= 20 OR max(n) >= 10"),
    "job2_candidate_report": fx.sql("c d tb", """, hs AS (SELECT code, count_if(t > 0) AS prevalence, count_if(t >= 40 AND e > 0.5) AS qualifying_haps, sum(e) AS es, min(e) AS e0, max(e) AS e1, count(e) AS en FROM he WHERE hap <> 0 GROUP BY code),
mh AS (SELECT count(*) AS m FROM dt WHERE hap <> 0 AND den_t > 0 AND den_b > 0),
ch AS (SELECT code, chrom, sum(n) AS n FROM c WHERE hap <> 0 AND region <> 'background' GROUP BY 1, 2),
tp AS (SELECT code, max(n) AS top, sum(n) AS total FROM ch GROUP BY code),
dm AS (SELECT code, min(chrom) AS chrom, any_value(CAST(top AS DOUBLE) / total) AS chrom_share, count(*) > 1 AS chrom_tied FROM ch JOIN tp USING (code) WHERE n = top GROUP BY code)
SELECT pe.code, t, b, round(pe.e, 6) AS e, coalesce(prevalence, 0) AS prevalence, round(coalesce(prevalence, 0) / m, 6) AS prevalence_fraction, coalesce(qualifying_haps, 0) AS qualifying_haps, round(coalesce(es, 0) / m, 6) AS mean_hap_e,
  round(least(e0, CASE WHEN m > coalesce(en, 0) THEN 0 END), 6) AS min_hap_e, round(greatest(e1, CASE WHEN m > coalesce(en, 0) THEN 0 END), 6) AS max_hap_e, chrom, round(chrom_share, 6) AS chrom_share, chrom_tied,
  CASE WHEN NOT (t >= 100 AND pe.e > 0.5) THEN 'hap' WHEN qualifying_haps > 0 THEN 'pooled_and_hap' ELSE 'pooled' END AS selection_reason
FROM pe CROSS JOIN mh LEFT JOIN hs USING (code) LEFT JOIN dm USING (code) WHERE (t >= 100 AND pe.e > 0.5) OR qualifying_haps > 0"""),
}
