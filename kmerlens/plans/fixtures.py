"""Views of the driver tables that have the shapes of the domain, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import spread

REFERENCE_HAP = 0
REFERENCE_SOURCE = "src0"
POOLED_MIN, HAP_MIN, THRESHOLD = 100, 40, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region(flag: str):
    return F.when(F.col(flag) == "R", "HSat2").when(F.col(flag) == "A", "HSat3").otherwise("background")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("hap"), F.col("l_linenumber").alias("chrom"), _region("l_returnflag").alias("region"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("code", "hap", "chrom", "region").agg(F.sum("q").alias("n"))


def den(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("hap"), F.col("l_linenumber").alias("chrom"), _region("l_returnflag").alias("region"), F.floor("l_extendedprice").alias("v"))
    return rows.groupBy("hap", "chrom", "region").agg(F.sum("v").alias("valid_starts"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences: letters become bases, line ends break windows, the rest goes."""
    docs = spread(table(spark, sf_dir, "documents"))
    region = F.when(F.col("lang") == "fr", "HSat2").when(F.col("lang") == "de", "HSat3").otherwise("background")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z\n]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC")
    return docs.select("doc_id", F.col("source").alias("hap"), (F.col("doc_id") % 6).alias("chrom"), region.alias("region"), seq.alias("seq"))


def bases(spark: SparkSession, sf_dir: str) -> int:
    """At least as many as all sequences have."""
    return table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") * 200 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')")
    return rows.select((F.col("l_suppkey") % 24).alias("chromosome"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "R", "HSat2").otherwise("HSat3").alias("label"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 chromosomes, each 200 bases longer than the last interval may reach."""
    top = table(spark, sf_dir, "part").agg(((F.max("p_partkey") + 2) * 200).alias("length"))
    return spark.range(24).select(F.col("id").alias("chromosome")).crossJoin(F.broadcast(top))  # one row


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "part").agg(((F.max("p_partkey") + 1) * 200).alias("top"))
    rows = table(spark, sf_dir, "events").crossJoin(F.broadcast(top))  # one row
    start = (F.col("event_id") * 7919) % F.col("top")
    return rows.select("event_id", (F.col("user_id") % 24).alias("chromosome"), start.alias("start"), (start + 16).alias("end"), F.col("event_type").alias("kmer"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


REGION = "CASE l_returnflag WHEN 'R' THEN 'HSat2' WHEN 'A' THEN 'HSat3' ELSE 'background' END"
CTE = {
    "c": f"c AS (SELECT l_partkey AS code, l_suppkey AS hap, l_linenumber AS chrom, {REGION} AS region, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3, 4)",
    "d": f"d AS (SELECT l_suppkey AS hap, l_linenumber AS chrom, {REGION} AS region, CAST(SUM(FLOOR(l_extendedprice)) AS BIGINT) AS valid_starts FROM lineitem GROUP BY 1, 2, 3)",
    "s": "s AS (SELECT doc_id, source AS hap, doc_id % 6 AS chrom, CASE lang WHEN 'fr' THEN 'HSat2' WHEN 'de' THEN 'HSat3' ELSE 'background' END AS region, translate(regexp_replace(lower(text), '[^a-z' || chr(10) || ']', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)",
    "w": "w0 AS (SELECT hap, chrom, region, doc_id, seq, unnest(range(1, greatest(1, length(seq) - 14))) AS i FROM s), w1 AS (SELECT hap, chrom, region, doc_id, i - 1 AS start, substr(seq, i, 16) AS k FROM w0 WHERE strpos(substr(seq, i, 16), chr(10)) = 0 AND length(substr(seq, i, 16)) = 16), w2 AS (SELECT *, reverse(translate(k, 'ACGT', 'TGCA')) AS rc FROM w1), w AS (SELECT hap, chrom, region, doc_id, start, least(k, rc) AS kmer, CASE WHEN k > rc THEN 1 ELSE 0 END AS strand FROM w2)",
    "iv": "iv AS (SELECT l_suppkey % 24 AS chromosome, l_partkey * 200 + l_linenumber AS s, l_partkey * 200 + l_linenumber + CAST(l_quantity AS BIGINT) AS e, CASE l_returnflag WHEN 'R' THEN 'HSat2' ELSE 'HSat3' END AS label FROM lineitem WHERE l_returnflag IN ('R', 'A'))",
    "len": "len AS (SELECT range AS chromosome, (SELECT (max(p_partkey) + 2) * 200 FROM part) AS length FROM range(24))",
    "h": "h AS (SELECT event_id, user_id % 24 AS chromosome, (event_id * 7919) % (SELECT (max(p_partkey) + 1) * 200 FROM part) AS s, (event_id * 7919) % (SELECT (max(p_partkey) + 1) * 200 FROM part) + 16 AS e, event_type AS kmer, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events)",
    # islands of intervals, also of each family
    "m": "m AS (SELECT chromosome, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY chromosome ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chromosome ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv)) GROUP BY chromosome, g)",
    "f": "f AS (SELECT chromosome, label, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY chromosome, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chromosome, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv)) GROUP BY chromosome, label, g)",
    "x": "x AS (SELECT a.chromosome, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM f a JOIN f b ON a.chromosome = b.chromosome AND a.label = 'HSat2' AND b.label = 'HSat3' AND a.s < b.e AND b.s < a.e)",
    # target and background sums, pooled and by hap, as E needs them
    "tb": "dt AS (SELECT hap, CAST(sum(CASE WHEN region <> 'background' THEN valid_starts ELSE 0 END) AS BIGINT) AS den_t, CAST(sum(CASE WHEN region = 'background' THEN valid_starts ELSE 0 END) AS BIGINT) AS den_b FROM d GROUP BY hap), ht AS (SELECT code, hap, CAST(sum(CASE WHEN region <> 'background' THEN n ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN region = 'background' THEN n ELSE 0 END) AS BIGINT) AS b FROM c GROUP BY code, hap), he AS (SELECT ht.*, den_t, den_b, CASE WHEN den_t > 0 AND den_b > 0 THEN log2((CAST(t AS DOUBLE) / den_t + 1e-9) / (CAST(b AS DOUBLE) / den_b + 1e-9)) END AS e FROM ht JOIN dt USING (hap)), pd AS (SELECT CAST(sum(den_t) AS BIGINT) AS den_t, CAST(sum(den_b) AS BIGINT) AS den_b FROM dt WHERE hap <> 0), pt AS (SELECT code, CAST(sum(t) AS BIGINT) AS t, CAST(sum(b) AS BIGINT) AS b FROM ht WHERE hap <> 0 GROUP BY code), pe AS (SELECT pt.*, den_t, den_b, CASE WHEN den_t > 0 AND den_b > 0 THEN log2((CAST(t AS DOUBLE) / den_t + 1e-9) / (CAST(b AS DOUBLE) / den_b + 1e-9)) END AS e FROM pt, pd)",
    # counts and denominators with the union as a third region
    "u": "u AS (SELECT code, hap, chrom, region, n FROM c WHERE region <> 'background' UNION ALL SELECT code, hap, chrom, 'HSat23', CAST(sum(n) AS BIGINT) FROM c WHERE region <> 'background' GROUP BY 1, 2, 3), ud AS (SELECT hap, chrom, region, valid_starts FROM d WHERE region <> 'background' UNION ALL SELECT hap, chrom, 'HSat23', CAST(sum(valid_starts) AS BIGINT) FROM d WHERE region <> 'background' GROUP BY 1, 2)",
}


def sql(names: str, body: str) -> str:
    """``body`` behind the named common table expressions; it may go on with further ones."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + ("" if body.startswith(",") else " ") + body
