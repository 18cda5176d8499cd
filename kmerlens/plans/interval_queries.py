"""Queries on intervals, positions and input eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, intervals, landscape
from ..sources import eligibility
from . import fixtures as fx
from .registry import query
from .written import written

WIDTH = 2048


def _families(spark, sf):
    iv = fx.intervals(spark, sf)
    return {f: intervals.merge(iv.where(F.col("label") == f)) for f in ("HSat2", "HSat3")}


def _union(spark, sf):
    return intervals.merge(fx.intervals(spark, sf))


def _partition(spark, sf):
    return intervals.region_partition(fx.intervals(spark, sf), fx.lengths(spark, sf), store=written)


_SE = 's AS start, e AS "end"'
_ONLY = "{name} AS (SELECT chromosome, s, min(e) AS e FROM (SELECT a.chromosome, a.s, coalesce(x.s, a.fe) AS e FROM (SELECT f.chromosome, f.s, f.e AS fe FROM f WHERE label = '{fam}' UNION SELECT f.chromosome, x.e, f.e FROM f JOIN x ON x.chromosome = f.chromosome AND f.label = '{fam}' AND x.s >= f.s AND x.e <= f.e) a LEFT JOIN x ON x.chromosome = a.chromosome AND x.s >= a.s AND x.e <= a.fe) WHERE s < e GROUP BY 1, 2 HAVING min(e) > s)"
# a start that coincides with the start of an overlap gives nothing
_CUT = {f: _ONLY.format(name=n, fam=f).replace("WHERE s < e GROUP", "GROUP") for f, n in (("HSat2", "o2"), ("HSat3", "o3"))}
_BG = "bg AS (SELECT chromosome, s, min(e) AS e FROM (SELECT a.chromosome, a.s, coalesce(m.s, a.length) AS e FROM (SELECT chromosome, CAST(0 AS BIGINT) AS s, length FROM len UNION SELECT m.chromosome, m.e, length FROM m JOIN len USING (chromosome)) a LEFT JOIN m ON m.chromosome = a.chromosome AND m.s >= a.s) GROUP BY 1, 2 HAVING min(e) > s)"
_PART = f", {_CUT['HSat2']}, {_CUT['HSat3']}, {_BG}, pt AS (SELECT chromosome, 'HSat2' AS region, s, e FROM o2 UNION ALL SELECT chromosome, 'HSat3', s, e FROM o3 UNION ALL SELECT chromosome, 'HSat23', s, e FROM m UNION ALL SELECT chromosome, 'ambiguous', s, e FROM x UNION ALL SELECT chromosome, 'background', s, e FROM bg)"


@query("interval_merge", fx.sql("iv m", f"SELECT chromosome, {_SE} FROM m"))
def interval_merge(spark, sf):
    return _union(spark, sf)


@query("interval_intersect", fx.sql("iv f x", f"SELECT chromosome, {_SE} FROM x"))
def interval_intersect(spark, sf):
    f = _families(spark, sf)
    return intervals.intersect(f["HSat2"], f["HSat3"], width=WIDTH)


@query("interval_subtract", fx.sql("iv f x", f", {_CUT['HSat2']} SELECT chromosome, {_SE} FROM o2"))
def interval_subtract(spark, sf):
    f = _families(spark, sf)
    return intervals.subtract(f["HSat2"], intervals.intersect(f["HSat2"], f["HSat3"], width=WIDTH))


@query("interval_complement", fx.sql("iv m len", f", {_BG} SELECT chromosome, {_SE} FROM bg"))
def interval_complement(spark, sf):
    return intervals.complement(_union(spark, sf), fx.lengths(spark, sf))


@query("region_partition", fx.sql("iv m f x len", _PART + f" SELECT chromosome, region, {_SE} FROM pt"))
def region_partition(spark, sf):
    return _partition(spark, sf)


@query("region_stats", fx.sql("iv m f x len", _PART + " SELECT chromosome, region, count(*) AS intervals, CAST(sum(e - s) AS BIGINT) AS bp, CAST(sum(greatest(0, e - s - 15)) AS BIGINT) AS valid_starts FROM pt GROUP BY 1, 2"))
def region_stats(spark, sf):
    size = F.col("end") - F.col("start")
    return _partition(spark, sf).groupBy("chromosome", "region").agg(F.count("*").alias("intervals"), F.sum(size).alias("bp"), F.sum(F.greatest(F.lit(0), size - 15)).alias("valid_starts"))


@query("overlap_pairs", fx.sql("iv h", "SELECT h.event_id, h.chromosome, iv.label, count(*) AS n, CAST(sum(least(h.e, iv.e) - greatest(h.s, iv.s)) AS BIGINT) AS bases FROM h JOIN iv ON h.chromosome = iv.chromosome AND h.s < iv.e AND iv.s < h.e GROUP BY 1, 2, 3"))
def overlap_pairs(spark, sf):
    pairs = intervals.overlap_join(fx.hits(spark, sf).select("event_id", "chromosome", "start", "end"), fx.intervals(spark, sf), width=WIDTH)
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    return pairs.groupBy("event_id", "chromosome", F.col("b_label").alias("label")).agg(F.count("*").alias("n"), F.sum(shared).alias("bases"))


@query("hits_containment", fx.sql("iv m h", 'SELECT event_id, chromosome, s AS start, e AS "end", kmer, strand FROM h WHERE EXISTS (SELECT 1 FROM m WHERE m.chromosome = h.chromosome AND m.s <= h.s AND h.e <= m.e)'))
def hits_containment(spark, sf):
    return intervals.inside(fx.hits(spark, sf), _union(spark, sf), width=WIDTH)


def _hit_regions(spark, sf):
    """Hits with ``inside``: whether the union of the intervals contains them whole."""
    hits = fx.hits(spark, sf)
    inner = intervals.inside(hits, _union(spark, sf), width=WIDTH).select("event_id", F.lit(True).alias("inside"))
    return hits.join(inner, "event_id", "left").fillna(False, ["inside"])


@query("hits_asof", fx.sql("iv h", ", i AS (SELECT chromosome, s, max(e) AS e FROM iv GROUP BY 1, 2) SELECT event_id, h.chromosome, i.s AS i_start, i.e AS i_end, coalesce(h.e <= i.e, FALSE) AS inside FROM h ASOF LEFT JOIN i ON h.chromosome = i.chromosome AND h.s >= i.s"))
def hits_asof(spark, sf):
    rows = intervals.asof(fx.hits(spark, sf), fx.intervals(spark, sf))
    return rows.select("event_id", "chromosome", "i_start", "i_end", F.coalesce(F.col("end") <= F.col("i_end"), F.lit(False)).alias("inside"))


_INS = "EXISTS (SELECT 1 FROM {t} k WHERE k.chromosome = h.chromosome AND k.s <= h.s AND h.e <= k.e{w})"
_LABEL = "CASE WHEN " + _INS.format(t="f", w=" AND k.label = 'HSat3'") + " THEN 'HSat3' WHEN " + _INS.format(t="f", w=" AND k.label = 'HSat2'") + " THEN 'HSat2' ELSE 'outside' END"


def _merged(spark, sf, store=lambda df: df):
    """(chromosome, label, start, end): both families, each merged."""
    return intervals.merge(fx.intervals(spark, sf), ["chromosome", "label"], store=store)


def _labelled(spark, sf, merged=None):
    return intervals.priority_label(fx.hits(spark, sf), merged or _merged(spark, sf), ("HSat3", "HSat2"), "event_id", width=WIDTH)


@query("hits_priority_label", fx.sql("iv f h", f"SELECT event_id, {_LABEL} AS label FROM h"))
def hits_priority_label(spark, sf):
    return _labelled(spark, sf).select("event_id", "label")


@query("hits_region_case", fx.sql("iv m f x len h", _PART + " SELECT event_id, CASE " + " ".join("WHEN " + _INS.format(t="pt", w=f" AND k.region = '{r}'") + f" THEN '{r}'" for r in ("HSat3", "HSat2", "ambiguous")) + " ELSE 'background_or_boundary' END AS region FROM h"))
def hits_region_case(spark, sf):
    parts = _partition(spark, sf).where("region in ('HSat2', 'HSat3', 'ambiguous')").withColumnRenamed("region", "label")
    out = intervals.priority_label(fx.hits(spark, sf), parts, ("HSat3", "HSat2", "ambiguous"), "event_id", width=WIDTH)
    return out.select("event_id", F.when(F.col("label") == "outside", "background_or_boundary").otherwise(F.col("label")).alias("region"))


def _overlay(spark, sf, merged=None):
    return landscape.overlay_counts(_labelled(spark, sf, merged), ["kmer", "chromosome"], F.col("label") != "outside", F.col("label"), ("HSat3", "HSat2", "outside"))


_OV = f", l AS (SELECT kmer, chromosome, {_LABEL} AS label FROM h), ov AS (SELECT kmer, chromosome, count(*) AS total, count_if(label <> 'outside') AS inside, count_if(label = 'outside') AS outside, count_if(label = 'HSat3') AS fine_hsat3, count_if(label = 'HSat2') AS fine_hsat2, count_if(label = 'outside') AS fine_outside FROM l GROUP BY 1, 2)"
_NAMES = ("total", "inside", "outside", "fine_hsat3", "fine_hsat2", "fine_outside")


@query("hits_overlay_grid", fx.sql("iv f h", _OV + " SELECT k.kmer, r.range AS chromosome, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NAMES) + " FROM (SELECT DISTINCT kmer FROM h) k CROSS JOIN range(24) r LEFT JOIN ov ON ov.kmer = k.kmer AND ov.chromosome = r.range"))
def hits_overlay_grid(spark, sf):
    chromosomes = spark.range(24).select(F.col("id").alias("chromosome"))
    return landscape.dense(_overlay(spark, sf), fx.hits(spark, sf).select("kmer").distinct(), chromosomes, list(_NAMES))


@query("hits_totals", fx.sql("iv f h", _OV + " SELECT kmer, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _NAMES) + ", count(*) AS chromosomes_with_hits FROM ov GROUP BY kmer"))
def hits_totals(spark, sf):
    return _overlay(spark, sf).groupBy("kmer").agg(*(F.sum(c).alias(c) for c in _NAMES), F.count_if(F.col("total") > 0).alias("chromosomes_with_hits"))


@query("hits_bins", fx.sql("h", "SELECT chromosome, kmer, (s // 10000) * 10000 AS bin_start, (s // 10000) * 10000 + 10000 AS bin_end, count(*) AS n, count_if(strand = '+') AS forward, count_if(strand = '-') AS reverse FROM h GROUP BY 1, 2, 3"))
def hits_bins(spark, sf):
    return landscape.bins(fx.hits(spark, sf), 10000, ["chromosome", "kmer"])


@query("hits_bins_filled", fx.sql("h", ", b AS (SELECT chromosome, (s // 10000) * 10000 AS bin_start, count(*) AS n FROM h GROUP BY 1, 2), g AS (SELECT chromosome, unnest(range(min(bin_start), max(bin_start) + 1, 10000)) AS bin_start FROM b GROUP BY chromosome) SELECT g.chromosome, g.bin_start, coalesce(n, 0) AS n FROM g LEFT JOIN b ON b.chromosome = g.chromosome AND b.bin_start = g.bin_start"))
def hits_bins_filled(spark, sf):
    return landscape.gap_filled(landscape.bins(fx.hits(spark, sf), 10000, ["chromosome"]), 10000, ["chromosome"])


def _inputs(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("hap"), F.col("l_linenumber").alias("chromosome"), "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    haps = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hap"), (F.col("s_acctbal") > 0).alias("complete"))
    passed = li.where("l_returnflag = 'R'").select("hap", "chromosome").distinct()
    lengths = li.where("l_linestatus = 'O' or l_returnflag = 'N' or hap % 5 > 0").groupBy("hap", "chromosome").agg(((F.max("l_partkey") + 1) * 200).alias("length"))
    start = F.col("l_partkey") * 200 - 150
    return haps, passed, lengths, li.select("hap", "chromosome", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


_IN = "li AS (SELECT l_suppkey AS hap, l_linenumber AS chromosome, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf, l_linestatus AS ls FROM lineitem), pa AS (SELECT DISTINCT hap, chromosome FROM li WHERE rf = 'R'), ln AS (SELECT hap, chromosome, (max(l_partkey) + 1) * 200 AS length FROM li WHERE ls = 'O' OR rf = 'N' OR hap % 5 > 0 GROUP BY 1, 2), an AS (SELECT hap, chromosome, l_partkey * 200 - 150 AS s, l_partkey * 200 - 150 + q AS e FROM li), bad AS (SELECT an.* FROM an LEFT JOIN ln USING (hap, chromosome) WHERE NOT coalesce(s >= 0 AND s < e AND e <= length, FALSE)), el AS (SELECT s_suppkey AS hap, CASE WHEN s_suppkey IN (SELECT hap FROM bad) THEN 'EXCLUDE_invalid_coordinate' WHEN s_suppkey IN (SELECT hap FROM pa ANTI JOIN ln USING (hap, chromosome)) THEN 'EXCLUDE_missing_chromosome' WHEN NOT s_acctbal > 0 THEN 'EXCLUDE_incomplete_input' ELSE 'PASS' END AS reason FROM supplier)"


@query("eligibility", f"WITH {_IN} SELECT * FROM el")
def eligibility_reasons(spark, sf):
    haps, passed, lengths, annotation = _inputs(spark, sf)
    return eligibility.eligibility(haps, passed, lengths, eligibility.split_annotation(annotation, lengths)[1])


@query("invalid_annotations", f'WITH {_IN} SELECT hap, chromosome, s AS start, e AS "end", count(*) AS n FROM bad GROUP BY 1, 2, 3, 4')
def invalid_annotations(spark, sf):
    _, _, lengths, annotation = _inputs(spark, sf)
    return eligibility.split_annotation(annotation, lengths)[1].groupBy("hap", "chromosome", "start", "end").agg(F.count("*").alias("n"))


@query("chromosome_status", f"WITH {_IN} SELECT hap, chromosome, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS passed, CASE WHEN q IS NULL THEN 0 ELSE 1 END AS present, CASE WHEN p = 1 THEN reason ELSE 'EXCLUDE_not_passed' END AS status FROM (SELECT hap, chromosome, p, q FROM (SELECT *, 1 AS p FROM pa) FULL JOIN (SELECT hap, chromosome, 1 AS q FROM ln) USING (hap, chromosome)) LEFT JOIN el USING (hap)")
def chromosome_status(spark, sf):
    haps, passed, lengths, annotation = _inputs(spark, sf)
    reasons = eligibility.eligibility(haps, passed, lengths, eligibility.split_annotation(annotation, lengths)[1])
    return eligibility.chromosome_status(reasons, passed, lengths)


@query("audit_intervals", "SELECT unnest(['partition', 'overlay_sums', 'containment_agrees']) AS \"check\", CAST(0 AS BIGINT) AS violations")
def audit_intervals(spark, sf):
    """Merged families and their union are written once, for all checks."""
    hits, lengths = fx.hits(spark, sf), fx.lengths(spark, sf)
    merged = written(_merged(spark, sf, written))
    union = written(intervals.merge(merged.select("chromosome", "start", "end"), store=written))
    by_asof = intervals.asof(hits, union).where(F.col("end") <= F.col("i_end")).select("event_id")
    return audit.violations(
        {
            "partition": audit.partition_identity(intervals.partition_merged(merged, union, lengths, store=written), lengths, ["chromosome"]),
            "overlay_sums": audit.hits_add_up(_overlay(spark, sf, merged), ["fine_hsat3", "fine_hsat2", "fine_outside"]),
            "containment_agrees": audit.sets_differ(by_asof, intervals.inside(hits, union, width=WIDTH).select("event_id")),
        }
    )
