"""Queries behind the tables of the final reports: selections, summaries, series and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kmer as K
from ..functions import measures as M
from ..operators import audit, cluster, counting, landscape, mismatch, ranking
from ..operators.quantiles import quantiles
from ..sources import files
from . import fixtures as fx
from .count_queries import _FAM, _haps, _nonref, _share
from .interval_queries import _hit_regions
from .ranking_queries import _SCORE, _scored
from .registry import query, rounded
from .sequence_queries import _TOP, _most, _top, _windows
from .written import written


@query("prevalence_histogram", fx.sql("c d", _FAM + ", pv AS (SELECT code, count(*) / CAST((SELECT count(DISTINCT hap) FROM d WHERE hap <> 0) AS DOUBLE) AS v FROM le GROUP BY code), b AS (SELECT CAST(least(floor(v / 0.05)::INT + 1, 20) AS INT) AS bin, count(*) AS n FROM pv GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, round((r.range - 0.5) * 0.05, 6) AS midpoint, coalesce(n, 0) AS n FROM range(1, 21) r LEFT JOIN b ON b.bin = r.range"))
def prevalence_histogram(spark, sf):
    haps = _haps(spark, sf).count()
    rows = _share(spark, sf).withColumn("v", F.col("prevalence") / F.lit(haps).cast("double"))
    return rounded(landscape.histogram(rows, "v", 0.0, 1.0, 20), "midpoint")


@query("strand_fraction_histogram", fx.sql("s w", ", fr AS (SELECT kmer, count_if(strand = 0) / CAST(count(*) AS DOUBLE) AS v FROM w GROUP BY kmer HAVING count(*) >= 5), b AS (SELECT CAST(least(floor(v / 0.05)::INT + 1, 20) AS INT) AS bin, count(*) AS n FROM fr GROUP BY 1) SELECT CAST(r.range AS INT) AS bin, round((r.range - 0.5) * 0.05, 6) AS midpoint, coalesce(n, 0) AS n FROM range(1, 21) r LEFT JOIN b ON b.bin = r.range"))
def strand_fraction_histogram(spark, sf):
    """How much of each frequent k-mer's hits lies on the strand of its canonical form."""
    sums = counting.strand_totals(fx.sequences(spark, sf), 5, bases=fx.bases(spark, sf))
    return rounded(landscape.histogram(sums.withColumn("v", M.ratio(F.col("f"), F.col("n"))), "v", 0.0, 1.0, 20), "midpoint")


_FIVE = ("least", "lower", "median", "upper", "greatest")


@query("score_quartiles", fx.sql("c d", _SCORE + " SELECT family, type, count(*) AS kmers, " + ", ".join(f"round(quantile_cont(round(score, 9), {i / 4}), 6) AS {n}" for i, n in enumerate(_FIVE)) + " FROM sc GROUP BY 1, 2"))
def score_quartiles(spark, sf):
    """What a box plot of the scores of each family and type draws."""
    rows = written(_scored(spark, sf).select("family", "type", F.round("score", 9).alias("score")), "scores")
    five = quantiles(rows, ["family", "type"], "score", {n: i / 4 for i, n in enumerate(_FIVE)})
    return rounded(rows.groupBy("family", "type").agg(F.count("*").alias("kmers")).join(five, ["family", "type"]), *_FIVE)


_ASSIGNED = ", cg AS (SELECT hap, chrom, region, sum(valid_starts) AS v FROM d WHERE region <> 'background' AND hap <> 0 GROUP BY 1, 2, 3), ga AS (SELECT gh.hap, gc.chrom, gr.region, v, CASE WHEN v >= 40000 THEN 'G' || gh.hap % 3 END AS grp FROM (SELECT DISTINCT hap FROM d WHERE hap <> 0) gh CROSS JOIN (SELECT DISTINCT chrom FROM d) gc CROSS JOIN (SELECT DISTINCT region FROM d WHERE region <> 'background') gr LEFT JOIN cg ON cg.hap = gh.hap AND cg.chrom = gc.chrom AND cg.region = gr.region)"


def _assigned(spark, sf):
    """(region, chrom, hap, grp, status): haps with many starts have a group of their own."""
    d = fx.den(spark, sf)
    cases = d.where("region <> 'background'").select("region").distinct().crossJoin(F.broadcast(d.select("chrom").distinct()))  # families by chromosomes
    own = _nonref(d).where("region <> 'background' and valid_starts > 0")
    groups = own.where("valid_starts >= 40000").select("region", "chrom", "hap", F.concat(F.lit("G"), F.col("hap") % 3).alias("grp"), F.lit("stable_partition").alias("status"))
    return cluster.status_grid(groups, d.select("hap").distinct(), cases, own, F.col("hap") == fx.REFERENCE_HAP, ["region", "chrom"])


@query("chromosome_groups", fx.sql("d", _ASSIGNED + " SELECT region, chrom, count_if(v IS NOT NULL) AS measurable, count(grp) AS assigned, count(DISTINCT grp) AS groups FROM ga GROUP BY 1, 2"))
def chromosome_groups(spark, sf):
    rows = _assigned(spark, sf).where("status <> 'reference_projection_only'")
    return rows.groupBy("region", "chrom").agg(F.count_if(F.col("status") != "missing_target_region").alias("measurable"), F.count("grp").alias("assigned"), F.count_distinct("grp").alias("groups"))


@query("status_counts", fx.sql("d", _ASSIGNED + " SELECT region, chrom, CASE WHEN grp IS NOT NULL THEN 'stable_partition' WHEN v IS NULL THEN 'missing_target_region' ELSE 'insufficient_measurable_haps' END AS status, count(*) AS haps FROM ga GROUP BY ALL UNION ALL SELECT region, chrom, 'reference_projection_only', 1 FROM (SELECT DISTINCT region, chrom FROM ga)"))
def status_counts(spark, sf):
    return _assigned(spark, sf).groupBy("region", "chrom", "status").agg(F.count("*").alias("haps"))


@query("outside_order", fx.sql("iv m h", ", hi AS (SELECT h.event_id, h.kmer || '_' || h.chromosome AS kmer, EXISTS (SELECT 1 FROM m WHERE m.chromosome = h.chromosome AND m.s <= h.s AND h.e <= m.e) AS inside FROM h), nk AS (SELECT kmer, count(*) AS total, count_if(NOT inside) AS outside FROM hi GROUP BY kmer UNION ALL SELECT 'absent_' || range, 0, 0 FROM range(3)) SELECT kmer, total, outside, row_number() OVER (ORDER BY outside DESC, coalesce(CAST(outside AS DOUBLE) / nullif(total, 0), 0) DESC, kmer) AS place FROM nk"))
def outside_order(spark, sf):
    """k-mers by hits outside all intervals, then by the share of these, which counts as 0 where a
    k-mer has no hit at all, then by name."""
    rows = _hit_regions(spark, sf).select(F.concat_ws("_", "kmer", F.col("chromosome").cast("string")).alias("kmer"), "inside")
    sums = rows.groupBy("kmer").agg(F.count("*").alias("total"), F.count_if(~F.col("inside")).alias("outside"))
    sums = sums.unionByName(spark.range(3).select(F.concat(F.lit("absent_"), F.col("id")).alias("kmer"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("outside")))
    return ranking.by_outside(sums, "kmer").select("kmer", "total", "outside", F.col("place").cast("long").alias("place"))


@query("top_three", fx.sql("c d", _SCORE + " SELECT code, kmer FROM sc WHERE family = 'HSat3' AND type = 0 ORDER BY round(score, 9) DESC, code LIMIT 3"))
def top_three(spark, sf):
    rows = _scored(spark, sf).where("family = 'HSat3' and type = 0").withColumn("score", F.round("score", 9))
    return ranking.exactly(rows, 3, [F.desc("score"), F.asc("code")]).select("code", "kmer")


_T72 = _SCORE + ", tp AS (SELECT code, kmer, row_number() OVER (ORDER BY round(score, 9) DESC, code) AS place FROM sc QUALIFY place <= 72)"


def _places(spark, sf, n: int = 72):
    rows = _scored(spark, sf).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "code").limit(n)
    return rows.select("code", "kmer", F.row_number().over(Window.orderBy(F.desc("score"), "code")).cast("long").alias("place"))


@query("seed_records", fx.sql("c d", _T72 + ", st AS (SELECT place, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM tp) SELECT place || '_F' AS name, kmer AS seq FROM st UNION ALL SELECT place || '_R', rc FROM st WHERE rc <> kmer"))
def seed_records(spark, sf):
    return files.seed_records(_places(spark, sf).select("place", K.encode(F.col("kmer")).alias("code")))


@query("new_queries", fx.sql("c d", _T72 + " SELECT place, code FROM tp WHERE code NOT IN (SELECT code FROM tp WHERE place <= 24)"))
def new_queries(spark, sf):
    """Of the final queries those that the first screen has not asked yet."""
    places = written(_places(spark, sf))
    return places.join(places.where("place <= 24").select("code"), "code", "left_anti").select("place", "code")


@query("merged_origins", fx.sql("c d", _T72 + ", qs AS (SELECT code, CASE WHEN place <= 24 THEN 'first' ELSE 'second' END AS origin FROM tp), oc AS (SELECT 'first' AS origin, code, hap, n FROM c UNION ALL SELECT 'second', code, hap, 2 * n FROM c) SELECT origin, code, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT hap) AS haps FROM qs JOIN oc USING (origin, code) GROUP BY 1, 2"))
def merged_origins(spark, sf):
    """Counts of each query from the screen that asked it, although both screens may have its code."""
    queries = _places(spark, sf).select("code", F.when(F.col("place") <= 24, "first").otherwise("second").alias("origin"))
    c = fx.counts(spark, sf).select("code", "hap", "n")
    both = mismatch.merge_origins(queries, {"first": c, "second": c.withColumn("n", 2 * F.col("n"))}, "code")
    return both.groupBy("origin", "code").agg(F.sum("n").alias("n"), F.count_distinct("hap").alias("haps"))


@query("prefix_bitmap", fx.sql("s w", ", p AS (SELECT DISTINCT list_sum(list_transform(range(0, 12), lambda i: CAST(strpos('ACGT', substr(kmer, i + 1, 1)) - 1 AS BIGINT) << (2 * (11 - i)))) AS p FROM (SELECT DISTINCT kmer FROM w)) SELECT CAST(CASE WHEN p > 0 THEN 1 + (p - 1) // 32768 ELSE 0 END AS BIGINT) AS bucket, count(*) AS prefixes FROM p GROUP BY 1"))
def prefix_bitmap(spark, sf):
    return counting.prefix_bitmap(_windows(spark, sf).select("code")).select("bucket", "prefixes")


@query("kmer_lookup", fx.sql("s w", _TOP.format(n=1) + " SELECT hap, region, count(*) AS n FROM w WHERE kmer IN (SELECT kmer FROM tp) GROUP BY 1, 2"))
def kmer_lookup(spark, sf):
    """The most frequent k-mer, asked for by its reverse complement in small letters."""
    top = _top(spark, sf, 1)
    counts = counting.seeded(fx.sequences(spark, sf), top, keys=["hap", "region"])
    asked = top.select(F.lower(K.reverse_complement(F.col("kmer")))).first()[0]
    return counting.lookup_kmer(counts, asked, counts).select("hap", "region", "n")


@query("substring_scan", fx.sql("s w", _TOP.format(n=5) + " SELECT doc_id, kmer, start FROM w WHERE kmer IN (SELECT kmer FROM tp)"))
def substring_scan(spark, sf):
    """Hits of the five most frequent k-mers by a plain search for both orientations."""
    return _plain_scan(fx.sequences(spark, sf), _top(spark, sf, 5))


def _plain_scan(sequences, queries):
    top = [r["kmer"] for r in queries.select("kmer").collect()]  # five
    both = sorted({x for k in top for x in (k, k[::-1].translate(str.maketrans("ACGT", "TGCA")))})
    return counting.substring_hits(sequences, both, ["doc_id"]).select("doc_id", K.canonical(F.col("motif")).alias("kmer"), "start")


@query("region_fasta", fx.sql("s", ", r AS (SELECT doc_id, hap, chrom, doc_id % 50 AS s, doc_id % 50 + 100 AS e, replace(seq, chr(10), '') AS q FROM s WHERE hap IS NOT NULL) SELECT '>' || hap || '|' || doc_id || ':' || s || '-' || e || '|HSat2|strand=+' || chr(10) || CASE WHEN length(substr(q, s + 1, 100)) > 80 THEN substr(q, s + 1, 80) || chr(10) || substr(q, s + 81, 20) ELSE substr(q, s + 1, 100) END AS value FROM r WHERE length(q) >= e"))
def region_fasta(spark, sf):
    seqs = fx.sequences(spark, sf).where("hap is not null").select("hap", F.col("doc_id").alias("chromosome"), F.replace("seq", F.lit("\n"), F.lit("")).alias("seq"))
    parts = seqs.where(F.length("seq") >= F.col("chromosome") % 50 + 100).select("hap", "chromosome", (F.col("chromosome") % 50).alias("start"), (F.col("chromosome") % 50 + 100).alias("end"))
    return files.fasta_lines(files.region_records(seqs, parts, "HSat2"))


_VIEWS = "CROSS JOIN (SELECT unnest(['HSat2', 'HSat3', 'HSat23', 'ambiguous', 'background']) AS region) r"


@query("region_views", fx.sql("d", f"SELECT hap, region, hap || '.fa' AS source_fasta, 'regions/' || hap || '/' || region || '.bed' AS region_bed, 'filtered_oriented_fasta_0based_halfopen' AS coordinate_system FROM (SELECT DISTINCT hap FROM d ORDER BY hap LIMIT 5) h {_VIEWS}"))
def region_views(spark, sf):
    """Where the regions of the first five haps are found, as a trial run lists them."""
    haps = counting.pilot(fx.den(spark, sf).select("hap").distinct(), 5)
    return counting.region_views(haps.withColumn("fasta", F.concat(F.col("hap").cast("string"), F.lit(".fa"))))


@query("plot_index", fx.sql("d", "SELECT '- [Chromosome ' || chrom || '](' || lpad(chrom::VARCHAR, 2, '0') || '.png)' AS value FROM (SELECT DISTINCT chrom FROM d)"))
def plot_index(spark, sf):
    chroms = fx.den(spark, sf).select("chrom").distinct()
    return files.plot_index(chroms.select(F.format_string("Chromosome %d", "chrom").alias("title"), F.concat(F.lpad(F.col("chrom").cast("string"), 2, "0"), F.lit(".png")).alias("file")))


@query("dominant_bins", fx.sql("h", ", hb AS (SELECT kmer, chromosome, s // 100000 * 100000 AS b, count(*) AS n FROM h GROUP BY 1, 2, 3), dc AS (SELECT kmer, arg_max(chromosome, (n, -chromosome)) AS chromosome FROM (SELECT kmer, chromosome, sum(n) AS n FROM hb GROUP BY 1, 2) GROUP BY kmer), lm AS (SELECT kmer, chromosome, min(b) AS lo, max(b) AS hi FROM hb JOIN dc USING (kmer, chromosome) GROUP BY 1, 2), gr AS (SELECT kmer, chromosome, unnest(range(greatest(0, lo - 200000), hi + 200001, 100000)) AS b FROM lm) SELECT kmer, chromosome, b AS bin_start, coalesce(n, 0) AS n FROM gr LEFT JOIN hb USING (kmer, chromosome, b)"))
def dominant_bins(spark, sf):
    """Hits along the chromosome that has most of them, two empty bins of margin on both sides."""
    binned = landscape.bins(fx.hits(spark, sf), 100_000, ["kmer", "chromosome"])
    return landscape.dominant_series(binned, 100_000, "kmer", "chromosome", margin=2)


@query("audit_screens", "SELECT unnest(['neighbourhoods', 'variant_sums', 'plain_scan_agrees', 'clusters']) AS \"check\", CAST(0 AS BIGINT) AS violations")
def audit_screens(spark, sf):
    """Neighbourhoods are whole; counts by distance of evenly spaced haps are found again in their own
    spectra; a plain search finds the hits of the scan; cluster cases keep their rules."""
    from .ranking_queries import cluster_cases

    # made once, for all passes over them
    seqs = written(fx.sequences(spark, sf).select("doc_id", "hap", "region", "seq"), "sequences", "zstd")
    top = _most(seqs, 5)
    near = mismatch.neighbours(top)
    sums = written(mismatch.by_distance(mismatch.radius_counts(top.select("code"), seqs, ["hap", "region"]), ["hap", "region"]))
    some = written(landscape.even_spaced(sums.where("hap is not null").select("hap").distinct(), "hap", 12), "haps")
    # the other way round: every window of a hap against the queries, by distance and not by a list of variants
    queries = [r["code"] for r in top.select("code").collect()]  # five
    again = counting.near(seqs.join(F.broadcast(some), "hap", "left_semi"), queries, keys=["hap", "region"])  # twelve rows
    saved = sums.join(some, "hap").where("n > 0").select("query", "hap", "region", F.col("d").cast("long"), "n")
    scanned = landscape.scan(seqs, top, keys=["doc_id"]).select("doc_id", K.decode(F.col("code")).alias("kmer"), "start")
    return audit.violations(
        {
            "neighbourhoods": audit.neighbourhood_differs(near),
            "variant_sums": audit.sets_differ(saved, again.select("query", "hap", "region", F.col("d").cast("long"), "n")),
            "plain_scan_agrees": audit.sets_differ(scanned, _plain_scan(seqs, top)),
            "clusters": audit.clusters_break_rules(cluster_cases(spark, sf), ["region", "chrom"]),
        }
    )
