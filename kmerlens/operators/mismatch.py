"""Hits within a Hamming radius: neighbourhoods, joins, sums by distance, screens and tiers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmer as K
from ..functions.measures import log2_ratio, ratio
from ..plans.written import written
from .counting import seeded

#: Pairs under one key of an index that one task tries, and keys with more of them that are broadcast.
PAIRS, HOT_KEYS = 1 << 22, 1_000_000


def neighbours(queries: DataFrame, k: int = 16, radius: int = 2) -> DataFrame:
    """(query, variant, d): canonical codes within the radius of queries (code), each once with its
    least distance in either orientation. Substitutions are exploded twice, never joined."""
    rows = queries.select(F.col("code").alias("query"), F.col("code").alias("v"), F.lit(-1).alias("last"))
    out = rows
    for _ in range(radius):
        at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i > F.col("last"))).alias("i")
        step = rows.where(F.col("last") < k - 1).select("query", "v", at).select("query", "i", F.col("v"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("x"))
        moved = F.col("v").bitwiseXOR(F.call_function("shiftleft", F.col("x").cast("long"), (2 * (k - 1 - F.col("i"))).cast("int")))
        rows = step.select("query", moved.alias("v"), F.col("i").alias("last"))
        out = out.unionByName(rows)
    variant = F.least("v", K.reverse_complement_code(F.col("v"), k))
    return out.select("query", variant.alias("variant")).distinct().withColumn("d", K.hamming_either(F.col("query"), F.col("variant"), k))


def radius_join(queries: DataFrame, counts: DataFrame, k: int = 16, radius: int = 2) -> DataFrame:
    """counts (code, ...) of every variant of the queries: (query, d, and the columns of counts)."""
    return counts.join(neighbours(queries, k, radius).withColumnRenamed("variant", "code"), "code")


def radius_counts(queries: DataFrame, sequences: DataFrame, keys: list[str], k: int = 16, radius: int = 2) -> DataFrame:
    """(query, d, code, keys, n) of every variant of the queries (code) in sequences (keys, seq): only
    variants are counted. Queries are few (each has about a thousand variants at radius 2) and read
    twice."""
    variants = neighbours(queries, k, radius)
    counts = seeded(sequences, variants.select(F.col("variant").alias("code")), k, keys)
    return counts.join(variants.withColumnRenamed("variant", "code"), "code")


def _masks(k: int, radius: int, blocks: int) -> list[int]:
    """Bits of every choice of ``blocks - radius`` of the blocks of a code: wherever ``radius`` bases
    differ, the bits of one choice are equal."""
    ends = [k * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << 2 * (k - 1 - i) for i in range(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def index_pairs(queries: DataFrame, targets: DataFrame, k: int = 16, radius: int = 2, blocks: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """(query, code, d) of all targets (code) within the radius of queries (code), canonical codes both, each
    pair once with the lesser distance of the two orientations.

    A pigeonhole index, for many queries: codes are cut into blocks (radius + 3), and pairs meet where
    all but ``radius`` of them are equal. Queries come in both orientations, targets in one. A pair is
    kept under the first choice of blocks that it shares, and in the nearer orientation (the given one
    of equals), so nothing is made distinct afterwards. The targets of a key with more than ``pairs`` pairs are dealt
    to several tasks, which all get the key's queries."""
    masks = _masks(k, radius, blocks or radius + 3)
    keys = lambda c: F.posexplode(F.array(*(F.col(c).bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "bits")
    other = K.reverse_complement_code(F.col("code"), k)
    asked = queries.select("code").where("code is not null").distinct().select(F.col("code").alias("query"), F.explode(F.array_distinct(F.array(F.col("code"), other))).alias("v"))
    asked = written(asked.select("query", "v", keys("v")), "asked")
    there = written(targets.select("code").where("code is not null").distinct().select("code", keys("code")), "targets")
    on = ["choice", "bits"]
    sizes = asked.groupBy(on).agg(F.count("*").alias("q")).join(there.groupBy(on).agg(F.count("*").alias("t")), on)
    hot = written(sizes.where(F.col("q") * F.col("t") > pairs).select(*on, F.ceil(F.col("q") * F.col("t") / pairs).cast("long").alias("shares")), "hot")
    few = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    left = asked.join(few, on, "left").select("query", "v", *on, F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    right = there.join(few, on, "left").select("code", *on, F.pmod(F.xxhash64("code"), shares).alias("share"))
    met = left.join(right, [*on, "share"])
    apart = F.col("v").bitwiseXOR(F.col("code"))
    first = F.lit(len(masks))
    for i in reversed(range(len(masks))):
        first = F.when(apart.bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(first)
    met = met.where(K.hamming_code(F.col("v"), F.col("code")) <= radius).where(first == F.col("choice"))
    met = met.select("query", "code", "v", K.hamming_code(F.col("v"), F.col("code")).alias("d"), K.hamming_code(K.reverse_complement_code(F.col("v"), k), F.col("code")).alias("e"))
    return met.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("v") == F.col("query")))).select("query", "code", "d")


def index_join(queries: DataFrame, counts: DataFrame, k: int = 16, radius: int = 2, **index: int) -> DataFrame:
    """As ``radius_join``, for many queries: by ``index_pairs`` instead of every neighbour of every query."""
    return counts.join(index_pairs(queries, counts, k, radius, **index), "code")


def by_distance(matched: DataFrame, by: list[str], radius: int = 2) -> DataFrame:
    """(query, by, d, n, cumulative) for every d of the radius: sums at a distance, and up to it."""
    sums = matched.groupBy("query", *by).agg(*(F.coalesce(F.sum(F.when(F.col("d") == d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(radius + 1)))
    rows = sums.select("query", *by, F.posexplode(F.array(*(F.col(f"n{d}") for d in range(radius + 1)))).alias("d", "n"))
    return rows.withColumn("cumulative", F.sum("n").over(Window.partitionBy("query", *by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))


def position_weights(matched: DataFrame, by: list[str], k: int = 16) -> DataFrame:
    """(query, by, d, position, weight): counts by place of mismatch. Where both orientations reach
    the distance, each has half of the count; weights of a distance sum to d times its count."""
    q, v = K.decode(F.col("query"), k), K.decode(F.col("code"), k)
    rc = K.reverse_complement(v)
    rows = matched.where("d > 0").withColumn("p1", K.mismatch_positions(q, v, k)).withColumn("p2", K.mismatch_positions(q, rc, k))
    first, second = F.size("p1") == F.col("d"), F.size("p2") == F.col("d")
    sides = F.array(F.struct(F.col("p1").alias("p"), F.when(first & second, 0.5).when(first, 1.0).otherwise(0.0).alias("w")), F.struct(F.col("p2").alias("p"), F.when(first & second, 0.5).when(second, 1.0).otherwise(0.0).alias("w")))
    rows = rows.select("query", *by, "d", "n", F.explode(F.filter(sides, lambda s: s["w"] > 0)).alias("s")).select("query", *by, "d", "n", F.col("s.w").alias("w"), F.explode("s.p").alias("position"))
    return rows.groupBy("query", *by, "d", "position").agg(F.sum(F.col("n") * F.col("w")).alias("weight"))


def strict_pan(sums: DataFrame, den: DataFrame, broad_min: int, threshold: float = 10.0, share: float = 0.999, least: int = 10) -> DataFrame:
    """Per (query, d): pooled and per-hap screens of cumulative sums (query, hap, d, t, o, b) of the own
    family, the other one and the background, with den (hap, den_t, den_o, den_b). An undefined ratio
    fails. passes: pooled screen, and at least broad_min haps that pass theirs."""
    rows = sums.join(den, "hap")

    def screen(t, o, b, vt, vo, vb) -> tuple[Column, ...]:
        dens = [ratio(F.col(x), F.when(F.col(v) > 0, F.col(v))) for x, v in ((t, vt), (o, vo), (b, vb))]
        return log2_ratio(dens[0], dens[2]), log2_ratio(dens[0], dens[1]), ratio(F.col(t), F.col(t) + F.col(o))

    e_b, e_o, part = screen("t", "o", "b", "den_t", "den_o", "den_b")
    fine = F.coalesce((F.col("t") >= least) & (e_b > threshold) & (e_o > threshold) & (part >= share), F.lit(False))
    pooled = rows.withColumn("fine", fine).groupBy("query", "d").agg(*(F.sum(c).alias(c) for c in ("t", "o", "b", "den_t", "den_o", "den_b")), F.count_if("fine").alias("haps"))
    p_b, p_o, p_part = screen("t", "o", "b", "den_t", "den_o", "den_b")
    ok = F.coalesce((p_b > threshold) & (p_o > threshold) & (p_part >= share), F.lit(False))
    return pooled.select("query", "d", "t", "o", "b", p_b.alias("e_background"), p_o.alias("e_other"), p_part.alias("share"), "haps", (ok & (F.col("haps") >= broad_min)).alias("passes"))


def merge_origins(queries: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several screens (key, ...), one table for each origin, of the queries (key, origin): a
    query's rows are those of the screen that asked it, even where others have its key."""
    both = None
    for origin, df in tables.items():
        one = df.withColumn("origin", F.lit(origin))
        both = one if both is None else both.unionByName(one)
    return both.join(queries.select(key, "origin"), [key, "origin"])
