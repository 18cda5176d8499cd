"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, staged, tasks_for

#: Sources of this many rows at most are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sized (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times
    the sum of all sizes; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight, until none is above. Places in the order come from ranges of sources, each
    numbered by itself, and the level that the others share from sums, so no task holds all sources.
    Sizes of no words at all have targets of 0.
    """
    spark = sized.sparkSession
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "sources")
    before, start = 0, {}
    for r in ranged.groupBy("range").count().orderBy("range").collect():  # one row for each task
        start[r["range"]], before = before, before + r["count"]
    starts = F.broadcast(spark.createDataFrame(list(start.items()), "range int, start long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = staged(ranged.join(starts, "range").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    level, full = 0.0, -1
    while True:
        # sources whose caps lie under the level are full; what they leave raises the level of the others
        over = F.col("cap") <= level * F.col("weight")
        found = rows.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if found[2] is None or found[3] == full:
            break
        full, level = found[3], (share * found[0] - (found[1] or 0.0)) / found[2]
    return rows.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def pivot_round(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractional copies in turn: the fractional row at hand and the next one trade words
    (size times part stays equal) in a random direction, with chances that keep every part's
    mean, until one of the two is 0 or 1. Returns the parts and the row left fractional, or -1."""
    out, a = parts.tolist(), -1
    s, u = sizes.tolist(), draws.tolist()
    for b in range(len(out)):
        if not 0.0 < out[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        fa, fb, r = out[a], out[b], s[b] / s[a]
        up, down = min(1.0 - fa, fb * r), min(fa, (1.0 - fb) * r)
        if u[b] * (up + down) < down:
            fa, fb = (1.0, fb - up / r) if 1.0 - fa <= fb * r else (fa + up, 0.0)
        else:
            fa, fb = (0.0, fb + down / r) if fa <= (1.0 - fb) * r else (fa - down, 1.0)
        fa, fb = (round(x) if min(x, 1.0 - x) < 1e-12 else x for x in (fa, fb))
        out[a], out[b] = float(fa), float(fb)
        a = a if 0.0 < fa < 1.0 else b if 0.0 < fb < 1.0 else -1
    return np.asarray(out), a


def trade_rests(rows: DataFrame, few: bool, trades: int = 2) -> DataFrame:
    """rows (row_id, doc_id, source, size, mark, source_size, target, sure, part, all parts 0 or 1),
    where one more row of each source changes its part in each of ``trades`` turns: that which brings
    the words taken nearest to the target, if any brings them nearer. Sources whose rows were never
    fractional stay as they are. Turns are aggregates by source; with ``few`` sources what they find is
    broadcast. Of equally good rows that of the smaller size goes, then of the smaller doc_id and mark."""
    sides = F.broadcast if few else lambda d: d
    split = (F.col("size") > 0) & (F.col("target") / F.col("source_size") > F.col("sure"))
    for turn in range(trades):
        off = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("sure") + F.col("part")))).alias("off"))
        off = staged(off.withColumnRenamed("source", "s"), f"rests{turn}", rows.sparkSession.sparkContext.defaultParallelism)
        to = F.when((F.col("off") > 0) & (F.col("part") == 0), 1.0).when((F.col("off") < 0) & (F.col("part") == 1), 0.0)
        miss = F.abs(F.abs("off") - F.col("size"))
        open_rows = rows.where(split).join(sides(off), F.col("source").eqNullSafe(F.col("s"))).where(to.isNotNull() & (miss < F.abs("off")))
        best = open_rows.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "size", "doc_id", "mark", "row_id", to.alias("to"))).alias("best"))
        best = staged(best.select(F.col("best.row_id").alias("picked"), "best.to"), f"trades{turn}", rows.sparkSession.sparkContext.defaultParallelism)
        rows = rows.join(sides(best), F.col("row_id") == F.col("picked"), "left").withColumn("part", F.coalesce("to", "part")).drop("picked", "to")
    return rows


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, leaf_rows: int = 8192, fan_in: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, mark, source_size, target, copies, taken) of every row of docs (doc_id,
    text, source); mark is a hash of the text, by which rows without an id spread over leaves.

    A source's rows all start from target / source_size copies. The whole part is sure; the rest
    is rounded by pivot_round inside leaves dealt by a hash of the rows, largest first, and the one
    row per source that a leaf leaves fractional meets those of fan_in - 1 other leaves on the next
    level, up to one root, which rounds its last row to the nearer end. What that row leaves, half of
    its words at most, goes to other rows of the source by ``trade_rests``, mostly down to a few words;
    this moves one or two rows of a source against their chances. A hot source fills no single task,
    and the result depends on rows and seed alone. Null text has no words and takes none; a null source is a
    source; repeated rows are rounded each by itself; no rows give no rows.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.monotonically_increasing_id().alias("row_id"))
    tasks = tasks_for(docs)
    sized = staged(sized, "sized", tasks)
    targets = staged(source_targets(sized, weights, share, most), "targets", tasks)
    few = targets.count() <= BROADCAST_SOURCES
    if few:
        targets = F.broadcast(targets)
    rows = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("sure", F.floor(ratio).cast("long")).withColumn("part", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0))
    nodes = max(1, -(-sized.count() // leaf_rows))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("doc_id", "size", "mark"), F.lit(nodes)).cast("long")).withColumn("left", F.lit(True))
    done, level = None, 0
    while True:
        last = nodes == 1

        def round_node(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["source", "size", "doc_id", "mark"], ascending=[True, False, True, True], kind="stable", ignore_index=True)
            draws = np.random.Generator(np.random.PCG64([seed, level, int(pdf["node"].iat[0])])).random(len(pdf))
            part, left = pdf["part"].to_numpy(float).copy(), np.zeros(len(pdf), bool)
            for at in pdf.groupby("source", dropna=False, sort=False).indices.values():
                part[at], still = pivot_round(pdf["size"].to_numpy()[at], part[at], draws[at])
                if still >= 0:
                    if last:
                        part[at[still]] = float(part[at[still]] >= 0.5)
                    else:
                        left[at[still]] = True
            return pdf.assign(part=part, left=left)

        step = staged(rows.groupBy("node").applyInPandas(round_node, rows.schema), f"rounded{level}", tasks)
        part = step.where(~F.col("left"))
        done = part if done is None else done.unionByName(part)
        if nodes == 1:
            break
        nodes, level = -(-nodes // fan_in), level + 1
        rows = step.where("left").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
    done = trade_rests(done, few)
    copies = (F.col("sure") + F.col("part").cast("long")).alias("copies")
    return done.select("doc_id", "source", "size", "mark", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def repeated_by_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs, all columns as they are, whatever their names, each row as often as ``mix`` says. Rows that
    agree in doc_id, source and text share their copies evenly. Null texts and
    texts without words are taken by no mix and go; no rows give no rows."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"), word_count(F.col("text")).alias("words"), F.xxhash64(F.col("text").cast("string")).alias("hash"), rows_of(docs))
    plan = mixed.groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_src"), F.col("size").alias("p_words"), F.col("mark").alias("p_hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("src").eqNullSafe(F.col("p_src")) & (F.col("words") == F.col("p_words")) & (F.col("hash") == F.col("p_hash"))
    rows = keyed.join(plan.where("copies > 0").hint("merge"), same)  # the same way at every size
    turn = F.row_number().over(Window.partitionBy("p_id", "p_src", "p_words", "p_hash").orderBy("hash"))
    alone = rows.where("n = 1").select("row", "copies")
    shared = rows.where("n > 1").select("row", (F.floor(F.col("copies") / F.col("n")) + F.when(turn <= F.col("copies") % F.col("n"), 1).otherwise(0)).alias("copies"))
    both = alone.unionByName(shared).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy")).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
