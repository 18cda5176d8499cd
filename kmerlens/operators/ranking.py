"""Percentile composites, ranks, shortlists and similarity classes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.written import written

WEIGHTS = (0.20, 0.20, 0.20, 0.15, 0.10, 0.15)


#: Groups by ranges that are broadcast: a few numbers each.
BROADCAST_PARTS = 100_000


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "place", rows: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with the place of each row (from 1) in the order within its group, and with ``rows`` the size
    of the group. The order has to tell all rows of a group apart.

    No task holds a group: rows are sorted into ranges of about equal size by group and order, and get a
    running number there. A row for each range of each group tells how many of the group lie in the
    ranges before. Rows are written once, sorted, so that both are taken from the same ranges."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [*map(F.col, by), *order]
    # ids of this kind are the number of the partition in the high bits, and a running number
    placed = df.repartitionByRange(n, *ends).sortWithinPartitions(*ends).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranges")
    low = F.col("_at").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part"), *(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.min(low).alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*(f"_by_{c}" for c in by))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("*", (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(group).alias("_rows")), "parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    same = [F.shiftright("_at", 33) == F.col("_part"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)]
    out = placed.join(parts, same).withColumn(name, low + F.col("_shift"))
    return out.select(*df.columns, name, *([F.col("_rows").alias(rows)] if rows else []))


def percentile(value: Column, by: list[str], ties: Column) -> Column:
    """Place in ascending order over the number of rows less one; equal values in order of ``ties``. A
    group is one task: ``composite`` is for large ones."""
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(value.asc_nulls_first(), ties)) - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1)


def composite(df: DataFrame, columns: list[str], by: list[str], ties: Column, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """df with pct_<column> of each column (numbers) and their weighted sum, ``score``. All columns are
    numbered at once, as rows of their own."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("_column", "_value")
    long = rows.select("_row", *by, ties.alias("_tie"), values)
    long = numbered(long, ["_column", *by], [F.col("_value").asc_nulls_first(), F.col("_tie")], "_place", "_rows")
    share = (F.col("_place") - 1) / F.greatest(F.lit(1), F.col("_rows") - 1)
    wide = long.groupBy("_row").agg(*(F.max(F.when(F.col("_column") == i, share)).alias(f"pct_{c}") for i, c in enumerate(columns)))
    out = rows.join(wide, "_row").drop("_row")
    return out.withColumn("score", sum((F.col(f"pct_{c}") * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0)))


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return numbered(df, by, order, name)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Spark cuts groups to k rows before it shuffles them, so a group in one task does no harm."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def exactly(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in the order; fewer are an error."""
    rows = df.orderBy(*order).limit(n)
    found = rows.count()
    if found < n:
        raise ValueError(f"{n} rows are asked for, {found} are there")
    return rows


def by_outside(df: DataFrame, name: str, total: str = "total", outside: str = "outside") -> DataFrame:
    """df with ``place``: most hits outside first, then the greatest share of hits outside, which is 0
    where there is no hit at all, then by name."""
    share = F.coalesce(F.try_divide(F.col(outside), F.col(total)), F.lit(0.0))
    return numbered(df, [], [F.desc(outside), share.desc(), F.col(name)])


def collect_categories(df: DataFrame, key: str, category: str) -> DataFrame:
    """(key, categories): sorted distinct categories of each key, joined by ``;``."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(category)), ";").alias("categories"))


def explode_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("category", F.explode(F.split("categories", ";"))).drop("categories")


def systematic_pool(df: DataFrame, by: list[str], width: int, order: list[Column], count: str = "n") -> DataFrame:
    """Features of each group, with ``route``: the first width / 2 of positive count, an evenly spaced
    sample of the other positives, then the next unused ones until the width is reached."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("positives", F.count_if(F.col(count) > 0).over(w)).withColumn("rows", F.count("*").over(w))
    common = F.least(F.lit(width // 2), F.col("positives"))
    rest = F.col("positives") - common
    k = F.least(F.least(F.lit(width), F.col("rows")) - common, rest)
    i = F.col("r") - common
    # row i of the rest is int(j (rest - 1) / (k - 1)) for some j: the least j that reaches i tells
    j = F.when(k > 1, F.ceil(i * (k - 1) / (rest - 1))).otherwise(F.lit(0))
    hit = F.when(k > 1, F.floor(j * ((rest - 1) / (k - 1)) + 1e-9) == i).otherwise(i == 0) & (i >= 0) & (i < rest) & (k > 0)
    ranked = ranked.withColumn("route", F.when(F.col("r") < common, "common").when(F.coalesce(hit, F.lit(False)), "systematic"))
    used = F.count("route").over(w)
    spare = F.row_number().over(w.orderBy(F.col("route").isNotNull(), "r"))
    filled = ranked.withColumn("used", used).withColumn("spare", spare)
    route = F.coalesce("route", F.when(F.col("spare") <= F.least(F.lit(width), F.col("rows")) - F.col("used"), "fill"))
    return filled.withColumn("route", route).where("route is not null").select(*df.columns, "route")


def _pairs_apart(x: int) -> int:
    """Bases in which two packed k-mers differ, from their XOR: pairs of bits that are not 00."""
    return ((x | x >> 1) & 0x5555555555555555).bit_count()


class Picks:
    """Accepted k-mers of one list, as packed codes. A k-mer is refused if it is within ``distance``
    of an accepted one in either orientation, or shares ``n`` bases in a row with it or its reverse
    complement: of the accepted ones all runs of n bases are kept as a set."""

    def __init__(self, k: int = 16, distance: int = 2, n: int = 12):
        self.k, self.distance, self.n = k, distance, n
        self.codes: list[int] = []
        self.runs: set[int] = set()

    def packed(self, kmer: str) -> int:
        return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)

    def runs_of(self, code: int) -> set[int]:
        return {code >> 2 * i & (1 << 2 * self.n) - 1 for i in range(self.k - self.n + 1)}

    def admits(self, kmer: str) -> bool:
        code = self.packed(kmer)
        return self.runs.isdisjoint(self.runs_of(code)) and all(_pairs_apart(code ^ c) > self.distance for c in self.codes)

    def add(self, kmer: str) -> None:
        for text in (kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))):
            self.codes.append(self.packed(text))
            self.runs |= self.runs_of(self.codes[-1])


def greedy_shortlist(df: DataFrame, by: list[str], store, kmer: str = "kmer", score: str = "score", cap: int = 5, pan_cap: int = 20, category: str = "category", ahead: int = 256) -> DataFrame:
    """Per group, in order of score (descending), then k-mer: rows unlike all chosen before, up to the
    cap (``pan_cap`` for categories that hold ``pan``), with their ``category_rank``.

    Only the first ``ahead`` rows of each group go to a task. Groups that meet their cap there, or have
    no more rows, are done; the others go on with eight times as many, until none is left. ``store``
    (DataFrame to DataFrame) writes a table and reads it again.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("category_rank", T.IntegerType()), T.StructField("seen", T.LongType())])
    ranked = store(rank_within(df, by, [F.desc(score), F.asc(kmer)], "place"))
    done, todo = None, ranked

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        most = pan_cap if "pan" in str(pdf[category].iat[0]) else cap
        picks, chosen, seen = Picks(), [], 0
        for i, text in enumerate(pdf[kmer]):
            if len(chosen) == most:
                break
            seen = i + 1
            if picks.admits(text):
                picks.add(text)
                chosen.append(i)
        # a full list needs no further row
        seen = -1 if len(chosen) == most else seen
        return pdf.iloc[chosen].drop(columns="place").assign(category_rank=range(1, len(chosen) + 1), seen=seen)

    while True:
        found = store(todo.where(F.col("place") <= ahead).groupBy(*by).applyInPandas(pick, schema))
        sizes = todo.groupBy(*by).agg(F.max("place").alias("rows"))
        short = store(found.select(*by, "seen").distinct().join(sizes, by).where((F.col("seen") >= 0) & (F.col("rows") > F.col("seen"))).select(*by))
        whole = found.join(short, by, "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if short.isEmpty():
            return done.drop("seen")
        todo, ahead = ranked.join(short, by, "left_semi"), 8 * ahead


def interleaved(queues: list[list[tuple]], taken: list, most: int, turns: int | None = None) -> list:
    """taken and further ids of queues of (id, k-mer), sorted, ``most`` at most. In every turn each
    queue gives the first of its ids that nobody has taken and that its own earlier picks admit; a
    queue that has none left drops out, and others go on, for ``turns`` turns or to the end. For the
    few short queues of a finished ranking."""

    def picks_of(queue: list[tuple]):
        own = Picks()
        for name, text in queue:
            if name not in out and own.admits(text):
                own.add(text)
                yield name

    out = dict.fromkeys(taken)
    order = [(0, i, picks_of(q)) for i, q in enumerate(queues)]
    while order and len(out) < most:
        turn, i, source = heapq.heappop(order)
        name = next(source, None)
        if name is not None:
            out[name] = None
            if turns is None or turn + 1 < turns:
                heapq.heappush(order, (turn + 1, i, source))
    return sorted(out)


def round_robin(pools: list[list[tuple]], rounds: int = 3, most: int = 24) -> list:
    """Ids of (id, k-mer): in each round one from every pool; sorted."""
    return interleaved(pools, [], most, rounds)


def balanced_fill(seeds: list, buckets: dict[str, list[tuple]], most: int = 72) -> list:
    """seeds, filled up from the buckets in turn; sorted."""
    return interleaved(list(buckets.values()), seeds, most)


def min_label_components(edges: DataFrame, nodes: DataFrame, checkpoint) -> DataFrame:
    """(node, component): smallest node reached over edges (a, b). Labels halve their paths by taking
    the label of their label, so rounds are few; each round ends in ``checkpoint`` (DataFrame to
    DataFrame), which cuts the lineage."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = checkpoint(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("j"))
        then = checkpoint(step.join(jump, "c").select("node", F.least("c", "j").alias("component")))
        changed = then.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = then
        if changed:
            return labels
