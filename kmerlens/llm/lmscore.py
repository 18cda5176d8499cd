"""Cross-entropy difference of matched n-gram models that share one vocabulary.

The target model counts the target documents, the background model all documents. Both have the same
orders, smoothing and vocabulary: all words of the corpus, and one token for the bounds of a text. With
V types, N tokens and counts c,

    P1(w) = (c(w) + 1) / (N + V)        P2(w | h) = (c(h, w) + m / V) / (c(h) + m)

and a token's loss is the mean of -ln P1 and -ln P2. A document is scored by what the other ones say: its
own counts are taken off those of the background, and off those of the target if it is part of it.
Otherwise a score would tell membership in the target, not likeness to it.

The logarithms of a loss each depend on one count alone, so words and bigrams are keys that are counted
and priced alike. Keys and counts grow with the corpus, and there is no bound on their number. A key is 52
bits of a hash, of which a bucket keeps 32 beside its own number: about 0.05 % of the keys of a bucket of
two million share a count with another one.

1. A sample tells which keys are frequent (a list of bounded length); a pass over all texts counts these
   exactly, and estimates V. They are priced where the texts lie, so no task gathers them.
2. Other keys go to hash buckets with the documents' own counts. Texts price them as if no other document
   had them, and buckets return what those that several documents have change, a blob for each that came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix64, staged, string_buffers, tasks_for, unstage, word_hashes

#: Hash of the token for the start and the end of a text.
BOUND = U64(0x5BD1E995A5A5A5A5)
#: Registers of the estimate of the number of types.
REGISTERS = 1 << 12


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values))


def grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the distinct words and bigrams of rows of word hashes, at most 4,096 rows.
    Keys of words are even, those of bigrams odd; a row has the bound once as a word."""
    m, n = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(m, dtype=np.uint64), n + 2)
    flat = np.full(len(words) + 2 * m, BOUND)
    flat[np.arange(len(words)) + np.repeat(2 * np.arange(m) + 1, n)] = words
    inside = row[1:] == row[:-1]
    both = mix64(flat[:-1] * U64(0x9E3779B97F4A7C15) + flat[1:] * U64(0xD6E8FEB86659FD93))[inside]
    keys = np.concatenate([(flat[1:][inside] >> U64(12)) & ~U64(1), (both >> U64(12)) | U64(1)])
    found, count = np.unique(np.tile(row[1:][inside], 2) << U64(52) | keys, return_counts=True)
    return (found >> U64(52)).astype(np.int64), (found & U64((1 << 52) - 1)).astype(np.int64), count


def _slices(batches, most: int = 1 << 12):
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            yield batch.slice(lo, most)


def loss(key: np.ndarray, n: np.ndarray, others: np.ndarray, mass: float, types: float) -> np.ndarray:
    """What n occurrences of a key add to twice a document's loss, with the count of the other
    documents: of a word those of -ln of its own P1 and of the bigrams that it starts."""
    word = key & 1 == 0
    return n * np.where(word, np.log(others + mass) - np.log(others + 1.0), -np.log(others + mass / types))


def _sampled(batches):
    """(key, n): the counts of the words and bigrams of a partition."""
    kept: list[tuple] = []

    def out():
        key, n = _sum_by(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    for batch in _slices(batches):
        _, key, n = grams(*word_hashes(*string_buffers(batch.column(0))))
        kept.append(_sum_by(key, n))
        if sum(len(x[0]) for x in kept) > 1 << 20:
            yield out()
    if kept:
        yield out()


def _counted(frequent):
    def run(batches):
        """(kind, key, n, target): counts of frequent keys (0), sums of tokens and documents (1) and
        the registers of the estimate of the number of words (2) of a partition."""
        known = frequent.value
        total, sums, ranks = np.zeros((2, len(known)), np.int64), np.zeros((2, 2), np.int64), np.zeros(REGISTERS, np.int64)
        for batch in _slices(batches):
            words, at = word_hashes(*string_buffers(batch.column(0)))
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key, n = grams(words, at)
            if len(known):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                total[0] += np.bincount(place[hit], n[hit], len(known)).astype(np.int64)
                total[1] += np.bincount(place[hit], (n * target[row])[hit], len(known)).astype(np.int64)
            tokens = np.diff(at) + 1
            sums += [[tokens.sum(), (tokens * target).sum()], [len(target), target.sum()]]
            words = mix64(np.unique(words))
            # the leading zeros of what a register's bits leave, and one
            zeros = 53 - np.frexp((words & U64((1 << 52) - 1)).astype(np.float64))[1]
            np.maximum.at(ranks, (words >> U64(52)).astype(np.int64), zeros)
        rows = [(np.zeros(len(known), np.int64), known, *total), (np.ones(2, np.int64), np.arange(2), sums[:, 0], sums[:, 1]), (np.full(REGISTERS, 2), np.arange(REGISTERS), ranks, ranks)]
        kind, key, n, t = (np.concatenate(x) for x in zip(*rows, strict=True))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (kind, key, n, t)], names=["kind", "key", "n", "target"])

    return run


def types_of(ranks: np.ndarray) -> float:
    """Distinct words and the bound, from the registers: linear counting while many are empty."""
    m, empty = len(ranks), int((ranks == 0).sum())
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -ranks.astype(np.float64))
    return float(round(m * np.log(m / empty) if empty and raw < 2.5 * m else raw)) + 1


class Model:
    """What every Python worker needs: frequent keys (sorted) with their counts in both models,
    target first, tokens of both, the number of types and the mass of the smoothing."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: tuple[int, int], types: float, mass: float):
        self.keys, self.counts, self.tokens, self.types, self.mass = keys, counts, tokens, types, mass


_ROWS = "row long, doc_id long, n_tokens long, target double, background double, bucket long, origin long, keys binary, counts binary, rows binary, runs binary, in_target binary"


def _price(model, buckets: int, hold: int = 1 << 19):
    names = [c.split()[0] for c in _ROWS.split(", ")]
    types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 5
    lead = buckets.bit_length() - 1

    def run(batches):
        """A row for each document, priced as if no other one had its rare keys, and blobs of these
        keys by bucket: low bits, counts (of as many bytes as they need), rows, runs and membership. All
        blobs of some consecutive documents have the first one's row as their origin."""
        m, at_row = model.value, TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def out():
            key, n, row, target = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key >> (52 - lead), kind="stable")
            key, n, row, target = key[order], n[order], row[order], target[order]
            b = key >> (52 - lead)
            at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            cols: list[list] = [[] for _ in range(7)]
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=True):
                r = row[lo:hi]
                runs = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                c = n[lo:hi]
                c = c.astype(np.uint8 if c.max() < 1 << 8 else np.uint16 if c.max() < 1 << 16 else np.uint32)
                for col, x in zip(cols, (int(b[lo]), int(row.min()), (key[lo:hi] & 0xFFFFFFFF).astype(np.uint32).tobytes(), c.tobytes(), r[runs].tobytes(), np.diff(np.append(runs, hi - lo)).astype(np.uint32).tobytes(), target[lo:hi][runs].tobytes()), strict=True):
                    col.append(x)
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in types[:5]), *(pa.array(c, t) for c, t in zip(cols, types[5:], strict=True))], names=names)

        for batch in _slices(batches):
            words, at = word_hashes(*string_buffers(batch.column(1)))
            rows, target = batch.num_rows, batch.column(2).to_numpy(zero_copy_only=False)
            row, key, n = grams(words, at)
            tokens = np.diff(at) + 1
            hit, place = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
            if len(m.keys):
                place = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
                hit = m.keys[place] == key
            sums = []
            for i, own in enumerate((target, np.ones(rows, bool))):
                others = np.where(hit, m.counts[i][place] - n * own[row], 0) if len(m.keys) else np.zeros(len(key))
                left = m.tokens[i] - tokens * own
                sums.append((np.bincount(row, loss(key, n, others, m.mass, m.types), rows) + tokens * np.log(left + m.types)) / 2)
            own_rows = at_row + np.arange(rows)
            at_row += rows
            yield pa.RecordBatch.from_arrays([pa.array(own_rows), batch.column(0), pa.array(tokens), pa.array(sums[0]), pa.array(sums[1]), *(pa.nulls(rows, t) for t in types[5:])], names=names)
            if not hit.all():
                held.append((key[~hit], n[~hit], own_rows[row[~hit]], target[row[~hit]].astype(np.uint8)))
            if sum(len(x[0]) for x in held) > hold:
                yield out()
        if held:
            yield out()

    return run


def _changes(model):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket of keys: by how much the keys that several documents have change the losses of
        each document in both models, as one blob for each origin."""
        m = model.value
        blobs = {c: table.column(c).to_pylist() for c in ("keys", "counts", "rows", "runs", "in_target")}
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["keys"]])
        n = np.concatenate([np.frombuffer(c, {1: np.uint8, 2: np.uint16, 4: np.uint32}[4 * len(c) // len(k)]).astype(np.int64) for c, k in zip(blobs["counts"], blobs["keys"], strict=True)])
        runs = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["runs"]])
        row = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in blobs["rows"]]), runs)
        target = np.repeat(np.concatenate([np.frombuffer(x, np.uint8) for x in blobs["in_target"]]), runs).astype(np.int64)
        order = np.argsort(key, kind="stable")
        many = key[order][1:] == key[order][:-1]
        order = order[np.append(False, many) | np.append(many, False)] if len(order) else order
        key, n, row, target = key[order].astype(np.int64), n[order], row[order], target[order]
        none = loss(key, n, np.zeros(len(key)), m.mass, m.types)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(key)))
        change = []
        for own in (target, np.ones(len(key), np.int64)):
            others = np.repeat(np.add.reduceat(n * own, at) if len(at) else at, size) - n * own
            change.append((loss(key, n, others.astype(np.float64), m.mass, m.types) - none) / 2)
        row, t, b = _sum_by(row, *change)
        origins = np.unique(table.column("origin").to_numpy())
        cuts = [*np.searchsorted(row, origins).tolist(), len(row)]
        some = [i for i in range(len(origins)) if cuts[i + 1] > cuts[i]]
        parts = [[v[cuts[i] : cuts[i + 1]].tobytes() for i in some] for v in (row, t, b)]
        return pa.table([pa.array(origins[some], pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], names=["origin", "rows", "target", "background"])

    return run


def _settled(table: pa.Table) -> pa.Table:
    """Of one origin: the sums of the changes of each document."""
    row, t, b = (np.concatenate([np.frombuffer(x, d) for x in table.column(c).to_pylist()]) for c, d in (("rows", np.int64), ("target", np.float64), ("background", np.float64)))
    row, t, b = _sum_by(row, t, b)
    return pa.table({"r": row, "dt": t, "db": b})


def score(docs: DataFrame, target: DataFrame, mass: float = 50.0, types: float | None = None, frequent: int = 1 << 17, one_in: int = 32, bucket_rows: int = 1 << 21) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) of every row of docs (doc_id, text).

    target has the doc_ids of the target documents. Words are those of lower-cased A-Z text between
    white space; a text also has its end as a token, so null and empty texts have one token. ce_* are
    mean losses per token in nats in models of the other rows, score is ce_target - ce_background: the
    lower, the closer to the target. Without any other target document the target model is uniform.
    ``types`` is the number of types of the smoothing; None estimates it, within about 2 %. ``frequent``
    keys at most, of those that the sample of one document in ``one_in`` shows, are priced without a
    shuffle; they change no result. Rows that share a doc_id share its place in the target; repeated
    rows count and are scored each, so each has the other's counts. Null ids are never in the target.
    Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = tasks_for(docs)
    wanted = target.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the flag meets doc_ids alone; texts are then read by scans that need no shuffle where it is small
    wanted = staged(wanted.withColumn("wanted", F.lit(True)), "target", tasks)
    if wanted.count() <= 1_000_000:
        wanted = F.broadcast(wanted)
    flagged = docs.join(wanted, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("in_target"))
    size = flagged.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1
    while buckets * bucket_rows * 8 < size:  # about one rare key in 8 characters
        buckets *= 2
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(one_in)) == 0).select("text").mapInArrow(_sampled, "key long, n long")
    top = sample.groupBy("key").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "key").limit(frequent).select("key").toPandas()
    known = spark.sparkContext.broadcast(np.sort(top["key"].to_numpy(np.int64)))
    sums = flagged.select("text", "in_target").mapInArrow(_counted(known), "kind long, key long, n long, target long")
    sums = sums.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("target").alias("target"), F.max("n").alias("most")).toPandas()
    counts = np.zeros((2, len(known.value)))
    of = sums[sums.kind == 0]
    at = np.searchsorted(known.value, of.key)
    counts[0, at], counts[1, at] = of.target, of.n
    tokens = sums[(sums.kind == 1) & (sums.key == 0)]
    ranks = np.zeros(REGISTERS, np.int64)
    ranks[sums[sums.kind == 2].key.to_numpy()] = sums[sums.kind == 2].most
    total = (int(tokens.target.sum()), int(tokens.n.sum()))
    model = spark.sparkContext.broadcast(Model(known.value, counts, total, types or types_of(ranks), mass))
    priced = staged(flagged.mapInArrow(_price(model, buckets), _ROWS), "priced", tasks)
    blobs = priced.where("bucket is not null").select("bucket", "origin", "keys", "counts", "rows", "runs", "in_target")
    changes = blobs.groupBy("bucket").applyInArrow(_changes(model), "origin long, rows binary, target binary, background binary")
    changes = changes.groupBy("origin").applyInArrow(_settled, "r long, dt double, db double")
    rows = priced.where("bucket is null").join(changes, F.col("row") == F.col("r"), "left")
    mean = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0.0))) / F.col("n_tokens")
    out = staged(rows.select("doc_id", "n_tokens", mean("target", "dt").alias("ce_target"), mean("background", "db").alias("ce_background")), "losses", tasks)
    unstage(priced)
    return out.withColumn("score", F.col("ce_target") - F.col("ce_background"))


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)
