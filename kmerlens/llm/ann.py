"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are cut into pairs of dimensions with 16 codewords each. Codes and codewords lower a
loss in which the part of the residual that is parallel to the vector weighs more than the rest,
since that part moves large inner products. A search scans four-bit codes through one table per
query and block, and reranks the best rows of every block exactly on the original vectors. A row's code
is kept with the length of what it misses, so a scan also bounds every other row from above: those that
may still reach the best are checked too, and no row of a visited list is lost, however vectors lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

CODES = 16


class Quantizer:
    """Coarse centroids and anisotropic codebooks, trained with numpy on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = 0.2, rounds: int = 6, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        n, d = sample.shape
        self.dims, self.pairs = d, -(-d // 2)
        self.weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        lists = max(1, min(lists, n))
        c = sample[np.sort(rng.choice(n, lists, replace=False))].copy()
        for _ in range(10 if lists > 1 else 1):
            own = (sample @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            count = np.bincount(own, minlength=lists)
            total = np.zeros_like(c)
            np.add.at(total, own, sample)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        self.centroids = c.astype(np.float32)
        own = self.lists(sample)
        res, x = self._cut(sample - c[own]), self._cut(sample)
        self.books = np.stack([res[rng.choice(n, CODES, replace=n < CODES), s] for s in range(self.pairs)])
        for _ in range(rounds):
            codes = self._codes(res, x)
            self._update(res, x, codes)
        self.books = self.books.astype(np.float32)

    def _cut(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, 2 * self.pairs - self.dims))).reshape(len(v), self.pairs, 2).astype(np.float64)

    def lists(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def _codes(self, res: np.ndarray, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Coordinate descent on |e|^2 + (weight - 1) (e . x)^2, where e is the residual's error, for
        as many rows at a time as 32 MB of errors hold."""
        step = max(1, (1 << 21) // (self.pairs * CODES))
        out = np.empty((len(res), self.pairs), np.int64)
        for lo in range(0, len(res), step):
            r, v = res[lo : lo + step], x[lo : lo + step]
            err = r[:, :, None, :] - self.books[None]  # rows, pairs, codes, 2
            plain, along = (err**2).sum(-1), (err * v[:, :, None, :]).sum(-1)
            codes = plain.argmin(2)
            rows = np.arange(len(r))
            total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
            for _ in range(sweeps):
                for s in range(self.pairs):
                    rest = total - along[rows, s, codes[:, s]]
                    best = (plain[:, s] + (self.weight - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                    codes[:, s] = best
                    total = rest + along[rows, s, best]
            out[lo : lo + step] = codes
        return out

    def _update(self, res: np.ndarray, x: np.ndarray, codes: np.ndarray, sweeps: int = 3) -> None:
        """Codewords that lower the loss for these codes: the 16 of each pair of dimensions in turn,
        by one system of 32 unknowns, with the others as they stand."""
        n, size = len(res), CODES * 2
        rows = np.arange(n)
        along = ((res - self.books[np.arange(self.pairs), codes]) * x).sum(2)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(self.pairs):
                v = np.zeros((n, size))
                v[rows, 2 * codes[:, s]], v[rows, 2 * codes[:, s] + 1] = x[:, s, 0], x[:, s, 1]
                rest = total - along[:, s] + (res[:, s] * x[:, s]).sum(1)
                right = (self.weight - 1) * v.T @ rest
                np.add.at(right, 2 * codes[:, s], res[:, s, 0])
                np.add.at(right, 2 * codes[:, s] + 1, res[:, s, 1])
                left = (self.weight - 1) * v.T @ v
                left[np.diag_indices(size)] += np.repeat(np.bincount(codes[:, s], minlength=CODES), 2) + 1e-6
                self.books[s] = np.linalg.solve(left, right + 1e-6 * self.books[s].ravel()).reshape(CODES, 2)
                new = ((res[:, s] - self.books[s][codes[:, s]]) * x[:, s]).sum(1)
                total += new - along[:, s]
                along[:, s] = new

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.lists(v)
        codes = self._codes(self._cut(v - self.centroids[own]), self._cut(v)).astype(np.uint8)
        if self.pairs % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return own, codes[:, ::2] | codes[:, 1::2] << 4

    def missed(self, v: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what list and code of each row leave out of it."""
        each = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)[:, : self.pairs]
        error = self._cut(v - self.centroids[own]) - self.books[np.arange(self.pairs), each]
        return np.sqrt((error**2).sum((1, 2)))

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products with the residuals: a table of 256 sums per byte of codes."""
        q = self._cut(queries)
        tables = np.einsum("qsd,scd->qsc", q, self.books.astype(np.float64)).astype(np.float32)
        if self.pairs % 2:
            tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
        wide = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(q), -1, 256)
        out = np.zeros((len(q), len(codes)), np.float32)
        for b in range(codes.shape[1]):
            out += wide[:, b][:, codes[:, b]]
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, len): the rows that take part: neither null nor zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.sqrt(norm).alias("len"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _nearest(q_ids, q_vecs, ids, vecs, approx, k: int, rerank: int, miss=np.inf):
    """Exact top k of each query. The rerank best of approx, and all rows that equal the last of them, give
    the score to beat; every other row is held against it by its bound (approx and what its code misses),
    and those that may reach it are checked exactly too. Rows come in order of id."""
    out = []
    vecs = vecs / np.abs(vecs).max(1, keepdims=True)
    lens = np.sqrt((vecs * vecs).sum(1))
    queries = q_vecs / np.abs(q_vecs).max(1, keepdims=True)
    q_lens = np.sqrt((queries * queries).sum(1))

    def scored(i: int, near: np.ndarray) -> np.ndarray:
        pieces = (near[at : at + 1024] for at in range(0, max(1, len(near)), 1024))
        return np.concatenate([(vecs[p] * queries[i]).sum(1) / (lens[p] * q_lens[i]) for p in pieces])

    beat = np.full(len(q_ids), -np.inf)
    for i, qid in enumerate(q_ids):
        a = approx[i]
        if len(a) > rerank + 1:
            cut = np.partition(a, len(a) - rerank - 1)[len(a) - rerank - 1]
            near = np.flatnonzero(a >= cut)
            score = scored(i, near[ids[near] != qid])
            if len(score) >= k:
                beat[i] = np.partition(score, len(score) - k)[len(score) - k]
    miss, keep = np.broadcast_to(miss, len(ids)), np.zeros((len(q_ids), len(ids)), bool)
    for at in range(0, len(ids), 4096):
        # sums of the scan are of 32 bits, those of the products of 64
        may = approx[:, at : at + 4096] + miss[at : at + 4096] >= (beat - 1e-4)[:, None]
        rows = np.flatnonzero(may.any(0))
        product = (queries @ vecs[at + rows].T) / (q_lens[:, None] * lens[at + rows])
        keep[:, at + rows] = may[:, rows] & (product >= (beat - 1e-9)[:, None])
    for i, qid in enumerate(q_ids):
        near = np.flatnonzero(keep[i])
        near = near[ids[near] != qid]
        score = scored(i, near)
        top = np.lexsort((ids[near], -score))[:k]
        out.extend((qid, int(ids[near[t]]), float(score[t])) for t in top)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 250, list_rows: int = 8192, probe: float = 1.0, sample_rows: int = 8192, block_bytes: int = 4 << 20, query_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query, by cosine.

    vectors and queries come from ``usable``. The quantizer is fitted on sample_rows rows at most
    (those with the smallest hashes of their ids); every row is indexed. There is a list for each
    list_rows rows, up to 4096 lists, and a query visits the share ``probe`` of them that is nearest,
    one at least. Lists are cut into blocks of vectors by a hash of ids, and a list's queries into
    blocks too, both of bounded bytes, so a hot list or vector spreads over tasks: a vector travels once
    for each block of queries. Equal scores come in order of vec_id. The row with the
    query's own id takes no part. Of rows of unequal lengths, the most frequent length counts (the
    greater of equals). A repeated id is asked once, but each of its rows can be found. Fewer than k
    candidates are all returned, and a query whose lists hold fewer than k is asked on all lists.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    sizes = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    block_rows, query_rows = max(1, block_bytes // (8 * d)), max(1, query_bytes // (8 * d))
    vectors, queries = vectors.where(F.size("vec") == d), queries.where(F.size("vec") == d)
    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").collect()])
    model = Quantizer(_unit(sample), min(4096, -(-n // list_rows)))
    lists = len(model.centroids)
    probes = max(1, round(lists * probe))

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                u = _unit(v)
                own, codes = model.encode(u)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(model.missed(u, own, codes))], names=["id", "vec", "list", "code", "miss"])

    def visits(batches, probes: int = probes):
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                near = np.argsort(-(_unit(v) @ model.centroids.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    indexed = staged(vectors.select("id", "vec").mapInArrow(index, "id long, vec array<double>, list int, code binary, miss double"), "vector-index")
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    asked = staged(queries.mapInArrow(visits, "id long, vec array<double>, lists array<int>"), "queries")
    blocks = indexed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))

    def scan(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        rows = rows.sort_values("id", ignore_index=True)
        ids, vecs = rows["id"].to_numpy(), np.stack(rows["vec"])
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        out = []
        for at in range(0, len(ask), 64):
            part = ask.iloc[at : at + 64]
            q = np.stack(part["vec"])
            u = _unit(q)
            approx = model.scan(u, codes) + (u @ model.centroids[rows["list"].iat[0]])[:, None]  # a block is of one list
            out += _nearest(part["id"].tolist(), q, ids, vecs, approx, k, rerank, rows["miss"].to_numpy())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def run(asked: DataFrame) -> DataFrame:
        visit = asked.select("id", "vec", F.explode("lists").alias("list"))
        shares = visit.groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares"))
        plan = F.broadcast(blocks.join(shares, "list"))  # 4096 lists at most
        spots = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = indexed.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "vec", "code", "miss", "list", "block", spots("shares").alias("share"))
        right = visit.join(plan, "list").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).select("id", "vec", "list", spots("blocks").alias("block"), "share")
        keys = ["list", "block", "share"]
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(lambda a, b: scan(a, b), "query_id long, vec_id long, score double")

    found = staged(run(asked), "found")
    least = min(k, n - 1)
    if lists > probes:
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        short = staged(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short-queries")
        if not short.isEmpty():
            everywhere = short.withColumn("lists", F.sequence(F.lit(0), F.lit(lists - 1)))
            found = found.join(short, F.col("id") == F.col("query_id"), "left_anti").unionByName(run(everywhere))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors, vectors.where("id % 50 = 0"))
