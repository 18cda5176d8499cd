"""Document fingerprints by consistent weighted sampling.

Terms are the k-word shingles of a text and weigh as often as they occur. Each of the samples draws
one term: gamma-distributed r and c and a uniform b belong to the term and the sample alone, and a
term of weight S gets t = floor(ln S / r + b) and the value ln c - r (t - b + 1); the least value
wins. Two texts draw the same (term, t) with a chance equal to their generalised Jaccard
similarity, the sum of the lesser over the sum of the greater weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix64, shingles, staged, string_buffers, word_hashes

#: Quantiles of doc_id that are asked for at most; finer ranges are equal parts of these.
COARSE = 2000
#: Terms whose samples are drawn in one step; temporaries are 4 bytes a sample and term.
STEP = 1024


def weighted_terms(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms of every row, their counts, offsets of the rows)."""
    h, at = shingles(*word_hashes(raw, offs), k)
    terms, counts, sizes = [], [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        t, c = np.unique(h[a:b], return_counts=True)
        terms.append(t)
        counts.append(c)
        sizes.append(len(t))
    return np.concatenate(terms or [h]), np.concatenate(counts or [at[:0]]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal shares, by Newton's method."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.26, np.sqrt(2 * p), -np.log1p(-p) + 1)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32)


_GAMMA = _gamma_table()
_UNIT = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def draws(terms: np.ndarray, counts: np.ndarray, first: int, samples: int) -> np.ndarray:
    """For every term and the samples from ``first``: the value's bits above, which sort as the
    value does, and 32 bits of the drawn (term, t) below, so that a minimum picks the sample.

    Two 32-bit hashes of term and sample give 16 bits each to r, c and b, looked up in tables of
    quantiles.
    The value is taken out of its logarithm: it is then above 0.
    """
    out = np.empty((len(terms), samples), np.uint64)
    keys = (mix64(np.arange(4 * first + 1, 4 * (first + samples) + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    for lo in range(0, len(terms), STEP):
        t64, n = terms[lo : lo + STEP], counts[lo : lo + STEP]
        low, high = t64.astype(np.uint32)[:, None], (t64 >> U64(32)).astype(np.uint32)[:, None]
        x = low * keys[::4]
        x += high * keys[1::4]
        x ^= x >> np.uint32(15)
        x *= keys[2::4]
        y = x ^ high
        x ^= x >> np.uint32(16)
        y *= keys[3::4]
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        x, y = x.view(np.uint16), y.view(np.uint16)
        r, c, b = np.take(_GAMMA, x[:, 1::2]), np.take(_GAMMA, y[:, 1::2]), np.take(_UNIT, x[:, ::2])
        name = np.repeat((t64 >> U64(16)).astype(np.uint32)[:, None], samples, 1)
        b -= np.float32(1)
        many = np.flatnonzero(n > 1)
        if len(many):
            t = np.floor(np.log(n[many].astype(np.float32))[:, None] / r[many] + b[many] + 1)
            b[many] -= t
            name[many] += t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        r *= b
        np.exp(r, out=r)
        r *= c
        both = out[lo : lo + STEP].view(np.uint32).reshape(len(t64), samples, 2)
        both[:, :, 1], both[:, :, 0] = r.view(np.uint32), name
    return out


def signatures(rows: list[tuple[np.ndarray, np.ndarray]], samples: int, bits: int = 16) -> np.ndarray:
    """Signatures of rows (terms, counts): a number of ``bits`` bits per sample; -1 without terms.
    Equal (term, count) pairs of the rows are drawn once."""
    out = np.full((len(rows), samples), -1, np.int64)
    sizes = np.array([len(t) for t, _ in rows])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pairs = np.empty(int(sizes.sum()), dtype=[("t", np.uint64), ("c", np.int64)])
    pairs["t"], pairs["c"] = np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows])
    key = mix64(pairs["t"] + mix64(pairs["c"].astype(np.uint64)))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, samples, 16):
        n = min(16, samples - lo)
        drawn = draws(pairs["t"][first], pairs["c"][first], lo, n)
        out[full, lo : lo + n] = (np.minimum.reduceat(drawn[inverse], at[:-1][full], axis=0) & U64((1 << bits) - 1)).astype(np.int64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples; texts without terms are like each other and unlike the rest."""
    return (a == b).mean(1)


def _print(sig: np.ndarray, bits: int) -> list[str]:
    """Hexadecimal; a text without terms has a row of dashes."""
    plain = sig.astype(">u2" if bits == 16 else ">u4")
    return ["-" * (bits // 4 * sig.shape[1]) if s[0] < 0 else p.tobytes().hex() for s, p in zip(sig, plain, strict=True)]


def fingerprints(docs: DataFrame, k: int = 5, samples: int = 64, bits: int = 16) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text), without any shuffle. Null text is
    empty; texts without words share one fingerprint; equal texts have equal ones."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            terms, counts, at = weighted_terms(*string_buffers(batch.column(1)), k)
            rows = [(terms[a:b], counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_print(signatures(rows, samples, bits), bits), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _compare(k: int, samples: int, bits: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(rows: list[tuple], following: str) -> pa.RecordBatch:
        """Results of consecutive rows (doc_id, text), of which the last is followed by a text."""
        texts = [t for _, t in rows] + [following]
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:-1], texts[1:], strict=True)]
        terms, counts, at = weighted_terms(*string_buffers(pa.array([*texts, *edited], pa.large_string())), k)
        sig = signatures([(terms[a:b], counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], samples, bits)
        m = len(rows)
        own, nxt, new = sig[:m], sig[1 : m + 1], sig[m + 1 :]
        cols = [[r[0] for r in rows], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], _print(own, bits), _print(new, bits), likeness(own, new), likeness(own, nxt)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    def run(batches):
        """Rows (bucket, guest, doc_id, text) in order; a bucket's first guest follows its last row."""
        held, chars, bucket, closed = [], 0, None, False
        for batch in batches:
            raw, offs = string_buffers(batch.column(3))
            for at, guest, doc, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                if at != bucket:
                    held, chars, bucket, closed = [], 0, at, False
                if closed:
                    continue
                text = raw[lo:hi].tobytes().decode("utf-8", "replace")
                if held and (guest or chars > 1 << 18 or len(held) >= 128):
                    yield block(held, text)
                    held, chars = [], 0
                if guest:
                    closed = True
                    continue
                held.append((doc, text))
                chars += len(text)

    return run


def against_edits(docs: DataFrame, k: int = 5, samples: int = 64, bits: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row of docs (doc_id, text).

    The edited text has its last half (rounded down) of code points replaced by as many first ones of
    the next row in order of doc_id (null first), then text; after the last row comes the first. Rows
    go to ranges of ids once, each range with a copy of the first row of the next range, and are
    compared as they stream by in order. A single row follows itself; null text is empty; rows that
    share a doc_id are of one range, so are those without one. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    # ranges of ids: quantiles of a sketch of fixed size, each cut evenly where more ranges are wanted
    wanted = max(1, -(-n // bucket_rows))
    coarse = min(wanted, COARSE)
    fine = -(-wanted // coarse)
    inner = docs.stat.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.1 / COARSE) if coarse > 1 else []
    edges = np.unique(np.array([low or 0, *inner, (high or 0) + 1], np.float64))

    @F.pandas_udf("long")
    def bucket_of(ids):
        import pandas as pd

        known = np.where(ids.isna(), edges[0], ids.fillna(0).astype("float64"))
        at = np.clip(np.searchsorted(edges, known, "right") - 1, 0, len(edges) - 2)
        part = np.clip((known - edges[at]) / (edges[at + 1] - edges[at]) * fine, 0, fine - 1).astype("int64")
        return pd.Series(at * fine + part)

    placed = docs.withColumn("bucket", bucket_of("doc_id"))
    # the first row of each range also follows the last row of the range before
    heads = staged(placed.groupBy("bucket").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("null")), "ranges")
    after = F.lag("bucket").over(Window.orderBy("bucket"))  # one row of 24 bytes for each range of bucket_rows documents
    last = heads.agg(F.max("bucket")).first()[0]
    guests = heads.select(F.coalesce(after, F.lit(last)).alias("to"), F.when(~F.col("null"), F.col("id")).alias("head"))
    guests = F.broadcast(guests) if heads.count() <= 1_000_000 else guests
    visiting = docs.join(guests, F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text")
    rows = placed.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(visiting)
    # ranges are dealt in turn, not by a hash: no task has several while others have none
    dealt = rows.repartitionById(min(len(edges) * fine, 1 << 20), F.pmod("bucket", F.lit(1 << 20)).cast("int"))
    return dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_compare(k, samples, bits), schema)


def op7_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
