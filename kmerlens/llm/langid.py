"""Language mixtures of documents: expectation-maximisation over n-gram likelihoods of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, staged, string_buffers

GRAM_BITS = 16
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def letter_grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of every letter byte, first gram of every word, words' offsets of the rows). A word is
    a run of ASCII letters and bytes above 127; its grams are hashed triples of neighbouring bytes,
    A-Z folded, with 0 beyond its ends."""
    b = _LETTER[raw]
    solid = b > 0
    edge = np.ones(len(b) + 1, bool)
    edge[1:-1] = ~solid[:-1]
    edge[offs[:-1][offs[:-1] < len(b)]] = True
    starts = np.flatnonzero(solid & edge[:-1])
    before = np.concatenate([[0], b[:-1]]).astype(np.uint32) if len(b) else b.astype(np.uint32)
    after = np.concatenate([b[1:], [0]]).astype(np.uint32) if len(b) else before
    inner = offs[(offs > 0) & (offs < len(b))]
    before[inner], after[inner - 1] = 0, 0
    gram = (((before << 16) | (b.astype(np.uint32) << 8) | after) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    where = np.flatnonzero(solid)
    return gram[where].astype(np.int32), np.searchsorted(where, starts), np.searchsorted(starts, offs)


class LanguageModel:
    """Smoothed n-gram log-probabilities of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        p = counts.astype(np.float64) + smooth
        self.logp = np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32).copy()  # gram, language

    def words(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of every word in every language, words' offsets of the rows)."""
        gram, first, to = letter_grams(raw, offs)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32), to
        return np.add.reduceat(self.logp[gram], first, axis=0), to

    def mixtures(self, ll: np.ndarray, to: np.ndarray, tolerance: float = 1e-3, rounds: int = 200) -> np.ndarray:
        """Shares of the languages in each row. EM fits all languages; then the sets of the 1, 2, ...
        largest, up to all, are refitted, and the set of the best likelihood less half a
        logarithm of the number of words per further language (BIC) is kept. EM goes on until no
        share of a row moves by more than ``tolerance``, for ``rounds`` rounds at most. Rows without
        words have shares of 0."""
        n, count = len(self.langs), np.diff(to)
        rows = np.flatnonzero(count)
        out = np.zeros((len(count), n))
        if not len(rows):
            return out
        at, of = to[:-1][rows], np.repeat(np.arange(len(rows)), count[rows])
        words = count[rows]
        top = ll.max(1, keepdims=True)
        lik = np.exp(np.maximum(ll - top, -60.0))

        def fit(pi: np.ndarray) -> np.ndarray:
            pi, live = pi.copy(), np.arange(len(pi))
            some, first, row, size = lik, at, of, words[:, None]
            for _ in range(rounds):
                r = some * pi[live][row]
                r /= r.sum(1, keepdims=True)
                now = np.add.reduceat(r, first, axis=0) / size
                moving = np.abs(now - pi[live]).max(1) > tolerance
                pi[live] = now
                if not moving.any():
                    break
                if moving.mean() < 0.7:  # rows at rest drop out
                    some, live, size = some[moving[row]], live[moving], size[moving]
                    first = np.cumsum(size[:, 0]) - size[:, 0]
                    row = np.repeat(np.arange(len(live)), size[:, 0])
            return pi

        full = fit(np.full((len(rows), n), 1.0 / n, np.float32))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best, shares = np.full(len(rows), -np.inf), full
        for size in range(1, n + 1):
            pi = np.where(rank < size, np.maximum(full, 1e-6), 0).astype(np.float32)
            pi /= pi.sum(1, keepdims=True)
            pi = pi if size == 1 else fit(pi)
            value = np.add.reduceat(np.log(np.maximum((lik * pi[of]).sum(1), 1e-30)), at) - 0.5 * (size - 1) * np.log(words)
            better = value > best
            best, shares = np.where(better, value, best), np.where(better[:, None], pi, shares)
        out[rows] = shares
        return out


def fit_languages(docs: DataFrame, per_language: int = 400) -> LanguageModel | None:
    """Learns from the rows (doc_id, text, lang) that are not held out and have a language: of each
    language per_language rows at most, those with the smallest hashes of doc_id, in whole."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    # a language of a third of all rows is ranked in 256 shares first, of per_language rows at most each
    turn = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = ids.withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(256))).withColumn("turn", turn("share")).where(F.col("turn") <= per_language)
    chosen = staged(some.withColumn("turn", turn()).where(F.col("turn") <= per_language).select("doc_id", "lang").distinct(), "chosen")
    langs = [r[0] for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    if chosen.count() <= 100_000:
        chosen = F.broadcast(chosen)
    sample = docs.join(chosen, ["doc_id", "lang"]).select("lang", "text").repartition(4)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), 1 << GRAM_BITS), np.int64)
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            gram, first, to = letter_grams(raw, offs)
            ends = np.append(first, len(gram))[to]
            for lang, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                total[place[lang]] += np.bincount(gram[a:b], minlength=1 << GRAM_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(langs)), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in total], pa.binary())], names=["lang", "counts"])

    counts = np.zeros((len(langs), 1 << GRAM_BITS), np.int64)
    for lang, blob in sample.mapInArrow(count, "lang int, counts binary").collect():
        counts[lang] += np.frombuffer(blob, np.uint32)
    return LanguageModel(langs, counts)


def detect(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of every row of docs (doc_id, text): the language with
    the largest share (the first by name of equals), its share, and all shares of the chosen set.

    Null text and text without any letter give ``und``, 0 and an empty mixture, and so does every
    row where nothing could be learned. Repeated rows give equal results; no rows give no rows.
    Memory follows the longest text (about 200 bytes a word), not the number of rows.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, lang_pred string, score double, mixture map<string,double>"
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = broadcast.value
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            m = len(offs) - 1
            shares = np.zeros((m, len(model.langs) if model else 1))
            lo = 0
            while model and lo < m:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1)
                ll, to = model.words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                shares[lo:hi] = model.mixtures(ll, to)
                lo = hi
            best = shares.argmax(1)
            known = shares[np.arange(m), best] > 0
            ascii_letters = np.concatenate([[0], np.cumsum((_LETTER[raw] > 0) & (raw < 128))])[offs]
            for i in np.flatnonzero(known & (np.diff(ascii_letters) == 0)):
                known[i] = any(ch.isalpha() for ch in raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
            pred = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.minimum(shares[np.arange(m), best], 1.0), 0.0)
            mixture = [[(model.langs[j], float(x[j])) for j in np.flatnonzero(x > 0)] if k else [] for x, k in zip(shares, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(mixture, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = detect(docs, fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
