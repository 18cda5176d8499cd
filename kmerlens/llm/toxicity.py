"""Toxicity: a convolutional text classifier over hashed word embeddings, trained with numpy.

Every word and every word's beginning is hashed into 2^20 buckets each; buckets that occur in enough
training texts have an embedding, others share a zero one, and a word is the sum of its two. Filters
of several widths slide over the words; each filter's maxima over the two halves of the text, the
larger and the smaller, feed a logistic output. Scores are calibrated for each
language, told from the words themselves, so that one threshold serves all languages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, held_out, lean, rows_of, staged, string_buffers, word_hashes

BUCKET_BITS = 20
PREFIX_BYTES = 6
#: The score from which a document counts as toxic.
THRESHOLD = 0.3


def buckets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word and of its beginning, words' offsets of the rows). Here a word is a run
    of letters, digits and bytes above 127, so punctuation next to a word leaves its bucket alone;
    A-Z and the capitals of Latin-1 are folded."""
    plain = _PLAIN[raw]
    second = np.flatnonzero(plain[:-1] == 0xC3) + 1
    b = plain[second]
    plain[second] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    words, at = word_hashes(plain, offs, prefix=PREFIX_BYTES)
    return (words >> U64(64 - BUCKET_BITS)).astype(np.int32) + np.array([0, 1 << BUCKET_BITS], np.int32), at


_PLAIN = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_lo:_hi] = np.arange(_lo, _hi)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Classifier:
    """rows: bucket to embedding (0: none). filters: by width, (width * dims, filters)."""

    rows: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    slope: np.ndarray = field(default_factory=lambda: np.ones(1))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, ids: np.ndarray, at: np.ndarray, where: bool = False):
        """Largest rectified response of every filter in each row, 0 at least; and its place."""
        m, width = len(at) - 1, max(self.filters)
        counts = np.diff(at)
        # width - 1 zero embeddings behind every row keep windows inside it
        place = np.arange(len(ids)) + np.repeat(np.arange(m) * (width - 1), counts)
        padded = np.zeros((len(ids) + m * (width - 1) + width, 2), np.int32)
        padded[place] = ids
        starts = at[:-1] + np.arange(m) * (width - 1)
        x = self.embedding[padded[:, 0]]
        x += self.embedding[padded[:, 1]]
        full = np.flatnonzero(counts)
        feats, spots = [], []
        for w, f in self.filters.items():
            n = len(padded) - w + 1
            r = x[:n] @ f[: x.shape[1]]
            for j in range(1, w):
                r += x[j : n + j] @ f[j * x.shape[1] : (j + 1) * x.shape[1]]
            r += self.bias[w]
            half = np.zeros((2, m, f.shape[1]), np.float32)
            spot = np.full((2, m, f.shape[1]), -1)
            if where:
                for i in full:
                    mid = starts[i] + (counts[i] + 1) // 2
                    for k, (lo, hi) in enumerate(((starts[i], mid), (mid, starts[i] + counts[i]))):
                        if hi > lo:
                            j = r[lo:hi].argmax(0)
                            half[k, i], spot[k, i] = r[lo:hi][j, np.arange(f.shape[1])], j + lo
            elif len(full):
                mid = starts[full] + (counts[full] + 1) // 2
                ends = np.stack([starts[full], mid, starts[full] + counts[full]], 1).ravel()
                most = np.maximum.reduceat(r, ends, axis=0).reshape(len(full), 3, -1)
                half[0, full], half[1, full] = most[:, 0], np.where((counts[full] > 1)[:, None], most[:, 1], 0)
            half = np.maximum(half, 0)
            larger = half[0] >= half[1]
            feats += [np.where(larger, half[0], half[1]), np.where(larger, half[1], half[0])]
            spots += [np.where(larger, spot[0], spot[1]), np.where(larger, spot[1], spot[0])]
        return np.hstack(feats), np.hstack(spots), padded

    def language(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(at) - 1, self.languages.shape[1]))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            total[full] = np.add.reduceat(self.languages[ids].sum(1, dtype=np.float64), at[:-1][full], axis=0)
        return total.argmax(1)

    def margins(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(ids, at)[0] @ self.out + self.out_bias

    def scores(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids = self.rows[words]
        lang = self.language(ids, at)
        return _sigmoid(self.slope[lang] * self.margins(ids, at) + self.shift[lang])


def _labelled_rows(batches):
    for batch in batches:
        raw, offs = string_buffers(batch.column(0))
        words, at = buckets(raw, offs)
        blobs = [words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1), batch.column(2), batch.column(3)], names=["words", "label", "lang", "place"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, dims: int = 8, n_filters: int = 12, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 6, least_docs: int = 3, seed: int = 3) -> Classifier | None:
    """Trains on rows (doc_id, text, lang) with a label (doc_id, toxic) that are not held out: of each
    label per_class rows at most, those with the smallest hashes of doc_id, in whole (as word
    buckets, 8 bytes a word, on the driver). Three in four train, the others calibrate. lang serves
    only as the label of the words' language. None if either label is missing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    pick = known.withColumn("place", F.xxhash64("doc_id"))
    pick = staged(pick.where("label = 1").orderBy("place", "doc_id").limit(per_class).unionByName(pick.where("label = 0").orderBy("place", "doc_id").limit(per_class)), "chosen")
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(pick), "doc_id")  # 2 * per_class rows at most
    rows = sorted(rows.select("text", "label", F.coalesce("lang", F.lit("")).alias("lang"), "place").repartition(8).mapInArrow(_labelled_rows, "words binary, label int, lang string, place long").collect(), key=lambda r: (r["place"], r["label"], bytes(r["words"])))
    y = np.array([r["label"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    texts = [np.frombuffer(r["words"], np.int32).reshape(-1, 2) for r in rows]
    langs = sorted({r["lang"] for r in rows})
    lang = np.array([langs.index(r["lang"]) for r in rows])
    train = np.arange(len(y)) % 4 != 3

    # buckets that enough texts have, with their log odds of the label and of each language
    seen = [np.unique(t) for t in texts]
    size = 2 << BUCKET_BITS
    pos = np.bincount(np.concatenate([s for s, l, t in zip(seen, y, train, strict=True) if l and t] or [np.zeros(0, int)]), minlength=size)
    neg = np.bincount(np.concatenate([s for s, l, t in zip(seen, y, train, strict=True) if not l and t] or [np.zeros(0, int)]), minlength=size)
    kept = np.flatnonzero(pos + neg >= least_docs)
    table = np.zeros(size, np.int32)
    table[kept] = np.arange(1, len(kept) + 1)
    n1, n0 = float(y[train].sum()), float((1 - y[train]).sum())
    odds = np.log((pos[kept] + 0.5) / (n1 + 1)) - np.log((neg[kept] + 0.5) / (n0 + 1))
    doubt = np.sqrt(1 / (pos[kept] + 0.5) + 1 / (neg[kept] + 0.5))
    rng = np.random.Generator(np.random.PCG64(seed))
    e = rng.normal(0, 0.05, (len(kept) + 1, dims)).astype(np.float32)
    e[1:, 0] = np.clip(odds / np.maximum(doubt, 0.3), -4, 4) / 4
    e[0] = 0
    f = {w: rng.normal(0, 0.2, (w * dims, n_filters)).astype(np.float32) for w in widths}
    for w in widths:
        f[w][::dims] = np.abs(f[w][::dims]) + 1.0 / w
    model = Classifier(table, e, f, {w: np.zeros(n_filters, np.float32) for w in widths}, np.full(2 * n_filters * len(widths), 0.1, np.float32), _logit(n1 / (n1 + n0)) - 1.0)
    ids = [table[t] for t in texts]
    per_lang = np.full((len(kept) + 1, len(langs)), 0.5)
    for i in np.flatnonzero(train):
        per_lang[:, lang[i]] += np.bincount(ids[i].ravel(), minlength=len(kept) + 1)
    per_lang = np.log(per_lang / per_lang.sum(0))
    per_lang[0] = 0
    model.languages = per_lang.astype(np.float32)
    _descend(model, [ids[i] for i in np.flatnonzero(train)], y[train], epochs, rng)
    _calibrate(model, ids, y, train, share, len(langs))
    return model


def _descend(model: Classifier, ids: list[np.ndarray], y: np.ndarray, epochs: int, rng, batch: int = 64, rate: float = 0.02) -> None:
    """Adagrad on the log loss; only the places of the maxima carry gradients."""
    dims, widths = model.embedding.shape[1], list(model.filters)
    past: dict = {}

    def step(key, value, grad):
        past.setdefault(key, np.full(value.shape, 1e-3, np.float32))
        past[key] += grad * grad
        value -= rate * grad / np.sqrt(past[key])

    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            at = np.concatenate([[0], np.cumsum([len(ids[i]) for i in own])])
            feats, spots, padded = model.pooled(np.concatenate([ids[i] for i in own]), at, where=True)
            g = (_sigmoid(feats @ model.out + model.out_bias) - y[own]).astype(np.float32) / len(own)
            back = g[:, None] * model.out * (feats > 0)
            step("out", model.out, feats.T @ g + 1e-4 * model.out)
            model.out_bias -= rate * float(g.sum()) * 5
            touched, grads, col = [], [], 0
            for w in widths:
                n = model.filters[w].shape[1]
                b, s = back[:, col : col + 2 * n], spots[:, col : col + 2 * n]
                col += 2 * n
                live = (b != 0) & (s >= 0)
                j = np.nonzero(live)[1] % n
                place, value = s[live], b[live]
                grad = np.zeros_like(model.filters[w])
                for d in range(w):
                    row = padded[place + d]
                    x = model.embedding[row].sum(1)
                    np.add.at(grad[d * dims : (d + 1) * dims].T, j, value[:, None] * x)
                    touched += [row[:, 0], row[:, 1]]
                    grads += [value[:, None] * model.filters[w][d * dims : (d + 1) * dims].T[j]] * 2
                step(("f", w), model.filters[w], grad)
                total = np.zeros(n, np.float32)
                np.add.at(total, j, value)
                step(("b", w), model.bias[w], total)
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(rows), dims), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            total[rows == 0] = 0
            past.setdefault("e", np.full(model.embedding.shape, 1e-3, np.float32))
            past["e"][rows] += total * total
            model.embedding[rows] -= rate * total / np.sqrt(past["e"][rows])


def _calibrate(model: Classifier, ids: list[np.ndarray], y: np.ndarray, train: np.ndarray, share: float, langs: int) -> None:
    """Per language, on the rows that did not train: a logistic curve over the margins, weighed to
    the labels' share in the corpus, and shifted so that the threshold of the best F1 has the score
    THRESHOLD. A language with fewer than 20 rows of a label takes the curve of all."""
    test = np.flatnonzero(~train)
    at = np.concatenate([[0], np.cumsum([len(ids[i]) for i in test])])
    flat = np.concatenate([ids[i] for i in test]) if len(test) else np.zeros(0, np.int32)
    z, own, t = model.margins(flat, at), model.language(flat, at), y[test]
    w1, w0 = share / max(float(y.mean()), 1e-9), (1 - share) / max(1 - float(y.mean()), 1e-9)
    weight = np.where(t == 1, w1, w0)

    def curve(z, t, weight):
        a, b = 1.0, 0.0
        if min((t == 1).sum(), (t == 0).sum()) < 2:
            return a, b + float(np.log(w1 / w0))
        for _ in range(50):
            p = _sigmoid(a * z + b)
            q = weight * p * (1 - p)
            g = np.array([(weight * (p - t) * z).sum() + 0.1 * (a - 1), (weight * (p - t)).sum()])
            h = np.array([[(q * z * z).sum() + 0.1, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = max(0.05, a - float(np.clip(step[0], -2, 2))), b - float(np.clip(step[1], -4, 4))
        order = np.argsort(-z, kind="stable")
        hit, claimed = np.cumsum((weight * t)[order]), np.cumsum(weight[order])
        f1 = 2 * hit / (claimed + (weight * t).sum())
        i = int(f1.argmax())
        cut = (z[order][i] + (z[order][i + 1] if i + 1 < len(z) else z[order][i] - 1)) / 2
        return a, _logit(THRESHOLD) - a * cut

    a, b = curve(z, t, weight)
    model.slope, model.shift = np.full(langs, a), np.full(langs, b)
    for k in range(langs):
        s = own == k
        if min((t[s] == 1).sum(), (t[s] == 0).sum()) >= 20:
            model.slope[k], model.shift[k] = curve(z[s], t[s], weight[s])


def _scores(model: Classifier | None, texts: pa.Array) -> np.ndarray:
    raw, offs = string_buffers(texts)
    m = len(offs) - 1
    score, lo = np.zeros(m), 0
    while model and lo < m:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 19), "right")) - 1)
        words, at = buckets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        score[lo:hi] = model.scores(words, at)
        lo = hi
    return score


def classify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs (doc_id, text). Null text counts as empty and
    gets the score of a text without words; without a model every score is 0. Repeated rows have equal
    scores; no rows give no rows. Memory follows the longest text."""
    bounded_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(broadcast.value, batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """The rows of docs that ``classify`` doesn't predict to be toxic, all columns as they are, whatever
    their names. Null and empty texts are judged as texts without words; without a model all rows
    stay; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    broadcast, place, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            fields = batch.column(0).flatten()
            kept = pa.array(_scores(broadcast.value, fields[place]) < THRESHOLD)
            yield pa.RecordBatch.from_arrays([f.filter(kept) for f in fields], names=names)

    return docs.select(rows_of(docs)).mapInArrow(lean(run), docs.schema)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
