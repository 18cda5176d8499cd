import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerlens.llm import ann, common, fingerprint, langid, toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", common.held_out(F.col("id"))).collect()}
    assert got == {i: held(i) for i in range(50)}


def test_language_mixtures(spark):
    rng = random.Random(1)
    vocab = {"aa": ["tala", "lata", "atal", "ralat"], "bb": ["chuck", "knock", "thick", "shock"], "cc": ["ouie", "eiou", "oueie", "iouea"]}
    line = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(i, line(lang, 30), lang, 9.0) for i, lang in enumerate(rng.choices(list(vocab), k=200))]
    rows += [(1000, None, "aa", 9.0), (1001, "", None, 9.0), (1002, "12 34 !?", None, 9.0), (1003, line("aa", 60) + " " + line("bb", 30), None, 9.0), (1004, "日本語", None, 9.0), (1004, "日本語", None, 9.0), (None, "thick shock", None, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit_languages(df, per_language=40)
    got = langid.detect(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang, _ in rows[:200] if held(i)]) == 1.0
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    mix = by[1003]["mixture"]
    assert by[1003]["lang_pred"] == "aa" and mix["aa"] == pytest.approx(2 / 3, abs=0.1) and mix["bb"] == pytest.approx(1 / 3, abs=0.1)
    assert len(by[0]["mixture"]) == 1 and by[1004]["lang_pred"] != "und" and by[None]["lang_pred"] == "bb"
    assert langid.fit_languages(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.detect(df, None).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        w = [f"{rng.choice('abc')}{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["vile", "Foul,", "RANK"]))
        rows.append((i, " ".join(w), "en" if i % 3 else None, "s"))
        if i % 5:
            labels.append((i, int(bad), 1))
    rows += [(900, None, None, "s"), (901, "", None, "s"), (902, "vile foul " * 20000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, lab, per_class=200)
    got = {r["doc_id"]: r for r in toxicity.classify(df, model).collect()}
    test = [(got[i]["predicted"], y) for i, y, _ in labels if held(i)]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0 and got[902]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    wide = df.selectExpr("*", "5 as predicted", "'x' as row")
    kept = toxicity.without_toxic(wide, model)
    assert kept.columns == wide.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in wide.collect()}
    assert toxicity.without_toxic(wide.limit(0), model).isEmpty() and toxicity.classify(df.limit(0), model).isEmpty()
    assert toxicity.fit(df.limit(0), lab) is None and toxicity.fit(df, lab.limit(0)) is None
    assert toxicity.fit(df, lab.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.classify(df, None).collect()} == {0.0}


def shingle_counts(text, k=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_fingerprints(spark, bucket_rows):
    rng = random.Random(7)
    rows = [(i * 3, " ".join(f"é{rng.randrange(50)}" for _ in range(rng.randrange(0, 120)))) for i in range(40)] + [(1, None), (2, ""), (200, "a b c"), (201, "a b c"), (50, "tie one"), (50, "tie two")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    got = fingerprint.against_edits(df, bucket_rows=bucket_rows, samples=256).collect()
    order = sorted(((d, t or "") for d, t in rows))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    errors = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = next(x for x in by[d] if x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(shingle_counts, (t, edited, nxt))
        for x, y in ((b, "near_edited"), (c, "near_next")):
            if a and x:
                errors.append(r[y] - sum((a & x).values()) / sum((a | x).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    plain = {(r["doc_id"], r["fingerprint"]) for r in fingerprint.fingerprints(df, samples=256).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got}
    assert by[200][0]["fingerprint"] == by[201][0]["fingerprint"] and by[1][0]["fingerprint"] == by[2][0]["fingerprint"]
    odd = [(None, "null id text " * 4), (None, "z " * 3), (7, "w " * 150_000), (9, None)]
    few = fingerprint.against_edits(spark.createDataFrame(odd, "doc_id long, text string"), bucket_rows=2).collect()
    texts = ["null id text " * 4, "z " * 3, "w " * 150_000, ""]
    want = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1], strict=True)}
    assert {r["edited_sha256"] for r in few} == want and len(few) == 4
    assert fingerprint.against_edits(df.limit(0)).isEmpty()
    lone = fingerprint.against_edits(df.where("doc_id = 200")).first()
    assert lone["near_next"] == 1.0


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        u = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a = rng.integers(0, 5, len(u)) * (rng.random(len(u)) < 0.8)
        b = np.where(rng.random(len(u)) < 0.5, a, rng.integers(0, 5, len(u)))
        s = fingerprint.signatures([(u[a > 0], a[a > 0]), (u[b > 0], b[b > 0])], 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def brute_nearest(ids, x, queries, k):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in queries:
        s = u @ u[list(ids).index(q)]
        top = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))[:k]
        out[q] = [ids[i] for i in top]
    return out


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 15)).astype(np.float32)
    x[200:260] = x[10]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    bad = [(5000, None, "z"), (5050, [0.0] * 15, "z"), (5100, [1.0] * 14 + [None], "z"), (5150, [float("nan")] + [1.0] * 14, "z"), (5200, [1.0, 2.0], "z"), (None, [1.0] * 15, "z")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, len string")
    v = ann.usable(df, "vec_id", "embedding")
    got = ann.search(v, v.where("id % 50 = 0"), list_rows=300, block_bytes=100 * 8 * 15, query_bytes=5 * 8 * 15).toPandas()
    want = brute_nearest(list(range(1200)), x.astype(float), range(0, 1200, 50), 5)
    assert set(got.query_id) == set(want)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (5 * len(want)) >= 0.95
    g = got[got.query_id == 200].sort_values("rank")
    assert g.vec_id.tolist() == [10, 201, 202, 203, 204] and g.score.iloc[0] == pytest.approx(1.0)
    few = ann.search(v.where("id < 4"), v.where("id = 0"), list_rows=1, probe=0.3)
    assert few.count() == 3
    assert ann.search(v.limit(0), v.limit(0)).isEmpty()


def test_all_rows_of_one_code_are_reranked():
    rng = np.random.default_rng(4)
    q = rng.normal(size=(1, 16))
    far = np.linspace(1.0, 0.01, 3000)[:, None]
    vecs = q + far * rng.normal(size=(3000, 16))
    got = ann._nearest([-1], q, np.arange(3000), vecs, np.ones((1, 3000), np.float32), 5, 100)
    score = (vecs @ q[0]) / np.sqrt((vecs**2).sum(1) * (q**2).sum())
    assert [g[1] for g in got] == np.lexsort((np.arange(3000), -score))[:5].tolist()


def test_large_vectors_are_quantised_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    x = ann._unit(rng.normal(size=(2000, 1024)))
    tracemalloc.start()
    model = ann.Quantizer(x, 1, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own, codes = model.encode(x[:100])
    near = model.scan(x[:100], codes) + (x[:100] @ model.centroids[0])[:, None]
    assert peak < 400e6 and codes.shape == (100, 256) and np.mean(near.argmax(1) == np.arange(100)) == 1.0


def test_search_among_many_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[300] + 1e-4 * rng.normal(size=(300, 16))
    x[600:610] = x[600]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, [1e308] * 16), (7, [float("inf")] * 16)], "vec_id long, embedding array<double>")
    v = ann.usable(df, "vec_id", "embedding")
    queries = [0, 350, 450, 600]
    got = ann.search(v, v.where(F.col("id").isin(queries)), list_rows=200, rerank=20).toPandas()
    y = np.vstack([x, np.ones(16)])
    ids = [*range(900), 50]
    want = brute_nearest(ids, y, queries, 5)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 20


def test_search_finds_all_in_dense_groups(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([c + 0.02 * rng.normal(size=(2000, 16)) for c in rng.normal(size=(3, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = ann.usable(df, "vec_id", "embedding")
    got = ann.search(v, v.where("id % 100 = 0"), rerank=50).toPandas()
    want = brute_nearest(list(range(6000)), x, range(0, 6000, 100), 5)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")} == want


def test_mixture_of_more_than_four_languages():
    model = langid.LanguageModel([f"l{i}" for i in range(7)], np.ones((7, 1 << langid.GRAM_BITS), np.int64))
    own = np.repeat(np.arange(6), 100)
    ll = np.where(own[:, None] == np.arange(7), -5.0, -40.0).astype(np.float32)
    shares = model.mixtures(ll, np.array([0, 600]))[0]
    assert np.flatnonzero(shares > 0.01).tolist() == list(range(6)) and shares[:6] == pytest.approx(1 / 6, abs=0.01)


def plain_mixture(ll):
    """EM to rest over one row's words, all subsets by rank, BIC; no shortcuts."""

    def em(sets, rounds=3000):
        pi = [1 / len(sets) if j in sets else 0.0 for j in range(ll.shape[1])]
        for _ in range(rounds):
            total = [0.0] * len(pi)
            for w in ll:
                r = [p * np.exp(x - max(w)) for p, x in zip(pi, w, strict=True)]
                total = [t + x / sum(r) for t, x in zip(total, r, strict=True)]
            pi = [t / len(ll) for t in total]
        return np.array(pi)

    def value(pi):
        return sum(np.log((pi * np.exp(w)).sum()) for w in ll) - 0.5 * (np.count_nonzero(pi) - 1) * np.log(len(ll))

    full = em(range(ll.shape[1]), 300)
    order = np.argsort(-full, kind="stable")
    return max((em(set(order[:size].tolist()), 300) for size in range(1, ll.shape[1] + 1)), key=value)


def test_mixtures_against_plain_em():
    rng = np.random.default_rng(12)
    model = langid.LanguageModel(["a", "b", "c"], np.ones((3, 1 << langid.GRAM_BITS), np.int64))
    rows = []
    for _ in range(25):
        own = rng.choice(3, int(rng.integers(1, 40)), p=rng.dirichlet([0.4] * 3))
        ll = rng.normal(-12, 1, (len(own), 3))
        ll[np.arange(len(own)), own] += rng.choice([0.5, 2.0, 6.0])
        rows.append(ll.astype(np.float32))
    to = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = model.mixtures(np.concatenate(rows), to)
    want = np.stack([plain_mixture(r.astype(float)) for r in rows])
    same = np.abs(got - want).max(1)
    assert (same < 0.05).mean() >= 0.9 and np.median(same) < 0.01
    assert model.mixtures(np.zeros((0, 3), np.float32), np.array([0, 0])).tolist() == [[0, 0, 0]]


def test_learned_shares_come_to_rest():
    model = langid.LanguageModel(["a", "b"], np.ones((2, 1 << langid.GRAM_BITS), np.int64))
    ll = np.log(np.array([[0.5, 0.4]] * 30 + [[0.3, 0.5]] * 20)).astype(np.float32)
    rough, fine = model.mixtures(ll, np.array([0, 50]), 1e-3)[0], model.mixtures(ll, np.array([0, 50]), 1e-6, 5000)[0]
    assert np.abs(rough - fine).max() < 0.06


def test_network_against_loops():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 30, 2 << toxicity.BUCKET_BITS).astype(np.int32)
    model = toxicity.Classifier(rows, rng.normal(size=(30, 5)).astype(np.float32), {w: rng.normal(size=(5 * w, 4)).astype(np.float32) for w in (1, 2, 3)}, {w: rng.normal(size=4).astype(np.float32) for w in (1, 2, 3)}, rng.normal(size=24).astype(np.float32), 0.3, rng.normal(size=(30, 2)).astype(np.float32), np.array([0.7, 1.3]), np.array([-0.2, 0.4]))
    model.embedding[0] = 0
    texts = ["one", "", "two words", "A, longer text; with some more words in it", None, "three more words"]
    words, at = toxicity.buckets(*common.string_buffers(pa.array(texts)))
    got = model.scores(words, at)
    for i in range(len(texts)):
        ids = model.rows[words[at[i] : at[i + 1]]]
        x = [model.embedding[a] + model.embedding[b] for a, b in ids] + [np.zeros(5)] * 2
        feats = []
        for w in (1, 2, 3):
            large, small = [], []
            for f in range(4):
                r = [max(0.0, float(np.concatenate(x[j : j + w]) @ model.filters[w][:, f] + model.bias[w][f])) for j in range(len(ids))]
                mid = (len(ids) + 1) // 2
                halves = [max(r[:mid], default=0.0), max(r[mid:], default=0.0)]
                large.append(max(halves))
                small.append(min(halves))
            feats += large + small
        lang = int(sum((model.languages[a] + model.languages[b] for a, b in ids), np.zeros(2)).argmax())
        z = model.slope[lang] * (np.dot(feats, model.out) + model.out_bias) + model.shift[lang]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
