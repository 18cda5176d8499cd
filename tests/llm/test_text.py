"""Word, shingle and component helpers, Jaccard join, passages, language models."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerlens.llm import common, jaccard, lmscore, passages

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \t\n\x0b. ", max_size=40), max_size=6))
def test_word_hashes_follow_the_pattern(texts):
    h, at = common.word_hashes(*common.string_buffers(pa.array(texts, pa.string())))
    names = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert at[i + 1] - at[i] == len(w)
        for a, b in zip(w, h[at[i] : at[i + 1]], strict=True):
            assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)


def test_words_made_to_collide_are_told_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    h, _ = common.word_hashes(*common.string_buffers(pa.array([a, b])))
    assert h[0] != h[1]


def test_segments_change_nothing(monkeypatch):
    texts = pa.array(["alpha beta  gamma" * 9, "", "x" * 100, None, " y z "])
    raw, offs = common.string_buffers(texts)
    whole = common.word_hashes(raw, offs)
    monkeypatch.setattr(common, "SEGMENT_BYTES", 16)
    cut = common.word_hashes(raw, offs)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_shingles():
    h, at = common.shingles(*common.word_hashes(*common.string_buffers(pa.array(["a b c d e f", "a b", "", "b a", "a b c d e"]))))
    assert np.diff(at).tolist() == [2, 1, 0, 1, 1]
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(df.repartition(7)).collect()}
    for part in (1, 40, 10**6):
        assert got == {r["node"]: r["root"] for r in common.components(df.repartition(7), part_edges=part).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert common.components(df.limit(0)).isEmpty()


def test_stage_tables_can_be_dropped(spark):
    common.drop_stages(spark)
    a, b = common.staged(spark.range(5), "one"), common.staged(spark.range(3), "two")
    common.unstage(a)
    common.unstage(a)
    assert b.count() == 3 and common.drop_stages(spark) == 1 and common.drop_stages(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(b._stage_path).count()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_heavy_keys(spark, how):
    rng = random.Random(3)
    rows = [(i, 7 if rng.random() < 0.4 else rng.randrange(60)) for i in range(500)] + [(900, 99)] * 3
    left, right = spark.createDataFrame(rows, "i long, k long"), spark.range(70).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for most, few in ((1, 10), (4, 10), (1000, 10), (4, 100)):
        got = common.join_hot(left, right, "k", how, most, few).select("i", "k", "v").collect()
        want = [(i, k, 2 * k if k < 70 else None) for i, k in rows if how == "left" or k < 70]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    docs = []
    for i in range(130):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w) + (" boiler plate text that every other one has here" if i % 2 else "")))
    return docs + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One\ttwo"), (505, "W " * 3000), (7, docs[7][1])]


def brute_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("kw", [{}, {"bucket_hashes": 64, "tile_bytes": 3000, "tile_rows": 5}, {"tile_rows": 5, "pair_blocks": 1}, {"tile_rows": 20}, {"one_in": 1}, {"one_in": 2, "tile_rows": 5, "pair_blocks": 1, "bucket_hashes": 64}])
def test_jaccard_against_all_pairs(spark, kw):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, key string, n int")
    got = jaccard.jaccard_components(df, **kw).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(docs)


def test_texts_of_frequent_lines_alone(spark):
    rng = random.Random(23)
    lines = [" ".join(f"f{i}_{j}" for j in range(12)) for i in range(9)]
    rows = [(i, " ".join(rng.sample(lines, rng.randrange(1, 7)))) for i in range(150)]
    rows += [(200 + i, f"{' '.join(lines[:5])} " + " ".join(f"g{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for kw in ({"one_in": 1}, {"one_in": 1, "tile_rows": 7, "pair_blocks": 1}, {"one_in": 3}):
        got = jaccard.jaccard_components(df, **kw).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == want


def test_few_sets_outside_a_large_component(spark):
    rng = random.Random(19)
    base = [f"n{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, rng, 1))) for i in range(60)]
    # two that resemble one copy alone, each by other parts of it
    rows += [(100, " ".join([*rows[7][1].split()[:105], *(f"p{i}" for i in range(9))])), (101, " ".join([*(f"r{i}" for i in range(9)), *rows[9][1].split()[15:]])), (102, " ".join(base[:60] + [f"s{i}" for i in range(60)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, tile_rows=8).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_chain_of_unlike_sets_has_few_tiles(spark, monkeypatch):
    lines = [" ".join(f"c{i}_{j}" for j in range(20)) for i in range(301)]
    rows = [(i, f"{lines[i]} {lines[i + 1]}") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 50)]
    tiles, real = [], jaccard.staged

    def staged(df, name, *more):
        out = real(df, name, *more)
        if name.endswith("-tiles"):
            tiles.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", staged)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, tile_rows=10, pair_blocks=4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)
    assert len(tiles) == 2 and tiles[0] <= 2 * len(rows) and tiles[1] <= 30 * len(rows)


def test_one_of_each(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, i, "k", None, 2.5, [i]) for i, (d, t) in enumerate(docs)], "doc_id long, text string, row int, key string, _key string, count double, keeper_key array<int>")
    kept = jaccard.one_of_each(df)
    assert kept.schema == df.schema
    wordless = [d for d, t in docs if not words(t)]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, n, c in brute_components(docs) if n} | set(wordless))
    assert {tuple(map(str, r)) for r in kept.collect()} <= {tuple(map(str, r)) for r in df.collect()}
    assert jaccard.one_of_each(df.limit(0)).isEmpty()


def sentence(rng, n):
    return " ".join(f"v{rng.randrange(3000)}" for _ in range(n)).capitalize() + "."


def test_passages(spark):
    rng = random.Random(9)
    passage = " ".join(sentence(rng, rng.randrange(5, 14)) for _ in range(8))
    clean = [(i, " ".join(sentence(rng, 11) for _ in range(9))) for i in range(40)]
    own = {i: (" ".join(sentence(rng, 9) for _ in range(4)), " ".join(sentence(rng, 9) for _ in range(4))) for i in range(100, 106)}
    planted = [(i, f"{a} and so {passage} but not {b}") for i, (a, b) in own.items()]
    others = [(200, None), (201, ""), (202, "short text"), (203, passage + " " + passage), (204, clean[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in clean + planted + others], "doc_id long, text string, start string")
    found = passages.repeated_passages(df, bucket_rows=64)
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == {*range(100, 106), 203, 0, 204}
    # of classes of paragraphs that reach over the passage's end, another document may be the keeper
    assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in rows if r["removed"]} == {100, 0}
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(df, found).collect()}
    assert len(left) == len(clean + planted + others)
    assert all(left[i] == t for i, t in [*clean, *others[:3]]) and left[100] == dict(planted)[100]
    n = len(passage.split())
    for i in range(101, 106):
        a, b = own[i]
        kept = left[i].split()
        assert set(a.split()) <= set(kept) and set(b.split()) <= set(kept)
        assert len(kept) <= len(a.split()) + len(b.split()) + 4 + n // 4
    assert left[204] == ""
    assert passages.repeated_passages(df.limit(0)).isEmpty()


def test_near_passages_are_verified(spark):
    rng = random.Random(3)
    w = [f"u{rng.randrange(9000)}" for _ in range(64)]
    near = list(w)
    near[2] = "changed"
    far = [x if i % 4 else f"z{i}" for i, x in enumerate(w)]
    text = lambda x: " ".join(x).capitalize() + "."
    df = spark.createDataFrame([(1, text(w)), (2, text(near)), (3, text(far))], "doc_id long, text string")
    got = {(r["doc_id"], r["removed"]) for r in passages.repeated_passages(df).collect()}
    assert (2, True) in got and not any(d == 3 for d, _ in got)


def parts(texts, cut=passages.windows):
    words_, at = common.word_hashes(*common.string_buffers(pa.array(texts)))
    return at, cut(words_, at, 32)


KINDS = ["lower", "stops", "one word", "few words", "greek"]


def word_of(kind, rng):
    return {"lower": lambda: f"v{rng.randrange(10**6)}", "stops": lambda: f"v{rng.randrange(10**6)}" + "." * (rng.random() < 0.1), "one word": lambda: "same", "few words": lambda: rng.choice("abc"), "greek": lambda: chr(945 + rng.randrange(24)) * rng.randrange(1, 5)}[kind]


@pytest.mark.parametrize("kind", KINDS)
def test_every_run_of_51_words_has_a_window(kind):
    rng = random.Random(11)
    word = word_of(kind, rng)
    for _ in range(60):
        shared = [word() for _ in range(51)]
        found, texts, places = [], [], []
        for n, m in ((rng.randrange(60), rng.randrange(60)), (rng.randrange(60), rng.randrange(60))):
            places.append(n)
            texts.append(" ".join([*(word() for _ in range(n)), *shared, *(word() for _ in range(m))]))
        at, (row, first, end) = parts(texts)
        for i in range(2):
            mine = row == i
            found.append({(a, b) for a, b in zip(first[mine] - at[i] - places[i], end[mine] - at[i] - places[i], strict=True) if a >= 0 and b <= 51})
            assert ((end - first)[mine] >= 32).all() and ((end - first)[mine] <= 51).all()
        assert found[0] & found[1]


@pytest.mark.parametrize("kind", KINDS)
def test_paragraphs_cover_texts(kind):
    rng = random.Random(13)
    word = word_of(kind, rng)
    sizes = [0, 1, 31, 32, 33, 64, 700, 5000]
    at, (row, first, end) = parts([" ".join(word() for _ in range(n)) for n in sizes], passages.paragraphs)
    for i, n in enumerate(sizes):
        mine = np.flatnonzero(row == i)
        assert (first[mine] - at[i]).tolist() + [n] == [0, *(end[mine] - at[i]).tolist()] if n >= 32 else not len(mine)
    assert (end - first >= 32).all() and (end - first < 288).all()


def test_bands_are_tuned():
    for recall, hashes in ((0.96, 20), (0.9, 64), (0.99, 8)):
        bands, rows = passages.tune(0.75, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - 0.75**rows) ** bands >= recall
        assert 1 - (1 - 0.75 ** (rows + 1)) ** (hashes // (rows + 1)) < recall


def test_passages_without_sentences(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    passage = own(51)
    rows = [(1, f"{own(40)} {passage} {own(35)}"), (2, f"{own(33)} {passage} {own(50)}"), (3, own(120)), (4, own(60)), (5, "ha " * 51), (6, own(20) + " ha" * 60)]
    rows.append((7, rows[3][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df)
    assert {(r["doc_id"], r["keeper_id"], r["removed"]) for r in found.collect()} == {(1, 1, False), (2, 1, True), (4, 4, False), (7, 4, True), (5, 5, False), (6, 5, True)}
    assert {r["doc_id"]: r["text"] for r in passages.without_passages(df, found).collect()}[7] == ""


def edited(w, rng, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def boilerplate_corpus(seed=21):
    """150 pairs of near copies; lines of 12 words, in turn own and of one boilerplate for all."""
    rng = random.Random(seed)
    lines = [[f"b{i}_{j}" for j in range(14)] for i in range(4)]
    rows = []
    for i in range(150):
        w = [x for line in lines for x in [*line, *(f"o{rng.randrange(10**6)}" for _ in range(8))]]
        rows += [(2 * i, w), (2 * i + 1, edited(w, rng, rng.randrange(4)))]
    return [(d, " ".join(w)) for d, w in rows]


def brute_force_classes(rows):
    """(pairs of paragraphs (doc, doc) that are alike or hold an equal window, all of them alike)."""
    texts = [t for _, t in rows]
    alike = set()
    for cut in (passages.windows, passages.paragraphs):
        at, (row, first, end) = parts(texts, cut)
        sets = [(int(r), shingle_set(" ".join(texts[r].split()[a - at[r] : b - at[r]]))) for r, a, b in zip(row, first, end, strict=True)]
        for i, (x, s) in enumerate(sets):
            for y, z in sets[:i]:
                if x != y and (s == z if cut is passages.windows else 4 * len(s & z) >= 3 * len(s | z)):
                    alike.add((rows[x][0], rows[y][0]))
    return alike


@pytest.mark.parametrize("kw", [{}, {"tile_rows": 5, "parcel_rows": 20, "bucket_rows": 64}])
def test_near_passages_against_all_pairs(spark, kw):
    rows = boilerplate_corpus()
    alike = brute_force_classes(rows)
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect():
        got.setdefault(r["doc_id"], set()).add(r["keeper_id"])
    hit = sum(bool(got.get(a, set()) & got.get(b, set())) for a, b in alike)
    assert len(alike) > 100 and hit >= 0.95 * len(alike)
    assert set(got) <= {d for pair in alike for d in pair}


def under_one_key(monkeypatch):
    """Lets all paragraphs have the same keys, as a frequent line does."""
    real = passages._key_blobs

    def blobs(bands, buckets, frequent):
        def run(batches):
            for batch in batches:
                key = [pa.array(np.full(batch.num_rows, 7 + i)) for i in range(bands)]
                yield from real(bands, buckets, frequent)(iter([pa.RecordBatch.from_arrays([batch.column(0), *key], names=batch.schema.names)]))

        return run

    monkeypatch.setattr(passages, "_key_blobs", blobs)


@pytest.mark.parametrize("kw", [{}, {"tile_rows": 16, "parcel_rows": 20}])
def test_all_paragraphs_of_a_key_are_compared(spark, monkeypatch, kw):
    under_one_key(monkeypatch)
    rng = random.Random(5)
    base = [[f"q{rng.randrange(10**6)}" for _ in range(45)] for _ in range(80)]
    rows = [*enumerate(map(" ".join, base)), *((1000 + i, " ".join([*base[i][:-2], "a", "b"])) for i in range(0, 80, 4))]
    # copies of an edited version are linked to the first version as well
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1])]
    got = {(r["doc_id"], r["keeper_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect() if r["removed"]}
    want = {(1000 + i, i) for i in range(0, 80, 4)} | {(2000, 76), (2001, 76)}
    # windows that hold the edit are in the edited version and its copies alone
    assert want <= got <= want | {(2000, 1076), (2001, 1076)}


def test_sizes_of_tiles_parcels_and_buckets_change_no_row(spark, monkeypatch):
    under_one_key(monkeypatch)
    rng = random.Random(8)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = [own(45) for _ in range(90)]
    # pairs just above the threshold, and chains of versions that differ at both ends
    pairs = [(i, w) for i, w in enumerate(base)] + [(1000 + i, w[:-5] + own(5)) for i, w in enumerate(base)]
    chain = own(56)
    chains = [(2000 + i, own(i % 4) + chain[i % 4 : 56 - i // 4] + own(i // 4)) for i in range(16)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in pairs + chains], "doc_id long, text string")
    key = lambda **kw: sorted(map(tuple, passages.repeated_passages(df, **kw).collect()))
    whole = key()
    assert {r[0] for r in whole if r[5]} >= {1000 + i for i in range(90)} | {2000 + i for i in range(1, 16)}
    assert key(tile_rows=16, parcel_rows=20, bucket_rows=64, broadcast_rows=0) == whole


def test_frequent_passages_take_their_own_way(spark, monkeypatch):
    real = passages._frequent
    monkeypatch.setattr(passages, "_frequent", lambda docs, k, least, bands: real(docs, k, least, bands, 1))
    rng = random.Random(15)
    own = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    line, base = own(60), own(70)
    rows = [(i, " ".join([*own(40), *line, *own(40)])) for i in range(30)]
    rows += [(100 + i, " ".join(edited(base, rng, 1))) for i in range(60)] + [(200, " ".join(own(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.undo()
    plain = passages.repeated_passages(df)
    monkeypatch.setattr(passages, "_frequent", lambda docs, k, least, bands: real(docs, k, least, bands, 1))
    found = passages.repeated_passages(df)
    key = lambda f: sorted((r["doc_id"], r["start"], r["end"], r["keeper_id"], r["removed"]) for r in f.collect())
    assert key(found) == key(plain)
    lost = {(d, k) for d, _, _, k, removed in key(found) if removed}
    assert {(i, 0) for i in range(1, 30)} | {(100 + i, 100) for i in range(1, 60)} <= lost and not {0, 100, 200} & {d for d, _ in lost}


def test_passages_of_odd_rows(spark):
    rng = random.Random(16)
    own = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    text = own(60)
    rows = [(None, text, 1, [3], "k"), (5, text, 2, None, None), (5, text, 2, None, None), (6, None, 3, None, "x"), (7, "", 4, None, "x"), (8, own(20000) + " " + text, 5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, spans array<int>, row string")
    found = passages.repeated_passages(df)
    assert {(r["doc_id"], r["keeper_id"], r["removed"]) for r in found.collect()} == {(None, None, False), (5, None, True), (8, None, True)}
    left = sorted(map(tuple, passages.without_passages(df, found).collect()), key=str)
    long = next(r[1] for r in left if r[0] == 8)
    assert rows[5][1].startswith(long) and 20000 <= len(long.split()) <= 20010
    want = [(None, text, 1, [3], "k"), (5, "", 2, None, None), (5, "", 2, None, None), rows[3], rows[4], (8, long, 5, None, "x")]
    assert left == sorted(want, key=str)
    assert passages.without_passages(df.limit(0), found).isEmpty()


def lm_corpus(seed=6):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, range(60, 0, -1), k=rng.randrange(0, 50)))) for i in range(60)]
    return [*docs, (90, None), (91, "  "), (92, "w " * 70000), (None, docs[7][1]), (docs[5][0], docs[5][1])], vocab


@pytest.mark.parametrize("kw", [{}, {"bucket_rows": 8}, {"one_in": 1}, {"one_in": 2, "frequent": 20, "bucket_rows": 8}])
def test_cross_entropy_against_counts(spark, kw):
    docs, _ = lm_corpus()
    target, v = set(range(0, 60, 3)), 62.0
    df = spark.createDataFrame([(d, t, 0.5, "x") for d, t in docs], "doc_id long, text string, score double, n_tokens string")
    got = lmscore.score(df, spark.createDataFrame([(t,) for t in target], "doc_id long"), types=v, **kw).collect()
    lines = [(d, ["<b>", *words(t), "<b>"]) for d, t in docs]
    want = []
    for i, (d, s) in enumerate(lines):
        row = [d, len(s) - 1]
        for own in (lambda x: x in target, lambda x: True):
            uni, bi = Counter(), Counter()
            for j, (other, line) in enumerate(lines):
                if j != i and own(other):
                    uni.update(line[1:])
                    bi.update(zip(line, line[1:], strict=False))
            n = sum(uni.values())
            p = [(uni[b] + 1) / (n + v) * (bi[a, b] + 50 / v) / (uni[a] + 50) for a, b in zip(s, s[1:], strict=False)]
            row.append(sum(-math.log(x) for x in p) / 2 / len(p))
        want.append(row)
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    for g, w in zip(sorted([[r["doc_id"], r["n_tokens"], r["ce_target"], r["ce_background"]] for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9)
    assert all(r["score"] == r["ce_target"] - r["ce_background"] for r in got)


def test_scores_without_target_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    assert lmscore.score(df.limit(0), df.select("doc_id").limit(0)).isEmpty()
    lone = lmscore.score(df, df.where("doc_id = 1").select("doc_id"), types=4.0).where("doc_id = 1").first()
    assert lone["ce_target"] == pytest.approx(math.log(4))


def test_scores_do_not_tell_membership(spark):
    rng = random.Random(8)
    good, bad = ([f"{c}{i}" for i in range(300)] for c in "gb")
    docs = [(i, " ".join(rng.choices(good if i < 200 else bad, k=60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(df, df.where("doc_id < 200 and doc_id % 2 = 0").select("doc_id")).collect()}
    used, unused = np.mean([got[i] for i in range(0, 200, 2)]), np.mean([got[i] for i in range(1, 200, 2)])
    assert abs(used - unused) < 0.1 and np.mean([got[i] for i in range(200, 400)]) > max(used, unused) + 1


def test_types_are_estimated():
    for n in (10, 3000, 200_000):
        h = common.mix64(common.mix64(np.arange(n, dtype=np.uint64)))
        ranks = np.zeros(lmscore.REGISTERS, np.int64)
        zeros = 53 - np.frexp((h & np.uint64((1 << 52) - 1)).astype(float))[1]
        np.maximum.at(ranks, (h >> np.uint64(52)).astype(np.int64), zeros)
        assert lmscore.types_of(ranks) == pytest.approx(n, rel=0.05, abs=2)
