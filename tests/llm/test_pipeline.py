import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kmerlens.llm import common
from kmerlens.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, n = docs.columns, None, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        if name != "mixing sources to target weights":
            own = [r[0] for r in docs.select("doc_id").collect()]
            assert len(own) == len(set(own)) <= n and (ids is None or set(own) <= ids), name
            ids = set(own)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


ODD = "key string, row int, score double, predicted int, copies long, words int, spans array<int>, _size long, _n int, _copies int, _spans string, _doc int, bucket int, keeper_key string"


def odd_documents(spark):
    rng = random.Random(31)
    own = lambda n: " ".join(f"y{rng.randrange(10**6)}" for _ in range(n))
    texts = [own(80) for _ in range(30)] + [None, "", "  ", "few words", own(150_000)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, own(50), None, "s", 9), (100, rows[5][1], "en", "s", None), (101, f"{own(60)} {rows[6][1]}", "en", "t", 5)]
    extra = [(None if i % 5 == 0 else f"k{i}", i, i / 2, 7, i, i, [i], i, i, i, "s", i, i, None) for i in range(len(rows))]
    return spark.createDataFrame([(*r, *e) for r, e in zip(rows, extra, strict=True)], f"doc_id long, text string, lang string, source string, n_chars long, {ODD}")


def test_stages_keep_odd_rows_and_columns(spark):
    docs = odd_documents(spark)
    names = [f.name for f in docs.schema if f.name not in ("text", "n_chars")]
    before, sizes = {str(tuple(r[n] for n in names)) for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = common.staged(docs, "stage")
        rows = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 5 + ODD.count(",") + 1, name
        assert {str(tuple(r[n] for n in names)) for r in rows} <= before, name
        sizes.append(len(rows))
    # 40 rows; two repeated rows and a copy go, passages are cut, rows without words are not mixed
    assert sizes[0] == 40 and sizes[1] == 37 and sizes[2] == 37 and sizes[3] > 30
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed.length.sum() > 150_000 and packed.groupby("sequence_id").length.sum().max() <= 1024


def runs(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_run_against_plain_python(spark, tmp_path):
    """Toxic documents, near copies, repeated passages, mixing and packing, each by its plain rule."""
    rng = random.Random(41)
    own = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    line = own(70)
    docs = [(i, own(rng.randrange(20, 200)), f"s{i % 3}") for i in range(120)]
    docs = [(i, t + " vile foul rank" * 2 if i % 6 == 0 else t, s) for i, t, s in docs]
    docs += [(200 + i, t + " end", "s0") for i, t, _ in docs[1:30:7]] + [(300 + i, f"{own(40)} {line} {own(40)}", "s1") for i in range(8)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = df, {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.staged(stage(spark, at, str(tmp_path)), "plain")
        kept[name] = at.collect()
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    toxic = {i for i in range(0, 120, 6)}
    assert len(toxic & set(clean)) <= 1 and len(set(range(120)) - toxic - set(clean)) <= 1 and {200 + i for i in range(1, 30, 7) if i % 6} <= set(clean)
    # one document of each component, as all pairs tell
    ids, sets = sorted(clean), {i: runs(t, 5) for i, t in clean.items()}
    first = {i: min(j for j in ids if j == i or 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in ids}
    single = {r["doc_id"]: r["text"] for r in kept["n-gram Jaccard join"]}
    assert set(single) == {i for i in ids if first[i] == i} and all(single[i] == clean[i] for i in single)
    # no run of 51 words stands in two documents any more, and texts that share none are as they were
    cut = {r["doc_id"]: r["text"] for r in kept["substring dedup"]}
    seen = [runs(t, 51) for t in cut.values()]
    assert set(cut) == set(single) and sum(map(len, seen)) == len(set().union(*seen)) and cut[300] == single[300]
    shared = {i for i in single for j in single if i != j and runs(single[i], 32) & runs(single[j], 32)}
    assert all(cut[i] == single[i] for i in single if i not in shared) and shared == set(range(300, 308))
    # each source near its target, nobody above twice its size
    sizes = {i: len(words(t)) for i, t in cut.items()}
    source = {r["doc_id"]: r["source"] for r in kept["substring dedup"]}
    copies = {i: sum(r["doc_id"] == i for r in kept["mixing sources to target weights"]) for i in cut}
    assert max(copies.values()) <= 2
    total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in ("s0", "s1", "s2")}
    weight, target, free = {"s0": 3, "s1": 1, "s2": 2}, {}, {"s0", "s1", "s2"}
    while True:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in target:
        assert abs(sum(sizes[i] * copies[i] for i in cut if source[i] == s) - target[s]) <= max(sizes[i] for i in cut if source[i] == s) / 2 + 1
    # all tokens of all copies, in sequences without gaps
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(hf.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    pieces = kept["best-fit packing"]
    for i, n in copies.items():
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == n * tokens[i]
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:j]) for j in range(len(v))] and sum(n for _, n in v) <= 1024 for v in by.values())


def test_stages_on_no_rows(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).isEmpty(), name


def test_queries_are_listed():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 13)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()[list(got.columns)]
    text = lambda df: sorted(tuple("" if str(v) in ("nan", "<NA>", "None") else str(v).removesuffix(".0") for v in r) for r in df.itertuples(index=False))
    assert text(got) == text(want)
