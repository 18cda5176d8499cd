import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlens.llm import chat, kdcodes

MESSAGE = "conv_id long, turn long, role string, parts " + f"array<{chat.PART}>"


def part(type=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (type, text, ref, width, height, seconds, pages)


def texts(*rows):
    return [(c, t, r, [part("text", x)]) for c, t, r, x in rows]


def formatted(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, MESSAGE))
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"))
    return {r["conv_id"]: r for r in read.collect()}


def test_control_strings_come_back(spark):
    marks = chat.Template().controls
    rng = random.Random(7)
    bits = [*marks, "\\", "\\\\", "<", "[", "<\\/s>", "[\\\\INST]", "\n", "s>", "é", "🙂", " ", "\\0", "\\1", "user", "</s>\n<s>assistant\n"]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "a\nb", "\\", "</s>", ""]), "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(120) for t in range(4)]
    found = formatted(spark, texts(*rows))
    for i in range(120):
        own = [r for r in rows if r[0] == i]
        r = found[i]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, _, role, text in own]
        assert r["learned"] == "".join(text for _, _, role, text in own if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        # only the marks of turns are left
        assert r["formatted"].count("</s>") == r["formatted"].count("<s>") == 4
        assert not any(m in r["formatted"] for m in marks[2:])


def test_text_without_control_strings_is_left_alone(spark):
    text = "a < b, [x] </ s> \\ [INST"
    assert formatted(spark, texts((1, 0, "user", text)))[1]["formatted"] == f"<s>user\n{text}</s>\n"


def test_parts_and_attachments(spark):
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=33, height=16), part("text", " and "), part("audio", ref="b.wav", seconds=2.1), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", "first"), part("image", ref="d.png"), part("text", " [IMG]")]),
        (1, 2, "user", [part("video", ref="e.mp4"), part(), None]),
    ]
    r = formatted(spark, rows)[1]
    assert r["formatted"] == "<s>user\nsee [IMG] and [AUDIO][DOC]</s>\n<s>assistant\nfirst[IMG] [\\IMG]</s>\n<s>user\n[FILE][FILE][FILE]</s>\n"
    assert [tuple(a) for a in r["attachments"]] == [
        (0, 0, "image", "a.png", 3),
        (1, 0, "audio", "b.wav", 27),
        (2, 0, "document", "c.pdf", 768),
        (3, 1, "image", "d.png", 0),
        (4, 2, "video", "e.mp4", 0),
        (5, 2, None, None, 0),
        (6, 2, None, None, 0),
    ]
    assert r["expanded_tokens"] == 798 and r["learned"] == "first [IMG]"


def test_odd_messages(spark):
    long = "word </s> " * 200_000
    rows = texts((None, 0, "user", "a"), (None, None, None, None), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "b"), (3, 0, "assistant", long), (4, 0, "assistant", "")) + [(5, 0, "user", None), (5, 1, "user", [])]
    found = formatted(spark, rows)
    assert found[None]["n_turns"] == 2 and found[None]["formatted"] == "<s>\n</s>\n<s>user\na</s>\n"
    assert found[2]["formatted"] == "<s>assistant\nb</s>\n<s>user\nsame</s>\n<s>user\nsame</s>\n"
    assert found[3]["learned"] == long
    assert found[4]["learned"] == "" and found[5]["n_turns"] == 2
    assert chat.format_chats(spark.createDataFrame([], MESSAGE)).count() == 0
    extra = spark.createDataFrame(texts((1, 0, "user", "x")), MESSAGE).withColumns({n: F.lit(1) for n in ("turns", "all", "row", "segments", "text")})
    assert chat.format_chats(extra).first()["formatted"] == "<s>user\nx</s>\n"


def test_long_conversation_is_linear(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_parts(F.concat(F.lit("[INST] "), F.col("id").cast("string"))).alias("parts"))
    out = chat.format_chats(rows).select("n_turns", F.length(chat.learned_text(F.col("segments"))).alias("n"), F.size(chat.read_turns(F.col("formatted"))).alias("read")).first()
    assert out["n_turns"] == out["read"] == 30_000
    assert out["n"] == sum(len(f"[INST] {i}") for i in range(1, 30_000, 2))


def test_marks_that_cant_be_escaped():
    with pytest.raises(ValueError, match="escaped"):
        chat.Template(end="a[b")


def test_chat_query_runs_no_python(spark):
    plan = chat.op11_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# ------------------------------------------------------------------ vector codes


def plain(rows, parts=16, entries=64, rounds=2):
    """The rows that compress gives, by loops over whole numbers."""
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = -(-len(kept[0][2]) // parts)
    cut = [[tuple((v + [0] * parts)[p * w : p * w + w]) if p * w + w <= len(v) else tuple((v[p * w :] + [0] * w)[:w]) for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            for i, xs in members.items():
                books[p][i] = tuple(sum(col) // len(xs) for col in zip(*xs, strict=True))
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, e in out:
        totals[label] = totals.get(label, 0) + e
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(((i, code, e, totals[label]) for i, label, code, e in out), key=key), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTOR = "vec_id long, label int, embedding array<float>"


def compressed(spark, rows, **kw):
    out, books = kdcodes.compress(spark.createDataFrame(rows, VECTOR), "vec_id", "embedding", "label", **kw)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=key), kdcodes.codebooks_digest(books)


@pytest.mark.parametrize(("n", "dims", "parts", "scale"), [(300, 64, 16, 1.0), (200, 8, 4, 0.02), (40, 6, 4, 1.0), (150, 10, 2, 0.01)])
def test_codes_equal_plain_loops(spark, n, dims, parts, scale):
    rng = np.random.default_rng(n)
    rows = [(int(i), int(rng.integers(3)) if i % 5 else None, [float(np.float32(x)) for x in rng.normal(0, scale, dims)]) for i in rng.permutation(n)]
    assert compressed(spark, rows, parts=parts) == plain(rows, parts)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.05, 16)]
    same = v()
    good = [(i % 50, i % 3 or None, same if i % 2 else v()) for i in range(150)] + [(None, None, v()), (None, 1, same)]
    bad = [(500, 1, None), (-5, 1, [float("nan")] * 16), (-6, 1, [float("inf")] + [0.0] * 15), (-7, 2, [None] + [0.0] * 15), (-8, 1, [0.5] * 4), (-9, 1, [])]
    rows = good + bad
    rng.shuffle(rows := [tuple(r) for r in rows])
    assert compressed(spark, [(None if r[0] is None else int(r[0]), None if r[1] is None else int(r[1]), r[2]) for r in rows]) == plain(good)
    out, books = kdcodes.compress(spark.createDataFrame(bad[:4], VECTOR), "vec_id", "embedding", "label")
    assert books == [] and out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error"]
    extra = spark.createDataFrame(good[:9], VECTOR).withColumns({n: F.lit("x") for n in ("id", "vec", "of", "code", "error", "n")})
    assert kdcodes.compress(extra, "vec_id", "embedding", "label")[0].count() == 9
    with pytest.raises(Exception, match="reaches"):
        kdcodes.compress(spark.createDataFrame([(1, 1, [1e9] * 16)], VECTOR), "vec_id", "embedding", "label")[0].collect()


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_first_of_nearest(seed):
    rng = np.random.default_rng(seed)
    spread = [1, 2, 5, 40, 300, 10**7][seed]
    points = rng.integers(-spread, spread + 1, (64, 1 + seed % 4))
    x = np.concatenate([rng.integers(-spread - 2, spread + 3, (500, points.shape[1])), points])
    index, d = kdcodes.Tree(points, leaf=1 + seed).nearest(x)
    every = ((x[:, None] - points) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (d == every.min(1)).all()


def test_decoded_codes_give_the_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(np.float32(x)) for x in rng.normal(0, 0.1, 64)]) for i in range(100)]
    out, books = kdcodes.compress(spark.createDataFrame(rows, VECTOR), "vec_id", "embedding", "label")
    back = {r["vec_id"]: r for r in out.select("vec_id", "error", kdcodes.decode(F.col("code"), books).alias("v")).collect()}
    for i, _, v in rows:
        whole = np.floor(256 * np.array(v)).astype(int)
        assert ((whole - np.array(back[i]["v"])) ** 2).sum() == back[i]["error"]


def test_types(spark):
    assert kdcodes.op12_vector_codes(spark, "/root/testdata/sf0.001").schema["error"].dataType == T.LongType()
