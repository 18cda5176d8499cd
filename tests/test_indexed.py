import random

import pytest

from kmerlens.sources import indexed


def bases(rng, n):
    return "".join(rng.choices("ACGTacgtN", k=n))


def fasta(path, records, width, end="\n", last=True):
    text = "".join(f">{name} about it{end}" + "".join(seq[i : i + width] + end for i in range(0, len(seq), width)) for name, seq in records)
    path.write_text(text if last else text.removesuffix(end), newline="")


@pytest.mark.parametrize(("width", "end", "last", "block"), [(60, "\n", True, 8 << 20), (7, "\r\n", True, 50), (10, "\n", False, 13), (1, "\n", True, 5), (10**6, "\n", False, 100)])
def test_index_and_parts(spark, tmp_path, width, end, last, block):
    rng = random.Random(width)
    sizes = [0, 1, width - 1, width, width + 1, 3 * width, 200] if width < 100 else [0, 1, 59, 60, 500]
    records = {f"r{i}": bases(rng, max(0, n)) for i, n in enumerate(sizes)} | {f"t{i}": bases(rng, n) for i, n in enumerate((90, 2 * width if width < 100 else 7))}
    fasta(tmp_path / "a.fa", [(n, s) for n, s in records.items() if n[0] == "r"], width, end, last)
    fasta(tmp_path / "b.fa", [(n, s) for n, s in records.items() if n[0] == "t"], width, end, last)
    index = indexed.index_fasta(spark, str(tmp_path / "*.fa"), block)
    assert {r["name"]: r["length"] for r in index.collect()} == {n: len(s) for n, s in records.items()}
    asked = [(n, a, b, i) for i, (n, s) in enumerate(records.items()) for a, b in ((0, len(s)), (len(s) // 3, len(s) // 2), (max(0, len(s) - 3), len(s)))]
    rows = spark.createDataFrame([*asked, ("absent", 0, 5, 0)], "name string, start long, end long, id long")
    got = indexed.fetch(rows, index, k=4, piece=30).collect()
    parts = {}
    for r in sorted(got, key=lambda r: r["at"]):
        key = (r["name"], r["start"], r["end"], r["id"])
        assert r["seq"] == records[r["name"]][r["at"] : min(r["end"], r["at"] + 33)]
        parts.setdefault(key, []).append(r["seq"])
    for (n, a, b, _), seqs in parts.items():
        found = sorted(s[i : i + 4] for s in seqs for i in range(len(s) - 3))
        assert found == sorted(records[n][i : i + 4] for i in range(a, b - 3))
    assert set(parts) == {x for x in asked if x[1] < x[2]}


def test_only_the_bytes_asked_for_are_read(spark, tmp_path):
    rng = random.Random(1)
    unit = bases(rng, 60_000)
    seq = unit * 500  # 30 million bases
    fasta(tmp_path / "long.fa", [("chr1", seq)], 60)
    (tmp_path / "long.fa.fai").write_text(f"chr1\t{len(seq)}\t15\t60\t61\n")
    index = indexed.read_index(spark, str(tmp_path / "long.fa.fai"))
    assert [tuple(r)[1:] for r in index.collect()] == [tuple(r)[1:] for r in indexed.index_fasta(spark, str(tmp_path / "long.fa"), 1 << 20).collect()]
    rows = spark.createDataFrame([("chr1", 12_345_678, 13_345_678), ("chr1", 29_999_990, 30_000_000)], "name string, start long, end long")
    got = indexed.fetch(rows, index, k=16, piece=1 << 17).collect()
    assert sum(r["bytes"] for r in got) < 1_000_010 * 61 / 60 + 8 * 20
    assert all(r["seq"] == seq[r["at"] : min(r["end"], r["at"] + (1 << 17) + 15)] for r in got) and len(got) == 9


def test_errors(spark, tmp_path):
    (tmp_path / "odd.fa").write_text(">a\nACGT\nAC\nACGT\nACGT\n")
    index = indexed.index_fasta(spark, str(tmp_path / "odd.fa"))
    ask = lambda a, b: indexed.fetch(spark.createDataFrame([("a", a, b)], "name string, start long, end long"), index).collect()
    with pytest.raises(Exception, match="unequal width"):
        ask(0, 12)
    for a, b in ((0, 99), (-1, 3)):
        with pytest.raises(Exception, match="outside its record"):
            ask(a, b)
