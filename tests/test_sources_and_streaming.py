import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlens import cli
from kmerlens.functions import kmer as K
from kmerlens.functions import measures as M
from kmerlens.functions import tables
from kmerlens.operators import audit, counting, mismatch
from kmerlens.plans import source_queries
from kmerlens.schema import COUNTS
from kmerlens.settings import Settings
from kmerlens.sources import eligibility, files
from kmerlens.streaming import pooled


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa.gz"
    with gzip.open(path, "wb") as f:
        f.write(b">chr1 some text\r\nACGT\r\nacgt\r\n>chr2\nGG\n\n>empty\n")
    got = {r["name"]: r["seq"] for r in files.read_fasta(spark, str(path)).collect()}
    assert got == {"chr1": "ACGTacgt", "chr2": "GG", "empty": ""}
    out = str(tmp_path / "out")
    files.write_fasta(spark.createDataFrame([("n", "A" * 165)], "name string, seq string"), out)
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert [len(x) for x in lines] == [2, 80, 80, 5]
    assert {r["name"]: r["seq"] for r in files.read_fasta(spark, out).collect()} == {"n": "A" * 165}


def test_bed_fai_list_logs(spark, tmp_path):
    (tmp_path / "h1.bed").write_text("# head\nchr1\t1\t5\tHSat2\t0\t+\nchr1\tx\t5\tHSat2\t0\t+\nchr1 7 9 HSat3\n")
    got = files.named(files.read_bed(spark, str(tmp_path / "h1.bed")), r"/(\w+)\.bed$", "hap").orderBy("bad", "start").collect()
    assert [(r["hap"], r["start"], r["bad"]) for r in got] == [("h1", 1, False), ("h1", None, True), ("h1", 7, True)]
    (tmp_path / "a.fai").write_text("chr1\t50\t6\t60\t61\n")
    assert [tuple(r)[1:] for r in files.read_fai(spark, str(tmp_path / "a.fai")).collect()] == [("chr1", 50)]
    (tmp_path / "pass.txt").write_text("#x\nchr1 yes\n\nchr2\n")
    assert sorted(r["item"] for r in files.read_list(spark, str(tmp_path / "pass.txt")).collect()) == ["chr1", "chr2"]
    for name, text in (("ok", "printed output\nrunning time 3"), ("bad", "printed output running time ERROR x"), ("cut", "printed output")):
        (tmp_path / f"{name}.log").write_text(text)
    got = files.completed_logs(spark, str(tmp_path / "*.log"), ("printed output", "running time"))
    assert {r["path"].rsplit("/", 1)[1]: r["complete"] for r in got.collect()} == {"ok.log": True, "bad.log": False, "cut.log": False}


def test_gathered_logs_are_as_logs_of_own_files(spark, tmp_path):
    texts = {"ok": "printed output\r\n\n\trunning time 3 \"x\" \u2028 \\n", "bad": "printed output running time\nERROR x", "cut": "printed output", "long": "printed output\n" + "x" * 25_000_000 + " ERRORS\nrunning time"}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    own = files.completed_logs(spark, str(tmp_path / "*.log"), ("printed output", "running time"))
    files.gather_logs(spark.createDataFrame([(f"{k}.log", v) for k, v in texts.items()], "path string, value string").coalesce(1), str(tmp_path / "gathered"))
    got = files.completed_gathered_logs(spark, str(tmp_path / "gathered"), ("printed output", "running time"))
    want = {"ok.log": True, "bad.log": False, "cut.log": False, "long.log": True}
    assert {r["path"]: r["complete"] for r in got.collect()} == want == {r["path"].rsplit("/", 1)[1]: r["complete"] for r in own.collect()}


def test_logs_of_many_haps_are_few_files(spark, tmp_path, monkeypatch):
    spark.range(500).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(source_queries, "_path", lambda _, name: str(tmp_path / name))
    got = {r["hap"]: r["complete"] for r in source_queries.log_completion(spark, str(tmp_path)).collect()}
    assert got == {h: h % 4 != 1 and h % 6 != 0 for h in range(500)}
    assert 1 <= len(list((tmp_path / "logs").rglob("part-*"))) <= 8


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 0.5, "y")], "id long, v double, extra string")
    path = str(tmp_path / "t")
    files.write_tsv(df, path, ["id", "v"], "gzip")
    back = files.read_tsv(spark, path, T.StructType.fromDDL("id long, v double")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, None), (2, 0.5)]
    assert files.fingerprint(spark, [path]).where(F.length("sha256") == 64).count() >= 1


def test_eligibility(spark):
    haps = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "hap string, complete boolean")
    passed = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1)], "hap string, chromosome long")
    lengths = spark.createDataFrame([(h, 1, 10) for h in "abcd"], "hap string, chromosome long, length long")
    ann = spark.createDataFrame([("a", 1, 0, 10), ("c", 1, 5, 11), ("c", 1, 3, 3), ("b", 2, 0, 1)], "hap string, chromosome long, start long, end long")
    good, bad = eligibility.split_annotation(ann, lengths)
    assert good.count() == 1 and bad.count() == 3
    got = eligibility.eligibility(haps, passed, lengths, bad)
    assert {r["hap"]: r["reason"] for r in got.collect()} == {"a": "PASS", "b": "EXCLUDE_invalid_coordinate", "c": "EXCLUDE_invalid_coordinate", "d": "EXCLUDE_incomplete_input"}
    only = eligibility.eligibility(haps, passed, lengths, bad.limit(0))
    assert {r["hap"]: r["reason"] for r in only.collect()}["b"] == "EXCLUDE_missing_chromosome"
    st = eligibility.chromosome_status(got, passed, lengths).where("hap = 'b'").collect()
    assert {(r["chromosome"], r["present"]) for r in st} == {(1, 1), (2, 0)}


def test_stream_equals_batch(spark, tmp_path):
    shards, out, mark = (str(tmp_path / x) for x in ("shards", "out", "mark"))
    rows = [(f"h{i}", "1", "HSat2", 0, c, i + c) for i in range(5) for c in range(3)]
    for i in range(5):
        spark.createDataFrame([r for r in rows if r[0] == f"h{i}"], COUNTS).coalesce(1).write.mode("append").parquet(shards)
        if i in (1, 4):
            pooled.maintain(spark, shards, out, mark, "h0").awaitTermination()
    got = {r["code"]: (r["pooled"], r["haps"], r["largest"]) for r in pooled.pooled(spark, out).collect()}
    assert got == {c: (sum(i + c for i in range(1, 5)), 4, 4 + c) for c in range(3)}




def fasta_text(rng, records):
    out = []
    for name, n in records:
        seq = "".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(n))
        out.append(f">{name} made up\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, n, 60)))
    return "".join(out)


def test_fasta_pieces_have_every_window_once(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "a.fa").write_text(fasta_text(rng, [("one", 5000), ("empty", 0), ("two", 9), ("three", 700), ("four", 16)]))
    (tmp_path / "b.fa").write_text(fasta_text(rng, [("one", 2500)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(tuple, counting.spectrum(files.read_fasta(spark, str(tmp_path)).select("path", "name", "seq")).collect()))
    for block in ("256b", "1000b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        for size in (40, 100_000):
            got = counting.spectrum(files.fasta_pieces(spark, str(tmp_path), size=size)).collect()
            assert sorted(map(tuple, got)) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_long_rows_are_walked_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGTN\n" if rng.random() < 0.05 else "ACGT") for _ in range(n))) for i, n in enumerate([700, 0, 15, 16, 90, 2100, 31])] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, seq string")
    want = {}
    for i, s in rows:
        for at in range(len(s or "") - 15):
            w = s[at : at + 16]
            if not set(w) - set("ACGT"):
                want[i, at] = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
    code = {(i, at): int(w.translate(str.maketrans("ACGT", "0123")), 4) for (i, at), w in want.items()}
    for segment in (64, 500, 1 << 20):
        # the workers get the bound with the closure's module globals
        monkeypatch.setattr(counting, "SEGMENT", segment)
        got = {(r["id"], r["start"]): r["code"] for r in counting.windows(df, positions=True).collect()}
        assert got == code
        sums = counting.spectrum(df, keys=["id"]).agg(F.sum("n")).first()[0]
        assert sums == len(code)


def test_records_of_regions_and_seeds(spark):
    seqs = spark.createDataFrame([("h1", "chr1", "ACGT" * 50), ("h2", "chr1", "TTTT")], "hap string, chromosome string, seq string")
    parts = spark.createDataFrame([("h1", "chr1", 2, 165), ("h2", "chr1", 0, 1)], "hap string, chromosome string, start long, end long")
    rows = files.region_records(seqs, parts, "HSat2")
    text = {r["value"] for r in files.fasta_lines(rows).collect()}
    body = ("ACGT" * 50)[2:165]
    assert text == {f">h1|chr1:2-165|HSat2|strand=+\n{body[:80]}\n{body[80:160]}\n{body[160:]}", ">h2|chr1:0-1|HSat2|strand=+\nT"}
    codes = spark.createDataFrame([(0, int("0123" * 4, 4)), (1, 5)], "place long, code long")
    assert {tuple(r) for r in files.seed_records(codes).collect()} == {("0_F", "ACGT" * 4), ("1_F", "A" * 14 + "CC"), ("1_R", "GG" + "T" * 14)}
    plots = spark.createDataFrame([("Two", "02.png"), ("One", "01.png")], "title string, file string")
    assert [r[0] for r in files.plot_index(plots).collect()] == ["- [One](01.png)", "- [Two](02.png)"]


def test_fingerprints_tell_changes(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(files.fingerprint(spark, [str(tmp_path)]).collect())
    (tmp_path / "b").write_text("changed")
    (tmp_path / "c").unlink()
    now = files.fingerprint(spark, [str(tmp_path)])
    assert {r[0].rsplit("/", 1)[1] for r in audit.inputs_changed(before, now).collect()} == {"b", "c"}
    assert audit.inputs_changed(before, before).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    code = int("0001" * 4, 4)
    spark.createDataFrame([("h1", code, 3), ("h2", code, 4), ("h3", 7, 1)], "hap string, code long, n long").write.parquet(f"file://{tmp_path}/c")
    at = f"file://{tmp_path}/c"
    assert cli.main(["--counts", at, "--kmer", "GTTT" * 4], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["hap\tn\tkmer", "h1\t3\t" + "AAAC" * 4, "h2\t4\t" + "AAAC" * 4]
    assert cli.main(["--counts", at, "--kmer", "aaac" * 4, "--hap", "h2"], spark) == 0 and capsys.readouterr().out.count("\n") == 2
    assert cli.main(["--counts", at, "--hap", "h3", "--pilot", "2"], spark) == 0 and capsys.readouterr().out.count("\n") == 1
    assert cli.main(["--counts", at, "--kmer", "C" * 16], spark) == 2 and cli.main(["--counts", at, "--kmer", "ACGN"], spark) == 2 and cli.main(["--counts", at, "--hap", "h9"], spark) == 2


def test_shards_summaries_and_extracts(spark, tmp_path):
    at = f"file://{tmp_path}/shards"
    files.write_counts(spark.createDataFrame([(1, 5, 2), (2, 5, 3)], "hap int, code long, n long"), at)
    files.write_counts(spark.createDataFrame([(2, 6, 9)], "hap int, code long, n long"), at)
    assert {tuple(r) for r in spark.read.parquet(at).select("hap", "code", "n").collect()} == {(1, 5, 2), (2, 6, 9)}
    files.write_summary(spark, {"b": 1, "a": [2]}, f"file://{tmp_path}/s")
    assert spark.read.text(f"file://{tmp_path}/s").first()[0] == '{"a": [2], "b": 1}'
    seqs = spark.createDataFrame([("x", "ACGTACGT")], "chromosome string, seq string")
    parts = spark.createDataFrame([("x", 2, 5)], "chromosome string, start int, end int")
    assert counting.extract(seqs, parts, ["chromosome"]).first()["seq"] == "GTA"


def test_table_functions(spark):
    tables.register(spark)
    got = [tuple(r) for r in spark.sql("SELECT * FROM kmers('acgtnTTTT', 4)").collect()]
    assert got == [(0, "ACGT", "+"), (5, "AAAA", "-")]
    near = {r["kmer"]: r["d"] for r in spark.sql("SELECT * FROM neighbors('ACGTTGCAATGCCGTA', 2)").collect()}
    code = int("ACGTTGCAATGCCGTA".translate(str.maketrans("ACGT", "0123")), 4)
    want = mismatch.neighbours(spark.createDataFrame([(code,)], "code long")).select(K.decode(F.col("variant")).alias("kmer"), "d").collect()
    assert near == {r["kmer"]: r["d"] for r in want}


def test_settings_file_and_markers(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# run\nk: 15\nenrichment: 2.5  # low\n\n")
    assert Settings.read(str(tmp_path / "s.yaml")) == Settings(k=15, enrichment=2.5)
    for text in ("k 15\n", "k: 1\nk: 2\n", "other: 1\n"):
        (tmp_path / "s.yaml").write_text(text)
        with pytest.raises(ValueError):
            Settings.read(str(tmp_path / "s.yaml"))
    for name, rows in (("pan_HSat2.tsv", "HSat2\t1\nHSat3\tNA\n"), ("chr1.tsv", "HSat2\t3\n")):
        (tmp_path / name).write_text("family\tx\n" + rows)
    schema = T.StructType([T.StructField("family", T.StringType()), T.StructField("x", T.LongType())])
    got = files.read_marker_tables(spark, f"{tmp_path}/*.tsv", schema, "HSat2").collect()
    assert {(r["source"], r["x"]) for r in got} == {("pan_HSat2", 1), ("chr1", 3)} and files.read_marker_tables(spark, f"{tmp_path}/*.tsv", schema).count() == 3


def test_lenient_numbers_and_identifiers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("a-b_c.1",), ("-a",), ("a b",)], "t string")
    assert [r[0] for r in df.select(M.lenient_double(F.col("t"))).collect()] == [1.5, None, None, None, None, None]
    assert [r[0] for r in df.select(M.valid_identifier(F.col("t"))).collect()] == [True, True, None, True, False, False]
