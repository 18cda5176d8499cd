import logging
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import candidate_report, queries, settings, spectrum_update
from kmerlens.operators import enrichment

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
SMALL = settings.load("spectrum_update") | {"pooled_min": 4, "hap_min": 3}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plain(docs, least=4, hap_least=3, k=16):
    """Candidates by loops over texts."""
    comp, counts = str.maketrans("ACGT", "TGCA"), Counter()
    for d in docs:
        if d["source"] in (None, "src0"):
            continue
        region = {"fr": "HSat2", "de": "HSat3"}.get(d["lang"], "background")
        for line in (d["text"] or "").lower().split("\n"):
            seq = "".join("ACGT"[(ord(c) - 97) % 4] for c in line if "a" <= c <= "z")
            for i in range(len(seq) - k + 1):
                w = seq[i : i + k]
                counts[region, min(w, w[::-1].translate(comp)), d["source"]] += 1
    pool = {}
    for (region, kmer, _), n in counts.items():
        pool.setdefault((region, kmer), []).append(n)
    return sorted((*key, sum(ns), len(ns), max(ns)) for key, ns in pool.items() if sum(ns) >= least or max(ns) >= hap_least)


@pytest.fixture
def growing(spark, tmp_path):
    """A function that adds a file of some documents to a folder, and gives what the folder then holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").collect()
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    folder, held = tmp_path / "documents", []

    def add(lo, hi):
        new = docs[lo:hi]
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(folder))
        held.extend(new)
        return held

    add.folder = str(folder)
    return add


def test_two_runs_over_growing_input(spark, growing, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs.spectrum_update")
    out, mark = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    go = lambda: rows_of(spectrum_update.run(spark, growing.folder, out, mark, SMALL))
    first = growing(0, 40)
    assert go() == plain(first)
    assert "read 40 rows" in caplog.text
    caplog.clear()
    # nothing new: nothing is read, and every file stays as it is
    files = {f: os.stat(f).st_mtime_ns for f in (os.path.join(d, x) for d, _, xs in os.walk(out) for x in xs)}
    assert go() == plain(first)
    assert "0 new batches; candidates of no region made again" in caplog.text
    assert files == {f: os.stat(f).st_mtime_ns for f in (os.path.join(d, x) for d, _, xs in os.walk(out) for x in xs)}
    caplog.clear()
    both = growing(40, 90)
    assert go() == plain(both)
    assert "read 50 rows" in caplog.text and "1 new batches" in caplog.text
    assert sorted(x for x in os.listdir(f"{out}/deltas")) == ["batch=0", "batch=1"]
    # all at once gives the same
    assert rows_of(spectrum_update.run(spark, growing.folder, f"{tmp_path}/out2", f"{tmp_path}/checkpoint2", SMALL)) == plain(both)


def test_only_regions_with_news_are_made_again(spark, growing, tmp_path):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    growing(0, 40)
    spectrum_update.run(spark, growing.folder, out, mark, SMALL)
    before = {r: sorted(os.listdir(f"{out}/marks/region={r}")) for r in ("HSat2", "HSat3", "background")}
    extra = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumn("lang", F.lit("de")).withColumn("source", F.lit("another"))
    extra.coalesce(1).write.mode("append").parquet(growing.folder)
    spectrum_update.run(spark, growing.folder, out, mark, SMALL)
    after = {r: sorted(os.listdir(f"{out}/marks/region={r}")) for r in before}
    assert [r for r in before if before[r] != after[r]] == ["HSat3"]


def test_runs_that_end_early_are_made_good(spark, growing, tmp_path, monkeypatch):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    held = growing(0, 40)
    with monkeypatch.context() as m:
        m.setattr(spectrum_update, "refresh", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            spectrum_update.run(spark, growing.folder, out, mark, SMALL)
    assert rows_of(spectrum_update.run(spark, growing.folder, out, mark, SMALL)) == plain(held)
    # a batch that fails while its delta is written is replayed into the same folder
    held = growing(40, 90)
    with monkeypatch.context() as m:
        real = spectrum_update.pooled.by_hap
        m.setattr(spectrum_update.pooled, "by_hap", lambda c, r: real(c, r).withColumn("n", F.expr("if(n > 1, raise_error('stop'), n)").cast("long")))
        with pytest.raises(Exception, match="stop"):
            spectrum_update.run(spark, growing.folder, out, mark, SMALL)
    assert rows_of(spectrum_update.run(spark, growing.folder, out, mark, SMALL)) == plain(held)
    with pytest.raises(ValueError, match="other settings"):
        spectrum_update.run(spark, growing.folder, out, mark, SMALL | {"hap_min": 5})


def test_deltas_are_counted_once_and_without_a_sort(spark, growing, tmp_path, monkeypatch):
    """A delta has one row for each k-mer, region and hap, and regions are pooled without a shuffle of such rows."""
    plans, real = [], spectrum_update.pooled.pool_by_region
    monkeypatch.setattr(spectrum_update.pooled, "pool_by_region", lambda *a: (plans.append(real(*a)), plans[-1])[1])
    growing(0, 40)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spectrum_update.run(spark, growing.folder, f"{tmp_path}/out", f"{tmp_path}/checkpoint", SMALL)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    deltas = spark.read.parquet(f"{tmp_path}/out/deltas")
    assert deltas.groupBy("code", "region", "hap").count().where("count > 1").isEmpty()
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "HashAggregate" not in text and "bucket" in text


def test_odd_documents(spark, tmp_path):
    path, args = f"{tmp_path}/documents", (f"{tmp_path}/out", f"{tmp_path}/checkpoint", SMALL)
    text = "a" * 40
    schema = "doc_id long, text string, lang string, source string, region string, seq string"
    docs = [(1, text, "fr", "x"), (1, text, "fr", "x"), (None, text, None, "y"), (2, None, "fr", "x"), (3, "", "de", "x"), (4, text, "fr", None), (5, text, "fr", "src0"), (6, "b" * 3_000_000, "de", "z")]
    spark.createDataFrame([(*d, "clash", "clash") for d in docs], schema).write.parquet(path)
    assert rows_of(spectrum_update.run(spark, path, *args)) == [("HSat2", "A" * 16, 50, 1, 50), ("HSat3", "C" * 16, 2_999_985, 1, 2_999_985), ("background", "A" * 16, 25, 1, 25)]
    # no rows, and a folder of none
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    assert len(rows_of(spectrum_update.run(spark, path, *args))) == 3
    spark.createDataFrame([], schema).write.parquet(f"{path}-none")
    assert rows_of(spectrum_update.run(spark, f"{path}-none", f"{tmp_path}/o", f"{tmp_path}/c", SMALL)) == []


def test_report_is_the_same_each_time(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs.candidate_report")
    run = lambda at: rows_of(candidate_report.run(spark, f"{SF}/lineitem.parquet", f"{tmp_path}/{at}"))
    first = run("a")
    assert len(first) > 50 and "reading 6000 occurrences" in caplog.text and f"wrote {len(first)} rows" in caplog.text
    assert run("a") == first == run("b")
    assert {d for d in os.listdir(f"{tmp_path}/a/selected") if "=" in d} <= {f"selection_reason={x}" for x in ("pooled", "hap", "pooled_and_hap")}
    brief = {r["selection_reason"]: r for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/a/summary").collect()}
    assert sum(int(r["kmers"]) for r in brief.values()) == len(first)
    # fewer occurrences leave nothing of the run before
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_partkey < 20").write.parquet(f"{tmp_path}/few")
    few = rows_of(candidate_report.run(spark, f"{tmp_path}/few", f"{tmp_path}/a"))
    assert 0 < len(few) < len(first) and {r[0] for r in few} <= set(range(20))
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/none")
    assert rows_of(candidate_report.run(spark, f"{tmp_path}/none", f"{tmp_path}/a")) == []


def test_report_equals_the_operators(spark, tmp_path):
    """Selected k-mers of a tidy table of haps as texts, with other column names and targets."""
    rows = [("k1", "h1", "c1", "T", 5, 50), ("k1", "h2", "c2", "T", 5, 50), ("k1", "h1", "c1", "B", 1, 90), ("k1", "h2", "c1", "B", 0, 90), ("k2", "h1", "c1", "B", 9, 0), ("k1", "ref", "c9", "T", 99, 9), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "k string, s string, ch string, r string, x long, v long").write.parquet(f"{tmp_path}/in")
    chosen = {"pooled_min": 3, "hap_min": 5, "threshold": 0.5, "reference": "ref", "targets": ["T"], "columns": {"code": "k", "hap": "s", "chrom": "ch", "region": "CASE r WHEN 'B' THEN 'background' ELSE r END", "n": "x", "valid_starts": "v"}}
    (row,) = candidate_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", chosen).collect()
    counts = spark.createDataFrame([("k1", "T", 10), ("k1", "background", 1)], "code string, region string, n long").withColumn("hap", F.lit("x"))
    den = spark.createDataFrame([("T", 100), ("background", 180)], "region string, valid_starts long").withColumn("hap", F.lit("x"))
    e = enrichment.target_background(counts, ("T",)).join(enrichment.denominators(den, ("T",)), "hap").first()
    assert (row["code"], row["t"], row["b"]) == ("k1", e["t"], e["b"]) and row["selection_reason"] == "pooled_and_hap"
    assert (row["chrom"], row["chrom_share"], row["chrom_tied"]) == ("c1", 0.5, True)


def test_settings_files(tmp_path):
    own = tmp_path / "own.toml"
    own.write_text('k = 12\n[sequences]\nhap = "lang"\n')
    made = settings.load("spectrum_update", str(own))
    assert made["k"] == 12 and made["sequences"]["hap"] == "lang" and made["hap_min"] == 10 and "seq" in made["sequences"]
    own.write_text('depth = 1\n[sequences]\nhop = "lang"\n')
    with pytest.raises(ValueError, match="depth, sequences.hop"):
        settings.load("spectrum_update", str(own))


@pytest.mark.parametrize(("job", "table", "more"), [("spectrum_update", "documents", ["--checkpoint", "{}/mark"]), ("candidate_report", "lineitem", [])])
def test_command_lines(spark, tmp_path, job, table, more):
    own = tmp_path / "own.toml"
    own.write_text("pooled_min = 30\n")
    flag = {"documents": "--documents", "lineitem": "--occurrences"}[table]
    args = [flag, f"{SF}/{table}.parquet", "--out", f"{tmp_path}/out", "--settings", str(own), *(m.format(tmp_path) for m in more)]
    done = subprocess.run([sys.executable, f"{HERE}/jobs/{job}.py", *args], capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stderr and spark.read.parquet(f"{tmp_path}/out/{'candidates' if table == 'documents' else 'selected'}").count() > 0


def test_job_queries_restore_settings(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name, plan in queries.QUERIES.items():
        assert plan(spark, SF).count() > 0, name
    after = {r.key: r.value for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}
