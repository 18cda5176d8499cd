"""Lookups in a store by ranges of codes read few row groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kmerlens.sources import store

ROWS = 400_000


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "counts")
    # even codes; one holds a third of the rows
    code = F.when(F.col("id") % 3 == 0, 200_000).otherwise(2 * F.floor(F.col("id") / 2))
    rows = spark.range(ROWS).select(code.alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("hap"), (F.col("id") % 7).alias("n"))
    store.write_store(rows, path, files=4, group_bytes=256 << 10)
    return path


def _read(df):
    """(result, rows that the scan gave) of a plan without a shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = plan.execute().count()
    return rows, plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_few_row_groups_are_read(spark, kept):
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{kept}/*.parquet")]
    assert len(groups) == 4 and sum(groups) > 20
    table = store.read_store(spark, kept)
    rows, read = _read(store.lookup(table, [400]))
    assert rows == table.where("code + 0 = 400").count() > 0 and read < ROWS / 10
    # the ends of the range are far apart, and nothing between them is read
    rows, read = _read(store.lookup(table, [0, 2, 399_994, None]))
    assert rows == table.where("code + 0 in (0, 2, 399994)").count() > 0 and read < ROWS / 5


def test_absent_codes_read_nothing(spark, kept):
    table = store.read_store(spark, kept)
    assert _read(store.lookup(table, [401])) == (0, 0)  # between two neighbours: the Bloom filter
    assert _read(store.lookup(table, [10**9])) == (0, 0)
    assert store.lookup(table, []).count() == 0 and store.lookup(table, [None]).count() == 0


def test_a_hot_code_spreads_over_files(spark, kept):
    table = store.read_store(spark, kept).where("code = 200000")
    assert table.select(F.input_file_name()).distinct().count() >= 2 and table.count() > ROWS / 3


@pytest.mark.parametrize("as_table", [False, True])
def test_many_codes(spark, kept, as_table):
    table = store.read_store(spark, kept)
    asked = spark.range(0, 900).select((F.col("id") * 3).alias("code"))
    want = table.where("code % 3 = 0 and code < 2700").count()
    codes = asked.unionByName(asked) if as_table else [r[0] for r in asked.collect()] + [None]
    assert store.lookup(table, codes).count() == want > 0
