"""Schemas of the tidy tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}


def _schema(text: str) -> T.StructType:
    """From "name type, ..." (StructType.fromDDL would need a session at import)."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in text.split(","))])


SEQUENCES = _schema("hap string, chromosome string, seq string")
INTERVALS = _schema("chromosome string, start long, end long, label string")
COUNTS = _schema("hap string, chromosome string, region string, strand int, code long, n long")
DENOMINATORS = _schema("hap string, chromosome string, region string, valid_starts long, bp long")
HITS = _schema("kmer string, chromosome string, start long, end long, strand string")


class SchemaError(ValueError):
    """A table lacks a column, or has it with another type."""


def require_columns(df: DataFrame, schema: T.StructType | list[str]) -> DataFrame:
    """df itself if it has the columns (and, for a StructType, their types); else SchemaError."""
    if isinstance(schema, list):
        missing = [c for c in schema if c not in df.columns]
        wrong = []
    else:
        have = {f.name: f.dataType for f in df.schema}
        missing = [f.name for f in schema if f.name not in have]
        wrong = [f.name for f in schema if f.name in have and have[f.name] != f.dataType]
    if missing or wrong:
        raise SchemaError(f"missing columns: {missing}; columns of another type: {wrong}")
    return df


def chrom_ord(chromosome: Column) -> Column:
    """Place of a chromosome: its number, X 23, Y 24, others 99; a ``chr`` in front is ignored."""
    bare = F.regexp_replace(chromosome.cast("string"), "^chr", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.cast("int")).when(bare == "X", 23).when(bare == "Y", 24).otherwise(99)
