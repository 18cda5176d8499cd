"""Which haps and chromosomes may be used, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import valid


def split_annotation(annotation: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of annotation (hap, chromosome, start, end, ...) against lengths (hap,
    chromosome, length): rows on unknown chromosomes or outside them are bad."""
    rows = annotation.join(lengths, ["hap", "chromosome"], "left")
    fine = valid(F.col("start"), F.col("end"), F.col("length"))
    return rows.where(fine).drop("length"), rows.where(~fine).drop("length")


def eligibility(haps: DataFrame, passed: DataFrame, lengths: DataFrame, bad: DataFrame) -> DataFrame:
    """(hap, reason) of haps (hap, complete). A bad coordinate outweighs a passed chromosome that is
    missing from the sequences, which outweighs incomplete inputs."""
    missing = passed.join(lengths, ["hap", "chromosome"], "left_anti").select("hap").distinct().withColumn("missing", F.lit(True))
    wrong = bad.select("hap").distinct().withColumn("wrong", F.lit(True))
    rows = haps.join(missing, "hap", "left").join(wrong, "hap", "left")
    reason = F.when(F.col("wrong"), "EXCLUDE_invalid_coordinate").when(F.col("missing"), "EXCLUDE_missing_chromosome").when(~F.col("complete"), "EXCLUDE_incomplete_input").otherwise("PASS")
    return rows.select("hap", reason.alias("reason"))


def chromosome_status(reasons: DataFrame, passed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(hap, chromosome, passed, present, status) of every chromosome that either list names."""
    p = passed.select("hap", "chromosome").distinct().withColumn("passed", F.lit(1))
    q = lengths.select("hap", "chromosome").distinct().withColumn("present", F.lit(1))
    rows = p.join(q, ["hap", "chromosome"], "full").fillna(0, ["passed", "present"]).join(reasons, "hap", "left")
    return rows.select("hap", "chromosome", "passed", "present", F.when(F.col("passed") == 1, F.col("reason")).otherwise("EXCLUDE_not_passed").alias("status"))
