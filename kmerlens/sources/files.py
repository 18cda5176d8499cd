"""FASTA, FAI, BED, TSV and log files, read and written by Spark's own text sources, so any store
that Spark reaches will do; .gz is unpacked and packed by name or option."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kmer as K


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(path, name, seq): a record starts at ``>``; its name is the first token of the header line;
    white space in sequences, carriage returns too, is dropped. Header text must not hold ``>``. A
    record is one row: for records of many megabytes take ``fasta_pieces``."""
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return rows.select("path", F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"), (F.upper(body) if upper else body).alias("seq"))


def fasta_pieces(spark: SparkSession, path: str, k: int = 16, size: int = 1 << 20) -> DataFrame:
    """(path, name, seq): the records of FASTA files in pieces of about ``size`` bases, as counting
    needs them: every window of k bases of a record lies in exactly one piece. Files are read by lines
    and blocks, so no row or task holds a long record. What runs over from one block to the next is
    stitched from the last and the first k - 1 bases of the blocks, one row each."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    names = ["path", "block", "kind", "name", "seq"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def cut(batches):
        """Pieces; before a block's first header their name is null. Also the block's ends."""
        state: dict = {}
        out: list[tuple] = []

        def flush(last: bool) -> None:
            text = "".join(state["parts"])
            state["parts"], state["size"] = [], 0
            if not state["started"]:
                state["head"] += text[: k - 1 - len(state["head"])]
            text = state["carry"] + text
            if len(text) >= k:
                out.append((state["path"], state["block"], "piece", state["name"], text))
            state["carry"] = text[-(k - 1) :] if k > 1 else ""

        def close() -> None:
            if state:
                flush(True)
                # a block without any header hands on what it got: its head is all that it has, if short
                out.append((state["path"], state["block"], "head", None, state["head"]))
                out.append((state["path"], state["block"], "tail", state["name"], state["carry"]))

        def opened(path, block) -> None:
            state.clear()
            state.update(path=path, block=block, name=None, parts=[], size=0, carry="", head="", started=False)

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for rows in batches:
            for path, block, line in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if not state or state["path"] != path or state["block"] != block:
                    close()
                    opened(path, block)
                if line[:1] == b">":
                    flush(True)
                    state["started"], state["carry"] = True, ""
                    state["name"] = (line[1:].split() or [b""])[0].decode()
                else:
                    text = b"".join(line.split()).decode()
                    state["parts"].append(text)
                    state["size"] += len(text)
                    if state["size"] >= size:
                        flush(False)
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    found = lines.mapInArrow(cut, "path string, block long, kind string, name string, seq string")
    # one row for each block of a file meets by file
    order = Window.partitionBy("path").orderBy("block")
    ends = found.where("kind <> 'piece'").groupBy("path", "block").agg(F.max(F.when(F.col("kind") == "tail", F.col("name"))).alias("name"), F.max(F.when(F.col("kind") == "tail", F.col("seq"))).alias("tail"), F.max(F.when(F.col("kind") == "head", F.col("seq"))).alias("head"))
    known = ends.withColumn("before", F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    border = known.withColumn("left", F.lag("tail").over(order)).where(F.length(F.coalesce("left", F.lit(""))) + F.length("head") >= k).where(F.length("head") > 0)
    seams = border.select("path", F.col("before").alias("name"), F.concat("left", "head").alias("seq")).where("seq is not null")
    pieces = found.where("kind = 'piece'").join(known.select("path", "block", "before"), ["path", "block"])
    return pieces.select("path", F.coalesce("name", "before").alias("name"), "seq").unionByName(seams)


def write_fasta(df: DataFrame, path: str, width: int = 80, compression: str = "none") -> None:
    """Records of df (name, seq), sequences in lines of ``width``."""
    fasta_lines(df, width).write.option("compression", compression).text(path)


def fasta_lines(df: DataFrame, width: int = 80) -> DataFrame:
    """(value): the text of each record of df (name, seq)."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value"))


def region_records(sequences: DataFrame, intervals: DataFrame, region: str) -> DataFrame:
    """(name, seq) of the intervals (hap, chromosome, start, end) of one region view of sequences (hap,
    chromosome, seq); names are hap|chromosome:start-end|region|strand=+."""
    rows = sequences.join(intervals, ["hap", "chromosome"])
    name = F.format_string(f"%s|%s:%d-%d|{region}|strand=+", F.col("hap").cast("string"), F.col("chromosome").cast("string"), F.col("start").cast("long"), F.col("end").cast("long"))
    return rows.select(name.alias("name"), F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("seq"))


def seed_records(candidates: DataFrame, k: int = 16) -> DataFrame:
    """(name, seq): both strands of each candidate (place, code), the one strand of a palindrome once."""
    rc = K.reverse_complement_code(F.col("code"), k)
    both = F.array(F.struct(F.lit("F").alias("strand"), F.col("code").alias("c")), F.struct(F.lit("R").alias("strand"), rc.alias("c")))
    rows = candidates.select("place", F.explode(F.when(F.col("code") == rc, F.slice(both, 1, 1)).otherwise(both)).alias("x"))
    return rows.select(F.concat_ws("_", F.col("place").cast("string"), "x.strand").alias("name"), K.decode(F.col("x.c"), k).alias("seq"))


def plot_index(plots: DataFrame) -> DataFrame:
    """(value): one Markdown line for each plot (title, file), in order of file."""
    return plots.orderBy("file").select(F.format_string("- [%s](%s)", "title", "file").alias("value"))


def chunks(sequences: DataFrame, size: int = 1 << 20, k: int = 16) -> DataFrame:
    """Long sequences as rows of ``size`` bases that overlap by k - 1, with ``offset``: every window
    lies in one chunk, and no task holds a whole chromosome."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), (F.length("seq") - k).cast("long")), F.lit(size).cast("long"))
    rows = sequences.withColumn("offset", F.explode(starts))
    return rows.withColumn("seq", F.substring("seq", (F.col("offset") + 1).cast("int"), F.lit(size + k - 1)))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(path, chromosome, length): the first two columns of a FASTA index."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_path").alias("path"), parts[0].alias("chromosome"), parts[1].cast("long").alias("length"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(path, chromosome, start, end, label, score, strand, bad): ``bad`` rows have fewer than six
    fields, numbers that are none, or a strand other than + and -."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    out = rows.select(F.col("_metadata.file_path").alias("path"), *(F.try_element_at(f, F.lit(i + 1)).cast("string").alias(n) for i, n in enumerate(("chromosome", "start", "end", "label", "score", "strand"))))
    out = out.withColumn("start", F.col("start").try_cast("long")).withColumn("end", F.col("end").try_cast("long"))
    return out.withColumn("bad", F.col("start").isNull() | F.col("end").isNull() | ~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, item): first tokens of the lines that are not comments."""
    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("item"))


def completed_logs(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """(path, complete): logs that hold all needed texts and no word ERROR. One file each, which costs a
    call for each log: for many thousands of logs take ``gather_logs``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _completed(rows, needed)


def gather_logs(logs: DataFrame, path: str) -> None:
    """Logs (path, value) as JSON lines, one for each log with its whole text: as few files as tasks."""
    logs.select("path", "value").write.json(path)


def completed_gathered_logs(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """What ``completed_logs`` gives, of logs that ``gather_logs`` wrote."""
    rows = spark.read.schema("path string, value string").option("maxStringLen", 2**31 - 1).json(path)
    return _completed(rows, needed)


def _completed(logs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    fine = F.lit(True)
    for text in needed:
        fine = fine & F.col("value").contains(text)
    return logs.select("path", (fine & ~F.col("value").rlike(r"\bERROR\b")).alias("complete"))


def named(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """df with the groups of a pattern of its ``path`` as columns."""
    for i, name in enumerate(names):
        df = df.withColumn(name, F.regexp_extract("path", pattern, i + 1))
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, na: str = "NA") -> DataFrame:
    """A table with a header, by an explicit schema; ``na`` is null."""
    return spark.read.option("header", True).option("sep", "\t").option("nullValue", na).schema(schema).csv(path)


def read_marker_tables(spark: SparkSession, pattern: str, schema: T.StructType, family: str | None = None, column: str = "family") -> DataFrame:
    """All tables of a path pattern as one, with ``source``, the name of each file without its endings;
    of one family only, if named. Identifiers that hold other characters than letters, digits, ``_``,
    ``.`` and ``-`` are refused by ``measures.valid_identifier`` where the caller asks for it."""
    rows = spark.read.option("header", True).option("sep", "\t").option("nullValue", "NA").schema(schema).csv(pattern)
    rows = rows.withColumn("source", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    return rows if family is None else rows.where(F.col(column) == family)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, compression: str = "none", na: str = "NA") -> None:
    """The named columns, others ignored, with a header; null is written as ``na``."""
    df.select(*(columns or df.columns)).write.option("header", True).option("sep", "\t").option("nullValue", na).option("compression", compression).csv(path)


def write_counts(df: DataFrame, path: str) -> None:
    """Count shards partitioned by hap; a rerun replaces only the haps that it holds."""
    df.write.partitionBy("hap").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """A small dictionary as one JSON line."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified, sha256) of files: tells whether inputs changed between runs."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
