"""Parts of long FASTA records by index: tasks read only the bytes that are asked for.

An index row tells where the bases of a record start in its file and how long its lines are. Files are
plain (not compressed) and lie where all executors reach them: paths are URIs that Arrow's file
systems open (a shared folder, HDFS, S3).
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counting import spread

INDEX = ["path", "name", "length", "offset", "line_bases", "line_width"]


def _open(path: str) -> pa.NativeFile:
    system, inner = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(inner)


def _line(file: pa.NativeFile, at: int, size: int) -> bytes:
    """The line that starts at a byte, its end included."""
    out, step = b"", 1 << 12
    while b"\n" not in out and at + len(out) < size:
        out += file.read_at(min(step, size - at - len(out)), at + len(out))
        step *= 4
    return out[: out.index(b"\n") + 1] if b"\n" in out else out


def _headers(block: int):
    def run(batches):
        names = ["path", "size", "at", "name", "offset", "line_bases", "line_width", "closed"]
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with _open(path) as file:
                    before = 1 if start else 0
                    raw = file.read_at(min(block, size - start) + before, start - before)
                    closed = file.read_at(1, size - 1) == b"\n"
                    at = [0] if not start and raw[:1] == b">" else []
                    at += [m.start() + 1 - before + start for m in re.finditer(rb"\n(?=>)", raw)]
                    for a in at:
                        head = _line(file, a, size)
                        first = _line(file, a + len(head), size)
                        first = b"" if first.startswith(b">") else first
                        words = head[1:].split()
                        rows.append((path, size, a, words[0].decode() if words else "", a + len(head), len(first.rstrip()), len(first), closed))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=names)

    return run


def index_fasta(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    """INDEX of the records of FASTA files, whose lines have one width in each record but for the last.
    Headers are sought by blocks of the files, so a long file is many tasks; lengths follow from where
    the next header of the file starts."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.col("length").alias("size"))
    blocks = spread(files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))))
    rows = blocks.mapInArrow(_headers(block), "path string, size long, at long, name string, offset long, line_bases long, line_width long, closed boolean")
    after = F.lead("at").over(Window.partitionBy("path").orderBy("at"))
    rows = rows.withColumn("next", after)  # one row for each record of a file
    span = F.coalesce("next", "size") - F.col("offset")
    w, b = F.col("line_width"), F.col("line_bases")
    # a last line without its end has no bytes to take off
    rest = F.when(F.col("next").isNull() & ~F.col("closed"), F.least(span % w, b)).otherwise(F.greatest(F.lit(0), span % w - (w - b)))
    length = F.when(b == 0, 0).when(w == b, span).otherwise(F.floor(span / w) * b + rest).cast("long")
    return rows.select("path", "name", length.alias("length"), "offset", "line_bases", "line_width")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of .fai files; each lies beside its FASTA file."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    numbers = [part[i + 1].cast("long").alias(c) for i, c in enumerate(INDEX[2:])]
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.fai$", "").alias("path"), part[0].alias("name"), *numbers)


def fetch(intervals: DataFrame, index: DataFrame, k: int = 1, piece: int = 1 << 20) -> DataFrame:
    """The columns of intervals (name, start, end), with ``at``, ``seq`` and ``bytes``: the bases of each
    interval from ``at`` on, in pieces of ``piece`` bases that overlap by k - 1, and the bytes read for
    them. Intervals need not be few: they are sorted by place in the files and read by tasks. An interval
    that reaches out of its record, or lines of unequal width, are an error; one of a name that is not
    in the index, or without bases, gives no row."""
    rows = intervals.join(index.select(*INDEX), "name").where("start < end")
    out = F.raise_error(F.format_string("%s:%d-%d lies outside its record", "name", F.col("start"), F.col("end")))
    rows = rows.withColumn("start", F.when((F.col("start") >= 0) & (F.col("end") <= F.col("length")), F.col("start")).otherwise(out.cast("long")))
    starts = F.sequence(F.col("start"), F.greatest("start", F.col("end") - k), F.lit(piece).cast("long"))
    rows = rows.withColumn("at", F.explode(starts)).withColumn("_to", F.least(F.col("end"), F.col("at") + piece + k - 1))
    byte = lambda c: F.col("offset") + F.floor(c / F.col("line_bases")) * F.col("line_width") + c % F.col("line_bases")
    rows = rows.select(*intervals.columns, "at", "path", byte(F.col("at")).alias("_from"), (byte(F.col("_to") - 1) + 1).alias("_until"), (F.col("_to") - F.col("at")).alias("_bases"))
    kept = len(intervals.columns) + 1

    def read(batches):
        file, known = None, None
        for batch in batches:
            texts, sizes = [], []
            for path, start, end, bases in zip(*(batch.column(kept + i).to_pylist() for i in range(4)), strict=True):
                if path != known:
                    if file:
                        file.close()
                    file, known = _open(path), path
                raw = file.read_at(end - start, start)
                seq = raw.translate(None, b"\r\n")
                if len(seq) != bases:
                    raise ValueError(f"{path}: lines of unequal width near byte {start}")
                texts.append(seq.decode())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=[*names, "seq", "bytes"])
        if file:
            file.close()

    names = [*intervals.columns, "at"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    n = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "path", "_from").sortWithinPartitions("path", "_from").mapInArrow(read, f"{types}, seq string, bytes long")
