"""Runs named stages in order and keeps what is finished: a stage whose input files, settings and code
name have not changed is read, not computed. Finished tables are published as numbered versions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class StageError(RuntimeError):
    """A check of a stage's result found rows that break it."""


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified) of the files under the paths, whose contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def state(spark: SparkSession, paths: list[str]) -> str:
    """What tells whether files under the paths were added, removed or written again: one row of sums."""
    mark = F.xxhash64("path", "length", "modified").cast("decimal(38,0)")
    row = listed(spark, paths).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sum(mark).alias("marks")).first()
    return f"{row['files']} files, {row['bytes']} bytes, {row['marks']}"


class Pipeline:
    """Stage tables lie under root as <name>/<fingerprint>. Parquet's committer leaves _SUCCESS only
    in whole tables, and only those are reused."""

    def __init__(self, spark: SparkSession, root: str, settings: dict):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.done: dict[str, DataFrame] = {}
        self.prints: dict[str, str] = {}
        self.reused: list[str] = []

    def _print(self, name: str, version: str, needs: list[str], inputs: dict) -> str:
        parts = {"name": name, "version": version, "needs": {n: self.prints[n] for n in needs}, "settings": self.settings, "inputs": inputs}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]

    def _mark(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, path: str) -> bool:
        system, mark = self._mark(path)
        return system.exists(mark)

    def _disown(self, path: str) -> None:
        system, mark = self._mark(path)
        system.delete(mark, False)

    def run(self, name: str, stage: Stage, needs: tuple[str, ...] = (), version: str = "1", inputs: dict | None = None, checks: tuple[Callable[[DataFrame], DataFrame], ...] = (), reads: tuple[str, ...] = ()) -> DataFrame:
        """The table of a stage. ``reads`` are paths of the files that it reads: a stage is computed again
        once any of them has changed, and one whose files change while it runs is an error. ``checks`` give
        rows that must not be there. After either error later runs do not reuse the table."""
        before = {p: state(self.spark, [p]) for p in reads}
        self.prints[name] = self._print(name, version, list(needs), {**(inputs or {}), **({"reads": before} if reads else {})})
        path = f"{self.root}/{name}/{self.prints[name]}"
        if self._whole(path):
            self.reused.append(name)
        else:
            stage(self.spark, {n: self.done[n] for n in needs}).write.mode("overwrite").parquet(path)
            changed = [p for p in reads if state(self.spark, [p]) != before[p]]
            if changed:
                self._disown(path)
                raise StageError(f"{name}: changed while they were read: {', '.join(changed)}")
        try:
            table = self.spark.read.parquet(path)
        except AnalysisException as error:
            raise StageError(f"{name}: {error}") from error
        for check in checks:
            broken = check(table)
            if not broken.isEmpty():
                self._disown(path)
                raise StageError(f"{name}: {broken.limit(3).collect()}")
        self.done[name] = table
        return table

    def publish(self, name: str) -> int:
        """Publishes the table of a stage that has run as the next version, and gives its number. The list
        of its files is one file, so it is there whole or not at all. A table that is the newest version
        already keeps its number."""
        where, path = _versions(self.root, name), f"{self.root}/{name}/{self.prints[name]}"
        known = _manifest(self.spark, self.root, name)
        last = known.groupBy("version").agg(F.first("print").alias("print")).orderBy(F.desc("version")).first()
        if last is not None and last["print"] == self.prints[name]:
            return last["version"]
        number = 1 if last is None else last["version"] + 1
        rows = listed(self.spark, [path]).where("path like '%.parquet'").select(F.lit(self.prints[name]).alias("print"), "path", "length")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{where}/version={number}")
        return number


def _versions(root: str, name: str) -> str:
    return f"{root}/published/{name}"


def _manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = "print string, path string, length long, version int"
    try:
        return spark.read.schema(schema).parquet(_versions(root, name))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def incomplete(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    """(path, length, found): files of a published version that are missing (found is null) or not of the
    length that was published."""
    files = _manifest(spark, root, name).where(F.col("version") == version)
    folder = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).first()
    there = listed(spark, [folder["f"]]).select("path", F.col("length").alias("found")) if folder else spark.createDataFrame([], "path string, found long")
    return files.select("path", "length").join(there, "path", "left").where(~F.col("found").eqNullSafe(F.col("length")))


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A published version of a table, the newest one by default: exactly the files that it was published
    with, whatever has been written since. Versions that are not there, or not whole, are errors."""
    root = root.rstrip("/")
    files = _manifest(spark, root, name)
    number = files.agg(F.max("version")).first()[0] if version is None else version
    paths = [r["path"] for r in files.where(F.col("version") == number).select("path").collect()]  # as Spark lists them itself
    if not paths:
        raise StageError(f"{name}: version {number} is not published")
    broken = incomplete(spark, root, name, number).limit(3).collect()
    if broken:
        raise StageError(f"{name}: version {number} is not whole: {broken}")
    return spark.read.parquet(*paths)
