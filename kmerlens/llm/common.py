"""Shared pieces: written stage tables, vectorised words and shingles, connected components.

Columns of caller tables never leak into the operators: each operator first projects the
columns it names in its signature, and those that give back whole rows carry them as one column, so
extra columns (also ones whose names clash with columns made here) change nothing and stay as they are.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step handles; temporaries take about 40 times as much.
SEGMENT_BYTES = 1 << 20


# ---------------------------------------------------------------- stage tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``, or where that is unset and
    the master is local (tests) a temporary folder that is set there. Executors on other machines
    would not see such a folder, so elsewhere an unset one is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def tasks_for(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """Tasks that suit the size of df by Spark's estimate (of files: their bytes): one per core at
    least. Far more tasks than that only make small files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // bytes_each), 1 << 30))


_written: list[str] = []


def drop_stages(spark: SparkSession) -> int:
    """Deletes all stage tables that this program has written and not yet deleted, and gives their
    number. Results of operators are lazy and read such tables: write a result first, then call this."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here, so a
    lost executor costs no recomputation of earlier stages and later readers see one result. With
    ``tasks``, no more tasks than that write (no shuffle: partitions are merged)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(tasks) if tasks else df).write.option("compression", "zstd").parquet(path)
    gc.collect()  # plans that Python no longer holds leave the driver's JVM with their proxies
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    _written.append(path)
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a stage table that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 10_000, few: int = 100_000) -> DataFrame:
    """left joined to right (inner or left), which has one row for each of its keys. A right side of
    ``few`` rows at most is broadcast. Otherwise a key that more than one in ``most`` rows of left has
    (so ``most`` keys at most) meets its row by broadcast, where the rows of left lie, and only the
    others are shuffled. Either way no task gathers the rows of a key."""
    right = right if hasattr(right, "_stage_path") else staged(right, "right")
    if right.count() <= few:
        return left.join(F.broadcast(right), key, how)
    left = left if hasattr(left, "_stage_path") else staged(left, "left")
    n = left.count()
    heavy = staged(left.groupBy(key).count().where(F.col("count") > n / most).select(key), "heavy", 1)
    heavy = F.broadcast(heavy)
    some = left.join(heavy, key).join(F.broadcast(right.join(heavy, key)), key, how)
    return left.join(heavy, key, "left_anti").join(right, key, how).unionByName(some)


def rows_of(docs: DataFrame) -> Column:
    """All columns of docs as one: names made beside it never clash with theirs. ``select("row.*")``
    gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Arrow batches of bounded bytes: texts may be long and Python workers have little memory. All
    operators ask for the same bound, and one that the caller has set stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name) in (str(default), f"{default}b", "64m", "64MB"):
        spark.conf.set(name, f"{size}b")


def _give_back() -> None:
    """Returns freed memory to the system: workers live on, and what their allocators keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator that has no such call
        pass


def lean(f):
    """f, a function of Arrow batches, that gives its memory back at the end of a partition."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def lean_group(f):
    """f, a function of one group, that gives its memory back at the end of each."""

    def run(group):
        try:
            return f(group)
        finally:
            _give_back()

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 2 when divided by 4. A
    null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- vectorised text

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_places = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _place_keys(n: int) -> np.ndarray:
    """Keys of the places 0 to n - 1 of a word. Each is a mix of its number, not a power of a base:
    with powers, words made for it (Thue-Morse words) collide modulo 2^64 whatever the base is."""
    global _places
    if len(_places) < n:
        _places = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return _places


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 rows) of an Arrow string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _cuts(raw: np.ndarray, offs: np.ndarray, limit: int) -> list[int]:
    """Places that divide the bytes into runs of about ``limit``, at white space or between rows."""
    cuts, at, n = [0], 0, len(raw)
    while n - at > limit:
        k = int(np.searchsorted(offs, at + limit, "right")) - 1
        to = int(offs[k])
        if to <= at:
            window, to = at + limit, n
            stop = int(offs[k + 1]) if k + 1 < len(offs) else n
            for lo in range(window, stop, limit):
                hit = np.flatnonzero(_SPACE[raw[lo : min(stop, lo + limit)]])
                if len(hit):
                    to = lo + int(hit[0])
                    break
            else:
                to = stop
        cuts.append(to)
        at = to
    return [*cuts, n] if n > at else cuts


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool = True, prefix: int = 0):
    """(64-bit hashes of all words, word offsets of the rows). A word is a maximal run of bytes
    other than space and tab to carriage return; ``lower`` folds A-Z only. With ``prefix``, the
    hashes have a second column: of the first ``prefix`` bytes of the words."""
    table = _LOWER if lower else _BYTE
    hashes, starts_all = [], []
    cuts = _cuts(raw, offs, SEGMENT_BYTES)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = raw[lo:hi]
        solid = ~_SPACE[part]
        edge = np.ones(len(part) + 1, bool)
        edge[1:-1] = ~solid[:-1]
        inner = offs[(offs >= lo) & (offs < hi)] - lo
        edge[inner] = True
        starts = np.flatnonzero(solid & edge[:-1])
        if not len(starts):
            continue
        where = np.flatnonzero(solid)
        first = np.searchsorted(where, starts)
        lens = np.diff(np.append(first, len(where)))
        place = np.arange(len(where)) - np.repeat(first, lens)
        values = table[part[where]] * _place_keys(int(lens.max()))[place]
        whole = mix64(np.add.reduceat(values, first) + lens.astype(np.uint64))
        if prefix:
            values[place >= prefix] = 0
            whole = np.stack([whole, mix64(np.add.reduceat(values, first) + U64(1 << 40))], 1)
        hashes.append(whole)
        starts_all.append(starts + lo)
    if not hashes:
        return np.zeros((0, 2) if prefix else 0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offs)


def shingles(words: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles in order, shingle offsets of the rows). A row of 1 to k-1
    words has its whole sequence as one shingle; a row without words has none."""
    counts = np.diff(offs)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(to[-1]), np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1] * _POS[0]
        for j in range(1, k):
            full = full + words[j : len(words) - k + 1 + j] * _POS[j]
        rows = np.flatnonzero(counts >= k)
        place = np.arange(int(n[rows].sum())) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        out[np.repeat(to[:-1][rows], n[rows]) + place] = full[np.repeat(offs[:-1][rows], n[rows]) + place]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[offs[i] : offs[i + 1]]
        out[to[i]] = (w * _POS[10 : 10 + len(w)]).sum(dtype=np.uint64) + U64(len(w))
    return mix64(out), to


# ---------------------------------------------------------------- connected components


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its tree) that join the same nodes as the edges given."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]
    root = np.asarray(parent, dtype=np.int64)
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches, most: int = 1 << 20):
    """Star edges (a, b) that join the same nodes as the edges of a partition, by ``most`` at a time."""
    held: list[tuple] = []

    def out():
        node, root = local_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy() for c in batch.columns))
        if sum(len(x[0]) for x in held) > most:
            yield out()
    if held:
        yield out()


def components(edges: DataFrame, name: str = "components", tasks: int | None = None, part_edges: int = 1 << 19) -> DataFrame:
    """(node, root) of every node of the edges (a long, b long): root is the smallest node that it
    is joined to. Parts of about part_edges edges first become forests of stars by themselves, which
    leaves fewer edges and rounds. Then alternating large and small stars: every round halves path
    lengths, groups by node with map-side minima, and ends in a written table, so no component is
    gathered in a task."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    first = staged(edges, f"{name}-edges", tasks)
    parts = max(1, -(-first.count() // part_edges))
    now = staged(first.coalesce(parts).mapInArrow(lean(_forests), "a long, b long").distinct(), name, parts)
    unstage(first)
    while True:
        # in a forest of stars no node has two edges up, or edges both up and down
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then = staged(small, name, tasks)
        unstage(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
