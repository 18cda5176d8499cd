"""Vector code compression: product quantisation of integer vectors with exact nearest entries.

A vector is cut into equal parts, and each part position has a codebook. Every round a kd-tree of each
codebook goes to all tasks. A part is first held against the entries of its own leaf; then the tree is
walked down, and a node is left out only if its box lies farther than the best so far. Nodes at the
same distance are visited, so of equal entries that of the lowest index wins. Tasks give one row of
integer sums for each entry, which are summed exactly and replace the entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, lean, staged, unstage

#: Greatest magnitude of a component: squared distances of parts of 64 fit in 64 bits.
LARGEST = 1 << 27
#: Parts that are searched at once.
BLOCK = 1 << 16


class Tree:
    """kd-tree of integer points: nodes are split at the median of their widest axis, and each has the
    box of its points. Searches are exact, by squared Euclidean distance."""

    def __init__(self, points: np.ndarray, leaf: int = 8):
        self.points, self.leaf = points, leaf
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.cut: list[tuple[int, int]] = []  # axis and value: below it or not
        self.below: list[tuple[int, int]] = []
        self.members: list[np.ndarray] = []
        self._grow(np.arange(len(points)))

    def _grow(self, ids: np.ndarray) -> int:
        own, node = self.points[ids], len(self.low)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.cut.append((0, 0))
        self.below.append((-1, -1))
        self.members.append(ids)
        axis = int((self.high[node] - self.low[node]).argmax())
        # the median, or where the values below it are none, the next value above the least
        along = np.sort(own[:, axis])
        value = int(along[len(along) // 2])
        if value == along[0]:
            value = int(along[min(int(np.searchsorted(along, value, "right")), len(along) - 1)])
        if len(ids) > self.leaf and value > along[0]:
            left = own[:, axis] < value
            self.cut[node] = (axis, value)
            self.below[node] = (self._grow(ids[left]), self._grow(ids[~left]))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest point of each row of x, the lowest index of equals."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.zeros(len(x), np.int64)

        def meet(node: int, rows: np.ndarray) -> None:
            ids = self.members[node]
            d = ((x[rows, None, :] - self.points[ids]) ** 2).sum(2)
            at = d.argmin(1)  # the first of equals, and ids ascend
            d, i = d[np.arange(len(rows)), at], ids[at]
            closer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            best[rows[closer]], index[rows[closer]] = d[closer], i[closer]

        def home(node: int, rows: np.ndarray) -> None:
            left, right = self.below[node]
            if left < 0:
                meet(node, rows)
                own[rows] = node
            else:
                axis, value = self.cut[node]
                side = x[rows, axis] < value
                for child, part in ((left, rows[side]), (right, rows[~side])):
                    if len(part):
                        home(child, part)

        def walk(node: int, rows: np.ndarray) -> None:
            away = np.maximum(np.maximum(self.low[node] - x[rows], x[rows] - self.high[node]), 0)
            rows = rows[(away**2).sum(1) <= best[rows]]
            left, right = self.below[node]
            if left < 0:
                rows = rows[own[rows] != node]
                if len(rows):
                    meet(node, rows)
            elif len(rows):
                walk(left, rows)
                walk(right, rows)

        own = np.full(len(x), -1)
        everyone = np.arange(len(x))
        home(0, everyone)
        walk(0, everyone)
        return index, best


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """(id, label, vec): rows whose vector is neither null nor holds null or non-finite components,
    each component as floor(scale * x). The label is a text; null stays null."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("long")))
    return vectors.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), whole.alias("vec"))


def _cut(batch: pa.RecordBatch, column: int, width: int, parts: int) -> np.ndarray:
    """Vectors of a batch as (rows, parts, size of a part); zeros fill up the last part."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    return np.pad(flat, ((0, 0), (0, -width % parts))).reshape(batch.num_rows, parts, -1)


def train(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of rows (id, vec): first the parts of the ``entries`` smallest ids (null ones last, equal
    ids by their vectors), then after each round the floors of the means of what was nearest to them."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    start = np.array([r["vec"] for r in first], np.int64)
    books = list(np.pad(start, ((0, 0), (0, -width % parts))).reshape(len(start), parts, -1).transpose(1, 0, 2))
    size = books[0].shape[1]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

        def sums(batches, sent=sent):
            trees = sent.value
            total = np.zeros((parts, len(start), size + 1), np.int64)
            for batch in batches:
                x = _cut(batch, 0, width, parts)
                for at in range(0, len(x), BLOCK):
                    for p, tree in enumerate(trees):
                        part = x[at : at + BLOCK, p]
                        index, _ = tree.nearest(part)
                        np.add.at(total[p], index, np.pad(part, ((0, 0), (0, 1)), constant_values=1))
            part, entry = np.nonzero(total[:, :, size])
            if len(part):
                values = total[part, entry]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(values[:, j]) for j in range(size + 1))], names=names)

        names = ["part", "entry", *(f"s{j}" for j in range(size)), "n"]
        per_task = rows.select("vec").mapInArrow(lean(sums), "part int, entry int, " + ", ".join(f"{n} long" for n in names[2:]))
        # parts x entries rows; sums of 64 bits that run over are errors under ANSI, not wrong values
        for r in per_task.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:])).collect():
            books[r["part"]][r["entry"]] = [r[n] // r["n"] for n in names[2:-1]]
        sent.unpersist()
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1)).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(id, label, code, error) of rows (id, label, vec): nearest entries, two hex digits for each part
    (four where a codebook has more than 256 entries), and the summed squared distances."""
    parts, digits = len(books), 2 if len(books[0]) <= 256 else 4
    sent = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def codes(batches):
        hexes = np.array([f"{i:0{digits}x}".encode() for i in range(len(books[0]))], f"S{digits}")
        for batch in batches:
            if batch.num_rows:
                x = _cut(batch, 2, width, parts)
                found = [tree.nearest(x[:, p]) for p, tree in enumerate(sent.value)]
                code = np.stack([hexes[i] for i, _ in found], 1).reshape(-1).tobytes().decode()
                step = digits * parts
                text = [code[i : i + step] for i in range(0, len(code), step)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "vec").mapInArrow(lean(codes), "id long, label string, code string, error long")


def decode(code: Column, books: list[np.ndarray]) -> Column:
    """The entries of a code joined to one vector (integers; zeros that filled up the last part too)."""
    digits = 2 if len(books[0]) <= 256 else 4
    table = [F.array(*(F.array(*(F.lit(int(v)) for v in entry)) for entry in b)) for b in books]
    place = [F.conv(F.substring(code, digits * p + 1, digits), 16, 10).cast("int") + 1 for p in range(len(books))]
    return F.flatten(F.array(*(F.element_at(t, at) for t, at in zip(table, place, strict=True))))


def compress(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, code, error, label_error) of every kept row, codebooks).

    Kept rows have a vector without null or non-finite components; of vectors of unequal lengths those
    of the most frequent one (the greater of equals) are kept. A length that ``parts`` does not divide is
    filled up with zeros. Equal ids, repeated rows and null ids all stay; initial entries are those of the
    smallest ids, null ones last and equal ids by vector, and fewer rows give fewer entries. label_error
    sums the error of rows of equal labels, null ones together. Components beyond 2^27 after scaling are
    an error, since their squares are beyond 64 bits. No kept rows give no rows and no codebooks. Only
    the codebooks (parts x entries) go through the driver; vectors are written once and read each round.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = staged(integers(vectors, id_col, vector_col, label_col, scale), "integers")
    widths = rows.groupBy(F.size("vec").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if widths is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long"), []
    width = widths["d"]
    kept = rows.where(F.size("vec") == width)
    books = train(kept, width, parts, entries, rounds)
    coded = staged(encode(kept, books, width).withColumn("of", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))).drop("label"), "codes")
    unstage(rows)
    sums = coded.groupBy("of").agg(F.sum("error").alias("label_error"))
    return join_hot(coded, sums, "of").select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    return out.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def _rounds(n: int) -> str:
    """Codebooks b1 to bn from b0, and the nearest entries a0 to an of all parts."""
    d = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = []
    for r in range(n + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, v.p, any_value(v.x) AS x, min({{'d': {d}, 'e': b.e}}) AS m FROM v JOIN b{r} b ON b.p = v.p GROUP BY vec_id, label, v.p)")
        if r < n:
            mean = f"SELECT p, e, list(y ORDER BY j) AS x FROM (SELECT p, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS y FROM (SELECT p, m.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY p, e, j) GROUP BY p, e"
            out.append(f"m{r} AS ({mean}), b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)")
    return ", ".join(out)


OP12_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, list_slice(q, p * (len(q) // 16) + 1, (p + 1) * (len(q) // 16)) AS x FROM k, range(16) r(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
b0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN f USING (vec_id)), {_rounds(2)},
o AS (SELECT vec_id, label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h
"""
