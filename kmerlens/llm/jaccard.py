"""N-gram Jaccard join: every pair of documents whose shingle sets reach a Jaccard threshold.

The join is exact but for equal hashes: candidates are found by 32 bits and the number of their
bucket, pairs are verified by 64 bits. Documents with equal sets are one node from the start (its id is a hash of the
set). A pair that reaches threshold t shares a shingle among the first n - ceil(t n) + 1 of each
side in any common order of shingles; the order used here is rare first, so ordinary documents
have only shingles of their own in that prefix and drop out, and boilerplate comes last.

1. Texts are read once; shingle hashes go as packed blobs to hash buckets, which count in how many
   sets each stands. Half of the hash space comes first in the order, and suffices for most
   prefixes; a set with too few there sends all its hashes. Hashes that a sample shows to be frequent
   (a list of bounded length) come last, in the order of the list, and are not counted: no group holds
   all sets that have one, only sets that have little else are joined through them.
2. Shared hashes return to their sets as (set, hash, count); prefixes follow from them and from
   set sizes. Prefix hashes join sets of compatible sizes into candidate groups.
3. A candidate group of bounded size is one tile. A larger one is cut into blocks that share a leader,
   which joins groups of near copies at once. Where that leaves a group in several components, few sets
   outside the largest one meet each of its blocks; more sets meet as pairs of blocks, and those of a
   group of many blocks by prefix hash, under the hashes alone whose sets are still apart. Blocks are
   size bands of ratio 1/t, and sub-blocks where a band is large; pairs are those whose sizes match.
4. Inside a tile, parity bitmaps bound overlaps from above by bit counts; the pairs left are
   intersected exactly as sorted arrays, unless already joined. Tiles give spanning links only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bounded_batches, components, join_hot, lean, lean_group, local_forest, mix64, rows_of, shingles, staged, string_buffers, tasks_for, unstage, word_hashes

#: Hashes that are handled as frequent, at most: 8 bytes each in every Python worker.
FREQUENT = 50_000
#: Hashes below this come first in the order of shingles.
HALF = U64(1 << 63)


def document_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets, sizes, set ids) of the texts of an Arrow column."""
    raw, offs = string_buffers(texts)
    h, at = shingles(*word_hashes(raw, offs), k)
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    to = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    ids = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        ids[full] = mix64(np.add.reduceat(mix64(flat ^ U64(0x5851F42D4C957F2D)), to[:-1][full]) + sizes[full].astype(np.uint64))
    return flat, to, sizes, ids.view(np.int64)


def prefix_length(n, threshold: tuple[int, int]):
    """Shingles of which a set of n must share one with any set that reaches the threshold a / b."""
    a, b = threshold
    return n - (a * n + b - 1) // b + 1


def _sampled_sets(k: int):
    def run(batches):
        """(hash, set) of the distinct sets of each batch."""
        for batch in batches:
            flat, _, sizes, ids = document_sets(batch.column(0), k)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(ids, sizes))], names=["h", "s"])

    return run


def _frequent(docs: DataFrame, k: int, one_in: int, least: int = 8) -> np.ndarray:
    """Hashes that ``least`` sets of a sample have, rarest first, FREQUENT at most."""
    sample = docs.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(one_in)) == 0).select("text").mapInArrow(_sampled_sets(k), "h long, s long")
    counts = sample.distinct().groupBy("h").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toPandas()["h"]
    return found.to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _count_pass(batches, k, threshold, buckets, frequent, hold: int = 1 << 18):
    """Rows (doc_id, key, set_id, n, n_early, n_rare); blobs (bucket, hashes, sets, runs): the hashes
    of a bucket below its leading bits, the sets they stand in, and how many hashes each set has; and
    rows (set_id, h) of frequent hashes in prefixes."""
    lead = buckets.bit_length() - 1
    names = ["doc_id", "key", "set_id", "n", "n_early", "n_rare", "h", "bucket", "hashes", "sets", "runs"]
    types = [pa.int64()] * 8 + [pa.binary()] * 3
    order = np.argsort(frequent.value)
    known, rank = frequent.value[order], order
    held: list[tuple] = []

    def batch_of(size: int, /, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names=names)

    def out():
        f, s = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        b = (f >> U64(64 - lead)).astype(np.int64) if lead else np.zeros(len(f), np.int64)
        order = np.argsort(b, kind="stable")
        f, s, b = (f[order] << U64(lead) >> U64(32)).astype(np.uint32), s[order], b[order]
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist()
        rows = []
        for x, y in zip(at, [*at[1:], len(b)], strict=True):
            runs = np.flatnonzero(np.append(True, s[x + 1 : y] != s[x : y - 1]))
            rows.append((int(b[x]), f[x:y].tobytes(), s[x:y][runs].tobytes(), np.diff(np.append(runs, y - x)).astype(np.uint32).tobytes()))
        bucket, hashes, sets, runs = zip(*rows, strict=True)
        return batch_of(len(rows), bucket=bucket, hashes=hashes, sets=sets, runs=runs)

    for batch in batches:
        flat, to, sizes, ids = document_sets(batch.column(2), k)
        m = len(sizes)
        owner = np.repeat(np.arange(m), sizes)
        place = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        often = known[place] == flat if len(known) else np.zeros(len(flat), bool)
        early = (flat < HALF) & ~often
        n_early, n_often = np.bincount(owner[early], minlength=m), np.bincount(owner[often], minlength=m)
        wanted = prefix_length(sizes, threshold)
        short = n_early < wanted
        once = np.zeros(m, bool)
        once[np.unique(ids, return_index=True)[1]] = True
        sent = once[owner] & ~often & (early | short[owner])
        yield batch_of(m, doc_id=batch.column(0), key=batch.column(1), set_id=ids, n=sizes, n_early=n_early, n_rare=sizes - n_often)
        # sets with too few other hashes: the first frequent ones belong to the prefix
        some = np.flatnonzero(often & (once & (sizes - n_often < wanted))[owner])
        if len(some):
            some = some[np.lexsort((rank[place[some]], owner[some]))]
            of = owner[some]
            turn = np.arange(len(some)) - np.searchsorted(of, of)
            some = some[turn < (wanted - (sizes - n_often))[of]]
            yield batch_of(len(some), set_id=ids[owner[some]], h=flat[some].view(np.int64))
        if sent.any():
            held.append((flat[sent], ids[owner[sent]]))
        if sum(len(x[0]) for x in held) > hold:
            yield out()
    if held:
        yield out()


def _joined(column, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column]) if len(column) else np.zeros(0, dtype)


def _cut(keys: np.ndarray, extra: int, **arrays) -> pd.DataFrame:
    """Blobs of the arrays for each value of keys, which are sorted."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
    rows = [(int(keys[lo]), extra, *(v[lo:hi].tobytes() for v in arrays.values())) for lo, hi in zip(at, [*at, len(keys)][1:], strict=True)]
    return pd.DataFrame(rows, columns=["part", "bucket", *arrays])


def _shared_hashes(groups: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket: hashes that several sets hold, with their counts, by group of sets."""
        h, s = _joined(pdf["hashes"], np.uint32), np.repeat(_joined(pdf["sets"], np.int64), _joined(pdf["runs"], np.uint32))
        order = np.argsort(h, kind="stable")
        h, s = h[order], s[order]
        alike = h[1:] == h[:-1]
        many = np.zeros(len(h), bool)
        many[1:] |= alike
        many[:-1] |= alike
        h, s = h[many], s[many]
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[fresh], s[fresh]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        df = np.diff(np.append(at, len(h)))
        count = np.repeat(df, df)
        keep = count > 1
        h, s, count = h[keep], s[keep], count[keep].astype(np.uint32)
        g = (s.view(np.uint64) % U64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        return _cut(g[order], int(pdf["bucket"].iat[0]), hashes=h[order], sets=s[order], counts=count[order])

    return run


def _prefixes(threshold, buckets: int):
    lead = buckets.bit_length() - 1

    def run(blobs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        """Of one group of sets: the shared hashes in their prefixes, as blobs for the buckets."""
        h, s, c = _joined(blobs["hashes"], np.uint32), _joined(blobs["sets"], np.int64), _joined(blobs["counts"], np.uint32)
        b = np.repeat(blobs["bucket"].to_numpy(np.int64), [len(x) // 4 for x in blobs["hashes"]])
        ids = sets["set_id"].to_numpy(np.int64)
        order = np.argsort(ids)
        ids, n, n_early, n_rare = ids[order], *(sets[c].to_numpy(np.int64)[order] for c in ("n", "n_early", "n_rare"))
        at = np.searchsorted(ids, s)
        late = (b >= buckets // 2) if lead else (h >= 1 << 31)
        order = np.lexsort((h, b, c, late, at))
        h, b, at, late = h[order], b[order], at[order], late[order]
        # hashes that no other set holds come before the shared ones of the same half
        shared, shared_late = np.bincount(at, minlength=len(ids)), np.bincount(at[late], minlength=len(ids))
        own_early = n_early - (shared - shared_late)
        own_late = np.where(n_early < prefix_length(n, threshold), n_rare - n_early, 0) - shared_late
        place = np.arange(len(h)) - (np.cumsum(shared) - shared)[at] + own_early[at] + np.where(late, own_late[at], 0)
        keep = place < prefix_length(n, threshold)[at]
        h, b, at = h[keep], b[keep], at[keep]
        order = np.argsort(b, kind="stable")
        return _cut(b[order], 0, hashes=h[order], sets=ids[at[order]], sizes=n[at[order]])

    return run


def _candidates(threshold):
    a, b = threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sets that share a prefix hash, chained by size where neighbours can still match."""
        h, s, n = _joined(pdf["hashes"], np.uint32), _joined(pdf["sets"], np.int64), _joined(pdf["sizes"], np.int64)
        order = np.lexsort((s, n, h))
        h, s, n = h[order], s[order], n[order]
        ok = (h[1:] == h[:-1]) & (b * n[:-1] >= a * n[1:])
        x, y = local_forest(s[1:][ok], s[:-1][ok]) if ok.any() else (s[:0], s[:0])
        return pd.DataFrame({"a": x, "b": y})

    return run


def bitmaps(flat: np.ndarray, to: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: bit i of a row tells whether an odd number of its hashes fall on i."""
    rows = np.repeat(np.arange(len(to) - 1), np.diff(to))
    odd = np.zeros((len(to) - 1) * bits, np.uint8)
    cell = rows * bits + (flat % U64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(odd)) & 1).astype(np.uint8).reshape(len(to) - 1, bits)
    return np.packbits(odd, axis=1).view(np.uint64)


def tile_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning links of the pairs of a tile that reach the threshold; places in ``sets``.

    left and right are places in ascending order of size; ``same`` if they are one block, of which
    each pair counts once. |A xor B| is at least the number of bits in which two parity bitmaps
    differ, so 2 |A and B| <= |A| + |B| - that number; pairs whose bound is too low are dropped.
    """
    a, b = threshold
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 64
    while bits < 2 * int(sizes.max()) and bits < 1 << 16:
        bits *= 2
    to = np.concatenate([[0], np.cumsum(sizes)])
    maps = bitmaps(np.concatenate(sets), to, bits)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for place, i in enumerate(left.tolist()):
        others = right[place + 1 :] if same else right
        lo = np.searchsorted(sizes[others], -(-a * sizes[i] // b), "left")
        hi = np.searchsorted(sizes[others], sizes[i] * b // a, "right")
        others = others[lo:hi]
        if not len(others):
            continue
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        both = sizes[others] + sizes[i]
        most = (both - apart) // 2
        for j in others[(a + b) * most >= a * both].tolist():
            x, y = find(i), find(j)
            if x == y:
                continue
            x1, x2 = sets[i], sets[j]
            if len(x1) > len(x2):
                x1, x2 = x2, x1
            at = np.searchsorted(x2, x1)
            at[at == len(x2)] = 0
            common = int((x2[at] == x1).sum())
            if b * common >= a * (len(x1) + len(x2) - common):
                parent[max(x, y)] = min(x, y)
                links.append((i, j))
    return links


def _verify(k: int, threshold):
    def run(table: pa.Table) -> pa.Table:
        """Spanning links of one parcel of tiles."""
        flat, to, sizes, found = document_sets(table.column("text"), k)
        tile, side, ids = (table.column(c).to_numpy() for c in ("tile", "side", "set_id"))
        order = np.lexsort((ids, side, sizes, tile))
        order = order[found[order] == ids[order]]  # rows that share a doc_id may have another text
        same = np.zeros(len(order), bool)
        same[1:] = (tile[order][1:] == tile[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (side[order][1:] == side[order][:-1])
        order = order[~same]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(tile[order]) != 0)), len(order)) if len(order) else [0]
        x, y = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            sets = [flat[to[i] : to[i + 1]] for i in at]
            s, places = side[at], np.arange(len(at))
            whole = not s.any()
            for i, j in tile_links(sets, places[s == 0], places if whole else places[s == 1], whole, threshold):
                x.append(ids[at[i]])
                y.append(ids[at[j]])
        a, b = local_forest(np.array(x, np.int64), np.array(y, np.int64)) if x else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(tile_bytes: int, tile_rows: int) -> Column:
    return F.greatest(F.ceil(F.sum("bytes") / tile_bytes), F.ceil(F.count("*") / tile_rows)).cast("long")


def _group_tiles(found: DataFrame, parcels: int) -> DataFrame:
    """(key, set_id, tile, side, parcel) of candidate sets (key, set_id, root, n_blocks, leader): small
    groups are tiles that share parcels; a larger one is cut into blocks, all with its leader."""
    whole = found.where("n_blocks = 1").select("key", "set_id", F.col("root").alias("tile"), F.lit(0).alias("side"), F.pmod(F.xxhash64("root"), F.lit(parcels)).alias("parcel"))
    block = F.pmod(F.xxhash64("set_id"), F.col("n_blocks")).cast("long")
    spots = F.when(F.col("set_id") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).otherwise(F.array(block))
    cut = found.where("n_blocks > 1").select("key", "set_id", "root", F.explode(spots).alias("spot")).select("key", "set_id", F.xxhash64("root", "spot").alias("tile"), F.lit(0).alias("side"))
    return whole.unionByName(cut.withColumn("parcel", F.col("tile")))


def _few_tiles(found: DataFrame) -> DataFrame:
    """(key, set_id, tile, side, parcel) of groups that one component fills but for few sets: these meet
    each other, and each block of the component."""
    rest = found.where("now <> major")
    own = rest.select("key", "set_id", F.xxhash64("root", F.lit(-1)).alias("tile"), F.lit(0).alias("side"))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("long")
    full = found.where("now = major").select("key", "set_id", F.xxhash64("root", block).alias("tile"), F.lit(1).alias("side"))
    spots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    again = rest.select("key", "set_id", "root", spots.alias("spot")).select("key", "set_id", F.xxhash64("root", "spot").alias("tile"), F.lit(0).alias("side"))
    return own.unionByName(full).unionByName(again).withColumn("parcel", F.col("tile"))


def _hash_rows(batches):
    """(root, set_id) of the prefixes' blobs (part, hashes, sets): a row for each hash of a set."""
    for batch in batches:
        for part, h, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.uint32).astype(np.int64) | part << 32), pa.array(np.frombuffer(s, np.int64))], names=["root", "set_id"])


def _tiles(found: DataFrame, threshold: tuple[int, int], tile_bytes: int, tile_rows: int) -> DataFrame:
    """(key, set_id, tile, side, parcel) of sets (key, set_id, n, bytes, root) that meet under hashes.

    The sets of a hash are one tile if their size is bounded, and small tiles share parcels. More sets
    are cut into blocks: bands of sizes of ratio 1/t and, in a band, sub-blocks by hash. Sizes that
    match lie in the same or in neighbouring bands, so tiles are pairs of such blocks.
    """
    blocks = lambda: _blocks(tile_bytes, tile_rows)
    found = join_hot(found, found.groupBy("root").agg(blocks().alias("n_blocks")), "root")
    volume = found.agg(F.sum("bytes")).first()[0] or 0
    parcels = max(1, -(-int(volume) // tile_bytes))
    small = found.where("n_blocks = 1").select("key", "set_id", F.col("root").alias("tile"), F.lit(0).alias("side"), F.pmod(F.xxhash64("root"), F.lit(parcels)).alias("parcel"))
    ratio = threshold[1] / threshold[0]
    large = found.where("n_blocks > 1").withColumn("band", F.floor(F.log("n") / F.log(F.lit(ratio)) + 1e-9).cast("long"))
    bands = large.groupBy("root", "band").agg(blocks().alias("subs"))
    near = lambda d, name: bands.select("root", (F.col("band") + d).alias("band"), F.col("subs").alias(name))
    large = large.join(bands, ["root", "band"]).join(near(1, "below"), ["root", "band"], "left").join(near(-1, "above"), ["root", "band"], "left")
    large = large.withColumn("sub", F.pmod(F.xxhash64("set_id"), F.col("subs")))
    band, sub = F.col("band"), F.col("sub")

    def pairs(b, n, side, own=False):
        up = F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
        one = lambda s: F.struct((band if side == 0 else b).alias("b1"), (sub if side == 0 else s).alias("s1"), (b if side == 0 else band).alias("b2"), (s if side == 0 else sub).alias("s2"), F.lit(side).alias("side"))
        return F.transform(F.filter(up, lambda s: s >= sub if side == 0 else s < sub) if own else up, one)

    tiles = F.concat(pairs(band, F.col("subs"), 0, True), pairs(band, F.col("subs"), 1, True), pairs(band + 1, F.col("above"), 0), pairs(band - 1, F.col("below"), 1))
    large = large.select("key", "set_id", "root", F.explode(tiles).alias("t")).select("key", "set_id", F.xxhash64("root", "t.b1", "t.s1", "t.b2", "t.s2").alias("tile"), "t.side")
    return small.unionByName(large.withColumn("parcel", F.col("tile")))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), tile_bytes: int = 4 << 20, tile_rows: int = 1024, pair_blocks: int = 64, bucket_hashes: int = 1 << 20, one_in: int = 64, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, keeper_key) of every row of docs (doc_id, text). key
    is row_key(), keeper_key that of the row of the component that a deduplication keeps.

    A row's set is its distinct k-word shingles (words of lower-cased A-Z text between space and
    tab to carriage return; shorter texts are one shingle). Rows whose sets reach the threshold
    (a, b), b * intersection >= a * union, are linked; component_id is the smallest doc_id of the
    rows reached by links. Null, empty or wordless text has an empty set, linked with nothing: its
    component_id is its own doc_id. Repeated rows come back as often as they went in. A null doc_id
    is passed over as the smallest; a component without any other has a null component_id. No rows
    give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = tasks_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1
    while buckets * bucket_hashes * 12 < size:  # English has about one hash of the first half in 12 characters
        buckets *= 2
    frequent = spark.sparkContext.broadcast(_frequent(docs, k, one_in))
    scanned = staged(docs.mapInArrow(lean(lambda b: _count_pass(b, k, threshold, buckets, frequent)), "doc_id long, key long, set_id long, n long, n_early long, n_rare long, h long, bucket long, hashes binary, sets binary, runs binary"), "shingles", tasks)
    nodes = scanned.where("bucket is null and h is null").select("doc_id", "key", "set_id", "n", "n_early", "n_rare")
    # frequent hashes in prefixes: a node of its own for each, which the sets are joined to
    often = scanned.where("h is not null").select("set_id", F.xxhash64("h", F.lit(17)).alias("root")).distinct()
    by_set = nodes.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("n_early").alias("n_early"), F.first("n_rare").alias("n_rare"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("head"))
    blobs = scanned.where("bucket is not null").select("bucket", "hashes", "sets", "runs")
    shared = blobs.groupBy("bucket").applyInPandas(lean_group(_shared_hashes(buckets)), "part long, bucket long, hashes binary, sets binary, counts binary")
    grouped = by_set.select("set_id", "n", "n_early", "n_rare", F.when(F.col("set_id") >= 0, F.pmod("set_id", F.lit(buckets))).otherwise(F.pmod(F.pmod("set_id", F.lit(buckets)) + (2**64 % buckets), F.lit(buckets))).alias("part"))
    prefixes = shared.groupBy("part").cogroup(grouped.groupBy("part")).applyInPandas(_prefixes(threshold, buckets), "part long, bucket long, hashes binary, sets binary, sizes binary")
    prefixes = staged(prefixes, "prefixes", tasks)
    edges = prefixes.groupBy("part").applyInPandas(lean_group(_candidates(threshold)), "a long, b long")
    groups = components(edges.unionByName(often.select(F.col("set_id").alias("a"), F.col("root").alias("b"))), "candidates", tasks)
    found = staged(by_set.join(groups, F.col("set_id") == F.col("node")).select("set_id", "key", "n", (F.col("n") * 8).alias("bytes"), "root"), "candidate-sets", tasks)
    found = staged(join_hot(found, found.groupBy("root").agg(_blocks(tile_bytes, tile_rows).alias("n_blocks"), F.min("set_id").alias("leader")), "root"), "grouped-sets", tasks)
    parcels = max(1, -(-int(found.agg(F.sum("bytes")).first()[0] or 0) // tile_bytes))

    def verified(tiles: DataFrame, name: str) -> DataFrame:
        tiles = staged(tiles, f"{name}-tiles", tasks)
        near = F.broadcast(tiles) if tiles.count() <= broadcast_rows else tiles  # 40 bytes a row
        rows = docs.select("key", "text").join(near, "key").select("parcel", "tile", "side", "set_id", "text")
        return staged(rows.groupBy("parcel").applyInArrow(lean_group(_verify(k, threshold)), "a long, b long"), name, tasks)

    pairs = verified(_group_tiles(found, parcels), "pairs")
    large = found.where("n_blocks > 1")
    if not large.isEmpty():
        now = components(pairs, "settled", tasks)
        large = staged(large.join(now.withColumnRenamed("root", "r"), F.col("set_id") == F.col("node"), "left").select("set_id", "key", "n", "bytes", "root", "n_blocks", F.coalesce("r", "set_id").alias("now")), "large", tasks)
        classes = large.groupBy("root", "now").agg(F.count("*").alias("c"), F.first("n_blocks").alias("n_blocks"))
        apart = classes.groupBy("root").agg(F.max(F.struct("c", "now")).alias("most"), (F.sum("c") - F.max("c")).alias("others"), F.count("*").alias("classes"), F.first("n_blocks").alias("blocks")).where("classes > 1")
        few = F.col("others") <= tile_rows
        way = F.when(few, "few").when(F.col("blocks") <= pair_blocks, "blocks").otherwise("hashes")
        rest = staged(join_hot(large, apart.select("root", F.col("most.now").alias("major"), "blocks", way.alias("way")), "root"), "unsettled", tasks)
        ways = {r[0] for r in rest.select("way").distinct().collect()}
        if "few" in ways:
            pairs = pairs.unionByName(verified(_few_tiles(rest.where("way = 'few'")), "few-pairs"))
        if "blocks" in ways:
            pairs = pairs.unionByName(verified(_tiles(rest.where("way = 'blocks'").select("key", "set_id", "n", "bytes", "root"), threshold, tile_bytes, tile_rows), "block-pairs"))
        if "hashes" in ways:
            rows = prefixes.select("part", "hashes", "sets").mapInArrow(_hash_rows, "root long, set_id long").distinct().unionByName(often.select("root", "set_id"))
            rows = staged(rows.join(rest.where("way = 'hashes'").select("set_id", "key", "n", "bytes", "now"), "set_id"), "hash-sets", tasks)
            mixed = rows.groupBy("root").agg(F.min("now").alias("lo"), F.max("now").alias("hi")).where("lo <> hi").select("root")
            rows = staged(join_hot(rows, mixed, "root").drop("now"), "apart", tasks)
            pairs = pairs.unionByName(verified(_tiles(rows, threshold, tile_bytes, tile_rows), "hash-pairs"))
    links = components(pairs, "links", tasks)
    sets = by_set.select("set_id", "doc_id", "head").join(links, F.col("set_id") == F.col("node"), "left").select("set_id", "doc_id", "head", F.coalesce("root", "set_id").alias("root"))
    least = sets.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("head").alias("first"))
    labels = sets.join(least, "root").select("set_id", "component_id", F.col("first.key").alias("keeper_key"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "keeper_key"]
    empty = nodes.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("keeper_key", F.col("key")).select(columns)
    return nodes.where("n > 0").join(labels, "set_id").select(columns).unionByName(empty)


def row_key() -> Column:
    """Tells rows (doc_id, text) apart; equal for repeated rows."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def one_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id (a null one
    last), and one of rows that repeat doc_id and text. Rows without words all stay."""
    found = staged(jaccard_components(docs).select("key", "keeper_key", "n_shingles"), "components", tasks_for(docs))
    gone = found.where("key <> keeper_key").select("key").distinct()
    if gone.count() <= broadcast_rows:  # 8 bytes a row
        gone = F.broadcast(gone)
    rows = docs.select(row_key().alias("key"), rows_of(docs))
    left = rows.join(gone, "key", "left_anti")
    again = found.where("key = keeper_key and n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    again = staged(again, "repeated", tasks_for(docs))
    if not again.isEmpty():
        once = left.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        left = left.join(again, "key", "left_anti").select("key", "row").unionByName(once)
    return left.select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
