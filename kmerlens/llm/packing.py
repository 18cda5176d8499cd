"""Best-fit packing of token sequences: bounded-space online best fit over a bitset of free space."""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, staged, string_buffers, tasks_for

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict = {}


class Encoder:
    """Ids of a public byte-level BPE vocabulary, as the tokenizers library gives them: the strings of
    its special tokens are these tokens. The rank file beside a ``.json`` vocabulary holds the same
    merges and is five times as fast; tests compare the two. Its pattern tracks back over runs of white
    space and its merges take the square of a run's length, so texts with long runs go to the tokenizers
    library."""

    #: Bytes of white space, and of any other character, that may stand in a row.
    LONGEST = 1000

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = tuple(special)
        # looking for special tokens doubles the time, so the first one knows none
        self.fast, self.marked = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=x) for x in ({}, special))
        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str, plain: bool) -> np.ndarray:
        if plain and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if plain:
            return self.marked.encode_to_numpy(text, allowed_special="all")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


#: ASCII white space, and all bytes that stand in the UTF-8 of other white space.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0x85, 0xA0, 0xE1, 0x9A, 0xE2, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x81, 0x9F, 0xE3]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x09, 0x0E), 0x20]] = True


def without_long_runs(raw: np.ndarray, offs: np.ndarray, most: int = Encoder.LONGEST) -> np.ndarray:
    """Of each row, whether no run of bytes of white space, or of others, is longer than ``most``: a
    longer one fills one of the blocks of half as many bytes. Rows of shorter runs may be told to have
    one, if these fill a block."""
    plain, step = np.ones(len(offs) - 1, bool), most // 2
    blocks = raw[: len(raw) // step * step].reshape(-1, step)
    for kind in (_BLANK, ~_BREAK):
        for at in np.flatnonzero(kind[blocks].all(axis=1)) * step:
            # all rows that have bytes of the block
            plain[max(0, np.searchsorted(offs, at, "right") - 1) : np.searchsorted(offs, at + step, "left")] = False
    return plain


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def tokenize(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids, then end_id, cut into capacity tokens where longer.

    Null text is empty and gives the single id end_id. Only the first piece of a cut document is
    shorter than capacity. ``with_ids`` adds the piece's ids. Repeated rows give repeated pieces, a
    null doc_id stays null, and no rows give no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            raw, offs = string_buffers(batch.column(1))
            data, plain = raw.tobytes(), without_long_runs(raw, offs).tolist()
            rows = []
            for doc, fast, lo, hi in zip(batch.column(0).to_pylist(), plain, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                ids = np.append(enc.encode(data[lo:hi].decode("utf-8", "replace"), fast), end_id).astype("<u4")
                cuts = list(range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity))
                for piece, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each item in the order given, and the bins still open at the end.

    Bit f of ``bits`` is set while an open bin has f free places. An item goes to the open bin
    with the least free space that holds it, else to a new bin. Above open_bins open bins the
    fullest one closes. A full bin closes by itself.
    """
    bits, count, made = 0, 0, 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = [], []
    for n in lengths:
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            count -= 1
            if not stack:
                bits ^= 1 << free
        else:
            b, free, made = made, capacity, made + 1
        bins.append(b)
        offsets.append(capacity - free)
        free -= n
        if free:
            stacks[free].append(b)
            bits |= 1 << free
            count += 1
            if count > open_bins:
                least = (bits & -bits).bit_length() - 1
                stacks[least].pop()
                count -= 1
                if not stacks[least]:
                    bits ^= 1 << least
    return bins, offsets, [b for s in stacks for b in s]


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 256, leaf_rows: int = 16384, fan_in: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces are dealt by a hash of id and contents into leaves of about leaf_rows (rows without an id
    spread as well; rows that agree in all of it meet), so every leaf sees the same mix of lengths and the result depends on the rows alone, not on partitions or retries. Bins that a
    leaf leaves open (open_bins at most) are items of the next level, where fan_in leaves meet;
    one tree node at the end closes the last bins. No task holds more than a leaf or
    fan_in * open_bins bins.
    """
    pieces = staged(pieces, "pieces")
    tasks = tasks_for(pieces, 1 << 20)
    leaves = max(1, -(-pieces.count() // leaf_rows))
    own = [f.name for f in pieces.schema]

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offs, still = best_fit(pdf["length"].tolist(), capacity, open_bins)
        return pdf.assign(bin=bins, place=offs, open=np.isin(bins, still))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    node = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(leaves)).cast("long")
    level0 = staged(pieces.withColumn("node", node).groupBy("node").applyInPandas(leaf, f"{schema}, node long, bin long, place long, open boolean"), "packed", tasks)
    base = F.lit(1 << 30)
    placed = level0.select(*own, (F.col("node") * base + F.col("bin")).alias("bin"), "place", "open")
    open_now = level0.where("open").groupBy((F.col("node") * base + F.col("bin")).alias("bin"), "node").agg(F.sum("length").alias("fill"))
    level, nodes, moves = 0, leaves, None
    while True:
        level, nodes = level + 1, -(-nodes // fan_in)

        def inner(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin", ignore_index=True)
            bins, offs, still = best_fit(pdf["fill"].tolist(), capacity, open_bins)
            return pdf.assign(to=bins, shift=offs, open=np.isin(bins, still))

        met = open_now.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        step = staged(met.groupBy("node").applyInPandas(inner, "bin long, node long, fill long, to long, shift long, open boolean"), f"packed{level}", tasks)
        step = step.withColumn("to", F.lit(level << 58) + F.col("node") * base + F.col("to"))
        now = step.select("bin", "to", "shift")
        if moves is None:
            moves = now
        else:
            onward = now.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
            moves = moves.join(onward, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        if nodes == 1:
            break
        open_now = step.where("open").groupBy(F.col("to").alias("bin"), "node").agg(F.sum("fill").alias("fill"))
    out = placed.where("not open").select(*own, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moved = placed.where("open").join(moves, "bin").select(*own, F.col("to").alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset"))
    return out.unionByName(moved)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenize(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
