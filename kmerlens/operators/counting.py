"""k-mer counting over sequences.

Windows are encoded by a rolling NumPy pass over Arrow batches: a string of 16 letters per window,
as built-in functions would make, costs about a microsecond each, while the codes of a whole batch
cost a few nanoseconds each and leave Python already grouped. Everything after the codes
(grouping, joining, summing) is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases that are encoded at once; temporaries take about 80 bytes each.
SEGMENT = 1 << 20
#: Candidates that a prefilter knows by their codes, 8 bytes each, and the bits of its map at most.
EXACT_CODES, MAP_BITS = 1 << 22, 27
#: Windows that a task gathers before it deals them, and bases for each bucket that they are dealt to.
HOLD, BUCKET = 1 << 22, 1 << 22
_MIX = 0x9E3779B97F4A7C15
_BASE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _c in _letters:
        _BASE[ord(_c)] = _i


def _least(bits: int) -> type:
    """The smallest unsigned type of so many bits."""
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= 8 * t().itemsize)


def _rolling(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows without a code 4, their codes, codes of their reverse complements)."""
    n = len(codes) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    # doubling: codes of 1, 2, 4, ... bases, joined along the bits of k, each in the smallest type that holds it
    part, other, bad, have = codes & 3, ~codes & 3, codes > 3, 1
    forward = reverse = broken = None
    done = 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            # the run so far stands in front of the next one, its complement behind
            piece, turned, gap = part[done : done + n], other[done : done + n], bad[done : done + n]
            if done:
                t = _least(2 * (done + have))
                piece, turned = forward[:n].astype(t) << t(2 * have) | piece, turned.astype(t) << t(2 * done) | reverse
                gap = broken | gap
            forward, reverse, broken = piece, turned, gap
            done += have
        if k >> (bit + 1):
            t = _least(4 * have)
            part, other = part.astype(t), other.astype(t)
            part, other = part[:-have] << t(2 * have) | part[have:], other[have:] << t(2 * have) | other[:-have]
            bad = bad[:-have] | bad[have:]
            have *= 2
    at = np.flatnonzero(~broken)
    return at, forward[at].astype(np.int64), reverse[at].astype(np.int64)


def reverse_complements(codes: np.ndarray, k: int) -> np.ndarray:
    x = ~codes & ((1 << 2 * k) - 1)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        u = x.view(np.uint64)
        x = ((u >> np.uint64(shift) & np.uint64(mask)) | (u & np.uint64(mask)) << np.uint64(shift)).view(np.int64)
    return (x.view(np.uint64) >> np.uint64(64 - 2 * k)).view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def _pieces(raw: np.ndarray, offs: np.ndarray, k: int):
    """Runs of rows of about SEGMENT bases, and pieces of longer rows that overlap by k - 1: (bytes, offsets,
    first row, place in that row)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SEGMENT, "right")) - 1)
        if offs[hi] - offs[lo] <= SEGMENT + k:
            yield raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, 0
        else:
            for at in range(int(offs[lo]), int(offs[hi]) - k + 1, SEGMENT):
                end = min(at + SEGMENT + k - 1, int(offs[hi]))
                yield raw[at:end], np.array([0, end - at]), lo, at - int(offs[lo])
        lo = hi


def cell(codes: np.ndarray, bits: int) -> np.ndarray:
    """One of 2^bits cells for each code, by the high bits of a product: all bases take part."""
    return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


@dataclass(frozen=True)
class Prefilter:
    """Which codes are candidates: a map of 2^bits bits, by a code's low bits mixed with the next ones,
    and, of not too many candidates, their codes in order. Without codes it lets some others pass. With
    ``mixed`` the map is of cells (``cell``), and all codes of a marked cell pass."""

    bits: int
    marks: np.ndarray
    codes: np.ndarray | None
    mixed: bool = False

    @staticmethod
    def place(codes: np.ndarray, bits: int) -> np.ndarray:
        return (codes ^ codes >> bits) & ((1 << bits) - 1)

    @property
    def exact(self) -> bool:
        return self.codes is not None

    def which(self, codes: np.ndarray) -> np.ndarray:
        """Places in ``codes`` of those that pass."""
        at = cell(codes, self.bits) if self.mixed else self.place(codes, self.bits)
        hit = np.flatnonzero(self.marks[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if self.codes is None or not len(hit):
            return hit
        found = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
        return hit[self.codes[found] == codes[hit]]


def prefilter(candidates: DataFrame, exact: int = EXACT_CODES, bits: int = MAP_BITS) -> Broadcast | None:
    """A broadcast Prefilter of candidates (code): windows that are none of them never leave Python. Up to
    ``exact`` candidates are held by their codes; of more, up to a quarter of the map's bits, only the
    map goes to the tasks (16 MB by default), built by Spark in rows of 4 KB, and what passes it still
    has to meet its candidate. Beyond that None: the map would pass most windows, and joining them by
    code, which deals both sides to shards, is the better way."""
    spark = candidates.sparkSession
    codes = candidates.select("code").where("code is not null").distinct()
    some = codes.limit(exact + 1).toArrow().column(0).to_numpy()
    if len(some) <= exact:
        bits = max(15, min(bits, len(some).bit_length() + 5))
        marks = np.zeros(1 << (bits - 3), np.uint8)
        at = Prefilter.place(some, bits)
        np.bitwise_or.at(marks, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return spark.sparkContext.broadcast(Prefilter(bits, marks, np.sort(some)))
    if codes.count() > 1 << (bits - 2):
        return None
    marks = np.zeros((1 << (bits - 15), 4096), np.uint8)
    place = F.col("code").bitwiseXOR(F.shiftright("code", bits)).bitwiseAND((1 << bits) - 1)
    for row in _bitmap(codes, place + 1).toLocalIterator():  # bucket 1 starts at 1
        marks[row["bucket"] - 1] = np.frombuffer(row["bitmap"], np.uint8)
    return spark.sparkContext.broadcast(Prefilter(bits, marks.reshape(-1), None))


def windows(sequences: DataFrame, k: int = 16, keys: list[str] | None = None, positions: bool = False, only: Broadcast | None = None, cells: int | None = None) -> DataFrame:
    """Canonical windows of sequences (keys, seq): (keys, code, strand, n) summed within pieces of
    about SEGMENT bases, or (keys, code, strand, start) of every window. A longer row is walked in
    pieces, so memory beside the row itself is bounded. strand is 1 where the reverse complement
    is the smaller one; a palindrome has strand 0. Windows hold ACGT only, in either case, and never
    span two rows. Null or short sequences have no window. With ``only``, a prefilter, other windows than
    those that it lets pass are left out before anything is sorted, counted or given to Spark. With ``cells``,
    bits of a cell, and no keys, rows are (code, strand, n) of cells instead of codes, strand 0, one row for
    each cell in about every 2^(cells + 4) bases."""
    keys = [c for c in sequences.columns if c != "seq"] if keys is None else keys
    rows = sequences.select(*keys, "seq")

    def windows_of(raw, offs, first, shift):
        """Rows of the windows of some rows, or of one piece of a long one that starts at ``shift``."""
        codes = np.insert(_BASE[raw], offs[1:-1], 4) if len(offs) > 2 else _BASE[raw]
        at, f, r = _rolling(codes, k)
        starts = offs + np.arange(len(offs))
        code, strand = np.minimum(f, r), (f > r).astype(np.int32)
        if only is not None:
            hit = only.value.which(code)
            at, code, strand = at[hit], code[hit], strand[hit]
        row = np.searchsorted(starts, at, "right") - 1
        if positions:
            return row + first, code, strand, at - starts[row] + shift
        if len(offs).bit_length() + 2 * k < 64:
            key = np.sort((row << (2 * k + 1) | code << 1 | strand).view(np.uint64)).view(np.int64)
            row, code, strand = key >> (2 * k + 1), key >> 1 & ((1 << 2 * k) - 1), (key & 1).astype(np.int32)
        else:
            order = np.lexsort((strand, code, row))
            row, code, strand = row[order], code[order], strand[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (strand[1:] != strand[:-1]))) if len(row) else row
        return row[new] + first, code[new], strand[new], np.diff(np.append(new, len(row)))

    def sums(batches):
        """Counts of cells, given on when they hold 16 windows a cell."""
        count, held = np.zeros(1 << cells, np.int64), 0

        def out():
            at = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int32)), pa.array(count[at])], names=["code", "strand", "n"])

        for batch in batches:
            for raw, offs, _, _ in _pieces(*_buffers(batch.column(0)), k):
                _, f, r = _rolling(np.insert(_BASE[raw], offs[1:-1], 4) if len(offs) > 2 else _BASE[raw], k)
                np.add(count, np.bincount(cell(np.minimum(f, r), cells), minlength=1 << cells), out=count)
                held += len(f)
                if held >= 16 << cells:
                    yield out()
                    count[:], held = 0, 0
        if held:
            yield out()

    def run(batches):
        name = "start" if positions else "n"
        for batch in batches:
            for piece in _pieces(*_buffers(batch.column(len(keys))), k):
                row, code, strand, extra = windows_of(*piece)
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(code), pa.array(strand), pa.array(extra)], names=[*keys, "code", "strand", name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInArrow(sums if cells else run, f"{types + ', ' if keys else ''}code long, strand int, {'start' if positions else 'n'} long")


def counted_twice(sequences: DataFrame, by: list[str], union: Column, part: Column, k: int = 16) -> DataFrame:
    """(keys, code, n, net) of sequences (keys, seq), counted in two ways that leave only sums behind.

    Rows without a code: the windows of each key, as sums of the counts of its k-mers, one row for about HOLD
    windows. Rows with a code: how often more the k-mer was counted in the sequences of the ``union``, by the
    keys ``by`` alone (others are null), than its counts by all keys in those of a ``part`` add up to, where it
    is not as often. Both countings are made of the same HOLD windows, each from all of them, so what agrees is
    known there and is not shuffled; sums of ``net`` are those of all windows."""
    keys = [c for c in sequences.columns if c != "seq"]
    rows = sequences.select(*keys, F.coalesce(union, F.lit(False)).alias("_union"), F.coalesce(part, F.lit(False)).alias("_part"), "seq")
    width, own = 2 * k, [keys.index(c) for c in by]

    def runs(kind: np.ndarray, code: np.ndarray):
        """(kinds, codes, counts) of the windows, each k-mer of a kind once, in order."""
        if len(kind) and int(kind.max()) >> (63 - width) == 0:
            key = np.sort((kind << width | code).view(np.uint64)).view(np.int64)
            kind, code = key >> width, key & ((1 << width) - 1)
        else:
            order = np.lexsort((code, kind))
            kind, code = kind[order], code[order]
        at = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (code[1:] != code[:-1]))) if len(kind) else kind
        return kind[at], code[at], np.diff(np.append(at, len(kind)))

    def run(batches):
        known: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(types):
            kind, code = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            kinds = list(known)
            groups = {g: i for i, g in enumerate(dict.fromkeys(tuple(t[i] for i in own) for t in kinds))}
            group = np.array([groups[tuple(t[i] for i in own)] for t in kinds], np.int64)
            in_union, in_part = (np.array([t[i] for t in kinds], bool) for i in (-2, -1))
            of, kmer, n = runs(kind, code)
            total = np.bincount(of, n, len(kinds)).astype(np.int64)
            seen = np.flatnonzero(total)
            these = in_union[kind]
            mine = runs(group[kind[these]], code[these])
            these = in_part[of]
            # the counts of a part are taken off: sums by group and k-mer of both, those that are zero left out
            both = [np.concatenate(c) for c in zip(mine, (group[of[these]], kmer[these], -n[these]), strict=True)]
            order = np.argsort(both[0] << width | both[1], kind="stable") if len(groups) >> (63 - width) == 0 else np.lexsort((both[1], both[0]))
            g, c, n = (x[order] for x in both)
            at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))) if len(g) else g
            net = np.add.reduceat(n, at) if len(g) else n
            at, net = at[net != 0], net[net != 0]
            names = list(groups)
            columns = [pa.array([kinds[i][j] for i in seen] + ([names[x][own.index(j)] for x in g[at]] if j in own else [None] * len(at)), types[j]) for j in range(len(keys))]
            code = pa.array([None] * len(seen) + c[at].tolist(), pa.int64())
            n, net = pa.array(total[seen].tolist() + [None] * len(at), pa.int64()), pa.array([None] * len(seen) + net.tolist(), pa.int64())
            return pa.RecordBatch.from_arrays([*columns, code, n, net], names=[*keys, "code", "n", "net"])

        for batch in batches:
            types = [batch.column(i).type for i in range(len(keys))]
            tuples = zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 2)), strict=True)
            kind = np.array([known.setdefault(t, len(known)) for t in tuples], np.int64)
            for raw, offs, row, _ in _pieces(*_buffers(batch.column(len(keys) + 2)), k):
                at, f, r = _rolling(np.insert(_BASE[raw], offs[1:-1], 4) if len(offs) > 2 else _BASE[raw], k)
                held.append((kind[np.searchsorted(offs + np.arange(len(offs)), at, "right") - 1 + row], np.minimum(f, r)))
                size += len(at)
                if size >= HOLD:
                    yield out(types)
                    size = 0
        if size:
            yield out(types)

    return rows.mapInArrow(run, f"{key_types(sequences, keys)}code long, n long, net long")


def near(sequences: DataFrame, queries: list[int], k: int = 16, keys: list[str] | None = None, radius: int = 2) -> DataFrame:
    """(query, keys, d, n): windows of sequences (keys, seq) within the radius of each query (a code), by the
    lesser distance of the two orientations. Every window is held against every query, with no list of variants
    and no prefilter, so it checks those; only sums of what is near leave Python. For a few queries."""
    keys = [c for c in sequences.columns if c != "seq"] if keys is None else keys
    rows, t = sequences.select(*keys, "seq"), _least(2 * k)
    ones = t(0x5555555555555555 & ((1 << 2 * k) - 1))

    def apart(codes: np.ndarray, query: int) -> np.ndarray:
        x = codes ^ t(query)
        return np.bitwise_count((x | x >> t(1)) & ones)

    def run(batches):
        for batch in batches:
            for raw, offs, first, _ in _pieces(*_buffers(batch.column(len(keys))), k):
                at, f, r = _rolling(np.insert(_BASE[raw], offs[1:-1], 4) if len(offs) > 2 else _BASE[raw], k)
                starts, f, r = offs + np.arange(len(offs)), f.astype(t), r.astype(t)
                for query in queries:
                    d = np.minimum(apart(f, query), apart(r, query))
                    hit = np.flatnonzero(d <= radius)
                    if len(hit):
                        row = np.searchsorted(starts, at[hit], "right") - 1 + first
                        found, n = np.unique(row * (radius + 1) + d[hit], return_counts=True)
                        take = pa.array(found // (radius + 1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query, np.int64)), *(batch.column(i).take(take) for i in range(len(keys))), pa.array((found % (radius + 1)).astype(np.int32)), pa.array(n)], names=["query", *keys, "d", "n"])

    parts = rows.mapInArrow(run, f"query long, {key_types(sequences, keys)}d int, n long")
    return parts.groupBy("query", *keys, "d").agg(F.sum("n").alias("n"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small file would be one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.sparkSession.sparkContext.master.startswith("local[") else df


def _numbered(columns: list[pa.Array], rows: int, known: dict[tuple, int]) -> np.ndarray:
    """The number of each row's keys in ``known``, which takes new ones in; no row is looked at by itself."""
    try:
        parts = [c.dictionary_encode(null_encoding="encode") for c in columns]
    except pa.ArrowNotImplementedError:
        return np.array([known.setdefault(t, len(known)) for t in zip(*(c.to_pylist() for c in columns), strict=True)], np.int64)
    sizes, place = [max(1, len(p.dictionary)) for p in parts], np.zeros(rows, np.int64)
    for part, size in zip(parts, sizes, strict=True):
        place = place * size + part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    every = int(np.prod(sizes, dtype=object))
    if every <= max(1 << 16, rows):
        found = np.flatnonzero(np.bincount(place, minlength=every))
        turn = np.zeros(every, np.int64)
    else:
        found, place = np.unique(place, return_inverse=True)
        turn = np.zeros(len(found), np.int64)
    at, values = found, []
    for part, size in zip(reversed(parts), reversed(sizes), strict=True):
        values.insert(0, part.dictionary.take(pa.array(at % size)).to_pylist())
        at = at // size
    numbers = [known.setdefault(t, len(known)) for t in (zip(*values, strict=True) if values else [()] * len(found))]
    turn[found if len(turn) == every else slice(None)] = numbers
    return turn[place]


def _in_order(key: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and their counts beside them: sorted as one number where counts fit the
    bits that are left, which takes a tenth of the time that sorting places does."""
    free = 64 - bits
    if len(n) and 0 <= int(n.min()) and int(n.max()) >> free == 0:
        both = np.sort(key << np.uint64(free) | n.astype(np.uint64))
        return both >> np.uint64(free), (both & np.uint64((1 << free) - 1)).astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def _dealt(k: int, bits: int, nkeys: int, counted: bool):
    """Rows (keys, bucket, low, high, n) of rows (keys, seq), or (keys, code, n) if they are counted already:
    the windows of about HOLD bases by key and bucket, sorted and each once, with their counts. A window is
    its mixed code, of which the bucket has the first ``bits``, and its strand, cut into two runs of bytes."""
    mask, rest = np.uint64((1 << 2 * k) - 1), 2 * k + 1 - bits

    def run(batches):
        known: dict[tuple, int] = {}
        held: list[tuple] = []

        def add(kind, codes, strand, n):
            held.append((kind.astype(np.uint32), (codes.view(np.uint64) * np.uint64(_MIX) & mask) << np.uint64(1) | strand.astype(np.uint64), n))

        def out():
            kind, value = (np.concatenate([h[i] for h in held]) for i in range(2))
            n = np.concatenate([h[2] for h in held]) if counted else None
            held.clear()
            kinds, types = list(known), key_types
            if len(kinds) >> (63 - 2 * k) == 0 and not counted:
                both = np.sort(kind.astype(np.uint64) << np.uint64(2 * k + 1) | value)
                kind, value = (both >> np.uint64(2 * k + 1)).astype(np.uint32), both & np.uint64((2 << 2 * k) - 1)
            elif len(kinds) >> (63 - 2 * k) == 0:
                both, n = _in_order(kind.astype(np.uint64) << np.uint64(2 * k + 1) | value, n, 2 * k + 1 + len(kinds).bit_length())
                kind, value = (both >> np.uint64(2 * k + 1)).astype(np.uint32), both & np.uint64((2 << 2 * k) - 1)
            else:
                order = np.lexsort((value, kind))
                kind, value = kind[order], value[order]
                n = n[order] if counted else None
            at = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])))
            n = np.add.reduceat(n, at) if counted else np.diff(np.append(at, len(value)))
            kind, value = kind[at], value[at]
            bucket = (value >> np.uint64(rest)).astype(np.int64)
            first = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1])))
            value &= np.uint64((1 << rest) - 1)
            ends = np.append(first, len(value))

            def blobs(x):
                return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

            kinds = [pa.array([t[i] for t in kinds], types[i]).take(pa.array(kind[first])) for i in range(nkeys)]
            parts = (value & np.uint64(0xFFFF)).astype(np.uint16), (value >> np.uint64(16)).astype(np.uint16 if rest <= 32 else np.uint64), n.astype(np.int64)
            return pa.RecordBatch.from_arrays([*kinds, pa.array(bucket[first]), *map(blobs, parts)], names=[*key_names, "bucket", "low", "high", "n"])

        size = 0
        for batch in batches:
            key_types, key_names = [batch.column(i).type for i in range(nkeys)], batch.schema.names[:nkeys]
            kind = _numbered([batch.column(i) for i in range(nkeys)], batch.num_rows, known)
            if counted:
                codes, n = (batch.column(nkeys + i).to_numpy() for i in range(2))
                add(kind, codes, np.zeros(len(codes), np.int64), n)
                size += len(codes)
            else:
                for raw, offs, row, _ in _pieces(*_buffers(batch.column(nkeys)), k):
                    at, f, r = _rolling(np.insert(_BASE[raw], offs[1:-1], 4) if len(offs) > 2 else _BASE[raw], k)
                    starts = offs + np.arange(len(offs))
                    add(kind[np.searchsorted(starts, at, "right") - 1 + row], np.minimum(f, r), f > r, None)
                    size += len(at)
                    if size >= HOLD:
                        yield out()
                        size = 0
            if size >= HOLD:
                yield out()
                size = 0
        if size:
            yield out()

    return run


@dataclass(frozen=True)
class Tally:
    """The windows of one bucket in order of their mixed codes, then of their keys and strands, each once:
    codes, keys (rows of ``kinds``, in order of their columns), strands and counts."""

    kinds: pa.Table
    code: np.ndarray
    kind: np.ndarray
    strand: np.ndarray
    n: np.ndarray

    def firsts(self, *by: np.ndarray) -> np.ndarray:
        """Where runs of equal codes (and values of ``by``) start."""
        new = self.code[1:] != self.code[:-1]
        for x in by:
            new |= x[1:] != x[:-1]
        return np.flatnonzero(np.append(True, new))

    def rows(self, at: np.ndarray, **columns: np.ndarray) -> pa.Table:
        """The keys of the windows ``at``, and columns."""
        table = self.kinds.take(pa.array(self.kind[at]))
        names = [c for c in table.column_names if c != "_"]
        return pa.table([*(table.column(c) for c in names), *map(pa.array, columns.values())], names=[*names, *columns])


def _tally(table: pa.Table, k: int, bits: int, keys: list[str]) -> Tally:
    rest = 2 * k + 1 - bits

    def flat(name, dtype):
        column = table.column(name).combine_chunks()
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(dtype), np.diff(offs)

    (low, size), (high, _), (n, _) = flat("low", np.uint16), flat("high", np.uint16 if rest <= 32 else np.uint64), flat("n", np.int64)
    value = high.astype(np.uint64) << np.uint64(16) | low
    rows = list(zip(*(table.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * table.num_rows
    kinds = sorted(set(rows), key=lambda t: [(x is not None, x) if x is not None else (False, 0) for x in t])
    place = {t: i for i, t in enumerate(kinds)}
    kind = np.repeat(np.array([place[t] for t in rows], np.uint64), size // 2)
    width = max(1, (len(kinds) - 1).bit_length())
    if rest + width <= 64:
        both, n = _in_order((value >> np.uint64(1)) << np.uint64(width + 1) | kind << np.uint64(1) | value & np.uint64(1), n, rest + width)
        value, kind = (both >> np.uint64(width + 1)) << np.uint64(1) | both & np.uint64(1), both >> np.uint64(1) & np.uint64((1 << width) - 1)
    else:
        order = np.lexsort((value & np.uint64(1), kind, value >> np.uint64(1)))
        value, kind, n = value[order], kind[order], n[order]
    at = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (kind[1:] != kind[:-1])))
    value, kind, n = value[at], kind[at].astype(np.int64), np.add.reduceat(n, at)
    mixed = np.uint64(table.column("bucket")[0].as_py() << (rest - 1)) | value >> np.uint64(1)
    code = mixed * np.uint64(pow(_MIX, -1, 1 << 64)) & np.uint64((1 << 2 * k) - 1)
    schema = pa.schema([table.schema.field(c) for c in keys])
    named = pa.table([pa.array([t[i] for t in kinds], f.type) for i, f in enumerate(schema)], schema=schema) if keys else pa.table({"_": np.zeros(1, np.int8)})
    return Tally(named, code.view(np.int64), kind, (value & np.uint64(1)).astype(np.int64), n)


def tallied(rows: DataFrame, reduce: Callable[[Tally], pa.Table], schema: str, k: int = 16, keys: list[str] | None = None, bases: int | None = None) -> DataFrame:
    """``reduce`` of the windows of each bucket of codes, as rows of ``schema``: all windows of a k-mer, with the
    keys of their sequences (keys, seq), meet in one call, which gives only what is wanted of them. ``rows``
    may be counts (keys, code, n) as well. A row for each window would cost several times as much as its code:
    each task deals sorted runs of codes instead, about 3 bytes a window. There are as many buckets as ``bases``
    (by default the rows are measured; a bound does) asks for, so a call's memory does not grow with the input."""
    counted = "seq" not in rows.columns
    keys = [c for c in rows.columns if c not in ("seq", "code", "n")] if keys is None else keys
    if bases is None:
        bases = rows.agg(F.count("*") if counted else F.sum(F.length("seq"))).first()[0] or 0
    bits = min(2 * k, max(1, (bases // BUCKET).bit_length()))
    if counted:
        rows = rows.where("code is not null")
    some = rows.select(*keys, *(["code", F.col("n").cast("long").alias("n")] if counted else ["seq"]))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in some.select(*keys).schema)
    dealt = some.mapInArrow(_dealt(k, bits, len(keys), counted), types + "bucket long, low binary, high binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(lambda table: reduce(_tally(table, k, bits, keys)), schema)


def key_types(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def spectrum(sequences: DataFrame, k: int = 16, keys: list[str] | None = None, strands: bool = False, bases: int | None = None) -> DataFrame:
    """(keys, code, [strand,] n): how often each canonical k-mer occurs."""
    keys = [c for c in sequences.columns if c != "seq"] if keys is None else keys

    def reduce(t: Tally) -> pa.Table:
        at = t.firsts(t.kind, t.strand) if strands else t.firsts(t.kind)
        return t.rows(at, code=t.code[at], **({"strand": t.strand[at].astype(np.int32)} if strands else {}), n=np.add.reduceat(t.n, at))

    return tallied(sequences, reduce, f"{key_types(sequences, keys)}code long, {'strand int, ' * strands}n long", k, keys, bases)


def multiplicities(sequences: DataFrame, k: int = 16, bases: int | None = None) -> DataFrame:
    """(multiplicity, kmers): how many k-mers occur how often."""

    def reduce(t: Tally) -> pa.Table:
        n, kmers = np.unique(np.add.reduceat(t.n, t.firsts()), return_counts=True)
        return pa.table({"multiplicity": n, "kmers": kmers})

    found = tallied(sequences, reduce, "multiplicity long, kmers long", k, [], bases)
    return found.groupBy("multiplicity").agg(F.sum("kmers").alias("kmers"))


def strand_totals(sequences: DataFrame, least: int = 1, k: int = 16, bases: int | None = None) -> DataFrame:
    """(code, n, f) of k-mers that occur ``least`` times: all windows, and those on the strand of the code."""

    def reduce(t: Tally) -> pa.Table:
        at = t.firsts()
        n, f = np.add.reduceat(t.n, at), np.add.reduceat(np.where(t.strand == 0, t.n, 0), at)
        keep = n >= least
        return pa.table({"code": t.code[at][keep], "n": n[keep], "f": f[keep]})

    return tallied(sequences, reduce, "code long, n long, f long", k, [], bases)


def strand_counts(sequences: DataFrame, keys: list[str], k: int = 16, bases: int | None = None) -> DataFrame:
    """(keys, windows, forward, reverse, kmers, palindromes): windows by strand, different k-mers, and
    windows that are their own reverse complement."""

    def reduce(t: Tally) -> pa.Table:
        m = t.kinds.num_rows
        total = lambda x: np.bincount(t.kind, x, minlength=m).astype(np.int64)
        forward = total(np.where(t.strand == 0, t.n, 0))
        palindromes = total(np.where(t.code == reverse_complements(t.code, k), t.n, 0))
        kmers = np.bincount(t.kind[t.firsts(t.kind)], minlength=m)
        columns = {"windows": total(t.n), "forward": forward, "reverse": total(t.n) - forward, "kmers": kmers, "palindromes": palindromes}
        return pa.table([*(t.kinds.column(c) for c in keys), *map(pa.array, columns.values())], names=[*keys, *columns])

    names = ("windows", "forward", "reverse", "kmers", "palindromes")
    parts = tallied(sequences, reduce, key_types(sequences, keys) + ", ".join(f"{c} long" for c in names), k, keys, bases)
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names))


def compositions(sequences: DataFrame, k: int = 16, bases: int | None = None) -> DataFrame:
    """(code, kmers, windows): k-mers with as many of each base, as long a longest run and the same answer to
    whether they are palindromes, in one row or a few, by one of them."""

    def reduce(t: Tally) -> pa.Table:
        at = t.firsts()
        n, code = np.add.reduceat(t.n, at), t.code[at]
        ones = np.int64(0x5555555555555555 & ((1 << 2 * k) - 1))
        low, high = code & ones, code >> 1 & ones
        run, same = np.ones(len(code), np.int64), ~((low ^ low >> 2) | (high ^ high >> 2)) & ones >> 2
        while same.any():
            run += same > 0
            same &= same >> 2
        kind = (code == reverse_complements(code, k)).astype(np.int64)
        for part in (np.bitwise_count(low & high), np.bitwise_count(low & ~high), np.bitwise_count(high & ~low), run):
            kind = kind << 5 | part
        _, first, place, kmers = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
        return pa.table({"code": code[first], "kmers": kmers, "windows": np.bincount(place, n).astype(np.int64)})

    return tallied(sequences, reduce, "code long, kmers long, windows long", k, [], bases)


def _pooled(t: Tally, pooled_min: int, hap_min: int):
    """(first windows of codes, pooled, largest in one hap, whether it is enough) by the first key."""
    haps = t.kinds.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    hap = haps[t.kind]
    own, at = t.firsts(hap), t.firsts()
    n = np.add.reduceat(t.n, own)
    inner = np.searchsorted(own, at)
    pooled, largest = np.add.reduceat(n, inner), np.maximum.reduceat(n, inner)
    return at, pooled, largest, (pooled >= pooled_min) | (largest >= hap_min)


def sequence_pool(sequences: DataFrame, pooled_min: int, hap_min: int, hap: str = "hap", k: int = 16, bases: int | None = None) -> DataFrame:
    """``pool`` of the k-mers of sequences (hap, seq), without a row for any other k-mer."""

    def reduce(t: Tally) -> pa.Table:
        at, pooled, largest, keep = _pooled(t, pooled_min, hap_min)
        return pa.table({"code": t.code[at][keep], "pooled": pooled[keep], "largest": largest[keep]})

    return tallied(sequences, reduce, "code long, pooled long, largest long", k, [hap], bases)


def pooled_counts(sequences: DataFrame, pooled_min: int, hap_min: int, keys: list[str], k: int = 16, bases: int | None = None) -> DataFrame:
    """(keys, code, strand, n) of the k-mers of ``sequence_pool`` alone; the first of the keys is the hap. All
    windows of a k-mer are in one bucket, so it is known there whether it is pooled."""

    def reduce(t: Tally) -> pa.Table:
        at, _, _, keep = _pooled(t, pooled_min, hap_min)
        these = np.flatnonzero(np.repeat(keep, np.diff(np.append(at, len(t.code)))))
        return t.rows(these, code=t.code[these], strand=t.strand[these].astype(np.int32), n=t.n[these])

    return tallied(sequences, reduce, f"{key_types(sequences, keys)}code long, strand int, n long", k, keys, bases)


def target_counts(sequences: DataFrame, least: int, targets: tuple[str, ...], k: int = 16, bases: int | None = None) -> DataFrame:
    """(region, code, n) of the k-mers of sequences (region, seq) that the target regions hold ``least`` times."""

    def reduce(t: Tally) -> pa.Table:
        region = np.isin(np.array(t.kinds.column("region").to_pylist(), object), targets)
        at, own = t.firsts(), t.firsts(t.kind)
        keep = np.add.reduceat(np.where(region[t.kind], t.n, 0), at) >= least
        n = np.add.reduceat(t.n, own)
        these = np.repeat(keep, np.diff(np.append(np.searchsorted(own, at), len(own))))
        return t.rows(own[these], code=t.code[own[these]], n=n[these])

    return tallied(sequences, reduce, "region string, code long, n long", k, ["region"], bases)


def seeded(sequences: DataFrame, candidates: DataFrame, k: int = 16, keys: list[str] | None = None, strands: bool = False, **limits: int) -> DataFrame:
    """(keys, code, [strand,] n) of the candidates (code) only: the spectrum without the rest, which takes
    no part in any shuffle while the candidates fit a prefilter (``limits`` are its parameters)."""
    only = prefilter(candidates, **limits)
    counted = windows(sequences, k, keys, only=only)
    by = [c for c in counted.columns if c not in ("n", "strand")] + ["strand"] * strands
    counts = counted.groupBy(*by).agg(F.sum("n").alias("n"))
    return counts if only is not None and only.value.exact else restrict(counts, candidates)


def most_frequent(sequences: DataFrame, most: int, k: int = 16, bits: int = 20, store=None) -> DataFrame:
    """(code, n) of the ``most`` most frequent k-mers of sequences (seq), of equal counts those with the
    smaller code, in that order, exactly; fewer if there are no more.

    Only sums of 2^bits cells, by a mix of the code, are dealt for all windows. Those k-mers of the fullest
    cells, counted exactly, set a count that the ``most`` best reach at least; whatever reaches it lies in a
    cell that is as full, and only windows of such cells are counted one by one. Where counts are so even that no
    cell can be left out, all windows are. ``store`` writes the cells (by default ``written``)."""
    from ..plans.written import written

    spark, seq = sequences.sparkSession, sequences.select("seq")
    cells = (store or written)(windows(seq, k, [], cells=bits).groupBy("code").agg(F.sum("n").alias("n")), "cells")
    order = [F.desc("n"), F.asc("code")]

    def of(some: DataFrame) -> DataFrame:
        """Exact counts of the k-mers of some cells (code)."""
        marks = np.zeros(1 << (bits - 3), np.uint8)
        at = some.select("code").toArrow().column(0).to_numpy()  # 2^bits of them at most
        np.bitwise_or.at(marks, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        only = spark.sparkContext.broadcast(Prefilter(bits, marks, None, True))
        return windows(seq, k, [], only=only).groupBy("code").agg(F.sum("n").alias("n"))

    best = of(cells.orderBy(*order).limit(4 * most)).orderBy(*order).limit(most).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    least = best["n"] if best["rows"] == most else 1
    return of(cells.where(F.col("n") >= least)).where(F.col("n") >= least).orderBy(*order).limit(most)


def region_stats(sequences: DataFrame, k: int = 16) -> DataFrame:
    """(keys, bp, acgt_bp, non_acgt_bp, valid_starts) of every row: an ACGT run of length r has
    max(0, r - k + 1) valid starts."""
    runs = F.split(F.col("seq"), "[^ACGTacgt]+")
    acgt = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    starts = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0), F.length(x) - (k - 1)))
    bp = F.length("seq").cast("long")
    return sequences.select(*(c for c in sequences.columns if c != "seq"), bp.alias("bp"), acgt.alias("acgt_bp"), (bp - acgt).alias("non_acgt_bp"), starts.alias("valid_starts"))


def extract(sequences: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per interval with its part of the sequence of its keys."""
    return sequences.join(intervals, keys).select(*intervals.columns, F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))


def pool(counts: DataFrame, pooled_min: int, hap_min: int, key: str = "code", hap: str = "hap") -> DataFrame:
    """(key, pooled, largest): k-mers whose sum over haps or largest count in one hap is enough."""
    by_hap = counts.groupBy(key, hap).agg(F.sum("n").alias("n"))
    return by_hap.groupBy(key).agg(F.sum("n").alias("pooled"), F.max("n").alias("largest")).where((F.col("pooled") >= pooled_min) | (F.col("largest") >= hap_min))


def restrict(counts: DataFrame, candidates: DataFrame, key: str = "code") -> DataFrame:
    """Counts of the candidates only."""
    return counts.join(candidates.select(key), key, "left_semi")


def lookup(counts: DataFrame, key: str, value, candidates: DataFrame) -> DataFrame:
    """Counts of one k-mer; an unknown one is an error, not zero."""
    if candidates.where(F.col(key) == value).isEmpty():
        raise KeyError(f"{value} is not a candidate")
    return counts.where(F.col(key) == value)


def lookup_kmer(counts: DataFrame, kmer: str, candidates: DataFrame, k: int = 16, key: str = "code") -> DataFrame:
    """Counts of a k-mer given as text, in either orientation and case. Text that is no k-mer of this
    length, or one that is no candidate, is an error."""
    text = kmer.upper()
    if len(text) != k or set(text) - set("ACGT"):
        raise ValueError(f"{kmer!r} is not a {k}-mer")
    code = min(int(x.translate(str.maketrans("ACGT", "0123")), 4) for x in (text, text[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return lookup(counts, key, code, candidates)


def pilot(manifest: DataFrame, n: int, order: str = "hap") -> DataFrame:
    """The first n haps of a manifest, for a trial run."""
    return manifest.orderBy(order).limit(n)


def _bitmap(candidates: DataFrame, place: Column) -> DataFrame:
    """(bucket, bitmap) of the places of candidates, one bit for each, 32,768 in a row."""
    rows = candidates.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def prefix_bitmap(candidates: DataFrame, drop_bits: int = 8) -> DataFrame:
    """(bucket, bitmap, prefixes): which prefixes of candidate codes occur, for other programs. Scans and
    counts of candidates here use ``prefilter``."""
    return _bitmap(candidates, F.shiftright("code", drop_bits)).withColumn("prefixes", F.bitmap_count("bitmap"))


def substring_hits(sequences: DataFrame, motifs: list[str], keys: list[str]) -> DataFrame:
    """(keys, motif, start) of every place where one of the motifs stands, overlapping ones too: a plain
    search in the text, which shares nothing with ``windows`` and checks it. Each motif is one pass over a
    text, however long it is."""
    rows = sequences.select(*keys, "seq").where("seq is not null")
    motifs = list(dict.fromkeys(motifs))

    def places(text: str):
        for i, motif in enumerate(motifs):
            at = text.find(motif)
            while at >= 0:
                yield i, at
                at = text.find(motif, at + 1)

    def run(batches):
        for batch in batches:
            found = [(row, *place) for row in range(batch.num_rows) for place in places(batch.column(len(keys))[row].as_py())]
            if found:
                row, motif, start = zip(*found, strict=True)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array([motifs[i] for i in motif], pa.string()), pa.array(start, pa.int64())], names=[*keys, "motif", "start"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    return rows.mapInArrow(run, f"{types}motif string, start long")


def region_views(haps: DataFrame, regions: tuple[str, ...] = ("HSat2", "HSat3", "HSat23", "ambiguous", "background"), folder: str = "regions") -> DataFrame:
    """(hap, region, source_fasta, region_bed, coordinate_system): where each region of each hap (hap,
    fasta) is found."""
    rows = haps.select("hap", F.col("fasta").alias("source_fasta"), F.explode(F.array(*map(F.lit, regions))).alias("region"))
    bed = F.concat_ws("/", F.lit(folder), F.col("hap").cast("string"), F.concat("region", F.lit(".bed")))
    return rows.select("hap", "region", "source_fasta", bed.alias("region_bed"), F.lit("filtered_oriented_fasta_0based_halfopen").alias("coordinate_system"))
