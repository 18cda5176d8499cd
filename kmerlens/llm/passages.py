"""Substring deduplication: MinHash banding over paragraphs, exact verification, components.

Texts seldom mark where a repeated passage starts, so texts are cut by content, at words whose hashes
are the smallest of their surroundings; what stands outside a passage does not move the cuts inside.

1. *Windows* of 32 to 41 words go from one winnowed cut to another, a cut in any ten words in a row, so
   that every repeated run of 51 words, in any script or punctuation, has one. *Paragraphs* go from a
   word that is the smallest within 31 words on both sides to the next, so they have 32 words at least
   and about 63; they lie side by side. Each is named by a hash of its words.
2. Equal windows and paragraphs would share every band, so they meet by their names. Names that a
   sample shows to be frequent (a bounded list) go no such way: they are known to be shared, and they
   stay where they are, in one row of bytes for each batch, until their classes are known; then they
   leave as runs of overlapping ones.
3. Different paragraphs are keyed by bands of MinHash rows. ``tune`` picks the bands: rows as many as
   keep unlike texts apart, bands as many as the recall asks for. All paragraphs that share a key are
   compared by exact Jaccard on shingles, in tiles of bounded size. A key of more than one tile is
   cut into blocks that share a leader; where this leaves its paragraphs in several components, those
   that share a rare shingle (of each as many as alike ones need to share one) are compared too, so the
   same classes come out whatever the sizes of tiles, parcels and buckets.
4. Components of the links decide: the document with the smallest doc_id keeps the passage, all
   others lose it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, components, join_hot, lean, lean_group, local_forest, mix64, rows_of, staged, string_buffers, tasks_for, unstage, word_hashes
from .jaccard import bitmaps

#: Stands for a null doc_id, so that it sorts first.
NO_ID = -(2**63)
#: Marks the length of a paragraph.
_PARAGRAPH = 1 << 15
#: Names and keys that are handled as frequent, at most: 8 bytes each in every Python worker.
FREQUENT = 50_000
_ROLL = U64(0x9FB21C651E98DF25)
_ROLL_BACK = U64(pow(0x9FB21C651E98DF25, -1, 2**64))
_PLACE = U64((1 << 26) - 1)


def tune(threshold: float, recall: float, hashes: int = 32) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``hashes`` MinHashes still find pairs of the
    threshold's similarity with a chance of ``recall``, and the fewest bands that do."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of all words, as word_hashes sees them."""
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    solid = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1 if len(raw) else starts
    return starts, ends


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of any n values in a row."""
    have = 1
    while 2 * have <= n:
        x, have = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0], 2 * have
    return np.minimum(x[: len(x) - n + have], x[n - have :]) if n > have and len(x) > n - have else x if n == have else x[:0]


def _winnowed(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start of the last window, end of the first window) of all words that have the smallest
    hash (the last of equals) of some ``window`` words in a row of their text, in order."""
    m = len(words) - window + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    here = np.arange(len(words), dtype=np.uint64) & _PLACE
    least = _least((words & ~_PLACE) | (_PLACE - here), window)
    first = np.arange(m)
    place = first + ((_PLACE - (least & _PLACE)).astype(np.int64) - first) % (1 << 26)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(row[:m] == row[window - 1 :])
    place = place[start]
    new = np.append(True, place[1:] != place[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
    return place[lo[: len(place)]], start[hi[: len(place)]], start[lo[: len(place)]] + window


def windows(words: np.ndarray, at: np.ndarray, least: int, run: int = 51) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of all windows. They go from one winnowed cut to another, the ten
    words that make it one included: their own words alone decide that they are windows, so each text
    that holds these words has them (those at the start and the end of a text are more). With
    cuts in any w words they start within the first w words of equal runs and are w - 1 words longer
    than ``least`` at most, so runs of 2 w + least - 2 words have one."""
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    place, first, until = _winnowed(words, at, max(1, (run - least + 2) // 2))
    places, until = np.append(place, 1 << 62), np.append(until, n)
    row = np.searchsorted(at, place, "right") - 1
    k = np.searchsorted(places, first + least - 1)
    ok = places[k] < at[row + 1]
    # texts have a window from their first word on, and one up to their last
    long = np.flatnonzero(np.diff(at) >= least)
    start, end = at[long], at[long + 1]
    h = np.searchsorted(places, start + least - 1)
    head_end = np.where(places[h] < end, until[h], end)
    t = np.searchsorted(first, end - least, "right") - 1
    tail = np.maximum(first[t], start) if len(first) else start
    tail = np.where(t >= 0, tail, start)
    found = np.stack([np.concatenate([first[ok], start, tail]), np.concatenate([until[k[ok]], head_end, end]), np.concatenate([row[ok], long, long])])
    order = np.lexsort((found[1], found[0]))
    found = found[:, order]
    once = np.ones(len(order), bool)
    once[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    first, end, row = found[:, once]
    return row, first, end


def paragraphs(words: np.ndarray, at: np.ndarray, least: int, most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of the paragraphs: cut where a word's hash is smaller than those of
    the least - 1 words before it and none of as many behind it is smaller, and every ``most`` words
    from such a cut on. They cover all texts of ``least`` words; a last part that is shorter than that
    belongs to the part before."""
    n, h = len(words), least - 1
    long = np.flatnonzero(np.diff(at) >= least)
    if not len(long):
        return (np.zeros(0, np.int64),) * 3
    near = _least(words, h)
    mid = np.arange(h, n - h)
    cut = mid[(near[mid - h] > words[mid]) & (near[mid + 1] >= words[mid])] if h and n > 2 * h else mid[:0]
    row = np.searchsorted(at, cut, "right") - 1
    cut = cut[(cut - at[row] >= least) & (at[row + 1] - cut >= least)]
    first = np.sort(np.concatenate([at[long], cut]))
    row = np.searchsorted(at, first, "right") - 1
    end = np.minimum(np.append(first[1:], n), at[row + 1])
    parts = np.maximum(1, (end - first - least) // most + 1)
    row, ends = np.repeat(row, parts), np.repeat(end, parts)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + turn * most
    return row, start, np.where(turn + 1 < np.repeat(parts, parts), start + most, ends)


def _shingle(words: np.ndarray, k: int) -> np.ndarray:
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * U64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix64(out)


def _names(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from first to end, of each."""
    n = len(words)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(n, _ROLL)]))
    back = np.cumprod(np.concatenate([[U64(1)], np.full(n, _ROLL_BACK)]))
    total = np.concatenate([[U64(0)], np.cumsum(words * power[:-1], dtype=np.uint64)])
    return mix64((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64)).view(np.int64)


def band_keys(sh: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int, rows: int, salt: int = 0) -> np.ndarray:
    """Keys (paragraphs, bands) of the shingles first to end (at least one), ``rows`` MinHashes each."""
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)
    spans = np.stack([first, end], 1).ravel()
    keys = np.zeros((len(first), bands), np.uint64)
    for i, seed in enumerate(seeds):
        least = np.minimum.reduceat(np.append(sh * seed, U64(2**64 - 1)), spans)[::2] if len(first) else sh[:0]
        keys[:, i // rows] = mix64(keys[:, i // rows] + least + U64(i))
    return keys.view(np.int64)


def _parts(words: np.ndarray, at: np.ndarray, k: int, least: int, bands: tuple[int, int]):
    """Windows and paragraphs (row, first, end, name), and the paragraphs' band keys."""
    w, p = windows(words, at, least), paragraphs(words, at, least)
    sh = _shingle(words, k) if len(p[0]) else words[:0]
    return (*w, _names(words, w[1], w[2])), (*p, _names(words, p[1], p[2])), band_keys(sh, p[1], p[2] - k + 1, *bands)


_PART = "bucket long, names binary, docs binary, runs binary, starts binary, lengths binary, a long, doc long, start long, len long, "


def _blobs(bucket: np.ndarray, arrays: dict[str, np.ndarray], doc: np.ndarray | None = None):
    """One row for each bucket: the bytes of the arrays, and of runs of equal docs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist() if len(b) else []
    out: dict[str, list] = {"bucket": [], "docs": [], "runs": [], **{c: [] for c in arrays}}
    for lo, hi in zip(at, [*at, len(b)][1:], strict=True):
        o = order[lo:hi]
        out["bucket"].append(int(b[lo]))
        for c, v in arrays.items():
            out[c].append(v[o].tobytes())
        if doc is not None:
            d = doc[o]
            runs = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            out["docs"].append(d[runs].tobytes())
            out["runs"].append(np.diff(np.append(runs, len(d))).astype(np.uint32).tobytes())
    return out


def _scan(k: int, least: int, bands: tuple[int, int], buckets: int, frequent, hold: int = 1 << 18):
    lead = U64(64 - buckets.bit_length() + 1)
    names = [c.split()[0] for c in _PART.rstrip(", ").split(", ")] + [f"k{i}" for i in range(bands[0])]
    types = {c: pa.binary() if c in ("names", "docs", "runs", "starts", "lengths") else pa.int64() for c in names}

    def batch_of(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names=names)

    def run(batches):
        """Blobs of windows and paragraphs by bucket of their names (-1: those whose names are frequent),
        and a row with keys for every paragraph (bucket -1: its name is frequent)."""
        known = frequent.value
        held: list[tuple] = []

        def out():
            name, doc, start, length = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (name.view(np.uint64) >> lead).astype(np.int64) if buckets > 1 else np.zeros(len(name), np.int64)
            return batch_of(**_blobs(bucket, {"names": name, "starts": start.astype(np.uint32), "lengths": length.astype(np.uint16)}, doc))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            words, at = word_hashes(*string_buffers(batch.column(1)))
            w, p, keys = _parts(words, at, k, least, bands)
            if not len(w[0]):
                continue
            row, first, end, name = (np.concatenate(x) for x in zip(w, p, strict=True))
            twice = np.lexsort((end, first))  # a text's only window may be its paragraph too
            once = np.append(True, (first[twice][1:] != first[twice][:-1]) | (end[twice][1:] != end[twice][:-1]))
            mark = np.maximum.reduceat(np.where(twice < len(w[0]), 0, _PARAGRAPH), np.flatnonzero(once))
            row, first, end, name = (x[twice][once] for x in (row, first, end, name))
            doc, start, length = ids[row], first - at[row], end - first | mark
            often = np.isin(name, known)
            if often.any():
                yield batch_of(**_blobs(np.full(int(often.sum()), -1), {"names": name[often], "starts": start[often].astype(np.uint32), "lengths": length[often].astype(np.uint16)}, doc[often]))
            held.append((name[~often], doc[~often], start[~often], length[~often]))
            if len(p[0]):
                hot = pa.array(np.full(len(p[0]), -1), mask=~np.isin(p[3], known))
                yield batch_of(bucket=hot, a=p[3], doc=ids[p[0]], start=p[1] - at[p[0]], len=p[2] - p[1], **{f"k{i}": keys[:, i] for i in range(bands[0])})
            if sum(len(x[0]) for x in held) > hold:
                yield out()
        if held:
            yield out()

    return run


def _flat(column, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column.to_pylist()])


def _equal(table: pa.Table) -> pa.Table:
    """Of one bucket of names: all rows of those that several documents hold, with the least of them."""
    name, doc = _flat(table.column("names"), np.int64), np.repeat(_flat(table.column("docs"), np.int64), _flat(table.column("runs"), np.uint32))
    order = np.argsort(name, kind="stable")
    name, doc = name[order], doc[order]
    at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    n = np.diff(np.append(at, len(name)))
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    keep = np.repeat(low != high, n)
    start, length = (_flat(table.column(c), t)[order][keep].astype(np.int64) for c, t in (("starts", np.uint32), ("lengths", np.uint16)))
    return pa.table({"a": name[keep], "doc": doc[keep], "start": start, "len": length & ~_PARAGRAPH, "low": np.repeat(low, n)[keep], "paragraph": (length & _PARAGRAPH) > 0})


def _least_docs(batches):
    """(name, least document) of the frequent names of a batch of blobs (names, docs, runs)."""
    for batch in batches:
        if batch.num_rows:
            name, doc = _flat(batch.column(0), np.int64), np.repeat(_flat(batch.column(1), np.int64), _flat(batch.column(2), np.uint32))
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            first = np.append(True, name[1:] != name[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(name[first]), pa.array(doc[first])], names=["a", "low"])


def _runs(classes):
    """Overlapping passages of frequent names as one: (class_id, keeper, doc, start, end) with the least
    class and keeper of those that their document keeps, and of those that it loses."""

    def run(batches):
        names, class_of, keeper_of, own_keeper = classes.value
        for batch in batches:
            for blob in range(batch.num_rows):
                name, doc, runs, start, length = (np.frombuffer(batch.column(i)[blob].as_py(), t) for i, t in enumerate((np.int64, np.int64, np.uint32, np.uint32, np.uint16)))
                turn = np.repeat(np.arange(len(doc)), runs)
                at = np.searchsorted(names, name)
                # a window of a paragraph's name stays in the class of the name, as among the other names
                part = (length & np.uint16(_PARAGRAPH)) > 0
                kind, keeper, start = np.where(part, class_of[at], name), np.where(part, keeper_of[at], own_keeper[at]), start.astype(np.int64)
                end = start + (length & ~np.uint16(_PARAGRAPH)).astype(np.int64)
                group = turn * 2 + (doc[turn] != keeper)
                order = np.lexsort((end, start, group))
                group, start, end, kind, keeper = (x[order] for x in (group, start, end, kind, keeper))
                reach = np.maximum.accumulate(end + (group << 34)) - (group << 34)
                fresh = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1])))
                columns = (np.minimum.reduceat(kind, fresh), np.minimum.reduceat(keeper, fresh), doc[group[fresh] // 2], start[fresh], np.maximum.reduceat(end, fresh))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["class_id", "keeper", "doc", "start", "end"])

    return run


def _key_blobs(bands: int, buckets: int, frequent):
    lead = buckets.bit_length() - 1  # buckets only spread the rows: keys stay whole, so they meet alike whatever the size
    names = ["bucket", "keys", "names", "a", "g"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        """Blobs of keys and names by bucket of the key, and rows of frequent keys."""
        known = frequent.value
        for batch in batches:
            name = np.tile(batch.column(0).to_numpy(), bands)
            key = np.concatenate([batch.column(1 + i).to_numpy() for i in range(bands)])
            often = np.isin(key, known)
            if often.any():
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in types[:3]), pa.array(name[often]), pa.array(key[often])], names=names)
            key, name = key[~often].view(np.uint64), name[~often]
            bucket = (key >> U64(64 - lead)).astype(np.int64) if lead else np.zeros(len(key), np.int64)
            rows = _blobs(bucket, {"keys": key, "names": name})
            m = len(rows["bucket"])
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c], t) for c, t in zip(names[:3], types, strict=False)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket of keys: (name, key, names under the key, least name under it) where there are two."""
    key, name = _flat(table.column("keys"), np.int64), _flat(table.column("names"), np.int64)
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
    key, name = key[fresh], name[fresh]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(at, len(key)))
    keep = np.repeat(n > 1, n)
    return pa.table({"a": name[keep], "g": key[keep], "n": np.repeat(n, n)[keep], "lead": np.repeat(name[at], n)[keep]})


def _words_of(k: int, least: int):
    def run(batches):
        """(name, words) of the paragraphs asked for: rows (text, asked names). Names are made again
        from the text, so rows that share a doc_id but not a text do no harm."""
        for batch in batches:
            words, at = word_hashes(*string_buffers(batch.column(0)))
            row, first, end = paragraphs(words, at, least)
            name = _names(words, first, end)
            asked = batch.column(1)
            want = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            want = mix64(asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) + want.astype(np.uint64)
            o = np.flatnonzero(np.isin(mix64(name.view(np.uint64)) + row.astype(np.uint64), want))
            for lo in range(0, len(o), 1 << 13):
                p = o[lo : lo + (1 << 13)]
                n = end[p] - first[p]
                to = np.concatenate([[0], np.cumsum(n)])
                data = (words[np.repeat(first[p] - to[:-1], n) + np.arange(to[-1])] >> U64(32)).astype(np.uint32)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(to * 4), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(name[p]), blobs], names=["a", "words"])

    return run


def _pairs(lo: np.ndarray, hi: np.ndarray, at_once: int = 1 << 18):
    """(rows x, rows y) of all pairs of a row x with the rows lo[x] to hi[x], in pieces."""
    count = hi - lo
    sums = np.cumsum(count)
    cuts = np.unique(np.searchsorted(sums, np.arange(0, sums[-1] + at_once, at_once), "left")).tolist() if len(sums) else []
    for r0, r1 in zip([0, *cuts], [*cuts, len(lo)], strict=True):
        c = count[r0:r1]
        x = np.repeat(np.arange(r0, r1), c)
        if len(x):
            yield x, np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[r0:r1], c)


def _row_shingles(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, place in the row) of all shingles of word blobs."""
    sizes = np.array([len(x) // 4 for x in blobs], np.int64)
    flat = np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = max(0, len(flat) - k + 1)
    inside = place[:n] <= sizes[row[:n]] - k
    sh = _shingle(flat, k) if n else flat[:0]
    return sh[inside], row[:n][inside], place[:n][inside]


def _tile_links(k: int, threshold: tuple[int, int]):
    a, b = threshold

    def run(table: pa.Table) -> pa.Table:
        """Of one parcel of tiles: spanning links of the pairs of different documents that reach the
        threshold. All pairs of a tile are tried; parity bitmaps bound overlaps, and pairs already joined
        are passed over, so which links are found depends on the parcel, but not what they join."""
        tile, side, content, doc, shared = (table.column(c).to_numpy() for c in ("tile", "side", "a", "doc", "shared"))
        order = np.lexsort((content, side, tile))
        tile, side, content = tile[order], side[order], content[order]
        once = np.append(True, (tile[1:] != tile[:-1]) | (side[1:] != side[:-1]) | (content[1:] != content[:-1]))
        order, tile, side, content = order[once], tile[once], side[once], content[once]
        doc, shared = doc[order], shared[order] > 0
        m = len(order)
        sh, row, _ = _row_shingles(table.column("words").take(pa.array(order)).to_pylist(), k)
        kinds, rank = np.unique(sh, return_inverse=True)
        base = len(kinds) + 1
        code = row * base + rank
        sets = np.unique(code)
        n = np.bincount(sets // base, minlength=m)
        to = np.concatenate([[0], np.cumsum(n)])
        maps = bitmaps(kinds[sets % base], to, 256)
        # the partners of a row: all behind it in its tile, or the other side of a tile of two blocks
        t_at = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        t_n = np.diff(np.append(t_at, m))
        hi = np.repeat(t_at + t_n, t_n)
        ones = np.add.reduceat(side, t_at)
        lo = np.where(np.repeat(ones, t_n) > 0, np.where(side > 0, hi, hi - np.repeat(ones, t_n)), np.arange(m) + 1)
        label = np.unique(content, return_inverse=True)[1]
        left, right = [], []

        def verify(x, y):
            size = to[x + 1] - to[x]
            p = np.repeat(np.arange(len(x)), size)
            e = np.repeat(to[x] - np.cumsum(size) + size, size) + np.arange(len(p))
            want = y[p] * base + sets[e] % base
            found = np.minimum(np.searchsorted(sets, want), len(sets) - 1)
            both = np.bincount(p[sets[found] == want], minlength=len(x))
            return (both > 0) & (b * both >= a * (n[x] + n[y] - both))

        for x, y in _pairs(lo, hi):
            ok = (doc[x] != doc[y]) | shared[x] | shared[y]
            x, y = x[ok], y[ok]
            ok = (b * np.minimum(n[x], n[y]) >= a * np.maximum(n[x], n[y])) & (n[x] > 0)
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
            ok = (a + b) * ((n[x] + n[y] - apart) // 2) >= a * (n[x] + n[y])
            x, y = x[ok], y[ok]
            turns = 1  # of each row the first pair, then 2, 4, ... of those that nothing has joined yet
            while len(x):
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                now = np.arange(len(x)) - np.searchsorted(x, x) < turns
                for q in range(0, int(now.sum()), 1 << 15):
                    x1, y1 = x[now][q : q + (1 << 15)], y[now][q : q + (1 << 15)]
                    hit = verify(x1, y1)
                    left.append(x1[hit])
                    right.append(y1[hit])
                    node, root = local_forest(label[x1[hit]], label[y1[hit]])
                    to_root = np.arange(m)
                    to_root[node] = root
                    label = to_root[label]
                x, y, turns = x[~now], y[~now], turns * 2
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))

        return pa.table([pa.array(v, pa.int64()) for v in (content[x], content[y])], names=["a", "b"])

    return run


def _shingles_of(k: int):
    def run(batches):
        """(name, shingle, first place, last place, different shingles of the name) of paragraphs (name,
        words), each shingle of a paragraph once."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 13):
                some = batch.slice(lo, 1 << 13)
                sh, row, place = _row_shingles(some.column(1).to_pylist(), k)
                if not len(sh):
                    continue
                order = np.lexsort((place, sh, row))
                sh, row, place = sh[order], row[order], place[order]
                new = np.append(True, (row[1:] != row[:-1]) | (sh[1:] != sh[:-1]))
                first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
                size = np.bincount(row[first], minlength=some.num_rows)[row[first]]
                columns = (sh[first].view(np.int64), place[first], place[last], size)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row[first])), *(pa.array(c) for c in columns)], names=["a", "sh", "first", "last", "size"])

    return run


_SHINGLES = "a long, sh long, first long, last long, size long"


def _spans(classes: DataFrame, texts: DataFrame, k: int, tasks: int) -> DataFrame:
    """(a, from, to) of paragraphs that belong to a class (a, root): from the first to the last shingle that
    another paragraph of the class has too. This needs no pairs, so it doesn't depend on which were tried."""
    rows = texts.select("a", "words").mapInArrow(lean(_shingles_of(k)), _SHINGLES).join(classes.select("a", "root"), "a")
    rows = staged(rows.select("a", F.xxhash64("root", "sh").alias("g"), "first", "last"), "class-shingles", tasks)
    common = rows.groupBy("g").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("g")
    spans = staged(join_hot(rows, common, "g").groupBy("a").agg(F.min("first").alias("from"), (F.max("last") + k).alias("to")), "spans", tasks)
    unstage(rows)
    return spans


def _links_of(tiles: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int], parcel_rows: int, name: str, tasks: int) -> DataFrame:
    """Links of tiles (a, tile, side, one: whether the tile is small and shares a parcel)."""
    tiles = staged(tiles, f"{name}-tiles", tasks)
    parcels = max(1, -(-tiles.where("one").count() // parcel_rows))
    rows = tiles.select("a", "tile", "side", F.when(F.col("one"), F.pmod(F.xxhash64("tile"), F.lit(parcels))).otherwise(F.col("tile")).alias("parcel")).join(texts, "a")
    rows = rows.select("parcel", "tile", "side", "a", "doc", "shared", "words")
    links = staged(rows.groupBy("parcel").applyInArrow(lean_group(_tile_links(k, threshold)), "a long, b long"), name, tasks)
    unstage(tiles)
    return links


def _frequent(docs: DataFrame, k: int, least: int, bands: tuple[int, int], one_in: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Names that two documents of a sample hold, and keys that ten paragraphs of it share: FREQUENT
    each at most, the most frequent first. They decide how rows travel, not what is found."""
    none = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64))
    scan = _scan(k, least, bands, 1, none)

    def run(batches):
        for x in scan(batches):
            name = x.column("names").drop_null()
            if len(name):
                names, doc = _flat(name, np.int64), np.repeat(_flat(x.column("docs").drop_null(), np.int64), _flat(x.column("runs").drop_null(), np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(doc), pa.nulls(len(names), pa.int64())], names=["a", "doc", "g"])
            else:
                for i in range(bands[0]):
                    yield pa.RecordBatch.from_arrays([x.column("a"), x.column("doc"), x.column(f"k{i}")], names=["a", "doc", "g"])

    sample = staged(docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(one_in)) == 0).mapInArrow(run, "a long, doc long, g long"), "sample", docs.sparkSession.sparkContext.defaultParallelism)
    names = sample.where("g is null").groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low <> high")
    keys = sample.where("g is not null").select("a", "g").distinct().groupBy("g").count().where("count >= 10")
    out = [np.array([r[0] for r in d.collect()], np.int64) for d in (names.orderBy(F.desc("n"), "a").limit(FREQUENT).select("a"), keys.orderBy(F.desc("count"), "g").limit(FREQUENT).select("g"))]
    unstage(sample)
    return np.sort(out[0]), np.sort(out[1])


def repeated_passages(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), least: int = 32, recall: float = 0.96, hashes: int = 20, bucket_rows: int = 1 << 18, tile_rows: int = 2048, parcel_rows: int = 1 << 13, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, start, end, class_id, keeper_id, removed): every passage of docs (doc_id, text) that
    another document holds too, as words start to end (end not included) of the whole text.

    Passages are unions of overlapping windows of at least ``least`` words that repeat exactly and of
    paragraphs that reach the Jaccard threshold a / b on k-word shingles, each pair with a chance of
    ``recall`` or more; of those that only resemble others, the part from the first to the last shingle
    that another paragraph of their class has too counts. ``bucket_rows``, ``tile_rows``, ``parcel_rows``
    and ``broadcast_rows`` change how the work is cut, not the rows. ``removed`` is false in the document with the smallest doc_id of a class and
    true in the others. Texts with fewer words than ``least``, empty and null texts have no passage.
    Repeats inside one document are left alone, and rows that share a doc_id are one document; rows
    without a doc_id are the document of a null id, the smallest. Other columns are ignored. No rows
    give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = tasks_for(docs)
    bands = tune(threshold[0] / threshold[1], recall, hashes)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1
    while buckets * bucket_rows * 32 < size:  # a window or a paragraph starts about every 33 characters
        buckets *= 2
    often, often_keys = (spark.sparkContext.broadcast(x) for x in _frequent(docs, k, least, bands))
    scanned = staged(docs.mapInArrow(lean(_scan(k, least, bands, buckets, often)), _PART + ", ".join(f"k{i} long" for i in range(bands[0]))), "parts", tasks)

    blobs = scanned.where("bucket >= 0").select("bucket", "names", "docs", "runs", "starts", "lengths")
    equal = staged(blobs.groupBy("bucket").applyInArrow(lean_group(_equal), "a long, doc long, start long, len long, low long, paragraph boolean"), "equal", tasks)
    hot = scanned.where("bucket = -1 and k0 is null")
    hot_low = hot.select("names", "docs", "runs").mapInArrow(lean(_least_docs), "a long, low long").groupBy("a").agg(F.min("low").alias("low"))
    hot_low = staged(hot_low, "frequent", 1)  # FREQUENT rows at most

    columns = [f"k{i}" for i in range(bands[0])]
    places = scanned.where("k0 is not null").select("bucket", "a", "doc", "start", *columns)
    own = staged(places.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *(F.min(c).alias(c) for c in columns)), "paragraphs", tasks)
    keyed = own.select("a", *columns).mapInArrow(lean(_key_blobs(bands[0], max(1, buckets // 2), often_keys)), "bucket long, keys binary, names binary, a long, g long")
    keyed = staged(keyed, "keys", tasks)
    met = keyed.where("bucket is not null").select("bucket", "keys", "names").groupBy("bucket").applyInArrow(lean_group(_meet), "a long, g long, n long, lead long")
    common = keyed.where("bucket is null").select("a", "g").distinct()
    common = common.join(F.broadcast(common.groupBy("g").agg(F.count("*").alias("n"), F.min("a").alias("lead"))), "g")  # FREQUENT rows at most
    met = staged(met.unionByName(common.select("a", "g", "n", "lead")), "met", tasks)
    unstage(keyed)

    asked = own.select("a", "low", "high").join(met.select("a").distinct(), "a")
    asked = staged(asked, "asked", tasks)
    wanted = asked.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("a").alias("asked"))
    wanted = F.broadcast(wanted) if asked.count() <= broadcast_rows else wanted.hint("merge")
    words = docs.join(wanted, "doc_id").select("text", "asked").mapInArrow(lean(_words_of(k, least)), "a long, words binary").groupBy("a").agg(F.first("words").alias("words"))
    texts = staged(asked.join(words, "a").select("a", F.col("low").alias("doc"), (F.col("low") != F.col("high")).cast("long").alias("shared"), "words"), "words", tasks)

    # a key of one tile at most; a larger one is cut into blocks that all have its leader
    subs = F.ceil(F.col("n") / tile_rows).cast("long")
    block = F.pmod(F.xxhash64("a"), F.col("subs")).cast("long")
    spots = F.when((F.col("a") == F.col("lead")) & (F.col("subs") > 1), F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).otherwise(F.array(block))
    tiles = met.withColumn("subs", subs).select("a", F.explode(spots).alias("spot"), "g", "subs")
    tiles = tiles.select("a", F.xxhash64("g", "spot").alias("tile"), F.lit(0).cast("long").alias("side"), (F.col("subs") == 1).alias("one"))
    links = _links_of(tiles, texts, k, threshold, parcel_rows, "alike", tasks)
    large = met.where(subs > 1).select("a", "g")
    if not large.isEmpty():
        links = links.unionByName(_across(large, links, texts, k, threshold, tile_rows, parcel_rows, tasks))
    roots = staged(components(links.select("a", "b"), "passage-links", tasks).withColumnRenamed("node", "a").join(asked.select("a", "low", (F.col("low") != F.col("high")).alias("shared")), "a"), "roots", tasks)
    linked = staged(join_hot(roots, roots.groupBy("root").agg(F.min("low").alias("keeper")), "root").select("a", "root", "keeper", "shared"), "linked", tasks)

    spans = _spans(linked, texts, k, tasks).join(linked.where("not shared").select("a", "root", "keeper"), "a")
    # paragraphs that one document holds: none of them is frequent
    alike = places.where("bucket is null").select("a", "doc", "start").join(spans, "a").select(F.col("root").alias("class_id"), "keeper", "doc", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    known = linked.where("shared").select(F.col("a").alias("b"), "root", "keeper")
    # only paragraphs have links, so only they may belong to another class than that of their name
    single = equal.where("not paragraph").withColumn("root", F.col("a")).withColumn("keeper", F.col("low"))
    both = single.unionByName(equal.where("paragraph").join(known, F.col("a") == F.col("b"), "left").drop("b"))
    both = both.select(F.coalesce("root", "a").alias("class_id"), F.coalesce("keeper", "low").alias("keeper"), "doc", "start", (F.col("start") + F.col("len")).alias("end"))
    # the classes of frequent names: FREQUENT rows at most
    hot_known = hot_low.join(known.join(F.broadcast(hot_low.select(F.col("a").alias("b"))), "b"), F.col("a") == F.col("b"), "left")
    classes = hot_known.select("a", F.coalesce("root", "a"), F.coalesce("keeper", "low"), "low").collect()
    classes = np.array(sorted(tuple(r) for r in classes), np.int64).reshape(-1, 4)
    classes = spark.sparkContext.broadcast(tuple(classes.T.copy()))
    runs = hot.select("names", "docs", "runs", "starts", "lengths").mapInArrow(lean(_runs(classes)), "class_id long, keeper long, doc long, start long, end long")
    members = staged(both.unionByName(alike).unionByName(runs), "members", tasks)
    for done in (scanned, equal, own, met, asked, texts):
        unstage(done)

    spans = members.withColumn("removed", F.col("doc") != F.col("keeper"))
    by_doc = Window.partitionBy("doc", "removed").orderBy("start", "end", "class_id")
    spans = spans.withColumn("reach", F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("class_id").alias("class_id"), F.min("keeper").alias("keeper"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return merged.select(real("doc").alias("doc_id"), "start", "end", "class_id", real("keeper").alias("keeper_id"), "removed")


def _across(large: DataFrame, links: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int], tile_rows: int, parcel_rows: int, tasks: int) -> DataFrame:
    """Links across the blocks of large keys (a, g): where the links found so far leave the paragraphs
    of a key in several components, those that share one of their rarest shingles meet again, and under
    shingles that many have every pair of blocks is a tile. Of two sets that reach the threshold a / b
    each has at most 1 - a / b of its shingles alone, so in one order of all shingles, the rarest under
    the key first, the first 1 - a / b of each, and one more, share one: no pair is lost."""
    roots = components(links.select("a", "b"), "near-links", tasks)
    rows = staged(large.join(roots, F.col("a") == F.col("node"), "left").select("a", "g", F.coalesce("root", "a").alias("root")), "large", tasks)
    apart = lambda key: F.expr("lo <> hi")
    mixed = staged(rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(apart("g")).select("g"), "mixed", tasks)
    rows = staged(join_hot(rows, mixed, "g"), "unsettled", tasks)
    shingles = texts.join(rows.select("a").distinct(), "a").select("a", "words").mapInArrow(lean(_shingles_of(k)), _SHINGLES)
    held = staged(rows.join(shingles, "a").select("a", "root", "g", "size", F.xxhash64("g", "sh").alias("s")), "held", tasks)
    held = join_hot(held, held.groupBy("s").agg(F.count("*").alias("often")), "s")
    of = Window.partitionBy("g", "a").orderBy("often", "s")  # the shingles of one paragraph
    prefix = F.col("size") - F.ceil(F.col("size") * threshold[0] / threshold[1]) + 1
    keys = held.withColumn("place", F.row_number().over(of)).where(F.col("place") <= prefix)
    keys = staged(keys.select("a", "root", F.col("s").alias("g")), "finer", tasks)
    sizes = keys.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where(apart("g"))
    met = join_hot(keys, sizes.select("g", F.ceil(F.col("n") / tile_rows).cast("long").alias("subs")), "g").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("subs")).cast("long"))
    tiles = met.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    tiles = tiles.select("a", F.xxhash64("g", F.least("salt", "t"), F.greatest("salt", "t")).alias("tile"), (F.col("salt") > F.col("t")).cast("long").alias("side"), (F.col("subs") == 1).alias("one"))
    return _links_of(tiles, texts, k, threshold, parcel_rows, "across", tasks)


def without_passages(docs: DataFrame, passages: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with the removed passages cut out of their texts, white space before them included, all
    columns kept, whatever their names; a document of which nothing is left keeps an empty text. Rows
    that share a doc_id lose the same words; null texts stay null; no rows give no rows."""
    cut = passages.where("removed").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    cut = staged(cut, "cuts", tasks_for(docs))
    if (cut.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= broadcast_rows:  # 16 bytes each
        cut = F.broadcast(cut)
    columns = docs.columns
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), rows_of(docs)).join(cut, "id", "left")
    touched, whole = rows.where("spans is not null"), rows.where("spans is null")
    place = columns.index("text")

    def run(batches):
        for batch in batches:
            fields = batch.column(0).flatten()
            raw, offs = string_buffers(fields[place])
            out = []
            for lo, hi, spans in zip(offs[:-1], offs[1:], batch.column(1).to_pylist(), strict=True):
                text = raw[lo:hi]
                starts, ends = word_bounds(text, np.array([0, len(text)]))
                keep = np.ones(len(text), bool)
                for s in spans:
                    e = min(s["end"], len(starts))
                    if s["start"] < e:
                        keep[ends[s["start"] - 1] if s["start"] else 0 : ends[e - 1]] = False
                out.append(text[keep].tobytes().strip(b" "))
            fields[place] = pa.array(out, pa.binary(), mask=fields[place].is_null().to_numpy(zero_copy_only=False)).cast(fields[place].type)
            yield pa.RecordBatch.from_arrays(fields, names=columns)

    return whole.select("row.*").unionByName(touched.select("row", "spans").mapInArrow(lean(run), docs.schema))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
