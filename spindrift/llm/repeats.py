"""Exact removal of repeated byte strings through a collection Burrows-Wheeler transform built column by column.

A document's windows are its LENGTH-byte strings.  Equal windows have equal minimisers (the smallest hash of the GRAM-
byte strings in them), so windows with different minimisers never need to meet.

1. One pass cuts every document into pieces: maximal runs of windows with one minimiser (MOST windows at most; every
   window is in exactly one piece).  Only (minimiser, document, place) rows are kept, about one for each 85 bytes.
2. Minimisers that come once in the corpus hold no repeated window; their pieces go no further.
3. The other pieces' bytes are cut out and equal pieces are counted together, so thousands of copies of a passage are
   one piece with a count.
4. Sets of whole minimiser groups of about SET_BYTES are transformed column by column: every round inserts one symbol
   of every piece, from its end to its start, and updates the order of the rows and their common prefixes.  Equal
   windows have their minimiser at equal places, so the pieces are aligned by it and only rows of one column need be
   ordered: a round costs one pass over the pieces (`column_transform`, the positional Burrows-Wheeler transform)
   instead of one over all rows so far.  `transform` is the general collection transform without alignment, over
   sequential files beyond SPILL_BYTES; it gives the same result (tests hold the two together) at some thirty times
   the cost.
5. Neighbours with a common prefix of LENGTH or more are equal windows.  Runs whose counts add up to two or more are
   the repeated windows; their places in all documents give the bytes to remove.

All of that is exact: hashes only say what must be compared, except that equal pieces are joined to their places by two
64-bit hashes.  Null texts count as empty; texts under LENGTH bytes have no windows.  Repeated rows are copies of one
another.  Every row is a document, whatever its id: rows without an id and other texts of one id match as all others do
(rows are known by their id and a hash of their text).
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import large_text, map_slices, mix64, written

LENGTH, GRAM, MOST = 200, 32, 1024
SET_BYTES, SPILL_BYTES, STEP = 2 << 20, 64 << 20, 4 << 20
#: Most bytes of spans that are sent to the texts; beyond that texts and spans are shuffled.
BROADCAST_BYTES = 48 << 20


def raw_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = large_text(column)
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def minimisers(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash at each place, the smallest gram hash within the length bytes from it); near the end neither counts."""
    grams = gram_hashes(raw, gram)
    h = grams.copy()
    reach, want = 1, length - gram + 1
    while reach * 2 <= want:
        h[:-reach] = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = want - reach
    if rest:
        h[:-rest] = np.minimum(h[:-rest], h[rest:])
    return grams, h


def comes_twice(grams: np.ndarray, at: np.ndarray, n: np.ndarray, h: np.ndarray, reach: int) -> np.ndarray:
    """Whether the piece of n windows from `at` has its minimiser h at two places: only then can it repeat a window itself."""
    out = np.zeros(len(at), bool)
    for lo in range(0, len(at), 8192):
        a, size = at[lo : lo + 8192], n[lo : lo + 8192].astype(np.int64) + reach
        ends = np.cumsum(size)
        place = np.repeat(a - (ends - size), size) + np.arange(int(ends[-1]))
        same = grams[place] == np.repeat(h[lo : lo + 8192], size)
        out[lo : lo + 8192] = np.add.reduceat(same.astype(np.int32), ends - size) > 1
    return out


#: What a document is known by: rows of one id with other texts, and rows without an id, are documents of their own.
KEY = ["doc_id", "text_hash"]


def keys_of(doc_id: str = "doc_id", text: str = "text") -> list:
    """KEY of each row: its id (0 for null) and a hash of its text and of whether it has an id."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias(KEY[0]), F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias(KEY[1])]


def windows(part: pa.RecordBatch, length: int, gram: int) -> pa.RecordBatch:
    raw, offsets = raw_of(part.column("text"))
    docs, texts = (part.column(c).to_numpy(zero_copy_only=False) for c in KEY)
    names = ["h", *KEY, "start", "n", "own"]
    if len(raw) < length:
        return pa.RecordBatch.from_arrays([*(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.bool_())], names=names)
    grams, m = minimisers(raw, length, gram)
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # windows of text i start in [offsets[i], last[i])
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = m[1:] != m[:-1]
    begins[offsets] = True
    begins[last] = True
    at = np.flatnonzero(begins[:-1])
    ends = np.append(at[1:], len(raw))
    own = np.searchsorted(offsets, at, side="right") - 1
    good = at < last[own]
    at, ends, own = at[good], ends[good], own[good]
    n = ends - at
    if (n > MOST).any():
        k = (n + MOST - 1) // MOST
        own = np.repeat(own, k)
        first = np.repeat(at, k)
        step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        stop = np.repeat(ends, k)
        h = np.repeat(m[at], k)
        at = first + step * MOST
        n = np.minimum(MOST, stop - at)
    else:
        h = m[at]
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs[own].astype(np.int64)), pa.array(texts[own].astype(np.int64)), pa.array((at - offsets[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(comes_twice(grams, at, n, h, length - gram))], names=names)


class Columns:
    """A growing byte sequence that each round reads once in order and writes anew with rows merged in."""

    def __init__(self, data: np.ndarray, spill: int = SPILL_BYTES):
        self.spill, self.size, self.path, self.data = spill, len(data), None, data

    def blocks(self):
        if self.path is None:
            yield 0, self.data
        else:
            with open(self.path, "rb") as f:
                at = 0
                while at < self.size:
                    block = np.frombuffer(f.read(STEP), np.uint8)
                    yield at, block
                    at += len(block)

    def merge(self, where: np.ndarray, values: np.ndarray) -> None:
        """Put values at the places `where` (ascending) of the new sequence; the old rows fill the other places."""
        size = self.size + len(where)
        if size <= self.spill:
            out, keep = np.empty(size, np.uint8), np.ones(size, bool)
            keep[where] = False
            out[keep] = self.data
            out[where] = values
            self.data, self.size = out, size
            return
        new = tempfile.NamedTemporaryFile(prefix="columns", delete=False)  # noqa: SIM115
        with new:
            old, at = self.blocks(), 0
            have = np.zeros(0, np.uint8)
            while at < size:
                n = min(STEP, size - at)
                a, b = np.searchsorted(where, [at, at + n])
                need = n - (b - a)
                while len(have) < need:
                    have = np.concatenate([have, next(old)[1]])
                out, keep = np.empty(n, np.uint8), np.ones(n, bool)
                keep[where[a:b] - at] = False
                out[keep], have = have[:need], have[need:]
                out[where[a:b] - at] = values[a:b]
                new.write(out.tobytes())
                at += n
        self.drop()
        self.path, self.size, self.data = new.name, size, None

    def all(self) -> np.ndarray:
        return self.data if self.path is None else np.fromfile(self.path, np.uint8)

    def drop(self) -> None:
        if self.path:
            os.unlink(self.path)
            self.path = None


END = 255  # never a byte of UTF-8: the symbol before a piece's start


def transform(pieces: list[bytes], spill: int = SPILL_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(BWT, common prefix with the row before, 255 at most) of all suffixes of all pieces, the empty ones first.

    A piece's end is smaller than any symbol, and earlier pieces' ends are smaller than later ones'.
    """
    m = len(pieces)
    lens = np.fromiter(map(len, pieces), np.int64, m)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(lens) - lens
    at = lens - 1  # the place in each piece of the symbol inserted last
    live = np.arange(m)
    bwt = Columns(np.where(at >= 0, flat[np.maximum(first + at, 0)] if len(flat) else END, END).astype(np.uint8), spill)
    lcp = Columns(np.zeros(m, np.uint8), spill)
    rows = np.arange(m)  # where each live piece's last row stands
    live, rows = live[at >= 0], rows[at >= 0]
    while len(live):
        symbols, prefix = bwt.all(), lcp.all()
        order = np.argsort(symbols, kind="stable")  # the row that a row's symbol extends it to, for all rows
        rank = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
        rank[order] = np.arange(len(order))
        to = rank[rows].astype(np.int64)
        own = symbols[rows]
        before, after = order[np.maximum(to - 1, 0)], order[np.minimum(to + 1, len(order) - 1)]
        has_before = (to > 0) & (symbols[before] == own)
        has_after = (to + 1 < len(order)) & (symbols[after] == own)
        up, down = common(prefix, before, rows, has_before), common(prefix, rows, after, has_after)
        where = m + to
        seq = np.argsort(where, kind="stable")
        at[live] -= 1
        nxt = at[live]
        value = np.where(nxt >= 0, flat[np.maximum(first[live] + nxt, 0)], END).astype(np.uint8)
        bwt.merge(where[seq], value[seq])
        lcp.merge(where[seq], up[seq])
        below = where + 1 < lcp.size
        patch(lcp, where[below], down[below])
        rows = where
        more = nxt >= 0
        live, rows = live[more], rows[more]
    out = bwt.all(), lcp.all()
    bwt.drop()
    lcp.drop()
    return out


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """One more than the least of prefix[a + 1 .. b], 255 at most; 0 where not valid."""
    out = np.zeros(len(a), np.uint8)
    if valid.any():
        lo, hi = a[valid] + 1, b[valid] + 1
        order = np.argsort(lo, kind="stable")
        pairs = np.empty(2 * len(lo), np.int64)
        pairs[0::2], pairs[1::2] = lo[order], hi[order]
        padded = np.append(prefix, np.uint8(255))
        least = np.minimum.reduceat(padded, pairs)[0::2]
        got = np.empty(len(lo), np.uint8)
        got[order] = np.minimum(least, 254) + 1
        out[valid] = got
    return out


def patch(lcp: Columns, where: np.ndarray, down: np.ndarray) -> None:
    """Set the prefix of the row after each new row."""
    if lcp.path is None:
        lcp.data[where + 1] = down
        return
    with open(lcp.path, "r+b") as f:
        a = np.memmap(f, np.uint8, "r+", shape=(lcp.size,))
        a[where + 1] = down
        a.flush()


def repeated(pieces: list[bytes], copies: np.ndarray, length: int, spill: int = SPILL_BYTES) -> list[np.ndarray]:
    """For each piece which of its windows are repeated, within it, in other pieces or by its own copies."""
    m = len(pieces)
    lens = np.fromiter(map(len, pieces), np.int64, m)
    bwt, lcp = transform(pieces, spill)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner, start = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    live, rows = np.arange(m), np.arange(m)
    for j in range(int(lens.max(initial=0)) + 1):  # walk every piece from its end: row of each suffix
        owner[rows], start[rows] = live, lens[live] - j
        more = lens[live] > j
        live, rows = live[more], m + rank[rows[more]]
    run = np.cumsum(lcp < length) - 1
    long = lens[owner] - start >= length
    total = np.bincount(run, weights=np.where(long, copies[owner], 0))
    hit = long & (total[run] >= 2)
    out = [np.zeros(max(int(n) - length + 1, 0), bool) for n in lens]
    at = np.flatnonzero(hit)
    flat = np.zeros(int(lens.sum()) + 1, bool)
    first = np.cumsum(lens) - lens
    flat[first[owner[at]] + start[at]] = True
    for i in range(m):
        out[i] = flat[first[i] : first[i] + len(out[i])]
    return out


def least_between(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(prefix[a + 1 .. b]) for each pair."""
    if not len(a):
        return np.zeros(0, prefix.dtype)
    pairs = np.empty(2 * len(a), np.int64)
    pairs[0::2], pairs[1::2] = a + 1, b + 1
    return np.minimum.reduceat(np.append(prefix, prefix.dtype.type(0)), pairs)[0::2]


def column_transform(strings: list[bytes], anchors: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string which of its windows are repeated, for strings whose equal windows stand at equal places.

    Place 0 of every string is its anchor, so equal windows start in the same column.  Columns go from the last to the
    first; each round inserts one symbol of every string: the rows, sorted by what follows, are dealt stably by the
    symbol before them (the positional Burrows-Wheeler transform), and the common prefix of new neighbours is one more
    than the least one between them in the old order, or 0 under different symbols.
    """
    m = len(strings)
    lens = np.fromiter(map(len, strings), np.int64, m)
    begin, end = -anchors, lens - anchors
    lo, hi = int(begin.min()), int(end.max())
    table = np.zeros((hi - lo, m), np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    first = np.cumsum(lens) - lens
    table[np.arange(len(flat)) - np.repeat(first - (begin - lo), lens), np.repeat(np.arange(m), lens)] = flat
    enters, leaves = np.argsort(end, kind="stable"), np.argsort(begin, kind="stable")
    enter_at, leave_at = np.searchsorted(end[enters], np.arange(lo, hi + 2)), np.searchsorted(begin[leaves], np.arange(lo, hi + 2))
    rows, prefix = np.zeros(0, np.int64), np.zeros(0, np.int16)
    count = np.maximum(lens - length + 1, 0)
    base = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()) + 1, bool)
    for c in range(hi - 1, lo - 1, -1):
        new = enters[enter_at[c + 1 - lo] : enter_at[c + 2 - lo]]  # strings that end after this column: empty so far
        if len(new):
            if len(prefix):
                prefix[0] = 0
            rows, prefix = np.concatenate([new, rows]), np.concatenate([np.zeros(len(new), np.int16), prefix])
        symbols = table[c - lo, rows]
        order = np.argsort(symbols, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = symbols[order[1:]] == symbols[order[:-1]]
        after = np.zeros(len(order), np.int16)
        at = np.flatnonzero(same)
        after[at] = least_between(prefix, order[at - 1], order[at]) + 1
        rows, prefix = rows[order], after
        run = np.cumsum(prefix < length) - 1
        full = end[rows] - c >= length
        hit = full & (np.bincount(run, weights=np.where(full, weights[rows], 0))[run] >= 2)
        flags[base[rows[hit]] + c - begin[rows[hit]]] = True
        gone = leaves[leave_at[c - lo] : leave_at[c + 1 - lo]]  # strings that start at this column
        if len(gone):
            out = np.zeros(m, bool)
            out[gone] = True
            keep = np.flatnonzero(~out[rows])
            prefix = least_between(prefix, np.concatenate(([-1], keep))[:-1], keep)
            rows = rows[keep]
    return [flags[b : b + n] for b, n in zip(base, count, strict=True)]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h, size, factor = raw.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        while size < gram:
            h[:-size] = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
        return mix64(h)


def repeated_windows(pieces: list[bytes], keys: np.ndarray, copies: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each piece which of its windows are repeated; keys are the minimisers of the pieces.

    A window is anchored at the first place of its minimiser in it, so equal windows are anchored alike.  Windows of a
    piece with one anchor are a string; a piece whose minimiser comes again (periodic text) is several, equal ones
    counted together.
    """
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lens) - lens
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    place = np.flatnonzero(gram_hashes(raw, gram) == np.repeat(keys.view(np.uint64), lens))
    owner = np.searchsorted(starts, place, side="right") - 1
    inside = place <= starts[owner] + lens[owner] - gram
    place, owner = (place - starts[owner])[inside], owner[inside]
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    slot: dict[tuple[int, int, bytes], int] = {}
    strings: list[bytes] = []
    anchors: list[int] = []
    weights: list[int] = []
    use: list[tuple[int, int, int]] = []  # piece, first window, string
    for i, piece in enumerate(pieces):
        at = place[bounds[i] : bounds[i + 1]]
        n, a = len(piece) - length + 1, 0
        for t in at.tolist():
            if a >= n:
                break
            b = min(n, t + 1)  # windows a..b-1 have their first minimiser at t
            if b <= a:
                continue
            x = piece[a : b + length - 1]
            k = (int(keys[i]), t - a, x)
            j = slot.get(k)
            if j is None:
                j = slot[k] = len(strings)
                strings.append(x)
                anchors.append(t - a)
                weights.append(0)
            weights[j] += int(copies[i])
            use.append((i, a, j))
            a = b
    if not strings:
        return [np.zeros(max(int(n) - length + 1, 0), bool) for n in lens]
    found = column_transform(strings, np.array(anchors), np.array(weights), length)
    out = [np.zeros(max(int(n) - length + 1, 0), bool) for n in lens]
    for i, a, j in use:
        out[i][a : a + len(found[j])] = found[j]
    return out


def runs_of(flags: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.tolist()


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """KEY and spans (array of from, to byte places, ascending, maximal) of documents that lose bytes."""
    texts = docs.select(*keys_of(), "text")
    rows = written(map_slices(texts, lambda part: windows(part, length, gram), "h long, doc_id long, text_hash long, start int, n int, own boolean"), "windows")
    weight = F.when(F.col("own"), 2).otherwise(1)
    twice = rows.groupBy("h").agg(F.sum(weight).alias("w")).where("w > 1").select("h")
    places = rows.join(twice, "h", "left_semi").groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "h")).alias("places"))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = raw_of(part.column("text"))
        data = raw.tobytes()
        h, doc, own, start, piece, ph = [], [], [], [], [], []
        for i, (d, t, found) in enumerate(zip(*(part.column(c).to_pylist() for c in (*KEY, "places")), strict=True)):
            for p in found:
                a = int(offsets[i]) + p["start"]
                b = min(a + p["n"] + length - 1, int(offsets[i + 1]))
                if b - a < length:
                    continue
                x = data[a:b]
                h.append(p["h"])
                doc.append(d)
                own.append(t)
                start.append(p["start"])
                piece.append(x)
                ph.append(xxhash.xxh3_64_intdigest(x) - (1 << 63))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ph, pa.int64()), pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(start, pa.int32()), pa.array(piece, pa.binary())], names=["h", "ph", *KEY, "start", "piece"])

    cuts = written(map_slices(texts.join(places, KEY).select(*KEY, "text", "places"), cut, "h long, ph long, doc_id long, text_hash long, start int, piece binary", most=1 << 20), "pieces")
    distinct = cuts.groupBy("h", "ph", "piece").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"))

    def solve(batches):
        held: list[tuple[int, int, bytes, int]] = []
        size, key = 0, None

        def done():
            flags = repeated_windows([x[2] for x in held], np.array([x[0] for x in held], np.int64), np.array([x[3] for x in held]), length, gram)
            rows = [(x[0], x[1], runs_of(f)) for x, f in zip(held, flags, strict=True) if f.any()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["h", "ph", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "ph", "piece", "copies")), strict=True):
                if row[0] != key and size >= SET_BYTES:
                    yield done()
                    size = 0
                key = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield done()

    found = distinct.repartition("h").sortWithinPartitions("h").mapInArrow(solve, "h long, ph long, runs array<int>")
    found = written(found, "repeats")
    hits = cuts.select("h", "ph", *KEY, "start").join(found, ["h", "ph"])
    hits = hits.select(*KEY, F.expr(f"transform(filter(sequence(0, size(runs) - 1), i -> i % 2 = 0), i -> struct(start + runs[i] AS a, start + runs[i + 1] + {length - 1} AS b))").alias("s"))
    merged = hits.groupBy(*KEY).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))

    def join_spans(batches):
        for batch in batches:
            out = []
            for found in batch.column("s").to_pylist():
                ends: list[int] = []
                for x in found:
                    if ends and x["a"] <= ends[-1]:
                        ends[-1] = max(ends[-1], x["b"])
                    else:
                        ends += [x["a"], x["b"]]
                out.append(ends)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(out, pa.list_(pa.int32()))], names=[*KEY, "spans"])

    return merged.mapInArrow(join_spans, "doc_id long, text_hash long, spans array<int>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array<int>) and kept (binary) of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), *keys_of(), "text")
    found = written(spans(docs, length, gram), "spans")
    size = found.agg(F.sum(F.size("spans") * 4 + F.lit(40))).first()[0] or 0
    both = texts.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, KEY, "left")

    def apply(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = raw_of(part.column("text"))
        data = raw.tobytes()
        out = []
        for i, s in enumerate(part.column("spans").to_pylist()):
            own, kept, at = data[offsets[i] : offsets[i + 1]], [], 0
            s = s or []
            for a, b in zip(s[::2], s[1::2], strict=True):
                kept.append(own[at:a])
                at = b
            kept.append(own[at:])
            kept = b"".join(kept)
            out.append((len(own), len(own) - len(kept), len(s) // 2, hashlib.sha256(kept).hexdigest(), s, kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return map_slices(both.select("id", "text", "spans"), apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, kept binary")
