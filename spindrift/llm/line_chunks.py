"""Removal of repeated passages: multi-line chunks, cut where a rolling hash over line hashes says so, and line runs.

A text's lines are hashed; a cut follows line i where the rolling hash of the WINDOW lines up to i has its low MASK_BITS
bits zero and the chunk has LEAST lines.  The cut depends on the lines nearby only, so lines inserted before a shared
passage don't shift its chunks.  A chunk of LEAST lines or more that holds a word and comes again anywhere in the corpus is
removed, except where it comes first (smallest doc_id, then place).

Content-defined cuts seldom fall on a passage's own edges, so `remove_repeated_passages` also takes every line with the
next line that holds a word (a link, with the blank lines between them) and every single line of LEAST_WORDS words.  Links
that stand earlier are chained to runs; a run of LEAST_WORDS words goes, wherever its edges are, and so does a long line.
A removed line always stands at an earlier place too, so the first place of each line is never lost.  The lines of a run
stand earlier pair by pair, which is weaker than the whole run standing at one place.  `remove_repeated_chunks` takes the
chunks alone.

Chunks, links and lines are first met by a 128-bit hash (small rows: hash, document, place); only hashes that come twice have their bytes
cut out, and only where all bytes under one hash are equal (the least equals the greatest) anything is removed.  Sums
and minima are pre-aggregated, so one chunk may hold a third of all rows.

Null and empty texts have no chunks and stay as they are.  A text whose chunks all go becomes empty.  Rows of one doc_id
with one text are one document and get the same result; other texts of that id are documents of their own.  Rows without
an id are returned as they are and make nothing repeated.  Extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import large_text, map_slices, written
from spindrift.llm.repeats import KEY, keys_of

WINDOW, MASK_BITS, LEAST = 2, 1, 2
#: Least words of a repeated run of lines, or of a repeated single line.
LEAST_WORDS = 20
CHUNK, LINK, LINE = 0, 1, 2
#: Most bytes of places that are sent to the texts; beyond that texts and places are shuffled.
BROADCAST_BYTES = 48 << 20
MASK64 = (1 << 64) - 1


def line_hashes(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) for x in lines]


def chunks_of(hashes: list[int]) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk."""
    out, start, n = [], 0, len(hashes)
    mask = ((1 << MASK_BITS) - 1) << 40
    for i in range(n):
        if i + 1 - start < LEAST:
            continue
        roll = 0
        for h in hashes[i + 1 - WINDOW : i + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & MASK64
        if not (roll * 0xBF58476D1CE4E5B9 & MASK64) & mask:
            out.append((start, i + 1 - start))
            start = i + 1
    if start < n:
        out.append((start, n - start))
    return out


def split(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


def units(lines: list[bytes], passages: bool) -> list[tuple[int, int, int]]:
    """(kind, first line, lines) of all that may be met again: chunks and, for passages, links and long lines."""
    n_words = [len(x.split()) for x in lines]
    out = [(CHUNK, a, n) for a, n in chunks_of(line_hashes(lines)) if n >= LEAST and any(n_words[a : a + n])] if len(lines) >= LEAST else []
    if passages:
        full = [i for i, n in enumerate(n_words) if n]
        out += [(LINK, i, k + 1 - i) for i, k in zip(full, full[1:], strict=False)]
        out += [(LINE, i, 1) for i in full if n_words[i] >= LEAST_WORDS]
    return out


def unit_rows(part: pa.RecordBatch, passages: bool) -> pa.RecordBatch:
    a, b, doc, own, at, n, kinds = [], [], [], [], [], [], []
    for d, t, text in zip(*(part.column(c).to_pylist() for c in KEY), large_text(part.column("text")).to_pylist(), strict=True):
        lines = split(text)
        for kind, first, count in units(lines, passages):
            h = xxhash.xxh3_128_intdigest(b"\n".join(lines[first : first + count]), kind)
            a.append((h >> 64) - (1 << 63))
            b.append((h & MASK64) - (1 << 63))
            doc.append(d)
            own.append(t)
            at.append(first)
            n.append(count)
            kinds.append(kind)
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(kinds, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["c1", "c2", *KEY, "first", "n", "kind"])


def cut_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    a, b, body = [], [], []
    for text, places in zip(large_text(part.column("text")).to_pylist(), part.column("places").to_pylist(), strict=True):
        lines = split(text)
        for p in places:
            a.append(p["c1"])
            b.append(p["c2"])
            body.append(b"\n".join(lines[p["first"] : p["first"] + p["n"]]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], names=["c1", "c2", "body"])


def sent_or_shuffled(small: DataFrame, row_bytes: int) -> DataFrame:
    """small with a broadcast hint if its checked size is bounded."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def sent_lists(rows: DataFrame, column: str, item_bytes: int) -> DataFrame:
    """rows (KEY and an array) with a broadcast hint if all its items together are bounded: a row holds a document's."""
    n, items = rows.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(rows) if n * 80 + (items or 0) * item_bytes <= BROADCAST_BYTES else rows


def removals(docs: DataFrame, passages: bool = False) -> DataFrame:
    """KEY and gone (array of first line, lines, kind): what stands at an earlier place too.

    Counts and the place to keep are combined before their shuffle: a chunk is a row a task there.  Places then meet
    them in joins whose heavy keys adaptive execution splits, as the other side has one row a key.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(*keys_of(), "text")
    rows = written(map_slices(texts, lambda part: unit_rows(part, passages), "c1 long, c2 long, doc_id long, text_hash long, first int, n int, kind int"), "chunks")
    place = F.struct(*KEY, "first")
    twice = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c1", "c2")
    again = written(rows.join(twice, ["c1", "c2"], "left_semi"), "again")
    places = written(again.groupBy(*KEY).agg(F.collect_set(F.struct("c1", "c2", "first", "n")).alias("places")), "places")
    cuts = map_slices(texts.join(sent_lists(places, "places", 32), KEY).select("text", "places"), cut_rows, "c1 long, c2 long, body binary")
    same = cuts.groupBy("c1", "c2").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo = hi").select("c1", "c2")
    keep = again.groupBy("c1", "c2").agg(F.min(place).alias("keep")).join(same, ["c1", "c2"], "left_semi")
    gone = again.join(written(keep, "keep"), ["c1", "c2"]).where(place != F.col("keep"))
    return gone.groupBy(*KEY).agg(F.collect_set(F.struct("first", "n", "kind")).alias("gone"))


def dropped(lines: list[str], found: list) -> np.ndarray:
    """Which lines go, given the chunks, links and long lines that stand earlier."""
    drop = np.zeros(len(lines), bool)
    run: list[int] = []
    for kind, first, end in sorted((x["kind"], x["first"], x["first"] + x["n"]) for x in found):
        if kind != LINK:
            drop[first:end] = True
        elif run and first == run[1] - 1:  # a link begins at the line that the one before it ends with
            run[1] = end
        else:
            drop_run(drop, lines, run)
            run = [first, end]
    drop_run(drop, lines, run)
    return drop


def drop_run(drop: np.ndarray, lines: list[str], run: list[int]) -> None:
    if run and sum(len(x.encode().split()) for x in lines[run[0] : run[1]]) >= LEAST_WORDS:
        drop[run[0] : run[1]] = True


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with text less its repeated chunks, runs of lines and long lines, and the numbers of `remove_repeated_chunks`."""
    return remove_repeated_chunks(docs, passages=True)


def remove_repeated_chunks(docs: DataFrame, passages: bool = False) -> DataFrame:
    """docs with text less its repeated chunks, and n_lines, n_removed_lines, n_removed_chunks (long; stretches of lines)."""
    gone = sent_lists(written(removals(docs, passages), "gone"), "gone", 24)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    rest = [f for f in docs.schema if f.name in kept and f.name != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias("row"), *keys_of(), "text")
    both = rows.join(gone, KEY, "left").select("row", "text", "gone")

    def apply(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_gone, n_chunks = [], [], [], []
        for text, found in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            drop = dropped(lines, found or [])
            n_lines.append(len(lines))
            n_gone.append(int(drop.sum()))
            n_chunks.append(int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum()))
            texts.append(text if not n_gone[-1] else "\n".join(x for x, d in zip(lines, drop, strict=True) if not d))
        cols = [part.column("row"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (n_lines, n_gone, n_chunks))]
        return pa.RecordBatch.from_arrays(cols, names=["row", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])

    schema = f"row {both.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed_lines long, n_removed_chunks long"
    out = map_slices(both, apply, schema)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept), "n_lines", "n_removed_lines", "n_removed_chunks")
