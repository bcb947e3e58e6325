"""Token ids in compressed files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block's ids are dealt to lanes (contiguous runs of the block) that are coded side by side, one id of each lane a step,
with one model that starts empty in every block and learns from all lanes after each step:

    P(x) = p2 [x = s2] + (1 - p2) (p1 [x = s1] + (1 - p1) P0(x))

s2 and s1 are the ids last confirmed after the two ids before and after the one id before (order 2, order 1); p2 and p1
are the measured rates at which ids with that much confirmation were right, and mix the orders; P0 are the ids'
frequencies so far (order 0; every id has at least one part in 2^ORDER0_BITS).  Each lane is one 64-bit carry-less range
coder that emits 32-bit digits.  Lanes make the arithmetic vectors, so numpy does a step for thousands of ids at once.

Block: MAGIC, version, ids, lanes, vocabulary, documents, crc32 of the ids (little-endian uint32), crc32 of the rest;
then doc ids, document lengths, digits of each lane, digits.  A block holds whole documents, about BLOCK_IDS ids; a
longer document is a block of its own.  Any damage is found by the two checksums (ValueError).

Blocks are rows of a Spark table (part, block, first, n, payload) in ascending doc_id order: range partitions are parts,
so part, block and first give every document's place without a global count, and Spark's committer makes retried or
lost tasks safe.  Null and empty texts are documents of the end id alone; null doc_ids come first; documents of one id
are ordered by their texts' hash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.bpe import DOC_BYTES, encode_column
from spindrift.llm.common import bounded_batches, give_back, slices

MAGIC, VERSION, HEAD = b"SPTK", 2, "<4sHIIIIII"
BLOCK_IDS, LANES, LEAST_STEPS = 1 << 21, 8192, 64
TOTAL_BITS, ORDER0_BITS, PAIR_BITS, DIGIT_BITS = 28, 20, 18, 32
#: Most of what is left that a prediction may take: two of them leave 2^ORDER0_BITS of 2^TOTAL_BITS for order 0.
MOST_RATE = 1 - 2.0 ** ((ORDER0_BITS - TOTAL_BITS) / 2)
U = np.uint64
DIGIT = U(1 << DIGIT_BITS)
#: Confirmations of a predicted id, 0 to 15, after a miss (even places) and a hit (odd places); a weak one is replaced.
BEFORE = np.arange(32) >> 1
WEAK = (np.arange(32) % 2 == 0) & (BEFORE < 2)
CHANGE = (np.where(np.arange(32) % 2 == 1, np.minimum(BEFORE + 1, 15), BEFORE >> 1) - BEFORE).astype(np.int32)


class Model:
    """Predictions for one step of all lanes; encoder and decoder update it with the same ids in the same order.

    An entry of `one` (by the id before) or `two` (by a hash of the two ids before) is an id and, in its four low bits,
    how often it was confirmed.
    """

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        self.counts, self.fresh = np.zeros(vocabulary, np.int64), []
        self.one, self.two = np.zeros(vocabulary, np.int32), np.zeros(1 << PAIR_BITS, np.int32)
        self.tries, self.hits = np.full((2, 16), 4.0), np.full((2, 16), 1.0)
        self.before, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.next_build = 0, 0
        self.build()

    def build(self):
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.size)
            self.fresh = []
        total = int(self.counts.sum())
        room = (1 << ORDER0_BITS) - self.size
        freq = 1 + (self.counts * room // total if total else np.zeros(self.size, np.int64))
        freq[0] += (1 << ORDER0_BITS) - int(freq.sum())
        self.freq, self.span = freq, ((np.cumsum(freq) - freq) << 32 | freq).astype(np.uint64)  # an id's start and share
        self.table = None
        self.next_build = self.step + (1 if self.step < 4 else min(32, self.step // 2))

    def predict(self, n: int):
        """For the first n lanes: the shares of s2 and s1 and the rest of 2^TOTAL_BITS."""
        a = self.before[:n]
        self.at = a * 0x9E3779B1
        self.at += self.mixed[:n]
        self.at >>= 7
        self.at &= (1 << PAIR_BITS) - 1
        self.e1, self.e2 = self.one.take(a), self.two.take(self.at)
        self.s1, self.s2, self.k1, self.k2 = self.e1 >> 4, self.e2 >> 4, self.e1 & 15, self.e2 & 15
        self.differ = self.s1 != self.s2
        rate = np.minimum(self.hits / self.tries, MOST_RATE)
        f2 = (rate[0] * (1 << TOTAL_BITS)).astype(np.uint64).take(self.k2)
        rest = U(1 << TOTAL_BITS) - f2
        f1 = (rate[1] * (1 << 16)).astype(np.uint64).take(self.k1)
        f1 *= rest
        f1 >>= U(16)
        f1 *= self.differ
        rest -= f1
        return f2, f1, rest

    def update(self, ids: np.ndarray, hit2: np.ndarray, same1: np.ndarray):
        """hit2, same1: where the ids are s2, s1."""
        n = len(ids)
        code2, code1 = (self.k2 << 1) + hit2, (self.k1 << 1) + same1
        # order 1 is measured where order 2 said something else and was wrong
        measured = code1 + ((self.differ > hit2).view(np.int8) << 5)
        for row, found in enumerate((np.bincount(code2, minlength=32), np.bincount(measured, minlength=64)[32:])):
            self.tries[row] += found[::2] + found[1::2]
            self.hits[row] += found[1::2]
        big = self.tries > 1 << 16
        self.tries[big] /= 2
        self.hits[big] /= 2
        fresh = (ids << 4) + 1
        for table, at, code, entry in ((self.two, self.at, code2, self.e2), (self.one, self.before[:n], code1, self.e1)):
            entry += CHANGE.take(code)
            table[at] = np.where(WEAK.take(code), fresh, entry)
        self.fresh.append(ids)
        np.multiply(self.before[:n], 0x85EBCA77, out=self.mixed[:n])
        self.before[:n] = ids
        self.step += 1
        if self.step >= self.next_build:
            self.build()

    def symbols(self) -> np.ndarray:
        if self.table is None:
            self.table = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32), self.freq)
        return self.table


def layout(n: int) -> tuple[int, np.ndarray]:
    """(lanes, ids of each lane); longer lanes come first."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    size = np.full(lanes, n // lanes, np.int64)
    size[: n % lanes] += 1
    return lanes, size


def by_steps(ids: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """The ids as one row of all lanes a step, so that a step reads neighbours; short lanes end with a zero."""
    n_long = len(ids) - lanes * (steps - 1)
    out = np.zeros((steps, lanes), np.int32)
    out[:, :n_long] = ids[: n_long * steps].reshape(n_long, steps).T
    out[:-1, n_long:] = ids[n_long * steps :].reshape(lanes - n_long, steps - 1).T
    return out


def narrowed(rng: np.ndarray, rest: np.ndarray, f2, f1, span: np.ndarray, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, range) of the ids x within the lanes' ranges."""
    r = rng >> U(TOTAL_BITS)
    end = span.take(x)
    start = end >> U(32)
    end &= U((1 << 32) - 1)
    end += start
    start *= rest
    end *= rest
    start >>= U(ORDER0_BITS)
    end >>= U(ORDER0_BITS)
    end -= start
    start += f2
    start += f1
    # all bits or none, instead of copies by a condition: those take longer than all else here
    two, one = U(0) - hit2, U(0) - hit1
    none = ~(two | one)
    start &= none
    start |= f2 & one
    end &= none
    end |= f1 & one
    end |= f2 & two
    start *= r
    end *= r
    return start, end


def compress(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, digits of each lane, all digits lane after lane)."""
    n = len(ids)
    lanes, size = layout(n)
    model = Model(vocabulary, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []
    rows = by_steps(ids, lanes, int(size[0])) if n else np.zeros((0, lanes), np.int32)

    def emit(at, lo):
        who.append(at)
        what.append((lo >> U(DIGIT_BITS)).astype(np.uint32))

    for step in range(int(size[0])):
        k = lanes if step < size[-1] else int((size > step).sum())
        x = rows[step, :k]
        f2, f1, rest = model.predict(k)
        hit2, same1 = x == model.s2, x == model.s1
        offset, rng[:k] = narrowed(rng[:k], rest, f2, f1, model.span, x, hit2, same1 > hit2)
        low[:k] += offset
        shift(low, rng, k, emit)
        model.update(x, hit2, same1)
    for _ in range(2):  # the rest of every lane's interval
        emit(np.arange(lanes), low)
        low <<= U(DIGIT_BITS)
    who, what = np.concatenate(who).astype(np.uint16 if lanes <= 1 << 16 else np.uint32), np.concatenate(what)
    return lanes, np.bincount(who, minlength=lanes).astype(np.uint32), what[np.argsort(who, kind="stable")]


def shift(low, rng, k, emit):
    """Bring the ranges of the first k lanes back to a digit at least; emit(lanes, their low ends) is called before the shift.

    A range under a digit is shifted once; where its first digit isn't settled it is cut so that it is.  No range is
    empty, so that one shift makes it a digit at least.
    """
    at = np.flatnonzero(rng[:k] < DIGIT)
    if len(at):
        lo, ra = low[at], rng[at]
        open_ = (lo ^ (lo + ra)) >= DIGIT
        if open_.any():
            ra[open_] = (~lo[open_] + U(1)) & (DIGIT - U(1))
        emit(at, lo)
        low[at] = lo << U(DIGIT_BITS)
        rng[at] = ra << U(DIGIT_BITS)


def decompress(n: int, vocabulary: int, lanes: int, counts: np.ndarray, digits: np.ndarray) -> np.ndarray:
    own, size = layout(n)
    if own != lanes:
        raise ValueError("lanes don't fit the ids")
    model = Model(vocabulary, lanes)
    at = np.cumsum(counts.astype(np.int64)) - counts
    digits = np.concatenate([digits, np.zeros(8, np.uint32)])
    code = np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = (code << U(DIGIT_BITS)) | digits[at]
        at += 1
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    rows = np.empty((int(size[0]), lanes), np.int32)

    def feed(who, _):
        code[who] = (code[who] << U(DIGIT_BITS)) | digits[np.minimum(at[who], len(digits) - 1)]
        at[who] += 1

    for step in range(int(size[0])):
        k = lanes if step < size[-1] else int((size > step).sum())
        f2, f1, rest = model.predict(k)
        v = code[:k] - low[:k]
        v //= rng[:k] >> U(TOTAL_BITS)
        both = f2 + f1
        hit2 = v < f2
        hit1 = (v < both) > hit2
        # operands under 2^48, quotients under 2^20: the quotient of doubles has the exact whole part
        u = np.maximum(v, both) - both
        u = np.floor((((u + U(1)) << U(ORDER0_BITS)) - U(1)).astype(np.float64) / rest.astype(np.float64)).astype(np.int64)
        x = model.symbols().take(np.minimum(u, (1 << ORDER0_BITS) - 1)).astype(np.int32)
        x = np.where(hit2, model.s2, np.where(hit1, model.s1, x))
        offset, rng[:k] = narrowed(rng[:k], rest, f2, f1, model.span, x, hit2, hit1)
        low[:k] += offset
        shift(low, rng, k, feed)
        rows[step, :k] = x
        model.update(x, hit2, x == model.s1)
    n_long = int((size == size[0]).sum())
    return np.concatenate([rows[:, :n_long].T.ravel(), rows[:-1, n_long:].T.ravel()])


def pack(doc_ids: list, lens: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of whole documents."""
    lanes, counts, digits = compress(ids, vocabulary)
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = null.tobytes() + np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + lens.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + digits.astype("<u4").tobytes()
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    return struct.pack(HEAD, MAGIC, VERSION, len(ids), lanes, vocabulary, len(doc_ids), crc, zlib.crc32(body)) + body


def unpack(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, ids of each document, ids as uint32) of a block; ValueError if it is damaged."""
    if len(block) < struct.calcsize(HEAD):
        raise ValueError("the block is cut short")
    magic, version, n, lanes, vocabulary, docs, crc, body_crc = struct.unpack_from(HEAD, block)
    body = memoryview(block)[struct.calcsize(HEAD) :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != body_crc:
        raise ValueError("the block is damaged")
    null = np.frombuffer(body, np.uint8, docs)
    own = np.frombuffer(body, "<i8", docs, docs)
    lens = np.frombuffer(body, "<u4", docs, 9 * docs).astype(np.int64)
    counts = np.frombuffer(body, "<u4", lanes, 13 * docs)
    ids = decompress(n, vocabulary, lanes, counts, np.frombuffer(body, "<u4", -1, 13 * docs + 4 * lanes)).astype(np.uint32)
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
        raise ValueError("the ids are damaged")
    return [None if z else int(d) for d, z in zip(own, null, strict=True)], lens, ids


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, vocabulary: int | None = None) -> None:
    """Encode every whole text, add end_id to each document and write the blocks as a table at path."""
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)

    def blocks(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        lens: list[int] = []
        size = 0

        def done():
            nonlocal block, first, names, held, lens, size
            payload = pack(names, np.array(lens, np.int64), np.concatenate(held), vocabulary)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "first", "n", "payload"])
            block, first = block + 1, first + size
            names, held, lens, size = [], [], [], 0
            give_back()
            return row

        for b in slices(batches, "text", DOC_BYTES):
            ids, offsets = encode_column(b.column("text"), tokenizer)
            for d, a, z in zip(b.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                n = int(z - a) + 1
                if size and size + n > BLOCK_IDS:
                    yield done()
                names.append(d)
                held.append(np.append(ids[a:z], np.uint32(end_id)))
                lens.append(n)
                size += n
        if size:
            yield done()

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(blocks, "part int, block int, first long, n long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone.

    Only the parts' totals (one row a file) are added up in one place.
    """
    table = spark.read.schema("part int, block int, first long, n long, payload binary").parquet(path)
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def open_blocks(batches):
        for batch in batches:
            for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "payload")), strict=True):
                names, lens, ids = unpack(payload)
                ends = np.cumsum(lens)
                raw = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base[part] + first + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "first", "payload").mapInArrow(open_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")
