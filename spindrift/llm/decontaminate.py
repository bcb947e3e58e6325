"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words (2^WORD_BITS buckets) over all documents.
2. A randomised singular value decomposition of TF-IDF rows: the benchmark's items and a bounded sample of corpus
   passages (SAMPLE documents by hash of the id; items weigh ITEM_WEIGHT).  Executors hold the rows and return
   products with thin matrices; the driver orthogonalises.  The right singular vectors map words to RANK dimensions.
3. Every passage of every document (PASSAGE words, half overlapping, whole texts) is mapped and compared with every
   item by cosine, in blocks; an item at COSINE or more is a candidate, without a limit on their number.  So is, whatever
   its cosine, every item that could hold LCS of its words: its rarest words (POSTED of its length) are posted, and a
   passage whose surroundings hold fewer of them than LCS leaves after all other words can't be confirmed.  This path is
   exact, so rank, sample and the benchmark's size have no part in which pairs are found.
4. A candidate goes on if the words that item and passage share, an upper bound of what follows, hold LCS of the
   item's words.  It is confirmed on words: the longest common subsequence of the item and the passage (widened by the item's
   length on both sides) must hold LCS of the item's words, and its answer (the last quarter of the words) ANSWER of its.

The benchmark is the stated query set; more than ITEMS items are searched in groups of ITEMS, so what goes to the
executors is bounded.  Texts without words, null rows and an empty benchmark give no pair.  Repeated rows give the
pair once.  Words are lower-cased and trimmed of punctuation; those left empty are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import give_back, map_slices, mix64, words_of

WORD_BITS, RANK, EXTRA, ROUNDS = 15, 152, 8, 2
PASSAGE, SAMPLE, ITEM_WEIGHT, ITEMS = 48, 1500, 4.0, 5000
COSINE, LCS, ANSWER = 0.45, 0.6, 0.5
#: Share of an item's words, from the rarest on, that the exact path looks up; above 1 - LCS nothing is lost, so it only sets the time.
POSTED = 0.6
#: Most (document, item) sums of a slice that are formed to leave out what no region can hold; beyond, regions alone decide.
MOST_CELLS = 1 << 22
#: Text searched at once in a task: its passages' vectors take some ten times as much.
SEARCH_BYTES = 1 << 20
TRIM = ".,;:!?\"'()[]{}*#$%&|<>"


def byte_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string from its bytes and their places, without a loop over the strings."""
    strings = strings.cast(pa.large_string())
    buffers = strings.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    lens = np.diff(offsets)
    out = np.zeros(len(strings), np.uint64)
    full = lens > 0
    if full.any():
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(lens.max()), 0x9E3779B97F4A7C15, np.uint64))
            out[full] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(raw)) - np.repeat(starts, lens)], starts[full])
            out += lens.astype(np.uint64)
    return mix64(out)


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(offsets, bucket of each word, code of each word, trimmed unique words); words that are only punctuation go."""
    offsets, codes, uniques = words_of(column)
    trimmed = pc.utf8_lower(pc.utf8_trim(uniques.cast(pa.string()), TRIM))
    full = pc.not_equal(trimmed, "").to_numpy(zero_copy_only=False)
    bucket = (byte_hashes(trimmed) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    if not full.all():
        keep = full[codes]
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return offsets, bucket[codes] if len(codes) else np.zeros(0, np.int32), codes, trimmed


def frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each bucket comes; the last number is how many documents there are."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, bucket, _, _ = buckets_of(part.column("text"))
        n = np.zeros(1 << WORD_BITS, np.int64)
        for lo in range(0, part.num_rows, 1 << 16):  # 32-bit numbers sort several times faster
            hi = min(lo + (1 << 16), part.num_rows)
            doc = np.repeat(np.arange(hi - lo, dtype=np.uint32), np.diff(offsets[lo : hi + 1]))
            seen = np.sort((doc << np.uint32(WORD_BITS)) | bucket[offsets[lo] : offsets[hi]].astype(np.uint32))
            first = np.ones(len(seen), bool)
            first[1:] = seen[1:] != seen[:-1]
            n += np.bincount(seen[first] & np.uint32((1 << WORD_BITS) - 1), minlength=1 << WORD_BITS)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << WORD_BITS)), pa.array(np.append(n[at], part.num_rows))], names=["b", "n"])

    got = map_slices(docs.select("text"), count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << WORD_BITS) + 1)
    out[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of y's columns by the Gram matrix, which needs no copies of y in double precision."""
    gram = np.zeros((y.shape[1], y.shape[1]))
    for lo in range(0, len(y), 4096):
        part = y[lo : lo + 4096].astype(np.float64)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values = np.maximum(values[order], max(values.max(), 1e-30) * 1e-12)
    return y @ (vectors[:, order] / np.sqrt(values)).astype(np.float32)


def decompose(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the TF-IDF rows (text, weight)."""
    spark = rows.sparkSession
    size, width = 1 << WORD_BITS, rank + EXTRA
    parts = min(4, max(1, rows.count() // 256))
    rows = rows.repartition(parts).persist()
    basis = np.random.default_rng(7).standard_normal((size, width), dtype=np.float32)
    for _ in range(ROUNDS + 1):
        box = spark.sparkContext.broadcast(basis)

        def product(batches, box=box):
            """A'A times the basis over this task's rows."""
            out = np.zeros((size, width), np.float32)
            for b in batches:
                offsets, bucket, _, _ = buckets_of(b.column("text"))
                weight = b.column("weight").to_numpy(zero_copy_only=False)
                for i in range(b.num_rows):
                    own, n = np.unique(bucket[offsets[i] : offsets[i + 1]], return_counts=True)
                    x = (n * idf[own]).astype(np.float32)
                    norm = np.sqrt((x * x).sum())
                    if norm > 0:
                        x *= weight[i] / norm
                        out[own] += x[:, None] * (x @ box.value[own])
            for lo in range(0, size, 1024):  # in small rows: a whole matrix in one would be copied several times on its way
                part = out[lo : lo + 1024]
                at = np.flatnonzero(part.any(axis=1))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([(at + lo).astype("<i4").tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["at", "m"])
            del out
            give_back()

        total = np.zeros((size, width), np.float32)
        for r in rows.mapInArrow(product, "at binary, m binary").toLocalIterator():
            total[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["m"], np.float32).reshape(-1, width)
        basis = orthonormal(orthonormal(total))
        box.unpersist()
        del total
        give_back()
    rows.unpersist()
    return basis[:, :rank]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = places.get(y, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def latent(bucket: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of the words' vectors from each start to the next (starts ascending, none empty), in bounded steps."""
    out = np.empty((len(starts), vectors.shape[1]), np.float32)
    ends = np.append(starts[1:], len(bucket))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 8192, side="right")))
        out[i:j] = np.add.reduceat(vectors[bucket[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0)
        i = j
    return out


def posted(items: list, rarity: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings of the items' rarest words: (offsets by word, item, weight), and each item's length and least weight.

    The weight of a word is how often the item has it; a region with less than the least weight can't hold LCS of it.
    """
    words, owner, weight, lens, least = [], [], [], [], []
    for q, (_, own, distinct, _) in enumerate(items):
        n = {w: own.count(w) for w in distinct}
        total = 0
        for w in sorted(n, key=lambda w: (-rarity[w], w)):
            if total >= POSTED * len(own):
                break
            total += n[w]
            words.append(w)
            owner.append(q)
            weight.append(n[w])
        lens.append(len(own))
        least.append(LCS * len(own) - (len(own) - total) - 1e-6)
    words, owner, weight = (np.array(x, np.int64) for x in (words, owner, weight))
    order = np.argsort(words, kind="stable")
    return np.searchsorted(words[order], np.arange(len(rarity) + 1)), owner[order], weight[order], np.array(lens, np.int64), np.array(least)


def possible(known: np.ndarray, offsets: np.ndarray, blocks: np.ndarray, posts: tuple[np.ndarray, ...]) -> np.ndarray:
    """(passage, item) rows, ascending: all pairs whose words around the passage may hold LCS of the item's words."""
    at, owner, weight, lens, least = posts
    step = PASSAGE // 2
    place = np.flatnonzero(known >= 0)
    count = (at[known[place] + 1] - at[known[place]]).astype(np.int64)
    place, count = place[count > 0], count[count > 0]
    row = np.repeat(at[known[place]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place, item, w = np.repeat(place, count), owner[row], weight[row]
    doc = np.searchsorted(offsets, np.arange(len(known)), side="right")[place] - 1
    if (len(offsets) - 1) * len(lens) <= MOST_CELLS:  # what a whole document can't hold its regions can't either
        cell = doc * len(lens) + item
        enough = np.bincount(cell, w, (len(offsets) - 1) * len(lens)) >= np.tile(least, len(offsets) - 1)
        ok = enough[cell]
        place, item, w, doc = place[ok], item[ok], w[ok], doc[ok]
    order = np.argsort(item, kind="stable")  # places ascend already
    place, item, w, doc = place[order], item[order], w[order], doc[order]
    # what the widest region that begins at a word holds, of its own document
    size = len(known) + 1
    end = np.minimum(place + PASSAGE + 2 * lens[item], offsets[doc + 1])
    total = np.concatenate(([0], np.cumsum(w)))
    ok = total[np.searchsorted(item * size + place, item * size + end)] - total[:-1] >= least[item]
    place, item, doc = place[ok], item[ok], doc[ok]
    # the passages whose regions hold that word
    inside, wide = place - offsets[doc], lens[item]
    low = np.maximum(0, -((PASSAGE + wide - 1 - inside) // step))
    high = np.minimum(blocks[doc] - 1, (inside + wide) // step)
    n = np.maximum(high - low + 1, 0)
    passage = np.repeat((np.cumsum(blocks) - blocks)[doc] + low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.unique(np.stack([passage, np.repeat(item, n)], 1), axis=0)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer (shares of the item's and its answer's words), n_passages that agree."""
    spark: SparkSession = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, n_passages long"
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = frequencies(texts)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + np.float32(0.05)
    out = None
    ids = [r[0] for r in items.select("item_id").distinct().orderBy("item_id").toLocalIterator()]
    for lo in range(0, len(ids), ITEMS):
        group = items.where(F.col("item_id").between(ids[lo], ids[min(lo + ITEMS, len(ids)) - 1]))
        found = search(texts, group, idf, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("n_passages").alias("n_passages"))


def search(texts: DataFrame, items: DataFrame, idf: np.ndarray, schema: str) -> DataFrame:
    spark = texts.sparkSession
    sampled = texts.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id")
    # one passage of each sampled document, at a place drawn by its id
    words = texts.join(F.broadcast(sampled), "doc_id").select("doc_id", F.split(F.trim("text"), r"[\x20\x09-\x0D]+").alias("w"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size("w") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    passages = words.select(F.concat_ws(" ", F.slice("w", place, PASSAGE)).alias("text"), F.lit(1.0).alias("weight"))
    vectors = decompose(items.select("text", F.lit(ITEM_WEIGHT).alias("weight")).unionByName(passages), idf)
    table = items.orderBy("item_id", "text").toArrow()
    offsets, bucket, codes, uniques = buckets_of(table.column("text").combine_chunks())
    names = uniques.to_pylist()
    item_words = [[names[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    good = [i for i, w in enumerate(item_words) if w]
    weighted = (vectors * idf[:, None]).astype(np.float32)
    if not good:
        return spark.createDataFrame([], schema)
    own = np.stack([weighted[bucket[offsets[i] : offsets[i + 1]]].sum(0) for i in good])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    item_ids = table.column("item_id").to_numpy()
    vocabulary = sorted({w for x in item_words for w in x})
    number = {w: k for k, w in enumerate(vocabulary)}
    coded = []
    for i in good:
        w = [number[x] for x in item_words[i]]
        coded.append((int(item_ids[i]), w, frozenset(w), len(w) - len(set(w))))
    rarity = np.zeros(len(vocabulary))
    for names_at, b in zip(codes.tolist(), bucket.tolist(), strict=True):
        rarity[number[names[names_at]]] = idf[b]
    box = spark.sparkContext.broadcast((weighted, np.ascontiguousarray(own.T), coded, vocabulary, posted(coded, rarity)))
    del vectors, weighted
    give_back()
    step = PASSAGE // 2

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        vectors, own, items, vocabulary, posts = box.value
        offsets, bucket, codes, uniques = buckets_of(part.column("text"))
        doc_ids = part.column("doc_id").to_pylist()
        n = np.diff(offsets)
        blocks = (n + step - 1) // step
        rows = []
        if len(bucket):
            known = pc.fill_null(pc.index_in(uniques, value_set=pa.array(vocabulary, uniques.type)), -1).to_numpy(zero_copy_only=False)[codes]
            first = np.cumsum(blocks) - blocks
            doc = np.repeat(np.arange(len(n)), blocks)
            k = np.arange(len(doc)) - first[doc]
            starts = offsets[doc] + k * step
            half = latent(bucket, starts, vectors)
            whole = half.copy()
            same = np.flatnonzero(doc[1:] == doc[:-1])
            whole[same] += half[same + 1]
            whole /= np.maximum(np.sqrt(np.einsum("ij,ij->i", whole, whole))[:, None], 1e-9)
            best: dict = {}
            widest = max(len(x[1]) for x in items)
            exact = possible(known, offsets, blocks, posts)
            for lo in range(0, len(whole), 4096):
                sims = whole[lo : lo + 4096] @ own
                near = sims >= COSINE
                part_of = exact[np.searchsorted(exact[:, 0], lo) : np.searchsorted(exact[:, 0], lo + len(sims))]
                near[part_of[:, 0] - lo, part_of[:, 1]] = True
                last = -1
                for p, q in np.argwhere(near).tolist():
                    if p != last:  # the words around the passage, as wide as any item needs
                        i, last = int(doc[lo + p]), p
                        begin = int(starts[lo + p])
                        around = set(known[max(int(offsets[i]), begin - widest) : min(int(offsets[i + 1]), begin + PASSAGE + widest)].tolist())
                    _, words, distinct, more = items[q]
                    if len(distinct & around) + more < LCS * len(words):
                        continue
                    a, b = max(int(offsets[i]), begin - len(words)), min(int(offsets[i + 1]), begin + PASSAGE + len(words))
                    region = known[a:b]
                    region = region[region >= 0].tolist()
                    share = lcs(words, region) / len(words)
                    if share < LCS:
                        continue
                    tail = words[-max(1, len(words) // 4) :]
                    answer = lcs(tail, region) / len(tail)
                    if answer < ANSWER:
                        continue
                    was = best.get((i, q), (0.0, 0.0, 0.0, 0))
                    best[i, q] = (max(was[0], float(sims[p, q])), max(was[1], share), max(was[2], answer), was[3] + 1)
            rows = [(doc_ids[i], items[q][0], *v) for (i, q), v in best.items()]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer", "n_passages"])

    return map_slices(texts, find, schema, most=SEARCH_BYTES)
