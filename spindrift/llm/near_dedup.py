"""Near-duplicate classes by b-bit MinHash.

1. One pass over the texts makes, for each document, the set of distinct 5-word shingles (64-bit hashes), a digest of
   the whole set, band keys of a few minima each, and the low BITS bits of PERMS minima packed into longs.  Only these
   few hundred bytes are written to the shared folder.
2. Documents with equal sets are one class with its smallest id as representative (a pre-aggregated group-by), so
   thousands of copies cost one row from here on.
3. Bands of the representatives give candidates.  A band key that several share links its members to a hub (a star:
   members, not pairs): the member whose keys are shared most often, which is the text that the others were edited
   from.  Candidates whose packed bits put the collision-corrected similarity (matches / PERMS - C) / (1 - C),
   C = 2^-BITS, clearly below the threshold are dropped; the rest are confirmed on the full sets, which only documents
   in candidate pairs recompute.  A second round does the same for members that the first left outside the hub's
   component, with the most shared of them as hub.
4. Connected components over confirmed links by min-label propagation with checkpoints.
5. What the stars may have missed is searched in full: members of one key in different components.  First, exactly and
   in linear time, members are set aside that can link with nobody: those of whose shingles fewer than the threshold's
   share stands in any other open member's set (an upper bound of the similarity).  The others get a sharper sketch of
   SHARP single bits.  Every pair of them, of one key and different components, taken at the first key that it shares,
   whose sizes and sharp bits allow the threshold, is confirmed on the full sets, and components are merged.  Copies
   and near copies, already one component, make no pairs.

`banding` takes as many minima a key as keep the probability that a pair at the threshold shares no key under MISS: 25
keys of 5 minima at 85 percent (4e-7), 32 of 4 at 80 (5e-8).  Null, blank and empty
texts have an empty set and are linked with nothing; a text of fewer than 5 words is one shingle.  Repeated rows
give repeated, equal results.  A row without doc_id is kept unless another row's set equals its own.  Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import hashes_of, map_slices, mix64, shared_dir, words_of, written

WORDS, PERMS, BITS = 5, 128, 4
#: Most probability that a pair at the threshold shares no band key.
MISS = 1e-6
#: Standard deviations of the estimate below the threshold at which a candidate is dropped unconfirmed: of a star (the
#: full search finds it again) and of the full search, whose sketches have SHARP bits.
STAR_SLACK, SLACK, SHARP = 1.5, 5, 1024
#: Most ids that are broadcast to the texts (about 40 MB); beyond that ids and texts are shuffled.
BROADCAST_IDS = 1_000_000


def shingles(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, codes, uniques = words_of(column, lower=True)
    own = hashes_of(uniques, 9)[codes]
    if not len(own):
        return [own] * (len(offsets) - 1)
    acc = np.zeros(len(own), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n if len(own) >= n else 0):
            acc[: len(own) - j] = mix64(acc[: len(own) - j] * np.uint64(3) + own[j:] + np.uint64(j))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(acc[a : b - n + 1]))
        elif b > a:  # fewer words: the whole sequence is the one shingle
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in own[a:b]:
                    x = mix64(np.array([x * np.uint64(5) + w], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, PERMS) 32-bit minima of each set under multiply-shift permutations; sets must not be empty."""
    a, b = permutations()
    x = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), PERMS), np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(sets), 256):  # a block of documents stays in cache
            hi = min(lo + 256, len(sets))
            end = starts[hi] if hi < len(sets) else len(x)
            part, at = x[starts[lo] : end], starts[lo:hi] - starts[lo]
            for k in range(PERMS):
                out[lo:hi, k] = np.minimum.reduceat(((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, minima of each) for a threshold."""
    fit = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (PERMS // r) <= MISS]
    rows = max(fit, default=1)
    return PERMS // rows, rows


def sketch(part: pa.RecordBatch, bands: int, rows: int) -> pa.RecordBatch:
    sets = shingles(part.column("text"))
    full = [i for i, s in enumerate(sets) if len(s)]
    size = np.array([len(s) for s in sets], np.int64)
    digest = np.zeros((len(sets), 2), np.int64)
    keys: list = [[]] * len(sets)
    bits: list = [[]] * len(sets)
    if full:
        kept = [sets[i] for i in full]
        with np.errstate(over="ignore"):
            digest[full, 0] = [int(np.add.reduce(s).view(np.int64)) for s in kept]
            digest[full, 1] = [int(np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) for s in kept]
            m = minima(kept)
            band = np.zeros((len(full), bands), np.uint64)
            for r in range(rows):
                band = mix64(band * np.uint64(7) + m[:, r : bands * rows : rows][:, :bands].astype(np.uint64))
            band = mix64(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
        nibble = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(full), -1, 64 // BITS)
        packed = (nibble << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)
        for j, i in enumerate(full):
            keys[i], bits[i] = band[j], packed[j]
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(keys, lists), pa.array(bits, lists)], names=["doc_id", "n_shingles", "d1", "d2", "keys", "bits"])


def shingle_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.view(np.int64) for s in shingles(part.column("text"))], pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def matches(a: str, b: str) -> Column:
    """How many of the PERMS minima agree in their low bits: bit counts over the packed longs."""
    total = F.lit(0)
    low = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS))).cast("long")
    for k in range(PERMS * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(folded.bitwiseAND(low))
    return F.lit(PERMS) - total


def least_matches(percent: int, n: int = PERMS, bits: int = BITS, slack: float = STAR_SLACK) -> int:
    """The fewest agreeing minima, of n with so many bits, of a candidate worth confirming."""
    c, j = 2.0**-bits, percent / 100
    p = c + (1 - c) * j
    return int(np.floor(n * p - slack * np.sqrt(n * p * (1 - p))))


def sharp_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id and SHARP one-bit minima of each set, packed into longs; the bit is one of the smallest value's low bits."""
    rng = np.random.default_rng(21)
    a = rng.integers(1, 1 << 63, SHARP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for row in part.column("shingles"):
        x = np.asarray(row.values).view(np.uint64)
        bits = np.empty(SHARP, bool)
        with np.errstate(over="ignore"):
            for k in range(0, SHARP, 64):
                v = (x[:, None] * a[k : k + 64]).min(axis=0)
                bits[k : k + 64] = (mix64(v) & np.uint64(1)).astype(bool)
        out.append(np.packbits(bits).view(np.int64))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "sharp"])


def sharp_matches(a: str, b: str) -> Column:
    apart = F.lit(0)
    for k in range(SHARP // 64):
        apart = apart + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return F.lit(SHARP) - apart


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union over the full shingle sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb")
    return both.select("a", "b", inter.alias("i"), union.alias("u")).where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("u") - F.col("i"))).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) for the ids that links (a, b) touch: comp is the smallest id reachable.

    Each round sends the smaller label across every link and then jumps to the label's own label, so the number of
    rounds grows with the logarithm of a chain; rounds are checkpointed.
    """
    spark = links.sparkSession
    shared_dir(spark)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).checkpoint()
    while True:
        sent = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("got"))
        stepped = labels.join(sent, "id").select("id", F.least("comp", "got").alias("comp"), F.col("comp").alias("was"))
        roots = stepped.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        now = stepped.join(roots, "comp").select("id", F.least("comp", "root").alias("comp"), "was").checkpoint()
        changed = now.where("comp <> was").limit(1).count()
        labels = now.select("id", "comp")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id, kept, for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, band_rows = banding(percent)
    base = written(map_slices(texts, lambda part: sketch(part, bands, band_rows), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, bits array<long>"), "sketches")
    full = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "keys", "bits")).alias("m")).select("n_shingles", "d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.keys").alias("keys"), F.col("m.bits").alias("bits"))
    classes = written(classes, "classes")
    reps = classes.select("rep", "n_shingles", "bits")
    banded = classes.select("rep", "n_shingles", F.posexplode("keys").alias("band", "key"))
    keys = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # only keys that several representatives share go on
    shared = written(banded.join(keys, ["band", "key"]), "shared")
    popular = shared.groupBy("rep").agg(F.sum("members").alias("popular"))
    shared = written(shared.join(popular, "rep").select("rep", "n_shingles", "band", "key", F.struct("popular", (-F.col("rep")).alias("minus")).alias("rank")), "ranked")
    close = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    low = least_matches(percent)
    lists = shared.select(F.col("rep").alias("doc_id")).distinct().join(reps, F.col("doc_id") == F.col("rep")).select("rep", "n_shingles", "bits")
    bits = written(lists, "bits")

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and packed bits allow the threshold."""
        x = pairs.join(bits.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba")), "a")
        x = x.join(bits.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb")), "b")
        return x.where(close("na", "nb") & (matches("ba", "bb") >= low)).select("a", "b")

    # the full sets of all that share a key, made once; ids go to the texts while they are few
    members = bits.select(F.col("rep").alias("doc_id"))
    sent = F.broadcast(members) if bits.count() <= BROADCAST_IDS else members
    sets = written(map_slices(texts.join(sent, "doc_id", "left_semi"), shingle_rows, "doc_id long, shingles array<long>"), "sets")

    def star(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Confirmed links of rows (rep, band, key) with the hub of their key."""
        pairs = rows.join(hubs, ["band", "key"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        pairs = written(tested(pairs), "stars")
        return written(confirmed(pairs, sets, percent), "links")

    def placed(comp: DataFrame) -> DataFrame:
        """The rows of keys whose members stand in several components."""
        x = shared.join(comp, F.col("rep") == F.col("id"), "left").select("rep", "n_shingles", "band", "key", "rank", F.coalesce("comp", "rep").alias("comp"))
        split = x.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("rank", "comp")).alias("top")).where("lo < hi")
        return written(x.join(split.select("band", "key", F.col("top.comp").alias("top")), ["band", "key"]), "open")

    hub_of = lambda rows: rows.groupBy("band", "key").agg((-F.max("rank")["minus"]).alias("hub"))
    links = star(shared, hub_of(shared))
    comp = written(components(reps, links), "components")
    others = placed(comp).where("comp <> top")
    links = links.unionByName(star(others, hub_of(others)))
    comp = written(components(reps, links), "components")
    rest = placed(comp)
    open_sets = sets.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    for _ in range(2):  # set aside who can link with nobody; without them the bound of others may fall
        each = open_sets.select("doc_id", F.explode("shingles").alias("g"))
        common = each.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
        held = each.join(common, "g").groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"))
        able = open_sets.join(held, "doc_id").where(F.lit(100) * F.col("held") >= F.lit(percent) * F.size("shingles"))
        open_sets = written(able.select("doc_id", "shingles"), "able")
    sharp = open_sets.mapInArrow(lambda batches: (sharp_rows(b.slice(i, 512)) for b in batches for i in range(0, b.num_rows, 512)), "doc_id long, sharp array<long>")
    own_keys = classes.select("rep", "keys").join(bits.select("rep"), "rep", "left_semi")
    rest = rest.join(sharp.withColumnRenamed("doc_id", "rep"), "rep").join(own_keys, "rep")
    rest = written(rest.select("rep", "n_shingles", "band", "key", "comp", "sharp", "keys"), "rest")
    x = rest.select(*(F.col(c).alias(f"x_{c}") for c in rest.columns))
    y = rest.select(*(F.col(c).alias(f"y_{c}") for c in rest.columns))
    meet = (F.col("x_band") == F.col("y_band")) & (F.col("x_key") == F.col("y_key")) & (F.col("x_comp") < F.col("y_comp"))
    sharp_low = least_matches(percent, SHARP, 1, SLACK)
    before = F.zip_with(F.slice("x_keys", 1, F.col("x_band")), F.slice("y_keys", 1, F.col("x_band")), lambda p, q: p == q)
    first = ~F.array_contains(before, True)  # a pair is taken at the first key that it shares
    cross = x.join(y, meet & close("x_n_shingles", "y_n_shingles") & (sharp_matches("x_sharp", "y_sharp") >= sharp_low) & first).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
    more = written(confirmed(written(cross, "cross"), open_sets, percent), "more_links")
    comp = components(reps, links.unionByName(more))
    final = classes.join(comp, F.col("rep") == F.col("id"), "left").select("n_shingles", "d1", "d2", "rep", F.coalesce("comp", "rep").alias("comp"))
    out = base.select("doc_id", "n_shingles", "d1", "d2").join(final, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
