"""Quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes; each byte carries one more bit that says whether the eight bytes from it stood within the
LAGS bytes before (stuttering text).  FILTERS learned filters of WIDTH such symbols run over the whole text; their
outputs are max-pooled over overlapping chunks of two blocks of BLOCK bytes, a small dense layer scores each chunk, and
the mean and the maximum of the chunk scores give one probability.  Every chunk of a document counts; nothing is cut.

Training is by Adam on a bounded sample of labelled rows (TRAIN_ROWS of each class, CHUNKS chunks of each), drawn by
hash of the id; then the bias is set back from the balanced sample to the share of the classes in all labels.  Scoring is
a map over bounded slices: no shuffle, no state.  Null and empty texts are one block of padding and get a score like
any other.  Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import crc_mod, give_back, large_text, map_slices

BLOCK, WIDTH, FILTERS, HIDDEN, LAGS, GAP = 128, 6, 16, 8, 24, 32
PAD = 512
#: Bounds of the training sample: rows of each class, chunks of a row.
TRAIN_ROWS, CHUNKS = 2000, 6


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, blocks of each text, bytes of each text): each text padded to whole blocks with at least GAP pads."""
    text = large_text(column)
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    blocks = (size + GAP + BLOCK - 1) // BLOCK
    starts = np.concatenate(([0], np.cumsum(blocks * BLOCK)))
    out = np.full(starts[-1] + WIDTH + 8, 0, np.uint16)
    inside = np.zeros(starts[-1] + WIDTH + 8, bool)
    for i, n in enumerate(size):
        out[starts[i] : starts[i] + n] = raw[offsets[i] : offsets[i] + n]
        inside[starts[i] : starts[i] + n] = True
    n = starts[-1]
    gram = np.zeros(n + LAGS, np.uint64)
    for j in range(8):
        gram[LAGS:] |= out[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    again = np.zeros(n, bool)
    for lag in range(2, LAGS + 1):
        again |= gram[LAGS:] == gram[LAGS - lag : LAGS - lag + n]
    out[:n][again] += 256
    out[~inside] = PAD
    return out, blocks, size


def pooled(sym: np.ndarray, table: np.ndarray, n_blocks: int) -> np.ndarray:
    """The largest output of each filter in each block."""
    out = np.empty((n_blocks, table.shape[2]), np.float32)
    step = 128
    for b in range(0, n_blocks, step):
        k = min(step, n_blocks - b)
        at = b * BLOCK
        act = table[0].take(sym[at : at + k * BLOCK], axis=0)
        for j in range(1, WIDTH):
            act += table[j].take(sym[at + j : at + j + k * BLOCK], axis=0)
        out[b : b + k] = act.reshape(k, BLOCK, -1).max(axis=1)
    return out


def chunk_scores(h: np.ndarray, net: dict) -> np.ndarray:
    r = np.maximum(np.maximum(h + net["bias"], 0) @ net["w1"] + net["b1"], 0)
    return r @ net["w2"] + net["b2"]


def probabilities(column: pa.Array, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """(probability, number of chunks) of each text."""
    sym, blocks, _ = symbols(column)
    if not len(blocks):
        return np.zeros(0), np.zeros(0, np.int64)
    own = pooled(sym, net["table"], int(blocks.sum()))
    ends = np.cumsum(blocks)
    pair = own.copy()
    pair[:-1] = np.maximum(own[:-1], own[1:])
    pair[ends - 1] = own[ends - 1]
    z = chunk_scores(pair, net)
    keep = np.ones(len(z), bool)
    keep[ends[blocks > 1] - 1] = False  # the last block of a longer text is in the chunk before it
    n = np.maximum(blocks - 1, 1)
    z, starts = z[keep], np.concatenate(([0], np.cumsum(n)[:-1]))
    logit = net["mix"][0] * np.add.reduceat(z, starts) / n + net["mix"][1] * np.maximum.reduceat(z, starts) + net["mix"][2]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64))), n


def sample_chunks(column: pa.Array, ids: list[int]) -> list[bytes]:
    """Up to CHUNKS chunks of each text (2 * BLOCK + WIDTH symbols), spread by a hash of the id."""
    sym, blocks, _ = symbols(column)
    starts = np.concatenate(([0], np.cumsum(blocks * BLOCK)))
    sym = np.concatenate([sym, np.full(2 * BLOCK, PAD, np.uint16)])
    out = []
    for i, doc in enumerate(ids):
        n = max(int(blocks[i]) - 1, 1)
        rng = np.random.default_rng(abs(int(doc)) % (1 << 63))
        pick = rng.choice(n, size=CHUNKS, replace=n < CHUNKS)
        rows = []
        for c in pick:
            row = sym[starts[i] + c * BLOCK : starts[i] + c * BLOCK + 2 * BLOCK + WIDTH].copy()
            if blocks[i] < 2:
                row[BLOCK:] = PAD
            rows.append(row)
        out.append(np.concatenate(rows).astype("<u2").tobytes())
    return out


def train(x: np.ndarray, y: np.ndarray, share: float, steps: int = 500, batch: int = 48, rate: float = 3e-3, seed: int = 5) -> dict:
    """x: (documents, CHUNKS, 2 * BLOCK + WIDTH) symbols; y: 0 or 1.  share: of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    f32 = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
    net = {"table": f32(WIDTH, PAD + 1, FILTERS), "bias": np.zeros(FILTERS, np.float32), "w1": f32(FILTERS, HIDDEN, scale=0.3), "b1": np.zeros(HIDDEN, np.float32), "w2": f32(HIDDEN, scale=0.3), "b2": np.zeros((), np.float32), "mix": np.array([1.0, 0.2, 0.0], np.float32)}
    net["table"][:, PAD] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    by = [np.flatnonzero(y == c) for c in (0, 1)]
    n_pos, index = 2 * BLOCK, np.arange(WIDTH)
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(b, batch // 2) for b in by])
        s, t = x[rows].reshape(-1, x.shape[2]), y[rows].astype(np.float32)
        act = net["table"][0].take(s[:, :n_pos], axis=0)
        for j in range(1, WIDTH):
            act += net["table"][j].take(s[:, j : j + n_pos], axis=0)
        top = act.argmax(axis=1)  # chunks x filters
        raw = np.take_along_axis(act, top[:, None], 1)[:, 0] + net["bias"]
        h = np.maximum(raw, 0)
        u = h @ net["w1"] + net["b1"]
        r = np.maximum(u, 0)
        z = (r @ net["w2"] + net["b2"]).reshape(batch, CHUNKS)
        mean, best = z.mean(1), z.argmax(1)
        high = z[np.arange(batch), best]
        logit = net["mix"][0] * mean + net["mix"][1] * high + net["mix"][2]
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - t) / batch
        grad = {"mix": np.array([(g * mean).sum(), (g * high).sum(), g.sum()], np.float32)}
        gz = np.repeat((g * net["mix"][0] / CHUNKS)[:, None], CHUNKS, 1)
        gz[np.arange(batch), best] += g * net["mix"][1]
        gz = gz.reshape(-1)
        grad["w2"], grad["b2"] = r.T @ gz, gz.sum()
        gu = gz[:, None] * net["w2"] * (u > 0)
        grad["w1"], grad["b1"] = h.T @ gu, gu.sum(0)
        gh = gu @ net["w1"].T * (raw > 0)
        grad["bias"] = gh.sum(0)
        where = np.take_along_axis(s[:, :, None], (top[:, :, None] + index).reshape(len(s), -1)[:, :, None], 1)[:, :, 0].reshape(len(s), FILTERS, WIDTH)
        flat = (index * (PAD + 1) + where) * FILTERS + np.arange(FILTERS)[:, None]
        grad["table"] = np.bincount(flat.ravel(), weights=np.repeat(gh.ravel(), WIDTH), minlength=net["table"].size).reshape(net["table"].shape)
        grad["table"][:, PAD] = 0
        for k, v in grad.items():
            v = np.asarray(v, np.float32) + (1e-4 * net[k] if k in ("table", "w1", "w2") else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v * v
            net[k] = (net[k] - rate * min(1.0, 3 * (1 - step / (steps + 1))) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net["mix"][2] += np.log(share / (1 - share))
    return net


def fitted(docs: DataFrame, labels: DataFrame, holdout: int = 3, held: int = 1, label: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[dict | None, float]:
    """(network, share of label 1); the network is None without labels of both classes.  Held-out labels are never read."""
    fold = crc_mod(F.col("doc_id"), holdout)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    h = known.withColumn("h", F.xxhash64("doc_id"))
    picked = h.where(F.col(label) == 1).orderBy("h", "doc_id").limit(train_rows).unionByName(h.where(F.col(label) == 0).orderBy("h", "doc_id").limit(train_rows))
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = 0.5 if share is None else float(share)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(label), pa.array(sample_chunks(part.column("text"), part.column("doc_id").to_pylist()), pa.binary())], names=["doc_id", label, "chunks"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = map_slices(texts.join(F.broadcast(picked.select("doc_id", label)), "doc_id").select("doc_id", label, "text"), cut, f"doc_id long, {label} int, chunks binary").toArrow()
    y = got.column(label).to_numpy()
    if not 0 < y.sum() < len(y):
        return None, share
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")  # the same network whatever the partitions
    x = np.frombuffer(b"".join(got.column("chunks").to_pylist()), "<u2").reshape(len(y), CHUNKS, -1)[order]
    net = train(x, y[order], min(max(share, 1e-3), 1 - 1e-3))
    del got, x
    give_back()
    return net, share


def with_scores(docs: DataFrame, net: dict | None, share: float) -> DataFrame:
    """docs with score (double) and n_chunks (long) for each row; columns of these names are replaced."""
    box = docs.sparkSession.sparkContext.broadcast(net)
    fields = [f for f in docs.schema if f.name not in ("score", "n_chunks")]

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        if box.value is None:
            p, n = np.full(part.num_rows, share), np.zeros(part.num_rows, np.int64)
        else:
            p, n = probabilities(part.column("text"), box.value)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(n)], names=[*part.schema.names, "score", "n_chunks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, n_chunks long"
    return map_slices(docs.select(*(f.name for f in fields)), scored, schema)


def score(docs: DataFrame, labels: DataFrame, holdout: int = 3, held: int = 1, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod holdout is held), score and n_chunks of each row."""
    out = with_scores(docs.select("doc_id", "text"), *fitted(docs, labels, holdout, held, label, train_rows))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), holdout) == held, F.lit(False)).alias("held_out"), "score", "n_chunks")
