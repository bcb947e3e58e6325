"""Chunk reuse: equality with the library across cuts, repaired joins, how often the library is called, bounded stores."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import bpe, queries


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary()


def prose(rng, n):
    words = ["".join(rng.choice("abcdefgilmnoprstuvéñß'") for _ in range(rng.randint(1, 11))) for _ in range(200)]
    ends = ["", "", "", ",", ".", "!", "'s", "42", " ", "́", "日本", "İ", "<|endoftext|>", "\x01"]
    return "".join(rng.choice(words) + rng.choice(ends) + rng.choice([" ", " ", " ", "\n", "  ", "\x0b", "\t"]) for _ in range(n))


def test_equals_library_across_cuts(path, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 1, 3, 50, 400, 3000, 3000)] + ["x" * 9000, "é" * 5000 + " tail", " \n ", "a" * 3000 + " " + "b" * 3000]
    texts += [texts[5], texts[5][:7000] + " inserted " + texts[5][7000:]]
    for bits in (10, 3):  # few and very many cuts
        monkeypatch.setattr(bpe, "MASK_BITS", bits)
        encoder = bpe.Encoder(path)
        monkeypatch.setattr(bpe, "worker_encoder", lambda _, e=encoder: e)
        ids, offsets = bpe.encode_column(pa.array(texts), path)
        want = encoder.library.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
        assert encoder.joins.size > 10


def test_shared_chunks_are_encoded_once(path):
    rng = random.Random(5)
    passage = prose(rng, 4000)
    encoder = bpe.Encoder(path)
    raw = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())], np.int64))
    encoder.encode(*raw("A first beginning. " + passage + " an end"))
    calls, chunks = encoder.library.calls, encoder.chunks.size
    encoder.encode(*raw("Quite another text stands before it here. " + passage + " and another end"))
    assert encoder.chunks.size - chunks <= 2 < chunks  # only the first and the last chunk are new
    assert encoder.library.calls - calls <= 12


def test_disagreeing_windows_take_whole_documents(path, monkeypatch):
    monkeypatch.setattr(bpe, "MASK_BITS", 3)
    encoder = bpe.Encoder(path)
    plain = encoder.library.encode
    encoder.library.encode = lambda texts: [[7, *ids] if len(t) > 30 and " " in t else ids for t, ids in zip(texts, plain(texts), strict=True)]  # looks beyond white space
    texts = [prose(random.Random(6), 300), "short text"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, ends = encoder.encode(np.frombuffer(raw, np.uint8), offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == encoder.library.encode(texts)


def test_store_keeps_what_is_found_most():
    store = bpe.Store(4000, np.uint16)
    for k in range(40):
        if store.find([b"often"])[0] < 0:
            store.add([b"often"], np.array([1, 2, 3]), np.array([3]))
        store.add([b"once%d" % k], np.array([k]), np.array([1]))
        store.trim()
        ids, lens = store.take(store.find([b"often"]))
        assert ids.tolist() == [1, 2, 3] and lens.tolist() == [3] and store.bytes <= 4400


def test_whole_texts_where_cuts_are_not_safe(path, monkeypatch):
    monkeypatch.setattr(bpe, "can_cut", lambda t: False)
    encoder = bpe.Encoder(path)
    monkeypatch.setattr(bpe, "worker_encoder", lambda _: encoder)
    ids, offsets = bpe.encode_column(pa.array(["Ab c", None, ""]), path)
    assert ids.tolist() == encoder.library.encode(["Ab c"])[0] and offsets.tolist() == [0, len(ids), len(ids), len(ids)]
