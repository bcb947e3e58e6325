"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts every text into chunks of about 2^MASK_BITS bytes: a cut depends on the
bytes nearby only, so a passage is cut alike in every document.  A chunk is encoded once and its ids are reused wherever
it comes again, in any document that the worker sees.  A cut that falls into a run without white space tears it: the
chunks' own ids then stop at the white space on either side, and the join (the torn run) is repaired by re-encoding a
window of it and the run on each side.  The window agrees when its ids begin with the left run's own ids and end with the
right run's; what is between them are the join's ids.  Where a window disagrees the text can't be put together from
parts, and the window is widened to whole documents.

Inside a new chunk every distinct run is encoded once: runs of the letters, digits and signs that `Library.plain` admits
are normalised and split here, in bulk, and the library's model merges them; all others go through the library whole.
Chunks, joins and runs are kept between tasks in stores of bounded size, from which the least used go first.

Ids and decoded text equal the tokenizers library's encode(text, add_special_tokens=False) and
decode(ids, skip_special_tokens=False).  That rests on the vocabulary's normaliser and pre-tokeniser never looking
across ASCII white space, which `can_cut` tries on the loaded file; else whole texts are encoded.  Likewise the bulk path
is used only for a file whose normaliser and pre-tokeniser are those it was written for and whose ids it reproduces on
every admitted character (`Library.bulk_agrees`).

Null and empty texts have no ids.  Rows are independent: no shuffle; a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spindrift.llm.common import large_text, map_slices

WINDOW, MASK_BITS, DOC_BYTES = 8, 10, 4 << 20
#: Most bytes that a worker keeps of chunks and of joins; of runs unless the caller says otherwise.
CHUNK_STORE, JOIN_STORE, RUN_STORE = 16 << 20, 6 << 20, 160 << 20
#: White space at which pre-tokens always end, as bytes.
CUTS = (9, 10, 11, 12, 13, 32)
BLANK = np.zeros(256, bool)
BLANK[list(CUTS)] = True
#: What the bulk path reproduces: the file's normaliser, and its pre-tokeniser around the file's own pattern.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Visible ASCII and the letters of Latin-1 and Latin Extended-A, but for U+0130, whose lower case has two characters.
PLAIN = r"^[\x21-\x7E\x{C0}-\x{12F}\x{131}-\x{17F}]+$"
#: How byte-level vocabularies spell a byte, in UTF-8: visible Latin-1 characters as they are, the others from U+0100 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELT = np.zeros((256, 2), np.uint8)
for _i, _b in enumerate([*VISIBLE, *sorted(set(range(256)) - set(VISIBLE))]):
    _spelt = chr(_b if _i < len(VISIBLE) else 256 + _i - len(VISIBLE)).encode()
    SPELT[_b, : len(_spelt)] = list(_spelt)
SPELT[0x20] = (0x20, 0)  # blanks part the pre-tokens
#: Runs that are merged in one call of the library.
TOGETHER = 256


def worker_encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file, kept between tasks."""
    home = sys.modules.setdefault("_spindrift_store", types.ModuleType("_spindrift_store"))
    if path not in home.__dict__:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        home.__dict__[path] = Encoder(path)
    return home.__dict__[path]


class Store:
    """Pieces and their ids, at most about `most` bytes of them after `trim`."""

    def __init__(self, most: int, kind):
        self.most, self.kind = most, kind
        self.fill({}, np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def fill(self, known: dict, flat: np.ndarray, lens: np.ndarray, hits: np.ndarray) -> None:
        self.known, self.flat, self.lens, self.hits = known, flat, lens, hits
        self.size, self.used = len(lens), len(flat)
        self.starts = np.cumsum(lens) - lens
        self.bytes = sum(map(len, known)) + 160 * len(known) + self.flat.itemsize * len(flat)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The slot of each piece, -1 for new ones."""
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.hits[out[out >= 0]] += 1
        return out

    def add(self, pieces: list[bytes], ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The slots of new pieces, whose ids stand one after the other."""
        grown = lambda x, n: np.concatenate([x, np.zeros(max(n, len(x) // 2), x.dtype)])
        if self.used + len(ids) > len(self.flat):
            self.flat = grown(self.flat, self.used + len(ids) - len(self.flat))
        if self.size + len(pieces) > len(self.starts):
            more = self.size + len(pieces) - len(self.starts)
            self.starts, self.lens, self.hits = (grown(x, more) for x in (self.starts, self.lens, self.hits))
        slots = np.arange(self.size, self.size + len(pieces))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[slots] = self.used + np.cumsum(lens) - lens
        self.lens[slots] = lens
        self.hits[slots] = 0
        self.known.update(zip(pieces, slots.tolist(), strict=True))
        self.used += len(ids)
        self.size += len(pieces)
        self.bytes += sum(map(len, pieces)) + 160 * len(pieces) + self.flat.itemsize * len(ids)
        return slots

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these slots one after the other, their numbers)."""
        lens = self.lens[slots]
        return gathered(self.flat, self.starts[slots], lens), lens

    def trim(self) -> None:
        """Beyond the bound the pieces found most often stay, up to half of it; slots change."""
        if self.bytes <= self.most:
            return
        names = list(self.known)
        order = np.argsort(-self.hits[: self.size], kind="stable")
        cost = np.cumsum(np.fromiter(map(len, names), np.int64, len(names))[order] + 160 + self.flat.itemsize * self.lens[order])
        keep = np.sort(order[(cost <= self.most // 2) & (self.hits[order] > 0)])
        flat, lens = self.take(keep)
        self.fill({names[i]: k for k, i in enumerate(keep.tolist())}, flat, lens, self.hits[keep] // 2)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a column without nulls, without a scalar object for each."""
    return column.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] one after the other."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))] if len(lens) else flat[:0]


class Library:
    """The tokenizers library with a vocabulary file; counts the strings that it is given."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.calls = 0
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cut = can_cut(self.tokenizer)
        self.bulk = None
        own = lambda part: json.loads(part.__getstate__()) if part is not None else {}  # noqa: E731  a component's own specification
        normalizer, splitter, suffix = own(self.tokenizer.normalizer), own(self.tokenizer.pre_tokenizer), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        parts = splitter.get("pretokenizers", [])
        fits = normalizer.get("normalizers") == NORMALIZER and len(parts) == 2 and parts[1] == BYTE_LEVEL
        if self.cut and fits and suffix and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and "Regex" in parts[0]["pattern"]:
            self.pattern = f"(?:{parts[0]['pattern']['Regex']})"
            self.added = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
            self.last = np.zeros(self.size, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.endswith(suffix)]] = True
            self.bulk = Tokenizer(self.tokenizer.model)  # the same model, behind no normaliser
            self.bulk.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            if not self.bulk_agrees():
                self.bulk = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        self.calls += len(texts)
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, runs: pa.Array) -> np.ndarray:
        """Which runs the bulk path can take."""
        if self.bulk is None:
            return np.zeros(len(runs), bool)
        ok = pc.match_substring_regex(runs, PLAIN)
        for start in self.added:
            ok = pc.and_not(ok, pc.match_substring(runs, start))
        return ok.to_numpy(zero_copy_only=False)

    def merged(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, numbers) of plain runs; None where the model's word ends don't fit the pre-tokens."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(runs), self.pattern, r"\0 ").cast(pa.large_string())
        n = pc.count_substring(spaced, " ").to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        raw = np.frombuffer(spaced.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        wide = 1 + (raw >= 0x80)
        spelt = SPELT[np.repeat(raw, wide), 0]
        second = np.cumsum(wide)[raw >= 0x80] - 1
        spelt[second] = SPELT[raw[raw >= 0x80], 1]
        bounds = np.concatenate(([0], np.cumsum(wide)))[bounds - bounds[0]]
        bounds = np.append(bounds[:-1][::TOGETHER], bounds[-1])
        texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(spelt))
        self.calls += len(runs)
        found = self.bulk.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        stops = np.flatnonzero(self.last[ids])
        if len(stops) != int(n.sum()) or (n < 1).any() or (len(ids) and stops[-1] != len(ids) - 1):
            return None
        at = stops[np.cumsum(n) - 1] + 1
        return ids, np.diff(np.concatenate(([0], at)))

    def encode_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs one after the other, their numbers)."""
        column = pa.array(runs, pa.binary()).cast(pa.string())
        plain = self.plain(column)
        lens = np.zeros(len(runs), np.int64)
        got = self.merged(column.filter(pa.array(plain))) if plain.any() else None
        if got is None:
            plain[:] = False
        rest = np.flatnonzero(~plain)
        alone = self.encode([runs[i].decode() for i in rest]) if len(rest) else []
        lens[rest] = [len(x) for x in alone]
        if got is not None:
            lens[plain] = got[1]
        out = np.empty(int(lens.sum()), np.uint32)
        mine = np.repeat(plain, lens)
        if got is not None:
            out[mine] = got[0]
        out[~mine] = [x for y in alone for x in y]
        return out, lens

    def bulk_agrees(self) -> bool:
        """Whether the bulk path gives the library's ids for each admitted character beside others of every kind."""
        chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x130), *range(0x131, 0x180))]
        runs = sorted({t for c in chars for t in (c, f"a{c}", f"{c}a", f"1{c}", f"{c}1", f".{c}", f"{c}.", f"'{c}", f"{c}'", f"x{c}y", f"{c}'s", f"{c}{c}ll", f"'r{c}", f"!'{c}e")})
        column = pa.array(runs, pa.string())
        own = pa.array(self.plain(column))
        column = column.filter(own)
        got = self.merged(column)
        if got is None:
            return False
        ends = np.cumsum(got[1])
        return [got[0][a:b].tolist() for a, b in zip(ends - got[1], ends, strict=True)] == self.encode(column.to_pylist())


def can_cut(tokenizer) -> bool:
    """Whether encoding at the CUTS in parts gives the whole's ids: tried on texts that put marks, apostrophes, digits,
    controls and added tokens next to white space."""
    sides = ["a", "é", "é", "́", "'", "'s", "1", ".", "!!", " ", "‍", "\x1c", "Σ", "ß", "가", "x̨́", "<|", "|>"]
    sides += [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return all(ids(a + chr(c) + b) == ids(a + chr(c)) + ids(b) for a in sides for b in sides for c in CUTS) and all(ids(chr(c) + chr(d) + a) == ids(a) for a in sides for c in CUTS for d in CUTS)


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Where chunks begin (but for the first) in a run of bytes: after a byte at which the rolling hash of the WINDOW
    bytes up to it has its MASK_BITS high bits zero."""
    if len(raw) < WINDOW:
        return np.zeros(0, np.int64)
    h, power, wide = raw.astype(np.uint32), np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while wide < WINDOW:  # the hash of 2 x wide bytes from the hashes of wide bytes
            h[wide:] += h[:-wide] * power
            power, wide = power * power, 2 * wide
        h *= np.uint32(0x85EBCA6B)
    at = np.flatnonzero(h < np.uint32(1 << (32 - MASK_BITS))) + 1
    return at[(at >= WINDOW) & (at < len(raw))]


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, which are joins) of the pieces of concatenated texts: chunks without torn runs, and torn runs."""
    n, first = len(raw), offsets[:-1][offsets[:-1] < offsets[1:]]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    cuts = cuts_of(raw)
    own = np.searchsorted(offsets, cuts, side="right") - 1  # a cut right at a text's start is none
    cuts, own = (x[cuts - offsets[own] >= WINDOW] for x in (cuts, own))
    blanks = np.flatnonzero(BLANK[raw])
    k = np.searchsorted(blanks, cuts)
    padded = np.concatenate(([-1], blanks, [n]))
    left, right = padded[k] + 1, padded[k + 1]  # the run around the cut
    clean = (left == cuts) | (right == cuts)
    left[clean] = right[clean] = cuts[clean]
    inner = (left > offsets[own]) & (right < offsets[own + 1])  # else the run reaches the text's edge and stays whole
    left, right = left[inner], right[inner]
    starts = np.unique(np.concatenate([first, left, right]))
    return starts, np.isin(starts, left[left < right])


class Encoder:
    """A worker's library and stores for one vocabulary file."""

    def __init__(self, path: str):
        self.library = Library(path)
        kind = np.uint16 if self.library.size <= 1 << 16 else np.uint32
        self.chunks, self.runs, self.joins = Store(CHUNK_STORE, kind), Store(RUN_STORE, kind), Store(JOIN_STORE, kind)
        self.tokenizer, self.cut = self.library.tokenizer, self.library.cut

    def run_slots(self, runs: list[bytes]) -> np.ndarray:
        slots = self.runs.find(runs)
        new = np.flatnonzero(slots < 0)
        for lo in range(0, len(new), 1 << 15):
            part = new[lo : lo + (1 << 15)]
            names = [runs[i] for i in part]
            slots[part] = self.runs.add(names, *self.library.encode_runs(names))
        return slots

    def text_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers) of texts (binary) by their distinct runs."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        names = bytes_of(coded.dictionary)
        slots = self.run_slots(names)[coded.indices.to_numpy(zero_copy_only=False)]
        ids, lens = self.runs.take(slots)
        ends = np.concatenate(([0], np.cumsum(lens)))
        offsets = lists.offsets.to_numpy()
        return ids, np.diff(ends[offsets - offsets[0]])

    def chunk_slots(self, chunks: list[bytes]) -> np.ndarray:
        slots = self.chunks.find(chunks)
        new = np.flatnonzero(slots < 0)
        if len(new):
            names = [chunks[i] for i in new]
            slots[new] = self.chunks.add(names, *self.text_ids(pa.array(names, pa.binary())))
        return slots

    def join_slots(self, text: bytes, places: list[tuple[int, ...]]) -> np.ndarray:
        """The slots of joins, given as (window's start, join's start, its end, window's end); -1 if the window's ids don't
        begin and end with the ids of the runs beside the join."""
        keys = [text[a:d] + b"\n%d" % (b - a) for a, b, _, d in places]
        slots = self.joins.find(keys)
        new = {keys[i]: places[i] for i in np.flatnonzero(slots < 0)}
        if new:
            sides = {s: i for i, s in enumerate(dict.fromkeys(s for a, b, c, d in new.values() for s in (text[a:b].strip(), text[c:d].strip())))}
            ids, lens = self.runs.take(self.run_slots(list(sides)))
            ends = np.cumsum(lens)
            side = [ids[e - n : e].tolist() for e, n in zip(ends, lens, strict=True)]
            windows = self.library.encode([text[a:d].decode() for a, _, _, d in new.values()])
            found = []
            for (a, b, c, d), window in zip(new.values(), windows, strict=True):
                left, right = (side[sides[s]] for s in (text[a:b].strip(), text[c:d].strip()))
                stop = len(window) - len(right)
                agrees = stop >= len(left) and window[: len(left)] == left and window[stop:] == right
                found.append(window[len(left) : stop] if agrees else None)
            fit = [k for k, x in zip(new, found, strict=True) if x is not None]
            found = [x for x in found if x is not None]
            self.joins.add(fit, np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
            slots = np.fromiter((self.joins.known.get(k, -1) for k in keys), np.int64, len(keys))
        return slots

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of ids) of concatenated texts."""
        for store in (self.chunks, self.runs, self.joins):
            store.trim()
        starts, torn = pieces_of(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        coded = pieces.filter(pa.array(~torn)).dictionary_encode()
        chunk_ids, chunk_lens = self.chunks.take(self.chunk_slots(bytes_of(coded.dictionary)))
        places = windows_of(raw, offsets, starts[torn], bounds[1:][torn])
        slots = self.join_slots(raw.tobytes(), places) if places else np.zeros(0, np.int64)
        if (slots < 0).any():  # the window that agrees is the document
            return self.whole(raw, offsets)
        join_ids, join_lens = self.joins.take(slots)
        flat, all_lens = np.concatenate([chunk_ids, join_ids]), np.concatenate([chunk_lens, join_lens])
        at = np.empty(len(starts), np.int64)
        at[~torn] = coded.indices.to_numpy(zero_copy_only=False)
        at[torn] = len(chunk_lens) + np.arange(len(join_lens))
        lens = all_lens[at]
        ids = gathered(flat, (np.cumsum(all_lens) - all_lens)[at], lens)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        counts = np.bincount(owner, weights=lens, minlength=len(offsets) - 1).astype(np.int64)
        return ids.astype(np.uint32), np.concatenate(([0], np.cumsum(counts)))

    def whole(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `encode` returns, by the library on whole texts."""
        text = raw.tobytes()
        ids = self.library.encode([text[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return np.array([x for y in ids for x in y], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


def windows_of(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[tuple[int, ...]]:
    """(window's start, at, to, window's end) of each torn run [at, to): the window is the run and the one on each side."""
    if not len(at):
        return []
    blank = BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = ~blank[first]
    runs = np.append(np.flatnonzero(begins), len(raw))
    stops = np.append(np.flatnonzero(blank), len(raw))
    own = np.searchsorted(offsets, at, side="right") - 1
    lo, hi = offsets[own], offsets[own + 1]
    k = np.searchsorted(runs, at)
    before = runs[np.maximum(k - 1, 0)]
    start = np.where((k > 0) & (before >= lo), before, at)
    after = runs[np.searchsorted(runs, to)]
    stop = np.where(after < hi, np.minimum(stops[np.searchsorted(stops, after)], hi), to)
    return list(zip(*(x.tolist() for x in (start, at, to, stop)), strict=True))


def encode_column(column: pa.Array, path: str, run_store: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids as uint32, offsets): text i has the ids [offsets[i], offsets[i + 1])."""
    encoder = worker_encoder(path)
    encoder.runs.most = run_store or RUN_STORE
    text = large_text(column)
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    base = int(offsets[0])
    raw = np.frombuffer(buffers[2], np.uint8)[base : int(offsets[-1])] if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return (encoder.encode if encoder.cut else encoder.whole)(raw, offsets - base)


def token_strings(path: str) -> pa.Array:
    """The string of each id as the decoder joins it."""
    t = worker_encoder(path).tokenizer
    return pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], pa.string())


def decode_column(ids: np.ndarray, offsets: np.ndarray, path: str) -> pa.Array:
    """The text of each id list.  A file without a decoder joins the tokens' strings with blanks; others are asked."""
    store = worker_encoder(path)
    if store.tokenizer.decoder is not None:
        return pa.array(store.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], skip_special_tokens=False), pa.large_string())
    if not hasattr(store, "strings"):
        store.strings = token_strings(path)
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), store.strings.take(pa.array(ids)))
    return pc.binary_join(lists, " ")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_column(part.column("text"), path)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>", most=DOC_BYTES)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row's ids."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        col = part.column("ids")
        lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        ids = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.uint32)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), decode_column(ids, np.concatenate(([0], np.cumsum(lens))).astype(np.int64), path).cast(pa.string())], names=["doc_id", "text"])

    def bounded(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                yield run(b.slice(lo, 256))

    return rows.select("doc_id", "ids").mapInArrow(bounded, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, run_store: int | None = None, slice_bytes: int = DOC_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian uint32), decoded_sha256 (UTF-8) and, if asked, ids of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_column(part.column("text"), path, run_store)
        texts = decode_column(ids, offsets, path)
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        cols = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array([sha(raw[4 * a : 4 * b]) for a, b in spans]), pa.array([sha(x) for x in texts.cast(pa.large_binary()).to_pylist()])]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32))))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_slices(docs.select("doc_id", "text"), run, schema, most=slice_bytes)
