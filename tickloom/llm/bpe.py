"""Byte-level BPE: encoding with a priority queue of merge ranks, and decoding.

Texts are cut into words by the public byte-level pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

The cut is found for a whole batch at once, from the class of every character. Each
distinct word of a batch is encoded once: its bytes are a doubly linked list of
symbols, a heap holds the rank and place of every pair that can be merged, and an
entry whose pair is no longer there is skipped when it comes up. Decoding
concatenates the byte strings of the vocabulary.

Defined results: a null text is an empty one and has no tokens; a text of any length
is encoded whole; repeated rows and extra columns are kept as they are. A literal
``<|endoftext|>`` is the special token, as in the tokenizers library.
"""
from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import free_name, slices, texts_of

#: Bytes of text worked on at once; words up to this length are encoded together.
SLICE, TOGETHER = 1_500_000, 48
#: No entry in a queue.
NONE = np.int32(1 << 30)
#: A vocabulary file above this is refused: it is broadcast.
LARGEST_FILE = 64 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The characters with the property White_Space.
WHITE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: The endings the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: list[np.ndarray] = []
_models: dict[int, Bpe] = {}


def char_classes() -> np.ndarray:
    """Class of every code point, built once per process."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter(
            (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
            np.uint8, sys.maxunicode + 1,
        )
        table[list(WHITE)] = SPACE
        _classes.append(table)
    return _classes[0]


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the rest for 256 onwards.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Ranks of symbol pairs: an open-addressed hash table over numpy arrays."""

    BITS = 19

    def __init__(self, pairs: np.ndarray) -> None:
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, -1, np.int32)
        slots, left = self._slot(pairs), np.arange(len(pairs))
        self.probes = 0
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            at, one = np.unique(slots[free], return_index=True)
            self.keys[at], self.ranks[at] = pairs[free[one]], free[one]
            left = np.setdiff1d(left, free[one])
            slots[left] = (slots[left] + 1) & ((1 << self.BITS) - 1)
            self.probes += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, -1 for pairs that do not merge."""
        pairs = left.astype(np.int64) << 32 | right
        slots = self._slot(pairs)
        found = self.keys[slots]
        out = np.where(found == pairs, self.ranks[slots], np.int32(-1))
        open_ = np.flatnonzero((found != pairs) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            here = self.keys[at]
            hit = here == pairs[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (here >= 0)]
        return out


class Bpe:
    """A byte-level vocabulary with its merges, from the text of a tokenizer file."""

    def __init__(self, content: bytes) -> None:
        data = json.loads(content)
        vocab: dict[str, int] = data["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in symbols.items()}
        self.of_byte = [vocab[symbols[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        strings = {i: bytes(back[ch] for ch in s) for s, i in vocab.items() if s not in self.special}
        strings |= {i: s.encode() for s, i in self.special.items()}
        top = max(strings) + 1
        self.strings = pa.array([strings.get(i, b"") for i in range(top)], pa.large_binary())
        # pair -> rank, and rank -> id of the merged symbol
        pairs, made = [], []
        for merge in data["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append(vocab[left] << 32 | vocab[right])
            made.append(vocab[left + right])
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.made = np.array(made, np.int32)
        self.bytes = np.array(self.of_byte, np.int32)
        self.ranks = PairTable(np.array(pairs, np.int64))

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word of any length: linked list and heap."""
        rank, made = self.rank, self.made
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            # stale: the left symbol is gone, or the pair is another one by now
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = rank.get(ids[i] << 32 | ids[k])
                if q is not None:
                    heapq.heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0:
                q = rank.get(ids[h] << 32 | ids[i])
                if q is not None:
                    heapq.heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_same_length(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a matrix of words of one length (at most ``TOGETHER`` bytes).

        Every word has a queue of its own, with a place for each left symbol: its
        entry is ``rank << 6 | position``. A step pops the smallest entry of all words
        at once. An entry whose left symbol was merged away is stale and skipped when
        it comes up; one whose right symbol changed was overwritten by the new pair.
        Returns all ids in order, and how many each word has.
        """
        n, length = words.shape
        ids = self.bytes[words]
        if length > 1:
            places = np.arange(length, dtype=np.int32)
            queue = np.full((n, length), NONE, np.int32)
            first = self.ranks.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1)
            queue[:, :-1] = np.where(first >= 0, first << 6 | places[:-1], NONE)
            after = np.tile(places + 1, (n, 1)).ravel()
            before = np.tile(places - 1, (n, 1)).ravel()
            flat, entries = ids.ravel(), queue.ravel()
            rows = np.arange(n)
            while len(rows):
                best = queue[rows].min(axis=1)
                left = best < NONE
                rows, best = rows[left], best[left]
                base = rows * length
                i = base + (best & 63)
                alive = flat[i] >= 0
                entries[i[~alive]] = NONE
                i, base, best = i[alive], base[alive], best[alive]
                j = base + after[i]
                flat[i] = new = self.made[best >> 6]
                flat[j] = -1
                k = after[i] = after[j]
                entries[i] = NONE
                has = k < length
                i1, k1 = i[has], base[has] + k[has]
                before[k1] = i1 - base[has]
                r = self.ranks.get(new[has], flat[k1])
                entries[i1] = np.where(r >= 0, r << 6 | (i1 - base[has]), NONE)
                h = before[i]
                has = h >= 0
                h1 = h[has]
                r = self.ranks.get(flat[base[has] + h1], new[has])
                entries[base[has] + h1] = np.where(r >= 0, r << 6 | h1, NONE)
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def encode_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Packed ids of distinct words in some order, and each word's place in it."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        flats, counts, order = [], [], []
        for length in np.unique(sizes):
            which = np.flatnonzero(sizes == length)
            order.append(which)
            if length <= TOGETHER:
                got, many = self.encode_same_length(data[offsets[which][:, None] + np.arange(length)])
            else:
                lists = [self.encode_word(data[offsets[w]:offsets[w + 1]].tobytes()) for w in which]
                got, many = np.array([x for one in lists for x in one], np.int32), np.array([len(x) for x in lists])
            flats.append(got)
            counts.append(many)
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(np.concatenate(counts), out=ends[1:])
        place = np.empty(n, np.int64)
        place[np.concatenate(order)] = np.arange(n)
        packed = np.concatenate(flats).astype("<u4")
        return pa.Array.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(ends * 4), pa.py_buffer(packed)]
        ), place

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin and end."""
        parts, owner, forced = [], [], []
        marks = tuple(self.special)
        for d, text in enumerate(texts):
            pieces = [(text, False)]
            for mark in marks:
                if mark in text:
                    pieces = [
                        x for piece, special in pieces
                        for x in ([(piece, True)] if special else cut(piece, mark))
                    ]
            for piece, special in pieces:
                if piece:
                    parts.append(piece)
                    owner.append(d)
                    forced.append(special)
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        whole = np.array(forced)
        starts, data, firsts = word_starts(parts, whole)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]
        ).dictionary_encode()
        packed, place = self.encode_words(words.dictionary)
        at = place[words.indices.to_numpy()]
        if whole.any():
            # special strings are not made of ordinary words: they have entries of their own
            own = [self.special[parts[p]] for p in np.flatnonzero(whole)]
            at[firsts[whole]] = len(packed) + np.arange(len(own))
            packed = pa.concat_arrays([packed, pa.array([x.to_bytes(4, "little") for x in own], pa.large_binary())])
        ids = packed.take(pa.array(at))
        offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        flat = np.frombuffer(ids.buffers()[2], "<u4", offsets[-1] // 4)
        # first word of every part, then of every text: texts without parts are empty
        edge = np.full(len(texts) + 1, -1, np.int64)
        edge[-1] = len(ids)
        for d, first in zip(reversed(owner), reversed(firsts.tolist())):
            edge[d] = first
        for d in range(len(texts) - 1, -1, -1):
            if edge[d] < 0:
                edge[d] = edge[d + 1]
        return flat, offsets[edge] // 4

    def decode_batch(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts from ids: vocabulary strings one after another, read as UTF-8."""
        joined = self.strings.take(pa.array(ids))
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        data = memoryview(joined.buffers()[2] or b"")
        at = offsets[edges]
        return [str(data[at[d]:at[d + 1]], "utf-8", "replace") for d in range(len(edges) - 1)]


def cut(text: str, mark: str) -> list[tuple[str, bool]]:
    """``text`` without and with the special string, in order."""
    out: list[tuple[str, bool]] = []
    for i, piece in enumerate(text.split(mark)):
        if i:
            out.append((mark, True))
        out.append((piece, False))
    return out


def word_starts(parts: list[str], whole: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Byte offsets of all words of ``parts``, the bytes, and each part's first word.

    Parts are cut apart from each other; those marked in ``whole`` are one word.
    """
    joined = "".join(parts)
    data = joined.encode()
    if len(data) == len(joined):
        code: np.ndarray = np.frombuffer(data, np.uint8)
        ascii_only = True
    else:
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ascii_only = False
    n = len(code)
    kind = char_classes()[code]
    edges = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=edges[1:])
    first = np.zeros(n + 1, bool)
    first[edges] = True
    white = kind == SPACE
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = code == 0x20
    start = change.copy()
    # a run of others takes the blank before it
    start[1:] &= ~(blank[:-1] & ~white[1:] & ~first[1:-1])
    # the last of several white characters stands alone, or goes with what follows
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]
    quotes = np.flatnonzero((code == 0x27) & change)
    if len(quotes):
        quotes = quotes[start[quotes]]
        end = edges[np.searchsorted(edges, quotes, "right")]
        for ending in ENDINGS:
            hit = quotes + len(ending) < end
            for k, ch in enumerate(ending, 1):
                hit &= code[np.minimum(quotes + k, n - 1)] == ord(ch)
            at, stop = quotes[hit], end[hit]
            start[at + 1] = False
            after = at + len(ending) + 1
            start[after[after < stop]] = True
    for p in np.flatnonzero(whole):
        start[edges[p] + 1:edges[p + 1]] = False
    where = np.flatnonzero(start)
    firsts = np.searchsorted(where, edges[:-1])
    offsets = np.empty(len(where) + 1, np.int64)
    if ascii_only:
        offsets[:-1] = where
    else:
        width = np.ones(n, np.int64)
        width += code >= 0x80
        width += code >= 0x800
        width += code >= 0x10000
        offsets[:-1] = (np.cumsum(width) - width)[where]
    offsets[-1] = len(data)
    return offsets, data, firsts


def _shared(docs: DataFrame, tokenizer: str) -> Any:
    """The vocabulary file, read on the driver and broadcast; its size is checked."""
    with open(tokenizer, "rb") as f:
        content = f.read(LARGEST_FILE + 1)
    if len(content) > LARGEST_FILE:
        raise ValueError(f"{tokenizer} has more than {LARGEST_FILE} bytes")
    return docs.sparkSession.sparkContext.broadcast(content)


def _model(shared: Any) -> Bpe:
    key = hash(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(shared.value)
    return _models[key]


def encode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", decoded: str | None = None,
    then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType] | None = None,
) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids`` (little-endian 32-bit integers).

    With ``decoded`` the ids are decoded again into a column of that name. Columns of
    ``docs`` with one of these names are replaced. ``then`` (a function of a batch and
    the schema of its result) is applied to the result in the same pass, where ids and
    texts are not wanted themselves.
    """
    shared = _shared(docs, tokenizer)
    new = {"n_tokens": T.LongType(), "token_ids": T.BinaryType()} | ({decoded: T.StringType()} if decoded else {})
    # `text_col` may be one of the names replaced: read it under a name of its own
    source = free_name(docs, "_bpe_text")
    rows = docs.withColumn(source, F.col(text_col)).drop(*new)
    schema = T.StructType([f for f in rows.schema.fields if f.name != source])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    finish, result = then or (lambda batch: batch, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in slices(batches, source, SLICE):
            flat, edges = model.encode_batch(texts_of(batch, source))
            # not an array of memoryviews: pyarrow never lets go of what those are views of
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(batch), [None, pa.py_buffer(4 * edges), pa.py_buffer(flat)]
            ).cast(pa.binary())
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != source]
            columns += [pa.array(np.diff(edges), pa.int64()), ids]
            if decoded:
                columns.append(pa.array(model.decode_batch(flat, edges), pa.string()))
            yield finish(pa.RecordBatch.from_arrays(columns, schema.names))

    return rows.mapInArrow(run, result)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their packed ids; null ids give an empty text."""
    shared = _shared(rows, tokenizer)
    name_in = free_name(rows, "_bpe_ids")
    source = rows.withColumn(name_in, F.col(ids_col)).drop(out)
    schema = T.StructType([f for f in source.schema.fields if f.name != name_in]).add(out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in slices(batches, name_in, 4 * SLICE):
            packed = [x or b"" for x in batch.column(name_in).to_pylist()]
            edges = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in packed], out=edges[1:])
            texts = model.decode_batch(np.frombuffer(b"".join(packed), "<u4"), edges)
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != name_in]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema.names)

    return source.mapInArrow(run, schema)
