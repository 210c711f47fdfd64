"""Benchmark passages in documents, by the q-gram lemma.

A benchmark item of ``n`` characters counts as leaked if some region of a document
aligns with it in at most ``k = floor(n * ERRORS)`` edits. Such a region shares at least
``n - q + 1 - k * q`` q-grams with the item, all on diagonals (text position minus item
position) at most ``k`` apart. So the shared q-grams are counted in overlapping bands of
diagonals; bands below the bound cannot hold a leak, the others are verified by a banded
alignment whose ends in the text are free.

Both sides are compared in lower case with white space runs as one blank. Documents are
read once for each block of items; a block is a broadcast of at most ``BLOCK`` bytes,
and a larger benchmark is cut into more of them.

Defined results: a null or empty text holds no leak, a null item id or text is not
searched for, an item of fewer than ``Q`` characters cannot be told from chance and is not
either; equal items are reported each; repeated rows are reported as often; empty tables
give no rows. Other columns of either table are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import slices, texts_of

#: Length of a gram, share of an item's characters that may be edited.
Q, ERRORS = 8, 0.1
#: Bytes of benchmark text in one broadcast, bytes of documents worked on at once.
BLOCK, SLICE = 16 << 20, 2_000_000
_BITS = 22
_FAR = 1 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` characters from each position, by doubling."""
    h, span, base = code.astype(np.uint64), 1, 0x100000001B3
    while span < Q:
        if len(h) <= span:
            return np.zeros(0, np.uint64)
        h = h[:-span] * np.uint64(base) + h[span:]
        base, span = base * base % (1 << 64), span * 2
    return h * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """q-grams of a block of items: where each occurs, and what an item needs."""

    ids: np.ndarray
    texts: list[np.ndarray]
    sizes: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def index(items: list[tuple[int, str]]) -> Index | None:
    kept = [(i, codes(normal(t))) for i, t in items if i is not None and t is not None]
    kept = sorted(((i, c) for i, c in kept if len(c) >= Q), key=lambda x: (x[0], x[1].tobytes()))
    if not kept:
        return None
    sizes = np.array([len(c) for _, c in kept])
    budget = np.floor(sizes * ERRORS + 1e-9).astype(np.int64)
    hashes = [grams(c) for _, c in kept]
    flat = np.concatenate(hashes)
    item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(
        np.array([i for i, _ in kept]), [c for _, c in kept], sizes, budget,
        np.maximum(1, sizes - Q + 1 - budget * Q), keys, np.append(first, len(flat)), item[order], place[order], seen,
    )


def candidates(ix: Index, code: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and band of all bands that meet the bound.

    ``code`` holds several texts, each ended by a zero; ``edges`` are their beginnings
    and the end. Band ``b`` of an item covers diagonals ``[b * w, (b + 2) * w)`` of a
    text with ``w = k + 1``, so two diagonals at most ``k`` apart always share a band.
    """
    h = grams(code)
    at = np.flatnonzero(ix.seen[(h >> np.uint64(64 - _BITS)).view(np.int64)])
    key = np.searchsorted(ix.keys, h[at])
    fits = (key < len(ix.keys)) & (ix.keys[np.minimum(key, len(ix.keys) - 1)] == h[at])
    at, key = at[fits], key[fits]
    many = ix.first[key + 1] - ix.first[key]
    entry = np.repeat(ix.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(at, many)
    item, place = ix.item[entry], ix.place[entry]
    text = np.searchsorted(edges, at, "right") - 1
    width = ix.budget[item] + 1
    band = (at - edges[text] - place) // width
    # a gram counts once for each of its places in the item, in both bands it is in
    item, text, place = np.tile(item, 2), np.tile(text, 2), np.tile(place, 2)
    band = np.concatenate([band, band - 1]) + _FAR
    if not len(item):
        return item, item, item
    order = np.lexsort((place, band, item, text))
    text, item, band, place = text[order], item[order], band[order], place[order]
    group = np.ones(len(text), bool)
    group[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    fresh = group.copy()
    fresh[1:] |= place[1:] != place[:-1]
    begin = np.flatnonzero(group)
    shared = np.add.reduceat(fresh.astype(np.int64), begin)
    good = begin[shared >= ix.need[item[begin]]]
    return text[good], item[good], band[good] - _FAR


def align(
    ix: Index, code: np.ndarray, edges: np.ndarray, text: np.ndarray, item: np.ndarray, band: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each candidate within its band, and where that alignment ends in the text."""
    budget = ix.budget[item]
    low = band * (budget + 1) - budget
    width = int((4 * budget + 2).max())
    cell = np.arange(width)
    inside = cell < (4 * budget + 2)[:, None]
    start, size = edges[text], edges[text + 1] - edges[text] - 1
    big = 1 << 20
    sizes = ix.sizes[item]
    longest = int(sizes.max())
    pattern = np.zeros((len(item), longest), np.uint32)
    for row, i in enumerate(item):
        pattern[row, :sizes[row]] = ix.texts[i]
    at = low[:, None] + cell  # text position (end of the aligned part) at row 0
    row = np.where(inside & (at >= 0) & (at <= size[:, None]), 0, big)
    best, end = np.full(len(item), big), np.zeros(len(item), np.int64)
    for i in range(1, longest + 1):
        at = at + 1
        valid = inside & (at >= 0) & (at <= size[:, None])
        char = code[np.clip(start[:, None] + at - 1, 0, len(code) - 1)]
        here = np.minimum(row + ((char != pattern[:, i - 1:i]) | (at < 1)), big)
        here[:, :-1] = np.minimum(here[:, :-1], row[:, 1:] + 1)
        here = np.where(valid, here, big)
        row = np.minimum(np.minimum.accumulate(here - cell, axis=1) + cell, big)
        row = np.where(valid, row, big)
        for c in np.flatnonzero(sizes == i):
            k = int(row[c].argmin())
            best[c], end[c] = row[c, k], at[c, k]
    return best, end


def leaks_in(ix: Index, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """``text number, item number, edits, end`` of every leaked item, the best alignment of each."""
    forms = [normal(t) for t in texts]
    code = codes("\0".join(forms) + "\0")
    edges = np.zeros(len(forms) + 1, np.int64)
    np.cumsum([len(f) + 1 for f in forms], out=edges[1:])
    text, item, band = candidates(ix, code, edges)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for s in range(0, len(text), 512):
        t, i = text[s:s + 512], item[s:s + 512]
        edits, end = align(ix, code, edges, t, i, band[s:s + 512])
        for row in np.flatnonzero(edits <= ix.budget[i]):
            key, got = (int(t[row]), int(i[row])), (int(edits[row]), int(end[row]))
            found[key] = min(found.get(key, got), got)
    return [(*key, *got) for key, got in sorted(found.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark in blocks of checked size."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    for b in range(count):
        mine = items if count == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b)
        ix = index([(r["i"], r["t"]) for r in mine.toLocalIterator()])
        if ix is not None:
            yield ix


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per document and leaked item: id, ``item_id, edits, end_char``.

    ``end_char`` is where the passage ends in the document's compared form.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        rows.schema["id"], T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
        T.StructField("end_char", T.LongType()),
    ])
    found: DataFrame | None = None
    for ix in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE):
                hits = leaks_in(shared.value, texts_of(batch, "text"))
                if hits:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(pa.array([h[0] for h in hits])),
                        pa.array(shared.value.ids[[h[1] for h in hits]], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64()),
                    ], schema.names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = rows.limit(0).select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    return found.withColumnRenamed("id", id_col)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` without those that hold a benchmark passage, in the same pass."""
    schema = docs.schema
    where = docs.columns.index(text_col)
    for ix in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col, SLICE):
                texts = [t or "" for t in batch.column(where).to_pylist()]
                bad = {h[0] for h in leaks_in(shared.value, texts)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))])) if bad else batch

        docs = docs.mapInArrow(run, schema)
    return docs
