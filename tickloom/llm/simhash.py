"""SimHash near-duplicates, searched by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments. So every fingerprint is
entered in a table under both segments, and probes the table with its segments and
all segments one bit away; what it meets is verified on the complete distance. Of two
segments one bit apart only one has that bit, so probing with cleared bits alone finds
each such pair.

Equal fingerprints are one row before the search. Documents share a component when a
chain of links connects their fingerprints.

Defined results: a null or empty text has no words and fingerprint zero, which links
like any other; fewer than ``SHINGLE`` words are one shingle; repeated rows share a
fingerprint; a null id never names a component unless all its members are null; an
empty table gives no rows. Other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import slices
from tickloom.llm.components import components
from tickloom.session import durable

#: Words of a shingle, hash seed, most differing bits of a link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENT = 32
#: Bytes of text, and shingles, worked on at once.
SLICE, STEP = 4_000_000, 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit fingerprint of a UTF-8 text. A bit is set if over half the shingles have it."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - SHINGLE + 1)
    if count == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:count - 1]]).tolist()
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for k in range(0, count, STEP):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k:k + STEP], stops[k:k + STEP])]
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(bits * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None
) -> DataFrame:
    """``id``, ``key`` (of the caller's, to find rows again) and ``fp`` (the fingerprint as a
    signed long) of every document."""
    rows = docs.select(
        F.col(id_col).alias("id"), (F.lit(0) if key is None else key).cast("bigint").alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    schema = T.StructType([rows.schema["id"], rows.schema["key"], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [fingerprint(t) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), fp], schema.names)

    return rows.mapInArrow(run, schema)


def _segments() -> list[tuple[int, Column]]:
    high = F.shiftrightunsigned(F.col("fp"), SEGMENT)
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    return [(0, high), (1, low)]


def _key(number: int, segment: Column) -> Column:
    """Segment number and value in one long."""
    return segment + F.lit(number << SEGMENT)


def _near(number: int, segment: Column, masks: Column) -> Column:
    """The segment itself and all segments with one of its bits cleared."""
    return F.transform(
        F.filter(masks, lambda m: segment.bitwiseAND(m) == m),
        lambda m: F.struct(_key(number, segment.bitwiseXOR(m)).alias("key"), (m == 0).alias("same")),
    )


def hamming_links(fps: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) at most three bits apart.

    A pair may come up more than once.
    """
    table = fps.select(
        F.col("fp").alias("b"), F.explode(F.array(*[_key(n, s) for n, s in _segments()])).alias("key")
    )
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(SEGMENT)])
    near = [_near(n, s, masks) for n, s in _segments()]
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*near)).alias("p")).select("a", "p.key", "p.same")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Equal segments meet from both sides: one of the two is enough.
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return probes.join(table, "key").filter((F.col("a") != F.col("b")) & once & (apart <= DISTANCE)).select("a", "b")


def _grouped(rows: DataFrame) -> DataFrame:
    """``fp, root, first`` of each distinct fingerprint: its component, and its least id."""
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(hamming_links(distinct.select("fp")))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``fingerprint`` (hex) and ``component_id`` (least id of its component)."""
    rows = durable(fingerprints(docs, id_col, text_col))
    linked = _grouped(rows)
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``key`` of one document of each component: that with the least id, null last."""
    rows = durable(fingerprints(docs, id_col, text_col, key))
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("key"))).alias("best")
    # the best of each fingerprint first: a hot one is a row before it meets its component
    each = rows.groupBy("fp").agg(best).join(_grouped(rows), "fp")
    return each.groupBy("root").agg(F.min("best").alias("best")).select("best.key")
