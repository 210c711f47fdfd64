"""Near copies by five-word shingles: SimHash first, MinHash bands for the rest, checked exactly.

Two texts are linked if their sets of shingles have a Jaccard similarity of ``LEAST`` or
more. Each set has a SimHash fingerprint; multi-index hashing (``simhash.hamming_links``) finds
those at most three bits apart, and every member of such a group is compared with one of it.

At 0.8 fingerprints differ in ten bits on average, so more candidates come from ``BANDS`` bands
of ``ROWS`` minima: a pair at 0.8 shares none with probability ``(1 - 0.8 ** 5) ** 32``, three in
a million, and less above. In a bucket every member is compared with a leader, the member
that meets most others. Buckets whose members are in one component are settled.

The members of the other buckets are compared by an exact prefix filter. All their shingles are
put in one order, rare ones first. Two sets with ``o`` shingles in common have their first common
one at a place that leaves ``o`` from there on in both, so it is in the rarest ninth of the smaller
set and the rarest fifth of the larger, and only pairs whose places leave enough are made. Sets that
share a bucket and are not similar (copies of one text with changes of their own) differ in rare
shingles and do not meet, so a group of them costs its size; no pair that may be linked is left out.

Of a candidate pair the minima are counted that agree: at 0.8 they are 128 of 160 on average and
fewer than ``AGREE`` once in ten million pairs. What is left is compared by its complete
sets, made anew from the two texts, so no candidate adds a false link. Texts are moved once,
packed, to the partition of their set; only those of such pairs, and of open buckets, are moved
again. Equal sets are one row before the search.

Defined results: null and empty texts have the empty set and are copies of each other;
fewer than ``SHINGLE`` words are one shingle; A-Z and a-z are equal.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import shared_folder, slices
from tickloom.llm.components import components
from tickloom.llm.simhash import hamming_links
from tickloom.session import durable

#: Words of a shingle, hash seed, least similarity of a link.
SHINGLE, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS = 32, 5
#: Least number of minima that agree in a pair whose texts are compared.
AGREE = 100
#: Rounds of leaders before the pairs that are left.
ROUNDS = 1
#: Parts over which the pairs of one leader are dealt.
PARTS = 64
#: Bytes of a row group: a writer holds one.
ROW_GROUP = 8 << 20
#: Bytes of text, and shingles, worked on at once.
SLICE, STEP = 4_000_000, 512
#: Room for rounding where sizes are compared.
SLACK = 1e-6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the shingles of a UTF-8 text, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - SHINGLE + 1)
    if count == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:count - 1]]).tolist()
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, count))


def minima(found: np.ndarray) -> np.ndarray:
    """Minimum of a set of shingles under each of ``BANDS * ROWS`` hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), STEP):
        np.minimum(least, (found[k:k + STEP, None] * _FACTORS).min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """Two high bytes of each minimum, scattered anew (minima of large sets begin with zeros)."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2").tobytes()


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed long: the bits that over half of them have."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(found), STEP):
        raw = found[k:k + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(bits * 2 > len(found), bitorder="little").tobytes(), "little", signed=True)


def bands(signature: str) -> Column:
    """Buckets of the bands of a signature: hashes of ``ROWS`` of its minima each."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(signature, 1 + n * width, width), F.lit(n)) for n in range(BANDS)])


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _signatures(docs: DataFrame, key: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([
        rows.schema["id"], rows.schema["key"], T.StructField("node", T.LongType(), False),
        T.StructField("n", T.LongType(), False), T.StructField("fp", T.LongType(), False), T.StructField("signature", T.BinaryType(), False), T.StructField("packed", T.BinaryType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text", SLICE):
            nodes, sizes, fps, signatures, packed = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(fingerprint(found))
                signatures.append(signature(minima(found)))
                packed.append(pack(text or b""))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("key"), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(signatures, pa.binary()), pa.array(packed, pa.binary()),
            ], schema.names)

    return rows.mapInArrow(run, schema)


def _bucketed(rows: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` as a table in buckets of ``key`` in the shared folder, so that joins on it move
    only the other side, and what forgets the table's name."""
    spark = rows.sparkSession
    folder = shared_folder(rows, "neardup")
    name = folder.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, key).write.bucketBy(buckets, key).option("path", folder).option(
        "parquet.block.size", ROW_GROUP).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}") and None


def _beside(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``a, b, part, x, y``: pairs with the value of either end. ``values``: ``node``, ``column``.

    The value of ``a``, which may be the leader of many, goes once to each part of its pairs.
    """
    one = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    two = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    left = pairs.select("a", "part").distinct().join(one, "a")
    return pairs.join(two, "b").join(left, ["a", "part"]).select("a", "b", "part", "x", "y")


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs that enough minima agree on, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in "xy")
            near = (x == y).sum(axis=1) >= AGREE
            yield batch.select(["a", "b", "part"]).filter(pa.array(near, pa.bool_()))

    pairs = pairs.distinct().withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    return durable(_beside(durable(pairs), signatures, "signature").mapInArrow(run, "a bigint, b bigint, part bigint"))


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are similar, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, unpack = None, None, zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "y", SLICE):
            near = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a != last:  # rows of one leader mostly stand together
                    last, held = a, shingles(unpack(x.as_py()))
                near.append(similarity(held, shingles(unpack(y.as_py()))) >= LEAST)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _beside(pairs, nodes, "packed").mapInArrow(run, "a bigint, b bigint")


def _alike(n: str, m: str) -> Column:
    """Sets whose sizes alone allow the similarity."""
    return F.least(n, m) >= F.greatest(n, m) * LEAST - SLACK


def _labels(links: DataFrame) -> DataFrame:
    """``node, root``: for the second ends of links the least first end, two steps up. Nodes with
    one root are in one component; the reverse need not hold."""
    up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return durable(up.join(above, "up", "left").select("node", F.least("up", "top").alias("root")))


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of every set with the least of its group of fingerprints a few bits apart."""
    fps = durable(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("c")))
    roots = durable(components(hamming_links(fps.select("fp"))))
    groups = fps.join(roots, F.col("fp") == F.col("node"), "left").filter("c > 1 OR root IS NOT NULL").select(
        "fp", F.coalesce("root", "fp").alias("group"))
    rows = durable(distinct.select("node", "n", "fp").join(groups, "fp"))
    first = rows.groupBy("group").agg(F.min(F.struct("node", "n")).alias("f"))
    return rows.join(first, "group").filter((F.col("node") != F.col("f.node")) & _alike("n", "f.n")).select(
        F.col("f.node").alias("a"), F.col("node").alias("b"))


def _prefix_pairs(members: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``members`` (``node, root``) with another root that may be similar, by the
    places of a shingle they share in the order of all shingles, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed", SLICE // 8):  # texts are several times that
            found = [shingles(unpack(p.as_py())).view(np.int64) for p in batch.column("packed")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("root"), pa.array(found, pa.list_(pa.int64()))], ["node", "root", "found"])

    sets = durable(distinct.select("node", "packed").join(members, "node").select("node", "root", "packed").mapInArrow(
        run, "node bigint, root bigint, found array<bigint>"))
    each = sets.select("node", "root", F.size("found").cast("bigint").alias("n"), F.explode("found").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    own = Window.partitionBy("node")
    # shingles of one set alone come first in its order
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "shingle"))

    def reaches(share: float) -> Column:
        """Places from which that share of the set is left."""
        return F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - SLACK) + 1

    rare = durable(each.join(often, "shingle").withColumn("place", place).filter(reaches(LEAST)).drop("c"))
    both = 2 * LEAST / (1 + LEAST)
    less = rare.filter(reaches(both)).select(
        "shingle", F.col("node").alias("a"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("place").alias("at"))
    smaller = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("a") < F.col("node"))
    room = F.least(F.col("m") - F.col("at"), F.col("n") - F.col("place")) + 1 >= (F.col("m") + F.col("n")) * (both / 2) - SLACK
    return less.join(rare, "shingle").filter(smaller & (F.col("r") != F.col("root")) & _alike("n", "m") & room).select(
        "a", F.col("node").alias("b"))


def _roots(distinct: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that are linked to others."""
    similar = lambda pairs: durable(_verified(_agreeing(pairs, distinct), distinct))
    links = similar(_fingerprint_pairs(distinct))
    buckets = distinct.select("node", "n", F.explode(bands("signature")).alias("bucket"))
    shared = durable(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    members = durable(buckets.join(shared, "bucket"))
    members = members.drop("c").join(members.groupBy("node").agg(F.sum("c").alias("met")), "node")

    def unsettled(rows: DataFrame) -> DataFrame:
        """Members with their roots, and the leaders, of buckets that are not of one component."""
        named = durable(rows.join(_labels(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
        leader = F.min(F.struct(-F.col("met"), "node", "n", "root")).alias("f")
        open_ = named.groupBy("bucket").agg(leader, F.min("root").alias("lo"), F.max("root").alias("hi"))
        return durable(named.join(open_.filter("lo <> hi").select("bucket", "f"), "bucket"))

    members = unsettled(members)
    for _ in range(ROUNDS):
        pairs = members.filter((F.col("node") != F.col("f.node")) & (F.col("root") != F.col("f.root")) & _alike("n", "f.n"))
        links = links.unionByName(similar(pairs.select(F.col("f.node").alias("a"), F.col("node").alias("b"))))
        # leaders have met all others of their buckets
        members = unsettled(members.filter(F.col("node") != F.col("f.node")).select("bucket", "node", "n", "met"))
    return components(links.unionByName(similar(_prefix_pairs(members.select("node", "root").distinct(), distinct))))


def representatives(docs: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``key`` of one document of each component: that with the least id, null last."""
    rows = _signatures(docs, key, id_col, text_col)
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("key"))).alias("best")
    any_of = [F.any_value(c).alias(c) for c in ("signature", "packed")]
    sizes = [F.min(c).alias(c) for c in ("n", "fp")]
    distinct, drop = _bucketed(rows.groupBy("node").agg(best, *sizes, *any_of), "node")
    named = distinct.select("node", "best").join(_roots(distinct), "node", "left")
    first = F.min("best").alias("best")
    kept = durable(named.groupBy(F.coalesce("root", "node").alias("root")).agg(first).select("best.key"))
    drop()
    return kept
