"""Interpolated modified Kneser-Ney trigrams of whole words.

A word is a 64-bit hash of its bytes; words, pairs and trigrams of the trusted texts are
counted in joined tables that grow with the corpus. An unknown word is one of as many equally likely
ones as words are known.

The logarithm of ``p(c | a, b)`` is a sum over what the model knows of the n-grams at hand::

    log p(c)  +  log p(c | b) / p(c)  +  log p(c | a, b) / p(c | b)

where a quotient is the known n-gram's, else the weight that its known context leaves to the
lower order, else 1. So every n-gram and context has one addend, those not in the model add
nothing, and a shard that owns some keys adds up its part of each document by itself.

The work is done in ``ROUNDS`` rounds by the middle word of a trigram, so that only that part of
the counts and requests is on disk at once; each round reads all texts.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.classes import discounts
from tickloom.llm.common import shared_folder, slices
from tickloom.session import durable

#: Bytes of text encoded at once, and words of a block: the larger a block, the fewer
#: n-grams it shares with others and asks for again.
SLICE, BLOCK_WORDS = 4_000_000, 2_000_000
#: Rounds at most, and bytes of text for which one round, one shard of a round, is enough.
ROUNDS, ROUND_BYTES, SHARD_BYTES = 12, 16 << 20, 8 << 20
#: Bytes hashed at once; words longer than this are hashed by themselves.
PIECE, LONG = 1 << 20, 32
#: Stands twice before the first word; no word holds white space.
BEGIN = xxhash.xxh64_intdigest(b" ") >> 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_LETTER = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i])) for i in range(256)), np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of ``_BASE`` and of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers.shape[1] < n:
        _powers = np.empty((2, n), np.uint64)
        for row, base in zip(_powers, (_BASE, pow(_BASE, -1, 1 << 64))):
            row[0], row[1:] = 1, base
            np.cumprod(row, out=row)
    return _powers


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes that end with white space, and where they begin."""
    edge = np.flatnonzero(_SPACE[data])
    start = np.concatenate([[0], edge[:-1] + 1])
    full = edge > start
    start, end = start[full], edge[full]
    up, down = _powers_to(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[:len(data)])])
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes())
    return h.view(np.int64), start


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and how many each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.zeros(len(texts), np.int64)
    flats, at = [np.empty(0, np.int64)], 0
    while at < len(data):
        upto = at + PIECE
        while upto < len(data) and not _SPACE[data[upto - 1]]:  # a piece ends between words
            upto += 1
        piece = data[at:upto]
        flat, start = _hashes(piece)
        sizes += np.bincount(np.searchsorted(ends, start + at, "right"), minlength=len(texts))
        flats.append(flat)
        at = upto
    return np.concatenate(flats), sizes


def before(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word but one and the last word before each word."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    b = np.roll(flat, 1)
    b[first] = BEGIN
    a = np.roll(b, 1)
    a[first] = BEGIN
    return a, b


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    u = x.view(np.uint64)
    return u << np.uint64(bits) | u >> np.uint64(64 - bits)


def keys_of(a: np.ndarray | None, b: np.ndarray | None, c: np.ndarray | None) -> np.ndarray:
    """Keys of n-grams; of contexts, without their ``c``. The same as ``_key``."""
    parts = [_turned(x, bits) for x, bits in ((b, 21), (c, 42)) if x is not None]
    if a is not None:
        parts.append(a.view(np.uint64))
    return np.bitwise_xor.reduce(parts)


def _key(a: str | None, b: str | None, c: str | None) -> Column:
    out = F.col(a) if a else F.lit(0).cast("bigint")
    for name, bits in ((b, 21), (c, 42)):
        if name:
            out = out.bitwiseXOR(F.shiftleft(name, bits).bitwiseOR(F.shiftrightunsigned(name, 64 - bits)))
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys (unsigned)."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on, each compressed by itself after its length."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in planes]
    return b"".join(len(x).to_bytes(4, "little") + x for x in packed)


def _unpack(data: bytes, kind: Any) -> np.ndarray:
    planes, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4], "little")
        planes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 4:end]), np.uint8))
        at = end
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(kind).ravel()


def _blocks(
    batches: Iterator[pa.RecordBatch], most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row`` of the texts, hashes and numbers of words, ``most`` words or little more at once."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in slices(batches, "text", SLICE):
        names = batch.column("row").to_numpy(zero_copy_only=False)
        parts.append((names, *words([t or b"" for t in batch.column("text").to_pylist()])))
        held += len(parts[-1][1])
        if held >= most:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, held = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


# --- on Spark ------------------------------------------------------------------------


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of every action that ends herein."""
    before_ = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before_)


@dataclass
class Sizes:
    rounds: int
    shards: int


def sizes_of(rows: DataFrame) -> Sizes:
    """Rounds and shards for these texts."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, min(ROUNDS, -(-total // ROUND_BYTES)))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Sizes(rounds, max(partitions, -(-total // rounds // SHARD_BYTES)))


def rows_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, key: Column | None) -> DataFrame:
    """``id, lang, key, text, row``: rows that are alike have one ``row``."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        (F.lit(0) if key is None else key).cast("bigint").alias("key"), F.col(text_col).cast("binary").alias("text"),
    )
    marks = [x for i, c in enumerate(("id", "lang", "key", "text")) for x in (F.lit(i), F.col(c))]
    return rows.withColumn("row", F.xxhash64(*marks))


def texts_of(rows: DataFrame, chosen: DataFrame, folder: str, rounds: int) -> DataFrame:
    """``row, text`` of the chosen ids, written once."""
    path = f"{folder}/texts"
    ids = chosen.select(F.col(chosen.columns[0]).alias("id"))
    for turn in range(rounds):  # the join may have to shuffle whole texts
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn)
        part.join(ids, "id", "left_semi").select("row", "text").write.mode("append").parquet(path)
    return rows.sparkSession.read.schema("row bigint, text binary").parquet(path)


def counted(texts: DataFrame, turn: int, rounds: int) -> DataFrame:
    """``a, b, c, n``: trigrams of the round, and how often they stand there."""
    most = BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, sizes in _blocks(batches, most):
            a, b = before(c, sizes)
            mine = np.flatnonzero(b % rounds == turn)
            a, b, c = a[mine], b[mine], c[mine]
            _, at, n = np.unique(keys_of(a, b, c), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a[at], b[at], c[at], n.astype(np.int64))], ["a", "b", "c", "n"]
            )

    rows = texts.mapInArrow(run, "a bigint, b bigint, c bigint, n bigint").repartition("b", "c")
    return rows.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def _times(column: str, name: str) -> list[Column]:
    """How many counts are 1 to 4."""
    return [F.count_if(F.col(column) == k).alias(f"{name}{k}") for k in (1, 2, 3, 4)]


def _discount(column: str, d: np.ndarray) -> Column:
    n = F.col(column)
    return F.when(n == 1, float(d[1])).when(n == 2, float(d[2])).otherwise(float(d[3]))


@dataclass
class Model:
    """Words ``c, p1, s`` (probability, addend), discounts of pairs and trigrams, and the logarithm
    of the probability of a new word."""

    texts: DataFrame
    folder: str
    words: DataFrame
    d2: np.ndarray
    d3: np.ndarray
    new: float


def train(rows: DataFrame, chosen: DataFrame, sizes: Sizes) -> Model:
    """Words and discounts of the texts whose id is in ``chosen`` (one column, distinct)."""
    spark = rows.sparkSession
    folder = shared_folder(rows, "words")
    rounds = -(-sizes.rounds // 3)  # less is on disk at once than in ``score``
    texts = texts_of(rows, chosen, folder, rounds)
    held = ["n1", *[f"{x}{k}" for x in "pt" for k in (1, 2, 3, 4)]]
    found = []
    for turn in range(rounds):
        pairs = counted(texts, turn, rounds).groupBy("b", "c").agg(
            F.count(F.lit(1)).alias("n2"), *_times("n", "t")
        )
        found.append(durable(pairs.groupBy("c").agg(
            F.count(F.lit(1)).alias("n1"), *_times("n2", "p"), *[F.sum(f"t{k}").alias(f"t{k}") for k in (1, 2, 3, 4)],
        )))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = durable(every.groupBy("c").agg(*[F.sum(x).alias(x) for x in held]))
    got = every.agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n1").alias("total"), *_times("n1", "u"),
        *[F.sum(x).alias(x) for x in held[1:]],
    ).first().asDict()
    d1, d2, d3 = (discounts(np.array([got[f"{x}{k}"] or 0 for k in (1, 2, 3, 4)])) for x in "upt")
    total = got["total"] or 0
    taken = d1[1] * got["u1"] + d1[2] * got["u2"] + d1[3] * (got["kinds"] - got["u1"] - got["u2"])
    new = float(np.log((taken / total if total else 1.0) / max(got["kinds"], 1)))
    p1 = (F.col("n1") - _discount("n1", d1)) / F.lit(float(total or 1)) + F.lit(float(np.exp(new)))
    known = every.select("c", p1.alias("p1")).withColumn("s", F.log("p1") - F.lit(new))
    return Model(texts, folder, durable(known), d2, d3, new)


def addends(model: Model, turn: int, rounds: int) -> DataFrame:
    """``key, s`` of all n-grams and contexts of a round; those of the last round are overwritten."""
    spark = model.words.sparkSession

    def written(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{model.folder}/{name}")
        return spark.read.schema(schema).parquet(f"{model.folder}/{name}")

    tri = written(
        counted(model.texts, turn, rounds).select("a", "b", "c", "n"), "counts", "a bigint, b bigint, c bigint, n bigint"
    )

    def contexts(counts: DataFrame, by: list[str], n: str, d: np.ndarray) -> DataFrame:
        """Total of each context, and the share that the discounts take from it."""
        whole = counts.groupBy(*by).agg(F.sum(n).alias("total"), F.sum(_discount(n, d)).alias("taken"))
        return whole.select(*by, "total", (F.col("taken") / F.col("total")).alias("left"))

    def seen(n: str, d: np.ndarray, lower: str) -> Column:
        return (F.col(n) - _discount(n, d)) / F.col("total") + F.col("left") * F.col(lower)

    def gain(p: str, lower: str) -> Column:
        return F.log(F.col(p) / F.col(lower) / F.col("left")).alias("s")

    pairs = tri.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n2"))
    one, two = contexts(pairs, ["b"], "n2", model.d2), contexts(tri, ["a", "b"], "n", model.d3)
    pairs = pairs.join(one, "b").join(model.words.select("c", "p1"), "c").withColumn("p2", seen("n2", model.d2, "p1"))
    tri = tri.join(two, ["a", "b"]).join(pairs.select("b", "c", "p2"), ["b", "c"]).withColumn("p3", seen("n", model.d3, "p2"))
    parts = [
        tri.select(_key("a", "b", "c").alias("key"), gain("p3", "p2")),
        pairs.select(_key(None, "b", "c").alias("key"), gain("p2", "p1")),
        two.select(_key("a", "b", None).alias("key"), F.log("left").alias("s")),
        one.select(_key(None, "b", None).alias("key"), F.log("left").alias("s")),
        model.words.filter(F.pmod("c", F.lit(rounds)) == turn).select(_key(None, None, "c").alias("key"), "s"),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    return written(every.select("key", F.col("s").cast("float").alias("s")), "model", "key bigint, s float")


def _asked(rows: DataFrame, new: float, turn: int, sizes: Sizes) -> DataFrame:
    """Requests of every block to every shard: distinct keys, how often each stands there, and in which
    documents. One more row, without ``times``, has the documents' names, words and first addends."""
    rounds, shards, most = sizes.rounds, sizes.shards, BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, c, counts in _blocks(batches, most):
            doc = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            block = xxhash.xxh64_intdigest(names.tobytes()) >> 1
            start = counts * (0.0 if turn else new)
            out = [(block % shards, block, _pack(names), None, _pack(np.concatenate([counts.astype(np.float64), start])))]
            a, b = before(c, counts)
            own = np.flatnonzero(c % rounds == turn)
            mine = np.flatnonzero(b % rounds == turn)
            a, b, d = a[mine], b[mine], doc[mine]
            keys = np.concatenate([
                keys_of(a, b, c[mine]), keys_of(None, b, c[mine]), keys_of(a, b, None), keys_of(None, b, None),
                keys_of(None, None, c[own]),
            ])
            order = np.argsort(keys)
            keys, docs = keys[order], np.concatenate([d, d, d, d, doc[own]])[order]
            edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            for shard in np.flatnonzero(edges[1:] > edges[:-1]):
                k = keys[edges[shard]:edges[shard + 1]]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                out.append((
                    int(shard), block, _pack(np.diff(k[first], prepend=np.uint64(0))),
                    _pack(np.diff(first, append=len(k)).astype(np.uint32)), _pack(docs[edges[shard]:edges[shard + 1]]),
                ))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["shard", "block", "keys", "times", "docs"]
            )

    return rows.select("row", "text").mapInArrow(run, "shard int, block bigint, keys binary, times binary, docs binary")


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Each block's documents and the sums of their addends in this shard."""
    own = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(own)
    own, s = own[order], known.column("s").to_numpy()[order].astype(np.float64)
    out = []
    for block, keys, times, docs in zip(*[asked.column(c) for c in ("block", "keys", "times", "docs")]):
        if not times.is_valid:
            out.append((block.as_py(), True, keys.as_py(), docs.as_py()))
            continue
        if not len(own):
            continue
        wanted = np.cumsum(_unpack(keys.as_py(), np.uint64))
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        adds = np.repeat(np.where(own[at] == wanted, s[at], 0.0), _unpack(times.as_py(), np.uint32))
        some, place = np.unique(_unpack(docs.as_py(), np.uint32), return_inverse=True)
        out.append((block.as_py(), False, _pack(some), _pack(np.bincount(place, adds).astype(np.float32))))
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["block", "whole", "docs", "sums"])


def _total(part: pa.Table) -> pa.Table:
    """Documents of a block with their sums over all shards."""
    whole = part.column("whole").to_numpy()
    docs, sums = part.column("docs"), part.column("sums")
    heads = np.flatnonzero(whole)
    names = _unpack(docs[int(heads[0])].as_py(), np.int64)
    counts, total = _unpack(sums[int(heads[0])].as_py(), np.float64).reshape(2, -1).copy()
    for i in np.flatnonzero(~whole):  # more than one head only where whole blocks repeat
        total[_unpack(docs[int(i)].as_py(), np.uint32)] += _unpack(sums[int(i)].as_py(), np.float32) / len(heads)
    return pa.table({"row": names, "n_words": counts.astype(np.int64), "nll": -total})


def score(rows: DataFrame, model: Model, sizes: Sizes) -> DataFrame:
    """``id, lang, key, n_words, nll`` (sum of negative log probabilities) of every document."""
    parts = []
    for turn in range(sizes.rounds):
        known = addends(model, turn, sizes.rounds)
        top = F.shiftrightunsigned("key", 32) * F.lit(sizes.shards).cast("bigint")
        owned = known.select(F.shiftright(top, 32).cast("int").alias("shard"), "key", "s")
        answers = _asked(rows, model.new, turn, sizes).groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(
            _answer, "block bigint, whole boolean, docs binary, sums binary"
        )
        summed = answers.groupBy("block").applyInArrow(_total, "row bigint, n_words bigint, nll double")
        # rows that are alike are scored alike
        parts.append(durable(summed.groupBy("row").agg(F.max("n_words").alias("n_words"), F.max("nll").alias("nll"))))
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    every = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.sum("nll").alias("nll"))
    return rows.select("id", "lang", "key", "row").join(every, "row").drop("row")
