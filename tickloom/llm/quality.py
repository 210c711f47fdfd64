"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model (``wordmodel``) is trained on trusted documents and counts whole words.

A document is rejected if its log perplexity is above the cut of its language. The cut
comes from trusted documents that were left out of training: their median plus
``SLACK`` times the distance from there to the quantile ``HIGH``, and ``MARGIN``. As short texts scatter, a
text is compared (and that quantile taken) as if ``PRIOR`` more words of the language's median stood in it.

``encode``, ``train`` and ``score`` are the same model over classes instead of words: its lower
orders are small tables of a fixed bound, its trigram counts stay in shards. ``classify`` does
not use it. Documents are encoded once, in blocks of some thousand (ids, languages, packed
symbols). Every block asks each shard for its own distinct trigrams, in one packed row; the
shard joins the requests with its counts and answers with log probabilities, which return to
the block.

Defined results: a null or empty text has no words, perplexity null, and is rejected;
a language without held-out trusted documents, null included, takes the cut over all
of them; without any, nothing with words is rejected; a null id is never trusted; labels
that contradict each other are not trusted; repeated rows are scored alike; an empty table
gives no rows. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.llm import wordmodel
from tickloom.llm.classes import BEGIN, BITS, PLAIN, SYMBOLS, discounts, symbol  # noqa: F401
from tickloom.llm.common import slices
from tickloom.session import durable

#: Bytes of text encoded at once, and words of a block: the larger a block, the fewer
#: trigrams it shares with others and asks for again.
SLICE, BLOCK_WORDS = 4_000_000, 2_000_000
#: Log probabilities travel in steps of this size.
STEP = 1 / 2048
#: One trusted document in so many is held out for the ranges.
FOLDS = 5
HIGH, SLACK, MARGIN, PRIOR = 0.99, 1.5, 0.15, 10
#: More languages than this are refused: their cuts are collected.
LANGUAGES = 1000
#: Spreads neighbouring contexts over the shards.
MIX = 2654435761
_known: dict[bytes, int] = {}


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, and how many each text has."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    if len(_known) > 400_000:
        _known.clear()
    out = np.empty(len(flat), np.uint16)
    get = _known.get
    for i, word in enumerate(flat):
        s = get(word)
        if s is None:
            s = _known[word] = symbol(word)
        out[i] = s
    return out, sizes


def trigrams(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of the trigram that ends at each word; a text begins after two ``BEGIN``."""
    c = flat.astype(np.int64)
    n = len(c)
    if not n:
        return c
    first = np.zeros(n, bool)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[starts] = True
    b = np.empty(n, np.int64)
    b[1:] = c[:-1]
    b[first] = BEGIN
    a = np.empty(n, np.int64)
    a[1:] = b[:-1]
    a[first] = BEGIN
    return a << 2 * BITS | b << BITS | c


def lower_orders(pairs: np.ndarray) -> np.ndarray:
    """Matrix of ``p(c | b)`` from the number of distinct words before each pair ``b, c``."""

    def histogram(x: np.ndarray) -> np.ndarray:
        return np.bincount(np.minimum(x[x > 0], 5).astype(np.int64), minlength=6)[1:5]

    def weights(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        """What the discounts take from each row."""
        return sum(d[k] * ((counts == k) if k < 3 else (counts >= 3)).sum(axis=-1) for k in (1, 2, 3))

    uni = (pairs > 0).sum(axis=0).astype(np.int64)
    d1 = discounts(histogram(uni))
    total = max(int(uni.sum()), 1)
    p1 = np.maximum(uni - d1[np.minimum(uni, 3)], 0) / total
    p1 = p1 + (1 - p1.sum()) / len(uni)
    d2 = discounts(histogram(pairs.ravel()))
    out = np.empty(pairs.shape, np.float32)
    for b in range(len(pairs)):
        row = pairs[b]
        total = int(row.sum())
        if not total:
            out[b] = p1
            continue
        out[b] = np.maximum(row - d2[np.minimum(row, 3)], 0) / total + float(weights(row, d2)) / total * p1
    return out


def log_probabilities(
    keys: np.ndarray, model_keys: np.ndarray, counts: np.ndarray, d: np.ndarray, p2: np.ndarray
) -> np.ndarray:
    """Natural logarithm of ``p(c | a, b)`` for trigram keys of one shard."""
    low = p2[keys >> BITS & SYMBOLS - 1, keys & SYMBOLS - 1].astype(np.float64)
    if not len(model_keys):
        return np.log(low).astype(np.float32)
    order = np.argsort(model_keys)
    model_keys, counts = model_keys[order], counts[order]
    at = np.minimum(np.searchsorted(model_keys, keys), len(model_keys) - 1)
    count = np.where(model_keys[at] == keys, counts[at], 0)
    context = model_keys >> BITS
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total = np.add.reduceat(counts, begin)
    taken = np.add.reduceat(d[np.minimum(counts, 3)], begin)
    place = np.minimum(np.searchsorted(context[begin], keys >> BITS), len(begin) - 1)
    known = context[begin][place] == keys >> BITS
    p = np.maximum(count - d[np.minimum(count, 3)], 0) / total[place] + taken[place] / total[place] * low
    return np.log(np.where(known, p, low)).astype(np.float32)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Trigrams with the same first two words share a shard."""
    return (((keys >> BITS) * MIX & 0xFFFFFFFF) >> 8).astype(np.int32) % shards


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: Any) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# --- on Spark ------------------------------------------------------------------------


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key: Column | None = None
) -> DataFrame:
    """Documents as blocks of packed symbols, written once. ``key`` is of the caller's.

    A block's name is a hash of what is in it, so a repeated task names it alike.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        (F.lit(0) if key is None else key).cast("bigint").alias("key"), F.col(text_col).cast("binary").alias("text"),
    )
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        flats: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            narrow = pa.Table.from_batches(parts).combine_chunks()
            ids, langs, keys = (narrow.column(c).chunk(0) for c in ("id", "lang", "key"))
            blob = _pack(np.concatenate(flats))
            name = xxhash.xxh64(repr(ids.to_pylist()).encode() + blob).intdigest() >> 1
            one = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, x) for x in (ids, langs, keys, pa.array(np.concatenate(counts)))]
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), *lists, pa.array([blob], pa.binary())], schema.names
            )

        for batch in slices(batches, "text", SLICE):
            flat, sizes = symbols([t or b"" for t in batch.column("text").to_pylist()])
            parts.append(batch.select(["id", "lang", "key"]))
            flats.append(flat)
            counts.append(sizes)
            if sum(map(len, flats)) >= BLOCK_WORDS:
                yield block()
                parts, flats, counts = [], [], []
        if parts:
            yield block()

    return durable(rows.mapInArrow(run, schema))


@dataclass
class Model:
    """Trigram counts (``key, n``), their discounts, and the broadcast lower orders."""

    counts: DataFrame
    discounts: np.ndarray
    lower: Any


def train(blocks: DataFrame, chosen: DataFrame) -> Model:
    """Counts over the documents whose id is in ``chosen`` (one column, distinct)."""
    id_col = chosen.columns[0]
    narrow = blocks.select("block", F.posexplode("ids").alias("pos", "id"))
    picked = narrow.join(chosen.select(F.col(id_col).alias("id")), "id").groupBy("block").agg(
        F.collect_set("pos").alias("picked")  # at most the documents of a block
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, sizes, take in zip(*[batch.column(c).to_pylist() for c in ("blob", "sizes", "picked")]):
                sizes = np.array(sizes, np.int64)
                mask = np.zeros(len(sizes), bool)
                mask[take] = True
                keys, n = np.unique(
                    trigrams(_unpack(blob, np.uint16), sizes)[np.repeat(mask, sizes)], return_counts=True
                )
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["key", "n"])

    found = blocks.select("block", "blob", "sizes").join(picked, "block").mapInArrow(run, "key bigint, n bigint")
    counts = durable(found.groupBy("key").agg(F.sum("n").alias("n")))
    few = {r["n"]: r["c"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    seen = counts.groupBy(F.col("key").bitwiseAND(F.lit(SYMBOLS * SYMBOLS - 1)).alias("pair")).agg(
        F.count(F.lit(1)).alias("n")
    ).toArrow()  # SYMBOLS squared rows at most
    at = seen.column("pair").to_numpy()
    pairs[at >> BITS, at & SYMBOLS - 1] = seen.column("n").to_numpy()
    lower = blocks.sparkSession.sparkContext.broadcast(lower_orders(pairs))
    return Model(counts, discounts(np.array([few.get(k, 0) for k in (1, 2, 3, 4)])), lower)


def score(blocks: DataFrame, model: Model, shards: int | None = None) -> DataFrame:
    """``id, lang, key, n_words, nll`` (sum of negative log probabilities) of every document."""
    shards = shards or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d, lower = model.discounts, model.lower

    def distinct(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(trigrams(_unpack(blob, np.uint16), sizes), return_inverse=True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, sizes in zip(*[batch.column(c).to_pylist() for c in ("block", "blob", "sizes")]):
                keys, _ = distinct(blob, np.array(sizes, np.int64))
                owner = shard_of(keys, shards)
                wanted = np.unique(owner)
                yield pa.RecordBatch.from_arrays([
                    pa.array(wanted, pa.int32()), pa.array([block] * len(wanted), pa.int64()),
                    pa.array([_pack(np.diff(keys[owner == s], prepend=0)) for s in wanted], pa.binary()),
                ], ["shard", "block", "keys"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        counts = known.column("n").to_numpy(), known.column("key").to_numpy()
        blocks_, shard = asked.column("block"), asked.column("shard")
        out = []
        for packed in asked.column("keys"):
            keys = np.cumsum(_unpack(packed.as_py(), np.int64))
            logs = log_probabilities(keys, counts[1], counts[0], d, lower.value)
            out.append(_pack(np.rint(logs / -STEP).clip(0, 0xFFFF).astype(np.uint16)))
        return pa.table({"block": blocks_, "shard": shard, "values": pa.array(out, pa.binary())})

    owned = model.counts.select(
        (F.shiftright((F.shiftright("key", BITS) * MIX).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % shards)
        .cast("int").alias("shard"), "key", "n",
    )
    requests = blocks.select("block", "blob", "sizes").mapInArrow(ask, "shard int, block bigint, keys binary")
    answers = requests.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(
        answer, "block bigint, shard int, values binary"
    )
    schema = T.StructType([
        T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("lang", T.StringType()),
        T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("nll", T.DoubleType()),
    ])

    def total(block: pa.Table, values: pa.Table) -> pa.Table:
        got = dict(zip(values.column("shard").to_pylist(), values.column("values").to_pylist()))
        parts = []
        for row in range(block.num_rows):  # more than one only where whole blocks repeat
            sizes = block.column("sizes")[row].values.to_numpy()
            keys, inverse = distinct(block.column("blob")[row].as_py(), sizes)
            owner = shard_of(keys, shards)
            logs = np.zeros(len(keys))
            for s in np.unique(owner):
                logs[owner == s] = _unpack(got[int(s)], np.uint16) * -STEP
            doc = np.repeat(np.arange(len(sizes)), sizes)
            parts.append(pa.table([
                block.column("ids")[row].values, block.column("langs")[row].values, block.column("keys")[row].values,
                pa.array(sizes, pa.int64()),
                pa.array(-np.bincount(doc, logs[inverse], len(sizes)), pa.float64()),
            ], schema.names))
        return pa.concat_tables(parts) if parts else pa.table(
            [pa.array([], f.type) for f in to_arrow_schema(schema)], schema.names
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, schema)


def held_out(id_col: Column) -> Column:
    """Trusted documents that set the cuts and are not learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled good and harmless, without contradiction."""
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")
    ).filter("q = 1 AND t = 0").select("id")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    high: float = HIGH, slack: float = SLACK, key: Column | None = None,
) -> DataFrame:
    """Per document: id, ``n_words, perplexity, cut`` (highest perplexity kept), ``keep``, and
    with ``key`` that column of the caller's to find rows again."""
    spark = docs.sparkSession
    good = trusted(labels)
    rows = wordmodel.rows_of(docs, id_col, text_col, lang_col, key)
    with wordmodel.without_old_shuffles(spark):
        sizes = wordmodel.sizes_of(rows)
        model = wordmodel.train(rows, good.filter(~held_out(F.col("id"))), sizes)
        scores = durable(wordmodel.score(rows, model, sizes))
    sample = scores.filter("n_words > 0").join(good.filter(held_out(F.col("id"))), "id").select("lang", "nll", "n_words")

    def quantiles(rows: DataFrame, at: float) -> tuple[DataFrame, Column]:
        """Of each language (``lang, q``), and over all."""

        def found(by: DataFrame | Any) -> list[Any]:
            got = by.agg(F.percentile_approx("x", at, 100_000).alias("q")).limit(LANGUAGES + 1).collect()
            if len(got) > LANGUAGES:
                raise ValueError(f"more than {LANGUAGES} languages")
            return [r for r in got if r["q"] is not None]

        each = [(r["lang"], r["q"]) for r in found(rows.filter("lang IS NOT NULL").groupBy("lang"))]
        whole = [r["q"] for r in found(rows)]
        return spark.createDataFrame(each, "lang string, q double"), F.lit(whole[0] if whole else None).cast("double")

    def beside(rows: DataFrame, name: str, own: DataFrame, whole: Column) -> DataFrame:
        own = own.withColumnRenamed("q", "own")  # LANGUAGES rows at most
        return rows.join(F.broadcast(own), "lang", "left").withColumn(name, F.coalesce("own", whole)).drop("own")

    mean = (F.col("nll") + PRIOR * F.col("m")) / (F.col("n_words") + PRIOR)
    middle = quantiles(sample.withColumn("x", F.col("nll") / F.col("n_words")), 0.5)
    sample = beside(sample, "m", *middle)
    rows = beside(beside(scores, "m", *middle), "h", *quantiles(sample.withColumn("x", mean), high))
    cut = F.col("m") + slack * (F.col("h") - F.col("m")) + MARGIN
    words = F.col("n_words") > 0
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.when(words, F.exp(F.col("nll") / F.col("n_words"))).alias("perplexity"),
        F.exp(cut).alias("cut"), (words & ~F.coalesce(mean > cut, F.lit(False))).alias("keep"),
        *(["key"] if key is not None else []),
    )
