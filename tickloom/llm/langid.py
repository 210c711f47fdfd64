"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its training texts. A text is
cut into blocks, every block is compressed with every dictionary, and the language with
the smallest total wins. Blocks are short, so that long texts lean on the dictionaries
and not on themselves; all blocks of a text are used.

The dictionaries come from a bounded sample: per language at most ``SAMPLE`` training
documents chosen by a hash of their id, up to ``SNIPPET`` characters of each and
``DICTIONARY`` bytes together. Languages are limited to ``LANGUAGES``; more raise an error.

Defined results: a null text or one without letters is ``und`` with score 0; equal sizes
go to the language first in the alphabet with score 0; without any training text all
are ``und``; documents with a null language or text are not learned from; repeated rows
are predicted alike. Other columns of the input are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import in_share, slices, texts_of

SAMPLE, SNIPPET, DICTIONARY, LANGUAGES = 200, 1000, 112 * 1024, 200
#: Bytes of a block, compression level, and the least margin that is not rejected.
BLOCK, LEVEL, MARGIN = 4096, 6, 0.02
UNKNOWN = "und"
SLICE = 4_000_000
_LETTER = re.compile(r"[^\W\d_]")
_models: dict[str, Any] = {}


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for documents that are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, from at most ``SAMPLE`` documents of each."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"),
        F.substring(text_col, 1, SNIPPET).alias("text"),
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    # about twice SAMPLE rows of each language are left before anything moves
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * SAMPLE / r["n"]))])
    few = rows.filter(in_share(F.col("h"), shares[F.col("lang")])).distinct()
    place = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    sample = few.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= SAMPLE)
    found: dict[str, list[tuple[int, str]]] = {}
    for row in sample.select("lang", "place", "text").toLocalIterator():
        found.setdefault(row["lang"], []).append((row["place"], row["text"]))
    out = {}
    for lang, texts in found.items():
        held, parts = 0, []
        for _, text in sorted(texts):
            if held >= DICTIONARY:
                break
            parts.append(text.lower().encode())
            held += len(parts[-1])
        out[lang] = b"\n".join(parts)[:DICTIONARY]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False,
            ))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        view = memoryview(data)
        blocks = [view[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.langs[best], 1.0 if rest is None else 1.0 - sizes[best] / rest


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
    margin: float = MARGIN, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, the columns ``keep``, ``lang_pred``, ``score`` (how much smaller the
    best code is than the next, 0 to 1) and ``accepted`` (the margin is not narrow)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # LANGUAGES * DICTIONARY bytes at most
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in slices(batches, "_text", SLICE):
            found = [model.predict(t) for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], schema.names,
            )

    return rows.mapInArrow(run, schema).withColumn(
        "accepted", (F.col("score") >= margin) & (F.col("lang_pred") != UNKNOWN)
    )
