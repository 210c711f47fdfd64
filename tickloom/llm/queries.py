"""The registered queries: each operator over its whole table, with production parameters."""
from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import (
    ann, bpe, decontaminate, langid, licences, linktrust, pii, prefixtrie, quality, sharding, simhash, wacz, whitening,
)
from tickloom.llm.common import ORACLES, QUERIES, query, table
from tickloom.llm.stages import TOKENIZER

__all__ = ["ORACLES", "QUERIES"]



@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    def sha(column: str) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in batch.column(column)], pa.string())

    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("n_tokens"), sha("token_ids"), sha("decoded")],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())])
    for name in ("ids_sha256", "decoded_sha256"):
        schema = schema.add(name, T.StringType())
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded="decoded", then=(_digests, schema))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.train(docs.filter(~langid.held_out()))
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.classify(rows, dictionaries, keep=("held_out",))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_ann")
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


WACZ_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT p.page_id, p.html, f.first, sha1(p.html) AS hex FROM p JOIN f USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31
    AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return found.select(
        "doc_id",
        *[_of_kind(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


@query("op5_wacz", WACZ_SQL)
def op5_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = wacz.write_packages(pages, wacz.shared_folder(pages))
    index = wacz.read_index(manifest.repartition("package"))
    records = wacz.read_records(wacz.stretches(index, manifest), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_licences", licences.check_sql())
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.recognise(table(spark, sf_dir, "documents"))


@query("op13_linktrust", linktrust.check_sql())
def op13_linktrust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linktrust.filter_urls(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# CRC-32 of the decimal id, then every prefix as a list of turns.
TRIE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS v FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY i) AS own, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
      lambda s, one: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS node FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
nodes AS (SELECT d, node, min(conv_id) AS first, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY d, node),
kids AS (SELECT p.first, p.d, count(*) AS n FROM nodes k JOIN nodes p ON p.d = k.d - 1 AND p.node = k.node[1:k.d - 1] GROUP BY ALL),
each AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN nodes.d > 0 THEN (n_convs - 1) * length(node[nodes.d].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (first, d)),
-- a node's subtree: the nodes of its members at its depth and below, each once
below AS (SELECT DISTINCT a.first, a.d, e.first AS f, e.d AS fd, e.n_children = 0 AS leaf, e.saved
  FROM each a JOIN m x ON x.d = a.d AND x.node = a.node JOIN m y ON y.conv_id = x.conv_id AND y.d >= a.d
  JOIN each e ON e.d = y.d AND e.node = y.node),
sums AS (SELECT first, d, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY ALL)
SELECT e.first AS conv_id, e.d AS depth, p.first AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends AS ends_sha256
FROM each e JOIN sums USING (first, d) LEFT JOIN nodes p ON p.d = e.d - 1 AND p.node = e.node[1:e.d - 1]
"""


@query("op12_prefixtrie", TRIE_SQL)
def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))
