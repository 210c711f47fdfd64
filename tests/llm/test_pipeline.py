import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import SCHEMA, TEXTS
from tests.llm.test_quality import LABELS, corpus
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tickloom.llm import decontaminate, pii, stages

SF = os.environ.get("TICKLOOM_SF_DIR", "/root/testdata/sf0.001")
ITEM = "How many sheep does the farmer with the red hat count on the hill at night?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with planted copies, leaks, personal data and junk."""
    path = tmp_path_factory.mktemp("tables")
    rows, labels = corpus(180, seed=2)
    rows = [(i, f"{t} a{i}.b@c.de" if 90 <= i < 100 else t, lang) for i, t, lang in rows]  # personal data
    clean = [r for r in rows if r[0] % 10 != 7]
    rows += [(1000 + k, clean[k][1], clean[k][2]) for k in range(10)]  # exact copies
    rows += [(1100 + k, f"{clean[k + 20][1]} {ITEM}", clean[k + 20][2]) for k in range(5)]  # leaks
    rows += [(i and 2000 + i, t, "en") for i, t in TEXTS if t is None or len(t) < 1000]
    full = [(i, t, lang, "s", len(t or ""), *["x"] * (len(SCHEMA) - 5)) for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_in_order_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
    before = docs.collect()

    # junk and texts without words go, by the stage's own test of each row
    rows = stages.quality_classifier(spark, docs, folder).collect()
    assert rows and list(rows[0].asDict()) == columns
    gone = sorted(set(map(str, before)) - set(map(str, rows)))
    for r in before:
        junk = not (r["text"] or "").split() or (r["text"].isupper() and "!!" in r["text"])
        assert not junk or str(r) in gone, r
    assert sum((r["doc_id"] or 0) < 180 and (r["doc_id"] or 0) % 10 != 7 for r in rows if r["source"] == "s") >= 150

    # one row of each component
    prints = [plain_fingerprint(r["text"]) for r in rows]
    comp = plain_components([i for i in range(len(rows))], prints)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = stages.near_dedup(spark, docs, folder).collect()
    assert len(kept) == len(set(comp.values()))
    best = {}
    for n, r in enumerate(rows):
        best.setdefault(comp[n], []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(min(v) for v in best.values())

    # leaks go
    docs = spark.createDataFrame(kept, SCHEMA)
    pure = stages.benchmark_decontamination(spark, docs, folder).collect()
    want = [r for r in kept if decontaminate.normal(ITEM) not in decontaminate.normal(r["text"])]
    assert sorted(map(str, pure)) == sorted(map(str, want)) and len(want) < len(kept)

    # personal data is blanked
    safe = stages.redaction(spark, spark.createDataFrame(pure, SCHEMA), folder).collect()
    texts = {r["doc_id"]: r["text"] for r in pure}
    for r in safe:
        assert r["text"] == pii.blanked(texts[r["doc_id"]], pii.base_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert sum("[EMAIL]" in r["text"] for r in safe) >= 3

    # ids are those of the library
    library = Tokenizer.from_file(public_tokenizers.path(stages.TOKENIZER))
    final = stages.tokens(spark, spark.createDataFrame(safe, SCHEMA), folder).collect()
    texts = {r["doc_id"]: r["text"] for r in safe}
    for r in final:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    assert len(final) == len(safe)

    # run() is its stages
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, final))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    assert stage(spark, docs, folder).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
def test_registered_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).collect()


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
