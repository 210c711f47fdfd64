import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from tickloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = (
    "a", "b", "'", "s", "t", "re", "ll", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "漢", "😀", "!",
    "..", "\x1c", "\x85", "<|endoftext|>", "<|", "٣", "½", "'D", "The", " the", " ",
)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


def test_random_texts_match_the_library(model, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", "a" * 5000, " " * 3000, "<|endoftext|>", "  <|endoftext|>  \n"]
    flat, edges = model.encode_batch(texts)
    decoded = model.decode_batch(flat, edges)
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert flat[edges[i]:edges[i + 1]].tolist() == want.ids, repr(text)
        assert decoded[i] == library.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 20, 48])
def test_batched_words_match_single_ones(model, length):
    rng = random.Random(length)
    words = np.array([rng.choices(b"ertionsh theanding", k=length) for _ in range(300)], np.uint8)
    ids, counts = model.encode_same_length(words)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, word in enumerate(words):
        assert ids[at[i]:at[i + 1]].tolist() == model.encode_word(word.tobytes())


def test_decode_replaces_broken_bytes(model, library):
    ids = [model.of_byte[0xE2], model.of_byte[0x41], 50256]
    assert model.decode_batch(np.array(ids, "<u4"), np.array([0, 3])) == [
        library.decode(ids, skip_special_tokens=False)
    ]


def test_edge_rows(messy, library):
    rows = bpe.encode(messy, PATH, decoded="decoded").collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in rows) == sorted((i or 0, t or "") for i, t in TEXTS)
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["_bpe_text"] == "x"  # columns of the caller's stay


def test_decode_of_stored_ids(messy):
    encoded = bpe.encode(messy, PATH).select("doc_id", "text", "token_ids")
    for r in bpe.decode(encoded, PATH).collect():
        assert r["decoded"] == (r["text"] or "")


def test_empty_table(documents):
    assert bpe.encode(documents([]), PATH, decoded="d").collect() == []


def test_slices_are_let_go(documents):
    """What a worker holds does not grow with the slices it has encoded."""
    docs = documents([(i, f"{i} words of a long text " * 50_000) for i in range(12)]).coalesce(1)

    def held(batch):
        return pa.RecordBatch.from_arrays([pa.array([pa.total_allocated_bytes()], pa.int64())], ["held"])

    schema = T.StructType([T.StructField("held", T.LongType())])
    seen = [r["held"] for r in bpe.encode(docs, PATH, then=(held, schema)).collect()]
    assert len(seen) == 12 and max(seen[3:]) < seen[2] + 3_000_000
