import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tickloom.llm import quality as q

LABELS = "doc_id bigint, quality int, toxic int, text string, id string"


def corpus(n=240, seed=1):
    """Documents of three languages; every tenth is shouted junk."""
    rng, rows, labels = random.Random(seed), [], []
    words = {
        "en": "the of and to in that is was for with house garden water".split(),
        "de": "der die und das ist nicht mit haus garten wasser".split(),
        None: "le la les des est dans une maison jardin eau".split(),
    }
    for i in range(n):
        lang = list(words)[i % 3]
        text = " ".join(rng.choices(words[lang], k=rng.randint(20, 150)))
        junk = i % 10 == 7
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text.capitalize() + ".", lang))
        if i % 2:
            labels.append((i, int(not junk), 0, "x", "x"))
    return rows, labels


class Plain:
    """The same model, word by word over dictionaries."""

    def __init__(self, texts):
        self.c3 = Counter()
        for text in texts:
            a = b = q.BEGIN
            for w in text.split():
                c = q.symbol(w.encode())
                self.c3[a, b, c] += 1
                a, b = b, c
        self.c2 = Counter((b, c) for _, b, c in self.c3)
        self.c1 = Counter(c for _, c in self.c2)
        self.d = [None, *[self.discount(x.values()) for x in (self.c1, self.c2, self.c3)]]
        self.ctx3, self.ctx2 = {}, {}
        for (a, b, _), n in self.c3.items():
            self.ctx3.setdefault((a, b), []).append(n)
        for (b, _), n in self.c2.items():
            self.ctx2.setdefault(b, []).append(n)

    @staticmethod
    def discount(counts):
        n = Counter(counts)
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0, *[min(max(d, 0.05 * k), float(k)) for k, d in enumerate(raw, 1)]]

    def level(self, count, context, d, lower):
        total = sum(context)
        taken = sum(d[min(n, 3)] for n in context)
        return max(count - d[min(count, 3)], 0) / total + taken / total * lower

    def p(self, a, b, c):
        uni = self.level(self.c1[c], list(self.c1.values()) or [0], self.d[1], 1 / q.SYMBOLS) if self.c1 else 1 / q.SYMBOLS
        two = self.level(self.c2[b, c], self.ctx2[b], self.d[2], uni) if b in self.ctx2 else uni
        return self.level(self.c3[a, b, c], self.ctx3[a, b], self.d[3], two) if (a, b) in self.ctx3 else two

    def nll(self, text):
        a = b = q.BEGIN
        total = 0.0
        for w in (text or "").split():
            c = q.symbol(w.encode())
            total -= math.log(self.p(a, b, c))
            a, b = b, c
        return total


@pytest.fixture(scope="module")
def data(spark, documents):
    rows, labels = corpus()
    docs = documents([]).select("doc_id", "text", "lang").union(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    )
    return rows, labels, docs, spark.createDataFrame(labels, LABELS)


def test_scores_against_plain_model(data, monkeypatch):
    rows, labels, docs, table = data
    monkeypatch.setattr(q, "SLICE", 2000)  # many blocks
    monkeypatch.setattr(q, "BLOCK_WORDS", 300)
    good = {i for i, quality, *_ in labels if quality and zlib.crc32(str(i).encode()) % q.FOLDS}
    plain = Plain([t for i, t, _ in rows if i in good])
    blocks = q.encode(docs)
    assert blocks.count() > 5
    chosen = q.trusted(table).filter(~q.held_out(F.col("id")))
    got = {r["id"]: r for r in q.score(blocks, q.train(blocks, chosen), shards=7).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        assert got[i]["n_words"] == len(text.split()) and got[i]["lang"] == lang
        assert got[i]["nll"] == pytest.approx(plain.nll(text), rel=1e-4)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.zipf(1.3, 20_000) % (1 << 3 * q.BITS), return_counts=True)
    pairs = np.zeros((q.SYMBOLS, q.SYMBOLS), np.int64)
    np.add.at(pairs, (keys >> q.BITS & q.SYMBOLS - 1, keys & q.SYMBOLS - 1), 1)
    lower = q.lower_orders(pairs)
    assert np.allclose(lower.sum(axis=1), 1, atol=1e-4)
    d = q.discounts(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])
    for context in (keys[0] >> q.BITS, 123_456):
        every = (int(context) << q.BITS) | np.arange(q.SYMBOLS)
        assert np.exp(q.log_probabilities(every, keys, counts, d, lower).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_junk_goes_and_clean_stays(data):
    rows, _, docs, labels = data
    got = {r["doc_id"]: r["keep"] for r in q.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (i % 10 != 7) for i, _, _ in rows)


def test_contradicting_and_null_labels_are_not_trusted(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, None), (4, None, 0), (None, 1, 0), (5, 1, 1), (6, 1, 0), (6, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    assert sorted(r["id"] for r in q.trusted(labels).collect()) == [1, 6]


def test_edge_rows(messy, documents, data):
    labels = data[3]
    got = q.classify(messy, labels.filter("false")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["keep"] == (r["n_words"] > 0) and (r["perplexity"] is None) == (r["n_words"] == 0)
    assert q.classify(documents([]), labels).collect() == []


def test_classes_of_words():
    plain = {q.symbol(w.encode()) for w in ("the", "of", "wonderful", "là")}
    assert min(plain) >= q.PLAIN
    assert q.symbol(b"THE!!") == q.symbol(b"WONDER!!") != q.symbol(b"THE")
    assert q.symbol(b"House") == q.symbol(b"Garden") and q.symbol(b"|") == q.symbol(b"---")
