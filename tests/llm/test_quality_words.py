"""The classifier by whole words, beside the plain model of test_quality."""
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_quality import Plain, data  # noqa: F401
from tickloom.llm import quality as q
from tickloom.llm import wordmodel


class PlainWords(Plain):
    """The same model over whole words."""

    def __init__(self, texts):
        self.c3 = Counter()
        for text in texts:
            a = b = None
            for c in text.split():
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

    def p(self, a, b, c):
        uni = self.level(self.c1[c], list(self.c1.values()), self.d[1], 1 / len(self.c1))
        two = self.level(self.c2[b, c], self.ctx2[b], self.d[2], uni) if b in self.ctx2 else uni
        return self.level(self.c3[a, b, c], self.ctx3[a, b], self.d[3], two) if (a, b) in self.ctx3 else two

    def nll(self, text):
        a = b = None
        total = 0.0
        for c in (text or "").split():
            total -= math.log(self.p(a, b, c))
            a, b = b, c
        return total


@pytest.mark.parametrize("rounds", [1, 3])
def test_words_against_plain_model(data, monkeypatch, rounds):
    rows, labels, docs, table = data
    monkeypatch.setattr(wordmodel, "SLICE", 2000)  # many blocks
    monkeypatch.setattr(wordmodel, "BLOCK_WORDS", 300)
    good = {i for i, quality, *_ in labels if quality and zlib.crc32(str(i).encode()) % q.FOLDS}
    plain = PlainWords([t for i, t, _ in rows if i in good])
    more = [(1000, "the house Water. zzqxkon nation the the the", "en"), (1001, None, "en"), (1001, "", None), (1002, "the", "en")]
    twice = docs.sparkSession.createDataFrame([*more, more[0]], docs.schema)
    texts = wordmodel.rows_of(docs.union(twice), "doc_id", "text", "lang", None)
    sizes = wordmodel.Sizes(rounds, 7)
    model = wordmodel.train(texts, q.trusted(table).filter(~q.held_out(F.col("id"))), sizes)
    got = wordmodel.score(texts, model, sizes).collect()
    want = sorted((i, lang or "", len((t or "").split()), t) for i, t, lang in rows + [*more, more[0]] if t)
    assert len(got) == len(rows) + 5
    assert sorted((r["id"], r["lang"] or "", r["n_words"]) for r in got if r["n_words"]) == [w[:3] for w in want]
    texts_of = {i: t for i, t, _ in rows + more if t}
    for r in got:
        assert r["nll"] == pytest.approx(plain.nll(texts_of[r["id"]]) if r["n_words"] else 0, rel=1e-5)


def test_words_of_one_class_are_told_apart(data):
    """Unknown words with a known ending are no trusted text."""
    rows, _, docs, labels = data
    swap = {"water": "zzqxter", "garden": "moxxden", "house": "yyyyyse", "that": "qqat", "with": "xxth"}
    assert all(q.symbol(a.encode()) == q.symbol(b.encode()) for a, b in swap.items())
    text = "the water garden with that house and the house with water in that garden to that water " * 4
    odd = " ".join(swap.get(w, w) for w in text.split())
    two = docs.sparkSession.createDataFrame([(5000, text, "en"), (5001, odd, "en")], docs.schema)
    got = {r["doc_id"]: r for r in q.classify(docs.union(two), labels).collect()}
    assert got[5000]["keep"] and not got[5001]["keep"] and got[5001]["perplexity"] > 10 * got[5000]["perplexity"]
