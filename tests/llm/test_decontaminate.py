import random

import pytest

from tests.llm.conftest import TEXTS
from tickloom.llm import decontaminate as d

ITEMS = [
    (1, "What is the capital city of the country that lies north of the great lakes?"),
    (2, "A farmer has seventeen sheep and all but nine run away; how many are left over?"),
    (3, "tiny"), (4, None), (None, "an item without an id is not searched for in any text"),
    (5, "A farmer has seventeen sheep and all but nine run away; how many are left over?"),
]


def edits(pattern, text):
    """Fewest edits between ``pattern`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(rng, text, share):
    out = list(text)
    for _ in range(int(len(out) * share)):
        i, what = rng.randrange(len(out)), rng.random()
        if what < 0.4:
            out[i] = rng.choice("abcxyz ")
        elif what < 0.7:
            out.insert(i, rng.choice("abcxyz "))
        else:
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_edited_passages_against_plain_alignment(seed):
    rng = random.Random(seed)
    index = d.index(ITEMS)
    words = "the of farmer country many city seventeen run great lies what how lakes sheep".split()
    noise = lambda: " ".join(rng.choices(words, k=25))
    text = f"{noise()} {changed(rng, rng.choice(ITEMS[:2])[1], rng.choice([0, .03, .08, .1, .12, .2]))} {noise()}"
    got = {(int(index.ids[i]), e) for _, i, e, _ in d.leaks_in(index, [noise(), text]) if _ is not None}
    want = set()
    for item, passage in ITEMS:
        if item in (1, 2, 5):
            e = edits(d.normal(passage), d.normal(text))
            if e <= int(len(d.normal(passage)) * d.ERRORS):
                want.add((item, e))
    assert got == want


def test_texts_do_not_run_into_each_other():
    index = d.index(ITEMS)
    half = len(ITEMS[0][1]) // 2
    assert d.leaks_in(index, [ITEMS[0][1][:half], ITEMS[0][1][half:]]) == []


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")


def test_find_and_drop(documents, benchmark):
    leak = f"before  {ITEMS[0][1].upper()}\n after"
    docs = documents([*TEXTS, (20, leak), (20, leak), (21, "x " * 50_000 + ITEMS[1][1])])
    rows = [(r["doc_id"], r["item_id"], r["edits"]) for r in d.find_leaks(docs, benchmark).collect()]
    assert sorted(rows) == [(20, 1, 0), (20, 1, 0), (21, 2, 0), (21, 5, 0)]
    kept = d.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in TEXTS)


def test_benchmark_in_many_blocks(documents, benchmark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 100)
    docs = documents([(20, f"a {ITEMS[0][1]} b {ITEMS[1][1]}")])
    rows = [(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, benchmark).collect()]
    assert sorted(rows) == [(20, 1), (20, 2), (20, 5)]
    assert d.drop_leaks(docs, benchmark).count() == 0


def test_empty_tables(documents, benchmark):
    none = benchmark.filter("false")
    found = d.find_leaks(documents(TEXTS), none)
    assert found.columns == ["doc_id", "item_id", "edits", "end_char"] and found.collect() == []
    assert d.find_leaks(documents([]), benchmark).collect() == []
    assert d.drop_leaks(documents(TEXTS), none).count() == len(TEXTS)
