import random
import re

import pytest

from tests.llm.conftest import TEXTS
from tickloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = (
    "a", "@", ".", "1", "25", "255", "300", "4111111111111111", "+1", " ", "-", "(", "555-1234", ")", "a.b@c.de", "é",
    "٣", "1.2.3.4", "0",
)


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [
        ("card", *m.span()) for m in CARD.finditer(text)
        if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))
    ]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_runs_stay_linear():
    text = "a" * 300_000 + "1" * 300_000 + " " + "1 " * 100_000 + "@" * 1000 + "+((((" * 20_000
    assert pii.base_spans(text) == []


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(1)
    texts = []
    for _ in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        parts = [phone, f"x{rng.randint(10, 99)}.y@mail.example.com", f"{rng.randint(1, 99)}.2.3.{rng.randint(1, 99)}"]
        texts.append(f"call {rng.choice(parts)} or {rng.choice(parts)} by {rng.randint(1, 31)} on page {rng.randint(1, 9)}")
    return pii.fit(pii.tokens_of(texts, [pii.base_spans(t) for t in texts]))


def test_repeats_take_the_label_of_the_base(weights):
    text = "Call +1 (606) 555-7814 now. Later (606) 555-7814 is the same."
    spans = pii.spans_of([text], weights)[0]
    assert ("phone", 5, 22, True) in spans
    added = [s for s in spans if not s[3]]
    assert [s[0] for s in added] == ["phone"] and text[added[0][1]:added[0][2]].endswith("555-7814")


def test_nothing_is_added_without_a_base_span(weights):
    assert pii.spans_of(["ring 555-7814 or 555-7814, room 12, section 4.2.1"], weights) == [[]]


def test_loopy_messages_agree_with_enumeration(weights):
    import itertools

    import numpy as np

    text = "+1 (606) 555-7814 then 555-7814"
    tokens = pii.tokens_of([text], [pii.base_spans(text)])
    n, k = len(tokens.doc), len(pii.LABELS)
    node = tokens.features @ weights.token
    known = tokens.observed > 0
    node[known, tokens.observed[known]] += pii.OBSERVED
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        s = sum(node[i, y] for i, y in enumerate(labels))
        s += sum(weights.near[labels[a], labels[b]] for a, b in tokens.near)
        s += sum(weights.skip * (labels[a] == labels[b]) for a, b in tokens.skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(s - 100)
    exact = total / total.sum(axis=1, keepdims=True)
    assert (pii.beliefs(tokens, weights).argmax(axis=1) == exact.argmax(axis=1)).all()


def test_blanked_joins_overlaps():
    spans = [("card", 0, 4, True), ("phone", 2, 6, True), ("ip", 8, 9, True)]
    assert pii.blanked("abcdefghij", spans) == "[CARD]gh[IP]j"


def test_edge_rows(messy, documents):
    found = {(r["doc_id"] or 0): r["spans"] for r in pii.find(messy, pii.train(messy)).collect()}
    assert set(found) == {i or 0 for i, _ in TEXTS} and not any(found.values())
    clean = pii.redact(messy, None)
    assert clean.columns == messy.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, messy.collect()))
    assert pii.find(documents([]), None).collect() == [] and pii.train(documents([])) is None


def test_redact(documents):
    rows = pii.redact(documents([(1, "mail a.b@c.de now"), (2, None)]), None).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(1, "mail [EMAIL] now"), (2, None)]
