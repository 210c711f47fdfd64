"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The base spans are what four patterns find, leftmost and without overlap, less those
that fail their test (address parts, Luhn sum, number of digits). All of them stay.

The field labels the tokens that hold a digit or an at sign. Its potentials are features
of a token, pairs of neighbouring tokens, and skip links between distant tokens of a
document that repeat each other: the same letters and digits, the same last seven digits,
or the same name before an at sign. Each token is linked to the one before with the same
mark, so links grow with the tokens. Tokens in base spans are observed. Loopy message
passing over all documents of a batch gives every token's label; a token outside the
base spans becomes part of a span if its label is nearly certain and skip links of that
label lead to a base span. So ``555-7814`` is a phone number in a document that also has
``+1 (606) 555-7814``, and nothing is added to documents without personal data.

The weights are fitted by pseudo-likelihood on the tokens of at most ``SAMPLE`` texts, labelled
by the base spans; what decides the base (plus sign, Luhn sum) is no feature.

Defined results: a null or empty text has no spans; texts of any length are searched
whole, in time linear in their length; repeated rows are treated alike; without any
training token only the base is found; an empty table gives no rows. ``find`` ignores other
columns, ``redact`` keeps them.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import in_share, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Documents the weights are fitted on, and steps and penalty of the fit.
SAMPLE, STEPS, PENALTY = 1000, 200, 1e-3
#: Rounds of messages, probability above which a label is taken, weight of an observed label.
ROUNDS, CERTAIN, OBSERVED = 12, 0.8, 30.0
SLICE = 4_000_000

# The base patterns. Those that could start anywhere in a run are tied to
# its beginning, which changes no match and keeps the search linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = ".,;:!?\"'()[]{}<>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            last = got.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind and then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Tokens:
    """Tokens of several texts that hold a digit or an at sign."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    observed: np.ndarray  # label of the base span a token is in, else 0
    near: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs linked over a distance


def _features(token: str, before: str, after: str) -> list[float]:
    digits = len(_NOT_DIGIT.sub("", token))
    letters = any(ch.isalpha() for ch in token)
    size = [0, 1, 4, 7, 10, 13, 20]
    bucket = max(i for i, s in enumerate(size) if digits >= s)
    return [
        1.0, *[float(bucket == i) for i in range(len(size))], float("@" in token), float(letters),
        float(token.count(".") == 3), float("." in token), float("-" in token), float("(" in token or ")" in token),
        float(digits == len(token)), float("=" in token or '"' in token), float(len(token) > 24),
        float(bool(_DIGIT.search(before))), float(bool(_DIGIT.search(after))),
    ]


N_FEATURES = len(_features("", "", ""))


def _marks(token: str) -> set[str]:
    digits = _NOT_DIGIT.sub("", token)
    plain = "".join(ch for ch in token.lower() if ch.isalnum())
    marks = {f"t{plain}"} if len(plain) >= 6 else set()
    if len(digits) >= 7 and not any(ch.isalpha() for ch in token):
        marks.add(f"d{digits[-7:]}")
    if "@" in token:
        name = token.split("@")[0].strip(_EDGE).lower()
        if len(name) >= 5:
            marks.add(f"n{name}")
    return marks


def tokens_of(texts: list[str], bases: list[list[Span]]) -> Tokens:
    doc, start, end, feats, seen, near, skip = [], [], [], [], [], [], []
    for d, (text, spans) in enumerate(zip(texts, bases)):
        if "@" not in text and not _DIGIT.search(text):
            continue
        spans = sorted((s, e, LABELS.index(kind)) for kind, s, e in spans)
        previous, where, behind = "", None, -1
        latest: dict[str, int] = {}
        words = list(_TOKEN.finditer(text))
        k = 0
        for w, m in enumerate(words):
            token = m[0]
            if "@" in token or _DIGIT.search(token):
                i = len(doc)
                s, e = m.span()
                core = token.strip(_EDGE)
                lead = token.find(core) if core else 0
                while k < len(spans) and spans[k][1] <= s:
                    k += 1
                label = spans[k][2] if k < len(spans) and spans[k][0] < e else 0
                after = words[w + 1][0] if w + 1 < len(words) else ""
                doc.append(d)
                start.append(s + lead)
                end.append(s + lead + len(core))
                feats.append(_features(token, previous, after))
                seen.append(label)
                if where == w - 1:
                    near.append((behind, i))
                marks = _marks(core)
                # a number in several tokens is also known as a whole
                if label and spans[k][0] < s:
                    marks |= _marks(text[spans[k][0]:spans[k][1]])
                elif where == w - 1 and not label:
                    marks |= _marks(text[start[behind]:end[i]])
                for mark in sorted(marks):
                    if mark in latest and latest[mark] != i:
                        skip.append((latest[mark], i))
                    latest[mark] = i
                where, behind = w, i
            previous = token
    pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
    return Tokens(
        np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64),
        np.array(feats, np.float64).reshape(-1, N_FEATURES), np.array(seen, np.int64), pairs(near), pairs(skip),
    )


@dataclass
class Weights:
    token: np.ndarray  # features x labels
    near: np.ndarray  # label x label
    skip: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(tokens: Tokens) -> Weights:
    """Weights by pseudo-likelihood: each label given the labels around it."""
    n, k = len(tokens.doc), len(LABELS)
    gold = np.eye(k)[tokens.observed]
    left, right, linked = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    np.add.at(left, tokens.near[:, 1], gold[tokens.near[:, 0]])
    np.add.at(right, tokens.near[:, 0], gold[tokens.near[:, 1]])
    np.add.at(linked, tokens.skip[:, 1], gold[tokens.skip[:, 0]])
    np.add.at(linked, tokens.skip[:, 0], gold[tokens.skip[:, 1]])
    w = Weights(np.zeros((N_FEATURES, k)), np.zeros((k, k)), 1.0)
    rate = 1.0
    for _ in range(STEPS if n else 0):
        p = _softmax(tokens.features @ w.token + left @ w.near + right @ w.near.T + w.skip * linked)
        error = (gold - p) / n
        w.token += rate * (tokens.features.T @ error - PENALTY * w.token)
        w.near += rate * (left.T @ error + error.T @ right - PENALTY * w.near)
        w.skip += rate * float((linked * error).sum() - PENALTY * w.skip)
    w.skip = max(w.skip, 1.0)  # repeated tokens never repel each other
    return w


def beliefs(tokens: Tokens, w: Weights) -> np.ndarray:
    """Label probabilities by loopy message passing over all documents side by side."""
    n, k = len(tokens.doc), len(LABELS)
    node = tokens.features @ w.token
    known = tokens.observed > 0
    node[known, tokens.observed[known]] += OBSERVED
    same = w.skip * np.eye(k)
    # directed edges: from, to, and the potential as seen from the sender
    a = np.concatenate([tokens.near[:, 0], tokens.near[:, 1], tokens.skip[:, 0], tokens.skip[:, 1]])
    b = np.concatenate([tokens.near[:, 1], tokens.near[:, 0], tokens.skip[:, 1], tokens.skip[:, 0]])
    e, s = len(tokens.near), len(tokens.skip)
    back = np.concatenate([
        np.arange(e, 2 * e), np.arange(e), np.arange(2 * e + s, 2 * e + 2 * s), np.arange(2 * e, 2 * e + s)
    ])
    table = np.exp(np.stack([w.near, w.near.T, same]))
    which = np.concatenate([np.zeros(e, int), np.ones(e, int), np.full(2 * s, 2)])
    messages = np.zeros((len(a), k))
    for _ in range(ROUNDS if len(a) else 0):
        total = node.copy()
        np.add.at(total, b, messages)
        out = total[a] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, table[which]) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    total = node
    np.add.at(total, b, messages)
    return _softmax(total)


def spans_of(texts: list[str], w: Weights | None) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text by kind and start; the last field tells base spans."""
    bases = [base_spans(t) for t in texts]
    found = [[(*span, True) for span in spans] for spans in bases]
    tokens = tokens_of(texts, bases) if w is not None else None
    if tokens is not None and len(tokens.skip):
        p = beliefs(tokens, w)
        label = p.argmax(axis=1)
        label[tokens.observed > 0] = tokens.observed[tokens.observed > 0]
        free = (tokens.observed == 0) & (label > 0) & (p.max(axis=1) >= CERTAIN)
        # only what skip links of its own label, or a neighbour that has them, tie to the base
        anchored = tokens.observed > 0
        a, b = tokens.skip[:, 0], tokens.skip[:, 1]
        alike = label[a] == label[b]
        while True:
            more = anchored.copy()
            more[b[alike & anchored[a]]] = True
            more[a[alike & anchored[b]]] = True
            more &= free | anchored
            if (more == anchored).all():
                break
            anchored = more
        taken = free & anchored
        for x, y in tokens.near:
            if taken[y] and free[x] and label[x] == label[y]:
                taken[x] = True
        joined = {int(y): int(x) for x, y in tokens.near if taken[x] and taken[y] and label[x] == label[y]}
        begin: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i in np.flatnonzero(taken & (tokens.end > tokens.start)):
            i = int(i)
            first = begin[i] = begin.get(joined.get(i, -1), i)
            ends[first] = int(tokens.end[i])
        for i, end in ends.items():
            found[tokens.doc[i]].append((LABELS[label[i]], int(tokens.start[i]), end, False))
        for d in {int(tokens.doc[i]) for i in ends}:
            found[d].sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return found


# --- on Spark ------------------------------------------------------------------------


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Weights | None:
    """Weights from at most ``sample`` different texts with candidate tokens, chosen by hash."""
    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    share = min(1.0, 2.0 * sample / max(rows.count(), 1))
    few = rows.filter(in_share(F.xxhash64("text"), share)).distinct()
    taken = few.orderBy(F.xxhash64("text"), "text").limit(sample).collect()
    texts = [r["text"] for r in taken]
    return fit(tokens_of(texts, [base_spans(t) for t in texts])) if texts else None


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()),
]))
_ARROW_SPAN = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())
]))


def find(docs: DataFrame, weights: Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``spans`` (kind, start, end in code points, base), by kind and start."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            spans = spans_of(texts_of(batch, "text"), weights)
            named = [[dict(zip(("kind", "start", "end", "base"), s)) for s in one] for one in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(named, _ARROW_SPAN)], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def blanked(text: str, spans: list[tuple[str, int, int, Any]]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    out, at, last = [], 0, -1
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < last:
            last = max(last, end)
            at = last
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = last = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: Weights | None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; a null text stays null."""
    schema = docs.schema
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            texts = batch.column(where).to_pylist()
            spans = spans_of([t or "" for t in texts], weights)
            new = [blanked(t, s) if s else t for t, s in zip(texts, spans)]
            columns = list(batch.columns)
            columns[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
