import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import TEXTS
from tests.llm.test_simhash import plain_components
from tickloom.llm import neardup, stages


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(sets):
    """Components of all pairs at 0.8 or more; equal sets are linked."""
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= neardup.LEAST * len(a | b) - 1e-12:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def planted(seed=5):
    """Texts with near copies around 0.8 on both sides, chains of them, and one large group."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for size in (30, 60, 120, 400):
        for edits in range(1, size // 25 + 2):
            for _ in range(4):
                base = rng.choices(words, k=size)
                other = list(base)
                for at in rng.sample(range(size), edits):
                    other[at] = rng.choice(words)
                rows += [base, other]
    chain = rng.choices(words, k=100)
    for _ in range(8):
        rows.append(list(chain))
        at = rng.randrange(90)
        chain = [*chain[:at], *rng.choices(words, k=5), *chain[at + 5:]]
    base = rng.choices(words, k=80)
    rows += [[*base[:40], f"x{k}", *base[40:]] for k in range(60)]
    return [(100 + i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_copies_against_all_pairs(documents, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rows = [*TEXTS, *planted()]
    groups = plain_groups([plain_set(t) for _, t in rows])
    best = {}
    for (i, _), g in zip(rows, groups):
        best.setdefault(g, []).append((i is None, i or 0))
    kept = stages.near_copies(documents(rows).sparkSession, documents(rows), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(min(v) for v in best.values())
    assert len(kept) < len(rows) - 100
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"] is stages.near_copies


def test_large_group_costs_its_size(documents, monkeypatch):
    base = [f"v{k}" for k in range(80)]
    docs = documents([(i, " ".join([*base[:40], f"x{i}", *base[40:]])) for i in range(120)])
    seen, check = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda p, s: (seen.append(p.distinct().count()), check(p, s))[1])
    assert neardup.representatives(docs, F.col("doc_id")).count() == 1
    assert sum(seen) < 120 * 32


def test_group_of_unlike_copies_costs_its_size(documents, monkeypatch):
    """Copies of one text with changes of their own share buckets and are not similar."""
    rng = random.Random(3)
    base, rows = [f"u{k}" for k in range(150)], []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), 5):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words)))
    seen, check = [], neardup._agreeing
    monkeypatch.setattr(neardup, "_agreeing", lambda p, s: (seen.append(p.distinct().count()), check(p, s))[1])
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    assert neardup.representatives(documents(rows), F.col("doc_id")).count() == 120
    assert sum(seen) < 120  # 7,140 pairs, some 4,800 of them in a bucket


def test_fingerprints_link_without_bands(documents, monkeypatch):
    """The first candidates are SimHash fingerprints at most three bits apart."""
    rows = [r for r in planted() if len(r[1].split()) >= 100]
    sets = neardup._signatures(documents(rows), F.col("doc_id"), "doc_id", "text").groupBy("node").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    found = {r["node"]: r for r in sets.collect()}
    texts = dict(rows)
    for r in found.values():
        hashes = [int(h) for h in neardup.shingles(texts[r["id"]].encode())]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r["fp"] % (1 << 64) == bits
    group = plain_components(sorted(found), [found[k]["fp"] % (1 << 64) for k in sorted(found)])
    want = {(group[i], node) for i, node in enumerate(sorted(found)) if group[i] != node}
    alike = lambda a, b: min(found[a]["n"], found[b]["n"]) >= 0.8 * max(found[a]["n"], found[b]["n"])
    got = {(r["a"], r["b"]) for r in neardup._fingerprint_pairs(sets).collect()}
    assert got == {p for p in want if alike(*p)} and len(got) > 5

    monkeypatch.setattr(neardup, "bands", lambda s: F.array(F.xxhash64(s)))  # no bucket holds two sets
    kept = neardup.representatives(documents(rows), F.col("doc_id")).count()
    assert kept < len(found) - 5
