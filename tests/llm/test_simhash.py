import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tickloom.llm import simhash
from tickloom.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(ids, prints, most=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        named = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[i] = min(named, default=None)
    return out


def test_messy_rows_against_brute_force(messy):
    ids, prints = [i for i, _ in TEXTS], [plain_fingerprint(t) for _, t in TEXTS]
    want = plain_components(ids, prints)
    rows = simhash.near_duplicates(messy).collect()
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in rows)
    assert got == sorted((ids[i] or 0, format(prints[i], "016x"), want[i] or 0) for i in range(len(ids)))


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    for p in list(prints)[:150]:  # neighbours at distance 1 to 5, in both segments
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    got = {tuple(sorted((r["a"], r["b"]))) for r in links.collect()}
    mask = (1 << 64) - 1
    want = {
        tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i]
        if bin((a ^ b) & mask).count("1") <= 3
    }
    assert got == want


def test_components_of_chain_star_and_strays(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (60, 61), (61, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {60: 60, 61: 60}


def test_representatives_keep_one_row_of_each(messy):
    key = F.xxhash64("doc_id", "text")
    kept = {r["key"] for r in simhash.representatives(messy, key).collect()}
    rows = messy.select("doc_id", "text", key.alias("k")).collect()
    left = sorted({(r["doc_id"] or 0, r["text"] or "") for r in rows if r["k"] in kept})
    ids = {i for i, _ in left}
    assert {1, 3, 6, 7, 8, 0} == ids


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
