import hashlib
import random
import zlib

import pytest

from tickloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, rep string, key string, up int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", 1) for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            nodes.setdefault(tuple(full[c][:d]), []).append(c)
    kids = {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(nodes[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((
        cs[0], len(n), nodes[n[:-1]][0] if n else -1, len(cs), len(kids.get(n, [])), leaves[n], saved[n],
        hashlib.sha256(",".join(str(c) for c in cs if len(full[c]) == len(n)).encode()).hexdigest(),
    ) for n, cs in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


def random_turns(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c, t, rng.choice("ua"), rng.choice(words)) for t in range(rng.randrange(longest + 1))]
    return rows


@pytest.mark.parametrize("piece", [8, 64, 20_000])
def test_against_brute_force(spark, piece):
    rows = random_turns(1, 260, 9, ["", "a", "b", "ünï😀"])
    rows += [(300, t, "u", "a") for t in range(120)]  # a long chain
    rows += [(400 + i, 0, "u", f"t{i}") for i in range(120)]  # many children
    assert rows_of(prefixtrie.trie(table(spark, rows), piece=piece, width=7)) == brute(rows)


def test_messy_rows(spark):
    rows = [
        (1, None, "u", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", ""), (1, 1, "a", "x" * 200_000),
        (None, 0, "u", "nobody"), (7, 3, "u", "b"), (7, 3, "u", "a"), (-150, 0, "u", "neg"), (-150, 1, "u", "neg"),
        (305, 0, "u", "only"), (2, 5, "u", "z"), (2, -5, "u", "y"), (100, 0, "a", "base"), (103, 0, "u", "q"),
    ]
    assert rows_of(prefixtrie.trie(table(spark, rows), piece=8, width=2)) == brute(rows)


def test_conversations_without_turns(spark):
    # h of 305 and 306 exceeds their turns and 300 is absent
    rows = [(c, 0, "u", "t") for c in range(301, 340)]
    assert any(zlib.crc32(str(c).encode()) % 6 for c in range(301, 340))
    assert rows_of(prefixtrie.trie(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "t")]])
def test_no_conversation(spark, rows):
    got = prefixtrie.trie(table(spark, rows))
    assert got.count() == 0 and got.columns[0] == "conv_id"


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_decomposition(shape):
    n, rng = 500, random.Random(2)
    parents = [-1, *(i - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(i) for i in range(1, n))]
    parents[n // 2] = -1  # two tops
    values = [[rng.randrange(100) for _ in range(n)], [1] * n]
    want = [list(v) for v in values]
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            for w in want:
                w[parents[i]] += w[i]
    assert prefixtrie.decompose(parents, values) == want
