import hashlib
import zlib

import pytest

from tests.llm.conftest import TEXTS
from tickloom.llm import sharding


def plain(rows, shards, split=sharding.SPLIT):
    """``shard`` of every row by one running sum; ties within a group are not told apart."""
    keyed = sorted(
        (hashlib.md5(t.encode()).hexdigest() if t is not None else "", len((t or "").encode()) + 1) for _, t in rows
    )
    total, groups = sum(s for _, s in keyed), {}
    for key, size in keyed:
        groups[key] = groups.get(key, 0) + size
    out, before, start = [], 0, {}
    for key, size in keyed:
        start.setdefault(key, before)
        large = groups[key] * shards * split > total
        out.append((before if large else start[key]) * shards // total)
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
@pytest.mark.parametrize("split", [1, 256])
def test_against_a_running_sum(documents, shards, split):
    rows = TEXTS + [(100 + i, f"text number {i % 23} " * (i % 7)) for i in range(200)]
    got = sharding.shard_by_bytes(documents(rows), shards, split=split).collect()
    assert sorted(r["shard"] for r in got) == sorted(plain(rows, shards, split))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        assert any(
            (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
            for t in texts[r["doc_id"]]
        )
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_sizes_are_near_equal_with_a_hot_text(documents):
    rows = [(i, "copy of one text" if i % 3 == 0 else f"another text {i:04d}") for i in range(3000)]
    sizes = {}
    for r in sharding.shard_by_bytes(documents(rows), 8).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    target = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - target) for s in sizes.values()) <= target / sharding.SPLIT + 20


def test_slots_follow_the_ids_within_a_text(documents):
    rows = [(i, f"text {i % 7}") for i in range(300)]
    got = sharding.shard_by_bytes(documents(rows), 2, split=1).collect()
    by_text = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by_text.setdefault(r["doc_id"] % 7, []).append(r["doc_id"])
    assert all(ids == sorted(ids) for ids in by_text.values())


def test_small_groups_stay_together(documents):
    rows = [(i, f"text {i % 1500}") for i in range(3000)]
    of = {}
    for r in sharding.shard_by_bytes(documents(rows), 4, split=20).collect():
        of.setdefault(r["doc_id"] % 1500, set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_empty_table(documents):
    assert sharding.shard_by_bytes(documents([])).collect() == []
