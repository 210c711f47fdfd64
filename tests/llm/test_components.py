import random

import pytest

from tickloom.llm import components as c


def plain_roots(links):
    root = {n: n for pair in links for n in pair}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    return root


@pytest.mark.parametrize("size", [30, 5_000])
def test_rounds_have_as_many_tasks_as_links_need(spark, monkeypatch, size):
    """With hundreds of shuffle partitions a round over few links is still a few tasks."""
    rng = random.Random(4)
    links = [(a, b) for a, b in ((rng.randrange(900), rng.randrange(900)) for _ in range(700)) if a != b]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)]
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tasks, hold = [], c.durable
    monkeypatch.setattr(c, "LINKS", size)
    monkeypatch.setattr(c, "durable", lambda df: (held := hold(df), tasks.append(held.rdd.getNumPartitions()))[0])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_roots(links)
    assert len(tasks) > 3 and max(tasks[1:]) <= 1 + len(links) // size < 61
