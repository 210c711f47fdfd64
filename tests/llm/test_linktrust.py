import pytest
from pyspark.sql import functions as F

from tickloom.llm import linktrust


def pages(spark, rows):
    """Extra columns carry names the operator uses itself."""
    full = [(i, u, h, "x", "x", "x", 1, 1) for i, u, h in rows]
    return spark.createDataFrame(
        full, "page_id long, url string, html string, host string, path string, rule string, mass int, verdict int")


def test_urls_and_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?y=/z#q", None), (2, "https://example.org/en/1", ""), (3, "https://example.org/en/2", ""),
        (4, "https://x.com/fr/", ""), (5, "https://x.com/de/7#a", ""), (6, "https://x.com", ""), (7, None, None),
        (8, "no scheme", ""), (9, "http://org?x", ""), (10, "ftp://notorg/es/", ""), (None, "http://Ü.COM/fr/é", ""),
        (1, "http://A.Example.ORG/es/x?y=/z#q", None), (11, "", ""), (12, "a://b.com:80/de/", ""),
    ]
    got = {
        (r.page_id, r.host, r.path, r.rule, r.verdict)
        for r in linktrust.filter_urls(pages(spark, rows)).collect()
    }
    assert got == {
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"),
        (3, "example.org", "/en/2", "org/", "allow"), (4, "x.com", "/fr/", "com/fr/", "allow"),
        (5, "x.com", "/de/7", "com/de/", "block"), (6, "x.com", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "", "", None, "allow"), (9, "org", "", None, "allow"), (10, "notorg", "/es/", None, "allow"),
        (None, "Ü.com", "/fr/é", "com/fr/", "allow"), (11, "", "", None, "allow"), (12, "b.com:80", "/de/", None, "allow"),
    }
    assert linktrust.filter_urls(pages(spark, rows)).count() == len(rows)


def test_link_hosts(spark):
    html = (
        "<a href='http://B.net/x'>b</a> <A HREF=\"//c.net/y\"> <a href=/here> <a href='mailto:me@d.net'> <a href=#top>"
        " <a href='http://b.net'> <a href = 'https://B.net?q'>"
    )
    rows = pages(spark, [(1, "http://a.net/", html), (2, "http://a.net/2", None), (3, None, html)]).withColumn(
        "host", linktrust.host_of(F.col("url")))
    got = {(r.src, r.dst): r.n for r in linktrust.links(rows).collect()}
    assert got == {("a.net", "b.net"): 3, ("a.net", "c.net"): 1, ("a.net", "a.net"): 3}


def reference(edges, seeds, rounds, damping=0.85):
    hosts = sorted({h for e in edges for h in e[:2]})
    out = {}
    for name, (giver, taker) in {"trust": (0, 1), "distrust": (1, 0)}.items():
        given = {h: float(seeds.get(h, (0, 0))[name == "distrust"]) for h in hosts}
        mass, whole = dict(given), {}
        for e in edges:
            whole[e[giver]] = whole.get(e[giver], 0) + e[2]
        for _ in range(rounds):
            new = {h: (1 - damping) * given[h] for h in hosts}
            for e in edges:
                new[e[taker]] += damping * mass[e[giver]] * e[2] / whole[e[giver]]
            mass = new
        out[name] = mass
    return {h: (out["trust"][h], out["distrust"][h]) for h in hosts}


def test_masses_against_plain_rounds(spark):
    edges = [(f"h{i}", f"h{(i * 7 + 3) % 30}", i % 4 + 1) for i in range(30)] + [(f"h{i}", "h0", 2) for i in range(1, 30)]
    edges += [(f"h{i}", f"h{i}", 1) for i in range(30)]
    merged = {}
    for a, b, n in edges:
        merged[a, b] = merged.get((a, b), 0) + n
    edges = [(a, b, n) for (a, b), n in merged.items()]
    seeds = {"h1": (5, 0), "h2": (0, 4), "h9": (2, 2), "elsewhere": (1, 1)}
    got = linktrust.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust long, distrust long"),
        rounds=6, tolerance=0.0,
    ).collect()
    want = reference(edges, seeds, 6)
    assert {r.host for r in got} == set(want)
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx(want[r.host], abs=1e-9)


def test_verdicts_follow_links(spark):
    rows = [
        (1, "http://bad.com/de/1", ""), (2, "http://bad.com/de/2", ""), (3, "http://bad.com/x", ""),
        (4, "http://good.com/fr/1", "<a href='http://friend.net/'>"), (5, "http://friend.net/a", ""),
        (6, "http://farm.net/a", "<a href='http://bad.com/'><a href='http://bad.com/de/1'>"),
        (7, "http://alone.net/a", ""), (8, "http://farm.net/b", "<a href='http://alone.net/'>"),
    ] + [(10 + i, f"http://good.com/fr/{i}", "<a href='http://friend.net/'>") for i in range(6)]
    got = {r.page_id: r.verdict for r in linktrust.filter_urls(pages(spark, rows)).collect()}
    assert [got[i] for i in (3, 5, 6, 7, 8)] == ["block", "allow", "block", "allow", "block"]


def test_no_rows(spark):
    got = linktrust.filter_urls(pages(spark, []))
    assert got.count() == 0 and got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
