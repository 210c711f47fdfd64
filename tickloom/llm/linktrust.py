"""URL filter: path rules first, then trust and distrust carried over the host link graph.

Only DataFrame functions. A url that a rule fits takes the rule's verdict. The other urls take
the verdict of their host: the pages that rules allow are seeds of trust, those that rules
block are seeds of distrust. Trust follows the links (personalised PageRank), distrust goes
against them, to hosts that link to what is blocked. A host is blocked where distrust has more
than ``threshold`` of its trust and distrust together; a host that neither reached is allowed.

Links are the ``href`` values of the html. A link without a host stays on its page's host, one
with another scheme (``mailto:``) is none, and every page counts as one link to its own host,
so each host passes on all it has. Links between two hosts are one row with a count.

The graph and the masses are tables of hosts, never collected; a round is one join on the
sending host and one sum at the receiver, and ends in the checkpoint folder. Rounds go on
until the masses move by less than ``TOLERANCE`` of all, ``rounds`` at most, which leaves
``damping ** rounds`` of the mass unsettled at worst.

Defined results: a null url, or one without ``://``, has host and path ``""`` and the verdict
allow; a null html has no links; null and repeated ids are rows of their own; other columns
are ignored. Of rules that fit, the longest text wins.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import durable, once

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 20, 1e-6, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>#][^"'\s>]*)"""
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``rule, verdict``; null if none does."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Host edges ``src, dst, n``: how many links of one host's pages go to the other."""
    link = F.col("_link")
    to = (
        F.when(link == "", F.col(host))
        .when(link.rlike(SCHEME + "//"), host_of(link))
        .when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link)))
        .when(~link.rlike(SCHEME), F.col(host))
    )
    found = F.coalesce(F.regexp_extract_all(html, F.lit(HREF), 1), F.array().cast("array<string>"))
    # the empty link is the page's own
    rows = pages.filter(F.col(host) != "").select(host, F.explode(F.array_append(found, F.lit(""))).alias("_link"))
    edges = rows.select(F.col(host).alias("src"), to.alias("dst"))
    return edges.filter(F.col("dst") != "").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _flows(edges: DataFrame) -> DataFrame:
    """``kind, host, to, share``: what part of a host's mass goes where."""
    sides = {"trust": ("src", "dst"), "distrust": ("dst", "src")}
    parts = []
    for kind, (giver, taker) in sides.items():
        whole = edges.groupBy(giver).agg(F.sum("n").alias("_all"))
        parts.append(edges.join(whole, giver).select(
            F.lit(kind).alias("kind"), F.col(giver).alias("host"), F.col(taker).alias("to"),
            (F.col("n") / F.col("_all")).alias("share"),
        ))
    return parts[0].unionByName(parts[1])


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``host, trust, distrust`` of every host of ``edges`` (``src, dst, n``).

    ``seeds``: ``host, trust, distrust``, one row a host.
    """
    flows = durable(_flows(edges))
    hosts = flows.select("kind", "host").unionByName(flows.select("kind", F.col("to").alias("host"))).distinct()
    given = seeds.select("host", F.explode(F.map_from_arrays(
        F.array(F.lit("trust"), F.lit("distrust")), F.array(F.col("trust").cast("double"), F.col("distrust").cast("double"))
    )).alias("kind", "seed"))
    nodes = hosts.join(given, ["kind", "host"], "left").withColumn("seed", F.coalesce("seed", F.lit(0.0)))
    state = durable(nodes.withColumn("mass", F.col("seed")))
    total = state.agg(F.sum("seed").alias("s")).first()["s"] or 0.0
    for _ in range(rounds if total else 0):
        came = flows.join(state.filter("mass > 0").select("kind", "host", "mass"), ["kind", "host"]).groupBy(
            "kind", F.col("to").alias("host")
        ).agg(F.sum(F.col("share") * F.col("mass")).alias("in"))
        mass = (1 - damping) * F.col("seed") + damping * F.coalesce("in", F.lit(0.0))
        state = durable(state.join(came, ["kind", "host"], "left").select(
            "kind", "host", "seed", mass.alias("mass"), F.abs(mass - F.col("mass")).alias("moved")
        ))
        if state.agg(F.sum("moved").alias("m")).first()["m"] <= tolerance * total:
            break
    return state.groupBy("host").agg(*[
        F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind) for kind in ("trust", "distrust")
    ])


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options: float,
) -> DataFrame:
    """One row per page: id, ``host, path, rule, verdict, trust, distrust``."""
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = once(read.select("id", "host", "path"), "_rule", rule_of(F.col("host"), F.col("path"), rules))
    by = {"trust": "allow", "distrust": "block"}
    seeds = judged.filter(F.col("_rule").isNotNull() & (F.col("host") != "")).groupBy("host").agg(*[
        F.count_if(F.col("_rule.verdict") == verdict).alias(name) for name, verdict in by.items()
    ])
    masses = propagate(links(read), seeds, **options)
    # sums of doubles differ in their last digits with the order of their rows
    bad = F.col("distrust") > (F.col("trust") + F.col("distrust")) * (threshold + 1e-9)
    hosts = masses.withColumn("_bad", bad)
    none = F.lit(0.0)
    return judged.join(hosts, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"),
    )


def check_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same for DuckDB, with all rounds and no early end."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    href = HREF.replace("'", "''")
    return f"""
WITH RECURSIVE rules(verdict, dom, pre) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS r, page_id, html, coalesce({host.format('url')}, '') AS host,
    coalesce(regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT r, arg_max(dom || pre, length(dom || pre)) AS rule, arg_max(verdict, length(dom || pre)) AS verdict
  FROM p JOIN rules ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre) GROUP BY r),
l AS (SELECT host, unnest(list_append(coalesce(regexp_extract_all(html, '{href}', 1), []), '')) AS link FROM p WHERE host <> ''),
t AS (SELECT host AS src, CASE WHEN link = '' THEN host WHEN regexp_matches(link, '{SCHEME}//') THEN {host.format('link')}
    WHEN starts_with(link, '//') THEN {host.format("('x:' || link)")}
    WHEN NOT regexp_matches(link, '{SCHEME}') THEN host END AS dst FROM l),
e AS (SELECT src, dst, count(*) AS n FROM t WHERE dst <> '' GROUP BY ALL),
flows AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst AS into_, n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
seeds AS MATERIALIZED (
  SELECT DISTINCT f.kind, f.host, coalesce(s.n, 0)::DOUBLE AS seed
  FROM (SELECT kind, host FROM flows UNION SELECT kind, into_ FROM flows) f LEFT JOIN (
    SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
    FROM p JOIN fits USING (r) GROUP BY ALL) s ON s.kind = f.kind AND s.host = f.host),
mass AS (
  SELECT 0 AS round, kind, host, seed, seed AS mass FROM seeds UNION ALL
  SELECT round + 1, kind, host, any_value(seed), {1 - DAMPING} * any_value(seed) + {DAMPING} * sum(come) FROM (
    SELECT m.round, m.kind, m.host, m.seed, 0.0::DOUBLE AS come FROM mass m WHERE m.round < {ROUNDS} UNION ALL
    SELECT m.round, f.kind, f.into_, s.seed, share * m.mass FROM mass m
    JOIN flows f ON f.kind = m.kind AND f.host = m.host
    JOIN seeds s ON s.kind = f.kind AND s.host = f.into_ WHERE m.round < {ROUNDS})
  GROUP BY round, kind, host),
hosts AS (SELECT host, sum(mass) FILTER (kind = 'trust') AS trust, sum(mass) FILTER (kind = 'distrust') AS distrust
  FROM mass WHERE round = {ROUNDS} GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(verdict,
  CASE WHEN distrust > (trust + distrust) * {THRESHOLD + 1e-9} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (r) LEFT JOIN hosts ON hosts.host = p.host
"""
