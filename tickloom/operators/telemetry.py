"""Counts, rates, latency and lag figures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.axis import Axis, running, slice_expr
from tickloom.operators.ranks import global_rank, nearest_rank_percentile

# Default upper bounds of a latency histogram, seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def count_by_kind(events: DataFrame, kind: str = "kind") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def pipeline_counters(streams: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Records and bytes per stream: name -> (rows, text column or None)."""
    parts = [
        df.select(
            F.lit(name).alias("topic"),
            (F.octet_length(text) if text else F.lit(0)).cast("bigint").alias("_b"),
        )
        for name, (df, text) in streams.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("records"), F.sum("_b").alias("bytes"))


def valid_latency(df: DataFrame, now: str = "now", rts: str = "rts") -> DataFrame:
    """Rows with a usable latency, in column ``latency_ms``."""
    latency = (F.col(now) - F.col(rts)).cast("double")
    return df.filter((F.col(rts) > 0) & (latency >= 0)).withColumn("latency_ms", latency)


def recent_percentile(
    df: DataFrame, value: str, order: tuple[str, ...], p: float = 0.99, last: int = 4096
) -> DataFrame:
    """Nearest-rank percentile of the ``last`` newest rows; 0 without rows.

    The rows are a bounded top-n (merged per task); their sorted array is small.
    """
    newest = df.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    values = F.sort_array(F.collect_list(value))
    picked = newest.agg(values.alias("_v")).withColumn("n", F.size("_v"))
    rank = F.least(F.floor(F.col("n") * F.lit(p)) + 1, F.col("n")).cast("int")
    return picked.select(
        "n", F.coalesce(F.when(F.col("n") > 0, F.get("_v", rank - 1)), F.lit(0.0)).alias("value")
    )


def latency_histogram(
    df: DataFrame, value: str, by: tuple[str, ...] = (), bounds: tuple[float, ...] = BUCKETS
) -> DataFrame:
    """Cumulative buckets ``le`` with the group's ``sum`` and ``count``; one aggregation."""
    x = F.col(value)
    cumulative = [F.count_if(x <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    sums = df.groupBy(*by).agg(*cumulative, F.count(x).alias("count"), F.sum(x).alias("sum"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return sums.select(*by, "count", "sum", F.explode(F.array(*pairs)).alias("_p")).select(
        *by, "_p.le", "_p.n", "count", "sum"
    )


def rate_per_window(df: DataFrame, ts: str, window_ms: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per second in tumbling windows; ``start`` in epoch milliseconds."""
    start = (slice_expr(ts, window_ms) * F.lit(window_ms)).alias("start")
    return df.groupBy(*by, start).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "rate", F.col("n") * 1000.0 / window_ms
    )


def counter_rates(
    df: DataFrame, counter: str, ts: str, key: tuple[str, ...] = (), width: int = 900_000
) -> DataFrame:
    """Per-second increase of a sampled counter since the sample before."""
    rows = running(
        df, Axis(key, (ts,), width),
        before={"_p": F.struct(F.col(counter).alias("c"), F.col(ts).alias("t"))},
    )
    seconds = (F.col(ts) - F.col("_p.t")) / 1000.0
    return rows.withColumn(
        "rate", F.when(seconds > 0, (F.col(counter) - F.col("_p.c")) / seconds)
    ).drop("_p")


def sys_stats(
    inputs: DataFrame, outputs: DataFrame, sessions: DataFrame, *, window_ms: int = 1_000,
    p: float = 0.99, last: int = 4096, order: tuple[str, ...] = ("ts", "latency_ms"),
) -> DataFrame:
    """One row per window: live clients, records in and messages out per second, p99.

    ``inputs`` has ``ts, latency_ms`` (and what ``order`` names); ``outputs`` has ``ts``;
    ``sessions`` has ``client_id, start, end`` (``end`` null while connected). Clients are
    counted at the end of the window; the percentile covers the ``last`` newest samples
    at the end of the window, those of earlier windows included, and is 0 before the first.
    """
    window = (slice_expr("ts", window_ms) * F.lit(window_ms)).alias("start")
    timed = inputs.select(window, "latency_ms")
    came = timed.groupBy("start").agg((F.count(F.lit(1)) * 1000.0 / window_ms).alias("in_eps"))
    went = outputs.select(window).groupBy("start").agg(
        (F.count(F.lit(1)) * 1000.0 / window_ms).alias("out_mps")
    )
    slow = _trailing_percentile(inputs.filter(F.col("latency_ms") >= 0), window, p, last, order)
    # +1 at connect, -1 at disconnect, summed per window and accumulated.
    def at(c: str) -> Column:
        return slice_expr(c, window_ms) * F.lit(window_ms)

    steps = sessions.select(at("start").alias("start"), F.lit(1).alias("d")).unionByName(
        sessions.filter("end is not null").select(at("end").alias("start"), F.lit(-1).alias("d"))
    ).groupBy("start").agg(F.sum("d").alias("d"))
    grid = came.join(went, "start", "full").join(slow, "start", "left").join(steps, "start", "full")
    rows = running(
        grid, Axis((), ("start",), window_ms * 3_600), sums={"clients": F.coalesce("d", F.lit(0))},
        lasts={"_p99": F.col("p99_ms")},
    ).withColumn("p99_ms", F.col("_p99"))
    return rows.filter(F.col("in_eps").isNotNull() | F.col("out_mps").isNotNull()).select(
        "start", "clients", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("in_eps", "out_mps", "p99_ms")]
    )


def _trailing_percentile(
    samples: DataFrame, window: Column, p: float, last: int, order: tuple[str, ...]
) -> DataFrame:
    """``start, p99_ms``: percentile of the ``last`` newest samples at the end of each window
    that has samples.

    Samples are numbered and gathered in blocks of ``last``; what a window needs lies in
    the block of its newest sample and the one before.
    """
    numbered = global_rank(samples.withColumn("start", window), order, "_rank").select(
        "start", "latency_ms", (F.col("_rank") - 1).alias("_n")
    )
    block = F.floor(F.col("_n") / last)
    blocks = numbered.groupBy(block.alias("_b")).agg(
        F.collect_list(F.struct("_n", "latency_ms")).alias("_v")  # at most `last` entries
    )
    ends = numbered.groupBy("start").agg(F.max("_n").alias("_end")).withColumn("_b", F.floor(F.col("_end") / last))
    newest = ends.join(blocks, "_b", "left")
    older = blocks.select((F.col("_b") + 1).alias("_b"), F.col("_v").alias("_w"))
    both = newest.join(older, "_b", "left").withColumn(
        "_all", F.concat("_v", F.coalesce("_w", F.slice("_v", 1, 0)))
    )
    kept = F.filter("_all", lambda s: (s["_n"] <= F.col("_end")) & (s["_n"] > F.col("_end") - last))
    values = F.array_sort(F.transform(kept, lambda s: s["latency_ms"]))
    size = F.size("_sorted")
    at = F.least(F.floor(size * F.lit(p)) + 1, size).cast("int")
    return both.withColumn("_sorted", values).select("start", F.element_at("_sorted", at).alias("p99_ms"))


def client_report(connections: DataFrame, latencies: DataFrame, duration_s: float) -> DataFrame:
    """Load figures of one run.

    ``connections``: ``client_id, connected, slow, msgs``. ``latencies``:
    ``client_id, latency_ms`` of the connections. Slow ones count as established but
    their messages and latencies are left out.
    """
    normal = ~F.col("slow")
    totals = connections.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("connected").alias("established"),
        F.count_if(~F.col("connected")).alias("failed"), F.count_if("slow").alias("slow"),
        F.coalesce(F.sum(F.when(normal, F.col("msgs"))), F.lit(0)).alias("messages"),
    )
    fast = connections.filter(normal).select("client_id")
    kept = latencies.join(fast, "client_id", "left_semi")
    pct = nearest_rank_percentile(kept, "latency_ms", (0.5, 0.99)).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50_ms"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99_ms"),
        F.max("n").alias("samples"),
    )
    one = F.lit(1).alias("_one")
    joined = totals.select("*", one).join(F.broadcast(pct.select("*", one)), "_one").drop("_one")
    zero = F.lit(0.0)
    return joined.select(
        "attempted", "established",
        F.when(F.col("attempted") > 0, F.col("established") * 100.0 / F.col("attempted")).alias("established_pct"),
        "failed", "slow", (F.col("established") - F.col("slow")).alias("normal"), "messages",
        F.coalesce("samples", F.lit(0)).alias("samples"),
        (F.col("messages") / F.lit(float(duration_s))).alias("msgs_per_s"),
        F.coalesce("p50_ms", zero).alias("p50_ms"), F.coalesce("p99_ms", zero).alias("p99_ms"),
    )


def partition_lag(polls: DataFrame, width: int = 100_000) -> DataFrame:
    """Total backlog after each poll: the last known lag of every partition, summed.

    ``polls``: ``poll, partition, hwm, last_offset``. Each poll contributes the
    change of its partitions' lag; the total is the running sum of the changes.
    """
    lag = polls.withColumn("_lag", F.col("hwm") - (F.col("last_offset") + 1))
    steps = running(lag, Axis(("partition",), ("poll",), width), before={"_old": F.col("_lag")})
    per_poll = steps.groupBy("poll").agg(
        F.sum(F.col("_lag") - F.coalesce("_old", F.lit(0))).alias("_d")
    )
    return running(per_poll, Axis((), ("poll",), width), sums={"lag": F.col("_d")}).select("poll", "lag")
