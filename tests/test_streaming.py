import time

from tests.conftest import EVENT
from tests.fold import fold
from tests.test_series import CASES, rounded
from tickloom.operators import series
from tickloom.streaming import jobs, processor


def stream_of(spark, rows, folder, files=4):
    """The rows as a file stream of several micro-batches, in time order."""
    rows = sorted(rows, key=lambda r: (r[5], r[6]))
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step:(i + 1) * step], EVENT).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    p, rows = CASES["small ring"]
    stream = stream_of(spark, rows, str(tmp_path / "in"))
    derived = processor.derive_stream(stream, p)
    jobs.run_to_end(derived, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(derived.schema).parquet(str(tmp_path / "out"))
    ticks, snaps, alerts = fold(rows, p)
    assert rounded(processor.ticks_of(got)) == ticks
    assert rounded(processor.ticks_of(got, "snapshot")) == snaps
    assert sorted(tuple(r) for r in processor.surges_of(got).collect()) == alerts


def test_stream_starts_from_snapshots_and_resumes(spark, tmp_path, make_events):
    start = series.restore_state(series.throttled_snapshots(make_events([(0, 0.40), (2, 0.42)])))
    folder = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(EVENT).parquet(folder)
        derived = processor.derive_stream(stream, initial=start)
        jobs.run_to_end(derived, str(tmp_path / "out"), str(tmp_path / "cp"))
        rows = processor.ticks_of(spark.read.schema(derived.schema).parquet(str(tmp_path / "out")))
        return [(r.p, r.seq) for r in rows.orderBy("seq").collect()]

    make_events([(10, 0.42), (11, 0.43)]).coalesce(1).write.parquet(folder)
    assert run() == [(0.43, 3)]
    make_events([(12, 0.43), (13, 0.44)]).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [(0.43, 3), (0.44, 4)]


def test_latest_table_over_batches(spark, tmp_path):
    _, rows = CASES["dense"]
    stream = stream_of(spark, rows, str(tmp_path / "in"), 3).select("asset_id", "recv_ts", "ord")
    jobs.latest_table(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ("asset_id",), ("recv_ts", "ord"), once=True).awaitTermination()
    got = {r.asset_id: (r.recv_ts, r.ord) for r in jobs.read_latest(spark, str(tmp_path / "t"), ("asset_id",), ("recv_ts", "ord")).collect()}
    want = {}
    for r in rows:
        want[r[0]] = max(want.get(r[0], (0, 0)), (r[5], r[6]))
    assert got == want


def test_late_events_are_an_output(spark, tmp_path):
    """Applied and late events together are the input; late ones change nothing."""
    p, rows = CASES["small ring"]
    rows = sorted(rows, key=lambda r: (r[5], r[6]))
    half = len(rows) // 2
    newest = max(r[5] for r in rows[:half])
    late = [(a, "late", 9.0, 1.0, 1.0, t, 10_000 + i) for i, (a, t) in enumerate(
        [("a", newest - 90_000), ("b", newest - 80_000), ("a", newest - 70_000), ("zz", newest - 90_000)])]
    folder = str(tmp_path / "in")
    for part in (rows[:half], late, rows[half:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    derived = processor.derive_stream(stream, p, late_ms=30_000)
    jobs.run_to_end(derived, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(derived.schema).parquet(str(tmp_path / "out"))
    found = sorted((r.asset_id, r.n, r.ord, r.price, r.market_id) for r in processor.late_of(got).collect())
    # an asset without earlier events has nothing to be late against
    assert found == [("a", 1, 10_000, 9.0, "late"), ("a", 2, 10_002, 9.0, "late"), ("b", 1, 10_001, 9.0, "late")]
    ticks, snaps, _ = fold([*rows, late[3]], p)
    assert rounded(processor.ticks_of(got)) == ticks
    assert rounded(processor.ticks_of(got, "snapshot")) == snaps


def test_new_stream_goes_on_from_a_checkpoint(spark, tmp_path):
    """A second job, with its own checkpoint, starts from the state the first one left."""
    p, rows = CASES["small ring"]
    rows = sorted(rows, key=lambda r: (r[5], r[6]))
    half, start, parts = len(rows) // 2, None, []
    for n, part in enumerate((rows[:half], rows[half:])):
        folder, out, checkpoint = (str(tmp_path / f"{name}{n}") for name in ("in", "out", "cp"))
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(folder)
        derived = processor.derive_stream(spark.readStream.schema(EVENT).parquet(folder), p, initial=start)
        jobs.run_to_end(derived, out, checkpoint)
        parts.append(spark.read.schema(derived.schema).parquet(out))
        start = processor.state_of(spark, checkpoint)
    got = parts[0].unionByName(parts[1])
    ticks, snaps, alerts = fold(rows, p)
    assert rounded(processor.ticks_of(got)) == ticks
    assert rounded(processor.ticks_of(got, "snapshot")) == snaps
    assert sorted(tuple(r) for r in processor.surges_of(got).collect()) == alerts
