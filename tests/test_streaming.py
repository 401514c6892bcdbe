"""Stateful streams and durable sinks: equal to the batch answer, with late rows, reordered files, restarts and crashes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import sequences, sessions
from hushframe.streaming import commits, idle, versions
from hushframe.streaming.counts import counts, sessions as stream_sessions
from hushframe.streaming.span_index import SpanIndex

START = dt.datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def put(spark, folder, rows, schema):
    """One file more of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    folder.mkdir(exist_ok=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, out, checkpoint, mode="append"):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_idle_timers(spark, tmp_path):
    """Reordered rows in several files, a restart halfway, a third of the rows of one key; state is gone once stretches have closed."""
    schema, gap = "k int, ts timestamp", 600
    rng = random.Random(1)
    rows = sorted((rng.randrange(40_000), 0 if i % 3 == 0 else rng.randrange(1, 6)) for i in range(240))
    files = [rows[i : i + 60] for i in range(0, 240, 60)]
    late = [(3, t) for t, _ in files[0][-3:]]  # of the first file's time, within the watermark's delay
    files[1] += [(t + 1, k) for k, t in late]
    for part in files:
        rng.shuffle(part)
    events = idle.idle_since(stream(spark, tmp_path / "in", schema), "k", "ts", gap * 1000, late="4 hours")
    for n, part in enumerate(files):
        put(spark, tmp_path / "in", [(k, at(t)) for t, k in part], schema)
        if n == 1:
            run(events, tmp_path / "out", tmp_path / "ck")  # stops here; the rest begins from the checkpoint
    for later in (200_000, 200_001, 400_000, 400_001):
        put(spark, tmp_path / "in", [(-1, at(later))], schema)
    q = run(events, tmp_path / "out", tmp_path / "ck")
    every = spark.read.schema(schema).parquet(str(tmp_path / "in")).where("k >= 0")
    want = sessions.idle_periods(every.withColumn("ms", F.unix_millis("ts")), "k", "ms", gap * 1000)
    found = spark.read.parquet(str(tmp_path / "out")).where("k >= 0")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 20
    held = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "ck")).selectExpr("key.*").distinct().collect()
    assert [r[0] for r in held] == [-1] and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_results_by_version(spark, tmp_path):
    """Results before their requests, of another version, too late or never asked for; two files a side."""
    asked, done = "key int, request_id int, version int, asked_at timestamp", "key int, request_id int, version int, done_at timestamp, found string"
    requests = [(i % 4, i, i % 3, at(i * 20)) for i in range(60)]
    results = [(i % 4, i, i % 3 if i % 5 else 9, at(i * 20 + (i * 37) % 900), "x") for i in range(0, 70)] + [(None, 3, 1, at(70), "n")]
    end = [(0, -1, 0, at(90_000))], [(0, -2, 0, at(90_000), "end")]
    for part in (requests[30:], requests[:30], end[0], [(0, -3, 0, at(90_001))]):
        put(spark, tmp_path / "asked", part, asked)
    for part in (results[:40], results[40:], end[1], [(0, -4, 0, at(90_001), "end")]):
        put(spark, tmp_path / "done", part, done)
    judged = versions.judged(stream(spark, tmp_path / "asked", asked), stream(spark, tmp_path / "done", done), late="1 hour")
    run(judged, tmp_path / "out", tmp_path / "ck")
    want = {}
    for i in range(70):
        delay = (i * 37) % 900
        want[i] = "late" if i >= 60 or delay > 600 else "stale" if i % 5 == 0 else "accepted"
    found = spark.read.parquet(str(tmp_path / "out")).where("found <> 'end'")
    assert sorted((r["request_id"], r["verdict"]) for r in found.where("key is not null").collect()) == sorted(want.items())
    assert [r["verdict"] for r in found.where("key is null").collect()] == ["late"]
    tables = versions.judged(spark.read.schema(asked).parquet(str(tmp_path / "asked")), spark.read.schema(done).parquet(str(tmp_path / "done")))
    same = lambda d: sorted(repr(tuple(r)) for r in d.where("found <> 'end'").select("key", "request_id", "version", "asked_version", "verdict").collect())
    assert same(found) == same(tables)
    totals = {r["verdict"]: r["n"] for r in versions.verdict_counts(tables.where("found <> 'end'"), "10 days").collect()}
    assert totals["stale"] == sum(v == "stale" for v in want.values()) and sum(totals.values()) == 71


def test_counts_and_sessions_as_streams(spark, tmp_path):
    schema = "user_id int, event_type string, ts timestamp"
    rows = [(i % 3, "ab"[i % 2], at((i * 7919) % 30_000)) for i in range(90)]
    for part in (rows[:50], rows[50:], [(9, "z", at(500_000))], [(9, "z", at(500_001))]):
        put(spark, tmp_path / "in", part, schema)
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    for make, name in ((lambda d: counts(d, late="1 day"), "counts"), (lambda d: stream_sessions(d, "user_id", late="1 day"), "sessions")):
        run(make(stream(spark, tmp_path / "in", schema)), tmp_path / name, tmp_path / f"ck-{name}")
        early = F.col("start") < F.lit(at(400_000))
        rows_of = lambda d: sorted(map(tuple, d.where(early).collect()))  # noqa: E731, B023
        assert rows_of(spark.read.parquet(str(tmp_path / name))) == rows_of(make(whole))


SPANS = "key int, lo int, hi int"


def some_spans(rng, n):
    return [(0 if i % 3 == 0 else rng.randrange(40), lo := rng.randrange(500), lo + rng.randrange(9)) for i in range(n)]


def test_span_index(spark, tmp_path):
    """Batches merge to the union of all; one that comes again, after a crash or not, changes nothing; others' buckets stay."""
    rng = random.Random(3)
    batches = [some_spans(rng, 80), some_spans(rng, 50), [(7, 0, 5), (7, 5, 6), (None, 1, 2), (7, None, 3)], [(3, 4, 4)], []]
    frame = lambda rows: spark.createDataFrame(rows, SPANS)
    index = SpanIndex(spark, str(tmp_path / "index"), "int", buckets=8)
    assert index.read().count() == 0
    for n, rows in enumerate(batches):
        if n == 2:
            kept = dict(index.commits.last()["folders"])
            crash = index.commits.commit
            index.commits.commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost the driver"))
            with pytest.raises(RuntimeError, match="lost"):
                index.merge(frame(rows), n)
            index.commits.commit = crash
            assert index.commits.last()["folders"] == kept
        index.merge(frame(rows), n)
        index.merge(frame([(1, -100, 900)]), n)  # the same batch again, whatever it holds
        if n == 2:
            assert sum(index.commits.last()["folders"][b] != kept[b] for b in kept) == 1
    again = SpanIndex(spark, str(tmp_path / "index"), "int", buckets=8)
    every = [r for rows in batches for r in rows if None not in r and r[2] > r[1]]
    want = sequences.interval_union(frame(every), "key", "lo", "hi")
    assert sorted(map(tuple, again.read().collect())) == sorted(map(tuple, want.collect()))
    again.merge(frame([(1, -5, -4)]), 2)
    assert again.read().where("lo = -5").count() == 0
    left = again.missing(frame([(7, 0, 600), (999, 1, 2)]))
    covered = {x for k, lo, hi in every if k == 7 for x in range(lo, hi)}
    assert {(r["key"], x) for r in left.collect() for x in range(r["lo"], r["hi"])} == {(7, x) for x in range(600) if x not in covered} | {(999, 1)}


def test_span_index_fed_by_a_stream(spark, tmp_path):
    rng = random.Random(4)
    parts = [some_spans(rng, 40) for _ in range(3)]
    index = SpanIndex(spark, str(tmp_path / "index"), "int", buckets=4)
    for n, part in enumerate(parts):
        put(spark, tmp_path / "in", part, SPANS)
        if n:
            q = stream(spark, tmp_path / "in", SPANS).writeStream.foreachBatch(index.merge).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    want = sequences.interval_union(spark.createDataFrame([r for p in parts for r in p if r[2] > r[1]], SPANS), "key", "lo", "hi")
    assert sorted(map(tuple, index.read().collect())) == sorted(map(tuple, want.collect()))


def test_changed_snapshots_outlive_a_crash(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string")
    sink, written = commits.ChangedSnapshots(spark, str(tmp_path / "s")), []
    write = sink.write
    sink.write = lambda batch, folder: (written.append(folder.rsplit("/", 1)[1]), write(batch, folder))
    assert sink.read() is None
    sink(frame([(1, "a"), (2, None)]), 0)
    sink(frame([(2, None), (1, "a")]), 1)  # the same rows in another order
    assert written == ["batch-0"] and sink.read().count() == 2
    commit = sink.commits.commit
    sink.commits.commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost the driver"))
    with pytest.raises(RuntimeError, match="lost"):
        sink(frame([(3, "c")]), 2)
    assert sink.read().count() == 2  # not committed: the old one holds
    sink.commits.commit = commit
    again = commits.ChangedSnapshots(spark, str(tmp_path / "s"))
    again(frame([(3, "c")]), 2)
    again(frame([(4, "d")]), 2)  # the same batch once more
    assert [tuple(r) for r in again.read().collect()] == [(3, "c")]
    again(frame([(1, "a"), (1, "a")]), 3)
    again(frame([(1, "a")]), 4)
    assert again.read().count() == 1 and again.commits.batches() == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError, match="committed already"):
        again.commits.commit(4, {})
