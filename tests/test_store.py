"""The bucketed log, keyed streaming states and the review store on top of them."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from foliospark.api import Engine
from foliospark.operators import review
from foliospark.sources.bucketlog import BucketLog, ConflictError
from foliospark.streaming import states

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v long")


def log_of(spark, tmp_path, **more):
    return BucketLog(spark, f"{tmp_path}/log", "k long, v long", "k", ("v",), buckets=8, **more)


def files_read(df):
    return {f.split("/log/")[1] for f in df.inputFiles()}


def test_lookup_reads_one_bucket(spark, tmp_path):
    log = log_of(spark, tmp_path)
    for i in range(3):
        log.append(rows(spark, [(k, i) for k in range(50)]))
    every, one = files_read(log.read()), files_read(log.lookup(7))
    assert sorted(map(tuple, log.lookup(7).collect())) == [(7, 0), (7, 1), (7, 2)]
    assert one < every and len(one) == 3 and log.lookup(1000).count() == 0
    assert len({p.split("/")[2] for p in one}) == 1 and one <= set(sum(log.version().files.values(), []))


def test_concurrent_appends_both_survive(spark, tmp_path):
    log = log_of(spark, tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: log_of(spark, tmp_path).append(rows(spark, [(i, i), (i + 100, i)])), range(6)))
    assert log.version().number == 6
    assert sorted(r.k for r in log.read().collect()) == sorted([*range(6), *range(100, 106)])


def test_compaction_changes_no_view_and_touches_full_buckets_only(spark, tmp_path):
    log = log_of(spark, tmp_path, max_runs=2)
    log.append(rows(spark, [(k, 0) for k in range(40)]))
    for i in range(1, 4):
        log.append(rows(spark, [(5, i)]))
    before, files = sorted(map(tuple, log.read().collect())), log.version().files
    log.compact()
    after = log.version()
    changed = {b for b in files if files[b] != after.files[b]}
    assert sorted(map(tuple, log.read().collect())) == before and len(changed) == 1 and after.runs(*changed) == 1
    gone = log.vacuum(keep=1)
    assert gone and sorted(map(tuple, log.read().collect())) == before


def test_compactions_that_meet(spark, tmp_path, monkeypatch):
    log, other = log_of(spark, tmp_path, max_runs=0), log_of(spark, tmp_path, max_runs=0)
    log.append(rows(spark, [(1, 1)]))
    log.append(rows(spark, [(1, 2)]))
    write = log._write_run
    monkeypatch.setattr(log, "_write_run", lambda df: (write(df), other.compact(1))[0])
    with pytest.raises(ConflictError):
        log.compact()
    # an append beside a compaction is kept
    monkeypatch.setattr(log, "_write_run", lambda df: (write(df), other.append(rows(spark, [(1, 9)])))[0])
    log.append(rows(spark, [(2, 0)]))
    log.compact()
    assert sorted(map(tuple, log.read().collect())) == [(1, 1), (1, 2), (1, 9), (1, 9), (2, 0)]


def test_tags_empty_appends_and_failures(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert log.read().count() == 0 and log.append(rows(spark, [])).number == 0
    log.append(rows(spark, [(1, 1), (None, 2)]), ("s", "4"))
    log.append(rows(spark, [(1, 1)]), ("s", "4"))
    log.append(rows(spark, [(1, 1)]), ("s", "3"))
    log.append(rows(spark, [(1, 7)]), ("t", "0"))
    assert sorted(map(str, map(tuple, log.read().collect()))) == ["(1, 1)", "(1, 7)", "(None, 2)"]
    broken = rows(spark, [(1, 1)]).withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        log.append(broken)
    assert log.version().number == 2 and log.read().count() == 3


def test_written_bytes_follow_the_append(spark, tmp_path):
    biggest = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    log = log_of(spark, tmp_path, reduce=biggest)
    log.append(spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 0).alias("v")))
    old = set(files_read(log.read()))
    log.append(rows(spark, [(3, 1), (3, 5), (4, 2)]))
    new = set(files_read(log.read())) - old
    size = sum(len(spark.read.format("binaryFile").load(f"{tmp_path}/log/{f}").first().content) for f in new)
    assert size < 3_000 and sum(len(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{tmp_path}/log/data").collect()) > 20 * size
    assert [tuple(r) for r in log.lookup(3, 4, 5).orderBy("k").collect()] == [(3, 5), (4, 2), (5, 0)] and log.read().count() == 20_000


KINDS = "job long, file string"


def put(spark, tmp_path, events):
    made = [(j, f, s, None if m is None else T0 + dt.timedelta(minutes=m), q) for j, f, s, m, q in events]
    spark.createDataFrame(made, f"{KINDS}, status string, ts timestamp, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run(spark, tmp_path, **more):
    log = states.state_log(spark, f"{tmp_path}/states", ["job", "file"], KINDS, buckets=4, max_runs=2)
    stream = spark.readStream.schema(f"{KINDS}, status string, ts timestamp, seq long").parquet(f"{tmp_path}/in")
    states.follow(states.keyed_states(stream, ["job", "file"], **more), log, f"{tmp_path}/checkpoint").awaitTermination()
    return log, {(r.job, r.file): (r.status, r.changes, r.overdue) for r in log.read().collect()}


def test_states_with_timers_and_late_events(spark, tmp_path):
    hang = {"timeout_ms": 30 * 60_000, "lateness": "10 minutes"}
    put(spark, tmp_path, [(1, "a", "running", 0, 1), (1, "b", "running", 0, 2), (2, "a", "queued", 5, 3)])
    assert run(spark, tmp_path, **hang)[1] == {(1, "a"): ("running", 1, False), (1, "b"): ("running", 1, False), (2, "a"): ("queued", 1, False)}
    put(spark, tmp_path, [(1, "a", "done", 20, 5), (1, "b", "running", 60, 4)])
    # the watermark is now at 50 minutes: 2/a has waited since 5, 1/a is final, 1/b has just spoken
    assert run(spark, tmp_path, **hang)[1] == {(1, "a"): ("done", 2, False), (1, "b"): ("running", 2, False), (2, "a"): ("queued", 1, True)}
    # an older event does not take a state back, one behind the watermark is dropped, a hung job goes on
    put(spark, tmp_path, [(1, "b", "older", 55, 9), (2, "a", "done", 70, 10), (9, "x", "running", 1, 1)])
    assert run(spark, tmp_path, **hang)[1] == {(1, "a"): ("done", 2, False), (1, "b"): ("running", 3, False), (2, "a"): ("done", 2, False)}


def test_states_without_timers_drop_nothing(spark, tmp_path):
    put(spark, tmp_path, [(1, "a", "x", 100, 1), (None, None, "n", None, None)])
    run(spark, tmp_path)
    put(spark, tmp_path, [(1, "a", "y", 0, 5), (1, "a", "z", 100, 2), (1, "a", "w", 100, 2)])
    log, got = run(spark, tmp_path)
    assert got == {(1, "a"): ("z", 4, False), (None, None): ("n", 1, False)}
    assert run(spark, tmp_path)[0].version().number == log.version().number  # nothing new: nothing written


def submitted(spark, ids):
    e = spark.createDataFrame([(i,) for i in ids], "item_id long")
    none = [F.lit(None).cast("string").alias(c) for c in ("field_name", "original_value", "corrected_value")]
    text = {"source_path": "'/a.pdf'", "source_text": "'t'", "invoice_json": "'{}'", "gate_json": """'{"problems":[],"fields":{"currency":"TND"}}'"""}
    return e.select(F.col("item_id").alias("event_id"), "item_id", F.lit("submitted").alias("kind"), F.lit(T0).alias("ts"), *(F.expr(v).alias(k) for k, v in text.items()), *none)


def test_engine_verbs_read_one_bucket(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"{tmp_path}/store")
    engine.append(submitted(spark, range(200)), ("watch", "0"))
    engine.append(submitted(spark, range(200)), ("watch", "0"))  # the same batch again
    engine.correct(7, "currency", "EUR")
    engine.approve(7)
    engine.delete(8)
    opened, read = [], engine.log._open
    monkeypatch.setattr(engine.log, "_open", lambda paths: opened.append(len({p.split("/")[2] for p in paths})) or read(paths))
    item = engine.item(7).first()
    assert (item.status, item.fields["currency"], len(item.corrections)) == ("approved", "EUR", 1)
    assert opened and set(opened) == {1}
    with pytest.raises(KeyError):
        engine.item(8)
    assert review.items(engine.events()).count() == 199
    before = sorted(map(str, engine.queue().collect()))
    engine.log.compact(0)
    assert sorted(map(str, engine.queue().collect())) == before
