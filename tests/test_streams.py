"""The batch result is the stream result, in whatever batches the log arrives."""

from datetime import datetime, timedelta

import pytest

from dnslake.operators import rollup
from dnslake.operators.investigate import resolution_rollup
from dnslake.plans import adapters as A
from dnslake.schemas import ANSWERS, EVENTS
from dnslake.sources.events import stream_events
from dnslake.streaming import streams

T0 = datetime(2026, 3, 1, 8, 0, 0)


def event(name, client, minutes, qtype=1):
    return (name, "example.com", client, qtype, T0 + timedelta(minutes=minutes))


#: Overlapping clients; the last batch is a day late for one name.
BATCHES = [
    [event("a.example.com", 20, 1), event("a.example.com", 21, 2), event("b.example.com", 20, 3)],
    [event("a.example.com", 20, 4), event("a.example.com", 22, 70), event("a.example.com", 22, 70, 16)],
    [event("a.example.com", 23, 5), event("b.example.com", 20, -1440)]]


@pytest.fixture()
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "check")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def feed(spark, folders, batch, schema=EVENTS):
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folders["in"])


def drain(spark, folders):
    query = streams.start_event_stream(stream_events(spark, folders["in"]), folders["out"],
                                       folders["check"])
    query.awaitTermination()


def expected(spark):
    kept = spark.createDataFrame([e for b in BATCHES for e in b if e[3] != 16], EVENTS)
    return rows(rollup.hourly_rollup(kept).select("name", "hour", "query_count", "client_count"))


def result(spark, folders):
    return rows(streams.read_hourly(spark, folders["out"]).select(
        "name", "hour", "query_count", "client_count"))


def test_three_batches_one_of_them_late(spark, folders):
    for batch in BATCHES:
        feed(spark, folders, batch)
        drain(spark, folders)
    assert result(spark, folders) == expected(spark)
    totals = {r.name: (r.query_count, r.first_seen) for r in
              streams.read_domains(spark, folders["out"]).collect()}
    assert totals == {"a.example.com": (5, T0 + timedelta(minutes=1)),
                      "b.example.com": (2, T0 - timedelta(minutes=1440))}


def test_a_batch_run_twice_changes_nothing(spark, folders):
    frames = [spark.createDataFrame([e for e in b if e[3] != 16], EVENTS) for b in BATCHES]
    for n, df in enumerate(frames):
        streams.merge_batch(df, n, folders["out"])
    streams.merge_batch(frames[1], 1, folders["out"])
    assert result(spark, folders) == expected(spark)


def test_compaction_between_batches(spark, folders):
    frames = [spark.createDataFrame([e for e in b if e[3] != 16], EVENTS) for b in BATCHES]
    for n, df in enumerate(frames[:2]):
        streams.merge_batch(df, n, folders["out"])
    for name in ("hourly", "domain"):
        assert streams.compact(spark, folders["out"], name) == 1
    streams.merge_batch(frames[2], 2, folders["out"])
    assert result(spark, folders) == expected(spark)
    assert streams.compact(spark, folders["out"], "hourly") == 2
    assert result(spark, folders) == expected(spark)


def test_answers_are_their_own_stream(spark, folders):
    answer = [("ads.example.com", ["198.19.5.6", "2606:4700::1111"], 300, T0),
              ("ads.example.com", ["198.19.5.6"], 60, T0 + timedelta(minutes=9)),
              ("unknown.example.com", ["1.1.1.1"], 60, T0)]
    for a in answer:
        feed(spark, folders, [a], ANSWERS)
        query = streams.start_answer_stream(
            spark.readStream.schema(ANSWERS).parquet(folders["in"]), folders["out"], folders["check"])
        query.awaitTermination()
    known = spark.createDataFrame([("ads.example.com",)], "name string")
    got = rows(streams.read_resolutions(spark, folders["out"], known))
    assert got == rows(resolution_rollup(spark.createDataFrame(answer, ANSWERS), known))
    assert ("ads.example.com", "198.19.5.6", T0, T0 + timedelta(minutes=9), 2, 60) in got


def test_progress_counts_rows(spark, folders):
    progress = streams.Progress()
    spark.streams.addListener(progress)
    try:
        feed(spark, folders, BATCHES[0])
        drain(spark, folders)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    assert progress.rows == 3 and progress.batches


def test_views_work_on_a_stream(spark):
    raw = stream_events(spark, "/root/testdata/sf0.001", A.DRIVER_TABLES["events"], glob="events.parquet")
    assert A.from_raw_events(raw).isStreaming
