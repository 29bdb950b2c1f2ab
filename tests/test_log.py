"""Roll-ups, behaviour and co-occurrence against plain Python over skewed random logs."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dnslake.operators import behavior, joins, relate, rollup, stats, windows

T0 = datetime(2026, 3, 1, 8, 0, 0)
SCHEMA = "name string, etld1 string, client_id long, qtype int, occurred_at timestamp"


def skewed_log(n=900, seed=1, span=600):
    """One client and one name hold about half of all rows; many share a second."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        client = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
        k = 0 if rng.random() < 0.4 else rng.randrange(1, 12)
        at = T0 + timedelta(seconds=rng.randrange(span))
        rows.append((f"h{k}.r{k % 4}.vn", f"r{k % 4}.vn", client, 1, at))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    rows = skewed_log()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_new_names_of_a_batch(spark):
    e = spark.createDataFrame([
        ("ads.example.com", "example.com", 20, 1, T0 + timedelta(minutes=15)),
        ("ads.example.com", "example.com", 21, 1, T0 + timedelta(minutes=15, seconds=1)),
        ("cdn.example.com", "example.com", 20, 1, T0 + timedelta(minutes=15, seconds=2))], SCHEMA)
    hourly = {r.name: (r.hour, r.query_count, r.client_count) for r in rollup.hourly_rollup(e).collect()}
    assert hourly["ads.example.com"] == (T0, 2, 2) and hourly["cdn.example.com"] == (T0, 1, 1)
    known = spark.createDataFrame([("cdn.example.com",)], "name string")
    new = rollup.new_domains(e, known).collect()
    assert [(r.name, r.status, r.origin, r.is_manual) for r in new] == [
        ("ads.example.com", "new", "discovered", False)]


def test_distinct_clients_over_three_batches(spark):
    batches = [[20, 21], [20, 22], [21, 22, 23]]
    parts = [rollup.hourly_cells(spark.createDataFrame(
        [("a.b", "a.b", c, 1, T0 + timedelta(minutes=i)) for c in clients], SCHEMA))
        for i, clients in enumerate(batches)]
    for order in ((0, 1, 2), (2, 0, 1)):
        merged = rollup.merge_rollups(*[parts[i] for i in order])
        hourly = rollup.hourly_from_cells(merged)
        assert [(r.query_count, r.client_count) for r in hourly.collect()] == [(7, 4)]
        assert rollup.peak_clients(hourly).first().client_count == 4
        assert rollup.distinct_clients(merged).first().clients == 4
    rows = [rollup.client_hours(spark.createDataFrame(
        [("a.b", "a.b", c, 1, T0 + timedelta(minutes=i)) for c in clients], SCHEMA))
        for i, clients in enumerate(batches)]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2])
    again = rollup.hourly_from_clients(rollup.merge_client_hours(union)).first()
    assert (again.query_count, again.client_count) == (7, 4)


def test_bitmaps_beyond_one_bucket(spark):
    ids = [0, 1, 32767, 32768, 70000, 70000, 1 << 33]
    e = spark.createDataFrame([("a.b", "a.b", c, 1, T0) for c in ids], SCHEMA)
    r = rollup.hourly_from_cells(rollup.hourly_cells(e)).first()
    assert (r.query_count, r.client_count) == (7, 6)


def test_client_numbers_are_unique_and_stable(spark):
    first = rollup.client_ids(spark.createDataFrame([(f"c{i}",) for i in range(50)], "client string"),
                              buckets=8)
    grown = rollup.client_ids(spark.createDataFrame([(f"c{i}",) for i in range(200)],
                                                    "client string"), first, buckets=8)
    old = {r.client: r.client_id for r in first.collect()}
    new = {r.client: r.client_id for r in grown.collect()}
    assert all(new[c] == i for c, i in old.items())
    assert len(new) == len(set(new.values())) == 200 and max(new.values()) < 800


@pytest.mark.parametrize("gap", [1, 3, 20])
def test_preceded_within_equals_exists(log, gap):
    rows, df = log
    want = sorted((r[0], r[2], r[4], any(
        p[2] == r[2] and p[1] != r[1] and timedelta(0) < r[4] - p[4] <= timedelta(seconds=gap)
        for p in rows)) for r in rows)
    for cell in (None, gap, 7 * gap):
        got = behavior.preceded_within(df, "client_id", "etld1", "occurred_at", gap, cell)
        assert sorted((r.name, r.client_id, r.occurred_at, r.preceded) for r in got.collect()) == want


def test_third_party_ratio_needs_five(spark):
    e = spark.createDataFrame(
        [("a.x", "x", 1, 1, T0 + timedelta(seconds=10 * i)) for i in range(5)]
        + [("b.y", "y", 1, 1, T0 + timedelta(seconds=10 * i + 2)) for i in range(5)]
        + [("c.z", "z", 1, 1, T0 + timedelta(seconds=1000))], SCHEMA)
    got = {r.name: (r.sample_size, r.third_party_ratio)
           for r in behavior.third_party_ratio(e).collect()}
    assert got == {"a.x": (5, 0.0), "b.y": (5, 1.0)}


def test_interval_cv(log):
    rows, df = log
    times = {}
    for r in sorted(rows, key=lambda r: r[4]):
        times.setdefault(r[0], []).append(r[4])
    want = {}
    for name, ts in times.items():
        g = [d for d in ((b - a).total_seconds() for a, b in zip(ts, ts[1:])) if d > 0]
        want[name] = statistics.pstdev(g) / statistics.fmean(g) if len(ts) >= 3 and len(g) >= 2 else 0.0
    got = {r.name: r.interval_cv for r in behavior.interval_cv(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_behavior_reads_the_log_once(log):
    _, df = log
    both = behavior.behavior(df, gap=3)
    ratio = {r.name: r.third_party_ratio for r in behavior.third_party_ratio(df).collect()}
    cv = {r.name: r.interval_cv for r in behavior.interval_cv(df).collect()}
    got = both.collect()
    assert {r.name: r.third_party_ratio for r in got} == ratio
    assert all(r.interval_cv == pytest.approx(cv[r.name]) for r in got)


@pytest.mark.parametrize("cell,most", [(1, 9), (13, 4), (3600, 1_000_000), (3600, 3), (86400, 10)])
def test_gaps(log, cell, most):
    rows, df = log
    want = []
    last = {}
    for name, at in sorted((r[0], r[4]) for r in rows):
        want.append((name, at, (at - last[name]).total_seconds() if name in last else -1.0))
        last[name] = at
    got = windows.gaps(df, "name", "occurred_at", cell, most).select(
        "name", "occurred_at", F.coalesce("gap", F.lit(-1.0)).alias("g")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_key_with_half_of_all_rows_is_never_gathered(spark):
    """Rows of the hot cell learn that they are hot under many salts, equal rows included."""
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) AS name", "0L AS _cell", "7 AS same")
    hot = spark.createDataFrame([("hot", 0, 5)], "name string, _cell long, _parts long")
    told = joins.with_hot(rows, hot, ["name", "_cell"])
    assert told.count() == 20_000 and told.where("_parts = 5").count() == 10_000
    assert told.where("name <> 'hot' and _parts is not null").isEmpty()
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(joins.SALTS)))
    assert salted.where("name = 'hot'").groupBy("_salt").count().agg(F.max("count")).first()[0] <= 10_000 / 16


@pytest.mark.parametrize("n,shares", [(1, 1), (5, 2), (1000, 64)])
def test_first_n(log, n, shares):
    rows, df = log
    numbered = df.rdd.zipWithIndex().map(lambda p: (*p[0], p[1])).toDF(SCHEMA + ", i long")
    want = {}
    for r in sorted(numbered.collect(), key=lambda r: (r.occurred_at, r.i)):
        if len(want.setdefault(r.name, [])) < n:
            want[r.name].append(r.i)
    got = {}
    for r in windows.first_n(numbered, ["name"], [F.col("occurred_at"), F.col("i")], n,
                             shares).collect():
        got.setdefault(r.name, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("rows_per_task", [5, 100_000])
@pytest.mark.parametrize("gap", [1, 3, 30])
def test_co_occurrence_equals_all_pairs(log, ordered, rows_per_task, gap):
    rows, df = log
    want = {}
    for a in rows:
        for b in rows:
            if a[2] != b[2] or not timedelta(0) < b[4] - a[4] <= timedelta(seconds=gap):
                continue
            if a[0] < b[0] or (not ordered and a[0] != b[0]):
                key = (min(a[0], b[0]), max(a[0], b[0]))
                want[key] = want.get(key, 0) + 1
    got = relate.co_occurrence_counts(df, "name", gap, 1, busy=1, ordered=ordered,
                                      rows_per_task=rows_per_task)
    assert {(r.a, r.b): r.n for r in got.collect()} == want


def test_rare_names_take_no_part(log):
    rows, df = log
    busy = {n for n in {r[0] for r in rows} if sum(r[0] == n for r in rows) >= 60}
    got = relate.co_occurrence_counts(df, "name", 5, 1, busy=60).collect()
    assert got and {r.a for r in got} | {r.b for r in got} <= busy


def test_npmi_bounds(spark):
    pairs = spark.createDataFrame([("a", "b", 4), ("a", "c", 1), ("d", "e", 5)],
                                  "a string, b string, n long")
    totals = spark.createDataFrame([("a", 5), ("b", 5), ("c", 85), ("d", 5), ("e", 5)],
                                   "name string, total long")
    got = {(r.a, r.b): r.strength for r in relate.npmi(pairs, totals).collect()}
    assert set(got) == {("a", "b"), ("d", "e")} and got["d", "e"] == 1.0 and 0 < got["a", "b"] < 1


def test_interval_join_cells(spark):
    rng = random.Random(3)
    left = [(rng.choice("aab"), i, T0 + timedelta(seconds=rng.randrange(5000))) for i in range(150)]
    spans = []
    for j in range(40):
        s = T0 + timedelta(seconds=rng.randrange(5000))
        spans.append((rng.choice("aab"), j, s, s + timedelta(seconds=rng.randrange(2000))))
    want = sorted((x[1], y[1]) for x in left for y in spans if x[0] == y[0] and y[2] <= x[2] <= y[3])
    a = spark.createDataFrame(left, "k string, i int, t timestamp")
    b = spark.createDataFrame(spans, "k string, j int, s timestamp, e timestamp")
    for cell in (60, 1000, 86400):
        got = joins.interval_join(a, b, ["k"], "t", "s", "e", cell)
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_bucket_width():
    h = timedelta(hours=1)
    spans = [h, 12 * h, 12 * h + timedelta(minutes=1), 13 * h, 48 * h, 49 * h, 168 * h, 200 * h]
    assert [stats.bucket_seconds(s) for s in spans] == [60, 60, 60, 300, 300, 900, 900, 3600]


def test_metric_buckets_and_empty_range(spark):
    rows = [(T0, 10.0), (T0 + timedelta(seconds=30), 30.0), (T0 + timedelta(seconds=60), 5.0)]
    m = spark.createDataFrame(rows, "at timestamp, cpu double")
    end = str(T0 + timedelta(hours=1))
    got = sorted(tuple(r) for r in stats.metric_buckets(m, 60, str(T0), end, ["cpu"]).collect())
    assert got == [(T0, 20.0, 30.0), (T0 + timedelta(minutes=1), 5.0, 5.0)]
    none = stats.metric_summary(m, "2030-01-01", "2030-01-02", ["cpu"]).first()
    assert (none.samples, none.cpu_avg, none.cpu_max, none.oldest) == (0, 0.0, 0.0, None)


def test_event_age_of_an_empty_log(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert stats.event_age(e, str(T0)).first().age_seconds == -1
    assert stats.freshness_alarm(e, str(T0)).first().stale


def test_stored_cells_are_small_whatever_the_client_numbers(spark):
    """A sparse cell takes no more than its clients; missing and negative numbers are kept apart."""
    ids = [None, -1, -64, -65, 0, 63, 63, 64, (1 << 62) + 63]
    e = spark.createDataFrame([("a.b", "a.b", c, 1, T0) for c in ids] + [("c.d", "c.d", None, 1, T0)], SCHEMA)
    cells = rollup.hourly_cells(e)
    assert {len(r.clients) if isinstance(r.clients, bytes) else 8 for r in cells.collect()} == {8}
    merged = rollup.merge_rollups(cells, rollup.hourly_cells(e))
    assert {tuple(r)[0::2] + (r.query_count,) for r in rollup.hourly_from_cells(merged).drop("hour").select(
        "name", "query_count", "client_count").collect()} == {("a.b", 7, 18), ("c.d", 0, 2)}
    assert {tuple(r) for r in rollup.distinct_clients(merged).collect()} == {("a.b", 7), ("c.d", 0)}


def test_a_large_input_partition_is_dealt_out_before_its_cells_are_built(spark):
    """Cells that hardly combine take memory by the event, so one partition of the input is dealt over tasks first."""
    e = spark.range(4000).selectExpr(
        "concat('h', id % 7) AS name", "id * 64 AS client_id", f"TIMESTAMP '{T0}' + make_interval(0, 0, 0, 0, 0, 0, id) "
        "AS occurred_at").coalesce(1)
    node = rollup.hourly_cells(e)._jdf.queryExecution().sparkPlan()
    aggregates = []
    while node.children().nonEmpty():
        aggregates += [node] if "Aggregate" in node.nodeName() else []
        node = node.children().head()
    assert aggregates[-1].child().outputPartitioning().numPartitions() > 1
    assert rollup.distinct_clients(rollup.hourly_cells(e)).agg(F.sum("clients")).first()[0] == 4000
