"""Queries over the event log: roll-ups, reports, behaviour, co-occurrence, streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from dnslake.operators import behavior, relate, rollup, stats, windows
from dnslake.plans import adapters as A
from dnslake.plans.registry import BOTH, DOM, EV, HOURLY, RANGE, query, sec, six
from dnslake.session import work_path
from dnslake.sources import events as log
from dnslake.sources import tables
from dnslake.streaming import streams

F_, T_ = A.FROM, A.TO


@query(f"""WITH {EV} SELECT name, CAST(epoch(date_trunc('hour', occurred_at)) AS BIGINT) AS hour,
count(*) AS query_count, count(DISTINCT client_id) AS client_count FROM dns_events GROUP BY 1, 2""")
def hourly_rollup(spark, sf):
    return A.hourly(spark, sf).select("name", sec("hour"), "query_count", "client_count")


@query(f"""WITH {EV} SELECT name, CAST(epoch(date_trunc('hour', occurred_at)) AS BIGINT) AS hour,
count(*) AS query_count, count(DISTINCT client_id) AS client_count FROM dns_events GROUP BY 1, 2""")
def hourly_bitmap_rollup(spark, sf):
    """The stored form: client bitmaps per cell, counted at the end."""
    cells = rollup.hourly_cells(A.events(spark, sf))
    return rollup.hourly_from_cells(cells).select("name", sec("hour"), "query_count",
                                                  "client_count")


@query(f"""WITH {EV} SELECT name, CAST(epoch(date_trunc('day', occurred_at)) AS BIGINT) AS day,
count(*) AS query_count, count(DISTINCT client_id) AS client_count FROM dns_events GROUP BY 1, 2""")
def merged_rollups(spark, sf):
    """Three separate roll-ups with common clients, merged."""
    e = A.events(spark, sf)
    parts = [rollup.hourly_cells(e.where(F.pmod(F.unix_seconds("occurred_at"), F.lit(3)) == i),
                                 unit="day") for i in range(3)]
    return rollup.hourly_from_cells(rollup.merge_rollups(*parts)).select(
        "name", sec("hour").alias("day"), "query_count", "client_count")


@query(f"""WITH {HOURLY} SELECT name, max(client_count) AS client_count FROM hourly GROUP BY 1""")
def peak_clients(spark, sf):
    return rollup.peak_clients(A.hourly(spark, sf))


@query(f"""WITH {EV} SELECT name, count(DISTINCT client_id) AS clients FROM dns_events GROUP BY 1""")
def distinct_clients(spark, sf):
    return rollup.distinct_clients(rollup.hourly_cells(A.events(spark, sf)))


@query(f"""WITH {EV} SELECT name, min(etld1) AS etld1, count(*) AS query_count,
CAST(epoch(min(occurred_at)) AS BIGINT) AS first_seen,
CAST(epoch(max(occurred_at)) AS BIGINT) AS last_seen FROM dns_events GROUP BY 1""")
def domain_totals(spark, sf):
    return rollup.domain_totals(A.events(spark, sf)).select(
        "name", "etld1", "query_count", sec("first_seen"), sec("last_seen"))


@query(f"""WITH {EV} SELECT client_id, CAST(epoch(min(occurred_at)) AS BIGINT) AS first_seen,
CAST(epoch(max(occurred_at)) AS BIGINT) AS last_seen FROM dns_events GROUP BY 1""")
def client_totals(spark, sf):
    return rollup.client_totals(A.events(spark, sf)).select(
        "client_id", sec("first_seen"), sec("last_seen"))


@query(f"""WITH {EV} SELECT count(DISTINCT client_id) AS clients, count(DISTINCT client_id) AS ids
FROM dns_events""")
def client_dictionary(spark, sf):
    e = A.events(spark, sf)
    early = rollup.client_ids(e.where(F.col("k") < 50).select(
        F.col("client_id").cast("string").alias("client")))
    grown = rollup.client_ids(e.select(F.col("client_id").cast("string").alias("client")), early)
    return grown.agg(F.count_distinct("client").alias("clients"),
                     F.count_distinct("client_id").alias("ids"))


@query(f"""WITH {DOM} SELECT e.name, d.name AS known FROM (SELECT DISTINCT name FROM dns_events) e
LEFT JOIN dom d ON d.name = e.name AND d.status = 'blocked' WHERE d.name IS NULL""",
       name="new_domains")
def _new_domains(spark, sf):
    known = A.domains(spark, sf).where(F.col("status") == "blocked")
    new = rollup.new_domains(A.events(spark, sf), known)
    return new.select("name", F.lit(None).cast("string").alias("known"))


@query(f"""WITH {DOM} SELECT e.name, count(*) AS rows_known, CAST(NULL AS BIGINT) AS rows_unknown
FROM dns_events e JOIN dom d ON d.name = e.name AND d.status <> 'ignored' GROUP BY 1
UNION ALL SELECT DISTINCT name, CAST(NULL AS BIGINT), CAST(1 AS BIGINT) FROM dom
WHERE status = 'ignored'""")
def id_lookup(spark, sf):
    dim = A.domains(spark, sf).where(F.col("status") != "ignored").select(
        "name", F.xxhash64("name").alias("domain_id"))
    known, unknown = rollup.with_ids(A.events(spark, sf), dim, "name", "domain_id")
    return known.groupBy("name").agg(F.count("*").alias("rows_known")).withColumn(
        "rows_unknown", F.lit(None).cast("long")).unionByName(unknown.select(
            "name", F.lit(None).cast("long").alias("rows_known"),
            F.lit(1).cast("long").alias("rows_unknown")))


@query(f"""WITH {DOM} SELECT status, category, cl.first_day, count(*) AS n
FROM dns_events e JOIN dom d USING (name) JOIN
(SELECT client_id, CAST(epoch(date_trunc('day', min(occurred_at))) AS BIGINT) AS first_day
 FROM dns_events GROUP BY 1) cl USING (client_id) GROUP BY 1, 2, 3""")
def star_join(spark, sf):
    e = A.events(spark, sf).select("name", "etld1", "client_id")
    clients = rollup.client_totals(A.events(spark, sf)).select(
        "client_id", F.unix_seconds(F.date_trunc("day", "first_seen")).alias("first_day"))
    dim = A.domains(spark, sf).select("name", "status", "category")
    return rollup.star(e, dim, clients).groupBy("status", "category", "first_day").agg(
        F.count("*").alias("n"))


@query(f"""WITH {EV} SELECT qtype, CASE qtype WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA'
WHEN 65 THEN 'HTTPS' ELSE 'TYPE' || qtype END AS type_name,
CAST(CASE WHEN qtype IN (1, 28, 65) THEN qtype ELSE 0 END AS INTEGER) AS code, count(*) AS n
FROM dns_events GROUP BY 1""")
def query_types(spark, sf):
    from dnslake.functions.names import qtype_code, qtype_name
    return (A.events(spark, sf).groupBy("qtype").agg(F.count("*").alias("n"))
            .withColumn("type_name", qtype_name("qtype"))
            .withColumn("code", qtype_code("type_name")))


@query(f"""WITH {EV} SELECT qtype, count(*) AS n FROM dns_events
WHERE qtype IN (1, 28, 65) GROUP BY 1""")
def wanted_types(spark, sf):
    return log.wanted_types(A.events(spark, sf)).groupBy("qtype").agg(F.count("*").alias("n"))


@query(f"""WITH {EV} SELECT count(*) AS n, CAST(epoch(min(occurred_at)) AS BIGINT) AS lo
FROM dns_events WHERE occurred_at {RANGE}""")
def time_range(spark, sf):
    return log.between(A.events(spark, sf), F_, T_).agg(
        F.count("*").alias("n"), F.unix_seconds(F.min("occurred_at")).alias("lo"))


@query(f"""WITH {EV} SELECT CAST(epoch(date_trunc('day', occurred_at)) AS BIGINT) AS day,
count(*) AS n FROM dns_events
WHERE occurred_at >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY GROUP BY 1""")
def retention(spark, sf):
    kept = log.apply_retention(A.events(spark, sf), A.AS_OF, 14)
    return kept.groupBy(F.unix_seconds(F.date_trunc("day", "occurred_at")).alias("day")).agg(
        F.count("*").alias("n"))


@query(f"""WITH {BOTH} SELECT CAST(sum(query_count) AS BIGINT) AS total_queries,
CAST(sum(CASE WHEN status = 'blocked' THEN query_count ELSE 0 END) AS BIGINT) AS blocked_queries,
count(DISTINCT name) AS unique_domains,
round(sum(CASE WHEN status = 'blocked' THEN query_count ELSE 0 END) / sum(query_count), 6)
AS blocked_ratio
FROM (SELECT h.name, h.hour, h.query_count, d.status FROM hourly h JOIN dom d USING (name))
WHERE hour {RANGE}""")
def overview(spark, sf):
    return stats.overview(A.hourly(spark, sf), A.domains(spark, sf), F_, T_).withColumn(
        "blocked_ratio", six("blocked_ratio"))


@query(f"""WITH {DOM} SELECT
(SELECT count(*) FROM (SELECT client_id FROM dns_events GROUP BY 1
  HAVING max(occurred_at) >= TIMESTAMP '2024-01-29')) AS active_clients,
(SELECT count(*) FROM dom WHERE status = 'staging') AS pending_review,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS unblock_requests""")
def overview_counters(spark, sf):
    return stats.counters(A.events(spark, sf), A.domains(spark, sf), A.requests(spark, sf),
                          "2024-01-29 00:00:00")


@query(f"""WITH {BOTH} SELECT category, CAST(sum(h.query_count) AS BIGINT) AS queries
FROM hourly h JOIN dom d USING (name) WHERE hour {RANGE} AND category IS NOT NULL GROUP BY 1""")
def queries_by_category(spark, sf):
    return stats.by_category(A.hourly(spark, sf), A.domains(spark, sf), F_, T_)


@query(f"""WITH {BOTH} SELECT CAST(epoch(hour) AS BIGINT) AS hour,
CAST(sum(h.query_count) AS BIGINT) AS queries,
CAST(sum(CASE WHEN status = 'blocked' THEN h.query_count ELSE 0 END) AS BIGINT) AS blocked
FROM hourly h JOIN dom d USING (name) WHERE hour {RANGE} GROUP BY 1""")
def traffic_timeseries(spark, sf):
    return stats.timeseries(A.hourly(spark, sf), A.domains(spark, sf), F_, T_).select(
        sec("hour"), "queries", "blocked")


@query(f"""WITH {HOURLY} SELECT CAST(epoch(hour) AS BIGINT) AS hour, query_count, client_count
FROM hourly WHERE name = 'h42.click.example' AND hour {RANGE}""")
def domain_timeline(spark, sf):
    return stats.timeline(A.hourly(spark, sf), "h42.click.example", F_, T_).select(
        sec("hour"), "query_count", "client_count")


@query(f"""WITH {EV} SELECT client_id, count(*) AS queries FROM dns_events
WHERE name = 'h42.click.example' AND occurred_at {RANGE} GROUP BY 1
ORDER BY queries DESC, client_id LIMIT 50""")
def domain_clients(spark, sf):
    return stats.clients_of(A.events(spark, sf), "h42.click.example", F_, T_)


@query(f"""WITH {BOTH} SELECT name AS key, CAST(sum(h.query_count) AS BIGINT) AS queries,
any_value(status) AS status, any_value(category) AS category
FROM hourly h JOIN dom d USING (name) WHERE hour {RANGE} GROUP BY 1
ORDER BY queries DESC, key LIMIT 20""")
def top_domains(spark, sf):
    return stats.top("domain", A.events(spark, sf), A.hourly(spark, sf), A.domains(spark, sf),
                     F_, T_)


@query(f"""WITH {BOTH} SELECT name AS key, CAST(sum(h.query_count) AS BIGINT) AS queries,
any_value(status) AS status, any_value(category) AS category
FROM hourly h JOIN dom d USING (name) WHERE hour {RANGE} AND status = 'blocked' GROUP BY 1
ORDER BY queries DESC, key LIMIT 20""")
def top_blocked(spark, sf):
    return stats.top("blocked", A.events(spark, sf), A.hourly(spark, sf), A.domains(spark, sf),
                     F_, T_)


@query(f"""WITH {EV} SELECT client_id AS key, count(*) AS queries FROM dns_events
WHERE occurred_at {RANGE} GROUP BY 1 ORDER BY queries DESC, key LIMIT 20""")
def top_clients(spark, sf):
    return stats.top("clients", A.events(spark, sf), A.hourly(spark, sf), A.domains(spark, sf),
                     F_, T_)


@query(f"""WITH {DOM} SELECT status, count(*) AS n FROM dom GROUP BY 1""")
def count_by_status(spark, sf):
    return stats.count_by_status(A.domains(spark, sf))


@query(f"""WITH {EV} SELECT age AS age_seconds, age < 0 OR age > 600 AS stale FROM (
SELECT CAST(epoch(TIMESTAMP '2024-02-01') - epoch(max(occurred_at)) AS BIGINT) AS age
FROM dns_events)""")
def event_freshness(spark, sf):
    return stats.freshness_alarm(A.events(spark, sf), A.AS_OF)


def _metrics(spark, sf):
    return A.table(spark, sf, "events").select(F.col("ts").alias("at"), "value")


@query(f"""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, round(avg(value), 6)
AS value_avg, max(value) AS value_max FROM events WHERE ts {RANGE} GROUP BY 1""")
def metric_buckets(spark, sf):
    width = stats.bucket_seconds(timedelta(days=16))
    return stats.metric_buckets(_metrics(spark, sf), width, F_, T_, ["value"]).select(
        sec("bucket"), six("value_avg"), "value_max")


@query(f"""SELECT count(*) AS samples, round(avg(value), 6) AS value_avg, max(value) AS value_max,
CAST(floor(epoch(min(ts))) AS BIGINT) AS oldest FROM events WHERE ts {RANGE}""")
def metric_summary(spark, sf):
    return stats.metric_summary(_metrics(spark, sf), F_, T_, ["value"]).select(
        "samples", six("value_avg"), "value_max", sec("oldest"))


@query("""SELECT moment, round(arg_max(v, part), 6) AS value FROM (
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS moment, max(value) AS v,
       CAST(event_type = 'click' AS INT) AS part FROM events GROUP BY 1, 3) GROUP BY 1""")
def metrics_upsert(spark, sf):
    """Hourly samples of all other events, overwritten by those of clicks at the same time."""
    hourly = A.table(spark, sf, "events").groupBy(
        F.date_trunc("hour", "ts").alias("at"), (F.col("event_type") == "click").alias("click")
    ).agg(F.max("value").alias("value"))
    merged = tables.upsert_metrics(hourly.where(~F.col("click")).drop("click"),
                                   hourly.where("click").drop("click"))
    return merged.select(sec("at").alias("moment"), six("value"))


@query("""SELECT count(*) AS requests, CAST(coalesce(sum(turn + 1), 0) AS BIGINT) AS domains,
CAST(coalesce(sum(turn), 0) AS BIGINT) AS verdicts, count(*) FILTER (conv_id % 7 = 0) AS failed,
CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS prompt_chars,
CAST(coalesce(sum(turn * 10), 0) AS BIGINT) AS reply_chars,
CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) + max(conv_id) * 3600 AS last_at
FROM conversations
WHERE TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id >= TIMESTAMP '2024-01-01 12:00:00'""")
def model_usage(spark, sf):
    return stats.call_usage(A.model_calls(spark, sf), "2024-01-31 12:00:00", 30).withColumn(
        "last_at", sec("last_at"))


@query("""SELECT conv_id * 1000 + turn AS id, role AS kind, conv_id * 3600 +
CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS created_at FROM conversations
WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 50 OFFSET 10""")
def model_calls_page(spark, sf):
    return stats.list_calls(A.model_calls(spark, sf), "assistant", 50, 10).select(
        "id", "kind", sec("created_at"))


@query("""SELECT role AS kind, count(*) AS n FROM conversations GROUP BY 1""")
def model_calls_by_kind(spark, sf):
    return stats.calls_by_kind(A.model_calls(spark, sf))


# Behaviour ---------------------------------------------------------------------------------------

PRECEDED = f"""WITH {EV} SELECT r.name, count(*) AS sample_size,
CAST(sum(CAST(EXISTS (SELECT 1 FROM dns_events p WHERE p.client_id = r.client_id
  AND p.etld1 <> r.etld1 AND p.occurred_at < r.occurred_at
  AND p.occurred_at >= r.occurred_at - INTERVAL 3600 SECOND) AS INT)) AS BIGINT) AS third_party
FROM dns_events r GROUP BY 1 HAVING count(*) >= 5"""


@query(f"""SELECT name, sample_size, third_party, round(third_party / sample_size, 6)
AS third_party_ratio FROM ({PRECEDED})""")
def third_party_ratio(spark, sf):
    return behavior.third_party_ratio(A.events(spark, sf), gap=3600).withColumn(
        "third_party_ratio", six("third_party_ratio"))


@query(f"""WITH {EV} SELECT etld1, count(*) AS n, count(*) FILTER (EXISTS (
SELECT 1 FROM dns_events p WHERE p.client_id = r.client_id AND p.etld1 <> r.etld1
AND p.occurred_at < r.occurred_at AND p.occurred_at >= r.occurred_at - INTERVAL 21600 SECOND))
AS preceded FROM dns_events r GROUP BY 1""")
def preceded_within(spark, sf):
    flagged = behavior.preceded_within(A.events(spark, sf), "client_id", "etld1", "occurred_at",
                                       21600)
    return flagged.groupBy("etld1").agg(F.count("*").alias("n"),
                                        F.count_if("preceded").alias("preceded"))


CV = f"""WITH {EV}, g AS (SELECT name, epoch(occurred_at) - lag(epoch(occurred_at)) OVER (
  PARTITION BY name ORDER BY occurred_at) AS gap FROM dns_events)
SELECT name, CASE WHEN count(*) < 3 OR count(*) FILTER (gap > 0) < 2 THEN 0.0
ELSE stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0) END AS interval_cv
FROM g GROUP BY 1"""


@query(f"SELECT name, round(interval_cv, 6) AS interval_cv FROM ({CV})")
def interval_cv(spark, sf):
    return behavior.interval_cv(A.events(spark, sf)).select("name", six("interval_cv"))


@query(f"""WITH {EV}, early AS (SELECT etld1, epoch(occurred_at) AS s, row_number() OVER (
  PARTITION BY etld1 ORDER BY occurred_at) AS rn FROM dns_events),
g AS (SELECT etld1, s - lag(s) OVER (PARTITION BY etld1 ORDER BY rn) AS gap FROM early)
SELECT etld1, round(stddev_pop(gap) / avg(gap), 6) AS interval_cv FROM g WHERE gap > 0
GROUP BY 1""")
def interval_cv_hot_key(spark, sf):
    """Few keys with many events each: gaps run inside time cells."""
    return behavior.interval_cv(A.events(spark, sf), keys=("etld1",)).select(
        "etld1", six("interval_cv"))


@query("""SELECT event_type, count(*) AS n, round(sum(gap), 4) AS total, round(max(gap), 4) AS longest
FROM (SELECT event_type, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap
FROM events) GROUP BY 1""")
def event_gaps(spark, sf):
    g = windows.gaps(A.table(spark, sf, "events"), "event_type", "ts")
    return g.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("gap"), 4).alias("total"),
        F.round(F.max("gap"), 4).alias("longest"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (
PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 10""")
def first_events(spark, sf):
    return windows.first_n(A.table(spark, sf, "events").select("user_id", "event_id", "ts"),
                           ["user_id"], [F.col("ts"), F.col("event_id")], 10).drop("ts")


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type
FROM events GROUP BY 1""")
def latest_event(spark, sf):
    return windows.latest_per(A.table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts"]).drop("ts")


@query(f"""WITH {DOM} SELECT name, etld1, count(*) OVER (PARTITION BY etld1) AS names FROM dom""")
def names_per_root(spark, sf):
    return windows.with_group_count(A.domains(spark, sf).select("name", "etld1"), "etld1", "names")


# Co-occurrence -----------------------------------------------------------------------------------

def _pairs(key: str, gap: int, order: str) -> str:
    return f"""WITH {EV} SELECT least(a.{key}, b.{key}) AS a, greatest(a.{key}, b.{key}) AS b,
count(*) AS n FROM dns_events a JOIN dns_events b ON a.client_id = b.client_id
AND {order} AND b.occurred_at > a.occurred_at
AND b.occurred_at <= a.occurred_at + INTERVAL {gap} SECOND GROUP BY 1, 2"""


@query(_pairs("etld1", 3600, "a.etld1 < b.etld1") + " HAVING count(*) >= 3")
def co_occurrence(spark, sf):
    return relate.co_occurrence_counts(A.events(spark, sf), "etld1", 3600)


@query(_pairs("name", 21600, "a.name <> b.name"))
def co_occurrence_both_orders(spark, sf):
    """Every pair of names, in small shares of the cells."""
    return relate.co_occurrence_counts(A.events(spark, sf), "name", 21600, min_count=1,
                                       ordered=False, rows_per_task=8)


@query(f"""WITH p AS ({_pairs("name", 86400, "a.name < b.name")} HAVING count(*) >= 3), {EV},
t AS (SELECT name, count(*) AS c FROM dns_events GROUP BY 1),
s AS (SELECT a, b, n, n / g.c AS pab, ta.c / g.c AS pa, tb.c / g.c AS pb FROM p
JOIN t ta ON ta.name = a JOIN t tb ON tb.name = b,
(SELECT CAST(count(*) AS DOUBLE) AS c FROM dns_events) g)
SELECT a, b, n, round(least(1.0, log2(pab / (pa * pb)) / -log2(pab)), 6) AS strength FROM s
WHERE log2(pab / (pa * pb)) > 0""")
def co_occurrence_strength(spark, sf):
    e = A.events(spark, sf)
    pairs = relate.co_occurrence_counts(e, "name", 86400)
    totals = e.groupBy("name").agg(F.count("*").alias("total"))
    return relate.npmi(pairs, totals).withColumn("strength", six("strength"))


@query(f"""WITH p AS ({_pairs("name", 21600, "a.name < b.name")} HAVING count(*) >= 2), {EV},
t AS (SELECT name, count(*) AS c FROM dns_events GROUP BY 1),
s AS (SELECT a, b, n, n / g.c AS pab, ta.c / g.c AS pa, tb.c / g.c AS pb FROM p
JOIN t ta ON ta.name = a JOIN t tb ON tb.name = b,
(SELECT CAST(count(*) AS DOUBLE) AS c FROM dns_events) g),
e AS (SELECT a, b, n, round(least(1.0, log2(pab / (pa * pb)) / -log2(pab)), 6) AS strength FROM s
WHERE log2(pab / (pa * pb)) > 0)
SELECT a AS from_id, b AS to_id, 'co_occurs' AS kind, strength FROM e
UNION ALL SELECT b, a, 'co_occurs', strength FROM e""")
def co_occurrence_edges(spark, sf):
    return relate.co_occurrence_edges(A.events(spark, sf), 21600, 2).select(
        "from_id", "to_id", "kind", six("strength"))


# Streams -----------------------------------------------------------------------------------------

def _stream(spark, sf):
    raw = log.stream_events(spark, sf, A.DRIVER_TABLES["events"], glob="events.parquet")
    return A.from_raw_events(raw)


@query(f"""WITH {EV} SELECT name, CAST(epoch(date_trunc('hour', occurred_at)) AS BIGINT) AS hour,
count(*) AS query_count, count(DISTINCT client_id) AS client_count FROM dns_events
WHERE qtype IN (1, 28, 65) GROUP BY 1, 2""")
def stream_hourly_rollup(spark, sf):
    """The event stream, drained into the shared folder, read back through the merge."""
    out = work_path(spark, "events")
    streams.start_event_stream(_stream(spark, sf), f"{out}/t", f"{out}/c").awaitTermination()
    return streams.read_hourly(spark, f"{out}/t").select("name", sec("hour"), "query_count",
                                                         "client_count")


@query(f"""WITH {EV} SELECT name, etld1, count(*) AS query_count,
CAST(epoch(min(occurred_at)) AS BIGINT) AS first_seen,
CAST(epoch(max(occurred_at)) AS BIGINT) AS last_seen FROM dns_events
WHERE qtype IN (1, 28, 65) GROUP BY 1, 2""")
def stream_domain_totals(spark, sf):
    out = work_path(spark, "domains")
    streams.start_event_stream(_stream(spark, sf), f"{out}/t", f"{out}/c").awaitTermination()
    return streams.read_domains(spark, f"{out}/t").select(
        "name", "etld1", "query_count", sec("first_seen"), sec("last_seen"))


@query(f"""WITH {EV} SELECT name, CAST(epoch(date_trunc('hour', occurred_at)) AS BIGINT) AS hour,
count(*) AS query_count FROM dns_events GROUP BY 1, 2""")
def stream_window_rollup(spark, sf):
    """Bounded state: windows under a watermark, written as they close or change."""
    out = work_path(spark, "windows")
    hourly = streams.hourly_stream(_stream(spark, sf), "40 days").select(
        "name", "hour", "query_count")
    run = (hourly.writeStream.outputMode("update").trigger(availableNow=True)
           .option("checkpointLocation", f"{out}/c")
           .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/t/batch_id={n}"))
           .start())
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/t")
    latest = windows.latest_per(rows, ["name", "hour"], ["batch_id"])
    return latest.select("name", sec("hour"), "query_count")
