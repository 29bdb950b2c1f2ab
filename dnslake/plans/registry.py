"""Named queries over the driver tables, each beside SQL that gives the same rows.

The SQL is written in another form than the Spark code where there is a trick to check: EXISTS
against windows, plain range joins against buckets, recursion against rounds of joins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tuned(fn: Query) -> Query:
    """Run with the job settings (UTC times among them), whatever the session started with."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(tune(spark), sf)
    return run


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise KeyError(f"query {key} registered twice")
        QUERIES[key] = tuned(fn)
        if sql is not None:
            ORACLE[key] = " ".join(sql.split("\n")).strip()
        return fn
    return register


def sec(c: str) -> Column:
    """Timestamp as whole seconds, the form in which results are compared."""
    return F.unix_seconds(c).alias(c)


def six(c: str) -> Column:
    return F.round(c, 6).alias(c)


# Views of the adapters as SQL, to be put behind WITH.
EV = """dns_events AS (
  SELECT 'h' || k || '.' || event_type || '.example' AS name, event_type || '.example' AS etld1,
         user_id AS client_id, k, event_type, value, date_trunc('second', ts) AS occurred_at,
         CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 65 ELSE 15 END AS qtype
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events))"""
HOURLY = EV + """, hourly AS (
  SELECT name, date_trunc('hour', occurred_at) AS hour, count(*) AS query_count,
         count(DISTINCT client_id) AS client_count
  FROM dns_events GROUP BY 1, 2)"""
DOM = EV + """, dom AS (
  SELECT name, etld1, k, count(*) AS query_count, count(DISTINCT client_id) AS client_count,
         min(occurred_at) AS first_seen, max(occurred_at) AS last_seen,
         CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'staging' WHEN 2 THEN 'blocked'
                    WHEN 3 THEN 'allowed' ELSE 'ignored' END AS status,
         CASE event_type WHEN 'click' THEN 'ads' WHEN 'view' THEN 'tracking'
                         WHEN 'error' THEN 'telemetry' WHEN 'purchase' THEN 'content' END AS category,
         k % 11 = 0 AS is_manual,
         CASE WHEN k % 7 <> 0 THEN CAST((k * 13) % 120 AS DOUBLE) / 10 - 3 END AS score,
         CAST(k % 4 AS DOUBLE) / 4 AS confidence,
         CASE WHEN k % 5 = 1 THEN date_trunc('day', min(occurred_at)) END AS staged_at
  FROM dns_events GROUP BY name, etld1, k, event_type)"""
BOTH = HOURLY + ", dom AS" + DOM.split(", dom AS", 1)[1]
CATEGORIES = """cat(key, enabled, threshold, publish_path) AS (VALUES
  ('ads', true, 5.5::DOUBLE, 'ads.txt'), ('tracking', true, 5.5, 'tracking.txt'),
  ('telemetry', true, 5.5, 'telemetry.txt'), ('malware', true, 3.0, 'malware.txt'),
  ('cryptomining', true, 3.0, 'cryptomining.txt'), ('adult', false, 5.5, 'adult.txt'),
  ('cdn', false, 99.0, 'cdn.txt'), ('content', false, 99.0, 'content.txt'))"""
LE = """le AS (SELECT DISTINCT CAST(p_size % 8 AS BIGINT) AS source_id,
  p_brand || '/' || p_type || '/' || (p_partkey % 40) AS domain FROM part)"""
HOSTS = r"""hosts AS (SELECT page_id,
  lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)"""
ANS = DOM + """, ans AS (
  SELECT name, unnest([
           '10.' || (k % 25) || '.' || (client_id % 3) || '.' || (k % 7),
           '10.' || (k % 25) || '.' || (client_id % 3 + 3) || '.' || (k % 7)]) AS ip,
         client_id % 5 * 60 + 60 AS ttl, occurred_at
  FROM dns_events),
ips AS (SELECT *, CAST(split_part(ip, '.', 2) AS INT) AS octet FROM (
  SELECT name, ip, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen,
         count(*) AS hits, min(ttl) AS ttl FROM ans GROUP BY 1, 2)),
domain_ips AS (SELECT *, CASE WHEN octet % 5 = 4 THEN 'ZZ' END AS country,
  CASE WHEN octet % 3 = 0 THEN '10.' || octet || '.0.0/16' END AS threat,
  CASE WHEN octet % 3 = 0 THEN 'drop' END AS threat_source FROM ips)"""
REL = """cust AS (SELECT c_custkey AS c, c_nationkey AS n, 'c' || c_custkey || '.example' AS name
  FROM customer),
cname AS (SELECT name AS from_id, 'e' || n || '.edge.example' AS to_id FROM cust
  UNION SELECT 'e' || n || '.edge.example', 'n' || (n % 5) || '.net.example' FROM cust),
asn AS (SELECT name, CASE WHEN (c // 20) % 7 = 0 THEN 15169 WHEN (c // 20) % 5 = 0 THEN 64496
               ELSE c // 20 + 100000 END AS asn FROM cust),
same AS (SELECT a.name AS from_id, b.name AS to_id, a.asn FROM asn a JOIN asn b
  ON a.asn = b.asn AND a.name <> b.name WHERE a.asn <> 15169),
relations AS (SELECT from_id, to_id, 'cname_to' AS kind, 1.0::DOUBLE AS strength FROM cname
  UNION ALL SELECT from_id, to_id, 'same_asn', 1.0::DOUBLE FROM same),
rdom AS (SELECT name, CASE c % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'staging' ELSE 'blocked' END AS status,
  c_mktsegment AS category, c % 97 AS query_count
  FROM cust JOIN customer ON c = c_custkey)"""
RANGE = "BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00'"
