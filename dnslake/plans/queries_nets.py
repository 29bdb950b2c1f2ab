"""Queries about addresses, networks, threats and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslake.functions import nets
from dnslake.operators import behavior, investigate, joins
from dnslake.plans import adapters as A
from dnslake.plans.queries_log import CV
from dnslake.plans.registry import ANS, DOM, EV, RANGE, query, sec
from dnslake.session import work_path
from dnslake.sources import lists, tables
from dnslake.sources.events import stream_events
from dnslake.streaming import streams

CUST = """c AS (SELECT c_custkey, c_custkey % 25 AS n, (c_custkey % 1024) // 256 AS third,
  '10.' || (c_custkey % 25) || '.' || ((c_custkey % 1024) // 256) || '.' || (c_custkey % 256) AS ip
  FROM customer)"""
NETS = """net AS (SELECT n_nationkey AS n, 16 AS bits, '10.' || n_nationkey || '.0.0/16' AS p,
  'drop' AS source, 0 AS priority FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 24, '10.' || n_nationkey || '.1.0/24', 'ioc', 1 FROM nation
  WHERE n_nationkey % 4 = 0)"""


@query(f"""WITH {CUST} SELECT c_custkey, ip, lower(hex((10::BIGINT << 24) + n * 65536
+ c_custkey % 1024)) AS tail FROM c""")
def address_keys(spark, sf):
    ips = A.customer_ips(spark, sf).withColumn("key", nets.ip_key("ip", allow_v6=False))
    return ips.select("c_custkey", nets.ip_text("key", allow_v6=False).alias("ip"),
                      F.ltrim(F.regexp_replace("key", "^0{20}ffff0?", "")).alias("tail"))


@query("""SELECT c_custkey, '2001:db8:' || lower(to_hex(c_custkey % 65535 + 1)) || '::'
|| lower(to_hex(c_nationkey + 1)) AS ip, '2001:db8::/32' AS net FROM customer""")
def address_keys_v6(spark, sf):
    """IPv6 text in long upper-case form, made canonical and masked."""
    long = F.concat(F.lit("2001:0DB8:"), F.hex(F.col("c_custkey") % 65535 + 1), F.lit(":0:0:0:0:"),
                    F.hex((F.col("c_nationkey") + 1).cast("long")))
    key = A.table(spark, sf, "customer").select("c_custkey", nets.ip_key(long).alias("key"))
    masked = key.withColumn("net_key", nets.mask_key("key", 32))
    return masked.select("c_custkey", nets.ip_text("key").alias("ip"),
                         nets.prefix_text("net_key", F.lit(32)).alias("net"))


@query("""WITH a AS (SELECT c_custkey, c_custkey % 256 AS o FROM customer)
SELECT o, count(*) AS n, o NOT IN (0, 10, 100, 127) AND o < 224 AS public FROM a GROUP BY 1""")
def public_addresses(spark, sf):
    o = F.col("c_custkey") % 256
    rows = A.table(spark, sf, "customer").select(
        o.alias("o"), F.concat(o.cast("string"), F.when(o == 0, ".0.0.0").otherwise(".77.0.1"))
        .alias("ip"))
    return (rows.withColumn("public", nets.is_public_ip(nets.ip_key("ip", allow_v6=False)))
            .groupBy("o", "public").agg(F.count("*").alias("n")))


@query(f"""WITH {CUST}, {NETS} SELECT c_custkey, ip, arg_max(p, bits) AS net,
arg_max(source, bits) AS source FROM c JOIN net USING (n)
WHERE bits = 16 OR third = 1 GROUP BY 1, 2""")
def longest_prefix(spark, sf):
    ips = A.customer_ips(spark, sf).withColumn("ip_key", nets.ip_key("ip", allow_v6=False))
    hit = joins.longest_prefix_join(ips, A.threat_lists(spark, sf))
    return hit.select("c_custkey", "ip", nets.prefix_text("net_key", "bits", False).alias("net"),
                      "source")


@query(f"""WITH {CUST}, {NETS} SELECT c_custkey, ip, arg_min(p, priority) AS net,
arg_min(source, priority) AS source FROM c JOIN net USING (n)
WHERE bits = 16 OR third = 1 GROUP BY 1, 2""")
def priority_prefix(spark, sf):
    ips = A.customer_ips(spark, sf).withColumn("ip_key", nets.ip_key("ip", allow_v6=False))
    hit = joins.priority_prefix_join(ips, A.threat_lists(spark, sf))
    return hit.select("c_custkey", "ip", nets.prefix_text("net_key", "bits", False).alias("net"),
                      "source")


@query(f"""WITH {CUST} SELECT c_custkey, ip, CAST(64500 + n AS BIGINT) AS asn,
upper(n_name[:2]) AS country, n_name AS org FROM c JOIN nation ON n_nationkey = n
WHERE n % 5 <> 0""")
def range_lookup(spark, sf):
    ips = A.customer_ips(spark, sf).withColumn("ip_key", nets.ip_key("ip", allow_v6=False))
    return joins.range_join(ips, A.ip_ranges(spark, sf)).select(
        "c_custkey", "ip", "asn", "country", "org")


@query(f"""WITH {EV}, q AS (SELECT k % 4096 * 65537 + user_id AS v FROM (SELECT *,
CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)),
r AS (SELECT p_partkey AS id, p_partkey * 3000 AS lo, p_partkey * 3000 + 100 * p_size AS hi FROM part)
SELECT id, count(*) AS n FROM q JOIN r ON v BETWEEN lo AND hi GROUP BY 1""")
def range_join_many(spark, sf):
    """Ranges of many widths against the event values taken as addresses."""
    v = F.col("k") % 4096 * 65537 + F.col("client_id")
    ips = A.events(spark, sf).select(nets.ip_key(nets.v4_text(v), False).alias("ip_key"))
    lo = F.col("p_partkey") * 3000
    ranges = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), nets.ip_key(nets.v4_text(lo), False).alias("start_key"),
        nets.ip_key(nets.v4_text(lo + F.col("p_size") * 100), False).alias("end_key"))
    return joins.range_join(ips, ranges).groupBy("id").agg(F.count("*").alias("n"))


_SIX = """v AS (SELECT c_custkey, c_custkey % 65535 + 1 AS v,
'2001:db8:' || lower(to_hex(c_custkey % 65535 + 1)) || '::' || lower(to_hex(c_nationkey + 1)) AS ip FROM customer)"""


def _six(spark, sf):
    """One v6 address per customer."""
    def digits(n):
        return F.lower(F.hex(n.cast("long")))
    return A.table(spark, sf, "customer").select("c_custkey", F.concat(
        F.lit("2001:db8:"), digits(F.col("c_custkey") % 65535 + 1), F.lit("::"), digits(F.col("c_nationkey") + 1)).alias("ip"))


@query(f"""WITH {_SIX} SELECT c_custkey, ip, CAST(p_partkey AS BIGINT) AS asn, 'ZZ' AS country FROM v
JOIN part ON p_partkey = v // 8 AND v % 8 BETWEEN 2 AND 5 WHERE p_partkey > 0""")
def range_lookup_v6(spark, sf):
    """A table of v6 ranges, each half of eight /48 networks."""
    start = F.lower(F.hex((F.col("p_partkey") * 8 + 2).cast("long")))
    end = F.lower(F.hex((F.col("p_partkey") * 8 + 5).cast("long")))
    lines = A.table(spark, sf, "part").where("p_partkey * 8 < 65536").select(F.concat_ws(
        "\t", F.concat(F.lit("2001:db8:"), start, F.lit("::")),
        F.concat(F.lit("2001:DB8:"), end, F.lit(":ffff:ffff:ffff:ffff:ffff")), F.col("p_partkey").cast("string"),
        F.lit("ZZ"), F.lit("org")).alias("value"))
    ips = _six(spark, sf).withColumn("ip_key", nets.ip_key("ip"))
    return joins.range_join(ips, lists.parse_ip_ranges(lines)).select("c_custkey", "ip", "asn", "country")


_SIX_NETS = f"""{_SIX}, hit AS (SELECT c_custkey, ip, v, v // 256 AS wide, v % 10 = 0 AS narrow FROM v)
SELECT c_custkey, ip, CASE WHEN narrow THEN '2001:db8:' || lower(to_hex(v)) || '::/48'
WHEN wide > 0 THEN '2001:db8:' || lower(to_hex(wide * 256)) || '::/40' ELSE '2001:db8::/32' END AS net"""


def _six_lists(spark, sf):
    lines = A.table(spark, sf, "customer").select((F.col("c_custkey") % 65535 + 1).alias("v"))
    wide = lines.select(F.floor(F.col("v") / 256).alias("w")).where("w > 0").distinct().select(F.concat(
        F.lit("2001:db8:"), F.lower(F.hex(F.col("w") * 256)), F.lit("::/40 ; wide")).alias("value"))
    narrow = lines.where("v % 10 = 0").distinct().select(F.concat(
        F.lit("2001:db8:"), F.lower(F.hex("v")), F.lit("::/48")).alias("value"))
    all_ = spark.range(1).select(F.lit("2001:db8::/32").alias("value"))
    first = lists.parse_cidr_list(wide.unionByName(narrow), "drop", 0)
    return first.unionByName(lists.parse_cidr_list(all_, "base", 1))


@query(f"WITH {_SIX_NETS}, CASE WHEN narrow OR wide > 0 THEN 'drop' ELSE 'base' END AS source FROM hit")
def longest_prefix_v6(spark, sf):
    ips = _six(spark, sf).withColumn("ip_key", nets.ip_key("ip"))
    hit = joins.longest_prefix_join(ips, _six_lists(spark, sf))
    return hit.select("c_custkey", "ip", nets.prefix_text("net_key", "bits").alias("net"), "source")


@query(f"WITH {_SIX_NETS}, CASE WHEN narrow OR wide > 0 THEN 'drop' ELSE 'base' END AS source FROM hit")
def priority_prefix_v6(spark, sf):
    ips = _six(spark, sf).withColumn("ip_key", nets.ip_key("ip"))
    hit = joins.priority_prefix_join(ips, _six_lists(spark, sf))
    return hit.select("c_custkey", "ip", nets.prefix_text("net_key", "bits").alias("net"), "source")


# Resolutions -------------------------------------------------------------------------------------


@query(f"""WITH {ANS} SELECT name, ip, CAST(epoch(first_seen) AS BIGINT) AS first_seen,
CAST(epoch(last_seen) AS BIGINT) AS last_seen, hits, ttl FROM ips JOIN dom USING (name)
WHERE status <> 'ignored'""".replace("first_seen AS BIGINT", "ips.first_seen AS BIGINT")
       .replace("epoch(first_seen)", "epoch(ips.first_seen)")
       .replace("epoch(last_seen)", "epoch(ips.last_seen)"))
def resolution_rollup(spark, sf):
    known = A.domains(spark, sf).where(F.col("status") != "ignored")
    return investigate.resolution_rollup(A.answers(spark, sf), known).select(
        "name", "ip", sec("first_seen"), sec("last_seen"), "hits", "ttl")


@query(f"""WITH {ANS} SELECT name, ip, CAST(epoch(first_seen) AS BIGINT) AS first_seen,
CAST(epoch(last_seen) AS BIGINT) AS last_seen, hits, ttl FROM ips""")
def merged_resolutions(spark, sf):
    a = A.answers(spark, sf)
    half = F.lit("2024-01-15").cast("timestamp")
    parts = [investigate.resolution_rollup(a.where(c)) for c in (
        F.col("occurred_at") < half, F.col("occurred_at") >= half)]
    return investigate.merge_resolutions(*parts).select(
        "name", "ip", sec("first_seen"), sec("last_seen"), "hits", "ttl")


@query(f"""WITH {ANS} SELECT name, CAST(epoch(ips.first_seen) AS BIGINT) AS first_seen,
CAST(epoch(ips.last_seen) AS BIGINT) AS last_seen, hits, status FROM ips JOIN dom USING (name)
WHERE ip = '10.2.1.2' ORDER BY ips.last_seen DESC, name LIMIT 200""")
def domains_by_ip(spark, sf):
    return investigate.domains_by_ip(A.domain_ips(spark, sf), A.domains(spark, sf),
                                     "10.2.1.2").select(
        "name", sec("first_seen"), sec("last_seen"), "hits", "status")


@query(f"""WITH {ANS} SELECT ip, hits FROM ips WHERE name = 'h2.click.example'
ORDER BY last_seen DESC, ip LIMIT 200""")
def ips_by_domain(spark, sf):
    return investigate.ips_by_domain(A.domain_ips(spark, sf), "h2.click.example").select(
        "ip", "hits")


@query(f"""WITH {ANS} SELECT ip, count(*) AS n FROM ips i JOIN dns_events e ON e.name = i.name
AND e.occurred_at >= i.first_seen AND e.occurred_at <= i.last_seen GROUP BY 1""")
def accesses_per_ip(spark, sf):
    rows = investigate.access_rows(A.domain_ips(spark, sf), A.events(spark, sf))
    return rows.groupBy("ip").agg(F.count("*").alias("n"))


@query(f"""WITH {ANS} SELECT client_id, e.name, CAST(epoch(occurred_at) AS BIGINT) AS occurred_at
FROM ips i JOIN dns_events e ON e.name = i.name AND e.occurred_at BETWEEN i.first_seen AND i.last_seen
WHERE ip = '10.2.1.2' ORDER BY e.occurred_at DESC, e.name, client_id LIMIT 200""")
def accesses_by_ip(spark, sf):
    return investigate.accesses_by_ip(A.domain_ips(spark, sf), A.events(spark, sf),
                                      "10.2.1.2").select("client_id", "name", sec("occurred_at"))


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY""")
def interval_join(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).alias("end"))
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return joins.interval_join(li, o, ["l_orderkey"], "l_shipdate", "start", "end").select(
        "l_orderkey", "l_linenumber")


@query(f"""WITH {ANS} SELECT ip, coalesce(max(threat), '') AS threat,
coalesce(arg_max(threat_source, threat), '') AS source FROM domain_ips GROUP BY 1""")
def ip_threat_state(spark, sf):
    return investigate.ip_threat_state(A.domain_ips(spark, sf))


@query(f"""WITH {ANS} SELECT ip, CAST(epoch(max(last_seen)) AS BIGINT) AS last_seen FROM domain_ips
WHERE country IS NULL GROUP BY 1""")
def pending_geo(spark, sf):
    return investigate.pending_geo(A.domain_ips(spark, sf)).select("ip", sec("last_seen"))


@query(f"""WITH {ANS}, g AS (SELECT *, CAST(split_part(ip, '.', 3) AS INT) <= 3 AND octet % 5 <> 0
AS located FROM domain_ips)
SELECT name, ip, CASE WHEN country IS NULL THEN CAST(CASE WHEN located THEN octet + 64500 ELSE 0 END
AS BIGINT) END AS asn, coalesce(country, CASE WHEN located THEN upper(n_name[:2]) ELSE '' END)
AS country FROM g JOIN nation ON n_nationkey = octet""")
def fill_geo(spark, sf):
    return investigate.fill_geo(A.domain_ips(spark, sf), A.ip_ranges(spark, sf),
                                allow_v6=False).select("name", "ip", "asn", "country")


@query("""SELECT 'c' || c_custkey AS name, CAST(64500 + c_custkey % 25 AS BIGINT) AS asn
FROM customer WHERE c_custkey % 25 % 5 <> 0 AND c_custkey % 3 <> 0""")
def asn_facts(spark, sf):
    c = A.customer_ips(spark, sf)
    dns = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"),
                   F.when(F.col("c_custkey") % 3 != 0, F.array("ip", F.lit("8.8.8.8")))
                   .otherwise(F.array().cast("array<string>")).alias("a"))
    return investigate.asn_facts(dns, A.ip_ranges(spark, sf), allow_v6=False).select("name", "asn")


SCAN = f"""WITH {ANS}, st AS (SELECT ip, any_value(octet) AS o, coalesce(max(threat), '') AS was,
coalesce(max(threat_source), '') AS was_source FROM domain_ips GROUP BY 1),
now AS (SELECT ip, was, was_source, CASE WHEN o % 2 = 0 THEN '10.' || o || '.0.0/16' ELSE '' END AS threat,
CASE WHEN o % 2 = 0 THEN 'drop' ELSE '' END AS source FROM st)"""


@query(f"{SCAN} SELECT ip, threat, source FROM now WHERE threat <> was OR source <> was_source")
def threat_changes(spark, sf):
    _, changes, _ = investigate.scan_threats(A.domain_ips(spark, sf), A.threat_lists(spark, sf))
    return changes


@query(f"{SCAN} SELECT ip, threat, source FROM now WHERE threat <> was AND threat <> ''")
def threat_alerts(spark, sf):
    _, _, alerts = investigate.scan_threats(A.domain_ips(spark, sf), A.threat_lists(spark, sf))
    return alerts


@query(f"{SCAN} SELECT name, d.ip, nullif(n.threat, '') AS threat, nullif(n.source, '') AS threat_source "
       "FROM domain_ips d JOIN now n USING (ip)")
def threats_written(spark, sf):
    d = A.domain_ips(spark, sf)
    _, changes, _ = investigate.scan_threats(d, A.threat_lists(spark, sf))
    return investigate.set_threats(d, changes).select("name", "ip", "threat", "threat_source")


@query(f"""WITH {ANS}, cv AS ({CV}) SELECT name, ip, threat, status,
coalesce(interval_cv, 0) > 0 AND coalesce(interval_cv, 0) < 0.35 AS beacon
FROM domain_ips i JOIN dom USING (name) LEFT JOIN cv USING (name) WHERE threat IS NOT NULL
ORDER BY i.last_seen DESC, name, ip LIMIT 200""")
def threat_matches(spark, sf):
    b = behavior.interval_cv(A.events(spark, sf))
    return investigate.threat_matches(A.domain_ips(spark, sf), A.domains(spark, sf), b).select(
        "name", "ip", "threat", "status", "beacon")


# Exports -----------------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT client_id AS client, name AS domain, qtype,
CAST(epoch(occurred_at) AS BIGINT) AS at FROM dns_events WHERE occurred_at {RANGE}"""
       .replace(" AS at FROM", ' AS "at" FROM'))
def export_queries(spark, sf):
    return investigate.export_queries(A.events(spark, sf), A.FROM, A.TO).withColumn("at", sec("at"))


@query(f"""WITH {ANS} SELECT name AS domain, ip, hits, ttl, CAST(0 AS BIGINT) AS asn,
coalesce(country, '') AS country, coalesce(threat, '') AS threat FROM domain_ips
WHERE last_seen >= TIMESTAMP '2024-01-05 00:00:00' AND first_seen <= TIMESTAMP '2024-01-20 23:00:00'""")
def export_resolutions(spark, sf):
    return investigate.export_resolutions(A.domain_ips(spark, sf), A.FROM, A.TO).select(
        "domain", "ip", "hits", "ttl", "asn", "country", "threat")


@query(f"""WITH {ANS} SELECT 'queries' AS file, count(*) AS rows FROM dns_events
WHERE occurred_at {RANGE} UNION ALL SELECT 'resolutions', count(*) FROM domain_ips
WHERE last_seen >= TIMESTAMP '2024-01-05 00:00:00' AND first_seen <= TIMESTAMP '2024-01-20 23:00:00'""")
def export_manifest(spark, sf):
    return tables.export_manifest(
        investigate.export_queries(A.events(spark, sf), A.FROM, A.TO),
        investigate.export_resolutions(A.domain_ips(spark, sf), A.FROM, A.TO),
        A.FROM, A.TO).select("file", "rows")


# Files -------------------------------------------------------------------------------------------


@query("""SELECT 10 AS octet, count(*) AS n FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 172, count(*) FROM part WHERE p_partkey % 3 = 1""")
def cidr_list(spark, sf):
    """A list with bare addresses, networks with host bits, comments and too wide networks."""
    k = F.col("p_partkey")
    tail = F.concat((F.floor(k / 200) % 256).cast("string"), F.lit("."), (k % 200).cast("string"))
    line = (F.when(k % 3 == 0, F.concat(F.lit("10.1."), tail, F.lit(" ; note")))
            .when(k % 3 == 1, F.concat(F.lit("172."), tail, F.lit(".77/24 # note")))
            .otherwise(F.lit("10.0.0.0/7")))
    parsed = lists.parse_cidr_list(A.table(spark, sf, "part").select(line.alias("value")), "x",
                                   allow_v6=False)
    octet = F.shiftright(nets.v4_of_key("net_key"), 24).cast("int")
    return parsed.groupBy(octet.alias("octet")).agg(F.count("*").alias("n"))


@query(f"""WITH {ANS} SELECT name, ip, hits, ttl, CAST(epoch(first_seen) AS BIGINT) AS first_seen
FROM ips""")
def stream_resolutions(spark, sf):
    """The answer stream as its own query, drained and read back through the merge."""
    raw = stream_events(spark, sf, A.DRIVER_TABLES["events"], glob="events.parquet")
    out = work_path(spark, "answers")
    answers = A.answers_of(A.from_raw_events(raw))
    streams.start_answer_stream(answers, f"{out}/t", f"{out}/c").awaitTermination()
    return streams.read_resolutions(spark, f"{out}/t").select("name", "ip", "hits", "ttl",
                                                              sec("first_seen"))


@query(f"""WITH {DOM} SELECT name, query_count FROM dom WHERE status IN ('new', 'staging')
AND (k % 6 NOT IN (1, 2) OR k % 7 = 0)""")
def names_needing_fact(spark, sf):
    open_ = A.domains(spark, sf).where(F.col("status").isin("new", "staging"))
    return joins.needs_fact(open_, A.facts(spark, sf), "asn", A.AS_OF).select("name",
                                                                             "query_count")
