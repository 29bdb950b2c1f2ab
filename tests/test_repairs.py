"""Cases that were once answered wrongly."""

from datetime import datetime, timedelta

from dnslake.functions.names import suffix_match
from dnslake.functions.nets import ip_key
from dnslake.operators import joins, relate, search
from dnslake.plans import adapters, lifecycle


def test_rare_names_still_pair(spark):
    at = datetime(2026, 3, 1)
    rows = [("a.example", 1, at)] + [("b.example", 1, at + timedelta(seconds=i)) for i in (1, 2, 3)]
    log = spark.createDataFrame(rows, "name string, client_id long, occurred_at timestamp")
    assert [tuple(r) for r in relate.co_occurrence_counts(log, gap=3).collect()] == [("a.example", "b.example", 3)]


def test_whole_rows_win(spark):
    hosts = spark.createDataFrame([("x.ads.example",)], "host string")
    table = spark.createDataFrame([("ads.example", "ads", 2), ("ads.example", "tracking", 1)], "suffix string, kind string, weight int")
    assert [tuple(r) for r in suffix_match(hosts, table).collect()] == [("x.ads.example", "ads.example", "ads", 2)]
    ips = spark.createDataFrame([("198.51.100.7",)], "ip string").select(ip_key("ip").alias("ip_key"))
    net = ips.selectExpr("ip_key AS net_key", "128 AS bits")
    lists = net.selectExpr("*", "'zeta' AS source", "0 AS priority").unionByName(net.selectExpr("*", "'alpha' AS source", "1 AS priority"))
    got = joins.longest_prefix_join(ips, lists).select("source", "priority").collect()
    assert [tuple(r) for r in got] == [("alpha", 1)]


def test_pattern_keeps_its_case(spark):
    names = spark.createDataFrame([("abc.example",), ("a1.example",)], "name string")
    assert [r.name for r in search.search(names, r"/^\D+$/").collect()] == ["abc.example"]
    assert [r.name for r in search.search(names, "ABC").collect()] == ["abc.example"]


def test_imported_names_know_their_root(spark):
    empty = adapters.domains(spark, "/root/testdata/sf0.001").limit(0)
    out, _, _ = lifecycle.import_hosts(empty, spark.createDataFrame([("ads.track.co.uk",)], "domain string"), "admin",
                                       "2026-03-01 00:00:00", category="ads")
    assert [(r.etld1, r.category) for r in out.collect()] == [("track.co.uk", "ads")]
