"""Addresses, networks, lists and threats."""

import gzip
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from dnslake.functions import nets
from dnslake.operators import investigate, joins, sweep
from dnslake.sources import lists


def frame(spark, values, name="value"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def key(text):
    ip = ipaddress.ip_address(text)
    return f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}"


def addresses(seed=5, n=120):
    rng = random.Random(seed)
    v4 = [str(ipaddress.IPv4Address(rng.choice([10 << 24, 104 << 24]) + rng.randrange(1 << 18)))
          for _ in range(n)]
    v6 = [str(ipaddress.IPv6Address((0x2606 << 112) + (rng.randrange(3) << 96)
                                    + (rng.randrange(4) << 80) + rng.randrange(1 << 20)))
          for _ in range(n)]
    return v4 + v6


def test_keys_and_text(spark):
    good = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "2606:4700::1111", "::1",
            "2001:0DB8:0:0:0:0:0:1", "::ffff:10.1.2.3"]
    bad = ["", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", "x::y", "a.b.c.d", None]
    rows = frame(spark, good + bad, "ip").select("ip", nets.ip_key("ip").alias("k")).withColumn(
        "t", nets.ip_text("k"))
    got = {r.ip: (r.k, r.t) for r in rows.collect()}
    for ip in good[:-1]:
        assert got[ip] == (key(ip), str(ipaddress.ip_address(ip)))
    assert got[good[-1]] == (key("10.1.2.3"), "10.1.2.3")
    assert all(got[b] == (None, None) for b in bad)


def test_mask_all_lengths(spark):
    rows = spark.createDataFrame([(ip, b) for ip in ("203.0.113.199", "2606:4700:ffff:1:2::9")
                                  for b in range(129)], "ip string, bits int")
    got = rows.select("ip", "bits", nets.mask_key(nets.ip_key("ip"), F.col("bits")).alias("m"))
    for r in got.collect():
        full = int(key(r.ip), 16)
        assert int(r.m, 16) == full >> (128 - r.bits) << (128 - r.bits)


def test_public_addresses(spark):
    private = ["10.1.1.1", "127.0.0.1", "169.254.1.1", "172.31.0.1", "192.168.1.1", "224.0.0.1",
               "0.0.0.0", "100.64.0.1", "192.0.2.1", "198.19.1.1", "203.0.113.9", "255.255.255.255",
               "::1", "::", "fe80::1", "ff02::1", "fd00::1", "2001:db8::1", "64:ff9b::1",
               "::ffff:10.0.0.1", "nonsense"]
    public = ["8.8.8.8", "89.91.5.6", "172.32.0.1", "2606:4700::1111", "100.128.0.1"]
    got = {r.ip: r.p for r in frame(spark, private + public, "ip").select(
        "ip", nets.is_public_ip(nets.ip_key("ip")).alias("p")).collect()}
    assert [i for i in private if got[i]] == [] and all(got[i] for i in public)


def test_nested_prefixes(spark):
    text = ["1.2.3.4", "2606:4700::1111", "89.90.0.0/16 # wide", "89.90.230.7/32 ; narrow", "# x",
            "; y", "", "10.0.0.0/7", "2000::/18", "2001:db8::5/19", "not an address", "89.90.9.9/33"]
    cidrs = lists.parse_cidr_list(frame(spark, text), "drop")
    seen = {(r.t, r.bits) for r in cidrs.withColumn(
        "t", nets.prefix_text("net_key", "bits")).collect()}
    assert seen == {("1.2.3.4/32", 128), ("2606:4700::1111/128", 128), ("89.90.0.0/16", 112),
                    ("89.90.230.7/32", 128), ("2001::/19", 19)}
    ips = nets.ips_of(frame(spark, ["89.90.230.7", "89.90.9.9", "1.2.3.4", "1.2.3.5",
                                    "2606:4700::1111", "2001:1f00::1", "x"], "ip"))
    hit = joins.longest_prefix_join(ips, cidrs).select(
        "ip", nets.prefix_text("net_key", "bits").alias("p"))
    assert {tuple(r) for r in hit.collect()} == {
        ("89.90.230.7", "89.90.230.7/32"), ("89.90.9.9", "89.90.0.0/16"), ("1.2.3.4", "1.2.3.4/32"),
        ("2606:4700::1111", "2606:4700::1111/128"), ("2001:1f00::1", "2001::/19")}


def test_first_list_wins_over_narrower_network(spark):
    a = lists.parse_cidr_list(frame(spark, ["89.90.0.0/16"]), "first", 0)
    b = lists.parse_cidr_list(frame(spark, ["89.90.1.0/24", "9.9.9.9"]), "second", 1)
    ips = nets.ips_of(frame(spark, ["89.90.1.1", "9.9.9.9"], "ip"))
    hit = joins.priority_prefix_join(ips, b.unionByName(a))
    assert {(r.ip, r.source) for r in hit.collect()} == {("89.90.1.1", "first"), ("9.9.9.9", "second")}


def test_ioc_csv(spark):
    text = ['# comment', '"2024-01-01", "1", "89.90.230.7:443", "ip:port", "a,b,c"',
            '"2024-01-01", "2", "[2606:4700::1111]:8080", "x"', '"t","3","2606:4700::2222","x"',
            '"t","4","evil.com:80"', 'short,row', '']
    got = lists.parse_ioc_csv(frame(spark, text), "ioc").select(nets.ip_text("net_key").alias("i"))
    assert {r.i for r in got.collect()} == {"89.90.230.7", "2606:4700::1111", "2606:4700::2222"}


@pytest.mark.parametrize("width", [1, 300, 70_000, 1 << 22])
def test_range_join_equals_search(spark, width):
    rng = random.Random(width)
    ranges, at = [], 10 << 24
    while len(ranges) < 60:
        size = rng.randrange(1, width + 1)
        ranges.append((key(str(ipaddress.IPv4Address(at))),
                       key(str(ipaddress.IPv4Address(at + size - 1))), len(ranges)))
        at += size + rng.randrange(0, 3) * width // 2
    base = 0x2606 << 112
    for j in range(40):
        size = rng.choice([1 << 16, 1 << 80, 1 << 97, 1 << 100])
        ranges.append((f"{base:032x}", f"{base + size - 1:032x}", 1000 + j))
        base += size
    ips = sorted(set(addresses(width, 200)))
    want = {(i, r) for i in ips for lo, hi, r in ranges if lo <= key(i) <= hi}
    table = spark.createDataFrame(ranges, "start_key string, end_key string, r int")
    rows = nets.ips_of(frame(spark, ips, "ip"))
    got = joins.range_join(rows, table).select("ip", "r")
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("slab_rows", [5, 40, 10_000])
def test_overlapping_ranges_over_slabs(spark, slab_rows):
    rng = random.Random(slab_rows)
    ips = sorted(set(addresses(slab_rows, 150)))
    keys = [key(i) for i in ips]
    ranges = [("0" * 32, "f" * 32, 0), (keys[0], keys[0], 1), (keys[9], keys[3], 2)]
    for r in range(3, 90):
        lo, hi = sorted(rng.sample(keys, 2)) if rng.random() < 0.7 else [rng.choice(keys)] * 2
        ranges.append((lo, hi, r))
    want = {(i, r) for i in ips for lo, hi, r in ranges if lo <= key(i) <= hi}
    table = spark.createDataFrame(ranges, "start_key string, end_key string, r int")
    rows = nets.ips_of(frame(spark, ips, "ip"))
    assert {tuple(r) for r in joins.range_join(rows, table, slab_rows=slab_rows).select("ip", "r").collect()} == want
    assert joins.range_join(rows, table.where("false")).count() == 0
    assert joins.range_join(rows, table.where("false"), "left").count() == len(ips)
    assert joins.range_join(rows.where("false"), table).count() == 0


def test_one_busy_network_is_cut_into_many_slabs(spark):
    ips = spark.range(20_000).selectExpr("concat(repeat('2', 28), lpad(lower(hex(id)), 4, '0')) AS ip_key")
    wide = spark.createDataFrame([("2" * 28 + "0000", "2" * 28 + "ffff", 1)], "start_key string, end_key string, r int")
    cuts = sweep.cut_points(ips.withColumnRenamed("ip_key", "key"), 1000)
    sizes = [r["count"] for r in ips.groupBy(sweep.slab_of(F.col("ip_key"), cuts).alias("s")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 4000 and sum(sizes) == 20_000
    assert joins.range_join(ips, wide, slab_rows=1000).count() == 20_000


def test_slab_is_a_binary_search(spark):
    cuts = [f"{i:032x}" for i in range(0, 300, 3)]
    rows = spark.range(310).select("id", sweep.slab_of(F.lpad(F.lower(F.hex("id")), 32, "0"), cuts).alias("s")).collect()
    assert all(r.s == min(100, r.id // 3 + 1) for r in rows)


def test_layers():
    import numpy as np
    start = np.array([0, 1, 1, 3, 5])
    end = np.array([4, 2, 2, 3, 6])
    assert [layer.tolist() for layer in sweep.layers(start, end)] == [[0, 4], [1, 3], [2]]
    assert sweep.layers(start[:0], end[:0]) == []


def test_prefixes_of_every_length(spark):
    rng = random.Random(3)
    ips = sorted(set(addresses(3, 120)))
    networks = {ipaddress.ip_network((i, b), strict=False) for i in ips[::2]
                for b in ((rng.randrange(0, 33), 7) if ":" not in i else (rng.randrange(1, 129), 16))}
    def row(n):
        v4 = n.version == 4
        return (f"{int(n.network_address) + ((0xffff << 32) if v4 else 0):032x}", n.prefixlen + (96 if v4 else 0), str(n), len(str(n)) % 3)
    table = spark.createDataFrame([row(n) for n in networks], "net_key string, bits int, source string, priority int")
    rows = nets.ips_of(frame(spark, ips, "ip"))
    held = {i: [n for n in networks if ipaddress.ip_address(i) in n] for i in ips}
    for slab_rows in (20, 10_000):
        got = joins.longest_prefix_join(rows, table, slab_rows=slab_rows).select("ip", "source")
        assert {tuple(r) for r in got.collect()} == {
            (i, str(max(h, key=lambda n: n.prefixlen))) for i, h in held.items() if h}
        got = joins.priority_prefix_join(rows, table, slab_rows=slab_rows).select("ip", "source")
        assert {tuple(r) for r in got.collect()} == {
            (i, str(min(h, key=lambda n: (len(str(n)) % 3, -n.prefixlen)))) for i, h in held.items() if h}


def test_v6_text_equals_the_library(spark):
    rng = random.Random(11)
    texts = ["::", "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:2:3:4:5:6:7", ":1:2",
             "::01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "FE80::ABCD", "12345::", "1:2:3:4:5:6:7:8:9",
             "", "a:", "1::2:3:4:5:6:7:8", "1.2.3.4::", "0:0:1:0:0:1:0:0", "1:0:0:2:0:0:0:3", " ::1"]
    texts += ["".join(rng.choice("0123456789abcdef::::.F%") for _ in range(rng.randint(2, 24))) for _ in range(1000)]
    for _ in range(1000):
        mask = sum(0xffff << 16 * g for g in range(8) if rng.random() < 0.5)
        address = ipaddress.IPv6Address(rng.getrandbits(128) & ~mask)
        texts.append(rng.choice([str(address), address.exploded, str(address).upper()]))
    for r in frame(spark, texts, "t").select("t", nets.ip_key("t").alias("k"), nets.ip_text(nets.ip_key("t")).alias("x")).collect():
        try:
            value = ipaddress.IPv6Address(r.t.split("%")[0]) if ":" in r.t else None
        except ValueError:
            value = None
        assert r.k == (None if value is None else f"{int(value):032x}"), r.t
        assert r.x == (None if value is None else str(value.ipv4_mapped or value)), r.t


def test_longest_prefix_equals_search(spark):
    rng = random.Random(9)
    ips = sorted(set(addresses(9, 150)))
    nets_ = {ipaddress.ip_network((i, rng.randrange(8, 33) if ":" not in i else rng.randrange(19, 129)),
                                  strict=False) for i in rng.sample(ips, 60)}
    cidrs = lists.parse_cidr_list(frame(spark, [str(n) for n in nets_]), "x")
    got = joins.longest_prefix_join(nets.ips_of(frame(spark, ips, "ip")), cidrs).select(
        "ip", nets.prefix_text("net_key", "bits").alias("p"))
    want = set()
    for i in ips:
        hits = [n for n in nets_ if ipaddress.ip_address(i) in n]
        if hits:
            want.add((i, str(max(hits, key=lambda n: n.prefixlen))))
    assert {tuple(r) for r in got.collect()} == want


RANGES = ["89.80.0.0\t89.95.255.255\t13335\tUS\tNET ONE", "1.0.0.0\t1.0.0.255\t0\tNone\tx",
          "2606:4700::\t2606:4700:ffff:ffff:ffff:ffff:ffff:ffff\t13335\tUS\tNET ONE", "short\trow"]
IPS = ("name string, ip string, last_seen timestamp, asn long, country string, org string, "
       "threat string, threat_source string")


def test_geo_fill_marks_unknown_addresses_done(spark):
    ranges = lists.parse_ip_ranges(frame(spark, RANGES))
    rows = spark.createDataFrame([("a", "89.91.5.6") + (None,) * 6, ("b", "203.0.113.9") + (None,) * 6,
                                  ("c", "2606:4700::1111") + (None,) * 6], IPS)
    done = investigate.fill_geo(rows, ranges)
    assert {(r.ip, r.asn, r.country) for r in done.collect()} == {
        ("89.91.5.6", 13335, "US"), ("203.0.113.9", 0, ""), ("2606:4700::1111", 13335, "US")}
    assert investigate.pending_geo(done).isEmpty()


def test_threat_scan_sets_moves_and_clears(spark):
    rows = spark.createDataFrame([
        ("a", "89.90.230.7", None, None, None, None, None, None),
        ("b", "89.90.230.7", None, None, None, None, None, None),
        ("c", "1.1.1.1", None, None, None, None, "1.1.1.0/24", "old"),
        ("d", "9.9.9.9", None, None, None, None, "9.9.9.9/32", "old"),
        ("e", "8.8.8.8", None, None, None, None, None, None)], IPS)
    now = lists.parse_cidr_list(frame(spark, ["89.90.0.0/16", "9.9.9.9"]), "drop")
    state, changes, alerts = investigate.scan_threats(rows, now)
    assert {tuple(r) for r in changes.collect()} == {
        ("89.90.230.7", "89.90.0.0/16", "drop"), ("1.1.1.1", "", ""), ("9.9.9.9", "9.9.9.9/32", "drop")}
    assert [r.ip for r in alerts.collect()] == ["89.90.230.7"]
    written = investigate.set_threats(rows, changes)
    assert {(r.name, r.threat, r.threat_source) for r in written.collect()} == {
        ("a", "89.90.0.0/16", "drop"), ("b", "89.90.0.0/16", "drop"), ("c", None, None),
        ("d", "9.9.9.9/32", "drop"), ("e", None, None)}
    _, again, _ = investigate.scan_threats(written, now)
    assert again.isEmpty()


# Lists of names ----------------------------------------------------------------------------------

HOSTS = ["# Title", "127.0.0.1 localhost", "0.0.0.0 Ads.Example.com # note", "0.0.0.0\ttrack.vn.",
         "ads.example.com", "0.0.0.0 bad_label..x", ""]
ADBLOCK = ["! title", "||ads.example.com^", "||track.vn^$third-party", "||path.vn/x", "@@||ok.vn^",
           "example.com##.ad"]
PLAIN = ["ads.example.com", "track.vn # note", "# c", "nodot"]
ERROR_PAGE = ["<!DOCTYPE html>", "<html><body>", "<h1>404 Not Found</h1>", "</body></html>"]


@pytest.mark.parametrize("text,fmt,want", [
    (HOSTS, "hosts", {"ads.example.com", "track.vn"}),
    (ADBLOCK, "adblock", {"ads.example.com", "track.vn", "path.vn"}),
    (PLAIN, "plain", {"ads.example.com", "track.vn"}),
    (ERROR_PAGE, "hosts", set()), (ERROR_PAGE, "adblock", set()), (ERROR_PAGE, "plain", set())])
def test_blocklists(spark, text, fmt, want):
    rows = lists.parse_blocklist(frame(spark, text), fmt, 7).collect()
    assert len(rows) == len(want) and {r.domain for r in rows} == want


def test_tables_without_rows_are_refused(spark, tmp_path):
    page = tmp_path / "page.txt"
    page.write_text("\n".join(ERROR_PAGE))
    for read in (lists.read_ip_ranges, lists.read_rank):
        with pytest.raises(lists.EmptyTable):
            read(spark, str(page))
    with pytest.raises(lists.EmptyTable):
        lists.read_cidr_list(spark, str(page), "x")
    other = tmp_path / "rank.csv"
    other.write_text("1,nobody.vn\n2,knows.vn\n")
    with pytest.raises(lists.EmptyTable):
        lists.read_rank(spark, str(other))
    other.write_text("1,google.com\r\n2,Knows.VN\nx,y\n60000,far.vn\n")
    assert {tuple(r) for r in lists.read_rank(spark, str(other)).collect()} == {
        ("google.com", 1), ("knows.vn", 2), ("far.vn", 60000)}
    assert {tuple(r) for r in lists.read_rank(spark, str(other), 50_000).collect()} == {
        ("google.com", 1), ("knows.vn", 2)}


def test_plain_and_gzip_give_the_same_lines(spark, tmp_path):
    body = "\n".join(RANGES)
    (tmp_path / "a.tsv").write_text(body)
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(body)
    assert lists.read_ip_ranges(spark, str(tmp_path / "a.tsv")).count() == 2
    assert lists.read_ip_ranges(spark, str(tmp_path / "b.tsv.gz")).count() == 2


def test_replace_entries_leaves_other_sources(spark, tmp_path):
    path = str(tmp_path / "entries")
    schema = "source_id int, domain string"
    first = spark.createDataFrame([(1, "a.vn"), (1, "b.vn"), (2, "c.vn")], schema)
    lists.replace_entries(first, path)
    counts = lists.replace_entries(spark.createDataFrame([(1, "z.vn")], schema), path, first).collect()
    assert [(r.source_id, r.new_count, r.prev_count) for r in counts] == [(1, 1, 2)]
    assert {(r.source_id, r.domain) for r in spark.read.parquet(path).collect()} == {
        (1, "z.vn"), (2, "c.vn")}
