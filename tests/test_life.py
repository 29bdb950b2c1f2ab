"""Lifecycle, publishing and the relation graph."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dnslake.operators import networks, relate, search
from dnslake.plans import lifecycle as L
from dnslake.plans import publish as P
from dnslake.sources import tables

AS_OF = "2026-03-01 00:00:00"
NOW = datetime(2026, 3, 1)
SCHEMA = ("name string, etld1 string, status string, is_manual boolean, category string, "
          "score double, confidence double, query_count long, last_seen timestamp, "
          "staged_at timestamp, blocked_at timestamp, origin string, first_seen timestamp")
SIGNALS = "name string, score double, confidence double, category string, " \
          "signals array<struct<kind string, weight double, detail string>>"


def domain(name, status="new", manual=False, category=None, score=None, last=NOW, staged=None):
    return (name, name, status, manual, category, score, None, 1, last, staged, None, "discovered", last)


def domains(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def status_of(df):
    return {r.name: r.status for r in df.collect()}


def scored(spark, *rows):
    return spark.createDataFrame([(n, s, 0.9, c, []) for n, s, c in rows], SIGNALS)


def request(name, action, manual=True, category=None, seq=1):
    return (name, action, "admin", "why", category, manual, seq)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, action string, actor string, "
                                 "reason string, category string, manual boolean, seq long")


@pytest.fixture(scope="module")
def categories(spark):
    return P.category_table(spark)


def test_scores_stage_release_and_respect_manual(spark, categories):
    d = domains(spark, domain("up"), domain("low"), domain("back", "staging"), domain("stay", "staging"),
                domain("manual", manual=True), domain("cdn"), domain("blocked", "blocked"),
                domain("other"))
    s = scored(spark, ("up", 5.5, "ads"), ("low", 5.4, "ads"), ("back", 5.0, "ads"),
               ("stay", 3.0, "malware"), ("manual", 9.0, "ads"), ("cdn", 99.0, "cdn"),
               ("blocked", 0.0, "ads"))
    out, decisions = L.save_scores(d, s, categories, AS_OF)
    assert status_of(out) == {"up": "staging", "low": "new", "back": "new", "stay": "staging",
                              "manual": "new", "cdn": "new", "blocked": "blocked", "other": "new"}
    assert {(r.name, r.action, r.reason) for r in decisions.collect()} == {
        ("up", "stage", "score 5.5 >= threshold 5.5"), ("back", "expire", "score 5.0 < threshold 5.5")}
    rows = {r.name: r for r in out.collect()}
    assert rows["manual"].score is None and rows["low"].score == 5.4
    assert rows["up"].staged_at == NOW and rows["other"].category is None


def test_promotion_skips_protected_manual_and_young(spark):
    old, young = NOW - timedelta(days=8), NOW - timedelta(days=6)
    d = domains(spark, domain("due.vn", "staging", staged=old), domain("young.vn", "staging", staged=young),
                domain("api.vnpay.vn", "staging", staged=old), domain("soft.vn", "staging", staged=old),
                domain("hand.vn", "staging", True, staged=old), domain("none.vn", "staging"))
    out, decisions = L.promote_staging(d, AS_OF, soft=("soft.vn",))
    assert {n for n, s in status_of(out).items() if s == "blocked"} == {"due.vn"}
    r = decisions.collect()
    assert [(x.name, x.action) for x in r] == [("due.vn", "block")] and '"ads"' in r[0].snapshot


def test_silent_blocked_names_expire(spark):
    d = domains(spark, domain("old", "blocked", last=NOW - timedelta(days=181)),
                domain("fresh", "blocked", last=NOW - timedelta(days=10)),
                domain("hand", "blocked", True, last=NOW - timedelta(days=999)))
    out, decisions = L.expire_blocked(d, AS_OF)
    assert status_of(out) == {"old": "new", "fresh": "blocked", "hand": "blocked"}
    assert decisions.count() == 1


def test_decisions(spark):
    d = domains(spark, domain("a"), domain("allowed", "allowed"), domain("freed", "allowed"),
                domain("api.vnpay.vn"), domain("tag"), domain("twice"))
    out, decisions, skipped = L.apply_decisions(d, requests(
        spark, request("a", "block", category="malware"), request("allowed", "block", manual=False),
        request("freed", "ignore"), request("api.vnpay.vn", "block"),
        request("tag", "recategorize", category="ads"), request("ghost", "block"),
        request("twice", "block", seq=1), request("twice", "allow", seq=2)), AS_OF)
    rows = {r.name: r for r in out.collect()}
    assert (rows["a"].status, rows["a"].category, rows["a"].is_manual, rows["a"].blocked_at) == (
        "blocked", "malware", True, NOW)
    assert rows["allowed"].status == "allowed" and not rows["allowed"].is_manual
    assert rows["freed"].status == "ignored" and rows["api.vnpay.vn"].status == "new"
    assert (rows["tag"].status, rows["tag"].category, rows["tag"].is_manual) == ("new", "ads", True)
    assert rows["twice"].status == "allowed"
    assert sorted(r.name for r in decisions.collect()) == ["a", "freed", "tag", "twice"]
    assert {(r.name, r.skip_reason) for r in skipped.collect()} == {
        ("allowed", "allowed changes by hand only"), ("api.vnpay.vn", "protected by vnpay.vn"),
        ("ghost", "unknown name"), ("twice", "superseded in batch")}


def test_each_status_change_is_one_decision(spark, categories):
    old = NOW - timedelta(days=400)
    d = domains(spark, *[domain(f"n{i}.vn", ["new", "staging", "blocked", "allowed"][i % 4], i % 5 == 0,
                                "ads", float(i % 9), old, old) for i in range(40)])
    s = scored(spark, *[(f"n{i}.vn", float(i % 11), "ads") for i in range(40)])
    for out, decisions in (L.save_scores(d, s, categories, AS_OF), L.promote_staging(d, AS_OF),
                           L.expire_blocked(d, AS_OF)):
        before, after = status_of(d), status_of(out)
        changed = sorted(n for n in before if before[n] != after[n])
        assert changed == sorted(r.name for r in decisions.collect()) and changed
        assert all(before[n] != "allowed" for n in changed)


def test_audit_log_only_grows(spark, tmp_path):
    d = domains(spark, domain("a"))
    for i in range(2):
        _, decisions, _ = L.apply_decisions(d, requests(spark, request("a", "block", seq=i)), AS_OF)
        tables.append_decisions(decisions, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_import_and_bulk_add(spark):
    d = domains(spark, domain("known.vn"))
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(
        ["known.vn", "New.vn ", "new.vn", "*.known.vn", "x..y", "push.apple.com", "big.com", ""])],
        "line_no int, raw string")
    ranks = spark.createDataFrame([("big.com", 5)], "domain string, rank long")
    got = {r.line_no: (r.action, r.code, r.matches_known)
           for r in L.add_domains(d, lines, ranks).collect()}
    assert got == {0: ("duplicate", None, None), 1: ("created", None, None), 2: ("duplicate", None, None),
                   3: ("created", None, 1), 4: ("rejected", "invalid_domain", None),
                   5: ("rejected", "domain_protected", None), 6: ("rejected", "high_rank", None)}
    forced = L.add_domains(d, lines, ranks, force=True).where("line_no = 6").first()
    assert forced.action == "created"
    entries = spark.createDataFrame([("known.vn",), ("fresh.vn",), ("a.gstatic.com",)], "domain string")
    out, _, counts = L.import_hosts(d, entries, "admin", AS_OF)
    assert status_of(out) == {"known.vn": "blocked", "fresh.vn": "blocked"}
    assert tuple(counts.first()) == (2, 1)


def test_paging_gives_every_row_once(spark):
    d = domains(spark, *[domain(f"n{i:02}", score=None if i % 4 == 0 else float(i % 3)) for i in range(23)])
    for desc in (True, False):
        seen, cursor = [], None
        while True:
            rows = search.page(d, "score", desc, cursor, 5).collect()
            seen += [r.name for r in rows[:5]]
            if len(rows) <= 5:
                break
            cursor = (rows[4].score, rows[4].name)
        assert sorted(seen) == sorted(f"n{i:02}" for i in range(23)) and len(seen) == 23


# Publishing --------------------------------------------------------------------------------------


def blocked(spark, n, category="ads"):
    return domains(spark, *[domain(f"d{i:04}.vn", "blocked", category=category) for i in range(n)])


def snapshot_rows(spark, plan):
    none = spark.createDataFrame([], "id long, list_key string, entry_count long, checksum string, "
                                 "published_at timestamp, published_by string")
    return P.new_snapshots(plan, none)


def test_lists_hold_enabled_categories_and_everything_blocked(spark, categories):
    d = domains(spark, domain("a", "blocked", category="ads"), domain("b", "blocked", category="adult"),
                domain("c", "blocked"), domain("d", "staging", category="ads"))
    got = {}
    for r in P.lists(d, categories).collect():
        got.setdefault(r.list_key, set()).add(r.domain)
    assert got == {"ads": {"a"}, "all": {"a"}, "blocked": {"a", "b", "c"}}
    files = {r.name: r.files for r in P.files_of(d, categories).collect()}
    assert files == {"a": ["ads.txt", "all.txt", "blocked.txt"], "b": ["blocked.txt"], "c": ["blocked.txt"]}


def test_publish_guard_unchanged_and_growth(spark, categories):
    old = P.lists(blocked(spark, 10), categories)
    snaps = snapshot_rows(spark, P.publish(old, old.limit(0).select(
        F.lit(0).alias("id"), "list_key", F.lit(0).alias("entry_count"), F.lit("").alias("checksum"),
        F.lit(NOW).alias("published_at")), AS_OF)).cache()
    assert sorted(r.id for r in snaps.collect()) == [1, 2, 3]

    def plan(n, category="ads"):
        later = P.publish(P.lists(blocked(spark, n, category), categories), snaps, AS_OF)
        return {r.list_key: r.status for r in later.collect()}

    assert set(plan(10).values()) == {"unchanged"}
    assert set(plan(5).values()) == {"published"} and set(plan(4).values()) == {"refused"}
    assert set(plan(30).values()) == {"published"}
    # Another list shrinks, the rest goes on.
    assert plan(6, "adult") == {"blocked": "published"}
    keys = snaps.select("list_key")
    empty = P.publish(P.lists(blocked(spark, 6, "adult"), categories), snaps, AS_OF, keys=keys)
    assert {r.list_key: r.status for r in empty.collect()} == {
        "ads": "refused", "all": "refused", "blocked": "published"}
    assert {r.list_key for r in P.publish(old, snaps, AS_OF, sink="127.0.0.1").collect()
            if r.status == "published"} == {"ads", "all", "blocked"}


def test_checksum_of_shares(spark, categories):
    entries = P.lists(blocked(spark, 5), categories)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shares = {}
    for name in (f"d{i:04}.vn" for i in range(5)):
        shares.setdefault(sha(name)[:2], []).append(name)
    whole = ",".join(f"{k}:{sha(chr(0).join(sorted(v)))}" for k, v in sorted(shares.items()))
    want = "sha256:" + sha("0.0.0.0\0" + whole)
    assert {r.checksum for r in P.list_checksum(entries).collect()} == {want}
    other = {r.checksum for r in P.list_checksum(entries, sink="127.0.0.1").collect()}
    assert want not in other and len(other) == 1


def test_snapshots_diff_rollback_prune(spark):
    snaps = spark.createDataFrame([(i, k, 1, "c", NOW + timedelta(days=i), "s") for i, k in
                                   enumerate(["ads", "all", "ads", "blocked", "ads"])],
                                  "id long, list_key string, entry_count long, checksum string, "
                                  "published_at timestamp, published_by string")
    entries = spark.createDataFrame([(0, "a"), (0, "b"), (2, "b"), (2, "c"), (4, "c")],
                                    "snapshot_id long, domain string")
    assert {tuple(r) for r in P.diff_snapshots(entries, 0, 2).collect()} == {
        ("a", "removed"), ("c", "added")}
    row, copied = P.rollback(snaps, entries, 0, AS_OF, "admin")
    assert (row.first().id, row.first().list_key) == (5, "ads")
    assert {tuple(r) for r in copied.collect()} == {(5, "a"), (5, "b")}
    kept, rest = P.prune(snaps, entries, 1)
    assert {r.id for r in kept.collect()} == {1, 3, 4}
    assert {tuple(r) for r in rest.collect()} == {(4, "c")}
    assert {r.list_key: r.id for r in P.last_snapshots(snaps).collect()} == {
        "ads": 4, "all": 1, "blocked": 3}


def test_published_files_are_ordered_with_header(spark, categories, tmp_path):
    out = tmp_path / "lists"
    P.publish_lists(P.lists(blocked(spark, 300), categories), str(out), AS_OF, rows_per_file=50)
    parts = sorted((out / "list_key=ads").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert lines[0] == "# ads" and lines[1].startswith("# 300 domain") and lines[2] == "# sink: 0.0.0.0"
    assert lines[3:] == [f"0.0.0.0 d{i:04}.vn" for i in range(300)]
    assert len(parts) >= 6


# Relations ---------------------------------------------------------------------------------------

EDGES = "from_id string, to_id string, kind string, strength double, detail string"


def edge(a, b, kind="cname_to", strength=1.0):
    return (a, b, kind, strength, None)


def test_degree_counts_both_directions_once(spark):
    e = relate.mirrored(spark.createDataFrame(
        [edge(f"m{i}", "hub") for i in range(3)] + [edge("m0", "m1", "same_asn"),
         edge("x", "y", "co_occurs", 0.4), edge("self", "self")], EDGES))
    assert {r.id: r.degree for r in relate.degree(e).collect()} == {
        "hub": 3, "m0": 2, "m1": 2, "m2": 1, "x": 1, "y": 1}
    assert tuple(relate.network_totals(e, min_degree=2).first()) == (3, 7)
    assert tuple(relate.network_totals(e, ["cname"], outgoing_only=True).first()) == (3, 3)


def test_cname_hops(spark):
    dns = spark.createDataFrame([("a.vn", ["A.vn.", "B.net.", "", "c.net"]), ("b.vn", [])],
                                "name string, cname_chain array<string>")
    assert {(r.from_id, r.to_id) for r in relate.cname_edges(dns).collect()} == {
        ("a.vn", "b.net"), ("b.net", "c.net")}


def test_same_asn_groups(spark):
    rows = ([(f"n{i}", 13335) for i in range(3)] + [(f"b{i}", 7) for i in range(51)]
            + [(f"s{i}", 8) for i in range(50)] + [("lone", 9), ("zero", 0), ("zero2", 0), (None, 9), ("b0", None)])
    asn = spark.createDataFrame(rows, "name string, asn long")
    got = relate.same_asn_edges(asn)
    assert got.count() == 50 * 49 + 51 * 50 and {r.from_id[0] for r in got.collect()} == {"s", "b"}
    assert relate.same_asn_edges(asn, largest=50).count() == 50 * 49


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_blocked_pairs_equal_all_pairs(spark, block):
    groups = {1: range(40), 2: range(30, 55), 3: [99], 4: range(98, 100)}
    members = spark.createDataFrame([(f"n{i:02}", g) for g, of in groups.items() for i in of], "name string, asn long")
    got = [tuple(r) for r in networks.group_pairs(members, "asn", "name", block).collect()]
    assert sorted(got) == sorted((g, f"n{i:02}", f"n{j:02}") for g, of in groups.items() for i in of for j in of if i < j)


def test_degrees_from_memberships_equal_those_of_pairs(spark):
    import random
    rng = random.Random(4)
    rows = {(f"n{i}", g) for i in range(150) for g in rng.sample(range(1, 12), rng.choice([0, 1, 1, 2, 4]))}
    members = spark.createDataFrame(sorted(rows), "name string, asn long")
    want = {}
    for a in {n for n, _ in rows}:
        mine = {g for n, g in rows if n == a}
        others = {n for n, g in rows if g in mine} - {a}
        if others:
            want[a] = len(others)
    assert {r.name: r.degree for r in networks.shared_degree(members).collect()} == want
    edges = relate.same_asn_edges(members)
    assert {r.id: r.degree for r in relate.degree(edges).collect()} == want
    none = edges.where("false")
    assert {r.id: r.degree for r in relate.degree(none, members=members).collect()} == want
    mine = {g for n, g in rows if n == "n3"}
    assert {r.name: r.asn for r in networks.sharing(members, "n3").collect()} == {
        n: max(g for m, g in rows if m == n and g in mine) for n, g in rows if g in mine and n != "n3"}


def test_a_group_of_five_thousand_gives_all_its_pairs(spark):
    asn = spark.range(5000).selectExpr("concat('n', id) AS name", "7L AS asn")
    pairs = networks.group_pairs(networks.memberships(asn), "asn", "name")
    assert pairs.select("a", "b").distinct().count() == 5000 * 4999 // 2
    assert networks.shared_degree(networks.memberships(asn)).where("degree = 4999").count() == 5000


def test_edge_upsert(spark):
    base = spark.createDataFrame([edge("a", "b", strength=0.5), edge("c", "d", strength=0.5)], EDGES)
    new = spark.createDataFrame([edge("a", "b", strength=0.1), edge("e", "f"), edge("g", "g")], EDGES)
    got = {(r.from_id, r.to_id): r.strength for r in relate.upsert_edges(base, new).collect()}
    assert got == {("a", "b"): 0.1, ("c", "d"): 0.5, ("e", "f"): 1.0}


def stored(spark, edges, members):
    """Edges, memberships, and the relations that both stand for."""
    edges = spark.createDataFrame(edges, EDGES)
    members = networks.memberships(spark.createDataFrame(members, "name string, asn long"))
    return edges, members, edges.unionByName(relate.same_asn_edges(members))


CNAMES = [edge("a1", "hub"), edge("hub", "out"), edge("b0", "hub")]
NETS = [(f"a{i}", 7) for i in range(5)] + [(f"b{i}", 8) for i in range(3)] + [("a0", 8), ("lone", 9)]


def forbid_pairs(monkeypatch):
    def none(*_, **__):
        raise AssertionError("all pairs of a network are made")
    monkeypatch.setattr(relate, "group_pairs", none)


def test_degrees_in_large_overlapping_networks(spark):
    """Many names, each in a network of its own kind and in one of two large ones."""
    rows = spark.range(20000).selectExpr("concat('n', id) AS name", "explode(array(id div 4, 1000000 + id % 2)) AS asn")
    found = networks.shared_degree(networks.memberships(rows.selectExpr("name", "asn + 2000000 AS asn")))
    assert found.count() == 20000 and found.where("degree = 10001").count() == 20000


@pytest.mark.parametrize("widest", [0, 1, 2, 3, 8])
def test_degrees_of_wide_and_narrow_classes(spark, widest):
    import random
    rng = random.Random(9)
    rows = {(f"n{i}", g) for i in range(80) for g in rng.sample(range(1, 9), rng.choice([1, 2, 3, 4, 6]))}
    members = spark.createDataFrame(sorted(rows), "name string, asn long")
    groups = {n: {g for m, g in rows if m == n} for n, _ in rows}
    want = {a: n for a in groups if (n := sum(bool(groups[a] & groups[b]) for b in groups) - 1)}
    assert {r.name: r.degree for r in networks.shared_degree(members, widest=widest).collect()} == want


def test_pairs_of_one_large_group_are_spread_over_tasks(spark):
    members = networks.memberships(spark.range(4000).selectExpr("concat('n', id) AS name", "7L AS asn"))
    counts = [r.n for r in networks.group_pairs(members, "asn", "name").groupBy(F.spark_partition_id())
              .agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 4000 * 3999 // 2 and len(counts) > 3 and max(counts) < sum(counts) / 2


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_runs_of_two_sizes_give_pairs_both_ways(spark, monkeypatch, block):
    monkeypatch.setattr(networks, "RUN", 3)
    monkeypatch.setattr(networks, "SHORT_RUN", 2)
    members = spark.createDataFrame([(f"n{i:02}", g, i % 4 == 0) for g, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)],
                                    "name string, asn long, odd boolean")
    want = sorted((g, f"n{i:02}", f"n{j:02}") for g, n in ((1, 40), (2, 3)) for i in range(n) for j in range(n) if i != j)
    got = networks.group_pairs(members, "asn", "name", block, both_ways=True)
    assert sorted(tuple(r) for r in got.collect()) == want
    got = networks.group_pairs(members, "asn", "name", block, both_ways=True, apart="odd")
    assert sorted(tuple(r) for r in got.collect()) == [w for w in want if int(w[1][1:]) % 4 or int(w[2][1:]) % 4]


def test_edges_of_a_network_are_written_small(spark, tmp_path):
    """Runs follow each other in the same order, so that a column file stores them once."""
    asn = spark.range(3000).selectExpr("concat('n', id) AS name", "7L AS asn")
    relate.same_asn_edges(asn).write.parquet(str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).distinct().count() == 3000 * 2999
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 3000 * 2999


def test_both_directions_of_a_network_are_written_small(spark, tmp_path):
    members = networks.memberships(spark.range(3000).selectExpr("concat('n', id) AS name", "7L AS asn"))
    edges = spark.createDataFrame(CNAMES, EDGES)
    relate.both_directions(edges, members).write.parquet(str(tmp_path / "ways"))
    assert spark.read.parquet(str(tmp_path / "ways")).distinct().count() == 3000 * 2999 + 2 * len(CNAMES)
    assert sum(f.stat().st_size for f in (tmp_path / "ways").glob("*.parquet")) < 3000 * 2999


def test_names_in_several_networks_have_one_edge(spark):
    """Only names that are both in several networks are grouped; the greatest shared number stays."""
    import random
    rng = random.Random(6)
    rows = {(f"n{i}", g) for i in range(60) for g in rng.sample(range(1, 9), rng.choice([1, 1, 2, 4]))}
    asn = spark.createDataFrame(sorted(rows), "name string, asn long")
    for largest in (None, 15):
        kept = {(n, g) for n, g in rows if largest is None or sum(h == g for _, h in rows) <= largest}
        want = {}
        for a, g in kept:
            for b, h in kept:
                if g == h and a != b:
                    want[a, b] = max(g, want.get((a, b), 0))
        got = relate.same_asn_edges(asn, largest).collect()
        assert len(got) == len(want) and {(r.from_id, r.to_id): r.detail for r in got} == {
            p: f'{{"asn":{g}}}' for p, g in want.items()}


def test_both_directions_with_memberships(spark):
    edges, members, whole = stored(spark, CNAMES, NETS)
    got = [tuple(r) for r in relate.both_directions(edges, members).collect()]
    assert sorted(got) == sorted(tuple(r) for r in relate.both_directions(whole).collect()) and len(set(got)) == len(got)


@pytest.mark.parametrize("outgoing", [False, True])
@pytest.mark.parametrize("kinds, strength", [(None, 0.0), (["cname"], 0.0), (["same_asn"], 1.0), (None, 1.5)])
def test_totals_with_memberships(spark, monkeypatch, outgoing, kinds, strength):
    edges, members, whole = stored(spark, CNAMES, NETS)
    want = relate.network_totals(whole, kinds, strength, 3, outgoing).collect()
    forbid_pairs(monkeypatch)
    assert relate.network_totals(edges, kinds, strength, 3, outgoing, members=members).collect() == want


def test_network_with_memberships(spark, monkeypatch):
    edges, members, whole = stored(spark, CNAMES, NETS)
    names = spark.createDataFrame([(f"{c}{i}", "e", "new", "x", i) for c in "ab" for i in range(5)] + [
        ("hub", "e", "blocked", "x", 1), ("lone", "e", "new", "x", 9)],
        "name string, etld1 string, status string, category string, query_count long")
    seen = []
    made = relate.group_pairs
    monkeypatch.setattr(relate, "group_pairs", lambda m, *a, **k: seen.append(m.count()) or made(m, *a, **k))
    for how in ({"k": 4}, {"k": 100, "kinds": ["same_asn"]}, {"k": 100, "min_strength": 1.5}, {"k": 3, "most_edges": 2}):
        want = relate.network(whole, names, **how)
        got = relate.network(edges, names, members=members, **how)
        assert [f.collect() for f in got] == [f.collect() for f in want]
    assert seen[0] < len(NETS) - 1  # only memberships of the best connected names are paired


def test_related_names_with_memberships(spark, monkeypatch):
    edges, members, whole = stored(spark, CNAMES, NETS)
    known = spark.createDataFrame([("a1",), ("b2",)], "name string")
    want = sorted(map(tuple, relate.related_names(whole, known).collect()))
    forbid_pairs(monkeypatch)
    assert sorted(map(tuple, relate.related_names(edges, known, members).collect())) == want


@pytest.mark.parametrize("name", ["a0", "a1", "hub", "lone", "none"])
@pytest.mark.parametrize("kinds, strength", [(None, 0.0), (["cname"], 0.0), (["same_asn"], 1.0), (None, 1.5)])
def test_neighbours_with_memberships(spark, monkeypatch, name, kinds, strength):
    edges, members, whole = stored(spark, CNAMES, NETS)
    names = spark.createDataFrame([(f"{c}{i}", "new", "x") for c in "ab" for i in range(5)] + [("hub", "blocked", "y")],
                                  "name string, status string, category string")
    want = [relate.neighbours(whole, names, name, kinds, strength, k).collect() for k in (2, 60)]
    forbid_pairs(monkeypatch)
    assert [relate.neighbours(edges, names, name, kinds, strength, k, members).collect() for k in (2, 60)] == want


def test_edge_upsert_takes_the_strongest_new_edge_in_one_shuffle(spark):
    base = spark.createDataFrame([edge("a", "b", strength=0.9), ("c", "d", "cname_to", 0.5, "old")], EDGES)
    new = spark.createDataFrame([("a", "b", "cname_to", 0.1, "x"), ("a", "b", "cname_to", 0.3, "y"),
                                 ("a", "b", "cname_to", None, "z"), ("c", "d", "cname_to", None, "z")], EDGES)
    merged = relate.upsert_edges(base, new)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.from_id, r.strength, r.detail) for r in merged.collect()} == {("a", 0.3, "y"), ("c", None, None)}


@pytest.mark.parametrize("block", [2, 1000])
def test_edges_of_networks_are_merged_where_they_are_made(spark, monkeypatch, block):
    """Pairs of networks, which grow with their square, are not shuffled; other edges and shared pairs are."""
    monkeypatch.setattr(relate, "group_pairs", lambda *a, made=networks.group_pairs, **k: made(*a, block=block, **k))
    for nets in (NETS, [n for n in NETS if n != ("a0", 8)]):
        members = spark.createDataFrame(nets, "name string, asn long")
        others = spark.createDataFrame([*CNAMES, edge("a0", "a1", "cname_to", 0.2)], EDGES)
        plain = others.unionByName(relate.same_asn_edges(members))
        base = others.unionByName(relate.same_asn_edges(members, placed=True), allowMissingColumns=True)
        assert sorted(map(str, base.drop(*relate.PLACE).collect())) == sorted(map(str, plain.collect()))
        def changed(rows):
            up = rows.where("from_id < to_id").withColumns({"strength": F.lit(0.25), "detail": F.lit("new")})
            most = rows.where("from_id < 'a2' and to_id < 'a3'").withColumn("strength", F.lit(0.5))
            loops = rows.withColumn("to_id", F.col("from_id"))
            return up.unionByName(most).unionByName(loops).unionByName(up.where("from_id > 'a0'"))
        merged = relate.upsert_edges(base, changed(base))
        want = relate.upsert_edges(plain, changed(plain))
        assert merged.columns == want.columns
        assert sorted(map(str, merged.collect())) == sorted(map(str, want.collect()))
        assert sorted(map(str, relate.upsert_edges(base, changed(plain)).collect())) == sorted(map(str, want.collect()))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "same_asn" in plan
    physical = relate.upsert_edges(*[f.where("kind = 'same_asn'") for f in (base, changed(base))])
    physical = physical._jdf.queryExecution().executedPlan().toString()
    before_sort = physical.split("SortAggregate")[2].split("Union")[0]
    assert "Exchange" not in before_sort
