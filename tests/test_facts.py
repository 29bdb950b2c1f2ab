"""Stored lookups, pages, model prompts and replies, tables."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.operators import search
from dnslake.plans import facts as P
from dnslake.plans import pages, replies
from dnslake.sources import tables
from dnslake.sources.events import read_events, write_events

AS_OF = "2026-03-01 00:00:00"
NOW = datetime(2026, 3, 1)
FACTS = ("name string, source string, data string, fetched_at timestamp, expires_at timestamp, "
         "error string")


@pytest.mark.parametrize("source,outcome,seconds", [
    ("dns", "", 6 * 3600), ("dns", "ok", 6 * 3600), ("http", "ok", 14 * 86400),
    ("http", "parking", 30 * 86400), ("http", "timeout", 2 * 86400), ("vt", "quota", 3600),
    ("vt", "not_found", 7 * 86400), ("ai", "other", 6 * 3600), ("cert", "timeout", 900),
    ("strange", "ok", 86400), ("strange", "other", 900), ("http", None, 14 * 86400)])
def test_ttl(spark, source, outcome, seconds):
    df = spark.createDataFrame([(source, outcome)], "s string, o string")
    assert df.select(P.ttl_seconds(F.col("s"), F.col("o"))).first()[0] == seconds


def test_failure_keeps_old_data(spark):
    base = spark.createDataFrame([("a", "dns", '{"a":["1.1.1.1"]}', NOW, NOW, None),
                                  ("b", "dns", "{}", NOW, NOW, "x")], FACTS)
    new = spark.createDataFrame([("a", "dns", None, "boom", "timeout"), ("b", "dns", '{"a":[]}', None, "ok"),
                                 ("c", "vt", None, "429", "quota")],
                                "name string, source string, data string, error string, outcome string")
    got = {r.name: r for r in P.save_facts(base, new, AS_OF).collect()}
    assert (got["a"].data, got["a"].error, got["a"].expires_at) == (
        '{"a":["1.1.1.1"]}', "boom", NOW + timedelta(minutes=15))
    assert (got["b"].data, got["b"].error) == ('{"a":[]}', None)
    assert (got["c"].data, got["c"].expires_at) == ("{}", NOW + timedelta(hours=1))


def test_wide_facts_respect_expiry_or_not(spark):
    later = NOW + timedelta(days=1)
    rows = spark.createDataFrame([
        ("a", "dns", '{"cname_chain":["x.y"]}', NOW, later, None), ("a", "asn", '{"asn":7}', NOW, NOW, None),
        ("a", "vt", '{"known":true}', NOW, later, "broken"), ("b", "rank", '{"tranco":3}', NOW, later, None)],
        FACTS)
    got = {r.name: r for r in P.facts_wide(rows, AS_OF).collect()}
    assert got["a"].dns.cname_chain == ["x.y"] and got["a"].asn is None and got["a"].vt is None
    assert got["b"]["rank"].tranco == 3
    assert {r.name: r.asn and r.asn.asn for r in P.facts_wide(rows, fresh_only=False).collect()}["a"] == 7


def test_candidates_of_a_costly_source(spark):
    d = spark.createDataFrame([
        ("busy", "e", "new", 9, 4.0), ("quiet", "e", "new", 4, 4.0), ("low", "e", "new", 9, 2.0),
        ("none", "e", "staging", 9, None), ("blocked", "e", "blocked", 9, 9.0), ("fresh", "e", "new", 99, 9.0),
        ("stale", "e", "new", 50, 9.0), ("a.vnpay.vn", "e", "new", 70, 9.0)],
        "name string, etld1 string, status string, query_count long, score double")
    f = spark.createDataFrame([("fresh", "vt", "{}", NOW, NOW + timedelta(1), None),
                               ("stale", "vt", "{}", NOW, NOW, None)], FACTS)
    assert [r.name for r in P.gated_candidates(d, f, "vt", AS_OF).collect()] == ["stale", "busy"]
    assert [r.name for r in P.enrich_candidates(d, f, "vt", AS_OF, 3).collect()] == [
        "a.vnpay.vn", "stale", "blocked"]


def plain_chain(records, name):
    step, seen = {}, [name.lower()]
    for a, b in sorted(records, reverse=True):
        step[a.lower()] = b.lower()
    while step.get(seen[-1]) and step[seen[-1]] not in seen:
        seen.append(step[seen[-1]])
    return [h.removesuffix(".") for h in seen[1:]], bool(step.get(seen[-1])) and step[seen[-1]] in seen and len(seen) > 1


def chains_of(spark, names, records, **options):
    return P.cname_chain(spark.createDataFrame([(n,) for n in names], "name string"),
                         spark.createDataFrame(records, "name string, target string"), **options)


def test_chains_of_any_length_and_loops(spark):
    records = ([("a.", "b."), ("b.", "c."), ("c.", "b."), ("self", "self"), ("X", "Y"), ("y", "x"), ("q", "Y"), ("p", "q")]
               + [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [(f"leaf{i}", "a.") for i in range(200)]
               + [(f"r{i}", f"r{(i + 1) % 77}") for i in range(77)] + [("t0", "t1"), ("t1", "r40")])
    names = {a for a, _ in records} | {"alone", "n1000"}
    got = {r.name: (r.cname_chain, r.looped) for r in chains_of(spark, sorted(names), records).collect()}
    want = {n: plain_chain(records, n) for n in names}
    assert {n: c for n, (c, _) in got.items()} == {n: c for n, (c, _) in want.items()}
    assert len(got["n0"][0]) == 1000 and len(got["r5"][0]) == 76 and got["alone"] == ([], False)
    assert {n for n, (_, looped) in got.items() if looped} == {n for n, (_, looped) in want.items() if looped}


def test_random_pointers_equal_a_plain_walk(spark):
    import random
    rng = random.Random(8)
    records = [(f"h{i}", f"h{rng.randrange(130)}") for i in range(100)] + [("h3", "h4"), ("h3", "h0")]
    names = [f"h{i}" for i in range(135)]
    got = {r.name: r.cname_chain for r in chains_of(spark, names, records).collect()}
    assert got == {n: plain_chain(records, n)[0] for n in names}


def test_hops_can_be_limited_with_a_mark(spark):
    records = [(f"n{i}", f"n{i + 1}") for i in range(15)]
    got = {r.name: r for r in chains_of(spark, ["n0", "n5", "n8"], records, max_hops=10).collect()}
    assert got["n0"].cname_chain == [f"n{i}" for i in range(1, 11)] and got["n0"].truncated
    assert len(got["n5"].cname_chain) == 10 and not got["n5"].truncated and len(got["n8"].cname_chain) == 7
    assert chains_of(spark, ["a"], []).first().cname_chain == []


def test_certificates_keep_all_names(spark):
    entries = [{"name_value": "*.A.vn\na.vn\n\n", "issuer_name": "CA", "not_after": "z"},
               {"name_value": "\n".join(f"n{i}.vn" for i in range(200)), "issuer_name": "other"}]
    df = spark.createDataFrame([("a", json.dumps(entries)), ("b", "[]")], "name string, body string")
    got = {r.name: r for r in P.parse_cert_log(df).collect()}
    some = {r.name: r for r in P.parse_cert_log(df, most_names=100).collect()}["a"]
    assert len(some.sans) == 100 and some.names_seen == 202
    assert got["a"].issuer == "CA" and len(got["a"].sans) == 202 and got["a"].sans[:3] == [
        "*.a.vn", "a.vn", "n0.vn"]
    assert got["b"].issuer == "" and got["b"].sans == []


def test_registration_and_scan(spark):
    reg = {"events": [{"eventAction": "last changed", "eventDate": "2020-01-01T00:00:00Z"},
                      {"eventAction": "registration", "eventDate": "2026-02-19T12:00:00Z"}]}
    df = spark.createDataFrame([("a", json.dumps(reg)), ("b", "{}"), ("c", json.dumps(
        {"events": [{"eventAction": "registration", "eventDate": "soon"}]}))], "name string, body string")
    assert {r.name: (r.registered_at, r.age_days) for r in P.parse_registration(df, AS_OF).collect()} == {
        "a": ("2026-02-19T12:00:00Z", 9), "b": ("", 0), "c": ("soon", 0)}
    scan = {"data": {"attributes": {"last_analysis_stats": {"malicious": 3, "harmless": 60}}}}
    df = spark.createDataFrame([("a", json.dumps(scan), 200), ("b", "", 404), ("c", "", 429)],
                               "name string, body string, status int")
    assert {tuple(r) for r in P.parse_scan(df).collect()} == {
        ("a", 3, 0, 60, 0, True), ("b", 0, 0, 0, 0, False)}


def test_facts_of_one_name_show_errors(spark):
    rows = spark.createDataFrame([("a", "dns", "{}", NOW, NOW, "no such host"),
                                  ("a", "asn", '{"asn":1}', NOW, NOW, None)], FACTS)
    assert {(r.source, r.data) for r in P.facts_for(rows, "a").collect()} == {
        ("dns", '{"error":"no such host"}'), ("asn", '{"asn":1}')}


# Pages -------------------------------------------------------------------------------------------

LONG = "<p>" + "lời " * 500 + "</p>"
PAGES = [
    ("<html><TITLE lang=vi> Tin  tức </TITLE><body>" + LONG + "</body></html>", "Tin  tức"),
    ("<title>x</title><script>var a = '" + "b" * 5000 + "';</script>ok", "x"),
    ("no tags at all", ""), ("<title>open<script>never closed " + "c" * 900, ""),
    ("a > b < c", ""), ("İ<title>dotted</title>", "dotted")]


def test_pages(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)], "i int, html string")
    got = pages.analyze_pages(df).orderBy("i").collect()
    assert [r.title for r in got] == [p[1] for p in PAGES]
    text = " ".join((["Tin", "tức"] + ["lời"] * 500))
    assert [r.text_len for r in got] == [
        len(text.encode()), len("xok"), len("no tags at all"), len("open"), len("a b"),
        len("İdotted".encode())]
    assert all(r.body_len == len(p[0].encode()) and r.is_html for r, p in zip(got, PAGES))


def test_parking_takes_the_first_provider(spark):
    df = spark.createDataFrame([("x SEDOPARKING.com bodis.com",), ("parkingpage",), ("plain",)], "html string")
    assert [r.parking for r in pages.analyze_pages(df).collect()] == ["Sedo", "parking chung", ""]
    other = pages.analyze_pages(df.withColumn("ct", F.lit("Text/Plain; charset=x")), content_type="ct")
    assert {(r.is_html, r.title, r.text_len) for r in other.collect()} == {(False, "", 0)}


def test_pixels(spark):
    gif, png = b"GIF89a" + b"\0" * 37, b"\x89PNG\r\n\x1a\n" + b"\0" * 20
    df = spark.createDataFrame([("image/gif", gif), ("image/png", png), ("image/gif", gif + b"\0" * 90),
                                ("image/gif", b""), ("text/html", gif), ("image/jpeg", b"\xff\xd8")],
                               "t string, b binary")
    assert [r[0] for r in df.select(pages.is_pixel(F.col("t"), F.col("b"))).collect()] == [
        True, True, False, False, False, False]


def test_tracking_cookies(spark):
    values = [["a=1; Max-Age=8640000; SameSite=None; Secure"], ["a=1; Max-Age=8640000; SameSite=None"],
              ["a=1; Max-Age=86400; SameSite=None; Secure", "b=2; secure; samesite=none; max-age=7776000"],
              ["a=1; Expires=Wed, 01 Jul 2026 00:00:00 GMT; SameSite=None; Secure"], [],
              ["a=1; SameSite=None; Secure"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, set_cookie array<string>")
    got = pages.tracking_cookie(df, as_of=AS_OF).orderBy("i").collect()
    assert [(r.tracking_cookie, r.cookie_max_days) for r in got] == [
        ("a", 100), ("", 0), ("b", 90), ("a", 122), ("", 0), ("", 0)]


# Model -------------------------------------------------------------------------------------------


def verdicts(spark, reply, asked):
    r = spark.createDataFrame([(1, reply)], "reply_id int, reply string")
    a = spark.createDataFrame([(1, d) for d in asked], "reply_id int, domain string")
    v, c = replies.parse_replies(r, a)
    counts = c.first()
    return ({x.domain: (x.category, x.confidence, x.reason) for x in v.collect()},
            counts and (counts.parsed, counts.skipped, counts.unknown))


def test_clean_reply(spark):
    got = verdicts(spark, "a.vn,ads,0.97,sàn quảng cáo\nb.vn,content,0.2,", ["a.vn", "B.vn"])
    assert got == ({"a.vn": ("ads", 0.97, "sàn quảng cáo"), "B.vn": ("content", 0.2, "")}, (2, 0, 0))


def test_fences_headings_quotes_and_commas(spark):
    reply = ('Sure, here:\n```csv\ndomain,category,confidence,reason\n"a.vn","Ad-Tech","85%","one, two"\n'
             "b.vn, analytics, cao, one, two\n```\nb.vn,ads,1,outside")
    got = verdicts(spark, reply, ["a.vn", "b.vn"])
    assert got == ({"a.vn": ("ads", 0.85, "one, two"), "b.vn": ("tracking", 0.9, "one, two")}, (2, 0, 0))


def test_strange_short_repeated_and_unknown_lines(spark):
    reply = "x.vn,ads,1,why\na.vn\na.vn,rubbish,1,no\na.vn,ads,0.5,first\na.vn,content,0.9,second"
    got = verdicts(spark, reply, ["a.vn"])
    assert got == ({"a.vn": ("ads", 0.5, "first")}, (1, 4, 1))


def test_stray_quotes_fences_and_long_lines(spark):
    reply = ('a.vn,ads,0.9,5" banner\nb.vn, "tracking" ,0.8,"said ""x"", twice"\nc.vn,ads,0.7,"never closed\n'
             + "d.vn,ads,0.6," + '"' * 10_000 + "\ne.vn,ads,0.5," + ",".join('"q' for _ in range(3_000)))
    got, counts = verdicts(spark, reply, ["a.vn", "b.vn", "c.vn", "d.vn", "e.vn"])
    assert got["a.vn"] == ("ads", 0.9, '5" banner') and got["b.vn"] == ("tracking", 0.8, 'said "x", twice')
    assert got["c.vn"][:2] == ("ads", 0.7) and got["d.vn"][:2] == ("ads", 0.6) and got["e.vn"][:2] == ("ads", 0.5)
    assert counts == (5, 0, 0)
    fenced = "x.vn,ads,1\n```csv\na.vn,ads,1\n```\nb.vn,ads,1\n```\nc.vn,ads,1\n```"
    assert set(verdicts(spark, fenced, ["x.vn", "a.vn", "b.vn", "c.vn"])[0]) == {"a.vn", "c.vn"}


def test_evidence_and_prompts(spark):
    row = spark.sql("""SELECT 'a.vn' AS name, named_struct('cname_chain', array('x.vn', 'y.net')) AS dns,
        named_struct('org', 'Net One') AS asn, 9 AS query_count, 0 AS client_count, false AS in_list, true AS etld1_in_list,
        named_struct('tranco', 70) AS rank, named_struct('age_days', 20) AS rdap,
        named_struct('parking', '', 'is_pixel', false, 'text_len', 10, 'title', ' A,  b: c ') AS http,
        named_struct('known', true, 'malicious', 3) AS vt
        UNION ALL SELECT 'b.vn', NULL, NULL, 0, NULL, false, false, NULL, NULL, NULL, NULL""")
    lines = {r.name: r.line for r in replies.evidence_line(row).collect()}
    assert lines == {"b.vn": "- b.vn", "a.vn": "- a.vn: 9 queries, parent name on a blocklist, 3 malware engines report it, "
                     "registered 20 days ago, popularity rank 70, alias of y.net, hosted by Net One, page without text, "
                     "page title A b c"}
    many = spark.range(205).selectExpr("concat('n', id) AS name", "concat('- n', id) AS line", "id % 7 AS query_count")
    prompts = replies.build_prompts(many, size=40).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in prompts] == [(0, 40), (1, 40), (2, 40), (3, 40), (4, 40), (5, 5)]
    order = [r.name for r in many.orderBy(F.desc("query_count"), "name").collect()]
    assert [x[2:] for r in prompts for x in r.prompt.split("\n")[1:]] == order


def test_words_and_numbers(spark):
    words = ["high", "TrungBinh", "thấp", "85", "0.85", "85 %", "-1", "x", "150%", '"0.5"']
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(replies.confidence_of(F.col("w"))).collect()]
    assert got == [0.9, 0.6, 0.3, 0.85, 0.85, 0.85, 0.0, 0.0, 1.0, 0.5]
    cats = spark.createDataFrame([(s,) for s in refdata.CATEGORY_SYNONYMS], "s string")
    assert {r[0] for r in cats.select(replies.category_of(F.upper("s"))).collect()} == set(
        refdata.CATEGORY_SYNONYMS.values())


# Tables ------------------------------------------------------------------------------------------


def test_versions_and_merge(spark, tmp_path):
    root = str(tmp_path / "t")
    base = spark.createDataFrame([("a", 1, 5, "x", "k", "f"), ("b", 1, 5, "x", "k", "f")],
                                 "k string, n int, lo int, last string, keep string, fill string")
    delta = spark.createDataFrame([("a", 2, 3, None, "z", None), ("c", 1, 9, "y", "q", "g")], base.schema)
    rules = {"n": "sum", "lo": "min", "last": "last", "keep": "keep", "fill": "fill"}
    assert tables.write_version(base, root) == 1
    merged = tables.merge_latest(tables.read_version(spark, root), delta, ["k"], rules)
    assert tables.write_version(merged, root) == 2
    (tmp_path / "t" / "v=3").mkdir()
    assert tables.versions(spark, root) == [1, 2] and tables.write_version(base, root) == 4
    assert {tuple(r) for r in tables.read_version(spark, root, 2).collect()} == {
        ("a", 3, 3, None, "k", "f"), ("b", 1, 5, "x", "k", "f"), ("c", 1, 9, "y", "q", "g")}


def test_event_log_on_disk(spark, tmp_path):
    e = spark.createDataFrame([("b.x", "x", 1, 1, NOW), ("a.x", "x", 2, 28, NOW + timedelta(days=1))],
                              "name string, etld1 string, client_id long, qtype int, occurred_at timestamp")
    write_events(e, str(tmp_path / "log"))
    assert sorted(p.name for p in (tmp_path / "log").glob("dt=*")) == ["dt=2026-03-01", "dt=2026-03-02"]
    got = read_events(spark, str(tmp_path / "log"), from_="2026-03-02 00:00:00")
    assert [r.name for r in got.collect()] == ["a.x"]


def test_case_export(spark, tmp_path):
    q = spark.createDataFrame([("c", "a.vn", 1, NOW)], "client string, domain string, qtype int, at timestamp")
    r = spark.createDataFrame([("a.vn", "1.1.1.1", NOW)], "domain string, ip string, last_seen timestamp")
    out = tmp_path / "case"
    tables.export_case(q, r, "2026-03-01", "2026-03-02", str(out))
    manifest = {m.file: m for m in spark.read.json(str(out / "manifest")).collect()}
    part = next((out / "queries").glob("part-*.json"))
    assert manifest["queries"].rows == 1 and manifest["queries"].bytes == part.stat().st_size
    hashes = {h.file.split("/")[-1]: h.sha256 for h in spark.read.json(str(out / "files")).collect()}
    assert hashes[part.name] == hashlib.sha256(part.read_bytes()).hexdigest()
    with pytest.raises(ValueError):
        tables.export_case(q, r, "2024-03-01", "2026-03-02", str(tmp_path / "long"))


def test_signals_of_a_page(spark):
    top = spark.createDataFrame([("a",), ("b",)], "name string")
    signals = spark.createDataFrame([("a", "keyword", 3.0), ("a", "shared_cdn", -6.0), ("c", "beacon", 2.0)],
                                    "name string, kind string, weight double")
    got = {r.name: r.signals and [s.kind for s in r.signals]
           for r in search.signals_of(top, signals).collect()}
    assert got == {"a": ["shared_cdn", "keyword"], "b": None}


def test_walks_are_put_together_once_and_end_before_loops(spark, monkeypatch):
    """No stored walk is longer than its chain, and one that has ended is not stored again."""
    from dnslake.operators import chains
    kept, cut = [], chains.cut_lineage

    def watched(df):
        df = cut(df)
        if "path" in df.columns:
            kept.extend((r.at, r.end, len(r.path)) for r in df.select("at", "end", "path").collect())
        return df

    monkeypatch.setattr(chains, "cut_lineage", watched)
    links = [(f"t{i:02}", f"t{i + 1:02}") for i in range(20)] + [("t20", "l0")] + [
        (f"l{i}", f"l{(i + 1) % 5}") for i in range(5)] + [(f"s{i}", f"s{i + 1}") for i in range(30)]
    got = {r.at: (len(r.path), r.looped) for r in chains.walks(spark.createDataFrame(links, "at string, to string")).collect()}
    assert got["t00"] == (25, True) and got["l3"] == (4, True) and got["s0"] == (30, False) and len(got) == 56
    ended = [at for at, end, _ in kept if end is None]
    assert max(n for *_, n in kept) <= 30 and len(ended) == len(set(ended)) == 56
