"""The scorer on hand-made candidates: exact score, category, kinds in order, confidence."""

import itertools
import json

import pytest

from dnslake import refdata, schemas
from dnslake.plans import rules as R
from dnslake.plans import score as S

SCHEMA = ("name string, etld1 string, query_count long, client_count long, subdomain_count long, "
          "third_party_ratio double, interval_cv double, in_list boolean, etld1_in_list boolean, "
          "cname_etld1_in_list string, list_categories array<string>, " + ", ".join(
              f"{s} struct<{', '.join(':'.join(c.split(' ', 1)) for c in d.split(', '))}>"
              for s, d in schemas.FACT_JSON.items()))


def fact(source, **values):
    fields = [c.split(" ")[0] for c in schemas.FACT_JSON[source].split(", ")]
    return tuple(values.get(f) for f in fields)


def row(name, **kw):
    facts = {s: kw.pop(s, None) for s in schemas.FACT_JSON}
    base = dict(name=name, etld1=".".join(name.split(".")[-2:]), query_count=0, client_count=0,
                subdomain_count=0, third_party_ratio=None, interval_cv=None, in_list=False,
                etld1_in_list=False, cname_etld1_in_list=None, list_categories=None)
    base.update(kw)
    return tuple(base.values()) + tuple(
        None if v is None else fact(s, **v) for s, v in facts.items())


CASES = [
    (row("metrics.webshop.vn", dns=dict(cname_chain=["cdn.eulerian.net", "x.eulerian.net"]),
         asn=dict(asn=62597)), 13.0, "tracking", ["cname_adtech", "asn_adtech", "keyword"], 0.95),
    (row("google.com", rank=dict(tranco=1), asn=dict(asn=15169)), -8.0, "cdn", ["high_rank"], 0.40),
    (row("analytics.congty.vn", asn=dict(asn=45899)), 3.0, "content", ["keyword"], 0.40),
    (row("static.webshop.vn", asn=dict(asn=15169)), 0.0, "content", [], 0.40),
    (row("check.thietbi.vn", query_count=2880, interval_cv=0.04, client_count=1),
     2.0, "telemetry", ["beacon"], 0.40),
    (row("c12.adnet.vn", subdomain_count=120, client_count=9, third_party_ratio=0.94,
         etld1_in_list=True), 10.5, "content",
     ["third_party", "fan_out", "spread_high", "etld1_blocked"], 0.60),
    (row("ads-assets.webshop.vn", dns=dict(cname_chain=["d1234.cloudfront.net"])),
     -6.0, "cdn", ["shared_cdn"], 0.40),
    (row("b4k8w2p9z6tx.tracker.io"), 5.0, "content", ["keyword", "random_sub"], 0.40),
    (row("x7q.webshop.vn"), 0.0, "content", [], 0.40),
    (row("verify.example.tk", in_list=True, list_categories=["malware"]), 0.0, "malware", [], 0.40),
    (row("www.baocu.vn", rdap=dict(age_days=7000)), -2.0, "content", ["long_lived_content"], 0.40),
    # Pages.
    (row("c1.thietbi.vn", http=dict(status=204)), 4.0, "telemetry", ["http_beacon"], 0.70),
    (row("px.citynet.vn", http=dict(status=200, content_type="image/gif", body_len=43, is_pixel=True)),
     4.0, "telemetry", ["http_beacon"], 0.70),
    (row("e.citynet.vn", http=dict(status=200, content_type="text/plain", is_html=False)),
     4.0, "telemetry", ["http_beacon"], 0.70),
    (row("tenmiencu.vn", http=dict(status=200, is_html=True, parking="Sedo", title="t", text_len=400)),
     3.0, "ads", ["http_parking"], 0.40),
    (row("go.webshop.vn", http=dict(status=302, redirect_to="https://x.doubleclick.net/abc")),
     4.0, "ads", ["http_redirect_adtech"], 0.70),
    (row("id.citynet.vn", http=dict(status=200, is_html=True, p3p='CP="NOI DSP"', tracking_cookie="uid",
                                  cookie_max_days=730, title="", text_len=50)),
     5.5, "content", ["http_p3p", "http_tracking_cookie", "http_empty_page"], 0.40),
    (row("baomoi.vn", http=dict(status=200, is_html=True, title="Tin", text_len=9000)),
     -2.0, "content", ["http_real_site"], 0.40),
    (row("api.citynet.vn", http=dict(status=200, is_html=False, body_len=9, cors="*")),
     1.0, "content", ["http_cors_wildcard"], 0.40),
    # Scanner.
    (row("verify.example.tk", vt=dict(known=True, malicious=5, harmless=60)),
     4.0, "malware", ["vt_malicious"], 0.40),
    (row("webshop.vn", vt=dict(known=True, malicious=1, harmless=30, undetected=20)),
     0.0, "content", [], 0.40),
    (row("webshop.vn", vt=dict(known=True, malicious=0, harmless=70, undetected=20)),
     -1.0, "content", ["vt_clean"], 0.40),
    (row("webshop.vn", vt=dict(known=False, malicious=9)), 0.0, "content", [], 0.40),
    # Model: under the floor nothing, cdn is neutral.
    (row("m.vn", ai=dict(category="ads", confidence=0.59)), 0.0, "content", [], 0.40),
    (row("m.vn", ai=dict(category="ads", confidence=0.6)), 2.5, "content", ["ai_adtech"], 0.40),
    (row("m.vn", ai=dict(category="content", confidence=0.9)), -2.0, "content", ["ai_clean"], 0.40),
    (row("m.vn", ai=dict(category="cdn", confidence=0.9)), 0.0, "content", [], 0.40),
    # Certificate, middle spread, weak third party, ASN category.
    (row("s.vn", cert=dict(sans=["s.vn", "*.criteo.com"]), subdomain_count=15, third_party_ratio=0.5),
     5.2, "ads", ["cert_adtech", "third_party_weak", "spread_mid"], 0.85),
    (row("q.vn", asn=dict(asn=40977)), 4.0, "tracking", ["asn_adtech"], 0.70),
    # The CNAME target is listed, though its suffix is no adtech suffix.
    (row("metric.x.vn", dns=dict(cname_chain=["t.evil.org"]), cname_etld1_in_list="evil.org"),
     8.0, "tracking", ["cname_blocked", "keyword"], 0.70),
]


def result(spark, rows, *args):
    numbered = spark.createDataFrame([(f"{i}|{r[0]}",) + r[1:] for i, r in enumerate(rows)], SCHEMA)
    # Names must stay what they are for the lexical signals: score one by one under an index.
    from pyspark.sql import functions as F
    clean = numbered.withColumn("i", F.substring_index("name", "|", 1).cast("int")).withColumn(
        "name", F.substring_index("name", "|", -1))
    return S.with_score(clean, *args).orderBy("i").collect()


def test_scores(spark):
    got = result(spark, [c[0] for c in CASES])
    for r, (case, score, category, kinds, confidence) in zip(got, CASES, strict=True):
        assert (r.score, r.category, [s.kind for s in r.signals], r.confidence) == (
            score, category, kinds, confidence), case[0]


def test_details_are_json(spark):
    first = result(spark, [CASES[0][0]])[0].signals[0]
    assert json.loads(first.detail) == {"cname": "cdn.eulerian.net", "matched": "eulerian.net"}


def test_same_input_same_output(spark):
    runs = [[(r.score, r.category, [s.kind for s in r.signals])
             for r in result(spark, [c[0] for c in CASES])] for _ in range(2)]
    assert runs[0] == runs[1]


def test_weights_fall_back_to_defaults(spark):
    rows = [row("metrics.webshop.vn", dns=dict(cname_chain=["x.eulerian.net"]))]
    base, tuned = result(spark, rows)[0], result(spark, rows, None, {"cname_adtech": 9.0})[0]
    assert tuned.score - base.score == 3.0
    assert [s.kind for s in tuned.signals] == ["cname_adtech", "keyword"]


def test_no_page_signal_blocks_alone():
    assert all(w < 5.5 for k, w in refdata.WEIGHTS.items() if k.startswith("http_"))
    assert refdata.WEIGHTS["vt_malicious"] < 5.5 and refdata.WEIGHTS["ai_adtech"] < 3.0


CUSTOM = [
    ("adtech_domains", "*.AdNet.VN.", "ads", None), ("adtech_domains", "", "ads", None),
    ("adtech_domains", "nodot", "ads", None), ("adtech_domains", "api.vnpay.vn", "ads", None),
    ("adtech_domains", "x.edgekey.net", "ads", None), ("adtech_domains", "ok.vn", "content", None),
    ("adtech_asns", "15169", "ads", "G"), ("adtech_asns", "0", "ads", "Z"),
    ("adtech_asns", "64500", "tracking", "Own"), ("shared_cdn", "cdn", None, None),
    ("keywords", "ab", "ads", None), ("keywords", "a b c", "ads", None), ("keywords", "", "ads", None),
    ("keywords", "word", "nothing", None), ("keywords", "Quang", "tracking", None),
    ("thresholds", "spread_high_min", "4", None), ("thresholds", "spread_mid_min", "0", None),
    ("thresholds", "fanout_min_clients", "7", None),
]


def test_rule_errors(spark):
    got = {(r.field, r.value) for r in R.validate_rules(
        spark.createDataFrame(CUSTOM, R.CUSTOM)).collect()}
    assert got == {
        ("adtech_domains", ""), ("adtech_domains", "nodot"), ("adtech_domains", "api.vnpay.vn"),
        ("adtech_domains", "x.edgekey.net"), ("adtech_domains", "ok.vn"), ("adtech_asns", "15169"),
        ("adtech_asns", "0"), ("shared_cdn", "cdn"), ("keywords", "ab"), ("keywords", "a b c"),
        ("keywords", ""), ("keywords", "nothing"), ("thresholds", "spread_high_min=4")}
    order = spark.createDataFrame([("thresholds", "spread_mid_min", "60", None),
                                   ("thresholds", "spread_high_min", "50", None)], R.CUSTOM)
    assert [r.value for r in R.validate_rules(order).collect()] == [
        "spread_mid_min=60 spread_high_min=50"]


def test_custom_rules_add_and_override(spark):
    custom = spark.createDataFrame(
        [CUSTOM[0], CUSTOM[8], CUSTOM[14], CUSTOM[16], CUSTOM[17],
         ("adtech_domains", "criteo.com", "tracking", None)], R.CUSTOM)
    rules = R.load_rules(R.merge_rules(custom))
    assert rules.adtech["adnet.vn"] == "ads" and rules.adtech["criteo.com"] == "tracking"
    assert rules.asns[64500] == ("Own", "tracking") and rules.keywords["tracking"][-1] == "quang"
    assert rules.thresholds["fanout_min_clients"] == 7 and rules.thresholds["spread_mid_min"] == 15
    assert len(rules.cdn) == len(refdata.SHARED_CDN)
    rows = [row("quang.x.vn", dns=dict(cname_chain=["t.adnet.vn"]), asn=dict(asn=64500))]
    got = result(spark, rows, rules)[0]
    assert (got.score, got.category) == (13.0, "ads")


def test_threshold_zero_is_not_set(spark):
    base = spark.createDataFrame([("a", 5), ("b", 6)], "key string, value int")
    new = spark.createDataFrame([("a", 0), ("b", 9)], "key string, value int")
    assert {tuple(r) for r in R.override_thresholds(base, new).collect()} == {("a", 5), ("b", 9)}


@pytest.mark.parametrize("position", [0, 1])
def test_equal_weights_first_signal_wins(spark, position):
    # A listed root (4.0) stands before a page without content (4.0): no telemetry then.
    rows = [row("a.vn", etld1_in_list=not position, http=dict(status=204))]
    assert result(spark, rows)[0].category == ("telemetry" if position else "ads")


def test_pages_of_signal_kinds_are_known():
    kinds = set(itertools.chain.from_iterable(c[3] for c in CASES))
    assert kinds <= set(refdata.WEIGHTS)
