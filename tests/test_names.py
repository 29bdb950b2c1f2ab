from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions import names as N


def column(spark, values, expr, t="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {t}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_entropy_values(spark):
    got = column(spark, ["b4k8w2p9z6tx", "tracking", "cdn", "www", ""], N.round2(N.entropy("v")))
    assert got == [3.58, 3.0, 1.58, 0.0, 0.0]


def test_valid_domain(spark):
    good = ["a.b", "x-1_y.example.vn", "a" * 63 + ".vn"]
    bad = ["", "nodot", ".a.b", "a.b.", "a..b", "A.b", "a b.c", "a" * 64 + ".vn",
           ".".join(["abcdefghi"] * 26), None]
    assert column(spark, good + bad, N.valid_domain("v")) == [True] * len(good) + [False] * len(bad)


def test_host_of(spark):
    urls = ["https://u:p@X.DoubleClick.net.:8080/a@b?c#d", "x.example.com/path", "//", "a.b?x://c"]
    assert column(spark, urls, N.host_of("v"))[:2] == ["x.doubleclick.net", "x.example.com"]


def test_protected_names(spark):
    yes = ["vnpay.vn", "api.vnpay.vn", "push.apple.com", "fcm.googleapis.com", "gstatic.com",
           "ssl.gstatic.com", "pool.ntp.org", "0.pool.ntp.org", "API.vnpay.vn."]
    no = ["doubleclick.net", "notvnpay.vn", "vnpay.vn.evil.com"]
    got = column(spark, yes + no, N.protecting_rule("v"))
    assert all(got[:len(yes)]) and got[len(yes):] == [None] * len(no)
    # List order decides, hard rules come first.
    assert got[3] == "fcm.googleapis.com" and got[6] == "pool.ntp.org"
    soft = column(spark, ["noibo.congty.vn", "x.gstatic.com"],
                  N.protecting_rule("v", [" CongTy.vn ", "", "gstatic.com"]))
    assert soft == ["congty.vn", "gstatic.com"]


def test_suffix_hit_takes_the_longest_at_a_label_boundary(spark):
    known = ["example.com", "a.example.com", "eulerian.net"]
    got = column(spark, ["x.a.example.com", "b.example.com.", "*.eulerian.net", "noteulerian.net"],
                 N.suffix_hit("v", known))
    assert got == ["a.example.com", "example.com", "eulerian.net", None]


def test_suffix_match_join_agrees_with_expression(spark):
    hosts = spark.createDataFrame([("x.a.example.com",), ("b.example.com",), ("c.org",)], "host string")
    table = spark.createDataFrame([("example.com", 1), ("a.example.com", 2)], "suffix string, n int")
    got = {tuple(r) for r in N.suffix_match(hosts, table).collect()}
    assert got == {("x.a.example.com", "a.example.com", 2), ("b.example.com", "example.com", 1)}


def test_keyword_order(spark):
    got = column(spark, ["telemetry-pixel.x", "metrics.webshop.vn", "ads-assets.webshop.vn",
                         "PIXEL.adserv.x"], N.keyword_hit("v", refdata.KEYWORDS))
    assert [r and (r.word, r.category) for r in got] == [
        ("pixel", "tracking"), ("metric", "tracking"), None, ("adserv", "ads")]


def test_registrable_names(spark):
    rules = N.suffix_rules(spark)
    cases = {"a.b.example.co.uk": "example.co.uk", "example.com": "example.com", "com": "com",
             "x.y.nosuchtld": "y.nosuchtld", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp",
             "x.city.kawasaki.jp": "city.kawasaki.jp", "foo.ck": "foo.ck", "www.ck": "www.ck",
             "a.www.ck": "www.ck", "co.uk": "co.uk", "A.Example.VN.": "example.vn"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.etld1 for r in N.with_etld1(df, rules).collect()} == cases


def test_qtypes_and_clip(spark):
    assert column(spark, [1, 28, 65, 15], N.qtype_name("v"), "int") == ["A", "AAAA", "HTTPS", "TYPE15"]
    assert column(spark, ["a", "AAAA", "https", "mx"], N.qtype_code("v")) == [1, 28, 65, 0]
    assert column(spark, ["abcdef", "abc"], N.clip("v", 3)) == ["abc…", "abc"]


def test_round_half_away_from_zero(spark):
    assert column(spark, [0.125, -0.125, 2.5, 1.005], N.round2(F.col("v")), "double") == [
        0.13, -0.13, 2.5, 1.0]
