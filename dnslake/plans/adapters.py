"""Views over the driver tables: DNS-like events, names, lists, addresses, facts.

Each view is a fixed expression over a table, so that another engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslake.functions import nets
from dnslake.operators import investigate
from dnslake.operators.rollup import hourly_rollup
from dnslake.sources import lists as list_sources

AS_OF = "2024-02-01 00:00:00"
FROM, TO = "2024-01-05 00:00:00", "2024-01-20 23:00:00"


#: Columns of the driver tables that are used here; a given schema saves the footer scan and reads
#: times without zone as UTC instants.
DRIVER_TABLES = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, "
              "props string",
    "pages": "page_id long, url string, html string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "supplier": "s_suppkey long, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_returnflag string, l_shipdate timestamp",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{sf}/{name}.parquet")


def from_raw_events(raw: DataFrame) -> DataFrame:
    """The raw event table (or stream) as DNS events."""
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("long")
    qtype = (F.when(F.col("k") % 4 == 0, 1).when(F.col("k") % 4 == 1, 28)
             .when(F.col("k") % 4 == 2, 65).otherwise(15))
    etld1 = F.concat("event_type", F.lit(".example"))
    return raw.withColumn("k", k).select(
        F.concat(F.lit("h"), F.col("k").cast("string"), F.lit("."), etld1).alias("name"),
        etld1.alias("etld1"), F.col("user_id").alias("client_id"), qtype.alias("qtype"),
        F.date_trunc("second", "ts").alias("occurred_at"), "k", "event_type", "value")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return from_raw_events(table(spark, sf, "events"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_rollup(events(spark, sf))


def _case(key: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()])


def domains(spark: SparkSession, sf: str) -> DataFrame:
    per_client = events(spark, sf).groupBy("name", "etld1", "event_type", "k", "client_id").agg(
        F.count("*").alias("n"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    rows = per_client.groupBy("name", "etld1", "event_type", "k").agg(
        F.sum("n").alias("query_count"), F.count("*").alias("client_count"),
        F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))
    k = F.col("k")
    status = _case(k % 5, {0: "new", 1: "staging", 2: "blocked", 3: "allowed", 4: "ignored"})
    category = _case(F.col("event_type"), {
        "click": "ads", "view": "tracking", "error": "telemetry", "purchase": "content"})
    score = F.when(k % 7 != 0, ((k * 13) % 120).cast("double") / 10 - 3)
    return rows.select(
        "name", "etld1", "k", "query_count", "client_count", "first_seen", "last_seen",
        status.alias("status"), category.alias("category"), (k % 11 == 0).alias("is_manual"),
        F.lit("discovered").alias("origin"), score.alias("score"),
        ((k % 4).cast("double") / 4).alias("confidence"),
        F.when(k % 5 == 1, F.date_trunc("day", "first_seen")).alias("staged_at"),
        F.when(k % 5 == 2, F.date_trunc("day", "last_seen")).alias("blocked_at"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Unblock requests, one per order of the first customers' priority class."""
    o = table(spark, sf, "orders")
    state = _case(F.col("o_orderstatus"), {"O": "pending", "F": "accepted", "P": "rejected"})
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("h"), (F.col("o_custkey") % 100).cast("string"),
                             F.lit(".click.example")).alias("name"),
                    state.alias("state"), F.col("o_orderdate").alias("created_at"))


def list_entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        (F.col("p_size") % 8).cast("long").alias("source_id"),
        F.concat_ws("/", "p_brand", "p_type", (F.col("p_partkey") % 40).cast("string"))
        .alias("domain")).distinct()


def name_entries(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    """Public list entries about the event names, some roots and one CNAME target."""
    d = (domains(spark, sf) if names is None else names).select("name", "etld1", "k")
    names = d.where((F.col("k") % 10).isin(1, 2)).select(
        (F.col("k") % 3).alias("source_id"), F.col("name").alias("domain"))
    roots = d.where(F.col("etld1") == "click.example").select(
        F.lit(0).cast("long").alias("source_id"), F.col("etld1").alias("domain"))
    targets = d.where(F.col("k") % 4 == 0).select(
        F.lit(2).cast("long").alias("source_id"), F.lit("eulerian.net").alias("domain"))
    return names.unionByName(roots).unionByName(targets).distinct()


def list_sources_table(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.where(F.col("n_nationkey") < 8).select(
        F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("source_name"),
        _case(F.col("n_nationkey") % 3, {0: "ads", 1: "malware"}).alias("category"))


def facts(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    """Stored lookup results of the event names."""
    k = F.col("k")
    d = (domains(spark, sf) if names is None else names).select("name", "k", "last_seen")

    def js(**values) -> Column:
        return F.to_json(F.struct(*[v.alias(n) for n, v in values.items()]))

    lit = F.lit
    ks = k.cast("string")
    by_source = {
        "dns": F.when(k % 4 == 0, js(cname_chain=F.array(
            F.concat(lit("x"), ks, lit(".edge.example")), F.concat(lit("x"), ks, lit(".eulerian.net"))),
            a=F.array(F.concat(lit("10.0.0."), ks))))
        .when(k % 10 == 3, js(cname_chain=F.array(F.concat(lit("d"), ks, lit(".cloudfront.net"))))),
        "asn": F.when(k % 6 == 1, js(asn=lit(62597), org=lit("Adform")))
        .when(k % 6 == 2, js(asn=lit(15169), org=lit("Google"))),
        "cert": F.when(k % 9 == 4, js(sans=F.array(F.col("name"), lit("*.criteo.com")))),
        "rdap": F.when(k % 8 == 5, js(age_days=lit(7000))),
        "rank": F.when(k % 13 == 6, js(tranco=k * 100)),
        "http": F.when(k % 5 == 2, js(status=lit(204)))
        .when(k % 5 == 3, js(status=lit(200), is_html=lit(True), title=lit("T"), text_len=k * 100))
        .when(k % 5 == 4, js(status=lit(302), redirect_to=lit("https://x.doubleclick.net/a"))),
        "vt": F.when(k % 17 == 3, js(malicious=lit(5), known=lit(True)))
        .when(k % 17 == 4, js(malicious=lit(0), harmless=lit(70), known=lit(True))),
        "ai": F.when(k % 19 == 2, js(category=lit("ads"), confidence=lit(0.9)))
        .when(k % 19 == 3, js(category=lit("content"), confidence=lit(0.8)))
        .when(k % 19 == 4, js(category=lit("ads"), confidence=lit(0.5))),
    }
    pairs = F.array(*[F.struct(lit(s).alias("source"), data.alias("data"))
                      for s, data in by_source.items()])
    fetched = F.date_trunc("day", "last_seen")
    # Facts of every seventh name have run out, those of every ninth failed.
    return (d.withColumn("_p", F.explode(pairs)).where(F.col("_p.data").isNotNull()).select(
        "name", "k", "_p.source", "_p.data", fetched.alias("fetched_at"),
        F.when(k % 7 == 0, fetched).otherwise(F.lit("2025-01-01").cast("timestamp"))
        .alias("expires_at"),
        F.when(k % 9 == 0, "no such host").alias("error")))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return answers_of(events(spark, sf))


def answers_of(log: DataFrame) -> DataFrame:
    """One answer per query: two addresses each."""
    c, k = F.col("client_id"), F.col("k")
    def ip(third: Column) -> Column:
        return F.concat_ws(".", F.lit("10"), (k % 25).cast("string"), third.cast("string"),
                           (k % 7).cast("string"))
    return log.select(
        "name", F.array(ip(c % 3), ip(c % 3 + 3)).alias("ips"), (c % 5 * 60 + 60).alias("ttl"),
        "occurred_at")


def threat_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of networks: /16 for even nations, /24 for every fourth."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"),
                                          F.col("n_nationkey").alias("i"))
    wide = n.where(F.col("i") % 2 == 0).select(
        F.concat(F.lit("10."), F.col("n"), F.lit(".0.0/16 ; drop")).alias("value"))
    narrow = n.where(F.col("i") % 4 == 0).select(
        F.concat(F.lit('"2024","1", "10.'), F.col("n"), F.lit('.1.0/24","x,y"')).alias("value"))
    return (list_sources.parse_cidr_list(wide, "drop", 0, allow_v6=False)
            .unionByName(list_sources.parse_ioc_csv(narrow, "ioc", 1, allow_v6=False)))


def ip_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Half a /16 per nation that is no multiple of five."""
    n = F.col("n_nationkey").cast("string")
    lines = table(spark, sf, "nation").select(F.concat_ws(
        "\t", F.concat(F.lit("10."), n, F.lit(".0.0")), F.concat(F.lit("10."), n, F.lit(".3.255")),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("0")).otherwise(
            (F.col("n_nationkey") + 64500).cast("string")),
        F.upper(F.left("n_name", F.lit(2))), F.col("n_name")).alias("value"))
    return list_sources.parse_ip_ranges(lines, allow_v6=False)


def domain_ips(spark: SparkSession, sf: str) -> DataFrame:
    """Resolutions, a third of them with an old threat mark."""
    rows = investigate.resolution_rollup(answers(spark, sf))
    octet = F.split("ip", r"\.").getItem(1).cast("int")
    marked = octet % 3 == 0
    return rows.select(
        "*", F.lit(None).cast("long").alias("asn"),
        F.when(octet % 5 == 4, "ZZ").alias("country"), F.lit(None).cast("string").alias("org"),
        F.when(marked, F.concat(F.lit("10."), octet.cast("string"), F.lit(".0.0/16")))
        .alias("threat"), F.when(marked, "drop").alias("threat_source"))


def customer_ips(spark: SparkSession, sf: str) -> DataFrame:
    """One address per customer, as text."""
    c = F.col("c_custkey")
    number = F.lit(10 << 24) + (c % 25) * 65536 + c % 1024
    return table(spark, sf, "customer").select("c_custkey", nets.v4_text(number).alias("ip"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("list_key"),
                    (F.col("o_custkey") % 50 + 1).alias("entry_count"),
                    F.lit("x").alias("checksum"), F.col("o_orderdate").alias("published_at"),
                    F.lit("system").alias("published_by"))


def snapshot_entries(spark: SparkSession, sf: str) -> DataFrame:
    flag = _case(F.col("l_returnflag"), {"A": 1, "N": 2, "R": 3})
    return table(spark, sf, "lineitem").select(
        flag.cast("long").alias("snapshot_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".s"),
                 F.col("l_suppkey").cast("string")).alias("domain")
    ).distinct()


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    from dnslake.functions.names import host_of
    return table(spark, sf, "pages").select("page_id", host_of("url").alias("host"))


def asn_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of twenty customers per network; some in one neutral, some in one huge network."""
    g = F.floor(F.col("c_custkey") / 20)
    asn = F.when(g % 7 == 0, 15169).when(g % 5 == 0, 64496).otherwise(g + 100000)
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("name"),
        asn.cast("long").alias("asn"))


def cname_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer points to the customer with a third of the number."""
    c = F.col("c_custkey")
    def host(n: Column) -> Column:
        return F.concat(F.lit("c"), n.cast("string"), F.lit(".example"))
    return table(spark, sf, "customer").select(host(c).alias("name"),
                                               host(F.floor(c / 3)).alias("target"))


def cname_facts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), c.cast("string"), F.lit(".example")).alias("name"),
        F.array(F.concat(F.lit("E"), nation, F.lit(".edge.example.")),
                F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string"),
                         F.lit(".net.example"))).alias("cname_chain"))


def relations(spark: SparkSession, sf: str, placed: bool = False) -> DataFrame:
    from dnslake.operators.relate import cname_edges, same_asn_edges
    return cname_edges(cname_facts(spark, sf)).unionByName(
        same_asn_edges(asn_of_customers(spark, sf), placed=placed), allowMissingColumns=placed)


def stored_relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same relations as they are stored: edges, and shared networks as their memberships."""
    from dnslake.operators.networks import memberships
    from dnslake.operators.relate import cname_edges
    return cname_edges(cname_facts(spark, sf)), memberships(asn_of_customers(spark, sf))


def relation_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the relation graph with status and traffic."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), c.cast("string"), F.lit(".example")).alias("name"),
        F.lit("example").alias("etld1"),
        _case(c % 3, {0: "new", 1: "staging", 2: "blocked"}).alias("status"),
        F.col("c_mktsegment").alias("category"), (c % 97).alias("query_count"))


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "conversations")
    start = F.lit("2024-01-01").cast("timestamp")
    return v.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("kind"),
        (F.col("turn") + 1).alias("domain_count"), F.col("turn").alias("parsed_count"),
        F.length("text").cast("long").alias("prompt_chars"), (F.col("turn") * 10).alias("reply_chars"),
        F.when(F.col("conv_id") % 7 == 0, "failed").otherwise("").alias("error"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("conv_id") * 3600).alias("created_at"))


def _line_name(n: Column) -> Column:
    return F.concat(F.lit("d"), n.cast("string"), F.lit(".example"))


def replies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Model replies of 40 lines each, made from parts, and the names asked for."""
    p = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40)
                                        .alias("reply_id"))
    key = F.col("p_partkey")
    d = key % 10
    line = (F.when(d == 0, F.concat(F.lit("strange"), key.cast("string"), F.lit(".example,ads,0.5,no")))
            .when(d == 1, F.concat(_line_name(key), F.lit(",Advertising,85%,first, with comma")))
            .when(d == 2, _line_name(key))
            .when(d == 3, F.concat(_line_name(key - 2), F.lit(",content,0.1,again")))
            .when(d == 4, F.concat(F.lit('"'), _line_name(key), F.lit('","tracking","high","quoted, text"')))
            .when(d == 5, F.concat(_line_name(key), F.lit(",nonsense,0.9,x")))
            .otherwise(F.concat(_line_name(key), F.lit(", content, 0."), d.cast("string"),
                                F.lit(",ok"))))
    packed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    body = F.array_join(F.transform(packed, lambda r: r["line"]), "\n")
    fenced = F.when(F.col("reply_id") % 3 == 0, F.concat(
        F.lit("Here it is:\n```csv\ndomain,category,confidence\n"), F.col("_b"), F.lit("\n```\nDone."))
    ).otherwise(F.col("_b"))
    rows = (p.groupBy("reply_id").agg(body.alias("_b"))
            .select("reply_id", fenced.alias("reply")))
    asked = p.where(d != 0).select("reply_id", _line_name(key).alias("domain"))
    return rows, asked
