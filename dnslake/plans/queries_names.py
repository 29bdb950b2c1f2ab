"""Queries about names: search and paging, name functions, pages, lists, rules, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions import names as N
from dnslake.operators import behavior, catalog, joins, search, trigrams, windows
from dnslake.plans import adapters as A
from dnslake.plans import facts as facts_plan
from dnslake.plans import pages, replies, rules, score
from dnslake.plans.publish import category_table
from dnslake.plans.queries_log import CV, PRECEDED
from dnslake.plans.registry import CATEGORIES, DOM, EV, HOSTS, LE, query, sec, six
from dnslake.session import cut_lineage, work_path
from dnslake.sources import lists as list_sources

# Search ------------------------------------------------------------------------------------------


@query(f"""WITH {DOM} SELECT name, status, category, score FROM dom
WHERE status IN ('blocked', 'staging') AND category IN ('ads', 'tracking') AND score >= 1
AND last_seen >= TIMESTAMP '2024-01-25'""")
def list_domains(spark, sf):
    return search.list_domains(
        A.domains(spark, sf), ["blocked", "staging"], ["ads", "tracking"], "", 1.0,
        "2024-01-25 00:00:00").select("name", "status", "category", "score")


@query(f"""WITH {DOM}, {CATEGORIES} SELECT name, category, threshold, enabled, publish_path
FROM dom LEFT JOIN cat ON key = category""")
def domains_with_category(spark, sf):
    return search.with_category(A.domains(spark, sf), category_table(spark)).select(
        "name", "category", "threshold", "enabled", "publish_path")


@query(f"WITH {EV} SELECT DISTINCT name FROM dns_events WHERE strpos(name, '7.c') > 0")
def search_contains(spark, sf):
    return search.search(A.events(spark, sf).select("name").distinct(), "7.C")


@query(f"""WITH {HOSTS} SELECT DISTINCT host FROM hosts
WHERE host LIKE '%.example.com' OR host = 'example.com'""")
def search_suffix(spark, sf):
    return search.search(A.hosts(spark, sf).select("host").distinct(), "*.example.com", "host")


@query(f"""WITH {HOSTS} SELECT DISTINCT host AS name, reverse(host) AS name_rev FROM hosts
WHERE host LIKE '%.example.net' OR host = 'example.net'""")
def search_suffix_reversed(spark, sf):
    named = A.hosts(spark, sf).select(F.col("host").alias("name")).distinct()
    return search.search(named.withColumn("name_rev", N.reversed_name("name")), "*.example.net")


@query(f"WITH {EV} SELECT DISTINCT name FROM dns_events "
       "WHERE regexp_matches(name, '^h[0-9]*3[.](view|error)')")
def search_regex(spark, sf):
    return search.search(A.events(spark, sf).select("name").distinct(),
                         "/^h[0-9]*3[.](view|error)/")


def _indexed(spark, sf):
    """Index of the part names of the whole part table and of the event names."""
    path = work_path(spark, "trigrams")
    parts = A.table(spark, sf, "part").select(F.concat_ws(
        ".", F.lower(F.regexp_replace("p_type", " ", "-")), F.lower("p_brand"), F.col("p_partkey").cast("string"), F.lit("example")).alias("name"))
    trigrams.build(A.events(spark, sf).select("name").unionAll(parts), path)
    return path


_INDEXED = f"""WITH {EV}, n AS (SELECT DISTINCT name FROM dns_events UNION
SELECT lower(replace(p_type, ' ', '-')) || '.' || lower(p_brand) || '.' || p_partkey || '.example' FROM part)"""


@query(f"{_INDEXED} SELECT name FROM n WHERE strpos(name, '7.e') > 0")
def indexed_contains(spark, sf):
    """A literal part of a name by the trigram index."""
    return trigrams.find(spark, _indexed(spark, sf), "7.E")


@query(f"{_INDEXED} SELECT name FROM n WHERE regexp_matches(name, 'brand#[0-9]+[.]1.*[.]exam') OR false")
def indexed_regex(spark, sf):
    """A pattern with literal parts by the trigram index."""
    return trigrams.find(spark, _indexed(spark, sf), "/brand#[0-9]+[.]1.*[.]exam/")


@query(f"""WITH {DOM} SELECT name, query_count FROM dom WHERE name = 'h7.view.example'""")
def lookup_domain(spark, sf):
    return search.lookup(A.domains(spark, sf), " H7.view.example").select("name", "query_count")


@query(f"""WITH {DOM} SELECT name, query_count FROM dom WHERE etld1 = 'click.example'
AND name <> 'h1.click.example' ORDER BY query_count DESC, name LIMIT 50""")
def siblings(spark, sf):
    return search.siblings(A.domains(spark, sf), "h1.click.example").select("name", "query_count")


@query(f"""WITH {DOM} SELECT count(*) AS n FROM dom WHERE etld1 = 'view.example'""")
def count_subdomains(spark, sf):
    return search.count_subdomains(A.domains(spark, sf), "view.example")


@query(f"""WITH {DOM} SELECT name, score FROM dom
ORDER BY score DESC NULLS LAST, name DESC LIMIT 100""")
def sort_by_score(spark, sf):
    return search.sort_domains(A.domains(spark, sf)).limit(100).select("name", "score")


@query(f"""WITH {DOM} SELECT name, confidence FROM dom
ORDER BY confidence ASC NULLS FIRST, name LIMIT 100""")
def sort_by_confidence(spark, sf):
    return search.sort_domains(A.domains(spark, sf), "confidence", False).limit(100).select(
        "name", "confidence")


@query(f"""WITH {DOM}, o AS (SELECT name, score, row_number() OVER (
ORDER BY score DESC NULLS LAST, name DESC) AS rn FROM dom)
SELECT name, score FROM o WHERE score IS NULL OR score < 0.0
OR (score = 0.0 AND name < 'h50') ORDER BY rn LIMIT 51""")
def page_after_cursor(spark, sf):
    return search.page(A.domains(spark, sf), cursor=(0.0, "h50")).select("name", "score")


@query(f"""WITH {DOM} SELECT name, score FROM dom WHERE score IS NOT NULL OR name > 'h5'
ORDER BY score ASC NULLS FIRST, name LIMIT 51""")
def page_after_null(spark, sf):
    return search.page(A.domains(spark, sf), desc=False, cursor=(None, "h5")).select(
        "name", "score")


@query(f"""WITH {DOM} SELECT name, query_count FROM dom
WHERE NOT is_manual AND status IN ('new', 'staging')""")
def scoring_candidates(spark, sf):
    return search.candidates(A.domains(spark, sf)).select("name", "query_count")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def pending_requests(spark, sf):
    return search.pending_requests(A.requests(spark, sf)).select("id")


@query("""SELECT o_orderkey AS id, o_orderpriority AS list_key FROM orders
WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30""")
def snapshot_history(spark, sf):
    return search.snapshot_history(A.snapshots(spark, sf), "1-URGENT").select("id", "list_key")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_shipmode FROM (SELECT l_orderkey,
l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE l_partkey = 7)
ORDER BY id DESC LIMIT 20""")
def verdict_history(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("domain"),
        F.col("l_returnflag").alias("l_shipmode"))
    return search.verdicts_of(li, " P7 ").select("id", "l_shipmode")


@query("""SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders
WHERE o_custkey = 17 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def decision_history(spark, sf):
    rows = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"))
    return search.history(rows, "c17").select("id", sec("created_at"))


# Name functions ----------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\s,;:!?()"]+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (length(w) <= 253 AND regexp_matches(w,
'^([a-z0-9_-]{1,63}\.)+[a-z0-9_-]{1,63}$')) AS n FROM w GROUP BY 1""")
def valid_names(spark, sf):
    """Words of the documents that are valid names."""
    words = F.split(F.lower("text"), r'[\s,;:!?()"]+')
    return A.table(spark, sf, "documents").select(
        "doc_id", F.size(F.filter(words, N.valid_domain)).cast("long").alias("n"))


@query(f"""WITH {HOSTS} SELECT page_id, host FROM hosts""")
def url_hosts(spark, sf):
    return A.hosts(spark, sf)


@query(f"""WITH {HOSTS} SELECT DISTINCT host, regexp_replace(host, '^.*?([^.]+[.][^.]+)$', '\\1')
AS etld1 FROM hosts""")
def registrable_names(spark, sf):
    found = N.with_etld1(A.hosts(spark, sf).select("host").distinct(), N.suffix_rules(spark),
                         "host")
    return found.select("host", "etld1")


@query(f"""WITH {HOSTS} SELECT DISTINCT host, split_part(host, '.', 1) AS label,
len(string_split(host, '.')) AS n_suffixes, reverse(host) AS name_rev,
host[length(split_part(host, '.', 1)) + 2:] AS parent FROM hosts""")
def host_parts(spark, sf):
    s = N.suffixes("host")
    return A.hosts(spark, sf).select("host").distinct().select(
        "host", N.leftmost_label("host").alias("label"),
        F.size(s).cast("long").alias("n_suffixes"), N.reversed_name("host").alias("name_rev"),
        F.get(s, F.lit(1)).alias("parent"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part),
f AS (SELECT p_partkey, c, count(*) AS n FROM w WHERE c <> '' GROUP BY 1, 2)
SELECT p_partkey, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (
SELECT *, CAST(sum(n) OVER (PARTITION BY p_partkey) AS DOUBLE) AS t FROM f) GROUP BY 1""")
def label_entropy(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.round(N.entropy("p_name"), 6)
                                             .alias("entropy"))


_WORDS = ", ".join(f"({i}, '{w}', '{c}')" for i, (w, c) in enumerate(
    (w, c) for c, ws in refdata.KEYWORDS.items() for w in ws))


@query(f"""WITH kw(i, word, grp) AS (VALUES {_WORDS}), n AS (SELECT p_partkey, CASE p_partkey % 5
WHEN 0 THEN 'metrics-' WHEN 1 THEN 'pixel-adserver-' WHEN 2 THEN 'telemetry-collect-' ELSE '' END ||
replace(lower(p_name), ' ', '.') AS name FROM part)
SELECT p_partkey, name, arg_min(word, i) AS word, arg_min(grp, i) AS grp
FROM n JOIN kw ON strpos(name, word) > 0 GROUP BY 1, 2""")
def keyword_hits(spark, sf):
    k = F.col("p_partkey") % 5
    name = F.concat(F.when(k == 0, "Metrics-").when(k == 1, "pixel-adserver-")
                    .when(k == 2, "telemetry-collect-").otherwise(""),
                    F.replace("p_name", F.lit(" "), F.lit(".")))
    rows = A.table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return (rows.withColumn("h", N.keyword_hit("name", refdata.KEYWORDS))
            .where(F.col("h").isNotNull())
            .select("p_partkey", F.lower("name").alias("name"), "h.word",
                    F.col("h.category").alias("grp")))


@query("""WITH t AS (SELECT 'p' || p_partkey || '.' || lower(p_type) || '.' || CASE p_partkey % 4
WHEN 0 THEN 'gstatic.com' WHEN 1 THEN 'x.doubleclick.net' WHEN 2 THEN 'notgstatic.com'
ELSE 'shop.vn' END AS name FROM part)
SELECT name, CASE WHEN name LIKE '%.gstatic.com' THEN 'gstatic.com'
WHEN name LIKE '%.shop.vn' THEN 'shop.vn' END AS protected_by,
CASE WHEN name LIKE '%.doubleclick.net' THEN 'doubleclick.net' END AS adtech FROM t""")
def protected_names(spark, sf):
    p = A.table(spark, sf, "part")
    tail = (F.when(F.col("p_partkey") % 4 == 0, "gstatic.com")
            .when(F.col("p_partkey") % 4 == 1, "x.doubleclick.net")
            .when(F.col("p_partkey") % 4 == 2, "notgstatic.com").otherwise("shop.vn"))
    named = p.select(F.concat_ws(".", F.concat(F.lit("p"), F.col("p_partkey").cast("string")),
                                 F.lower("p_type"), tail).alias("name"))
    return N.is_protected(named, ("shop.vn",)).withColumn(
        "adtech", N.suffix_hit("name", refdata.ADTECH_SUFFIXES))


@query(f"""WITH {HOSTS}, h AS (SELECT DISTINCT host FROM hosts),
t AS (SELECT DISTINCT host AS suffix FROM hosts UNION SELECT 'example.org'
UNION SELECT 'example.net')
SELECT host, arg_max(suffix, length(suffix)) AS suffix FROM h JOIN t
ON host = suffix OR host LIKE '%.' || suffix WHERE suffix NOT LIKE 'www%' GROUP BY 1""")
def suffix_join(spark, sf):
    h = A.hosts(spark, sf).select("host").distinct()
    table = h.select(F.col("host").alias("suffix")).union(
        h.select(F.substring_index("host", ".", -2).alias("suffix")).where(
            F.col("suffix").isin("example.org", "example.net"))
    ).distinct().where(~F.col("suffix").startswith("www"))
    return N.suffix_match(h, table)


# Pages -------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(html,
'(?is)<script.*?</script>|<script.*$', '', 'g'), '(?is)<style.*?</style>|<style.*$', '', 'g') AS bare
FROM pages)
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
CAST(strlen(trim(regexp_replace(regexp_replace(regexp_replace(bare, '(?s)<[^>]*(>|$)', '', 'g'),
'>', '', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))) AS BIGINT) AS text_len,
CAST(strlen(html) AS BIGINT) AS body_len, CASE WHEN contains(lower(html), 'dan.com') THEN 'Dan.com'
ELSE '' END AS parking FROM s""")
def page_facts(spark, sf):
    return pages.analyze_pages(A.table(spark, sf, "pages")).select(
        "page_id", "title", F.col("text_len").cast("long").alias("text_len"),
        F.col("body_len").cast("long").alias("body_len"), "parking")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'uid' ELSE '' END AS tracking_cookie,
CAST(CASE WHEN page_id % 3 = 0 THEN 90 + page_id % 100 ELSE 0 END AS INTEGER) AS cookie_max_days
FROM pages""")
def tracking_cookies(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id")
    days = F.col("page_id") % 100 + F.when(F.col("page_id") % 3 == 0, 90).otherwise(-20)
    value = F.concat(F.lit("uid=x; Max-Age="), (days * 86400).cast("string"),
                     F.when(F.col("page_id") % 3 == 1, "; Secure").otherwise(
                         "; SameSite=None; Secure"))
    seen = p.select("page_id", F.array(F.lit("sid=1; Path=/"), F.when(
        F.col("page_id") % 3 == 2, F.concat(F.lit("uid=x; SameSite=None; Secure; Max-Age="),
                                            (F.col("page_id") % 80 * 86400).cast("string")))
        .otherwise(value)).alias("set_cookie"))
    return pages.tracking_cookie(seen).drop("set_cookie")


# Lists -------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT CAST(5 AS INTEGER) AS source_id, 'p' || p_partkey || '.example' AS domain FROM part
WHERE p_partkey % 6 IN (0, 1, 3)""")
def blocklist_hosts(spark, sf):
    """Hosts lines in several spellings, comments and junk among them."""
    k = F.col("p_partkey")
    host = F.concat(F.lit("p"), k.cast("string"), F.lit(".example"))
    line = (F.when(k % 6 == 0, F.concat(F.lit("0.0.0.0 "), host, F.lit(" # note")))
            .when(k % 6 == 1, F.concat(F.lit("  "), F.upper(host), F.lit(".")))
            .when(k % 6 == 2, F.concat(F.lit("# "), host))
            .when(k % 6 == 3, F.concat(F.lit("127.0.0.1\t"), host, F.lit("\tother")))
            .when(k % 6 == 4, F.lit("127.0.0.1 localhost.localdomain"))
            .otherwise(F.concat(F.lit("0.0.0.0 bad^"), host)))
    lines = A.table(spark, sf, "part").select(line.alias("value"))
    return list_sources.parse_blocklist(lines.union(lines), "hosts", 5)


@query("""SELECT 'adblock' AS fmt, 'p' || p_partkey || '.example' AS domain FROM part
WHERE p_partkey % 3 = 0 UNION ALL SELECT 'plain', 'p' || p_partkey || '.example' FROM part
WHERE p_partkey % 3 <> 2""")
def blocklist_formats(spark, sf):
    k = F.col("p_partkey")
    host = F.concat(F.lit("p"), k.cast("string"), F.lit(".example"))
    adblock = (F.when(k % 3 == 0, F.concat(F.lit("||"), host, F.lit("^$third-party")))
               .when(k % 3 == 1, F.concat(F.lit("! "), host))
               .otherwise(F.concat(F.lit("@@||"), host, F.lit("^"))))
    plain = (F.when(k % 3 == 0, F.concat(host, F.lit(" trailing words")))
             .when(k % 3 == 1, F.concat(host, F.lit("#note"))).otherwise(F.lit("<html>")))
    p = A.table(spark, sf, "part")
    rows = [list_sources.parse_blocklist(p.select(v.alias("value")), fmt, 1).select(
        F.lit(fmt).alias("fmt"), "domain") for fmt, v in (("adblock", adblock), ("plain", plain))]
    return rows[0].unionByName(rows[1])


@query(f"""WITH {LE}, n AS (SELECT source_id, count(*) AS new_count FROM le
WHERE source_id <> 3 OR length(domain) % 5 = 0 GROUP BY 1),
o AS (SELECT source_id, count(*) AS prev_count FROM le GROUP BY 1)
SELECT o.source_id, coalesce(new_count, 0) AS new_count, prev_count,
CASE WHEN coalesce(new_count, 0) / prev_count < 0.5 THEN 'suspicious_drop' ELSE 'ok' END AS status
FROM o LEFT JOIN n USING (source_id)""")
def sync_guard(spark, sf):
    old = A.list_entries(spark, sf)
    new = old.where((F.col("source_id") != 3) | (F.length("domain") % 5 == 0))
    return list_sources.guard_drop(new, old).select("source_id", "new_count", "prev_count",
                                                    "status")


@query(f"""WITH {LE} SELECT source_id, domain FROM le WHERE source_id IN (3, 6)
OR length(domain) % 5 <> 0""")
def guarded_sync(spark, sf):
    """Sources lose entries: one loses too many and keeps all, one does not sync at all."""
    old = A.list_entries(spark, sf)
    new = old.where((F.col("source_id") != 6) & F.when(
        F.col("source_id") == 3, F.length("domain") % 5 == 0).otherwise(
            F.length("domain") % 5 != 0))
    return list_sources.sync_entries(new, old)


@query(f"""WITH {LE}, s AS (SELECT source_id, count(*) AS n FROM le GROUP BY 1)
SELECT a.source_id AS a, b.source_id AS b, count(*) AS shared,
round(count(*) / (any_value(sa.n) + any_value(sb.n) - count(*)), 6) AS jaccard
FROM le a JOIN le b ON a.domain = b.domain AND a.source_id < b.source_id
JOIN s sa ON sa.source_id = a.source_id JOIN s sb ON sb.source_id = b.source_id GROUP BY 1, 2""")
def source_overlap(spark, sf):
    return catalog.source_overlap(A.list_entries(spark, sf)).withColumn("jaccard", six("jaccard"))


@query(f"""WITH {LE} SELECT source_id, count(*) AS unique_entries FROM le a WHERE NOT EXISTS (
SELECT 1 FROM le b WHERE b.domain = a.domain AND b.source_id <> a.source_id) GROUP BY 1""")
def source_unique(spark, sf):
    return catalog.source_unique(A.list_entries(spark, sf))


@query(f"""WITH {LE} SELECT source_id, domain FROM le a WHERE NOT EXISTS (
SELECT 1 FROM le b WHERE b.domain = a.domain AND b.source_id <> a.source_id)""")
def only_in_one_source(spark, sf):
    return catalog.only_in_one_source(A.list_entries(spark, sf))


NE = DOM + """, entries AS (
  SELECT k % 3 AS source_id, name AS domain FROM dom WHERE k % 10 IN (1, 2)
  UNION SELECT 0, etld1 FROM dom WHERE etld1 = 'click.example'
  UNION SELECT 2, 'eulerian.net' FROM dom WHERE k % 4 = 0)"""


@query(f"""WITH {NE} SELECT name, source_id, n_name AS source_name,
CASE n_nationkey % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'malware' END AS category
FROM dom JOIN entries ON domain = name LEFT JOIN nation ON n_nationkey = source_id""")
def list_membership(spark, sf):
    return joins.membership(A.domains(spark, sf).select("name"), A.name_entries(spark, sf),
                            A.list_sources_table(spark, sf))


@query(f"""WITH {NE} SELECT name, EXISTS (SELECT 1 FROM entries WHERE domain = name) AS in_list,
EXISTS (SELECT 1 FROM entries WHERE domain = etld1) AS etld1_in_list FROM dom""")
def list_flags(spark, sf):
    e = A.name_entries(spark, sf)
    d = A.domains(spark, sf).select("name", "etld1")
    return joins.list_flags(joins.list_flags(d, e, "name", "in_list"), e, "etld1",
                            "etld1_in_list").drop("etld1")


@query("""SELECT 'c' || c_custkey AS etld1, CAST(CASE WHEN c_custkey BETWEEN 1 AND 1000 THEN c_custkey ELSE 0 END AS BIGINT) AS rank FROM customer""")
def rank_lookup(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey")
    lines = c.select(F.concat(
        F.col("c_custkey").cast("string"), F.lit(", C"), F.col("c_custkey").cast("string"))
        .alias("value"))
    ranks = list_sources.parse_rank(lines, 1000)
    roots = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("etld1"))
    return joins.rank_of(roots, ranks)


@query("""SELECT s_suppkey AS source_id FROM supplier WHERE s_nationkey % 2 = 0
AND (s_suppkey % 5 = 0 OR 3600 * (s_suppkey % 48) >= 86400)""")
def sources_due(spark, sf):
    s = A.table(spark, sf, "supplier")
    last = F.timestamp_seconds(F.unix_seconds(F.lit(A.AS_OF).cast("timestamp"))
                               - F.col("s_suppkey") % 48 * 3600)
    table = s.select(F.col("s_suppkey").alias("source_id"),
                     (F.col("s_nationkey") % 2 == 0).alias("enabled"),
                     F.when(F.col("s_suppkey") % 5 != 0, last).alias("last_sync_at"),
                     F.lit(86400).alias("interval_sec"))
    return list_sources.sources_due(table, A.AS_OF).select("source_id")


# Facts -------------------------------------------------------------------------------------------

# (source, condition on k) of the stored lookups, as in the adapter.
_HAS = {"dns": "k % 4 = 0 OR k % 10 = 3", "asn": "k % 6 IN (1, 2)", "cert": "k % 9 = 4",
        "rdap": "k % 8 = 5", "rank": "k % 13 = 6", "http": "k % 5 IN (2, 3, 4)",
        "vt": "k % 17 IN (3, 4)", "ai": "k % 19 IN (2, 3, 4)"}
FRESH = "(k % 7 <> 0 AND k % 9 <> 0)"


@query(f"""WITH {DOM} SELECT name, query_count FROM dom
WHERE status IN ('new', 'staging', 'blocked') AND NOT ((k % 6 IN (1, 2)) AND k % 7 <> 0)""")
def enrich_candidates(spark, sf):
    return facts_plan.enrich_candidates(A.domains(spark, sf), A.facts(spark, sf), "asn",
                                        A.AS_OF).select("name", "query_count")


@query(f"""WITH {DOM} SELECT name, query_count FROM dom WHERE status IN ('new', 'staging')
AND NOT (({_HAS["vt"]}) AND k % 7 <> 0) AND query_count >= 5 AND score >= 3""")
def gated_candidates(spark, sf):
    return facts_plan.gated_candidates(A.domains(spark, sf), A.facts(spark, sf), "vt",
                                       A.AS_OF).select("name", "query_count")


@query(f"""WITH {DOM} SELECT name, {", ".join(f"({t}) AS has_{s}" for s, t in _HAS.items())},
CAST(CASE WHEN k % 6 = 1 THEN 62597 WHEN k % 6 = 2 THEN 15169 END AS BIGINT) AS asn
FROM dom WHERE {FRESH} AND ({" OR ".join(f"({t})" for t in _HAS.values())})""")
def facts_wide(spark, sf):
    wide = facts_plan.facts_wide(A.facts(spark, sf), A.AS_OF)
    return wide.select("name", *[F.col(s).isNotNull().alias(f"has_{s}") for s in _HAS],
                       F.col("asn.asn").alias("asn"))


@query(f"""WITH {DOM} SELECT source, count(*) AS n, count(*) FILTER (k % 9 = 0) AS failed FROM (
{" UNION ALL ".join(f"SELECT '{s}' AS source, k FROM dom WHERE {t}" for s, t in _HAS.items())})
GROUP BY 1""")
def facts_shown(spark, sf):
    shown = facts_plan.facts_for(A.facts(spark, sf))
    return shown.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("data").startswith('{"error"')).alias("failed"))


_SAVED = """CASE WHEN k % 3 = 1 THEN 'timeout' WHEN k % 3 = 2 THEN 'other' ELSE 'ok' END"""


@query(f"""WITH {DOM} SELECT source, outcome, ttl, count(*) AS n, count(*) FILTER (kept) AS kept FROM (
SELECT source, {_SAVED} AS outcome, k % 3 <> 0 AND has AS kept,
CAST(CASE WHEN k % 3 = 0 THEN CASE source WHEN 'http' THEN 14 * 86400 ELSE 30 * 86400 END
WHEN source = 'http' AND k % 3 = 1 THEN 2 * 86400 WHEN source = 'http' THEN 3 * 86400
WHEN k % 3 = 2 THEN 6 * 3600 ELSE 900 END AS BIGINT) AS ttl
FROM (SELECT 'http' AS source, k, {_HAS["http"]} AS has FROM dom
UNION ALL SELECT 'vt', k, {_HAS["vt"]} FROM dom)) GROUP BY 1, 2, 3""")
def saved_facts(spark, sf):
    """New results over old facts: a failure keeps the old data."""
    base = A.facts(spark, sf).where(F.col("source").isin("http", "vt")).drop("k")
    k = F.col("k")
    outcome = F.when(k % 3 == 1, "timeout").when(k % 3 == 2, "other").otherwise("ok")
    new = (A.domains(spark, sf).select("name", "k")
           .withColumn("source", F.explode(F.array(F.lit("http"), F.lit("vt"))))
           .select("name", "source", F.lit("{}").alias("data"), outcome.alias("outcome"),
                   F.when(k % 3 != 0, "failed").alias("error"), "k"))
    saved = facts_plan.save_facts(base, new, A.AS_OF).join(new.select(
        "name", "source", "outcome", "k"), ["name", "source"])
    ttl = F.unix_seconds("expires_at") - F.unix_seconds("fetched_at")
    return saved.groupBy("source", "outcome", ttl.alias("ttl")).agg(
        F.count("*").alias("n"), F.count_if(F.col("data") != "{}").alias("kept"))


_ERRORS = {0: "lookup x: no such host", 1: "context deadline exceeded",
           2: "dial tcp: connection refused", 3: "tls: bad certificate", 4: "quota exceeded",
           5: "domain not found", 6: "points to a private address", 7: "odd"}
_CODES = ["dns_fail", "timeout", "refused", "tls_error", "quota", "not_found", "blocked_host",
          "other", "ok"]


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS outcome FROM part")
def error_outcomes(spark, sf):
    text = F.coalesce(*[F.when(F.col("p_partkey") % 9 == i, F.lit(t)) for i, t in _ERRORS.items()])
    return A.table(spark, sf, "part").select("p_partkey",
                                             facts_plan.outcome_of(text).alias("outcome"))


@query("""SELECT 'c' || c_custkey AS name, 'CA ' || c_nationkey AS issuer, CAST(3 AS BIGINT) AS n,
'*.c' || c_custkey || '.example|c' || c_custkey || '.example|m.example' AS sans FROM customer""")
def certificate_log(spark, sf):
    c = F.col("c_custkey").cast("string")
    body = F.to_json(F.array(
        F.struct(F.concat(F.lit("*.C"), c, F.lit(".example\nc"), c, F.lit(".example"))
                 .alias("name_value"),
                 F.concat(F.lit("CA "), F.col("c_nationkey").cast("string")).alias("issuer_name")),
        F.struct(F.concat(F.lit(" c"), c, F.lit(".example \nM.example")).alias("name_value"),
                 F.lit("other").alias("issuer_name"))))
    raw = A.table(spark, sf, "customer").select(F.concat(F.lit("c"), c).alias("name"),
                                                body.alias("body"))
    return facts_plan.parse_cert_log(raw).select(
        "name", "issuer", F.size("sans").cast("long").alias("n"),
        F.array_join("sans", "|").alias("sans"))


@query("""SELECT 'o' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS registered_at,
CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age_days
FROM orders""")
def registrations(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(F.struct(F.array(
        F.struct(F.lit("expiration").alias("eventAction"), F.lit("x").alias("eventDate")),
        F.struct(F.lit("registration").alias("eventAction"), stamp.alias("eventDate"))
    ).alias("events")))
    raw = A.table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), body.alias("body"))
    return facts_plan.parse_registration(raw, A.AS_OF)


@query("""SELECT 'p' || p_partkey AS name, CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_size ELSE 0 END
AS INTEGER) AS malicious, CAST(CASE WHEN p_partkey % 4 <> 0 THEN 60 ELSE 0 END AS INTEGER)
AS harmless, p_partkey % 4 <> 0 AS known FROM part WHERE p_partkey % 9 <> 0""")
def scanner_replies(spark, sf):
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.col("p_size").alias("malicious"), F.lit(60).alias("harmless"))
        .alias("last_analysis_stats")).alias("attributes")).alias("data")))
    k = F.col("p_partkey")
    raw = A.table(spark, sf, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("name"), body.alias("body"),
        F.when(k % 9 == 0, 429).when(k % 4 == 0, 404).otherwise(200).alias("status"))
    return facts_plan.parse_scan(raw).select("name", "malicious", "harmless", "known")


@query("""WITH RECURSIVE w AS (SELECT c_custkey AS start, c_custkey AS now, 0 AS hops FROM customer
UNION ALL SELECT start, now // 3, hops + 1 FROM w WHERE now // 3 <> now)
SELECT 'c' || start || '.example' AS name, CAST(max(hops) AS BIGINT) AS hops,
coalesce('c' || CAST(arg_max(now, hops) FILTER (hops > 0) AS BIGINT) || '.example', '') AS last
FROM w GROUP BY start""")
def cname_chains(spark, sf):
    records = A.cname_records(spark, sf)
    chains = facts_plan.cname_chain(records.select("name"), records)
    n = F.size("cname_chain")
    return chains.select("name", n.cast("long").alias("hops"), F.coalesce(
        F.get("cname_chain", n - 1), F.lit("")).alias("last"))


@query("""WITH m AS (SELECT max(c_custkey) AS m FROM customer),
p AS (SELECT c_custkey AS c, c_custkey % 500 AS p, c_custkey // 500 * 500 + 499 AS e, c_custkey // 500 % 2 = 0 AS loops FROM customer),
w AS (SELECT c, CASE WHEN e > m THEN m + 1 - c WHEN loops AND p >= 250 THEN 249 ELSE e - c END AS hops,
CASE WHEN e > m THEN m + 1 WHEN loops AND p > 250 THEN c - 1 ELSE e END AS last, loops AND e <= m AS looped FROM p, m)
SELECT 'c' || c || '.example' AS name, CAST(hops AS BIGINT) AS hops,
CASE WHEN hops = 0 THEN '' ELSE 'c' || last || '.example' END AS last, looped FROM w""")
def cname_long_chains(spark, sf):
    """Chains of up to 499 hosts; every other one runs into a loop of 250."""
    c = F.col("c_custkey")
    p, even = c % 500, F.floor(c / 500) % 2 == 0
    target = F.when(p < 499, c + 1).when(even, c - 249)
    records = A.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), c.cast("string"), F.lit(".example")).alias("name"),
        F.concat(F.lit("C"), target.cast("string"), F.lit(".Example")).alias("target"))
    chains = facts_plan.cname_chain(records.select("name"), records)
    n = F.size("cname_chain")
    return chains.select("name", n.cast("long").alias("hops"), F.coalesce(
        F.get("cname_chain", n - 1), F.lit("")).alias("last"), "looped")


# Rules and scores --------------------------------------------------------------------------------


def _custom(spark, sf):
    """Operator additions made from parts: every kind, good and bad."""
    rows = A.table(spark, sf, "part").select(
        (F.col("p_partkey") % 6).alias("g"), F.col("p_partkey").alias("k"))
    ks = F.col("k").cast("string")
    lit = F.lit
    kind = (F.when(F.col("g") < 3, "adtech_domains").when(F.col("g") == 3, "adtech_asns")
            .when(F.col("g") == 4, "shared_cdn").otherwise("keywords"))
    key = (F.when(F.col("g") == 0, F.concat(lit("*.P"), ks, lit(".example.")))
           .when(F.col("g") == 1, F.concat(lit("p"), ks, lit(".vnpay.vn")))
           .when(F.col("g") == 2, F.concat(lit("p"), ks))
           .when(F.col("g") == 3, F.when(F.col("k") % 4 == 1, lit("15169")).otherwise(ks))
           .when(F.col("g") == 4, F.concat(lit("cdn"), ks, lit(".example")))
           .otherwise(F.when(F.col("k") % 4 == 3, lit("ab")).otherwise(F.concat(lit("word"), ks))))
    return rows.select(kind.alias("kind"), key.alias("key"), F.when(
        kind != "shared_cdn", lit("ads")).alias("value"), F.when(
            kind == "adtech_asns", lit("Org")).alias("org"))


@query("""SELECT field, value, reason FROM (
SELECT 'adtech_domains' AS field, 'p' || p_partkey || '.vnpay.vn' AS value, 'protected name' AS reason
FROM part WHERE p_partkey % 6 = 1
UNION SELECT 'adtech_domains', 'p' || p_partkey, 'not a full domain name' FROM part
WHERE p_partkey % 6 = 2
UNION SELECT 'adtech_asns', '15169', 'neutral network: Google' FROM part
WHERE p_partkey % 6 = 3 AND p_partkey % 4 = 1
UNION SELECT 'keywords', 'ab', 'shorter than 3 bytes' FROM part
WHERE p_partkey % 6 = 5 AND p_partkey % 4 = 3)""")
def rule_errors(spark, sf):
    return rules.validate_rules(_custom(spark, sf))


@query(f"""SELECT 'adtech_domains' AS kind, count(DISTINCT p_partkey) + {len(refdata.ADTECH_SUFFIXES)} AS n
FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT 'shared_cdn', count(*) + {len(refdata.SHARED_CDN)} FROM part WHERE p_partkey % 6 = 4
UNION ALL SELECT 'keywords', count(*) + 1 + {sum(map(len, refdata.KEYWORDS.values()))} FROM part
WHERE p_partkey % 6 = 5 AND p_partkey % 4 <> 3
UNION ALL SELECT 'adtech_asns', count(*) + 1 + {len(refdata.ADTECH_ASNS)} FROM part
WHERE p_partkey % 6 = 3 AND p_partkey % 4 <> 1 AND p_partkey NOT IN ({
    ", ".join(map(str, refdata.ADTECH_ASNS))})
UNION ALL SELECT 'thresholds', {len(refdata.THRESHOLDS)}""")
def merged_rules(spark, sf):
    usable = _custom(spark, sf).where(~((F.col("kind") == "adtech_domains")
                                        & ~F.col("key").startswith("*.")))
    return rules.merge_rules(usable).groupBy("kind").agg(F.count("*").alias("n"))


def stored_domains(spark, sf):
    """The name table, which jobs normally keep, written once for all branches that read it."""
    return cut_lineage(A.domains(spark, sf))


def score_rows(spark, sf, only_open=True, names=None):
    """Candidate rows of the event names with all their evidence."""
    names = stored_domains(spark, sf) if names is None else names
    d = names.select("name", "etld1", "k", "query_count", "client_count", "status", "is_manual")
    return score.assemble_candidates(
        d, facts_plan.facts_wide(A.facts(spark, sf, names), A.AS_OF),
        behavior.behavior(A.events(spark, sf), gap=3600), A.name_entries(spark, sf, names),
        A.list_sources_table(spark, sf), only_open=only_open)


# The classifier as plain SQL over k: one column per signal.
SCORES = f"""b AS (SELECT r.name, third_party / sample_size AS ratio, interval_cv AS cv
FROM ({PRECEDED}) r JOIN ({CV}) c USING (name)),
s0 AS (SELECT d.*, coalesce(b.ratio, 0) AS ratio, coalesce(b.cv, 0) AS cv, {FRESH} AS ok,
count(*) OVER (PARTITION BY d.etld1) AS subs FROM dom d LEFT JOIN b USING (name)),
s1 AS (SELECT *,
CASE WHEN ok AND k % 4 = 0 THEN 6.0 END AS cname_adtech,
CASE WHEN ok AND k % 4 = 0 THEN 5.0 END AS cname_blocked,
CASE WHEN ok AND k % 6 = 1 THEN 4.0 END AS asn_adtech,
CASE WHEN ok AND k % 9 = 4 THEN 3.0 END AS cert_adtech,
CASE WHEN ratio > 0.8 THEN 2.5 WHEN ratio >= 0.5 THEN 1.0 END AS third_party,
CASE WHEN client_count >= 5 AND ratio > 0.6 THEN 1.5 END AS fan_out,
CASE WHEN query_count >= 50 AND cv > 0 AND cv < 0.35 THEN 2.0 END AS beacon,
CASE WHEN subs >= 50 THEN 2.5 WHEN subs >= 15 THEN 1.2 END AS spread,
CASE WHEN etld1 = 'click.example' THEN 4.0 END AS etld1_blocked,
CASE WHEN ok AND k % 5 = 2 THEN 4.0 END AS http_beacon,
CASE WHEN ok AND k % 5 = 4 THEN 4.0 END AS http_redirect,
CASE WHEN ok AND k % 5 = 3 AND k * 100 >= 1500 THEN -2.0 END AS real_site,
CASE WHEN ok AND k % 17 = 3 THEN 4.0 WHEN ok AND k % 17 = 4 THEN -1.0 END AS vt,
CASE WHEN ok AND k % 19 = 2 THEN 2.5 WHEN ok AND k % 19 = 3 THEN -2.0 END AS ai,
CASE WHEN ok AND k % 13 = 6 AND k > 0 THEN -8.0 END AS high_rank,
CASE WHEN ok AND k % 8 = 5 AND k % 4 <> 0 AND k % 6 <> 1 AND k % 9 <> 4 THEN -2.0 END AS long_lived,
CASE WHEN ok AND k % 10 = 3 AND k % 4 <> 0 THEN -6.0 END AS shared_cdn,
list_contains([1, 2], k % 10) AND k % 3 = 1 AS in_malware FROM s0),
s2 AS (SELECT *, [cname_adtech, cname_blocked, asn_adtech, cert_adtech, third_party, fan_out, beacon,
spread, etld1_blocked, http_beacon, http_redirect, real_site, vt, ai, high_rank, long_lived,
shared_cdn] AS w, list_aggregate([cname_adtech, cname_blocked, asn_adtech, cert_adtech, http_beacon,
http_redirect], 'count') AS infra FROM s1),
scores AS (SELECT name, k, status, is_manual, CAST(round(list_sum(w), 2) AS DOUBLE)
AS score, infra, list_aggregate(w, 'count') AS total,
CASE WHEN shared_cdn < 0 OR high_rank < 0 THEN 'cdn' WHEN in_malware THEN 'malware'
WHEN vt > 0 THEN 'malware'
WHEN http_beacon > 0 AND coalesce(cname_adtech, 0) = 0 AND coalesce(asn_adtech, 0) = 0
  AND coalesce(etld1_blocked, 0) = 0 THEN 'telemetry'
WHEN http_redirect > 0 THEN 'ads' WHEN cname_adtech > 0 THEN 'tracking'
WHEN asn_adtech > 0 THEN 'ads' WHEN infra > 0 THEN 'ads' ELSE 'content' END AS category,
CASE WHEN infra >= 2 THEN 0.95 WHEN infra = 1 AND list_aggregate(w, 'count') >= 3
THEN 0.85 WHEN infra = 1 THEN 0.7 WHEN list_aggregate(w, 'count') >= 4 THEN 0.6
ELSE 0.4 END AS confidence FROM s2)"""
SCORED = f"WITH {DOM}, {SCORES}"


@query(f"""{SCORED} SELECT name, coalesce(score, 0.0) AS score, category, CAST(confidence AS DOUBLE)
AS confidence, CAST(total AS BIGINT) AS signals FROM scores
WHERE NOT is_manual AND status IN ('new', 'staging')""")
def domain_scores(spark, sf):
    return score.score(score_rows(spark, sf)).select(
        "name", "score", "category", "confidence", F.size("signals").cast("long").alias("signals"))


@query(f"""{SCORED} SELECT name, coalesce(score, 0.0) AS score, category, CAST(confidence AS DOUBLE)
AS confidence FROM scores""")
def all_domain_scores(spark, sf):
    return score.score(score_rows(spark, sf, only_open=False)).select(
        "name", "score", "category", "confidence")


@query(f"""{SCORED}, {CATEGORIES}, t AS (SELECT s.*, c.enabled AND coalesce(score, 0) >= threshold AS a,
c.enabled AND round(coalesce(score, 0) - CASE WHEN etld1 = 'click.example' THEN 4 ELSE 0 END, 2)
>= threshold AS b FROM (SELECT scores.*, d.etld1 FROM scores JOIN dom d USING (name)) s
JOIN cat c ON c.key = s.category WHERE NOT is_manual AND status IN ('new', 'staging'))
SELECT count(*) FILTER (NOT a AND b) AS would_block, count(*) FILTER (a AND NOT b) AS would_unblock,
count(*) FILTER (a = b) AS unchanged, count(*) AS evaluated FROM t""")
def weight_impact(spark, sf):
    """Dry run of another weight: roots on lists stop counting."""
    counts, _ = score.simulate(score_rows(spark, sf), category_table(spark), (None, None),
                               (None, {"etld1_blocked": 0.0}))
    return counts


@query(f"""{SCORED} SELECT kind, count(*) AS n FROM (SELECT unnest(['cname_adtech', 'cname_blocked', 'asn_adtech',
'cert_adtech', CASE WHEN third_party > 2 THEN 'third_party' ELSE 'third_party_weak' END, 'fan_out', 'beacon',
CASE WHEN spread > 2 THEN 'spread_high' ELSE 'spread_mid' END, 'etld1_blocked', 'http_beacon', 'http_redirect_adtech',
'http_real_site', CASE WHEN vt > 0 THEN 'vt_malicious' ELSE 'vt_clean' END,
CASE WHEN ai > 0 THEN 'ai_adtech' ELSE 'ai_clean' END, 'high_rank', 'long_lived_content', 'shared_cdn']) AS kind,
unnest(w) AS w FROM s2) WHERE w IS NOT NULL GROUP BY 1""")
def signal_counts(spark, sf):
    scored = score.with_signals(score_rows(spark, sf, only_open=False))
    return (scored.select(F.explode("signals").alias("s")).groupBy(F.col("s.kind").alias("kind"))
            .agg(F.count("*").alias("n")))


@query(f"""{SCORED}, p AS (SELECT name, status, query_count FROM dom
ORDER BY query_count DESC, name LIMIT 50)
SELECT p.name, CAST(s.total AS BIGINT) AS n FROM p JOIN scores s USING (name)
WHERE s.total > 0""")
def page_signals(spark, sf):
    """Signals of the 50 busiest names, heaviest first."""
    signals = score.with_signals(score_rows(spark, sf, only_open=False)).select(
        "name", F.explode("signals").alias("s")).select("name", "s.kind", "s.weight")
    top = A.domains(spark, sf).orderBy(F.desc("query_count"), "name").limit(50).select("name")
    rows = search.signals_of(top, signals).where(F.col("signals").isNotNull())
    return rows.select("name", F.size("signals").cast("long").alias("n"))


@query("""SELECT count(*) FILTER (quality = 1 AND n_chars > 500) AS true_positive,
count(*) FILTER (n_chars > 500) AS predicted, count(*) FILTER (quality = 1) AS actual,
count(*) AS labelled,
round(count(*) FILTER (quality = 1 AND n_chars > 500) / count(*) FILTER (n_chars > 500), 6)
AS precision,
round(count(*) FILTER (quality = 1 AND n_chars > 500) / count(*) FILTER (quality = 1), 6) AS recall
FROM documents JOIN labels USING (doc_id)""")
def precision_recall(spark, sf):
    predicted = A.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500)
                                                       .alias("positive"))
    truth = A.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return score.precision_recall(predicted, truth, "doc_id").select(
        "true_positive", "predicted", "actual", "labelled", six("precision"), six("recall"))


@query(f"""{SCORED}, banded AS (SELECT name, coalesce(score, 0.0) AS score, CASE WHEN coalesce(score, 0) < 3
THEN 'under' WHEN score < 5.5 THEN 'near' WHEN score < 8 THEN 'over' ELSE 'far' END AS band FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(name), name) AS rn FROM banded)
SELECT name, score, band FROM ranked
WHERE rn <= CASE band WHEN 'near' THEN 100 WHEN 'over' THEN 100 ELSE 50 END""")
def evaluation_sample(spark, sf):
    """Stratified by score band, in the order of a hash of the name."""
    return score.eval_sample(score.score(score_rows(spark, sf, only_open=False))).select(
        "name", "score", "band")


# Model prompts and replies -----------------------------------------------------------------------


@query("""SELECT p_partkey // 40 AS reply_id, 'd' || p_partkey || '.example' AS domain,
CASE p_partkey % 10 WHEN 1 THEN 'ads' WHEN 4 THEN 'tracking' ELSE 'content' END AS category,
CAST(CASE p_partkey % 10 WHEN 1 THEN 0.85 WHEN 4 THEN 0.9 WHEN 6 THEN 0.6 WHEN 7 THEN 0.7
WHEN 8 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence,
CASE p_partkey % 10 WHEN 1 THEN 'first, with comma' WHEN 4 THEN 'quoted, text' ELSE 'ok' END AS reason
FROM part WHERE p_partkey % 10 IN (1, 4, 6, 7, 8, 9)""")
def model_verdicts(spark, sf):
    verdicts, _ = replies.parse_replies(*A.replies(spark, sf))
    return verdicts


@query("""SELECT p_partkey // 40 AS reply_id, count(*) FILTER (p_partkey % 10 IN (1, 4, 6, 7, 8, 9))
AS parsed, count(*) FILTER (p_partkey % 10 IN (0, 2, 3, 5)) AS skipped,
count(*) FILTER (p_partkey % 10 = 0) AS unknown FROM part GROUP BY 1""")
def model_reply_counts(spark, sf):
    _, counts = replies.parse_replies(*A.replies(spark, sf))
    return counts


@query(f"""WITH {DOM}, t AS (SELECT name, query_count, row_number() OVER (ORDER BY query_count DESC, name) - 1 AS p,
'- ' || name || ': ' || concat_ws(', ', query_count || ' queries', client_count || ' clients',
CASE WHEN k % 10 IN (1, 2) THEN 'on a blocklist' WHEN etld1 = 'click.example' THEN 'parent name on a blocklist' END,
CASE WHEN {FRESH} AND k % 17 = 3 THEN '5 malware engines report it' END,
CASE WHEN {FRESH} AND k % 13 = 6 THEN 'popularity rank ' || k * 100 END,
CASE WHEN {FRESH} AND k % 4 = 0 THEN 'alias of x' || k || '.eulerian.net'
     WHEN {FRESH} AND k % 10 = 3 THEN 'alias of d' || k || '.cloudfront.net' END,
CASE WHEN {FRESH} AND k % 6 = 1 THEN 'hosted by Adform' WHEN {FRESH} AND k % 6 = 2 THEN 'hosted by Google' END,
CASE WHEN {FRESH} AND (k % 5 IN (2, 4) OR k % 5 = 3 AND k * 100 < 200) THEN 'page without text' END,
CASE WHEN {FRESH} AND k % 5 = 3 THEN 'page title T' END) AS line FROM dom)
SELECT CAST(p // 40 AS BIGINT) AS batch, count(*) AS n,
'One CSV line (domain,category,confidence,reason) for each of these names, ' || count(*) ||
' in all:' || chr(10) || string_agg(line, chr(10) ORDER BY p) AS prompt FROM t GROUP BY 1""")
def model_prompts(spark, sf):
    return replies.build_prompts(replies.evidence_line(score_rows(spark, sf, only_open=False)))


@query(f"""WITH {DOM}, t AS (SELECT name, query_count, row_number() OVER (
ORDER BY query_count DESC, name) AS position FROM dom)
SELECT name, position, CAST((position - 1) // 40 AS BIGINT) AS batch FROM t""")
def batch_numbers(spark, sf):
    d = A.domains(spark, sf).select("name", "query_count")
    return windows.number_batches(d, [F.desc("query_count"), F.asc("name")]).select(
        "name", F.col("position").cast("long").alias("position"), "batch")


@query("""SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def first_of_duplicates(spark, sf):
    d = A.table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    return windows.dedupe_first(d, ["lang", "source"], ["doc_id"]).drop("n_chars")
