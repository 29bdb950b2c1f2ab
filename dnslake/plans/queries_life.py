"""Queries about the life of names, published lists and the relation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslake.operators import networks, relate, stats
from dnslake.plans import adapters as A
from dnslake.plans import lifecycle, publish, score
from dnslake.plans.queries_names import SCORED, score_rows, stored_domains
from dnslake.plans.registry import CATEGORIES, DOM, REL, query, sec
from dnslake.sources import tables

# Lifecycle ---------------------------------------------------------------------------------------

COLUMNS = ["name", "etld1", "k", "query_count", "client_count", "first_seen", "last_seen", "status",
           "category", "is_manual", "origin", "score", "confidence", "staged_at", "blocked_at"]


@query(f"""WITH {DOM} SELECT name, CASE WHEN status = 'staging' AND NOT is_manual
AND staged_at <= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY THEN 'blocked' ELSE status END AS status,
status = 'staging' AND NOT is_manual AND staged_at <= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY
AS decided FROM dom""")
def promote_staging(spark, sf):
    d = A.domains(spark, sf)
    out, decisions = lifecycle.promote_staging(d, "2024-01-20 00:00:00")
    marks = decisions.select("name", F.lit(True).alias("decided"))
    return out.select("name", "status").join(marks, "name", "left").fillna(False, ["decided"])


@query(f"""WITH {DOM} SELECT name, CASE WHEN status = 'blocked' AND NOT is_manual
AND last_seen <= TIMESTAMP '2024-02-06' - INTERVAL 10 DAY THEN 'new' ELSE status END AS status
FROM dom""")
def expire_blocked(spark, sf):
    out, _ = lifecycle.expire_blocked(A.domains(spark, sf), "2024-02-06 00:00:00", 10)
    return out.select("name", "status")


SAVED = f"""{SCORED}, {CATEGORIES}, m AS (SELECT d.name, d.status, s.score AS raw,
coalesce(s.score, 0.0) AS score, s.category, c.threshold, c.enabled FROM dom d
JOIN scores s USING (name) JOIN cat c ON c.key = s.category
WHERE NOT d.is_manual AND d.status IN ('new', 'staging')),
act AS (SELECT *, CASE WHEN enabled AND score >= threshold AND status = 'new' THEN 'stage'
WHEN status = 'staging' AND score < threshold THEN 'expire' END AS action FROM m)"""


@query(f"""{SAVED} SELECT d.name, CASE action WHEN 'stage' THEN 'staging' WHEN 'expire' THEN 'new'
ELSE d.status END AS status, CASE WHEN a.name IS NULL THEN d.score ELSE a.score END AS score,
CASE WHEN a.name IS NULL THEN d.category ELSE a.category END AS category
FROM dom d LEFT JOIN act a USING (name)""")
def save_scores(spark, sf):
    d = stored_domains(spark, sf)
    out, _ = lifecycle.save_scores(d, score.score(score_rows(spark, sf, names=d)),
                                   publish.category_table(spark), A.AS_OF)
    return out.select("name", "status", "score", "category")


@query(f"""{SAVED} SELECT name, action, 'system' AS actor FROM act WHERE action IS NOT NULL""")
def rescore_decisions(spark, sf):
    d = stored_domains(spark, sf)
    _, decisions = lifecycle.rescore(d, score_rows(spark, sf, names=d),
                                     publish.category_table(spark), A.AS_OF)
    return decisions.select("name", "action", "actor")


def _decision_requests(spark, sf):
    """Requests for every name and for names nobody knows, two for some."""
    d = A.domains(spark, sf).select("name", "k")
    k = F.col("k")
    action = F.when(k % 2 == 0, "block").when(k % 3 == 0, "allow").otherwise("recategorize")
    base = d.select(
        "name", action.alias("action"), F.lit("admin").alias("actor"), F.lit("r").alias("reason"),
        F.when(k % 4 == 0, "malware").alias("category"), (k % 2 == 0).alias("manual"),
        F.lit(1).cast("long").alias("seq"))
    again = base.where(F.col("action") == "allow").withColumn("action", F.lit("ignore")).withColumn(
        "seq", F.lit(2).cast("long"))
    strange = base.where(F.col("action") == "block").withColumn(
        "name", F.concat(F.lit("x-"), "name"))
    return base.unionByName(again).unionByName(strange)


DECIDED = f"""WITH {DOM}, req AS (SELECT name, status, k, k % 2 = 0 AS manual,
CASE WHEN k % 2 = 0 THEN 'block' WHEN k % 3 = 0 THEN 'ignore' ELSE 'recategorize' END AS action
FROM dom), use AS (SELECT * FROM req WHERE status <> 'allowed' OR manual)"""


@query(f"""{DECIDED} SELECT d.name, CASE u.action WHEN 'block' THEN 'blocked' WHEN 'ignore'
THEN 'ignored' ELSE d.status END AS status, d.is_manual OR coalesce(u.manual, false) AS is_manual,
CASE WHEN u.name IS NOT NULL AND d.k % 4 = 0 THEN 'malware' ELSE category END AS category
FROM dom d LEFT JOIN use u USING (name)""")
def apply_decisions(spark, sf):
    out, _, _ = lifecycle.apply_decisions(A.domains(spark, sf), _decision_requests(spark, sf),
                                          A.AS_OF)
    return out.select("name", "status", "is_manual", "category")


@query(f"""{DECIDED} SELECT name, action, 'admin' AS actor FROM use""")
def decision_log(spark, sf):
    _, decisions, _ = lifecycle.apply_decisions(A.domains(spark, sf),
                                                _decision_requests(spark, sf), A.AS_OF)
    return decisions.select("name", "action", "actor")


@query(f"""{DECIDED} SELECT name, action, 'allowed changes by hand only' AS skip_reason FROM req
WHERE status = 'allowed' AND NOT manual
UNION ALL SELECT name, 'allow', 'allowed changes by hand only' FROM req
WHERE status = 'allowed' AND NOT manual AND action = 'ignore'
UNION ALL SELECT name, 'allow', 'superseded in batch' FROM use WHERE action = 'ignore'
UNION ALL SELECT 'x-' || name, 'block', 'unknown name' FROM req WHERE action = 'block'""")
def skipped_decisions(spark, sf):
    _, _, skipped = lifecycle.apply_decisions(A.domains(spark, sf), _decision_requests(spark, sf),
                                              A.AS_OF)
    return skipped


@query(f"""WITH {DOM}, p AS (SELECT p_partkey AS line_no, CASE p_partkey % 6
WHEN 0 THEN 'h' || (p_partkey % 100) || '.view.example' WHEN 1 THEN 'p' || p_partkey || '.new.example'
WHEN 2 THEN 'bad name' WHEN 3 THEN 'p' || p_partkey || '.gstatic.com' WHEN 4 THEN '*.click.example'
ELSE 'p' || (p_partkey - p_partkey % 12) || '.twice.example' END AS name FROM part),
q AS (SELECT *, min(line_no) OVER (PARTITION BY name) AS first FROM p)
SELECT line_no, q.name, CASE WHEN q.name = 'bad name' THEN 'rejected' WHEN line_no <> first
THEN 'duplicate' WHEN q.name LIKE '%gstatic.com' THEN 'rejected' WHEN d.name IS NOT NULL
THEN 'duplicate' ELSE 'created' END AS action, CASE WHEN q.name = 'bad name' THEN 'invalid_domain'
WHEN line_no = first AND q.name LIKE '%gstatic.com' THEN 'domain_protected' END AS code,
CASE WHEN q.name = '*.click.example' AND line_no = first THEN
(SELECT count(*) FROM dom WHERE etld1 = 'click.example') END AS matches_known
FROM q LEFT JOIN dom d ON d.name = q.name""")
def add_domains(spark, sf):
    k = F.col("p_partkey")
    ks = k.cast("string")
    lit = F.lit
    raw = (F.when(k % 6 == 0, F.concat(lit(" H"), (k % 100).cast("string"), lit(".view.example ")))
           .when(k % 6 == 1, F.concat(lit("p"), ks, lit(".new.example")))
           .when(k % 6 == 2, lit("bad name"))
           .when(k % 6 == 3, F.concat(lit("p"), ks, lit(".gstatic.com")))
           .when(k % 6 == 4, lit("*.click.example"))
           .otherwise(F.concat(lit("p"), (k - k % 12).cast("string"), lit(".twice.example"))))
    names = A.table(spark, sf, "part").select(k.alias("line_no"), raw.alias("raw"))
    return lifecycle.add_domains(A.domains(spark, sf), names).select(
        "line_no", "name", "action", "code", "matches_known")


@query(f"""WITH {DOM} SELECT status, is_manual, origin, count(*) AS n FROM (
SELECT 'blocked' AS status, true AS is_manual, 'discovered' AS origin FROM dom UNION ALL SELECT 'blocked', true, 'imported' FROM part
WHERE p_partkey % 2 = 0) GROUP BY 1, 2, 3""")
def import_hosts(spark, sf):
    d = A.domains(spark, sf).select(*COLUMNS)
    names = d.select(F.col("name").alias("domain")).unionByName(
        A.table(spark, sf, "part").select(F.concat(
            F.lit("p"), F.col("p_partkey").cast("string"),
            F.when(F.col("p_partkey") % 2 == 0, ".new.example").otherwise(".gstatic.com"))
            .alias("domain")))
    out, _, _ = lifecycle.import_hosts(d, names, "admin", A.AS_OF)
    return out.groupBy("status", "is_manual", "origin").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'accepted'
WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 1 THEN 'rejected' WHEN o_orderstatus = 'O'
THEN 'pending' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'rejected' END AS state,
count(*) AS n, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS allows
FROM orders GROUP BY 1""")
def resolve_requests(spark, sf):
    r = A.requests(spark, sf)
    answers = r.where(F.col("id") % 3 != 2).select(
        "id", (F.col("id") % 3 == 0).alias("accept"), F.lit("admin").alias("actor"))
    closed, allows = lifecycle.resolve_requests(r, answers, A.AS_OF)
    done = allows.select(F.col("seq").alias("id"), F.lit(1).alias("_a"))
    return closed.join(done, "id", "left").groupBy("state").agg(
        F.count("*").alias("n"), F.count("_a").alias("allows"))


# Publishing --------------------------------------------------------------------------------------

LISTS = f"""{DOM}, {CATEGORIES}, b AS (SELECT d.name AS domain, c.key AS on_key FROM dom d
LEFT JOIN cat c ON c.key = d.category AND c.enabled WHERE status = 'blocked'),
lists AS (SELECT on_key AS list_key, domain FROM b WHERE on_key IS NOT NULL
UNION ALL SELECT 'all', domain FROM b WHERE on_key IS NOT NULL UNION ALL SELECT 'blocked', domain FROM b)"""


def _lists(spark, sf):
    return publish.lists(A.domains(spark, sf), publish.category_table(spark))


@query(f"WITH {LISTS} SELECT list_key, domain FROM lists")
def published_lists(spark, sf):
    return _lists(spark, sf)


@query(f"WITH {LISTS} SELECT list_key, domain, '0.0.0.0 ' || domain AS line FROM lists")
def hosts_lines(spark, sf):
    return publish.hosts_lines(_lists(spark, sf))


@query(f"""WITH {LISTS}, shares AS (SELECT list_key, substr(sha256(domain), 1, 2) AS s, count(*) AS n,
sha256(string_agg(domain, chr(0) ORDER BY domain)) AS h FROM lists GROUP BY 1, 2)
SELECT list_key, CAST(sum(n) AS BIGINT) AS entry_count, 'sha256:' || sha256('0.0.0.0' || chr(0)
|| string_agg(s || ':' || h, ',' ORDER BY s)) AS checksum FROM shares GROUP BY 1""")
def list_checksums(spark, sf):
    return publish.list_checksum(_lists(spark, sf))


@query(f"""WITH {DOM}, {CATEGORIES} SELECT name, coalesce(c.publish_path || '|all.txt|', '') ||
'blocked.txt' AS files FROM dom d LEFT JOIN cat c ON c.key = d.category AND c.enabled
WHERE status = 'blocked'""")
def files_of_domain(spark, sf):
    return publish.files_of(A.domains(spark, sf), publish.category_table(spark)).select(
        "name", F.array_join("files", "|").alias("files"))


@query(f"""WITH {LISTS}, now AS (SELECT list_key, count(*) AS entry_count FROM lists GROUP BY 1),
prev AS (SELECT list_key, entry_count * CASE list_key WHEN 'ads' THEN 3 WHEN 'blocked' THEN 1 ELSE 2 END
AS prev_count FROM now WHERE list_key <> 'telemetry')
SELECT list_key, entry_count, coalesce(prev_count, 0) AS prev_count, CASE WHEN list_key = 'ads'
THEN 'refused' WHEN list_key = 'blocked' THEN 'unchanged' ELSE 'published' END AS status
FROM now LEFT JOIN prev USING (list_key)""")
def publish_plan(spark, sf):
    """One list shrinks to a third, one stays as it was, one is new."""
    entries = _lists(spark, sf)
    key = F.col("list_key")
    prev = publish.list_fingerprint(entries).where(key != "telemetry").select(
        F.lit(1).cast("long").alias("id"), "list_key",
        (F.col("entry_count") * F.when(key == "ads", 3).when(key == "blocked", 1).otherwise(2))
        .alias("entry_count"),
        F.when(key == "blocked", F.col("checksum")).otherwise("old").alias("checksum"),
        F.lit("2024-01-01").cast("timestamp").alias("published_at"))
    return publish.publish(entries, prev, A.AS_OF).select("list_key", "entry_count", "prev_count",
                                                          "status")


@query("""SELECT list_key, id FROM (SELECT o_orderpriority AS list_key, o_orderkey AS id,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders) WHERE rn <= 20""")
def prune_snapshots(spark, sf):
    kept, _ = publish.prune(A.snapshots(spark, sf), A.snapshot_entries(spark, sf), 20)
    return kept.select("list_key", "id")


@query("""SELECT o_orderpriority AS list_key, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS id
FROM orders GROUP BY 1""")
def last_snapshots(spark, sf):
    return publish.last_snapshots(A.snapshots(spark, sf)).select("list_key", "id")


@query("""WITH a AS (SELECT DISTINCT 'p' || l_partkey || '.s' || l_suppkey AS domain FROM lineitem
WHERE l_returnflag = 'A'),
b AS (SELECT DISTINCT 'p' || l_partkey || '.s' || l_suppkey AS domain FROM lineitem
WHERE l_returnflag = 'N')
SELECT domain, 'added' AS change FROM b WHERE domain NOT IN (FROM a)
UNION ALL SELECT domain, 'removed' FROM a WHERE domain NOT IN (FROM b)""")
def snapshot_diff(spark, sf):
    return publish.diff_snapshots(A.snapshot_entries(spark, sf), 1, 2)


@query("""SELECT max(o_orderkey) OVER () + 1 AS id, o_orderpriority AS list_key,
'admin (rollback of #40)' AS published_by FROM orders QUALIFY o_orderkey = 40""")
def rollback(spark, sf):
    row, _ = publish.rollback(A.snapshots(spark, sf), A.snapshot_entries(spark, sf), 40, A.AS_OF,
                              "admin")
    return row.select("id", "list_key", "published_by")


@query(f"""WITH {DOM}, {CATEGORIES} SELECT key AS category, count(d.name) AS domain_count,
count(*) FILTER (status = 'blocked') AS blocked_count,
CASE WHEN enabled THEN count(*) FILTER (status = 'blocked') ELSE 0 END AS published_count
FROM cat LEFT JOIN dom d ON d.category = key GROUP BY key, enabled""")
def categories_report(spark, sf):
    published = publish.list_fingerprint(_lists(spark, sf))
    return stats.categories_report(publish.category_table(spark), A.domains(spark, sf),
                                   published).select(
        "category", "domain_count", "blocked_count", "published_count")


@query("""SELECT o_custkey AS name, CAST(sum(o_orderkey % 10) AS BIGINT) AS hits,
CAST(epoch(min(o_orderdate)) AS BIGINT) AS first_seen,
CAST(epoch(max(o_orderdate)) AS BIGINT) AS last_seen,
coalesce(max(o_orderstatus) FILTER (o_orderkey % 2 = 1), max(o_orderstatus)) AS status
FROM orders GROUP BY 1""")
def merge_tables(spark, sf):
    """Insert-or-update of odd orders into a table made of even ones."""
    def part(odd: int):
        return A.table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == odd).groupBy(
            F.col("o_custkey").alias("name")).agg(
                F.sum(F.col("o_orderkey") % 10).alias("hits"),
                F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"),
                F.max("o_orderstatus").alias("status"))
    merged = tables.merge_latest(part(0), part(1), ["name"], {
        "hits": "sum", "first_seen": "min", "last_seen": "max", "status": "last"})
    return merged.select("name", "hits", sec("first_seen"), sec("last_seen"), "status")


# Relations ---------------------------------------------------------------------------------------


@query(f"WITH {REL} SELECT from_id, to_id, 'cname_to' AS kind FROM cname")
def cname_edges(spark, sf):
    return relate.cname_edges(A.cname_facts(spark, sf)).select("from_id", "to_id", "kind")


@query(f"WITH {REL} SELECT from_id, to_id, '{{\"asn\":' || asn || '}}' AS detail FROM same")
def same_asn_edges(spark, sf):
    return relate.same_asn_edges(A.asn_of_customers(spark, sf)).select("from_id", "to_id",
                                                                       "detail")


@query("""WITH e AS (SELECT 's' || s_suppkey || '.example' AS a, 'n' || s_nationkey || '.example' AS b
FROM supplier UNION SELECT 's' || s_suppkey || '.example', 's' || (s_suppkey // 2) || '.example'
FROM supplier WHERE s_suppkey > 0)
SELECT a AS from_id, b AS to_id FROM e UNION SELECT b, a FROM e""")
def same_cert_edges(spark, sf):
    s = A.table(spark, sf, "supplier")
    def host(prefix, n):
        return F.concat(F.lit(prefix), n.cast("string"), F.lit(".example"))
    k = F.col("s_suppkey")
    cert = s.select(host("s", k).alias("name"), F.array(
        host("*.S", k), host("N", F.col("s_nationkey")), host(" s", F.floor(k / 2)),
        F.lit("two words")).alias("sans"))
    return relate.same_cert_edges(cert).select("from_id", "to_id")


DEGREE = f"""WITH {REL}, degree AS (SELECT id, count(*) AS degree FROM (
SELECT from_id AS id, to_id AS other, kind FROM relations UNION
SELECT to_id, from_id, kind FROM relations) GROUP BY 1)"""


@query(f"{DEGREE} SELECT id, degree FROM degree")
def node_degree(spark, sf):
    """Shared networks count from their memberships; no pairs are made."""
    return relate.degree(relate.cname_edges(A.cname_facts(spark, sf)),
                         members=networks.memberships(A.asn_of_customers(spark, sf)))


@query("""WITH m AS (SELECT DISTINCT name, g FROM (
SELECT 'c' || o_custkey AS name, o_custkey // 15 AS g FROM orders UNION ALL
SELECT 'c' || o_custkey, 1000000 + o_orderkey % 40 FROM orders WHERE o_orderkey % 64 = 0))
SELECT a.name, count(DISTINCT b.name) AS degree FROM m a JOIN m b ON a.g = b.g AND a.name <> b.name GROUP BY 1""")
def network_degrees(spark, sf):
    """Names in several overlapping networks, some of them large."""
    o = A.table(spark, sf, "orders")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")
    rows = o.select(name, F.floor(F.col("o_custkey") / 15).alias("asn")).unionAll(
        o.where(F.col("o_orderkey") % 64 == 0).select(name, (F.col("o_orderkey") % 40 + 1000000).alias("asn")))
    return networks.shared_degree(networks.memberships(rows.withColumn("asn", F.col("asn") + 1), neutral=[]))


@query(f"""WITH {REL} SELECT name, max(asn) AS asn FROM asn WHERE name <> 'c100.example'
AND asn = (SELECT asn FROM asn WHERE name = 'c100.example') GROUP BY 1""")
def network_sharing(spark, sf):
    """Names that share the large network of one name, from the memberships."""
    return networks.sharing(networks.memberships(A.asn_of_customers(spark, sf)), "c100.example")


@query(f"""WITH {REL} SELECT from_id AS id, to_id AS other, kind FROM relations UNION
SELECT to_id, from_id, kind FROM relations""")
def both_directions(spark, sf):
    return relate.both_directions(*A.stored_relations(spark, sf))


@query(f"""{DEGREE} SELECT (SELECT count(*) FROM degree WHERE degree >= 3) AS total_nodes,
(SELECT count(*) FROM relations) AS total_edges""")
def network_totals(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    return relate.network_totals(edges, min_degree=3, members=members)


@query(f"""WITH {REL} SELECT (SELECT count(*) FROM (SELECT from_id FROM relations GROUP BY 1
HAVING count(*) >= 3)) AS total_nodes, (SELECT count(*) FROM relations) AS total_edges""")
def network_totals_outgoing(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    return relate.network_totals(edges, min_degree=3, outgoing_only=True, members=members)


@query(f"""WITH {REL} SELECT from_id, to_id, kind, strength, status, category FROM relations
JOIN rdom ON name = to_id WHERE from_id = 'c25.example' AND kind = 'same_asn'
ORDER BY strength DESC, to_id, kind LIMIT 11""")
def neighbours(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    return relate.neighbours(edges, A.relation_domains(spark, sf), "c25.example", ["same_asn"], 0.5, 10, members)


NET = f"""{DEGREE}, top AS (SELECT name, status, category, degree, query_count FROM rdom
JOIN degree ON id = name WHERE degree >= 2 AND status IN ('new', 'blocked')
ORDER BY degree DESC, query_count DESC, name LIMIT 100)"""


@query(f"{NET} SELECT * FROM top")
def network_nodes(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    nodes, _ = relate.network(edges, A.relation_domains(spark, sf),
                              statuses=["new", "blocked"], min_degree=2, k=100, members=members)
    return nodes.drop("etld1")


@query(f"""{NET} SELECT from_id, to_id, kind, CAST(strength AS DOUBLE) AS strength FROM relations
WHERE from_id IN (SELECT name FROM top) AND to_id IN (SELECT name FROM top)
""")
def network_edges(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    _, among = relate.network(edges, A.relation_domains(spark, sf),
                              statuses=["new", "blocked"], min_degree=2, k=100, members=members)
    return among


@query(f"""WITH {REL} SELECT DISTINCT to_id AS name, 'related' AS origin, 'new' AS status
FROM relations WHERE to_id NOT IN (SELECT name FROM rdom)""")
def related_names(spark, sf):
    edges, members = A.stored_relations(spark, sf)
    return relate.related_names(edges, A.relation_domains(spark, sf), members).select(
        "name", "origin", "status")


@query(f"""WITH {REL} SELECT from_id, to_id, kind, CASE WHEN from_id < to_id THEN 0.25::DOUBLE
ELSE 1 END AS strength FROM relations WHERE kind = 'same_asn' UNION ALL
SELECT from_id, to_id, kind, strength FROM relations WHERE kind = 'cname_to'""")
def upsert_edges(spark, sf):
    base = A.relations(spark, sf, placed=True)
    ups = base.where((F.col("kind") == "same_asn") & (F.col("from_id") < F.col("to_id")))
    loops = base.withColumn("to_id", F.col("from_id"))
    new = ups.withColumn("strength", F.lit(0.25)).unionByName(loops)
    return relate.upsert_edges(base, new).select("from_id", "to_id", "kind", "strength")
