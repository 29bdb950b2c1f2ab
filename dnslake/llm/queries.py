"""One query per operator over its whole table, with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslake.llm import bpe, decontaminate, extract, minhash, nndescent, pieces, quality, secrets, substrings, urlrules, variants, warc, whiten
from dnslake.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_LOWER = rf"regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS_LOWER} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_LOWER} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
       FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k
       FROM d, (SELECT DISTINCT size FROM bw) s, unnest(generate_series(1, len(w) - size + 1)) AS g(i)),
hits AS (SELECT doc_id, i, dw.size AS size, item FROM dw JOIN bw USING (size, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT DISTINCT doc_id, i, size FROM hits), unnest(generate_series(i, i + size - 1)) AS g(p)
            GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op1_nn_descent", _OP1)
def op1(spark, sf):
    return nndescent.near_vectors(table(spark, sf, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op2_probminhash")
def op2(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "class_id", "group_id", "kept")


@query("op3_decontamination", _OP3)
def op3(spark, sf):
    docs, benchmark = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return decontaminate.scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


@query("op4_warc_derivatives")
def op4(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    made = warc.derive(warc.responses(pages, date="2024-01-01T00:00:00Z"))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date",
                       "content_type", "block_digest", "payload_digest", F.octet_length("block").alias("n_bytes"),
                       F.decode("block", "UTF-8").alias("block"))


@query("op5_compression_quality")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op6_secret_randomness")
def op6(spark, sf):
    base = ("assign", "access", "hex")
    found = secrets.find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in base],
                        F.sha2(secrets.joined(kinds=base), 256).alias("base_sha256"), secrets.joined().alias("spans"))


@query("op7_merge_dropout")
def op7(spark, sf):
    done = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"))
    return pieces.decode(done).select("doc_id", "n_pieces", "pieces",
                                      F.coalesce(F.col("decoded") == F.col("text"), F.size("pieces") == 0).alias("lossless"))


@query("op8_recurrent_blocks")
def op8(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.train(pages)).select("page_id", "url", "text", "n_chars")


_OP9 = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
       coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""


@query("op9_url_sweep", _OP9)
def op9(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlrules.judge(pages, urlrules.production_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k
            FROM d, unnest(generate_series(1, len(w) - 34)) AS g(i)),
often AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM often)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS g(p)),
marked AS (SELECT doc_id, p, word, max(mark) OVER (PARTITION BY doc_id ORDER BY p
                                                  ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone
           FROM (SELECT w.doc_id, w.p, w.word, CASE WHEN s.i IS NULL THEN 0 ELSE 1 END AS mark
                 FROM words w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.i = w.p))
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n,
                         string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
                  FROM marked GROUP BY doc_id) m USING (doc_id)
"""


@query("op10_fixed_block_repeats", _OP10)
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_bpe_ranks")
def op11(spark, sf):
    done = bpe.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_tokens")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.decode(done).select("doc_id", "n_tokens", F.sha2(digits, 256).alias("ids_sha256"),
                                   F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_refined_whitening")
def op12(spark, sf):
    return whiten.by_component(table(spark, sf, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


_OP13 = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                              lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS g(i))),
runs AS (SELECT id, run, count(*) AS n FROM (
             SELECT CAST(doc_id AS VARCHAR) AS id,
                    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
         GROUP BY id, run),
spelt AS (SELECT run, n, flatten(list_transform(string_split(coalesce(id, '') || ':' || run, ''), lambda c:
              CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
                   ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END)) AS bytes FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM spelt, crc_table),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                         ELSE run END AS word FROM hashed)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM v, unnest(generate_series(1, length(word))) AS g(i)),
near AS (SELECT DISTINCT a.word AS word, b.word AS other, b.n AS m FROM gone a JOIN v b ON a.rest = b.word
         UNION SELECT DISTINCT b.word, a.word, a.n FROM gone a JOIN v b ON a.rest = b.word
         UNION SELECT a.word, b.word, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM near GROUP BY word),
formed AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN top END AS form_n,
                  CASE WHEN top >= 10 * n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.m = top) END AS form
           FROM v LEFT JOIN best USING (word)),
climb AS (SELECT word, word AS here, 0 AS step FROM formed
          UNION ALL SELECT c.word, f.form, step + 1 FROM climb c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT formed.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM formed JOIN (SELECT word, arg_max(here, step) AS root FROM climb GROUP BY word) USING (word)
"""


@query("op13_reduced_alphabet", _OP13)
def op13(spark, sf):
    return variants.spelling_variants(table(spark, sf, "documents").select("doc_id", "text"))
