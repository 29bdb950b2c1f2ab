"""Scoring names: candidate assembly, signals, score, confidence, category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions.names import (clip, entropy, host_of, keyword_hit, leftmost_label,
                                     normalize_host, round2, suffix_hit)
from dnslake.operators.joins import list_flags
from dnslake.operators.search import candidates
from dnslake.operators.windows import first_n, with_group_count
from dnslake.plans.rules import Rules


def assemble_candidates(domains: DataFrame, facts: DataFrame, behavior: DataFrame,
                        entries: DataFrame, sources: DataFrame | None = None,
                        etld1_of: DataFrame | None = None,
                        only_open: bool = True) -> DataFrame:
    """Every name to score beside all its evidence.

    ``facts`` is the one-row-per-name form.  ``entries (source_id, domain)`` gives the list flags
    for the name, its registrable name and those of its CNAME hops; ``sources (source_id,
    category)`` the categories of the lists that hold the name.  ``etld1_of (name, etld1)`` maps
    hop names; without it the last two labels are taken.
    """
    counted = with_group_count(domains, "etld1", "subdomain_count")
    rows = candidates(counted) if only_open else counted
    rows = rows.join(facts, "name", "left").join(
        behavior.select("name", "third_party_ratio", "interval_cv"), "name", "left")
    rows = list_flags(rows, entries, "name", "in_list")
    rows = list_flags(rows, entries, "etld1", "etld1_in_list")

    hops = (rows.where(F.size("dns.cname_chain") > 0)
            .select("name", F.posexplode("dns.cname_chain").alias("_i", "_hop"))
            .withColumn("_hop", normalize_host("_hop")))
    if etld1_of is not None:
        root = etld1_of.select(F.col("name").alias("_hop"), F.col("etld1").alias("_root"))
        hops = hops.join(root, "_hop", "left").withColumn("_root", F.coalesce("_root", "_hop"))
    else:
        hops = hops.withColumn("_root", F.substring_index("_hop", ".", -2))
    listed = entries.select(F.col("domain").alias("_root")).distinct()
    blocked = (hops.join(listed, "_root", "left_semi").groupBy("name")
               .agg(F.min_by("_root", "_i").alias("cname_etld1_in_list")))
    rows = rows.join(blocked, "name", "left")

    if sources is not None:
        tags = (entries.join(sources.where(F.col("category").isNotNull()), "source_id")
                .groupBy(F.col("domain").alias("name"))
                .agg(F.collect_set("category").alias("list_categories")))
        rows = rows.join(tags, "name", "left")
    else:
        rows = rows.withColumn("list_categories", F.lit(None).cast("array<string>"))
    return rows


def _weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    return {**refdata.WEIGHTS, **(weights or {})}


_SCRATCH = ["_hop", "_san", "_cdn", "_kw", "_label", "_entropy", "_goto", "_org", "_asn_category"]


def _first_hit(hosts: Column, known: list[str]) -> Column:
    """First host of an array under a known suffix, as ``struct(host, suffix)``."""
    hits = F.transform(hosts, lambda h: F.struct(h.alias("host"), suffix_hit(h, known)
                                                 .alias("suffix")))
    return F.get(F.filter(hits, lambda s: s["suffix"].isNotNull()), F.lit(0))


def _lookup(values: Mapping, key: Column) -> Column:
    """Value of a constant map (folded to a literal), null when the key is missing."""
    if not values:
        return F.lit(None).cast("string")
    text = "\n".join(f"{k}\t{v}" for k, v in values.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t")),
                            key.cast("string"))


def with_signals(df: DataFrame, rules: Rules | None = None,
                 weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``signals``: the evidence that fired, in fixed order, each with weight and detail.

    One projection over the candidate row; nothing is shuffled.
    """
    rules, w = rules or Rules(), _weights(weights)
    t = rules.thresholds

    def signal(kind: str, test: Column, *detail: Column) -> Column:
        return F.when(test, F.struct(
            F.lit(kind).alias("kind"), F.lit(float(w[kind])).alias("weight"),
            F.to_json(F.struct(*detail)).alias("detail")))

    ratio = F.coalesce("third_party_ratio", F.lit(0.0))
    cv = F.coalesce("interval_cv", F.lit(0.0))
    shown_ratio = round2(ratio).alias("ratio")
    clients = F.coalesce("client_count", F.lit(0))
    asns = {k: v for k, v in rules.asns.items() if k not in refdata.NEUTRAL_ASNS}
    adtech = list(rules.adtech)

    # Lookups that several signals or the category need are computed once.
    none = F.array().cast("array<string>")
    hops, sans = F.coalesce("dns.cname_chain", none), F.coalesce("cert.sans", none)
    label = leftmost_label("name")
    df = df.withColumns({
        "_hop": _first_hit(hops, adtech),
        "_san": _first_hit(F.transform(sans, lambda s: F.regexp_replace(s, r"^\*\.", "")), adtech),
        "_cdn": _first_hit(F.concat(F.array("name"), hops), list(rules.cdn)),
        "_kw": keyword_hit("name", rules.keywords),
        "_label": label,
        "_entropy": F.when(F.length(label) >= refdata.RANDOM_LABEL_MIN_LEN, entropy(label)),
        "_goto": suffix_hit(host_of("http.redirect_to"), adtech),
        "_org": _lookup({k: v[0] for k, v in asns.items()}, F.col("asn.asn")),
        "_asn_category": _lookup({k: v[1] for k, v in asns.items()}, F.col("asn.asn")),
    })

    status, is_html = F.col("http.status"), F.coalesce("http.is_html", F.lit(False))
    pixel = F.coalesce("http.is_pixel", F.lit(False))
    body = F.coalesce("http.body_len", F.lit(0))
    text = F.coalesce("http.text_len", F.lit(0))
    head = F.coalesce("http.title", F.lit(""))
    fetched = F.col("http").isNotNull()
    mime = F.col("http.content_type").alias("content_type")

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    malicious = F.coalesce("vt.malicious", F.lit(0))
    harmless = F.coalesce("vt.harmless", F.lit(0))
    engines = harmless + F.coalesce("vt.undetected", F.lit(0))
    scanned = F.coalesce("vt.known", F.lit(False))
    many = malicious >= t["vt_malicious_min_engines"]
    sure = F.coalesce(F.col("ai.confidence"), F.lit(0.0)) >= refdata.MODEL_CONFIDENCE_FLOOR
    verdict = [F.col("ai.category").alias("category"), F.col("ai.confidence").alias("confidence"),
               F.col("ai.model").alias("model"), clip("ai.reason", 160).alias("reason")]
    age = F.coalesce("rdap.age_days", F.lit(0))
    rank = F.coalesce("rank.tranco", F.lit(0))
    etld1 = F.col("etld1")
    no_infra = (F.col("_hop").isNull() & F.col("cname_etld1_in_list").isNull()
                & F.col("_org").isNull() & F.col("_san").isNull())

    fired = F.array(
        signal("cname_adtech", F.col("_hop").isNotNull(), F.col("_hop.host").alias("cname"),
               F.col("_hop.suffix").alias("matched")),
        signal("cname_blocked", F.col("cname_etld1_in_list").isNotNull(),
               F.col("cname_etld1_in_list").alias("cname_etld1")),
        signal("asn_adtech", F.col("_org").isNotNull(), F.col("asn.asn").alias("asn"),
               F.col("_org").alias("org")),
        signal("cert_adtech", F.col("_san").isNotNull(), F.col("_san.host").alias("san"),
               F.col("_san.suffix").alias("matched")),
        signal("keyword", F.col("_kw").isNotNull(), F.col("_kw.word").alias("keyword"),
               F.col("_kw.category").alias("group")),
        signal("random_sub", F.col("_entropy") >= refdata.RANDOM_LABEL_MIN_ENTROPY,
               F.col("_label").alias("label"), round2(F.col("_entropy")).alias("entropy")),
        F.coalesce(
            signal("third_party", ratio > refdata.THIRD_PARTY_STRONG, shown_ratio),
            signal("third_party_weak", ratio >= refdata.THIRD_PARTY_WEAK, shown_ratio)),
        signal("fan_out", (clients >= t["fanout_min_clients"])
               & (ratio > refdata.FAN_OUT_MIN_RATIO), clients.alias("clients"), shown_ratio),
        signal("beacon", (F.col("query_count") >= t["beacon_min_queries"]) & (cv > 0)
               & (cv < refdata.BEACON_MAX_CV), round2(cv).alias("cv"),
               F.col("query_count").alias("queries")),
        F.coalesce(
            signal("spread_high", F.col("subdomain_count") >= t["spread_high_min"],
                   F.col("subdomain_count").alias("subdomains"), etld1),
            signal("spread_mid", F.col("subdomain_count") >= t["spread_mid_min"],
                   F.col("subdomain_count").alias("subdomains"), etld1)),
        signal("etld1_blocked", F.coalesce("etld1_in_list", F.lit(False)), etld1),
        F.coalesce(
            signal("http_beacon", status == 204, status.alias("status"),
                   F.lit("204 No Content").alias("reason")),
            signal("http_beacon", pixel, mime, body.alias("length"),
                   F.lit("one-pixel image").alias("reason")),
            signal("http_beacon", (status == 200) & ~is_html & (body == 0), mime,
                   F.lit("200 with empty body").alias("reason"))),
        signal("http_redirect_adtech", filled("http.redirect_to") & F.col("_goto").isNotNull(),
               F.col("http.redirect_to").alias("location"), F.col("_goto").alias("matched")),
        signal("http_parking", filled("http.parking"), F.col("http.parking").alias("provider")),
        signal("http_p3p", filled("http.p3p"), clip("http.p3p", 120).alias("p3p")),
        signal("http_tracking_cookie", filled("http.tracking_cookie")
               & (F.col("http.cookie_max_days") >= refdata.TRACKING_COOKIE_MIN_DAYS),
               F.col("http.tracking_cookie").alias("cookie"),
               F.col("http.cookie_max_days").alias("days")),
        signal("http_cors_wildcard", fetched & (F.col("http.cors") == "*") & ~is_html, mime),
        F.when(is_html & (status == 200), F.coalesce(
            signal("http_empty_page", (text < refdata.EMPTY_PAGE_MAX_TEXT) & (head == ""),
                   text.alias("text_len")),
            signal("http_real_site", (text >= refdata.REAL_SITE_MIN_TEXT) & (head != ""),
                   clip(head, 80).alias("title"), text.alias("text_len")))),
        F.when(scanned, F.coalesce(
            signal("vt_malicious", many, malicious.alias("malicious"),
                   F.col("vt.suspicious").alias("suspicious")),
            signal("vt_clean", (malicious == 0) & (engines >= refdata.VT_CLEAN_MIN_ENGINES),
                   harmless.alias("harmless"), engines.alias("engines")))),
        F.when(sure, F.coalesce(
            signal("ai_adtech", F.col("ai.category").isin(list(refdata.BLOCKABLE)), *verdict),
            signal("ai_clean", F.col("ai.category") == "content", *verdict))),
        signal("high_rank", (rank > 0) & (rank <= t["high_rank_max"]), rank.alias("tranco"), etld1),
        signal("long_lived_content", (age > refdata.LONG_LIVED_MIN_DAYS) & no_infra,
               age.alias("age_days")),
        signal("shared_cdn", F.col("_cdn").isNotNull(), F.col("_cdn.suffix").alias("cdn"),
               F.col("_cdn.host").alias("via")),
    )
    return df.withColumn("signals", F.filter(fired, lambda s: s.isNotNull()))


def score(df: DataFrame, rules: Rules | None = None,
          weights: Mapping[str, float] | None = None) -> DataFrame:
    """Score, confidence, category and signals of candidate rows."""
    return with_score(df, rules, weights).select("name", "score", "confidence", "category",
                                                 "signals")


def with_score(df: DataFrame, rules: Rules | None = None,
               weights: Mapping[str, float] | None = None) -> DataFrame:
    """Candidate rows with score, confidence, category and signals added (or replaced)."""
    rules = rules or Rules()
    df = with_signals(df, rules, weights)
    kinds = F.transform("signals", lambda s: s["kind"])

    def has(*names: str) -> Column:
        return F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))

    infra = F.size(F.filter(kinds, lambda k: k.isin(list(refdata.INFRA_KINDS))))
    total = F.size("signals")
    confidence = (F.when(infra >= 2, 0.95).when((infra == 1) & (total >= 3), 0.85)
                  .when(infra == 1, 0.70).when(total >= 4, 0.60).otherwise(0.40))
    # Strongest positive signal; of equals the first in order.
    positive = F.filter("signals", lambda s: s["weight"] > 0)
    strongest = F.array_max(F.transform(positive, lambda s, i: F.struct(
        s["weight"].alias("w"), (-i).alias("i"), s["kind"].alias("kind"))))["kind"]
    backed = F.exists(positive, lambda s: ~s["kind"].isin("keyword", "random_sub"))
    hop_category = _lookup(rules.adtech, F.col("_hop.suffix"))
    listed = F.coalesce("list_categories", F.array().cast("array<string>"))
    category = (
        F.when(has("shared_cdn", "high_rank"), "cdn")
        .when(F.array_contains(listed, "malware"), "malware")
        .when(F.array_contains(listed, "cryptomining"), "cryptomining")
        .when(F.array_contains(listed, "adult"), "adult")
        .when(has("vt_malicious"), "malware")
        .when(strongest.isin("beacon", "http_beacon"), "telemetry")
        .when(has("http_parking", "http_redirect_adtech"), "ads")
        .when(hop_category.isNotNull(), hop_category)
        .when(F.col("_asn_category").isNotNull(), F.col("_asn_category"))
        .when(F.col("_kw").isNotNull() & backed, F.col("_kw.category"))
        .when(infra > 0, "ads")
        .otherwise("content"))
    value = round2(F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["weight"]))
    added = {"score": value, "confidence": confidence, "category": category}
    return df.withColumns(added).drop(*_SCRATCH)


def simulate(rows: DataFrame, categories: DataFrame, current: tuple, proposed: tuple,
             sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """Effect of other weights or rules: (counts, sample of the names that change).

    ``current`` and ``proposed`` are ``(rules, weights)``.  A name counts as blocked when its score
    reaches the threshold of its category and the category is enabled.
    """
    limits = categories.select(F.col("key").alias("category"), "threshold", "enabled")

    def judged(df: DataFrame, setting: tuple, out: str) -> DataFrame:
        blocks = F.col("enabled") & (F.col("score") >= F.col("threshold"))
        return (with_score(df, *setting).join(limits, "category", "left")
                .withColumn(out, F.coalesce(blocks, F.lit(False)))
                .drop("threshold", "enabled", "category", "score", "confidence", "signals"))

    # Both settings judge the same row: no join of two results.
    both = judged(judged(rows, current, "now"), proposed, "then").select("name", "now", "then")
    change = (F.when(~F.col("now") & F.col("then"), "would_block")
              .when(F.col("now") & ~F.col("then"), "would_unblock"))
    counts = both.agg(
        F.count_if(~F.col("now") & F.col("then")).alias("would_block"),
        F.count_if(F.col("now") & ~F.col("then")).alias("would_unblock"),
        F.count_if(F.col("now") == F.col("then")).alias("unchanged"),
        F.count("*").alias("evaluated"))
    changed = both.withColumn("change", change).where(F.col("change").isNotNull())
    shown = first_n(changed.select("change", "name"), ["change"], [F.col("name")], sample)
    return counts, shown


def eval_sample(scored: DataFrame, per_band: Mapping[str, int] | None = None) -> DataFrame:
    """A repeatable sample for labelling, stratified by score band, names in hash order."""
    sizes = per_band or {"under": 50, "near": 100, "over": 100, "far": 50}
    band = (F.when(F.col("score") < 3, "under").when(F.col("score") < 5.5, "near")
            .when(F.col("score") < 8, "over").otherwise("far"))
    order = [F.col("_h"), F.col("name")]
    rows = scored.withColumn("band", band).withColumn("_h", F.md5("name"))
    few = first_n(rows, ["band"], order, max(sizes.values()))
    wanted = F.coalesce(*[F.when(F.col("band") == b, F.lit(n)) for b, n in sizes.items()],
                        F.lit(0))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(*order))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= wanted).drop("_h", "_rank")


def precision_recall(predicted: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """``predicted (key, positive)`` against ``labels (key, truth)``; only labelled rows count."""
    both = predicted.join(labels, key)
    hit = F.count_if(F.col("positive") & F.col("truth"))
    said, real = F.count_if(F.col("positive")), F.count_if(F.col("truth"))
    return both.agg(hit.alias("true_positive"), said.alias("predicted"), real.alias("actual"),
                    F.count("*").alias("labelled")).withColumns({
                        "precision": F.try_divide("true_positive", "predicted"),
                        "recall": F.try_divide("true_positive", "actual")})


__all__ = ["assemble_candidates", "eval_sample", "precision_recall", "score", "simulate",
           "with_signals"]
