"""Moving names through their life: new, staging, blocked, allowed, ignored.

Every function returns the changed domain table and the decisions that explain the changes.  Four
rules hold throughout: manual names are never rescored, ``allowed`` changes by hand only, one status
change is one decision row, protected names are never blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.functions.names import protecting_rule, suffix_rules, valid_domain, with_etld1
from dnslake.operators.windows import latest_per
from dnslake.sources.events import cutoff

DECISION_COLUMNS = ["name", "action", "actor", "reason", "snapshot", "created_at"]


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _pick(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def _moved(df: DataFrame, change: Column, as_of: str) -> DataFrame:
    """Apply a new status (null: unchanged) with the times that go with it."""
    now = _ts(as_of)
    return (df.withColumn("_to", change)
            .withColumn("staged_at", F.when(F.col("_to") == "staging", now)
                        .otherwise(F.col("staged_at")))
            .withColumn("blocked_at", F.when(F.col("_to") == "blocked", now)
                        .otherwise(F.col("blocked_at")))
            .withColumn("status", F.coalesce("_to", "status")))


def apply_decisions(domains: DataFrame, requests: DataFrame, as_of: str,
                    soft: tuple[str, ...] = (), signals: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ``requests (name, action, actor, reason, category, manual, seq)``.

    Returns (domains, decisions, skipped).  Of several usable requests for one name the last
    decides; the others are skipped as superseded.
    """
    extra = ["signals"] if signals is not None else []
    known = domains if signals is None else domains.join(
        signals.select("name", "signals"), "name", "left")
    facts = known.select("name", F.col("status").alias("_before"), F.col("score").alias("_score"),
                         F.col("confidence").alias("_confidence"),
                         F.col("category").alias("_category"), F.lit(True).alias("_known"), *extra)
    asked = requests.join(facts, "name", "left")
    rule = protecting_rule("name", soft)
    refusal = (F.when(F.col("_known").isNull(), "unknown name")
               .when(~F.col("action").isin(list(refdata.ACTIONS)), "unknown action")
               .when((F.col("action") == "block") & rule.isNotNull(),
                     F.concat(F.lit("protected by "), rule))
               .when((F.col("_before") == "allowed") & ~F.col("manual"),
                     "allowed changes by hand only"))
    asked = asked.withColumn("skip_reason", refusal)
    usable = asked.where(F.col("skip_reason").isNull())
    last = latest_per(usable, ["name"], ["seq"])
    older = (usable.join(last.select("name", F.col("seq").alias("_last")), "name")
             .where(F.col("seq") != F.col("_last")).drop("_last")
             .withColumn("skip_reason", F.lit("superseded in batch")))
    snapshot = F.to_json(F.struct(
        F.col("_before").alias("status_before"), F.col("_score").alias("score"),
        F.col("_confidence").alias("confidence"), F.col("_category").alias("category"), *extra))
    decisions = last.select("name", "action", "actor", "reason", snapshot.alias("snapshot"),
                            _ts(as_of).alias("created_at"))
    chosen = last.select("name", F.col("action").alias("_action"), F.col("manual").alias("_manual"),
                         F.col("category").alias("_new_category"))
    joined = domains.join(chosen, "name", "left")
    moved = _moved(joined, _pick(F.col("_action"), refdata.ACTION_STATUS), as_of)
    out = (moved.withColumn("is_manual", F.col("is_manual") | F.coalesce("_manual", F.lit(False)))
           .withColumn("category", F.coalesce("_new_category", "category"))
           .select(*domains.columns))
    skipped = (asked.where(F.col("skip_reason").isNotNull()).unionByName(older)
               .select("name", "action", "skip_reason"))
    return out, decisions, skipped


def save_scores(domains: DataFrame, scored: DataFrame, categories: DataFrame, as_of: str
                ) -> tuple[DataFrame, DataFrame]:
    """Store scores and stage or release names; manual ones stay as they are."""
    new = scored.select("name", F.col("score").alias("_score"),
                        F.col("confidence").alias("_confidence"),
                        F.col("category").alias("_category"), F.col("signals").alias("_signals"))
    limits = categories.select(F.col("key").alias("_category"), F.col("threshold").alias("_limit"),
                               F.col("enabled").alias("_enabled"))
    rows = domains.join(new.join(limits, "_category", "left"), "name", "left")
    scored_now = F.col("_score").isNotNull() & ~F.col("is_manual")
    action = F.when(scored_now, F.when(
        F.col("_enabled") & (F.col("_score") >= F.col("_limit")) & (F.col("status") == "new"),
        "stage").when((F.col("status") == "staging") & (F.col("_score") < F.col("_limit")),
                      "expire"))
    rows = rows.withColumn("_action", action)
    sign = F.when(F.col("_action") == "stage", ">=").otherwise("<")
    reason = F.concat(F.lit("score "), F.format_number("_score", 1), F.lit(" "), sign,
                      F.lit(" threshold "), F.format_number("_limit", 1))
    snapshot = F.to_json(F.struct(
        F.col("_score").alias("score"), F.col("_confidence").alias("confidence"),
        F.col("_category").alias("category"), F.col("_signals").alias("signals")))
    decisions = rows.where(F.col("_action").isNotNull()).select(
        "name", F.col("_action").alias("action"), F.lit("system").alias("actor"),
        reason.alias("reason"), snapshot.alias("snapshot"), _ts(as_of).alias("created_at"))
    moved = _moved(rows, _pick(F.col("_action"), refdata.ACTION_STATUS), as_of)
    for column in ("score", "confidence", "category"):
        moved = moved.withColumn(
            column, F.when(scored_now, F.col(f"_{column}")).otherwise(F.col(column)))
    return moved.select(*domains.columns), decisions


def _system(domains: DataFrame, due: Column, action: str, reason: str, snapshot: Column,
            as_of: str) -> tuple[DataFrame, DataFrame]:
    due = F.coalesce(due & ~F.col("is_manual"), F.lit(False))
    decisions = domains.where(due).select(
        "name", F.lit(action).alias("action"), F.lit("system").alias("actor"),
        F.lit(reason).alias("reason"), snapshot.alias("snapshot"), _ts(as_of).alias("created_at"))
    moved = _moved(domains, F.when(due, F.lit(refdata.ACTION_STATUS[action])), as_of)
    return moved.select(*domains.columns), decisions


def staging_due(as_of: str, days: int = 7) -> Column:
    return (F.col("status") == "staging") & (F.col("staged_at") <= cutoff(as_of, days))


def blocked_expired(as_of: str, days: int = 180) -> Column:
    return (F.col("status") == "blocked") & (F.col("last_seen") <= cutoff(as_of, days))


def promote_staging(domains: DataFrame, as_of: str, days: int = 7, soft: tuple[str, ...] = ()
                    ) -> tuple[DataFrame, DataFrame]:
    """Block what has stayed in staging long enough and is not protected."""
    due = staging_due(as_of, days) & protecting_rule("name", soft).isNull()
    snapshot = F.to_json(F.struct("score", F.coalesce("category", F.lit("ads")).alias("category")))
    return _system(domains, due, "block", f"{days} days in staging", snapshot, as_of)


def expire_blocked(domains: DataFrame, as_of: str, days: int = 180
                   ) -> tuple[DataFrame, DataFrame]:
    """Release blocked names that have not been seen for long."""
    return _system(domains, blocked_expired(as_of, days), "expire", f"not seen for {days} days",
                   F.to_json(F.struct("score", "category")), as_of)


def add_domains(domains: DataFrame, names: DataFrame, ranks: DataFrame | None = None,
                soft: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """Outcome per line of ``names (line_no, raw)``: created, duplicate or rejected with a code.

    A ``*.`` line counts the known names under it.  Nothing is written: apply the created rows with
    :func:`apply_decisions`, or take the table as a dry run.
    """
    rows = (names.withColumn("name", F.lower(F.trim("raw"))).where(F.col("name") != "")
            .withColumn("is_wildcard", F.col("name").startswith("*."))
            .withColumn("base", F.regexp_replace("name", r"^\*\.", "")))
    first = rows.groupBy("name").agg(F.min("line_no").alias("_first"))
    known = domains.select(F.col("name").alias("base"), F.lit(True).alias("_known"))
    # Counted over registrable names, as the count of names under the wildcard's base.
    under = domains.groupBy(F.col("etld1").alias("base")).agg(F.count("*").alias("_under"))
    rows = rows.join(first, "name").join(known, "base", "left").join(under, "base", "left")
    if ranks is not None:
        rows = rows.join(ranks.select(F.col("domain").alias("base"), F.col("rank").alias("_rank")),
                         "base", "left")
    else:
        rows = rows.withColumn("_rank", F.lit(None).cast("long"))
    ranked = F.coalesce(F.col("_rank") > 0, F.lit(False)) & (F.col("_rank") <= refdata.RANK_CUTOFF)
    code = (F.when(~valid_domain("base"), "invalid_domain")
            .when(F.col("line_no") != F.col("_first"), "duplicate")
            .when(protecting_rule("base", soft).isNotNull(), "domain_protected")
            .when(ranked & F.lit(not force), "high_rank")
            .when(F.col("_known") & ~F.col("is_wildcard"), "duplicate"))
    action = (F.when(code.isNull(), "created").when(code == "duplicate", "duplicate")
              .otherwise("rejected"))
    return rows.select(
        "line_no", "name", "base", "is_wildcard", action.alias("action"),
        F.when(action == "rejected", code).alias("code"),
        F.when((action == "created") & F.col("is_wildcard"), F.coalesce("_under", F.lit(0)))
        .alias("matches_known"))


def import_hosts(domains: DataFrame, entries: DataFrame, actor: str, as_of: str,
                 soft: tuple[str, ...] = (), rules: DataFrame | None = None,
                 category: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block every name of a parsed hosts file by hand; returns (domains, decisions, counts).

    Unknown names enter first with origin ``imported``, with their registrable name by the public
    suffix ``rules`` (the short default list if none are given).  ``category`` goes to all names.
    """
    names = entries.select(F.col("domain").alias("name")).distinct()
    fresh = with_etld1(names.join(domains.select("name"), "name", "left_anti"),
                       suffix_rules(domains.sparkSession) if rules is None else rules, out="_root")
    blank = fresh.select("name", *[
        {"etld1": F.col("_root"), "status": F.lit("new"), "origin": F.lit("imported"),
         "is_manual": F.lit(False), "query_count": F.lit(0).cast("long"),
         "first_seen": _ts(as_of), "last_seen": _ts(as_of)}.get(
             f.name, F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name)
        for f in domains.schema if f.name != "name"])
    requests = names.select(
        "name", F.lit("block").alias("action"), F.lit(actor).alias("actor"),
        F.lit("hosts import").alias("reason"), F.lit(category).cast("string").alias("category"),
        F.lit(True).alias("manual"), F.lit(1).alias("seq"))
    allowed = blank.where(protecting_rule("name", soft).isNull())
    out, decisions, skipped = apply_decisions(
        domains.unionByName(allowed.select(*domains.columns)), requests, as_of, soft)
    counts = decisions.agg(F.count("*").alias("imported")).select(
        "imported", skipped.agg(F.count("*")).scalar().alias("skipped"))
    return out, decisions, counts


def resolve_requests(requests: DataFrame, answers: DataFrame, as_of: str
                     ) -> tuple[DataFrame, DataFrame]:
    """Close pending unblock requests; returns (requests, allow decisions to apply).

    ``answers (id, accept, actor)``; only pending requests change.
    """
    rows = requests.join(answers, "id", "left")
    closes = (F.col("state") == "pending") & F.col("accept").isNotNull()
    state = F.when(closes, F.when(F.col("accept"), "accepted").otherwise("rejected")).otherwise(
        F.col("state"))
    out = rows.withColumn("_new", state).withColumn("state", F.col("_new"))
    decided = rows.where(closes & F.col("accept")).select(
        "name", F.lit("allow").alias("action"), "actor", F.lit("unblock request").alias("reason"),
        F.lit(None).cast("string").alias("category"), F.lit(True).alias("manual"),
        F.col("id").alias("seq"))
    return out.select(*requests.columns), decided


def rescore(domains: DataFrame, candidates: DataFrame, categories: DataFrame, as_of: str,
            rules=None, weights=None) -> tuple[DataFrame, DataFrame]:
    """One job: score every candidate and store the result."""
    from dnslake.plans.score import score
    return save_scores(domains, score(candidates, rules, weights), categories, as_of)
