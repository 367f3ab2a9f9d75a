"""Destination syncs in closed form, their state, and reconciliation of every customer's outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, hash_bucket

KEYS = ["tenant_id", "canonical_customer_id"]

#: Destination, export, rows a request, retries, required fields.
DESTINATIONS = [
    ("braze", "campaign_target", 4, 3, ["canonical_customer_id", "export_timestamp", "campaign_target", "customer_segment", "churn_risk_band"]),
    ("hubspot", "customer_segment", 5, 3, ["canonical_customer_id", "export_timestamp", "customer_segment"]),
    ("salesforce", "churn_risk", 4, 3, ["canonical_customer_id", "export_timestamp", "churn_risk_score", "churn_risk_band"]),
    ("zendesk", "support_priority", 3, 3, ["canonical_customer_id", "export_timestamp", "support_priority", "churn_risk_band"]),
]


def attempts(bucket: Column, max_retries: int) -> tuple[Column, Column, Column]:
    """(attempts, rate limits met, failed) of a row by its hash bucket: every 29th fails for good, every 17th is rate-limited
    once, every 23rd needs three attempts."""
    permanent = bucket % 29 == 0
    limited = ~permanent & (bucket % 17 == 0)
    flaky = ~permanent & (bucket % 23 == 0)
    need = F.when(permanent, 1).when(flaky, 3).when(limited, 2).otherwise(1)
    return F.least(need, F.lit(max_retries)), limited.cast("int"), permanent | (need > max_retries)


def sync_rows(rows: DataFrame, previous: DataFrame | None, destination: tuple) -> DataFrame:
    """Each exported row's outcome: key, payload hash, attempts, and inserted, updated, skipped_unchanged or failed with the
    reason. The hash covers every exported field, ``export_timestamp`` too, so what is exported again later is updated."""
    name, export, _, retries, required = destination
    fields = [c for c in rows.columns if c not in KEYS]
    key = F.concat_ws(":", F.lit(name), F.lit(export), "canonical_customer_id")
    body = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    r = rows.withColumns({"destination": F.lit(name), "record_key": key, "payload_hash": body})
    bucket = hash_bucket(F.concat_ws(":", F.lit(name), F.coalesce("tenant_id", F.lit("")), F.coalesce("canonical_customer_id", F.lit(""))), 1 << 31)
    n, limited, failed = attempts(bucket, retries)
    have = set(rows.columns)
    missing = F.array_compact(F.array(*[F.when(blank_to_null(F.col(f).cast("string")).isNull() if f in have else F.lit(True), F.lit(f)) for f in required]))
    contract = F.size(missing) > 0
    absent = contract | (F.col("hashed_email").isNull() & F.col("hashed_phone").isNull())
    why = (
        F.when(contract, F.concat(F.lit("destination_contract_missing_fields:"), F.array_join(missing, ","))).when(absent, "missing_destination_match_key")
        .when(bucket % 29 == 0, "destination_validation_error").when(failed, F.when(bucket % 17 == 0, "http_429_rate_limit").otherwise("transient_5xx"))
    )
    r = r.withColumns({"idempotency_key": F.sha2(F.concat_ws(":", "record_key", "payload_hash"), 256), "attempts": F.when(absent, 1).otherwise(n),
        "rate_limited": F.when(absent, 0).otherwise(limited), "failure_reason": why})
    bad = absent | failed
    if previous is None:
        known = F.lit(None).cast("string")
    else:
        r = r.join(previous.select("record_key", F.col("payload_hash").alias("known_hash")), "record_key", "left")
        known = F.col("known_hash")
    status = F.when(bad, "failed").when(known.isNull(), "inserted").when(known == F.col("payload_hash"), "skipped_unchanged").otherwise("updated")
    return r.select(*KEYS, "destination", "record_key", "payload_hash", "idempotency_key", "attempts", "rate_limited", status.alias("status"), "failure_reason")


def payload_audit(outcomes: DataFrame, run_id: str, at: Column) -> DataFrame:
    """One row per payload of a run: its keys and hash, how it went, the retries, why it failed."""
    return outcomes.select(
        F.lit(run_id).alias("sync_run_id"), "tenant_id", F.col("destination").alias("destination_name"), "canonical_customer_id", "idempotency_key",
            "payload_hash",
        F.when(F.col("status") == "updated", "update").otherwise("insert").alias("sync_mode"), F.col("status").alias("sync_status"),
            (F.col("attempts") - 1).alias("retry_count"), "failure_reason", at.alias("audited_at"),
    )


def failed_rows(outcomes: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The rows that failed, and whether another run may mend them."""
    bad = outcomes.where("status = 'failed'")
    return bad.select(F.lit(run_id).alias("sync_run_id"), "tenant_id", F.col("destination").alias("destination_name"), "canonical_customer_id",
        "idempotency_key", "failure_reason", "attempts", F.col("failure_reason").isin("http_429_rate_limit", "transient_5xx").alias("is_retryable"),
            at.alias("failed_at"))


def destination_status(logs: DataFrame) -> DataFrame:
    """Per destination its latest run: ``logs`` are those of ``sync_log`` with ``sync_run_id`` and ``ended_at``."""
    last = F.max_by(F.struct("sync_run_id", "status", "attempted_count", "success_count", "failed_count", "retry_count", "ended_at"),
        F.struct("ended_at", "sync_run_id")).alias("x")
    g = logs.groupBy("destination").agg(last)
    return g.select(F.col("destination").alias("destination_name"), F.col("x.sync_run_id").alias("latest_sync_run_id"),
        F.col("x.status").alias("last_sync_status"), "x.attempted_count", "x.success_count", "x.failed_count", "x.retry_count",
            F.col("x.ended_at").alias("last_synced_at"))


def sync_state(previous: DataFrame | None, outcomes: DataFrame) -> DataFrame:
    """(record_key, payload_hash) after a run: what succeeded replaces what was known, the rest is carried forward."""
    done = outcomes.where("status <> 'failed'").select("record_key", "payload_hash", F.lit(1).alias("at"))
    if previous is not None:
        done = done.unionByName(previous.select("record_key", "payload_hash", F.lit(0).alias("at")))
    return done.groupBy("record_key").agg(F.max_by("payload_hash", "at").alias("payload_hash"))


def sync_log(outcomes: DataFrame, destinations: list[tuple] = DESTINATIONS) -> DataFrame:
    """Per destination the counters of a run; success includes unchanged rows; a full request meets one rate limit."""
    per = F.element_at(F.create_map(*[F.lit(x) for d in destinations for x in (d[0], d[2])]), F.col("destination"))
    c = lambda s: F.count_if(F.col("status") == s)
    g = outcomes.groupBy("destination").agg(
        F.count("*").alias("attempted_count"), c("inserted").alias("inserted_count"), c("updated").alias("updated_count"),
            c("skipped_unchanged").alias("skipped_count"), c("failed").alias("failed_count"), F.sum(F.col("attempts") - 1).alias("retry_count"),
                F.sum("rate_limited").alias("limited")
    )
    g = g.withColumns({"success_count": F.col("attempted_count") - F.col("failed_count"),
        "rate_limit_events": F.floor((F.col("attempted_count") - 1) / per).cast("bigint") + F.col("limited")}).drop("limited")
    return g.withColumn("status", F.when(F.col("failed_count") == 0, "success").when(F.col("success_count") > 0, "partial_success").otherwise("failed"))


def sync_health(log: DataFrame) -> DataFrame:
    g = log.groupBy("destination").agg(F.sum("attempted_count").alias("attempted"), F.sum("success_count").alias("succeeded"),
        F.sum("failed_count").alias("failed"), F.sum("retry_count").alias("retries"), F.sum("rate_limit_events").alias("rate_limits"))
    return g.withColumn("status", F.when(F.col("failed") > 0, "degraded").when(F.col("rate_limits") > 0, "rate_limited").otherwise("healthy"))


def reconcile(outcomes: DataFrame, exported: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Per (destination, tenant): every customer's outcome counted; ``variance`` is what isn't explained."""
    base = eligibility.groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if(F.col("suppression_reason").isNotNull()).alias("suppressed_count"))
    rows = exported.groupBy("destination", "tenant_id").agg(F.count("*").alias("export_count"))
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    out = outcomes.groupBy("destination", "tenant_id").agg(F.count("*").alias("audited"), c("inserted", "updated").alias("success_count"),
        c("failed").alias("failed_count"), c("skipped_unchanged").alias("duplicate_count"))
    m = rows.join(out, ["destination", "tenant_id"], "full_outer").join(base, "tenant_id")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    m = m.select("destination", "tenant_id", "total", *[n(x).alias(x) for x in ("export_count", "audited", "success_count", "failed_count",
        "duplicate_count", "suppressed_count")])
    m = m.withColumn("skipped_count", F.greatest(F.lit(0), F.col("export_count") - F.col("audited")))
    explained = F.col("success_count") + F.col("failed_count") + F.col("suppressed_count") + F.col("skipped_count") + F.col("duplicate_count")
    return m.withColumns({"variance": F.col("total") - explained,
        "explained_pct": F.round(100.0 * explained / F.nullif(F.col("total"), F.lit(0)), 2)}).drop("audited")


def findings(exported: DataFrame, outcomes: DataFrame, eligibility: DataFrame) -> DataFrame:
    """(finding, severity, destination, tenant_id, canonical_customer_id): seven kinds of what reconciliation can't explain."""
    key = ["destination", *KEYS]
    ok = eligibility.where("activation_eligible").select(*KEYS)
    no = eligibility.where("not activation_eligible").select(*KEYS)
    dest = exported.select("destination").distinct()
    here = exported.select(*key).distinct()
    home = eligibility.select("canonical_customer_id", F.col("tenant_id").alias("home"))
    wrong = exported.join(home, "canonical_customer_id").groupBy(*key).agg(F.bool_or(F.col("home") == F.col("tenant_id")).alias("ok")).where("not ok").select(*key)
    kinds = {
        ("missing_eligible_row", "high"): ok.crossJoin(F.broadcast(dest)).join(here, key, "left_anti"),
        ("unexpected_exported_row", "high"): here.join(eligibility.select(*KEYS), KEYS, "left_anti"),
        ("privacy_suppressed_row_exported", "critical"): here.join(no, KEYS, "left_semi"),
        ("duplicate_customer_export", "medium"): exported.groupBy(*key).count().where("count > 1").select(*key),
        ("missing_hashed_identifier", "medium"): exported.where("hashed_email is null and hashed_phone is null").select(*key).distinct(),
        ("wrong_tenant_row", "critical"): wrong,
        ("duplicate_idempotency_key", "medium"): outcomes.join(outcomes.groupBy("idempotency_key").count().where("count > 1"), "idempotency_key",
            "left_semi").select(*key).distinct(),
    }
    parts = [df.select(F.lit(n).alias("finding"), F.lit(s).alias("severity"), *key) for (n, s), df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)
