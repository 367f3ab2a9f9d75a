"""Analysts' SQL over the marts as temporary views, singular data tests, run events, health checks, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import quality

KEYS = ["tenant_id", "canonical_customer_id"]

#: Named queries over views named as they say.
SQL = {
    "serving_view": "SELECT tenant_id, canonical_customer_id, lifecycle_stage, churn_risk_score FROM customer_360 ORDER BY churn_risk_score DESC NULLS LAST, canonical_customer_id",
    "identity_lineage": "SELECT tenant_id, canonical_customer_id, source_system, record_id, match_rule, match_confidence FROM identity_map ORDER BY canonical_customer_id, source_system, record_id",
    "quality_summary": "SELECT check, status, failures FROM quality_summary ORDER BY failures DESC, check",
    "pipeline_health": "SELECT source_table, records, rejected, rejected_rate, health FROM pipeline_health ORDER BY health DESC, rejected_rate DESC, source_table",
    "masked_mart": "SELECT tenant_id, canonical_customer_id, email AS masked_email, phone AS masked_phone, lifecycle_stage, churn_risk_band FROM customer_360_masked",
    "subscription_as_of": "SELECT canonical_customer_id, subscription_id, plan_name, subscription_status, valid_from, valid_to FROM subscription_history WHERE canonical_customer_id = :customer AND valid_from <= CAST(:at AS timestamp_ntz) AND coalesce(valid_to, timestamp_ntz'9999-12-31') > CAST(:at AS timestamp_ntz)",
    "events_known_by": "SELECT e.event_id, e.source_system, e.operation_type, e.event_timestamp FROM raw_events e JOIN (SELECT source_system, record_id FROM identity_map WHERE canonical_customer_id = :customer) r ON r.source_system = e.source_system AND r.record_id = e.record_primary_key WHERE e.event_timestamp <= CAST(:at AS timestamp_ntz) ORDER BY e.event_timestamp, e.event_id",
    "lineage_behind": "SELECT c.canonical_customer_id, c.email, m.source_system, m.record_id, m.match_rule, m.match_confidence FROM canonical_customers c JOIN identity_map m USING (tenant_id, canonical_customer_id) WHERE c.canonical_customer_id = :customer ORDER BY m.source_system, m.record_id",
    "subscriptions_as_of": "SELECT tenant_id, subscription_id, subscription_status FROM subscription_history WHERE valid_from <= CAST(:at AS timestamp_ntz) AND coalesce(valid_to, timestamp_ntz'9999-12-31') > CAST(:at AS timestamp_ntz)",
    "lifecycle_as_of": "SELECT tenant_id, canonical_customer_id, lifecycle_stage FROM lifecycle_history WHERE stage_started_at <= CAST(:at AS timestamp_ntz) AND coalesce(stage_ended_at, timestamp_ntz'9999-12-31') > CAST(:at AS timestamp_ntz)",
    "churn_export": "SELECT tenant_id, canonical_customer_id, churn_risk_score, churn_risk_band FROM churn_export ORDER BY churn_risk_score DESC, tenant_id, canonical_customer_id",
    "suppression_by_reason": "SELECT tenant_id, suppression_reason, count(*) AS customers FROM eligibility WHERE NOT activation_eligible GROUP BY tenant_id, suppression_reason",
}


def run(spark: SparkSession, name: str, views: dict[str, DataFrame], **args) -> DataFrame:
    """A named query over ``views``; arguments are bound, never pasted in."""
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    return spark.sql(SQL[name], args=args)


def quality_summary(checks: DataFrame) -> DataFrame:
    """``checks`` (check, failures) with ``status``."""
    return checks.select("check", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "failures")


def data_tests(exports: dict[str, DataFrame], eligibility: DataFrame, customers: DataFrame, orders: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(test, failures): nine tests over the models, each with no failing row where the models hold."""
    every = reduce(DataFrame.unionByName, [e.select(F.lit(n).alias("export"), *KEYS) for n, e in exports.items()])
    flag = every.join(eligibility.select(*KEYS, "activation_eligible"), KEYS, "left")
    counts = every.groupBy("export").agg(F.count("*").alias("n")).crossJoin(F.broadcast(eligibility.agg(F.count_if("activation_eligible").alias("eligible"))))
    nxt = F.lead("valid_from").over(Window.partitionBy("tenant_id", "subscription_id").orderBy("valid_from", "subscription_sk"))
    open_ = F.col("deletion_requested") | ~F.col("any_channel") | ~F.coalesce(F.col("marketing_consent_status") == "opted_in", F.lit(False))
    found = {
        "exports_are_eligible": flag.where(~F.coalesce("activation_eligible", F.lit(False))),
        "export_counts_match": counts.where("n <> eligible"),
        "deleted_subscription_not_current": subscriptions.where("is_delete and is_current"),
        "order_keys_unique": quality.duplicates(orders, ["tenant_id", "order_id"]),
        "no_orphan_exports": every.join(customers.select(*KEYS), KEYS, "left_anti"),
        "no_overlapping_intervals": subscriptions.withColumn("nxt", nxt).where("valid_to > nxt"),
        "eligibility_fails_closed": eligibility.where(F.col("activation_eligible") & open_),
        "one_current_subscription": quality.duplicates(subscriptions.where("is_current"), ["tenant_id", "subscription_id"]),
        "valid_windows": subscriptions.where("valid_from >= valid_to"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("failures")).select(F.lit(n).alias("test"), "failures") for n, df in found.items()])


def run_events(jobs: DataFrame, at: Column) -> DataFrame:
    """START and COMPLETE events of each job (job_name, inputs, outputs) for a lineage collector, as JSON."""
    kinds = jobs.withColumn("event_type", F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))))
    run_id = F.sha1(F.concat_ws("|", "job_name", at.cast("string")))
    return kinds.select("job_name", "event_type", F.to_json(F.struct(F.col("event_type").alias("eventType"), at.cast("string").alias("eventTime"),
        F.struct(run_id.alias("runId")).alias("run"), F.struct(F.col("job_name").alias("name")).alias("job"), "inputs", "outputs")).alias("event"))


def health_checks(tables: dict[str, DataFrame], none_expected: dict[str, DataFrame]) -> DataFrame:
    """(check, value, status): tables that must have rows, and findings that must have none."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(f"{n}_not_empty").alias("check"), "value",
        F.when(F.col("value") > 0, "pass").otherwise("fail").alias("status")) for n, df in tables.items()]
    parts += [df.agg(F.count("*").alias("value")).select(F.lit(f"{n}_empty").alias("check"), "value",
        F.when(F.col("value") == 0, "pass").otherwise("fail").alias("status")) for n, df in none_expected.items()]
    return reduce(DataFrame.unionByName, parts)


def retention_due(rows: DataFrame, policy: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows past the retention days of their tenant's policy (tenant_id, retention_days)."""
    return rows.join(policy, "tenant_id").where(micros(now) - micros(F.col(at)) > F.col("retention_days") * F.lit(86_400_000_000))


def survivorship_rules(spark: SparkSession) -> DataFrame:
    """The fixed order of sources by which fields survive."""
    from ..operators.identity import PRIORITY

    return spark.createDataFrame([(s, p, "priority, then newest, then first") for s, p in PRIORITY.items()], "source_system string, priority int, rule string")
