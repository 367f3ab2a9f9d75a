"""The sources of change events: their domain, system, keys, topic and the operations that may come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Domain, system, table, primary key, business key, tenant key, topic.
SOURCES = [
    ("account", "account_app", "customers", "customer_id", "external_account_id", "tenant_id", "cdc.customers"),
    ("subscription", "billing_platform", "subscriptions", "subscription_id", "external_account_id", "tenant_id", "cdc.subscriptions"),
    ("order", "commerce_platform", "orders", "order_id", "order_customer_ref", "tenant_id", "cdc.orders"),
    ("engagement", "product_analytics", "engagement_events", "engagement_event_id", "device_id", "tenant_id", "cdc.engagement_events"),
    ("support", "support_desk", "support_interactions", "support_interaction_id", "support_customer_ref", "tenant_id", "cdc.support_interactions"),
    ("marketing", "marketing_automation", "marketing_engagement", "marketing_touch_id", "external_account_id", "tenant_id", "cdc.marketing_engagement"),
]
OPERATIONS = ["snapshot", "insert", "update", "delete"]


def manifest(spark: SparkSession) -> DataFrame:
    rows = [(*s, OPERATIONS) for s in SOURCES]
    return spark.createDataFrame(rows, "domain string, source_system string, source_table string, primary_key string, business_key string, tenant_key string, topic string, expected_operations array<string>")


def unexpected(events: DataFrame) -> DataFrame:
    """Events that the manifest doesn't foresee: of a table it doesn't have, or of another system, topic or operation than it says."""
    m = manifest(events.sparkSession).select("source_table", F.col("source_system").alias("__system"), F.col("topic").alias("__topic"),
        F.col("expected_operations").alias("__ops"))
    met = events.join(m, "source_table", "left")
    why = (
        F.when(F.col("__system").isNull(), "unknown_table").when(F.col("source_system") != F.col("__system"), "other_system")
        .when(F.col("kafka_topic").isNotNull() & ~F.col("kafka_topic").isin("") & (F.col("kafka_topic") != F.col("__topic")),
            "other_topic").when(~F.array_contains("__ops", F.lower("operation_type")), "other_operation")
    )
    return met.withColumn("reason", why).where("reason is not null").select("event_id", "source_table", "reason")
