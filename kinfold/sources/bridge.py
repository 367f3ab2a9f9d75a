"""The star-schema tables read as a customer-data domain.

Regions are tenants, customers are customers, orders are orders, and the event stream holds
product engagement, support cases, subscription changes and consent changes. Each reader selects the
columns it needs, so scans stay pruned and filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import json_field
from ..runtime import table

SYSTEMS = {
    "customers": "account_app",
    "subscriptions": "billing_platform",
    "orders": "commerce_platform",
    "engagement_events": "product_analytics",
    "support_interactions": "support_desk",
    "marketing_engagement": "marketing_automation",
}


class Domain:
    """Readers over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def tenants(self) -> DataFrame:
        r, n = self.raw("region"), self.raw("nation")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey"), F.concat(F.lit("tenant_"), F.lower(F.regexp_replace("r_name", " ", "_"))).alias("tenant_id")
        )

    def customers(self) -> DataFrame:
        c, key = self.raw("customer"), F.col("c_custkey")
        return c.join(self.tenants(), c.c_nationkey == F.col("n_nationkey")).select(
            "tenant_id",
            F.concat(F.lit("cc_"), key).alias("canonical_customer_id"),
            F.concat(F.lit("cust_"), key).alias("customer_id"),
            F.lower("c_mktsegment").alias("business_unit"),
            F.when(key % 7 != 0, F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com"))).alias("email"),
            F.when(key % 11 != 0, F.concat(F.lit("+1"), (key + 5550000000).cast("string"))).alias("phone"),
            F.when(key % 5 == 0, "lead").when(key % 5 == 1, "inactive").otherwise("active").alias("customer_status"),
            (F.lit(0.6) + (key % 40) / 100.0).alias("identity_confidence"),
            F.col("c_acctbal").alias("balance"),
            key.alias("custkey"),
        )

    def identity_map(self) -> DataFrame:
        """One active row per source record: order references, event users and accounts."""
        return self.customers().select("tenant_id", "canonical_customer_id", "customer_id", "custkey", (F.col("custkey") % 13 != 0).alias("is_active"))

    def orders(self) -> DataFrame:
        o = self.raw("orders")
        status = F.when(F.col("o_orderstatus") == "O", "canceled").when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0),
            "refunded").otherwise("paid")
        return o.where(F.col("o_custkey") % 20 != 0).select(
            F.concat(F.lit("ord_"), "o_orderkey").alias("order_id"), F.col("o_custkey").alias("custkey"), status.alias("order_status"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("gross_amount"), F.col("o_orderdate").alias("ordered_at"),
                F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority"),
        )

    def events(self) -> DataFrame:
        k = json_field(F.col("props"), "k").try_cast("int")
        return self.raw("events").select("event_id", "ts", F.col("user_id").alias("custkey"), "event_type", "value", k.alias("k"))

    def engagement(self) -> DataFrame:
        e = self.events().where(F.col("event_type").isin("view", "click"))
        return e.select("event_id", "custkey", "event_type", F.col("k").alias("event_count"), (F.col("k") % 60).alias("session_minutes"),
            F.col("ts").alias("activity_at"))

    def support(self) -> DataFrame:
        k = F.col("k")
        csat = F.when(k % 20 == 5, 1).when(k % 20 == 0, None).otherwise(3 + k % 3)
        return self.events().where("event_type = 'error'").select(
            "event_id", "custkey", F.when(k % 20 == 0, "open").otherwise("closed").alias("status"),
                F.when(k % 3 == 0, "high").otherwise("normal").alias("priority"), csat.cast("int").alias("csat_score"), F.col("ts").alias("created_at")
        )

    def subscription_events(self) -> DataFrame:
        status = F.when(F.col("event_type") == "signup", "trialing").when(F.col("event_type") == "purchase",
            "active").when(F.col("event_type") == "error", "past_due").otherwise("canceled")
        return self.events().where("event_type <> 'view'").select(
            "event_id", "custkey", F.concat(F.lit("sub_"), "custkey").alias("subscription_id"), status.alias("subscription_status"),
            F.when(F.col("k") % 10 == 0, "enterprise").when(F.col("k") % 10 < 5, "starter").otherwise("growth").alias("plan_name"),
                (F.col("k") * 10).cast("decimal(18,2)").alias("mrr"), (F.col("k") == 99).alias("is_delete"), F.col("ts").alias("event_timestamp"),
        )

    def consent(self) -> DataFrame:
        k = F.col("k")
        return self.events().where("event_type = 'signup'").select(
            "event_id", "custkey", F.when(k % 4 != 0, "opted_in").otherwise("opted_out").alias("marketing_consent_status"),
                (k % 2 == 1).alias("email_opt_in"), (F.floor(k / 2) % 2 == 1).alias("sms_opt_in"), (F.floor(k / 4) % 2 == 1).alias("push_opt_in"),
            (k % 25 == 0).alias("do_not_contact"), F.when(k % 9 == 0, "unsubscribed").otherwise("subscribed").alias("unsubscribe_status"),
                (k == 98).alias("is_delete"), F.col("ts").alias("event_timestamp"),
        )

    def deletion_requests(self) -> DataFrame:
        c = self.customers()
        return c.where("custkey % 50 = 3").select("canonical_customer_id", F.when(F.col("custkey") % 100 == 3, F.col("tenant_id")).alias("tenant_id"))

    def envelopes(self) -> DataFrame:
        """Change events of the whole stream in one envelope, JSON payloads, in the order of arrival."""
        source = F.when(F.col("event_type").isin("view", "click"), "engagement_events").when(F.col("event_type") == "error",
            "support_interactions").when(F.col("event_type") == "signup", "marketing_engagement").otherwise("subscriptions")
        e, key = self.events().alias("e"), F.col("custkey")
        c = self.customers().select("custkey", "tenant_id")
        system = F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv])
        return e.join(c, "custkey", "left").select(
            F.concat(F.lit("evt_"), "event_id").alias("event_id"),
            F.when(F.col("k") != 97, F.col("tenant_id")).alias("tenant_id"),
            F.element_at(system, source).alias("source_system"), source.alias("source_table"),
            F.when(F.col("k") == 99, "delete").when(F.col("k") % 2 == 0, "insert").when(F.col("k") == 33, "upsert").otherwise("update").alias("operation_type"),
            F.col("ts").alias("event_timestamp"), F.when(F.col("k") != 96, F.concat(F.lit("rec_"), key)).alias("record_primary_key"),
            F.when(F.col("k") == 99, F.to_json(F.struct("k", "value"))).alias("payload_before"),
                F.when(F.col("k") != 99, F.to_json(F.struct("k", "value"))).alias("payload_after"),
            F.when(F.col("k") == 95, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("b"), F.col("event_id") % 8).alias("batch_id"),
            F.col("event_id").alias("event_sequence_number"), F.col("event_id").alias("arrival_ordinal"),
                (F.col("event_id") % 3).cast("int").alias("kafka_partition"), F.floor(F.col("event_id") / 3).cast("bigint").alias("kafka_offset"),
            source.alias("kafka_topic"), F.sha2(F.concat_ws("|", key, "event_type", "k"), 256).alias("event_hash"), F.col("k"), F.col("value"),
                key.alias("custkey"),
        )


#: The same readings for the oracle (DuckDB), as common table expressions.
ORACLE_CTES: dict[str, str] = {
    "tenants": "SELECT n_nationkey, 'tenant_' || lower(replace(r_name, ' ', '_')) AS tenant_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "customers": """SELECT tenant_id, 'cc_' || c_custkey AS canonical_customer_id, 'cust_' || c_custkey AS customer_id, lower(c_mktsegment) AS business_unit,
        CASE WHEN c_custkey % 7 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
        CASE WHEN c_custkey % 11 <> 0 THEN '+1' || CAST(c_custkey + 5550000000 AS VARCHAR) END AS phone,
        CASE c_custkey % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'inactive' ELSE 'active' END AS customer_status,
        CAST(0.6 AS DOUBLE) + (c_custkey % 40) / CAST(100 AS DOUBLE) AS identity_confidence, c_acctbal AS balance, c_custkey AS custkey
        FROM customer JOIN tenants ON c_nationkey = n_nationkey""",
    "identity_map": "SELECT tenant_id, canonical_customer_id, customer_id, custkey, custkey % 13 <> 0 AS is_active FROM customers",
    "ord": """SELECT 'ord_' || o_orderkey AS order_id, o_custkey AS custkey, CASE WHEN o_orderstatus = 'O' THEN 'canceled' WHEN o_orderstatus = 'P' AND
    o_orderkey % 4 = 0 THEN 'refunded' ELSE 'paid' END AS order_status,
        CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount, o_orderdate AS ordered_at, o_orderkey AS seq, o_orderpriority AS priority FROM orders
    WHERE o_custkey % 20 <> 0""",
    "ev": "SELECT event_id, ts, user_id AS custkey, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "engagement": "SELECT event_id, custkey, event_type, k AS event_count, k % 60 AS session_minutes, ts AS activity_at FROM ev WHERE event_type IN ('view', 'click')",
    "support": """SELECT event_id, custkey, CASE WHEN k % 20 = 0 THEN 'open' ELSE 'closed' END AS status, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'normal' END AS priority,
        CASE WHEN k % 20 = 5 THEN 1 WHEN k % 20 = 0 THEN NULL ELSE 3 + k % 3 END AS csat_score, ts AS created_at FROM ev WHERE event_type = 'error'""",
    "subs": """SELECT event_id, custkey, 'sub_' || custkey AS subscription_id, CASE event_type WHEN 'signup' THEN 'trialing' WHEN 'purchase' THEN
    'active' WHEN 'error' THEN 'past_due' ELSE 'canceled' END AS subscription_status,
        CASE WHEN k % 10 = 0 THEN 'enterprise' WHEN k % 10 < 5 THEN 'starter' ELSE 'growth' END AS plan_name, CAST(k * 10 AS DECIMAL(18,2)) AS mrr, k =
    99 AS is_delete, ts AS event_timestamp FROM ev WHERE event_type <> 'view'""",
    "consent": """SELECT event_id, custkey, CASE WHEN k % 4 <> 0 THEN 'opted_in' ELSE 'opted_out' END AS marketing_consent_status, k % 2 = 1 AS
    email_opt_in, (k // 2) % 2 = 1 AS sms_opt_in, (k // 4) % 2 = 1 AS push_opt_in,
        k % 25 = 0 AS do_not_contact, CASE WHEN k % 9 = 0 THEN 'unsubscribed' ELSE 'subscribed' END AS unsubscribe_status, k = 98 AS is_delete, ts AS
    event_timestamp FROM ev WHERE event_type = 'signup'""",
    "deletion": "SELECT canonical_customer_id, CASE WHEN custkey % 100 = 3 THEN tenant_id END AS tenant_id FROM customers WHERE custkey % 50 = 3",
    "env": """SELECT 'evt_' || event_id AS event_id, CASE WHEN k <> 97 THEN tenant_id END AS tenant_id,
        CASE WHEN event_type IN ('view', 'click') THEN 'product_analytics' WHEN event_type = 'error' THEN 'support_desk' WHEN event_type = 'signup'
    THEN 'marketing_automation' ELSE 'billing_platform' END AS source_system,
        CASE WHEN event_type IN ('view', 'click') THEN 'engagement_events' WHEN event_type = 'error' THEN 'support_interactions' WHEN event_type =
    'signup' THEN 'marketing_engagement' ELSE 'subscriptions' END AS source_table,
        CASE WHEN k = 99 THEN 'delete' WHEN k % 2 = 0 THEN 'insert' WHEN k = 33 THEN 'upsert' ELSE 'update' END AS operation_type, ts AS event_timestamp,
        CASE WHEN k <> 96 THEN 'rec_' || ev.custkey END AS record_primary_key, k = 99 AS has_before, k <> 99 AS has_after, CASE WHEN k = 95 THEN 2 ELSE
    1 END AS schema_version, 'b' || (event_id % 8) AS batch_id,
        event_id AS event_sequence_number, event_id AS arrival_ordinal, CAST(event_id % 3 AS INT) AS kafka_partition, event_id // 3 AS kafka_offset,
    sha256(concat_ws('|', ev.custkey, event_type, k)) AS event_hash, k, value, ev.custkey
        FROM ev LEFT JOIN customers ON ev.custkey = customers.custkey""",
}


def oracle(body: str, *extra: tuple[str, str]) -> str:
    """``body`` under the readings (and ``extra`` expressions) that it names, directly or through others."""
    import re

    every = ORACLE_CTES | dict(extra)
    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for n in every:
            if n not in names and re.search(rf"\b{n}\b", text):
                names.add(n)
                todo.append(every[n])
    used = ", ".join(f"{n} AS ({q})" for n, q in every.items() if n in names)
    return f"WITH {used} {body}" if used else body


def alive(is_delete: Column) -> Column:
    return ~F.coalesce(is_delete, F.lit(False))
