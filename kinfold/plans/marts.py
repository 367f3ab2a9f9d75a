"""Current state, histories, health, the customer view, eligibility and operational marts.

Each model is a function from DataFrames to a DataFrame; nothing is computed before the caller's action, so Catalyst
sees one plan and prunes and pushes through all of it. Star joins keep (tenant, customer) as their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, health_band, lifecycle_stage, mask_email_raw, mask_phone_raw, micros, minutes_between, surrogate_key
from ..operators.history import scd2
from ..sources.bridge import Domain

REVENUE_UNIT = 6000.0  # order totals of the sample tables per unit of scored revenue
KEYS = ["tenant_id", "canonical_customer_id"]


class Marts:
    def __init__(self, domain: Domain):
        self.d = domain

    def _mapped(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Source rows with their tenant and customer."""
        m = self.d.identity_map().select("custkey", *KEYS)
        return df.join(m, "custkey", how)

    # -- facts and roll-ups

    def order_history(self) -> DataFrame:
        return self._mapped(self.d.orders())

    def _rolled(self, rows: DataFrame, sums: dict[str, Column], latest: dict[str, Column]) -> DataFrame:
        """Sums and maxima per customer: first per source key, where each task pre-aggregates its rows, so that the join to
        customers and the second shuffle move one row per key instead of every fact."""
        per_key = rows.groupBy("custkey").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in latest.items()])
        return self._mapped(per_key).groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in latest])

    def order_totals(self) -> DataFrame:
        paid, refunded = F.col("order_status") == "paid", F.col("order_status") == "refunded"
        sums = {"order_count": F.lit(1), "paid_total": F.when(paid, F.col("gross_amount")).otherwise(0), "paid_orders": paid.cast("int"),
            "refunded_orders": refunded.cast("int")}
        return self._rolled(self.d.orders(), sums, {"last_order_at": F.col("ordered_at")}).withColumn("paid_total", F.col("paid_total").cast("double"))

    def activity_rollup(self) -> DataFrame:
        """Engagement and support, each summed by customer, met in a full outer join."""
        n = lambda x: F.coalesce(x, F.lit(0))
        flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        e = self._rolled(self.d.engagement(), {"engagement_events": F.lit(1), "event_count": n("event_count"),
            "session_minutes": n("session_minutes")}, {"last_engagement_at": F.col("activity_at")})
        s = self._rolled(self.d.support(), {"support_cases": F.lit(1), "open_cases": flag(F.col("status") == "open"),
            "low_csat_cases": flag(F.col("csat_score") <= 2)}, {"last_support_at": F.col("created_at")})
        zero = {c: n(c) for c in ("engagement_events", "event_count", "session_minutes", "support_cases", "open_cases", "low_csat_cases")}
        return e.join(s, KEYS, "full_outer").withColumns(zero).withColumn("last_activity_at", F.greatest("last_engagement_at", "last_support_at"))

    def subscription_history(self) -> DataFrame:
        rows = self._mapped(self.d.subscription_events())
        h = scd2(rows, ["tenant_id", "subscription_id"], "event_timestamp", "event_id", "is_delete")
        return h.withColumn("subscription_sk", surrogate_key(F.col("tenant_id"), F.col("subscription_id"), micros(F.col("valid_from")), F.col("event_id")))

    def current_subscription(self) -> DataFrame:
        w = Window.partitionBy(*KEYS).orderBy(F.col("valid_from").desc(), F.col("event_id").desc())
        h = self.subscription_history().where("is_current").withColumn("rn", F.row_number().over(w)).where("rn = 1")
        return h.select(*KEYS, "subscription_id", "subscription_status", "plan_name", "mrr")

    def lifecycle_history(self) -> DataFrame:
        h = self.subscription_history()
        w = Window.partitionBy(*KEYS).orderBy("valid_from", "event_id")
        ended = F.coalesce("valid_to", F.lead("valid_from").over(w))
        return h.select(*KEYS, "event_id", lifecycle_stage(F.col("subscription_status")).alias("lifecycle_stage"),
            F.col("valid_from").alias("stage_started_at"), ended.alias("stage_ended_at"), "is_current")

    # -- health and the customer view

    def features(self) -> DataFrame:
        """Customers with their order totals and activity: the one star join that health and the view both read."""
        o = self.order_totals().select(*KEYS, "order_count", "paid_total", "refunded_orders", "last_order_at")
        a = self.activity_rollup().select(*KEYS, "event_count", "session_minutes", "support_cases", "open_cases", "low_csat_cases", "last_activity_at")
        n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("order_count", "refunded_orders", "event_count", "support_cases", "open_cases",
            "low_csat_cases")}
        m = self.d.customers().join(o, KEYS, "left").join(a, KEYS, "left").withColumns(n)
        return m.withColumn("revenue", F.coalesce(F.col("paid_total"), F.lit(0.0)) / REVENUE_UNIT)

    @staticmethod
    def _scored(m: DataFrame) -> DataFrame:
        points = F.lit(55) + F.least("event_count", F.lit(30)) + F.least(F.round(F.col("revenue") / 50, 0).cast("int"),
            F.lit(20)) - 15 * F.col("open_cases") - 20 * F.col("low_csat_cases") - 10 * F.col("refunded_orders")
        m = m.withColumn("health_score", clamp(points, 0, 100).cast("int"))
        churn = 100 - F.col("health_score")
        return m.withColumns({"churn_risk_score": churn, "churn_risk_band": health_band(churn), "revenue": F.round("revenue", 6)})

    def health(self) -> DataFrame:
        m = self._scored(self.features())
        parts = ["revenue", "event_count", "open_cases", "low_csat_cases", "refunded_orders"]
        return m.select(*KEYS, "health_score", *parts, "churn_risk_score", "churn_risk_band", F.to_json(F.struct(*parts)).alias("feature_payload"))

    def customer_360(self) -> DataFrame:
        m = self._scored(self.features()).join(self.current_subscription(), KEYS, "left")
        return m.select(
            *KEYS, "customer_id", "business_unit", "email", "phone", "customer_status", "plan_name",
                F.coalesce("subscription_status", F.lit("none")).alias("subscription_status"),
                    lifecycle_stage(F.col("subscription_status")).alias("lifecycle_stage"),
            F.coalesce(F.col("mrr").cast("double"), F.lit(0.0)).alias("mrr"), "order_count", "revenue", "event_count", "support_cases", "open_cases",
                "health_score", "churn_risk_score", "churn_risk_band",
            F.greatest(micros(F.col("last_order_at")), micros(F.col("last_activity_at"))).alias("last_seen_us"),
        )

    def customer_360_masked(self) -> DataFrame:
        return self.customer_360().withColumns({"email": mask_email_raw(F.col("email")), "phone": mask_phone_raw(F.col("phone"))})

    # -- privacy

    def latest_consent(self) -> DataFrame:
        w = Window.partitionBy(*KEYS).orderBy(F.col("event_timestamp").desc(), F.col("event_id").desc())
        return self._mapped(self.d.consent(), "inner").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "custkey")

    def eligibility(self) -> DataFrame:
        """Who may be activated and why not, the first reason of the ladder; a deletion request counts for its
        tenant, or for every tenant where it names none."""
        base = self.d.customers().select(*KEYS, "email", "phone")
        c = self.latest_consent().withColumnRenamed("event_id", "consent_event_id")
        req = self.d.deletion_requests()
        named = req.where("tenant_id is not null").select(*KEYS).distinct().withColumn("del_t", F.lit(True))
        anywhere = req.where("tenant_id is null").select("canonical_customer_id").distinct().withColumn("del_any", F.lit(True))
        m = base.join(c, KEYS, "left").join(named, KEYS, "left").join(anywhere, "canonical_customer_id", "left")
        deleted = F.coalesce("del_t", "del_any", F.lit(False))
        opted = F.coalesce("email_opt_in", F.lit(False)) | F.coalesce("sms_opt_in", F.lit(False)) | F.coalesce("push_opt_in", F.lit(False))
        reason = (
            F.when(deleted, "privacy_deletion_requested").when(F.coalesce("do_not_contact", F.lit(False)),
                "do_not_contact").when(F.coalesce("is_delete", F.lit(False)), "consent_source_deleted")
            .when(F.col("unsubscribe_status") == "unsubscribed", "unsubscribed").when(F.col("marketing_consent_status").isNull(),
                "missing_consent_state").when(F.col("marketing_consent_status") != "opted_in",
                    F.concat(F.lit("marketing_consent_"), "marketing_consent_status"))
            .when(~opted, "no_active_channel_consent").when(F.col("email").isNull() & F.col("phone").isNull(), "missing_activation_identifier")
        )
        return m.select(*KEYS, "consent_event_id", "marketing_consent_status", deleted.alias("deletion_requested"), opted.alias("any_channel"),
            reason.isNull().alias("activation_eligible"), reason.alias("suppression_reason"))

    # -- operations

    def identity_quality(self) -> DataFrame:
        c = self.d.customers()
        return c.groupBy("tenant_id", "business_unit").agg(
            F.count("*").alias("customers"), F.round(F.avg("identity_confidence"), 6).alias("avg_confidence"),
                F.count_if(F.col("identity_confidence") < 0.75).alias("low_confidence"),
            F.count_if(F.col("email").isNull()).alias("missing_email"), F.count_if(F.col("phone").isNull()).alias("missing_phone"),
        )

    def pipeline_health(self, summary: DataFrame, freshness: DataFrame) -> DataFrame:
        """Per source table: counts of all loads, rejected rate, lag; over 360 minutes critical, over 5 % rejected a warning."""
        g = summary.groupBy("source_table").agg(F.sum("record_count").alias("records"), F.sum("rejected_count").alias("rejected"),
            F.max_by("status", "batch_id").alias("last_status"))
        rate = F.coalesce(F.col("rejected") / F.nullif(F.col("records"), F.lit(0)), F.lit(0.0))
        m = g.withColumn("rejected_rate", F.round(rate, 6)).join(freshness.groupBy("source_table").agg(F.min("lag_minutes").alias("lag_minutes")),
            "source_table", "left")
        lag = F.coalesce("lag_minutes", F.lit(999999))
        return m.withColumn("health", F.when(lag > 360, "critical").when(F.col("rejected_rate") > 0.05, "warning").otherwise("healthy"))

    def semantic_metrics(self, rejected_rate: DataFrame, sync_health: DataFrame, export_freshness: DataFrame) -> DataFrame:
        """Six metrics, a row each; one-row aggregates meet in cross joins of one row."""
        c = self.customer_360()
        a = c.agg(F.count_if(F.col("lifecycle_stage") == "active_customer").cast("double").alias("active_customers"),
            F.round(F.avg((F.col("churn_risk_band") == "high").cast("double")), 6).alias("high_churn_risk_rate"),
                F.round(F.avg(F.col("health_score").cast("double")), 6).alias("avg_customer_health_score"))
        fresh = export_freshness.agg(F.count_if(F.col("status") == "fresh").cast("double").alias("fresh_activation_export_count"))
        bad = sync_health.agg(F.count_if(F.col("status") != "healthy").cast("double").alias("unhealthy_sync_destination_count"))
        one = a.crossJoin(F.broadcast(rejected_rate)).crossJoin(F.broadcast(fresh)).crossJoin(F.broadcast(bad))
        return one.unpivot([], one.columns, "metric_name", "metric_value")


# -- exports -----------------------------------------------------------------------------------------------------------


def segment(revenue: Column, orders: Column, plan: Column) -> Column:
    return F.when(revenue >= 250, "high_value").when(F.coalesce(orders, F.lit(0)) == 0, "activation_needed").when(plan == "enterprise",
        "enterprise_growth").otherwise("self_serve_core")


def support_priority(band: Column, open_cases: Column, cases: Column, health: Column) -> Column:
    return F.when((band == "high") & (open_cases > 0), "p1").when((cases > 0) & (health < 60), "p2").otherwise("standard")


def campaign(band: Column, seg: Column) -> Column:
    return F.when(band == "high", "save_offer").when(seg == "activation_needed", "onboarding").when(seg == "high_value", "expansion").otherwise("education")


EXPORTS = {
    "customer_segment": ["customer_segment"],
    "churn_risk": ["churn_risk_score", "churn_risk_band"],
    "lifecycle_stage": ["lifecycle_stage"],
    "customer_health_score": ["health_score"],
    "support_priority": ["support_priority", "churn_risk_band"],
    "campaign_target": ["campaign_target", "customer_segment", "churn_risk_band"],
}


def activation_rows(view: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Eligible customers with every exported attribute; the six exports are projections of this one join."""
    from ..functions.columns import hash_email, hash_phone

    ok = eligibility.where("activation_eligible").select(*KEYS)
    seg = segment(F.col("revenue"), F.col("order_count"), F.col("plan_name"))
    rows = view.join(ok, KEYS, "left_semi").withColumns({"hashed_email": hash_email(F.col("email")), "hashed_phone": hash_phone(F.col("phone")),
        "customer_segment": seg})
    return rows.withColumns(
        {"support_priority": support_priority(F.col("churn_risk_band"), F.col("open_cases"), F.col("support_cases"), F.col("health_score")),
            "campaign_target": campaign(F.col("churn_risk_band"), F.col("customer_segment"))}
    )


def export(rows: DataFrame, name: str, at: Column | None = None) -> DataFrame:
    """The rows of an export, with ``export_timestamp`` where ``at`` gives it."""
    when = [] if at is None else [at.alias("export_timestamp")]
    return rows.where(F.col("churn_risk_score").isNotNull()).select(*KEYS, "hashed_email", "hashed_phone", *when, *EXPORTS[name])


def privacy_violations(exported: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Exported customers that may not be: the gate before a sync is that there are none."""
    return exported.select(*KEYS).distinct().join(eligibility.where("activation_eligible").select(*KEYS), KEYS, "left_anti")


def export_freshness(exports: dict[str, DataFrame], exported_at: Column, now: Column) -> DataFrame:
    """Per export rows, lag and status: missing without rows, stale over 180 minutes."""
    from functools import reduce

    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("export_name"), "rows",
        F.when(F.col("rows") > 0, exported_at).alias("at")) for n, df in exports.items()]
    lag = minutes_between(F.col("at"), now)
    return reduce(DataFrame.unionByName, parts).select("export_name", "rows", F.floor(lag).cast("bigint").alias("lag_minutes"),
        F.when(F.col("at").isNull(), "missing").when(lag > 180, "stale").otherwise("fresh").alias("status"))


# -- event-counting variant of the activation rules --------------------------------------------------------------------


def event_features(d: Domain) -> DataFrame:
    """Per customer the features that count every event: one pass per source, sets kept as sorted text."""
    o = d.orders().groupBy("custkey").agg(F.count_if(F.col("order_status") == "paid").alias("paid_orders"),
        F.count_if(F.col("order_status") == "refunded").alias("refunded_orders"),
            F.sum(F.when(F.col("order_status") == "paid", F.col("gross_amount"))).cast("double").alias("paid_total"))
    e = d.engagement().groupBy("custkey").agg(F.sum("event_count").alias("event_count"))
    s = d.support().groupBy("custkey").agg(F.count_if(F.col("status") == "open").alias("open_cases"),
        F.count_if(F.col("csat_score") <= 2).alias("low_csat_cases"))
    sub = d.subscription_events().groupBy("custkey").agg(F.sort_array(F.collect_set("subscription_status")).alias("statuses"),
        F.sort_array(F.collect_set("plan_name")).alias("plans"))
    c = d.consent().groupBy("custkey").agg(F.bool_or(F.col("unsubscribe_status") == "unsubscribed").alias("unsubscribed"))
    m = d.customers().select(*KEYS, "custkey", "customer_status")
    for part in (o, e, s, sub, c):
        m = m.join(part, "custkey", "left")
    return m


def event_activation(features: DataFrame) -> DataFrame:
    """The event-counting rules: truncated revenue points, churn raised by past due, canceled and unsubscribed, the last
    matching segment and priority stand."""
    n = lambda x: F.coalesce(x, F.lit(0))
    has = lambda s: F.coalesce(F.array_contains("statuses", s), F.lit(False))
    revenue = F.coalesce(F.col("paid_total"), F.lit(0.0)) / REVENUE_UNIT
    points = 55 + F.least(n("event_count"), F.lit(30)) + F.least((revenue / 50).cast("int"),
        F.lit(20)) - 15 * n("open_cases") - 20 * n("low_csat_cases") - 10 * n("refunded_orders")
    health = clamp(points, 0, 100).cast("int")
    churn = clamp(100 - F.col("health_score") + F.when(has("past_due"), 20).otherwise(0) + F.when(has("canceled"),
        40).otherwise(0) + F.when(F.coalesce("unsubscribed", F.lit(False)), 10).otherwise(0), 0, 100).cast("int")
    stage = F.when(has("canceled"), "churned").when(has("past_due"), "at_risk").when(has("active"),
        "active_customer").when(has("trialing") | (F.col("customer_status") == "lead"), "trial_or_lead").otherwise("unknown")
    plan = F.coalesce(F.array_contains("plans", "enterprise"), F.lit(False))
    seg = F.when(n("paid_orders") == 0, "activation_needed").when(revenue >= 250, "high_value").when(plan, "enterprise_growth").otherwise("self_serve_core")
    rows = features.withColumn("health_score", health).withColumn("churn_risk_score", churn).withColumn("churn_risk_band",
        health_band(F.col("churn_risk_score")))
    prio = F.when(n("low_csat_cases") > 0, "p2").when((F.col("churn_risk_band") == "high") & (n("open_cases") > 0), "p1").otherwise("standard")
    return rows.select(*KEYS, "health_score", "churn_risk_score", "churn_risk_band", stage.alias("lifecycle_stage"), seg.alias("customer_segment"),
        prio.alias("support_priority"))
