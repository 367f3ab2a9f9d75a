"""Queries of staging, contracts, wire messages, golden records, decisions, lookups and analysts' SQL, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cdc, history, identity, merge, quality, replay
from ..runtime import settle
from ..sources.bridge import Domain
from . import access, analyst, staging
from . import marts as M
from .registry import _LIFE, AT, KEYS, _resolved, classified, landed, query, records, rows_of, us

# -- staging: each table's events with their payloads as JSON text, some blank, some of the wrong type ------------------------------


def _sent(rows: DataFrame, table: str, key: Column, gone: Column, **fields: Column) -> DataFrame:
    payload = F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    op = F.when(gone, "delete").otherwise("update")
    return rows.select(
        F.concat(F.lit(f"{table}_"), key).alias("event_id"), F.lit("s").alias("source_system"), F.lit(table).alias("source_table"),
            op.alias("operation_type"), key.cast("string").alias("record_primary_key"),
        F.when(gone, payload).alias("payload_before"), F.when(~gone, payload).alias("payload_after"),
    )


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


_ENV = "'{0}_' || {1} AS event_id, 's' AS source_system, CASE WHEN {2} THEN 'delete' ELSE 'update' END AS operation_type, CAST({1} AS VARCHAR) AS {3}, {2} AS is_delete"


@query(f"""SELECT {_ENV.format("customers", "custkey", "custkey % 17 = 0", "source_customer_id")}, customer_id, CASE WHEN custkey % 9 <> 0 THEN
    lower(email) END AS email, CASE WHEN custkey % 8 <> 0 THEN phone END AS phone, CAST(NULL AS VARCHAR) AS external_account_id,
    CASE WHEN custkey % 6 = 0 THEN '' ELSE 'Ann' END AS first_name, tenant_id, customer_status, CASE WHEN custkey % 5 = 1 THEN NULL ELSE
    epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(custkey % 40 AS INT))) END AS source_updated_us FROM customers""")
def staging_customers(d):
    c, key = d.customers(), F.col("custkey")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((key % 40).cast("int"))
    e = _sent(
        c, "customers", key, key % 17 == 0, customer_id=F.col("customer_id"), email=F.when(key % 9 == 0, " ").otherwise(F.upper("email")),
            phone=F.when(key % 8 == 0, "").otherwise(F.col("phone")), first_name=F.when(key % 6 == 0, "").otherwise("Ann"),
        tenant_id=F.col("tenant_id"), customer_status=F.col("customer_status"), updated_at=F.when(key % 5 == 1, "soon").otherwise(_iso(at)),
    )
    s = staging.staged(e, "customers")
    return s.select("event_id", "source_system", "operation_type", "source_customer_id", "is_delete", "customer_id", "email", "phone",
        "external_account_id", "first_name", "tenant_id", "customer_status", us("source_updated_at").alias("source_updated_us"))


@query(f"""SELECT {_ENV.format("subscriptions", "event_id", "is_delete", "source_subscription_id")}, subscription_id, plan_name, subscription_status,
    CASE WHEN event_id % 7 >= 2 THEN CAST(mrr AS DOUBLE) END AS mrr, epoch_us(event_timestamp) AS start_us, CAST(NULL AS BIGINT) AS cancel_us FROM
    subs""")
def staging_subscriptions(d):
    key = F.col("event_id")
    mrr = F.when(key % 7 == 0, "").when(key % 7 == 1, "n/a").otherwise(F.col("mrr").cast("string"))
    e = _sent(d.subscription_events(), "subscriptions", key, F.col("is_delete"), subscription_id=F.col("subscription_id"),
        plan_name=F.col("plan_name"), subscription_status=F.col("subscription_status"), mrr=mrr, start_date=F.col("event_timestamp"), cancel_at=F.lit(""))
    s = staging.staged(e, "subscriptions")
    return s.select("event_id", "source_system", "operation_type", "source_subscription_id", "is_delete", "subscription_id", "plan_name",
        "subscription_status", F.col("mrr").cast("double").alias("mrr"), us("start_date").alias("start_us"), us("cancel_at").alias("cancel_us"))


@query(f"""SELECT {_ENV.format("orders", "seq", "seq % 31 = 0", "source_order_id")}, order_id, order_status, CASE WHEN seq % 11 <> 0 THEN
    CAST(gross_amount AS DOUBLE) END AS gross_amount, CASE WHEN seq % 2 = 0 THEN 'ref_' || custkey END AS order_customer_ref, epoch_us(CAST(ordered_at
    AS TIMESTAMP)) AS ordered_us FROM ord""")
def staging_orders(d):
    key = F.col("seq")
    e = _sent(d.orders(), "orders", key, key % 31 == 0, order_id=F.col("order_id"), order_status=F.col("order_status"),
        gross_amount=F.when(key % 11 == 0, "-").otherwise(F.col("gross_amount").cast("string")),
            order_customer_ref=F.when(key % 2 == 0, F.concat(F.lit("ref_"), "custkey")), ordered_at=F.col("ordered_at"))
    s = staging.staged(e, "orders")
    return s.select("event_id", "source_system", "operation_type", "source_order_id", "is_delete", "order_id", "order_status",
        F.col("gross_amount").cast("double").alias("gross_amount"), "order_customer_ref", us("ordered_at").alias("ordered_us"))


@query(f"""SELECT {_ENV.format("engagement_events", "event_id", "false", "source_engagement_event_id")}, event_type AS event_name, event_count, CASE
    WHEN event_id % 5 <> 0 THEN session_minutes END AS session_minutes, epoch_us(activity_at) AS activity_us FROM engagement""")
def staging_engagement(d):
    key = F.col("event_id")
    e = _sent(d.engagement(), "engagement_events", key, F.lit(False), event_name=F.col("event_type"), event_count=F.col("event_count"),
        session_minutes=F.when(key % 5 == 0, "1e").otherwise(F.col("session_minutes").cast("string")), event_timestamp=F.col("activity_at"))
    s = staging.staged(e, "engagement_events")
    return s.select("event_id", "source_system", "operation_type", "source_engagement_event_id", "is_delete", "event_name", "event_count",
        "session_minutes", us("activity_at").alias("activity_us"))


@query(f"""SELECT {_ENV.format("support_interactions", "event_id", "event_id % 23 = 0", "source_support_interaction_id")}, status, priority,
    csat_score, epoch_us(created_at) AS created_us FROM support""")
def staging_support(d):
    key = F.col("event_id")
    e = _sent(d.support(), "support_interactions", key, key % 23 == 0, status=F.col("status"), priority=F.col("priority"),
        csat_score=F.coalesce(F.col("csat_score").cast("string"), F.lit("")), created_at=F.col("created_at"))
    s = staging.staged(e, "support_interactions")
    return s.select("event_id", "source_system", "operation_type", "source_support_interaction_id", "is_delete", "status", "priority", "csat_score",
        us("created_at").alias("created_us"))


@query(f"""SELECT {_ENV.format("marketing_engagement", "event_id", "is_delete", "source_marketing_touch_id")}, marketing_consent_status, email_opt_in,
    CASE WHEN event_id % 4 = 0 THEN false ELSE sms_opt_in END AS sms_opt_in, false AS push_opt_in, do_not_contact AS do_not_contact_flag,
    unsubscribe_status, epoch_us(event_timestamp) AS occurred_us FROM consent""")
def staging_marketing(d):
    key = F.col("event_id")
    e = _sent(
        d.consent(), "marketing_engagement", key, F.col("is_delete"), marketing_consent_status=F.col("marketing_consent_status"),
            email_opt_in=F.col("email_opt_in"), sms_opt_in=F.when(key % 4 == 0, "perhaps").otherwise(F.col("sms_opt_in").cast("string")),
        push_opt_in=F.lit(""), do_not_contact_flag=F.col("do_not_contact"), unsubscribe_status=F.col("unsubscribe_status"),
            occurred_at=F.col("event_timestamp"),
    )
    s = staging.staged(e, "marketing_engagement")
    return s.select("event_id", "source_system", "operation_type", "source_marketing_touch_id", "is_delete", "marketing_consent_status",
        "email_opt_in", "sms_opt_in", "push_opt_in", "do_not_contact_flag", "unsubscribe_status", us("occurred_at").alias("occurred_us"))


# -- contracts and wire messages -----------------------------------------------------------------------------------------


CONTRACTS = {"events": {"required": ["k", "kind"], "types": {"k": "integer", "kind": "string", "value": "number", "flag": "boolean"},
    "nullable": ["value"], "enums": {"kind": ["view", "click", "purchase", "error"]}}}


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing:k' WHEN event_id % 13 = 0 THEN 'type:k' WHEN event_id % 17 = 0 THEN 'null:flag'
    WHEN event_id % 19 = 0 THEN 'type:flag' WHEN event_id % 23 = 0 THEN 'not_json' WHEN event_type = 'signup' THEN 'enum:kind' END AS problem FROM ev""")
def contract_payloads(d):
    """Payloads against a contract: fields that are missing, null or of another type, values outside an enumeration, no JSON."""
    key = F.col("event_id")
    n = F.when(key % 11 == 0, "").when(key % 13 == 0, '"k": "7", ').otherwise('"k": 7, ')
    flag = F.when(key % 17 == 0, "null").when(key % 19 == 0, "1").otherwise("true")
    clean = (key % 11 != 0) & (key % 13 != 0) & (key % 17 != 0) & (key % 19 != 0)
    body = F.concat(F.lit("{"), n, F.lit('"value": null, "flag": '), flag, F.lit(', "kind": "'), "event_type", F.lit('"}'))
    payload = F.when(clean & (key % 23 == 0), "{oops").otherwise(body)
    return d.events().select("event_id", cdc.payload_problem(F.lit("events"), payload, CONTRACTS).alias("problem"))


_OLD = {"a": {"required": ["x", "y"], "types": {"x": "string", "y": "integer", "z": "string"}, "enums": {"z": ["p", "q"]}},
    "b": {"types": {"x": "string"}}, "c": {"types": {"x": "string"}}}
_NEW = {"a": {"required": ["x", "w"], "types": {"x": "integer", "y": "integer", "w": "string", "v": "string"}, "enums": {"z": ["q", "r"]}},
    "b": {"types": {"x": "string"}, "nullable": ["x"]}, "d": {"types": {"x": "string"}}}


@query("""SELECT * FROM (VALUES ('a', 'required', 'y', '', 'removed', 'breaking'), ('a', 'required', 'w', '', 'added', 'breaking'), ('a', 'type', 'x',
    'integer', 'changed', 'breaking'), ('a', 'type', 'z', 'string', 'removed', 'review'), ('a', 'type', 'w', 'string', 'added', 'breaking'),
    ('a', 'type', 'v', 'string', 'added', 'compatible'), ('a', 'enum', 'z', 'p', 'removed', 'breaking'), ('a', 'enum', 'z', 'r', 'added', 'review'),
    ('b', 'nullable', 'x', '', 'added', 'compatible'), ('c', 'table', '', '', 'removed', 'breaking'), ('d', 'table', '', '', 'added', 'compatible'))
    t(source_table, kind, field, value, change, verdict)""")
def contract_changes(d):
    """Two versions of a contract file: a change of each class, with the verdict that its class has."""
    return cdc.contract_diff(cdc.contract_rows(d.spark, _OLD), cdc.contract_rows(d.spark, _NEW))


@query("""SELECT 'dbz_' || substr(sha256(concat_ws('|', 'postgresql', 'db', 'public', tab, CAST(event_id AS VARCHAR), op, CAST(event_id AS VARCHAR),
    CAST(event_id % 50 AS VARCHAR), CAST(epoch_us(ts) // 1000 AS VARCHAR))), 1, 24) AS event_id, CASE WHEN event_id % 9 = 0 THEN 'tenant_unknown' ELSE
    'tenant_' || (event_id % 4) END AS tenant_id,
    CASE tab WHEN 'orders' THEN 'commerce_platform' ELSE 'unknown' END AS source_system, tab AS source_table, CASE op WHEN 'u' THEN 'update' WHEN 'd'
    THEN 'delete' ELSE 'insert' END AS operation_type, CAST(event_id AS VARCHAR) AS record_primary_key, event_id AS event_sequence_number,
    CAST(event_id % 50 AS VARCHAR) AS source_transaction_id, op = 'd' AS only_before FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'orders' ELSE
    'carts' END AS tab, CASE event_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'r' WHEN 2 THEN 'u' ELSE 'd' END AS op FROM ev)""")
def wire_messages(d):
    """Messages of a log-based source as envelopes, wrapped or not, of a table that the mapping knows and one it doesn't."""
    key = F.col("event_id")
    tab, op = F.when(key % 3 == 0, "orders").otherwise("carts"), F.element_at(F.array(*[F.lit(x) for x in "crud"]), (key % 4 + 1).cast("int"))
    image = F.to_json(F.struct(F.when(tab == "orders", key).alias("order_key"), F.when(tab != "orders", key).alias("id"),
        F.when(key % 9 != 0, F.concat(F.lit("tenant_"), key % 4)).alias("tenant_id")))
    ms = F.floor(C.micros(F.col("ts")) / 1000).cast("bigint")
    source = F.struct(F.lit("postgresql").alias("connector"), F.lit("db").alias("db"), F.lit("public").alias("schema"), tab.alias("table"),
        key.alias("lsn"), (key % 50).alias("txId"), ms.alias("ts_ms"))
    gone = op == "d"
    bare = F.concat(F.lit('{"op":"'), op, F.lit('","source":'), F.to_json(source), F.lit(',"before":'), F.when(gone, image).otherwise("null"),
        F.lit(',"after":'), F.when(gone, "null").otherwise(image), F.lit("}"))
    value = F.when(key % 2 == 0, F.concat(F.lit('{"payload":'), bare, F.lit("}"))).otherwise(bare)
    m = d.events().select(value.alias("value"), F.concat(F.lit("db.public."), tab).alias("topic"))
    e = cdc.from_debezium(m, {"orders": "commerce_platform"}, {"orders": "order_key"})
    return e.select("event_id", "tenant_id", "source_system", "source_table", "operation_type", "record_primary_key", "event_sequence_number",
        "source_transaction_id", (F.col("payload_before").isNotNull() & F.col("payload_after").isNull()).alias("only_before"))


@query("""SELECT count(*) FILTER (WHERE event_timestamp >= TIMESTAMP '2024-01-05' AND batch_id = 'b1') AS selected_count, 'b1' AS batch_ids, '' AS
    source_tables, false AS reset_checkpoints, 'dry_run' AS status FROM ok""")
def replay_dry_run(d):
    manifest, _, _ = replay.run_replay(landed(d), "replay_1", F.lit("2024-02-01").cast("timestamp_ntz"),
        start=F.lit("2024-01-05").cast("timestamp_ntz"), batches=["b1"], dry_run=True)
    return manifest.select("selected_count", "batch_ids", "source_tables", "reset_checkpoints", "status")


@query("""SELECT custkey, k FROM (SELECT custkey, k, row_number() OVER (PARTITION BY custkey ORDER BY event_id DESC) AS rn, k = 99 AS gone FROM ev)
    WHERE rn = 1 AND NOT gone""")
def applied_changes(d):
    """A source table after its change events: the newest image of each key, deleted ones gone."""
    e = d.events().select("custkey", "k", "event_id", F.when(F.col("k") == 99, "delete").otherwise("update").alias("operation_type"))
    empty = e.limit(0).select("custkey", "k")
    return merge.apply_changes(empty, e, ["custkey"], "event_id")


@query("""SELECT 'run_1' AS run_id, tenant_id, 'raw_cdc_' || source_table AS stage_name, count(*) AS row_count, 'success' AS status, 'landed ' ||
    count(*) || ' change events for ' || source_table AS details FROM ok GROUP BY tenant_id, source_table
    UNION ALL SELECT 'run_1', 'all', 'quality_checks', count(*), CASE WHEN count(*) = 0 THEN 'success' ELSE 'warning' END, 'validation_failures=' ||
    count(*) FROM (SELECT batch_id FROM cl WHERE reject_category IS NOT NULL GROUP BY batch_id)""")
def pipeline_run_log(d):
    """What has landed, and how many batches had rejects."""
    bad = classified(d).groupBy(F.col("batch_id").alias("check")).agg(F.count_if(F.col("reject_category").isNotNull()).alias("failures"))
    return quality.run_log(landed(d), bad, "run_1", F.lit("2024-02-01").cast("timestamp_ntz")).drop("ended_at")


@query("""SELECT source, lag AS lag_minutes, CASE WHEN lag IS NULL OR lag > 360 THEN 'error' WHEN lag > 120 THEN 'warn' ELSE 'pass' END AS status FROM
    (SELECT 'events' AS source, (SELECT CAST(floor((epoch_us(max(ts) + INTERVAL 60 MINUTE) - epoch_us(max(ts))) / 60000000) AS BIGINT) FROM ev) AS lag
    UNION ALL SELECT 'signups', (SELECT CAST(floor((epoch_us((SELECT max(ts) FROM ev) + INTERVAL 60 MINUTE) - epoch_us(max(ts))) / 60000000) AS BIGINT)
    FROM ev WHERE event_type = 'signup' AND ts < (SELECT max(ts) FROM ev) - INTERVAL 90 MINUTE) UNION ALL SELECT 'none', NULL)""")
def source_freshness(d):
    """Sources that are fresh, late, and empty, an hour after the last event."""
    e = settle(d.events(), "events")
    last = e.agg(F.max("ts")).first()[0]
    now = F.lit(last).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(1))
    old = e.where((F.col("event_type") == "signup") & (F.col("ts") < F.lit(last).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(90))))
    return quality.source_freshness({"events": (e, F.col("ts")), "signups": (old, F.col("ts")), "none": (e.limit(0), F.col("ts"))}, now)


# -- snapshots, golden records, decisions --------------------------------------------------------------------------------


@query("""SELECT custkey, bal, from_us, to_us FROM (SELECT custkey, balance AS bal, epoch_us(TIMESTAMP '2024-01-01') AS from_us, CASE WHEN custkey % 10
    = 3 THEN epoch_us(TIMESTAMP '2024-01-10') WHEN custkey % 10 = 4 THEN epoch_us(TIMESTAMP '2024-01-05') END AS to_us FROM customers WHERE custkey %
    10 <> 5
    UNION ALL SELECT custkey, balance + 1, epoch_us(TIMESTAMP '2024-01-05'), NULL FROM customers WHERE custkey % 10 = 4 UNION ALL SELECT custkey,
    balance, epoch_us(TIMESTAMP '2024-01-01'), NULL FROM customers WHERE custkey % 10 = 5)""")
def snapshot_versions(d):
    """A second snapshot: some rows changed, some gone, some new, the rest as they were."""
    c, key = d.customers(), F.col("custkey")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    first = c.where(key % 10 != 5).select("custkey", F.col("balance").alias("bal"), day("2024-01-01").alias("at"))
    previous = first.withColumns({"snap_from": F.col("at"), "snap_to": F.lit(None).cast("timestamp_ntz")})
    now = c.where(key % 10 != 3).select("custkey", (F.col("balance") + (key % 10 == 4).cast("int")).alias("bal"),
        F.when(key % 10 == 4, day("2024-01-05")).otherwise(day("2024-01-01")).alias("at"))
    return history.snapshot(previous, now, ["custkey"], "at", day("2024-01-10")).select("custkey", "bal", us("snap_from").alias("from_us"),
        us("snap_to").alias("to_us"))


@query("""SELECT tenant_id, 'c' || custkey AS customer_id, 'email' AS field, CASE WHEN custkey % 50 = 0 THEN 'over' || custkey WHEN custkey % 4 = 0
    THEN 'billing' || custkey WHEN custkey % 4 = 1 THEN 'app' || custkey ELSE 'late' || custkey END AS value, custkey % 50 = 0 AS overridden,
    CASE WHEN custkey % 100 = 0 THEN 'first' || custkey WHEN custkey % 50 = 0 THEN CASE WHEN custkey % 4 = 0 THEN 'billing' || custkey WHEN custkey % 4
    = 1 THEN 'app' || custkey ELSE 'late' || custkey END END AS previous FROM customers""")
def golden_records(d):
    """Observations that compete by trust, by verification and by time, a blank one of the most trusted source, and overrides."""
    c, key = d.customers(), F.col("custkey")
    who = ["tenant_id", F.concat(F.lit("c"), "custkey").alias("customer_id"), F.lit("email").alias("field")]
    day = lambda x: F.lit(x).cast("timestamp_ntz")

    def seen(rows, prefix, system, verified, at, record):
        return rows.select(*who, F.concat(F.lit(prefix), "custkey").alias("value"), F.lit(system).alias("source_system"),
            F.lit(verified).alias("verified"), day(at).alias("observed_at"), F.lit(record).alias("record_id"))

    obs = seen(c.where(key % 4 == 0), "billing", "billing_platform", False, "2024-01-01",
        "1").unionByName(seen(c.where(key % 4 == 0), "shop", "commerce_platform", True, "2024-02-01", "2"))
    blank = c.where(key % 4 == 0).select(*who, F.lit(" ").alias("value"), F.lit("account_app").alias("source_system"), F.lit(True).alias("verified"),
        day("2024-03-01").alias("observed_at"), F.lit("3").alias("record_id"))
    obs = obs.unionByName(blank).unionByName(seen(c.where(key % 4 == 1), "app", "account_app", True, "2024-01-01",
        "1")).unionByName(seen(c.where(key % 4 == 1), "new", "account_app", False, "2024-02-01", "2"))
    obs = obs.unionByName(seen(c.where(key % 4 >= 2), "early", "support_desk", True, "2024-01-01", "2")).unionByName(seen(c.where(key % 4 >= 2),
        "late", "support_desk", True, "2024-01-02", "1"))
    over = lambda rows, prefix, at: rows.select(*who, F.concat(F.lit(prefix), "custkey").alias("value"), day(at).alias("decided_at"))
    overrides = over(c.where(key % 100 == 0), "first", "2024-01-01").unionByName(over(c.where(key % 50 == 0), "over", "2024-01-02"))
    return identity.golden(obs, overrides).select("tenant_id", "customer_id", "field", "value", "overridden", "previous")


@query("""SELECT event_id AS case_id, CASE WHEN error IS NOT NULL THEN old ELSE coalesce(nxt, old) END AS status, error FROM (SELECT *, CASE WHEN
    decision IS NULL OR nxt = old THEN NULL WHEN nxt IS NULL THEN 'unknown_decision' WHEN NOT (old || '>' || nxt IN ('OPEN>IN_REVIEW',
    'OPEN>REJECTED', 'OPEN>RESOLVED', 'IN_REVIEW>APPROVED', 'IN_REVIEW>REJECTED', 'APPROVED>RESOLVED', 'REJECTED>RESOLVED')) THEN 'illegal_transition'
    END AS error FROM (
    SELECT *, CASE decision WHEN 'APPROVE_MERGE' THEN 'APPROVED' WHEN 'REJECT_MERGE' THEN 'REJECTED' WHEN 'NEEDS_REVIEW' THEN 'IN_REVIEW' WHEN
    'APPROVE_UNMERGE' THEN 'APPROVED' WHEN 'IGNORE_FALSE_POSITIVE' THEN 'RESOLVED' END AS nxt FROM (
    SELECT event_id, ['OPEN', 'IN_REVIEW', 'APPROVED', 'REJECTED', 'RESOLVED'][k % 5 + 1] AS old, ['APPROVE_MERGE', 'REJECT_MERGE', 'NEEDS_REVIEW',
    'APPROVE_UNMERGE', 'IGNORE_FALSE_POSITIVE', 'WHATEVER', NULL][k // 5 % 7 + 1] AS decision FROM ev)))""")
def review_decisions(d):
    """Every status against every decision, a decision that there isn't, and none."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    k = F.col("k")
    statuses, decisions = ["OPEN", "IN_REVIEW", "APPROVED", "REJECTED", "RESOLVED"], ["APPROVE_MERGE", "REJECT_MERGE", "NEEDS_REVIEW",
        "APPROVE_UNMERGE", "IGNORE_FALSE_POSITIVE", "WHATEVER", None]
    e = d.events()
    cases = e.select(F.col("event_id").alias("case_id"), pick(statuses, k % 5 + 1).alias("status"))
    made = e.select(F.col("event_id").alias("case_id"), pick(decisions, F.floor(k / 5) % 7 + 1).alias("decision"))
    return identity.decide(cases, made.where("decision is not null")).select("case_id", "status", "error")


@query("""SELECT tenant_id, record_id, CASE WHEN custkey % 10 = 1 THEN 'cc_' || (custkey + 1) ELSE 'cc_' || custkey END AS canonical_customer_id FROM
    (SELECT r.*, EXISTS (SELECT 1 FROM customers c WHERE c.custkey = r.custkey + 1 AND c.tenant_id = r.tenant_id) AS there FROM rec r) WHERE custkey %
    10 <> 1 OR there
    UNION ALL SELECT tenant_id, record_id, 'cc_' || custkey FROM (SELECT r.*, EXISTS (SELECT 1 FROM customers c WHERE c.custkey = r.custkey + 1 AND
    c.tenant_id = r.tenant_id) AS there FROM rec r) WHERE custkey % 10 = 1 AND NOT there""")
def merged_map(d):
    """Customers merged into the next one; where that belongs to another tenant the merge is refused."""
    m = records(d).select("tenant_id", "record_id", F.concat(F.lit("cc_"), "custkey").alias("canonical_customer_id"))
    return identity.merge_customers(m, _merges(d))


def _merges(d: Domain) -> DataFrame:
    key = F.col("custkey")
    return d.customers().where(key % 10 == 1).select("tenant_id", F.concat(F.lit("cc_"), key).alias("from_id"), F.concat(F.lit("cc_"), key + 1).alias("to_id"))


@query("""SELECT c.tenant_id, 'cc_' || c.custkey AS from_id, 'cc_' || (c.custkey + 1) AS to_id, CASE WHEN n.tenant_id IS NULL THEN
    'refused_unknown_customer' WHEN n.tenant_id = c.tenant_id THEN 'merged' ELSE 'refused_cross_tenant' END AS outcome FROM customers c LEFT JOIN
    customers n ON n.custkey = c.custkey + 1 WHERE c.custkey % 10 = 1""")
def merge_audits(d):
    m = records(d).select("tenant_id", "record_id", F.concat(F.lit("cc_"), "custkey").alias("canonical_customer_id"))
    return identity.merge_audit(m, _merges(d), "ann", "same person", F.lit("2024-02-01").cast("timestamp_ntz")).select("tenant_id", "from_id", "to_id",
        "outcome")


@query("""SELECT count(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0) AS tp, count(*) FILTER (WHERE k % 3 = 0 AND k % 2 <> 0) AS fp, count(*) FILTER (WHERE
    k % 3 <> 0 AND k % 2 = 0) AS fn, count(*) FILTER (WHERE k % 3 <> 0 AND k % 2 <> 0) AS tn,
    count(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0) / count(*) FILTER (WHERE k % 3 = 0) AS precision, count(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0) /
    count(*) FILTER (WHERE k % 2 = 0) AS recall FROM ev""")
def match_evaluation(d):
    return identity.confusion(d.events(), F.col("k") % 3 == 0, F.col("k") % 2 == 0)


# -- lookups and analysts' SQL -------------------------------------------------------------------------------------------


def _map(d: Domain) -> DataFrame:
    r, _, x = _resolved(d)
    return x.join(r.select("tenant_id", "record_id", "source_system"), ["tenant_id", "record_id"])


@query("""SELECT rmap.tenant_id, canonical_customer_id, source_system, rmap.record_id, match_rule, match_confidence FROM rmap JOIN rec USING (tenant_id, record_id)""")
def analyst_identity_lineage(d):
    return analyst.run(d.spark, "identity_lineage", {"identity_map": _map(d)})


@query("""SELECT source_table, count(*) AS records, count(*) FILTER (WHERE reject_category IS NOT NULL) AS rejected, round(count(*) FILTER (WHERE
    reject_category IS NOT NULL) / count(*), 6) AS rejected_rate, 'critical' AS health FROM cl GROUP BY ALL""")
def analyst_pipeline_health(d):
    c = classified(d)
    fresh = quality.freshness(c, ["source_table"], F.col("event_timestamp"), F.lit("2025-02-01").cast("timestamp_ntz"), 1440)
    return analyst.run(d.spark, "pipeline_health", {"pipeline_health": M.Marts(d).pipeline_health(cdc.ingestion_summary(c), fresh)})


@query("""SELECT tenant_id, canonical_customer_id, left(split_part(email, '@', 1), 1) || '***@' || split_part(email, '@', 2) AS masked_email,
    left(phone, 3) || '***' || right(phone, 4) AS masked_phone, lifecycle_stage, churn_risk_band FROM c3""")
def analyst_masked_mart(d):
    return analyst.run(d.spark, "masked_mart", {"customer_360_masked": M.Marts(d).customer_360_masked()})


@query("""SELECT 'duplicate_canonical_email' AS check, 'pass' AS status, CAST(0 AS BIGINT) AS failures UNION ALL SELECT 'broken_mapping', CASE WHEN
    count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM customers WHERE custkey % 29 = 0 UNION ALL SELECT 'missing_source_key', CASE WHEN count(*)
    = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM env WHERE record_primary_key IS NULL
    UNION ALL SELECT 'table_without_inserts', 'fail', CAST(1 AS BIGINT) UNION ALL SELECT 'invalid_subscription_state', CASE WHEN count(*) = 0 THEN
    'pass' ELSE 'fail' END, count(*) FROM env WHERE source_table = 'subscriptions' AND k % 2 = 1 AND has_after
    UNION ALL SELECT 'missing_refresh_time', 'pass', CAST(0 AS BIGINT) UNION ALL SELECT 'suppressed_exported', CASE WHEN count(*) = 0 THEN 'pass' ELSE
    'fail' END, count(*) FROM el WHERE NOT activation_eligible AND TRY_CAST(substr(canonical_customer_id, 4) AS BIGINT) % 97 = 5""")
def analyst_quality_summary(d):
    """The seven checks over inputs with faults: mappings of customers that aren't there, a table that nothing was inserted into, odd
    subscription states, suppressed customers exported."""
    e = d.envelopes().withColumn("payload_after", F.when(F.col("payload_after").isNotNull(),
        F.to_json(F.struct(F.when(F.col("k") % 2 == 1, "frozen").otherwise("active").alias("subscription_status")))))
    c, el = d.customers(), settle(M.Marts(d).eligibility(), "eligibility")
    bad = c.where("custkey % 29 = 0").select("tenant_id", F.concat(F.lit("cc_gone_"), "custkey").alias("canonical_customer_id"))
    suppressed = el.where("not activation_eligible").select(*KEYS)
    leaked = suppressed.where(F.substring("canonical_customer_id", 4, 20).try_cast("bigint") % 97 == 5)
    tables = ["engagement_events", "support_interactions", "marketing_engagement", "subscriptions", "returns"]
    checks = quality.quality_checks(e, c, c.select(*KEYS).unionByName(bad), rows_of(d).select(*KEYS).unionByName(leaked), suppressed, tables,
        ["active", "trialing", "past_due", "canceled"])
    return analyst.run(d.spark, "quality_summary", {"quality_summary": analyst.quality_summary(checks)})


WHO = access.Principal("ann", frozenset({"tenant_asia", "tenant_europe", "tenant_africa", "tenant_america", "tenant_middle_east"}), everywhere=True)
_ONE = "SELECT canonical_customer_id FROM rmap WHERE record_id = 'acct_7'"


def _one(d: Domain, m: DataFrame) -> str:
    return m.where("record_id = 'acct_7'").first().canonical_customer_id


@query(f"""SELECT rmap.canonical_customer_id, r.email, r2.source_system, rmap.record_id, match_rule, match_confidence FROM rmap JOIN rec r2 USING
    (tenant_id, record_id) JOIN (SELECT email FROM rec WHERE record_id = 'acct_7') r ON true WHERE canonical_customer_id = ({_ONE})""")
def analyst_lineage_behind(d):
    """A report on one customer, as the query is meant."""
    m = settle(_map(d), "identity-map")
    r = records(d).join(m.select("tenant_id", "record_id", "canonical_customer_id"), ["tenant_id", "record_id"])
    canonical = r.where("source_system = 'account_app'").select("tenant_id", "canonical_customer_id", "email")
    return analyst.run(d.spark, "lineage_behind", {"canonical_customers": canonical, "identity_map": m}, customer=_one(d, m))


@query(f"""SELECT event_id, source_system, operation_type, epoch_us(event_timestamp) AS event_timestamp_us FROM env WHERE source_system =
    'product_analytics' AND record_primary_key = 'rec_7' AND event_timestamp <= TIMESTAMP '{AT}'""")
def analyst_events_known_by(d):
    mapping = d.customers().where("custkey = 7").select("canonical_customer_id", F.lit("product_analytics").alias("source_system"),
        F.concat(F.lit("rec_"), "custkey").alias("record_id"))
    out = analyst.run(d.spark, "events_known_by", {"raw_events": d.envelopes(), "identity_map": mapping}, customer="cc_7", at=AT)
    return out.select("event_id", "source_system", "operation_type", us("event_timestamp"))


@query(f"""SELECT canonical_customer_id, subscription_id, plan_name, subscription_status, epoch_us(valid_from) AS valid_from_us FROM sh WHERE
    canonical_customer_id = 'cc_7' AND valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')""")
def analyst_subscription_as_of(d):
    return analyst.run(d.spark, "subscription_as_of", {"subscription_history": M.Marts(d).subscription_history()}, customer="cc_7",
        at=AT).select("canonical_customer_id", "subscription_id", "plan_name", "subscription_status", us("valid_from"))


@query("""SELECT 'source_record' AS kind, 'rec_7' AS name, CAST(NULL AS BIGINT) AS at_us UNION ALL SELECT 'cdc_event', event_id,
    epoch_us(event_timestamp) FROM env WHERE record_primary_key = 'rec_7' AND tenant_id IS NOT NULL
    UNION ALL SELECT 'activation_output', v.n, NULL FROM (VALUES ('churn_risk'), ('campaign_target')) v(n) WHERE EXISTS (SELECT 1 FROM ar WHERE
    canonical_customer_id = 'cc_7')""")
def customer_lineage(d):
    mapping = d.customers().where("custkey = 7").select("tenant_id", F.concat(F.lit("rec_"), "custkey").alias("record_id"), "canonical_customer_id")
    tenant = mapping.first().tenant_id
    rows = rows_of(d)
    out = access.customer_lineage(mapping, d.envelopes(), {n: M.export(rows, n) for n in ("churn_risk", "campaign_target")}, WHO, tenant, "cc_7")
    return out.select("kind", "name", us("at"))


@query(f"""SELECT subscription_id, {_LIFE.format('subscription_status')} AS lifecycle_stage, epoch_us(valid_from) AS valid_from_us FROM sh WHERE
    canonical_customer_id = 'cc_7'""")
def customer_history(d):
    h = M.Marts(d).subscription_history()
    rows, _ = access.history_of(h, WHO, "cc_7")
    return rows.select("subscription_id", C.lifecycle_stage(F.col("subscription_status")).alias("lifecycle_stage"), us("valid_from"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) %
    1000000 AS VARCHAR), 6, '0') END || 'Z' AS plain, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M') AS shifted, CAST(NULL AS VARCHAR) AS bad
    FROM ev""")
def iso_times(d):
    """Times with ``Z``, with an offset, and what is no time, as UTC."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return d.events().select("event_id", C.iso_to_utc(F.concat(text, F.lit("Z"))).alias("plain"),
        F.left(C.iso_to_utc(F.concat(text, F.lit("+01:30"))), F.lit(16)).alias("shifted"), C.iso_to_utc(F.concat(F.lit("x"), text)).alias("bad"))


@query("""SELECT event_id, '{"k":' || k || ',"none":null,"type":"' || event_type || '"}' AS body FROM ev""")
def json_objects(d):
    return d.events().select("event_id", C.json_text_object(("k", F.col("k")), ("none", F.lit(None).cast("string")),
        ("type", F.col("event_type"))).alias("body"))

