"""Every query by name, with the SQL that an independent engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cdc, history, identity, merge, quality
from ..runtime import settle
from ..sources.bridge import Domain, oracle
from . import activation as A
from . import analyst
from . import marts as M

KEYS = ["tenant_id", "canonical_customer_id"]
TABLES = ("customers", "subscriptions", "orders", "engagement_events", "support_interactions", "marketing_engagement")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

K = "tenant_id, canonical_customer_id"
_LIFE = "CASE {} WHEN 'canceled' THEN 'churned' WHEN 'past_due' THEN 'at_risk' WHEN 'active' THEN 'active_customer' WHEN 'trialing' THEN 'trial_or_lead' ELSE 'unknown' END"
_BAND = "CASE WHEN {0} >= 70 THEN 'high' WHEN {0} >= 40 THEN 'medium' ELSE 'low' END"
_MAIL = "CASE WHEN strpos(lower(trim({0})), '@') > 0 THEN split_part(split_part(lower(trim({0})), '@', 1), '+', 1) || substr(lower(trim({0})), strpos(lower(trim({0})), '@')) END"
_HASH = "sha256('kinfold::' || lower({}))"
EXTRA: list[tuple[str, str]] = [
    ("oh", f"SELECT ord.*, {K} FROM ord LEFT JOIN identity_map m ON ord.custkey = m.custkey"),
    ("ot", f"""SELECT {K}, count(*) AS order_count, CAST(sum(CASE WHEN order_status = 'paid' THEN gross_amount ELSE 0 END) AS DOUBLE) AS paid_total,
    count(*) FILTER (WHERE order_status = 'paid') AS paid_orders,
        count(*) FILTER (WHERE order_status = 'refunded') AS refunded_orders, max(ordered_at) AS last_order_at FROM oh GROUP BY ALL"""),
    ("ru", f"""SELECT coalesce(e.tenant_id, s.tenant_id) AS tenant_id, coalesce(e.canonical_customer_id, s.canonical_customer_id) AS
    canonical_customer_id, coalesce(ne, 0) AS engagement_events, coalesce(ec, 0) AS event_count,
        coalesce(sm, 0) AS session_minutes, coalesce(sc, 0) AS support_cases, coalesce(oc, 0) AS open_cases, coalesce(lc, 0) AS low_csat_cases,
    greatest(le, ls) AS last_activity_at
        FROM (SELECT {K}, count(*) AS ne, sum(coalesce(event_count, 0)) AS ec, sum(coalesce(session_minutes, 0)) AS sm, max(activity_at) AS le FROM
    engagement e LEFT JOIN identity_map m ON e.custkey = m.custkey GROUP BY ALL) e
        FULL JOIN (SELECT {K}, count(*) AS sc, count(*) FILTER (WHERE status = 'open') AS oc, count(*) FILTER (WHERE csat_score <= 2) AS lc,
    max(created_at) AS ls FROM support s LEFT JOIN identity_map m ON s.custkey = m.custkey GROUP BY ALL) s
        ON e.tenant_id = s.tenant_id AND e.canonical_customer_id = s.canonical_customer_id"""),
    ("sh", f"""SELECT *, event_timestamp AS valid_from, nxt AS valid_to, nxt IS NULL AND NOT is_delete AS is_current FROM (
        SELECT s.*, {K}, lead(event_timestamp) OVER (PARTITION BY tenant_id, subscription_id ORDER BY event_timestamp, event_id) AS nxt FROM subs s
    LEFT JOIN identity_map m ON s.custkey = m.custkey WHERE tenant_id IS NOT NULL)
        WHERE nxt IS NULL OR nxt > event_timestamp"""),
    ("cs", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY valid_from DESC, event_id DESC) AS rn FROM sh WHERE is_current) WHERE rn = 1"),
    ("hl", f"""SELECT {K}, health_score, round(revenue, 6) AS revenue, event_count, open_cases, low_csat_cases, refunded_orders, 100 - health_score AS
    churn_risk_score, {_BAND.format("(100 - health_score)")} AS churn_risk_band FROM (
        SELECT *, CAST(greatest(0, least(100, 55 + least(event_count, 30) + least(CAST(round(revenue / 50, 0) AS INT), 20) - 15 * open_cases - 20 *
    low_csat_cases - 10 * refunded_orders)) AS INT) AS health_score FROM (
        SELECT c.tenant_id, c.canonical_customer_id, coalesce(paid_total, 0) / CAST(6000 AS DOUBLE) AS revenue, CAST(coalesce(event_count, 0) AS
    BIGINT) AS event_count, coalesce(open_cases, 0) AS open_cases, coalesce(low_csat_cases, 0) AS low_csat_cases, coalesce(refunded_orders, 0) AS
    refunded_orders
        FROM customers c LEFT JOIN ot USING ({K}) LEFT JOIN ru USING ({K})))"""),
    ("c3", f"""SELECT c.tenant_id, c.canonical_customer_id, customer_id, business_unit, email, phone, customer_status, plan_name,
    coalesce(subscription_status, 'none') AS subscription_status, {_LIFE.format("subscription_status")} AS lifecycle_stage,
        coalesce(CAST(mrr AS DOUBLE), 0) AS mrr, coalesce(order_count, 0) AS order_count, round(coalesce(paid_total, 0) / CAST(6000 AS DOUBLE), 6) AS
    revenue, CAST(coalesce(ru.event_count, 0) AS BIGINT) AS event_count, coalesce(support_cases, 0) AS support_cases,
        coalesce(ru.open_cases, 0) AS open_cases, health_score, churn_risk_score, churn_risk_band, greatest(epoch_us(last_order_at),
    epoch_us(last_activity_at)) AS last_seen_us
        FROM customers c LEFT JOIN cs USING ({K}) LEFT JOIN ot USING ({K}) LEFT JOIN ru USING ({K}) LEFT JOIN hl USING ({K})"""),
    ("lc", f"SELECT * FROM (SELECT c.*, {K}, row_number() OVER (PARTITION BY {K} ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM consent c JOIN identity_map m ON c.custkey = m.custkey) WHERE rn = 1"),
    ("el", f"""SELECT *, suppression_reason IS NULL AS activation_eligible FROM (SELECT c.tenant_id, c.canonical_customer_id, lc.event_id AS
    consent_event_id, marketing_consent_status, d.del AS deletion_requested,
        coalesce(email_opt_in, false) OR coalesce(sms_opt_in, false) OR coalesce(push_opt_in, false) AS any_channel,
        CASE WHEN d.del THEN 'privacy_deletion_requested' WHEN do_not_contact THEN 'do_not_contact' WHEN is_delete THEN 'consent_source_deleted' WHEN
    unsubscribe_status = 'unsubscribed' THEN 'unsubscribed'
        WHEN marketing_consent_status IS NULL THEN 'missing_consent_state' WHEN marketing_consent_status <> 'opted_in' THEN 'marketing_consent_' ||
    marketing_consent_status
        WHEN NOT (coalesce(email_opt_in, false) OR coalesce(sms_opt_in, false) OR coalesce(push_opt_in, false)) THEN 'no_active_channel_consent' WHEN
    email IS NULL AND phone IS NULL THEN 'missing_activation_identifier' END AS suppression_reason
        FROM customers c LEFT JOIN lc USING ({K}) CROSS JOIN LATERAL (SELECT exists(SELECT 1 FROM deletion r WHERE r.canonical_customer_id =
    c.canonical_customer_id AND (r.tenant_id IS NULL OR r.tenant_id = c.tenant_id)) AS del) d)"""),
    ("ar", f"""SELECT *, CASE WHEN churn_risk_band = 'high' THEN 'save_offer' WHEN customer_segment = 'activation_needed' THEN 'onboarding' WHEN
    customer_segment = 'high_value' THEN 'expansion' ELSE 'education' END AS campaign_target FROM (
        SELECT c3.*, {_HASH.format(_MAIL.format("email"))} AS hashed_email, {_HASH.format("phone")} AS hashed_phone,
        CASE WHEN revenue >= 250 THEN 'high_value' WHEN order_count = 0 THEN 'activation_needed' WHEN plan_name = 'enterprise' THEN 'enterprise_growth'
    ELSE 'self_serve_core' END AS customer_segment,
        CASE WHEN churn_risk_band = 'high' AND open_cases > 0 THEN 'p1' WHEN support_cases > 0 AND health_score < 60 THEN 'p2' ELSE 'standard' END AS support_priority
        FROM c3 JOIN el USING ({K}) WHERE activation_eligible)"""),
    ("cl", """SELECT *, CASE WHEN operation_type NOT IN ('insert', 'update', 'delete') THEN 'UNKNOWN_OPERATION' WHEN schema_version <> 1 THEN
    'UNSUPPORTED_SCHEMA_VERSION' WHEN record_primary_key IS NULL THEN 'MISSING_SOURCE_KEY'
        WHEN coalesce(tenant_id, '') = '' THEN 'INVALID_TENANT' WHEN (operation_type = 'delete' AND NOT has_before) OR (operation_type <> 'delete' AND
    NOT has_after) THEN 'INVALID_PAYLOAD' END AS reject_category FROM env"""),
    ("ok", "SELECT * FROM cl WHERE reject_category IS NULL"),
    ("first_seen", "SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY arrival_ordinal) AS rn FROM ok"),
]


_CKEY = "TRY_CAST(substr(canonical_customer_id, 4) AS BIGINT)"


def ckey() -> F.Column:
    """The customer key in a customer id, null where it names none of the sample's; faults are planted by it."""
    return F.substring("canonical_customer_id", 4, 20).try_cast("bigint")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def us(c: str) -> F.Column:
    return C.micros(F.col(c)).alias(f"{c}_us")


def classified(d: Domain) -> DataFrame:
    return cdc.classify(d.envelopes(), TABLES)


def landed(d: Domain) -> DataFrame:
    return cdc.accepted(classified(d))


# -- marts and histories ------------------------------------------------------------------------------------------------


@query("SELECT * FROM c3")
def customer_360_current(d):
    return M.Marts(d).customer_360()


@query("""SELECT * EXCLUDE (email, phone), left(split_part(email, '@', 1), 1) || '***@' || split_part(email, '@', 2) AS email, left(phone, 3) || '***'
    || right(phone, 4) AS phone FROM c3""")
def customer_360_masked(d):
    return M.Marts(d).customer_360_masked()


@query("SELECT * FROM hl")
def customer_health(d):
    return M.Marts(d).health().drop("feature_payload")


@query(f"""SELECT {K}, engagement_events, CAST(event_count AS BIGINT) AS event_count, CAST(session_minutes AS BIGINT) AS session_minutes,
    support_cases, open_cases, low_csat_cases, epoch_us(last_activity_at) AS last_activity_at_us FROM ru""")
def activity_rollup(d):
    return M.Marts(d).activity_rollup().select(*KEYS, "engagement_events", "event_count", "session_minutes", "support_cases", "open_cases",
        "low_csat_cases", us("last_activity_at"))


@query(f"SELECT {K}, order_count, paid_orders, refunded_orders, round(paid_total, 2) AS paid_total, epoch_us(last_order_at) AS last_order_at_us FROM ot")
def order_totals(d):
    return M.Marts(d).order_totals().select(*KEYS, "order_count", "paid_orders", "refunded_orders", F.round("paid_total", 2).alias("paid_total"),
        us("last_order_at"))


@query(f"SELECT {K}, order_id, order_status, CAST(gross_amount AS DOUBLE) AS gross_amount, epoch_us(ordered_at) AS ordered_at_us FROM oh")
def order_history(d):
    return M.Marts(d).order_history().select(*KEYS, "order_id", "order_status", F.col("gross_amount").cast("double").alias("gross_amount"), us("ordered_at"))


@query(f"""SELECT {K}, subscription_id, subscription_status, plan_name, CAST(mrr AS DOUBLE) AS mrr, epoch_us(valid_from) AS valid_from_us,
    epoch_us(valid_to) AS valid_to_us, is_current, is_delete,
    md5(concat_ws('||', coalesce(tenant_id, ''), subscription_id, CAST(epoch_us(valid_from) AS VARCHAR), CAST(event_id AS VARCHAR))) AS subscription_sk FROM sh""")
def subscription_history(d):
    h = M.Marts(d).subscription_history()
    return h.select(*KEYS, "subscription_id", "subscription_status", "plan_name", F.col("mrr").cast("double").alias("mrr"), us("valid_from"),
        us("valid_to"), "is_current", "is_delete", "subscription_sk")


@query(f"""SELECT {K}, event_id, {_LIFE.format("subscription_status")} AS lifecycle_stage, epoch_us(valid_from) AS stage_started_at_us,
    epoch_us(coalesce(valid_to, lead(valid_from) OVER (PARTITION BY {K} ORDER BY valid_from, event_id))) AS stage_ended_at_us, is_current FROM sh""")
def lifecycle_history(d):
    return M.Marts(d).lifecycle_history().select(*KEYS, "event_id", "lifecycle_stage", us("stage_started_at"), us("stage_ended_at"), "is_current")


@query(f"SELECT {K}, subscription_id, subscription_status, plan_name, CAST(mrr AS DOUBLE) AS mrr FROM cs")
def current_subscription(d):
    return M.Marts(d).current_subscription().withColumn("mrr", F.col("mrr").cast("double"))


AT = "2024-01-10 00:00:00"


@query(f"""SELECT {K}, subscription_id, subscription_status, epoch_us(valid_from) AS valid_from_us FROM sh WHERE valid_from <= TIMESTAMP '{AT}' AND
    (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') AND NOT is_delete""")
def subscription_as_of(d):
    h = M.Marts(d).subscription_history().drop("subscription_sk")
    return history.as_of(h, ["tenant_id", "subscription_id"], F.lit(AT).cast("timestamp_ntz"), "is_delete", "event_id").select(*KEYS,
        "subscription_id", "subscription_status", us("valid_from"))


@query("""SELECT s.event_id, s.status, h.subscription_status FROM (SELECT s.*, tenant_id FROM support s JOIN identity_map m ON s.custkey = m.custkey) s
    LEFT JOIN sh h ON s.custkey = h.custkey AND s.tenant_id = h.tenant_id AND h.valid_from <= s.created_at AND (h.valid_to IS NULL OR h.valid_to > s.created_at)""")
def support_with_subscription_as_of(d):
    s = d.support().join(d.identity_map().select("custkey", "tenant_id"), "custkey")
    h = M.Marts(d).subscription_history().select("tenant_id", "custkey", "subscription_status", "valid_from", "valid_to")
    return history.as_of_join(s, h, ["tenant_id", "custkey"], "created_at").select("event_id", "status", "subscription_status")


EXTRA.append(("shm", """SELECT * REPLACE (CASE WHEN event_id % 307 = 0 THEN valid_from WHEN event_id % 173 = 0 THEN valid_to + INTERVAL 1 DAY ELSE
    valid_to END AS valid_to, is_current OR event_id % 211 = 0 AS is_current) FROM sh"""))


def damaged_history(d: Domain) -> DataFrame:
    """The subscription history with planted faults: empty windows, overlaps, closed or deleted rows that claim to be current."""
    at = F.col("event_id")
    longer = F.col("valid_to") + F.make_dt_interval(F.lit(1))
    return M.Marts(d).subscription_history().withColumns({"valid_to": F.when(at % 307 == 0, F.col("valid_from")).when(at % 173 == 0,
        longer).otherwise(F.col("valid_to")), "is_current": F.col("is_current") | (at % 211 == 0)})


@query("""SELECT DISTINCT tenant_id, subscription_id, problem FROM (SELECT tenant_id, subscription_id, unnest([CASE WHEN valid_to <= valid_from THEN
    'invalid_window' END, CASE WHEN nxt2 IS NOT NULL AND (valid_to IS NULL OR valid_to > nxt2) THEN 'overlap' END,
    CASE WHEN n > 1 THEN 'multiple_current' END]) AS problem FROM (SELECT *, lead(valid_from) OVER (PARTITION BY tenant_id, subscription_id ORDER BY
    valid_from, event_id) AS nxt2, count(*) FILTER (WHERE is_current) OVER (PARTITION BY tenant_id, subscription_id) AS n FROM shm)) WHERE problem IS
    NOT NULL""")
def subscription_history_violations(d):
    return history.invariants(damaged_history(d), ["tenant_id", "subscription_id"], "event_id")


@query(f"SELECT {K}, event_id, marketing_consent_status, epoch_us(event_timestamp) AS event_timestamp_us FROM lc")
def latest_consent(d):
    return M.Marts(d).latest_consent().select(*KEYS, "event_id", "marketing_consent_status", us("event_timestamp"))


@query(f"""SELECT {K}, event_id, marketing_consent_status, epoch_us(event_timestamp) AS valid_from_us, epoch_us(nxt) AS valid_to_us FROM (
    SELECT c.*, {K}, lead(event_timestamp) OVER (PARTITION BY {K} ORDER BY event_timestamp, event_id) AS nxt FROM consent c JOIN identity_map m ON
    c.custkey = m.custkey) WHERE nxt IS NULL OR nxt > event_timestamp""")
def consent_history(d):
    rows = d.consent().join(d.identity_map().select("custkey", *KEYS), "custkey")
    return history.scd2(rows, KEYS, "event_timestamp", "event_id", "is_delete").select(*KEYS, "event_id", "marketing_consent_status", us("valid_from"),
        us("valid_to"))


@query("SELECT * FROM el")
def activation_eligibility(d):
    return M.Marts(d).eligibility()


@query("SELECT tenant_id, suppression_reason, count(*) AS customers FROM el WHERE suppression_reason IS NOT NULL GROUP BY ALL")
def suppressed_customers(d):
    return M.Marts(d).eligibility().where("suppression_reason is not null").groupBy("tenant_id", "suppression_reason").agg(F.count("*").alias("customers"))


@query(f"SELECT {K} FROM el WHERE NOT activation_eligible AND {_CKEY} % 97 = 5")
def privacy_gate(d):
    """An export into which some customers that may not be exported were planted: the gate finds just these."""
    e = M.Marts(d).eligibility()
    leaked = e.where(~F.col("activation_eligible") & (ckey() % 97 == 5)).select(*KEYS)
    return M.privacy_violations(rows_of(d).select(*KEYS).unionByName(leaked), e)


@query("""SELECT tenant_id, business_unit, count(*) AS customers, round(avg(identity_confidence), 6) AS avg_confidence, count(*) FILTER (WHERE
    identity_confidence < 0.75) AS low_confidence,
    count(*) FILTER (WHERE email IS NULL) AS missing_email, count(*) FILTER (WHERE phone IS NULL) AS missing_phone FROM customers GROUP BY ALL""")
def identity_quality(d):
    return M.Marts(d).identity_quality()


# -- exports, syncs, reconciliation -------------------------------------------------------------------------------------


def rows_of(d: Domain, often: bool = False) -> DataFrame:
    """Rows to export; written to the shared folder first where several branches of a plan read them."""
    m = M.Marts(d)
    rows = M.activation_rows(m.customer_360(), m.eligibility())
    return settle(rows, "activation-rows") if often else rows


def _export(name: str) -> None:
    cols = ", ".join(M.EXPORTS[name])

    def run(d):
        return M.export(rows_of(d), name)

    run.__name__ = f"export_{name}"
    query(f"SELECT {K}, hashed_email, hashed_phone, {cols} FROM ar WHERE churn_risk_score IS NOT NULL")(run)


for _name in M.EXPORTS:
    _export(_name)

_B = "CAST(('0x' || substr(sha256('{0}:' || tenant_id || ':' || canonical_customer_id), 1, 8)) AS BIGINT) % 2147483648"
_SYNC = " UNION ALL ".join(
    f"""SELECT '{n}' AS destination, tenant_id, canonical_customer_id, CASE WHEN hashed_email IS NULL AND hashed_phone IS NULL THEN 1 WHEN b % 29 = 0
    THEN 1 WHEN b % 23 = 0 THEN 3 WHEN b % 17 = 0 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN hashed_email IS NULL AND hashed_phone IS NULL THEN 0 WHEN b % 29 <> 0 AND b % 17 = 0 THEN 1 ELSE 0 END AS rate_limited, CASE WHEN
    (hashed_email IS NULL AND hashed_phone IS NULL) OR b % 29 = 0 THEN 'failed' ELSE 'inserted' END AS status
    FROM (SELECT *, {_B.format(n)} AS b FROM ar)"""
    for n, e, *_ in A.DESTINATIONS
)
EXTRA.append(("sy", _SYNC))
EXTRA.append(
    ("sl", """SELECT destination, count(*) AS attempted_count, count(*) FILTER (WHERE status = 'inserted') AS inserted_count, CAST(sum(attempts - 1) AS
    BIGINT) AS retry_count, count(*) FILTER (WHERE status = 'failed') AS failed_count, count(*) FILTER (WHERE status <> 'failed') AS success_count,
    CAST(floor((count(*) - 1) / max(CASE destination WHEN 'hubspot' THEN 5 WHEN 'zendesk' THEN 3 ELSE 4 END)) AS BIGINT) + CAST(sum(rate_limited) AS
    BIGINT) AS rate_limit_events FROM sy GROUP BY ALL""")
)


EXPORTED = "2024-02-01 00:00:00"


def synced(d: Domain) -> tuple[DataFrame, DataFrame]:
    """(outcomes, exported rows) of a first sync to all destinations."""
    rows = rows_of(d, often=True)
    out = exported = None
    for dest in A.DESTINATIONS:
        e = M.export(rows, dest[1], F.lit(EXPORTED))
        o = A.sync_rows(e, None, dest)
        x = e.select(*KEYS, "hashed_email", "hashed_phone", F.lit(dest[0]).alias("destination"))
        out, exported = (o, x) if out is None else (out.unionByName(o), exported.unionByName(x))
    return out, exported


@query("SELECT * FROM sy")
def sync_outcomes(d):
    return synced(d)[0].select("destination", *KEYS, "attempts", "rate_limited", "status")


@query("SELECT *, CASE WHEN failed_count = 0 THEN 'success' WHEN success_count > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM sl")
def sync_run_log(d):
    return A.sync_log(synced(d)[0]).drop("updated_count", "skipped_count").select("destination", "attempted_count", "inserted_count", "retry_count",
        "failed_count", "success_count", "rate_limit_events", "status")


@query("""SELECT destination, attempted_count AS attempted, success_count AS succeeded, failed_count AS failed, retry_count AS retries,
    rate_limit_events AS rate_limits, CASE WHEN failed_count > 0 THEN 'degraded' WHEN rate_limit_events > 0 THEN 'rate_limited' ELSE 'healthy' END AS
    status FROM sl""")
def sync_health(d):
    return A.sync_health(A.sync_log(synced(d)[0]))


@query("""SELECT destination, tenant_id, total, n AS export_count, ok AS success_count, bad AS failed_count, CAST(0 AS BIGINT) AS duplicate_count,
    suppressed_count, CAST(0 AS BIGINT) AS skipped_count, total - ok - bad - suppressed_count AS variance,
    round(100.0 * (ok + bad + suppressed_count) / total, 2) AS explained_pct FROM (SELECT destination, tenant_id, count(*) AS n, count(*) FILTER (WHERE
    status = 'inserted') AS ok, count(*) FILTER (WHERE status = 'failed') AS bad FROM sy GROUP BY ALL)
    JOIN (SELECT tenant_id, count(*) AS total, count(*) FILTER (WHERE suppression_reason IS NOT NULL) AS suppressed_count FROM el GROUP BY ALL) USING (tenant_id)""")
def reconciliation(d):
    out, exported = synced(d)
    return A.reconcile(out, exported, M.Marts(d).eligibility())


_DEST = "(VALUES ('braze'), ('hubspot'), ('salesforce'), ('zendesk')) v(destination)"
EXTRA.append(("xbase", f"""SELECT destination, CASE WHEN destination = 'braze' AND ck % 71 = 4 THEN 'tenant_moon' ELSE tenant_id END AS tenant_id,
    canonical_customer_id, ck, CASE WHEN destination = 'zendesk' AND ck % 67 = 3 THEN NULL ELSE hashed_email END AS hashed_email,
    CASE WHEN destination = 'zendesk' AND ck % 67 = 3 THEN NULL ELSE hashed_phone END AS hashed_phone FROM (SELECT *, {_CKEY} AS ck FROM ar) CROSS JOIN
    {_DEST} WHERE NOT (destination = 'braze' AND ck % 53 = 1)"""))
EXTRA.append(("xall", f"""SELECT * FROM xbase UNION ALL SELECT * FROM xbase WHERE destination = 'salesforce' AND ck % 61 = 2 UNION ALL SELECT
    'hubspot', {K}, {_CKEY}, 'x', 'x' FROM el WHERE NOT activation_eligible AND {_CKEY} % 97 = 5
    UNION ALL SELECT 'hubspot', tenant_id, 'cc_unknown_' || custkey, NULL, 'x', 'x' FROM customers WHERE custkey % 199 = 0"""))
_KEY = f"destination, {K}"


@query(f"""SELECT 'missing_eligible_row' AS finding, 'high' AS severity, {_KEY} FROM (SELECT {_KEY} FROM el CROSS JOIN {_DEST} WHERE
    activation_eligible EXCEPT SELECT {_KEY} FROM xall)
    UNION ALL SELECT 'unexpected_exported_row', 'high', {_KEY} FROM (SELECT DISTINCT {_KEY} FROM xall ANTI JOIN el USING ({K}))
    UNION ALL SELECT 'privacy_suppressed_row_exported', 'critical', {_KEY} FROM (SELECT DISTINCT {_KEY} FROM xall JOIN (SELECT {K} FROM el WHERE NOT
    activation_eligible) USING ({K}))
    UNION ALL SELECT 'duplicate_customer_export', 'medium', {_KEY} FROM (SELECT {_KEY} FROM xall GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'missing_hashed_identifier', 'medium', {_KEY} FROM (SELECT DISTINCT {_KEY} FROM xall WHERE hashed_email IS NULL AND hashed_phone IS NULL)
    UNION ALL SELECT 'wrong_tenant_row', 'critical', {_KEY} FROM (SELECT DISTINCT x.destination, x.tenant_id, x.canonical_customer_id FROM xall x JOIN
    el h ON x.canonical_customer_id = h.canonical_customer_id WHERE x.tenant_id <> h.tenant_id)
    UNION ALL SELECT 'duplicate_idempotency_key', 'medium', {_KEY} FROM (SELECT *, count(*) OVER () AS n FROM sy WHERE destination = 'hubspot' AND
    {_CKEY} % 73 = 6) WHERE n > 1""")
def reconciliation_findings(d):
    """A sync with planted faults of all seven kinds: rows left out, unknown and suppressed customers, rows sent twice, without an
    identifier or for another tenant, and one key for several rows."""
    out, exported = synced(d)
    e, to = settle(M.Marts(d).eligibility(), "eligibility"), F.col("destination")
    x = exported.where(~((to == "braze") & (ckey() % 53 == 1)))
    none = (to == "zendesk") & (ckey() % 67 == 3)
    x = x.withColumns({"tenant_id": F.when((to == "braze") & (ckey() % 71 == 4), "tenant_moon").otherwise(F.col("tenant_id"))} | {h: F.when(~none,
        F.col(h)) for h in ("hashed_email", "hashed_phone")})
    sent = [F.lit("hubspot").alias("destination"), "tenant_id"]
    hashes = [F.lit("x").alias("hashed_email"), F.lit("x").alias("hashed_phone")]
    leaked = e.where(~F.col("activation_eligible") & (ckey() % 97 == 5)).select(*sent, "canonical_customer_id", *hashes)
    unknown = d.customers().where("custkey % 199 = 0").select(*sent, F.concat(F.lit("cc_unknown_"), "custkey").alias("canonical_customer_id"), *hashes)
    x = settle(x.unionByName(x.where((to == "salesforce") & (ckey() % 61 == 2))).unionByName(leaked).unionByName(unknown), "exported")
    out = out.withColumn("idempotency_key", F.when((to == "hubspot") & (ckey() % 73 == 6), "same").otherwise(F.col("idempotency_key")))
    return A.findings(x, settle(out, "outcomes"), e)


@query(" UNION ALL ".join(f"SELECT '{n}' AS export_name, count(*) AS rows, CASE WHEN count(*) > 0 THEN CAST(90 AS BIGINT) END AS lag_minutes, CASE WHEN count(*) = 0 THEN 'missing' ELSE 'fresh' END AS status FROM ar" for n in M.EXPORTS))
def activation_freshness(d):
    rows = rows_of(d, often=True)
    at, now = (F.lit(x).cast("timestamp_ntz") for x in ("2024-02-01 00:00:00", "2024-02-01 01:30:00"))
    return M.export_freshness({n: M.export(rows, n) for n in M.EXPORTS}, at, now)


@query("""SELECT 'active_customers' AS metric_name, CAST(count(*) FILTER (WHERE lifecycle_stage = 'active_customer') AS DOUBLE) AS metric_value FROM c3
    UNION ALL SELECT 'high_churn_risk_rate', round(avg(CASE WHEN churn_risk_band = 'high' THEN 1.0 ELSE 0.0 END), 6) FROM c3
    UNION ALL SELECT 'avg_customer_health_score', round(avg(CAST(health_score AS DOUBLE)), 6) FROM c3 UNION ALL SELECT 'rejected_event_rate',
    round(avg(CASE WHEN reject_category IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM cl
    UNION ALL SELECT 'fresh_activation_export_count', CAST(CASE WHEN count(*) > 0 THEN 6 ELSE 0 END AS DOUBLE) FROM ar UNION ALL SELECT
    'unhealthy_sync_destination_count', CAST(count(*) FILTER (WHERE failed_count > 0 OR rate_limit_events > 0) AS DOUBLE) FROM sl""")
def semantic_metrics(d):
    rate = classified(d).agg(F.round(F.avg(F.col("reject_category").isNotNull().cast("double")), 6).alias("rejected_event_rate"))
    rows = rows_of(d, often=True)
    at, now = (F.lit(x).cast("timestamp_ntz") for x in ("2024-02-01 00:00:00", "2024-02-01 01:30:00"))
    fresh = M.export_freshness({n: M.export(rows, n) for n in M.EXPORTS}, at, now)
    return M.Marts(d).semantic_metrics(rate, A.sync_health(A.sync_log(synced(d)[0])), fresh)


@query(f"""SELECT {K}, CASE WHEN status = 'failed' THEN 'failed' WHEN {_CKEY} % 10 = 7 THEN 'inserted' WHEN {_CKEY} % 10 = 3 THEN 'updated' ELSE
    'skipped_unchanged' END AS status FROM sy WHERE destination = 'braze'""")
def sync_second_run(d):
    """A second sync: some rows that the first did not have, some whose attributes have changed, the rest as they were."""
    rows = rows_of(d, often=True)
    dest = A.DESTINATIONS[0]
    first = A.sync_rows(M.export(rows.where(ckey() % 10 != 7), dest[1], F.lit(EXPORTED)), None, dest)
    changed = rows.withColumn("campaign_target", F.when(ckey() % 10 == 3, "another").otherwise(F.col("campaign_target")))
    return A.sync_rows(M.export(changed, dest[1], F.lit(EXPORTED)), A.sync_state(None, first), dest).select(*KEYS, "status")


@query(f"""SELECT destination AS destination_name, {K}, CASE WHEN status = 'failed' THEN 'destination_validation_error' END AS failure_reason, attempts
    - 1 AS retry_count, 'insert' AS sync_mode, status AS sync_status, 'run_1' AS sync_run_id FROM sy""")
def payload_audit(d):
    return A.payload_audit(synced(d)[0], "run_1", F.lit(EXPORTED)).select("destination_name", *KEYS, "failure_reason", "retry_count", "sync_mode",
        "sync_status", "sync_run_id")


@query("""SELECT destination AS destination_name, CASE destination WHEN 'braze' THEN 'run_1' ELSE 'run_2' END AS latest_sync_run_id, CASE WHEN
    failed_count = 0 THEN 'success' WHEN success_count > 0 THEN 'partial_success' ELSE 'failed' END AS last_sync_status,
    attempted_count, success_count, failed_count, retry_count FROM sl""")
def destination_status(d):
    """The latest of two runs of each destination; the later one of the first destination's has the lower number."""
    log = A.sync_log(synced(d)[0])
    run = lambda df, n, at: df.withColumns({"sync_run_id": F.lit(n), "ended_at": F.lit(at).cast("timestamp_ntz")})
    one, two = log.where("destination = 'braze'"), log.where("destination <> 'braze'")
    logs = run(two, "run_1", "2024-01-01").unionByName(run(two, "run_2", "2024-01-02")).unionByName(run(one, "run_2",
        "2024-01-01")).unionByName(run(one, "run_1", "2024-01-02"))
    return A.destination_status(logs).drop("last_synced_at")


@query(f"""SELECT {K}, health_score, CAST(greatest(0, least(100, 100 - health_score + CASE WHEN pd THEN 20 ELSE 0 END + CASE WHEN ca THEN 40 ELSE 0 END
    + CASE WHEN un THEN 10 ELSE 0 END)) AS INT) AS churn_risk_score,
    CASE WHEN ca THEN 'churned' WHEN pd THEN 'at_risk' WHEN ac THEN 'active_customer' WHEN tr OR customer_status = 'lead' THEN 'trial_or_lead' ELSE
    'unknown' END AS lifecycle_stage,
    CASE WHEN paid_orders = 0 THEN 'activation_needed' WHEN revenue >= 250 THEN 'high_value' WHEN en THEN 'enterprise_growth' ELSE 'self_serve_core'
    END AS customer_segment FROM (
    SELECT c.tenant_id, c.canonical_customer_id, customer_status, coalesce(paid_total, 0) / CAST(6000 AS DOUBLE) AS revenue, coalesce(paid_orders, 0)
    AS paid_orders, coalesce(pd, false) AS pd, coalesce(ca, false) AS ca, coalesce(ac, false) AS ac, coalesce(tr, false) AS tr, coalesce(en, false) AS
    en, coalesce(un, false) AS un,
    CAST(greatest(0, least(100, 55 + least(coalesce(event_count, 0), 30) + least(CAST(trunc(coalesce(paid_total, 0) / CAST(6000 AS DOUBLE) / 50) AS
    INT), 20) - 15 * coalesce(open_cases, 0) - 20 * coalesce(low_csat_cases, 0) - 10 * coalesce(refunded_orders, 0))) AS INT) AS health_score
    FROM customers c LEFT JOIN ot USING ({K}) LEFT JOIN ru USING ({K})
    LEFT JOIN (SELECT custkey, bool_or(subscription_status = 'past_due') AS pd, bool_or(subscription_status = 'canceled') AS ca,
    bool_or(subscription_status = 'active') AS ac, bool_or(subscription_status = 'trialing') AS tr, bool_or(plan_name = 'enterprise') AS en FROM subs
    GROUP BY ALL) s ON c.custkey = s.custkey
    LEFT JOIN (SELECT custkey, bool_or(unsubscribe_status = 'unsubscribed') AS un FROM consent GROUP BY ALL) u ON c.custkey = u.custkey)""")
def activation_by_events(d):
    return M.event_activation(M.event_features(d)).select(*KEYS, "health_score", "churn_risk_score", "lifecycle_stage", "customer_segment")


# -- change events ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, reject_category FROM cl")
def cdc_classified(d):
    return classified(d).select("event_id", "reject_category")


@query("""SELECT event_id, tenant_id, source_table, reject_category AS failure_category, reject_category IN ('UNKNOWN_OPERATION', 'INVALID_PAYLOAD',
    'SCHEMA_INVALID') AS retry_eligible FROM cl WHERE reject_category IS NOT NULL""")
def cdc_dead_letters(d):
    r = cdc.rejection_records(classified(d), "normalization", F.lit("2024-02-01").cast("timestamp_ntz"))
    return r.select("event_id", "tenant_id", "source_table", "failure_category", "retry_eligible")


@query("""SELECT event_id, CASE WHEN operation_type = 'upsert' THEN 'insert' ELSE operation_type END AS operation_type, batch_id || '_dlq_reprocessed' AS batch_id,
    CASE WHEN schema_version <> 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN record_primary_key IS NULL THEN 'MISSING_SOURCE_KEY' WHEN coalesce(tenant_id,
    '') = '' THEN 'INVALID_TENANT' END AS reject_category FROM cl WHERE reject_category IS NOT NULL""")
def cdc_repaired(d):
    bad = classified(d).where("reject_category is not null").drop("reject_category", "reject_detail")
    return cdc.classify(cdc.repair(bad, {}), TABLES).select("event_id", "operation_type", "batch_id", "reject_category")


@query("""SELECT batch_id, source_system, source_table, schema_version, count(*) AS record_count, count(*) FILTER (WHERE reject_category IS NULL) AS
    landed_count, count(*) FILTER (WHERE reject_category IS NOT NULL) AS rejected_count,
    CASE WHEN count(*) FILTER (WHERE reject_category IS NOT NULL) = 0 THEN 'success' WHEN count(*) FILTER (WHERE reject_category IS NULL) > 0 THEN
    'partial_success' ELSE 'failed' END AS status FROM cl GROUP BY ALL""")
def cdc_ingestion_summary(d):
    return cdc.ingestion_summary(classified(d))


@query("""SELECT source_table, count(*) AS records, count(*) FILTER (WHERE reject_category IS NOT NULL) AS rejected, round(count(*) FILTER (WHERE
    reject_category IS NOT NULL) / count(*), 6) AS rejected_rate,
    CASE WHEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - max(epoch_us(event_timestamp)) > 360 * CAST(60000000 AS BIGINT) THEN 'critical' WHEN
    round(count(*) FILTER (WHERE reject_category IS NOT NULL) / count(*), 6) > 0.05 THEN 'warning' ELSE 'healthy' END AS health FROM cl GROUP BY ALL""")
def pipeline_health(d):
    c = classified(d)
    fresh = quality.freshness(c, ["source_table"], F.col("event_timestamp"), F.lit("2024-02-01").cast("timestamp_ntz"), 1440)
    return M.Marts(d).pipeline_health(cdc.ingestion_summary(c), fresh).select("source_table", "records", "rejected", "rejected_rate", "health")


@query("""SELECT tenant_id, source_system, source_table, epoch_us(max(event_timestamp)) AS high_watermark_us, arg_max(event_id, (event_timestamp,
    event_id)) AS last_event_id, count(*) AS event_count FROM ok GROUP BY ALL""")
def cdc_watermarks(d):
    return cdc.watermarks(landed(d)).select("tenant_id", "source_system", "source_table", us("high_watermark"), "last_event_id", "event_count")


@query("""SELECT kafka_topic, kafka_partition, max(kafka_offset) AS last_offset, arg_max(event_id, (kafka_offset, event_id)) AS last_event_id FROM
    (SELECT *, source_table AS kafka_topic FROM ok) GROUP BY ALL""")
def cdc_offset_checkpoints(d):
    return cdc.offset_checkpoints(landed(d))


@query("""SELECT tenant_id, source_system, source_table, record_primary_key, arg_max(event_id, event_sequence_number) AS event_id,
    arg_max(operation_type, event_sequence_number) AS operation_type FROM ok GROUP BY ALL""")
def cdc_latest_state(d):
    keys = ["tenant_id", "source_system", "source_table", "record_primary_key"]
    return cdc.latest_state(landed(d), keys).select(*keys, "event_id", "operation_type")


@query("""SELECT tenant_id, source_table, record_primary_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_table,
    record_primary_key ORDER BY event_sequence_number DESC) AS rn FROM ok) WHERE rn = 1 AND operation_type <> 'delete'""")
def cdc_latest_not_deleted(d):
    w = Window.partitionBy("tenant_id", "source_table", "record_primary_key").orderBy(F.col("event_sequence_number").desc())
    return landed(d).withColumn("rn", F.row_number().over(w)).where("rn = 1 and operation_type <> 'delete'").select("tenant_id", "source_table",
        "record_primary_key", "event_id")


@query(f"""SELECT event_id, batch_id, 'replay_1' AS replay_batch_id, true AS is_replay FROM ok WHERE event_timestamp >= TIMESTAMP '2024-01-05' AND
    event_timestamp < TIMESTAMP '{AT}' AND batch_id IN ('b1', 'b3') AND source_table IN ('subscriptions', 'support_interactions')""")
def cdc_replay_selection(d):
    r = cdc.select_replay(landed(d), "replay_1", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit(AT).cast("timestamp_ntz"), ["b1", "b3"],
        ["subscriptions", "support_interactions"])
    return r.select("event_id", "batch_id", "replay_batch_id", "is_replay")


@query("""SELECT arrival_ordinal, event_id, duplicate_key FROM (SELECT arrival_ordinal, event_id, 'event_hash' AS duplicate_key, rn > 1 AS twice, k FROM first_seen
    UNION ALL SELECT arrival_ordinal + 1000000000, event_id, 'event_id', rn = 1, k FROM first_seen WHERE k % 10 = 1 UNION ALL SELECT arrival_ordinal +
    2000000000, 'again_' || event_id, 'kafka_offset', rn = 1, k FROM first_seen WHERE k % 10 = 2) WHERE twice""")
def cdc_duplicates(d):
    """The stream repeats hashes; some events are sent again later with another hash, some under another id at the same offset. These
    are duplicates only where the first sending was accepted."""
    e = landed(d)
    other = F.concat(F.lit("other_"), "event_hash", F.lit("_"), "event_id")
    ids = e.where("k % 10 = 1").withColumns({"arrival_ordinal": F.col("arrival_ordinal") + 1_000_000_000, "event_hash": other,
        "kafka_offset": F.lit(None).cast("bigint")})
    offsets = e.where("k % 10 = 2").withColumns({"arrival_ordinal": F.col("arrival_ordinal") + 2_000_000_000, "event_hash": other,
        "event_id": F.concat(F.lit("again_"), "event_id")})
    return cdc.mark_duplicates(e.unionByName(ids).unionByName(offsets)).where("duplicate_key is not null").select("arrival_ordinal", "event_id",
        "duplicate_key")


@query("""SELECT tenant_id, record_primary_key, arrival_ordinal, event_sequence_number, 'out_of_order_sequence' AS anomaly FROM (
    SELECT *, max(event_sequence_number) OVER (PARTITION BY tenant_id, record_primary_key ORDER BY arrival_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND
    1 PRECEDING) AS most FROM (
    SELECT tenant_id, record_primary_key, arrival_ordinal, (event_sequence_number * 7919) % 10007 + 1 AS event_sequence_number FROM ok)) WHERE most >
    event_sequence_number""")
def cdc_ordering_anomalies(d):
    """Sequence numbers are shuffled by a fixed rule; the regular ones are those that raise the running maximum."""
    rows = landed(d).withColumns({"event_sequence_number": (F.col("event_sequence_number") * 7919) % 10007 + 1, "commit_us": F.lit(None).cast("bigint")})
    return cdc.ordering_anomalies(rows, ["tenant_id", "record_primary_key"]).select("tenant_id", "record_primary_key", "arrival_ordinal",
        "event_sequence_number", "anomaly")


@query("SELECT custkey, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM ev GROUP BY ALL")
def merge_upsert(d):
    """The state of even events merged with the odd ones, by the newest event."""
    e = d.events().select("custkey", "event_id", "value")
    return merge.upsert(merge.latest(e.where("event_id % 2 = 0"), ["custkey"], "event_id"), e.where("event_id % 2 = 1"), ["custkey"], "event_id")


@query("""SELECT event_id, event_hash FROM env WHERE event_id NOT IN (SELECT event_id FROM env WHERE k < 50) AND event_hash NOT IN (SELECT event_hash
    FROM env WHERE k < 50)""")
def merge_insert_ignore(d):
    e = d.envelopes().select("event_id", "event_hash", "k")
    return merge.insert_ignore(e.where("k < 50"), e, ["event_id"], ["event_hash"]).select("event_id", "event_hash")


@query(f"SELECT order_id, order_status, epoch_us(ordered_at) AS ordered_at_us FROM ord WHERE ordered_at >= (SELECT max(ordered_at) FROM ord) - INTERVAL 3 DAY")
def incremental_orders_lookback(d):
    """What an incremental run rereads: three days before the high-water mark."""
    o = d.orders()
    mark = o.agg(F.max("ordered_at").alias("mark"))
    return o.crossJoin(F.broadcast(mark)).where(F.col("ordered_at") >= F.col("mark") - F.make_dt_interval(F.lit(3))).select("order_id", "order_status",
        us("ordered_at"))


# -- identity -----------------------------------------------------------------------------------------------------------

EXTRA.append(("rec", """SELECT tenant_id, 'acct_' || custkey AS record_id, 'account_app' AS source_system, customer_id, email, phone, CAST(NULL AS
    VARCHAR) AS device_id, custkey FROM customers
    UNION ALL SELECT c.tenant_id, 'bill_' || c.custkey, 'billing_platform', CASE WHEN c.custkey % 3 = 0 THEN c.customer_id END, CASE WHEN c.custkey % 2
    = 0 THEN upper(c.email) END, CASE WHEN c.custkey % 5 = 0 THEN c.phone END, CAST(NULL AS VARCHAR), c.custkey FROM customers c
    UNION ALL SELECT c.tenant_id, 'prod_' || c.custkey, 'product_analytics', CASE WHEN c.custkey % 4 <> 0 THEN c.customer_id END, CAST(NULL AS
    VARCHAR), CAST(NULL AS VARCHAR), 'dev_' || (c.custkey % 500), c.custkey FROM customers c"""))  # fmt: skip
EXTRA.append(("tk", f"""SELECT DISTINCT tenant_id, record_id, kind, value, kind || ':' || value AS token, CASE kind WHEN 'customer_id' THEN 0.95 WHEN
    'email' THEN 0.86 WHEN 'phone' THEN 0.78 ELSE 0.62 END AS confidence FROM (
    SELECT tenant_id, record_id, 'customer_id' AS kind, lower(trim(customer_id)) AS value FROM rec UNION ALL SELECT tenant_id, record_id, 'email',
    {_MAIL.format("email")} FROM rec UNION ALL SELECT tenant_id, record_id, 'phone', phone FROM rec
    UNION ALL SELECT tenant_id, record_id, 'device_id', device_id FROM rec) WHERE value IS NOT NULL"""))  # fmt: skip
#: In this graph every strong token belongs to one customer key, so a component is what shares that key and a token.
EXTRA.append(("comp", """SELECT tenant_id, record_id, min(root) AS root FROM (SELECT a.tenant_id, a.record_id, c.record_id AS root FROM tk a JOIN tk b
    ON a.tenant_id = b.tenant_id AND a.token = b.token AND a.confidence >= 0.75
    JOIN tk b2 ON b2.tenant_id = b.tenant_id AND b2.record_id = b.record_id AND b2.confidence >= 0.75 JOIN tk c ON c.tenant_id = b2.tenant_id AND
    c.token = b2.token UNION ALL SELECT tenant_id, record_id, record_id FROM rec) GROUP BY ALL"""))  # fmt: skip


def records(d: Domain) -> DataFrame:
    """Account, billing and product records of each customer, sharing some of their identifiers."""
    c, none = d.customers(), F.lit(None).cast("string")
    key = F.col("custkey")
    acct = c.select("tenant_id", F.concat(F.lit("acct_"), key).alias("record_id"), F.lit("account_app").alias("source_system"), "customer_id", "email",
        "phone", none.alias("device_id"), "custkey")
    bill = c.select("tenant_id", F.concat(F.lit("bill_"), key).alias("record_id"), F.lit("billing_platform").alias("source_system"),
        F.when(key % 3 == 0, F.col("customer_id")).alias("customer_id"), F.when(key % 2 == 0, F.upper("email")).alias("email"),
            F.when(key % 5 == 0, F.col("phone")).alias("phone"), none.alias("device_id"), "custkey")
    prod = c.select("tenant_id", F.concat(F.lit("prod_"), key).alias("record_id"), F.lit("product_analytics").alias("source_system"),
        F.when(key % 4 != 0, F.col("customer_id")).alias("customer_id"), none.alias("email"), none.alias("phone"),
            F.concat(F.lit("dev_"), key % 500).alias("device_id"), "custkey")
    return acct.unionByName(bill).unionByName(prod)


@query("SELECT tenant_id, record_id, kind, value, CAST(confidence AS DOUBLE) AS confidence FROM tk")
def identity_tokens(d):
    return identity.tokens(records(d)).select("tenant_id", "record_id", "kind", "value", "confidence")


def _resolved(d):
    r = records(d)
    toks = settle(identity.tokens(r), "tokens")  # several branches of a plan read them
    return r, toks, identity.resolve(toks, r)


#: Per component its canonical id, its rule and its fingerprint.
EXTRA.append(("comp_tk", "SELECT c.tenant_id, c.root, t.kind, t.token, t.confidence, c.record_id FROM comp c LEFT JOIN tk t ON t.tenant_id = c.tenant_id AND t.record_id = c.record_id"))
EXTRA.append(("canon", """SELECT tenant_id, root, 'cc_' || substr(sha1(tenant_id || ':' || coalesce(substr(min(lpad(CAST(1000 - CASE kind WHEN
    'customer_id' THEN 85 WHEN 'email' THEN 75 WHEN 'phone' THEN 65 END AS VARCHAR), 4, '0') || token) FILTER (WHERE confidence >= 0.75), 5),
    'record:' || min(record_id))), 1, 12) AS canonical_customer_id,
    CASE WHEN bool_or(kind = 'customer_id') AND bool_or(kind = 'email') THEN 'customer_id_and_email' WHEN bool_or(kind = 'email') AND bool_or(kind =
    'phone') THEN 'email_and_phone' WHEN bool_or(kind = 'email') THEN 'email' WHEN bool_or(kind = 'phone') THEN 'phone' ELSE 'weak' END AS match_rule,
    sha256(coalesce(string_agg(DISTINCT token, '|' ORDER BY token), '')) AS fingerprint FROM comp_tk GROUP BY tenant_id, root"""))
EXTRA.append(("rmap", """SELECT comp.tenant_id, comp.record_id, canonical_customer_id, match_rule, CAST(CASE match_rule WHEN 'customer_id_and_email'
    THEN 0.95 WHEN 'email_and_phone' THEN 0.92 WHEN 'email' THEN 0.86 WHEN 'phone' THEN 0.78 ELSE 0.62 END AS DOUBLE) AS match_confidence, fingerprint
    FROM comp JOIN canon USING (tenant_id, root)"""))


@query("SELECT * FROM rmap")
def identity_resolved(d):
    return _resolved(d)[2]


@query("""SELECT rmap.tenant_id, rmap.record_id, canonical_customer_id, coalesce(matched, '') AS matched_identifiers, match_rule AS decision_reason,
    match_confidence AS confidence_score FROM rmap
    LEFT JOIN (SELECT tenant_id, record_id, string_agg(token, '|' ORDER BY token) AS matched FROM tk GROUP BY ALL) USING (tenant_id, record_id)""")
def identity_audit(d):
    _, toks, x = _resolved(d)
    return identity.audit(toks, x, F.lit("2024-02-01").cast("timestamp_ntz")).drop("resolved_at")


@query("""SELECT 'idrun_1' AS identity_resolution_run_id, (SELECT count(*) FROM (SELECT DISTINCT tenant_id, canonical_customer_id FROM rmap)) AS
    canonical_customers, (SELECT count(*) FROM rmap) AS source_records,
    (SELECT count(*) FROM rmap) + (SELECT count(*) FROM (SELECT DISTINCT tenant_id, token FROM tk)) AS graph_nodes, (SELECT count(*) FROM tk) AS graph_edges,
    (SELECT count(*) FROM (SELECT tenant_id, canonical_customer_id FROM rmap GROUP BY ALL HAVING count(*) >= 2)) AS graph_merge_events, 'success' AS run_status""")
def identity_resolution_run(d):
    _, toks, x = _resolved(d)
    return identity.resolution_run(toks, settle(x, "resolved"), "idrun_1", F.lit("2024-02-01").cast("timestamp_ntz")).drop("resolved_at")


@query("SELECT tenant_id, record_id, first_value(record_id) OVER (PARTITION BY tenant_id, root ORDER BY record_id) AS first_record FROM comp")
def identity_components(d):
    """The first record of each record's customer, in place of its hashed id."""
    _, _, x = _resolved(d)
    return x.join(x.groupBy(*KEYS).agg(F.min("record_id").alias("first_record")), KEYS).select("tenant_id", "record_id", "first_record")


@query("""SELECT tenant_id, count(*) AS records, string_agg(record_id, '|' ORDER BY record_id) AS merged_records FROM comp GROUP BY tenant_id, root HAVING count(*) >= 2""")
def identity_merge_events(d):
    _, toks, x = _resolved(d)
    return identity.graph_artifacts(toks, x)["merge_events"].select("tenant_id", "records", "merged_records")


@query("""SELECT tenant_id, token, count(DISTINCT root) - 1 AS links FROM tk JOIN comp USING (tenant_id, record_id) WHERE confidence < 0.75 GROUP BY
    ALL HAVING count(DISTINCT root) > 1""")
def identity_weak_links(d):
    _, toks, x = _resolved(d)
    return identity.weak_links(toks, x).groupBy("tenant_id", "token").agg(F.count("*").alias("links"))


@query("""SELECT 'case_' || substr(sha1(concat_ws('|', tenant_id, token, left_id, right_id)), 1, 16) AS case_id, tenant_id, token, kind,
    CAST(confidence AS DOUBLE) AS confidence, left_id, right_id, 'low_confidence_match' AS case_type, 'OPEN' AS status FROM (
    SELECT tenant_id, token, kind, confidence, canonical_customer_id AS right_id, min(canonical_customer_id) OVER (PARTITION BY tenant_id, token) AS
    left_id FROM (SELECT DISTINCT tenant_id, token, kind, confidence, canonical_customer_id FROM tk JOIN rmap USING (tenant_id, record_id) WHERE
    confidence < 0.75))
    WHERE right_id <> left_id""")
def identity_review_cases(d):
    _, toks, x = _resolved(d)
    return identity.review_cases(identity.weak_links(toks, x))


EXTRA.append(("rec2", f"""SELECT r.tenant_id, r.record_id, canonical_customer_id, source_system, custkey % 19 = 4 AND source_system = 'account_app' AS
    gone, TIMESTAMP '2024-01-01' + to_days(CAST(custkey % 28 AS INT)) AS updated_at,
    CASE source_system WHEN 'account_app' THEN 100 WHEN 'billing_platform' THEN 90 ELSE 40 END AS p, CASE WHEN custkey % 3 = 1 THEN 'x' || custkey ||
    '@z.example' ELSE email END AS email FROM rec r JOIN rmap USING (tenant_id, record_id)"""))


@query(f"""SELECT {K}, min(record_id) AS first_record, arg_min(email, (-p, -epoch_us(updated_at), record_id)) FILTER (WHERE email IS NOT NULL) AS
    email, count(*) AS record_count, epoch_us(min(updated_at)) AS first_seen_us, epoch_us(max(updated_at)) AS last_seen_us,
    string_agg(DISTINCT source_system, '|' ORDER BY source_system) AS source_systems FROM rec2 WHERE NOT gone GROUP BY ALL""")
def identity_survivors(d):
    """Records of several times and sources, some deleted; some product records have an email too, so that sources compete."""
    r, _, x = _resolved(d)
    ck = F.col("custkey")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(ck.cast("int") % 28)
    r = r.withColumns({"is_delete": (ck % 19 == 4) & (F.col("source_system") == "account_app"), "updated_at": at,
        "email": F.when(ck % 3 == 1, F.concat(F.lit("x"), "custkey", F.lit("@z.example"))).otherwise(F.col("email"))})
    s = identity.survivors(r, x, ["email"])
    first = r.where("not is_delete").join(x, ["tenant_id", "record_id"]).groupBy(*KEYS).agg(F.min("record_id").alias("first_record"))
    return s.join(first, KEYS).select(*KEYS, "first_record", "email", "record_count", us("first_seen_at").alias("first_seen_us"),
        us("last_seen_at").alias("last_seen_us"), "source_systems")


@query(f"""SELECT {K}, case_type FROM (SELECT {K}, unnest([CASE WHEN emails >= 2 THEN 'conflicting_email' END, CASE WHEN phones >= 2 THEN
    'conflicting_phone' END]) AS case_type FROM (SELECT {K}, count(DISTINCT {_MAIL.format("email")}) AS emails, count(DISTINCT phone) AS phones FROM
    (SELECT r.tenant_id, canonical_customer_id, r.record_id,
    CASE WHEN source_system = 'billing_platform' AND custkey % 97 = 0 THEN 'other.' || email ELSE email END AS email, CASE WHEN source_system =
    'billing_platform' AND custkey % 35 = 0 AND phone IS NOT NULL THEN '+19990000000' ELSE phone END AS phone FROM rec r JOIN rmap USING (tenant_id,
    record_id))
    GROUP BY {K} HAVING count(*) >= 2)) WHERE case_type IS NOT NULL""")
def identity_conflicts(d):
    """Some billing records got another email or phone after they were resolved."""
    r, _, x = _resolved(d)
    bill, ck = F.col("source_system") == "billing_platform", F.col("custkey")
    odd = r.withColumns({"email": F.when(bill & (ck % 97 == 0), F.concat(F.lit("other."), "email")).otherwise(F.col("email")),
        "phone": F.when(bill & (ck % 35 == 0) & F.col("phone").isNotNull(), "+19990000000").otherwise(F.col("phone"))})
    return identity.survivorship_conflicts(odd, x)


#: Candidates for the fuzzy queries. Names and addresses are shared by four customers and held by a tenth of the groups, others have none, so a ratio
#: of texts is 1 or 0; emails meet by local part and by domain.
EXTRA.append(("cand", """SELECT tenant_id, record_id, source_system, phone, custkey, CASE WHEN (custkey // 4) % 10 <> 0 AND source_system <>
    'product_analytics' THEN substr(sha1(CAST(custkey // 2 AS VARCHAR)), 1, 4) || '.' || custkey || '@d' || (custkey // 3) || '.example' END AS email,
    CASE WHEN (custkey // 4) % 10 = 0 THEN lpad(CAST(custkey // 4 AS VARCHAR), 5, '0') || ' co' END AS name, CASE source_system WHEN 'account_app' THEN
    1.0 WHEN 'billing_platform' THEN 0.95 ELSE 0.5 END AS trust,
    CASE source_system WHEN 'account_app' THEN 1 - 152 / 912.5 WHEN 'billing_platform' THEN 0.5 ELSE 0.2 END AS recency FROM rec"""))
EXTRA.append(("block", """SELECT record_id, tenant_id || '|' || kind || '|' || v AS key FROM (SELECT record_id, tenant_id, 'domain' AS kind,
    split_part(email, '@', 2) AS v FROM cand UNION ALL SELECT record_id, tenant_id, 'local', substr(email, 1, 4) FROM cand
    UNION ALL SELECT record_id, tenant_id, 'phone', right(phone, 7) FROM cand UNION ALL SELECT record_id, tenant_id, 'name', substr(name, 1, 5) FROM cand) WHERE v <> ''"""))
EXTRA.append(("pairs", "SELECT DISTINCT a.record_id AS left_id, b.record_id AS right_id FROM block a JOIN block b ON a.key = b.key AND a.record_id < b.record_id"))


def _candidates(d):
    ck, system = F.col("custkey"), F.col("source_system")
    local = F.substring(F.sha1(F.floor(ck / 2).cast("string")), 1, 4)
    email = F.when((F.floor(ck / 4) % 10 != 0) & (system != "product_analytics"),
        F.concat(local, F.lit("."), ck, F.lit("@d"), F.floor(ck / 3), F.lit(".example")))
    name = F.when(F.floor(ck / 4) % 10 == 0, F.concat(F.lpad(F.floor(ck / 4).cast("string"), 5, "0"), F.lit(" co")))
    at = F.when(system == "account_app", "2024-01-01").when(system == "product_analytics", "2021-01-01").cast("timestamp")
    return records(d).select("record_id", "tenant_id", "source_system", email.alias("email"), "phone", name.alias("name"), name.alias("address"),
        at.alias("updated_at"), (system == "account_app").alias("email_verified"), (ck % 2 == 0).alias("phone_verified"), "custkey")


@query("SELECT * FROM pairs")
def fuzzy_candidate_pairs(d):
    """By all four keys: mail domain, start of the local part, end of the phone, start of the name."""
    return identity.candidate_pairs(_candidates(d))


@query("""SELECT left_id, right_id, score, CASE WHEN ok AND score >= 0.44 THEN 'AUTO_MATCH' WHEN score >= 0.32 THEN 'REVIEW' ELSE 'NO_MATCH' END AS
    decision FROM (SELECT left_id, right_id, ok, round(round(0.3 * mail, 4) + round(0.24 * same_phone, 4) + round(0.16 * named, 4) + round(0.1 *
    named, 4) + round(0.08 * CAST(ok AS INT), 4) + round(0.07 * round(trust, 4), 4) + round(0.05 * round(recency, 4), 4), 4) AS score FROM (
    SELECT left_id, right_id, CASE WHEN coalesce(a.email = b.email, false) THEN 1.0 WHEN coalesce(split_part(a.email, '@', 2) = split_part(b.email,
    '@', 2), false) THEN 0.25 ELSE 0.0 END AS mail, CAST(coalesce(a.phone = b.phone, false) AS INT) AS same_phone, CAST(coalesce(a.name = b.name,
    false) AS INT) AS named,
    (CAST(a.trust AS DOUBLE) + b.trust) / 2 AS trust, (CAST(a.recency AS DOUBLE) + b.recency) / 2 AS recency, coalesce(a.email = b.email, false) AND
    a.source_system = 'account_app' AND b.source_system = 'account_app' OR coalesce(a.phone = b.phone, false) AND a.custkey % 2 = 0 AND b.custkey % 2
    = 0 AS ok
    FROM pairs JOIN cand a ON a.record_id = left_id JOIN cand b ON b.record_id = right_id))""")
def fuzzy_scores(d):
    c = settle(_candidates(d), "candidates")
    return identity.score_pairs(identity.candidate_pairs(c), c.drop("custkey"), F.lit("2024-06-01").cast("timestamp"))


# -- scalar functions, sets, pages, quality -----------------------------------------------------------------------------


@query(f"""SELECT customer_id, {_MAIL.format("upper(email)")} AS email_norm, sha256('kinfold::' || lower(email)) AS email_hash, left(phone, 3) || '***'
    || right(phone, 4) AS phone_masked,
    md5(concat_ws('||', coalesce(tenant_id, ''), coalesce(email, ''))) AS sk, CAST(('0x' || substr(sha256(customer_id), 1, 8)) AS BIGINT) % 29 AS
    bucket, substr(sha1(customer_id), 1, 12) AS short_id,
    CASE WHEN length(split_part(email, '@', 1)) <= 2 THEN left(email, 1) || '***@' || split_part(email, '@', 2) ELSE left(email, 1) || '***' ||
    right(split_part(email, '@', 1), 1) || '@' || split_part(email, '@', 2) END AS email_masked FROM customers""")
def scalar_functions(d):
    e = F.col("email")
    return d.customers().select(
        "customer_id", C.normalize_email(F.upper(e)).alias("email_norm"), C.pii_hash(e).alias("email_hash"),
            C.mask_phone(F.col("phone")).alias("phone_masked"), C.surrogate_key(F.col("tenant_id"), e).alias("sk"),
                C.hash_bucket(F.col("customer_id"), 29).alias("bucket"),
        F.substring(F.sha1("customer_id"), 1, 12).alias("short_id"), C.mask_email(e).alias("email_masked"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events")
def json_fields(d):
    return d.events().select("event_id", "k", "value")


@query("SELECT customer_id, balance FROM customers ORDER BY balance DESC NULLS LAST, customer_id LIMIT 50 OFFSET 25")
def page_of_customers(d):
    from .access import page

    return page(d.customers().select("customer_id", "balance"), [F.col("balance").desc_nulls_last(), "customer_id"], 25, 50)[0]


@query("SELECT customer_id FROM customers c WHERE NOT EXISTS (SELECT 1 FROM ord WHERE ord.custkey = c.custkey)")
def anti_join_customers_without_orders(d):
    return d.customers().join(d.orders(), "custkey", "left_anti").select("customer_id")


@query("SELECT DISTINCT customer_id FROM customers JOIN support USING (custkey)")
def semi_join_customers_with_cases(d):
    return d.customers().join(d.support(), "custkey", "left_semi").select("customer_id")


@query("SELECT custkey, count(*) AS n FROM support GROUP BY custkey HAVING count(*) > 1")
def duplicate_keys(d):
    return quality.duplicates(d.support(), ["custkey"])


@query("SELECT 'not_null' AS \"check\", 'email' AS \"column\", count(*) FILTER (WHERE email IS NULL) AS failures, count(*) FILTER (WHERE email IS NULL) = 0 AS passed FROM customers UNION ALL SELECT 'unique', 'customer_id', CAST(0 AS BIGINT), true UNION ALL SELECT 'in_set', 'customer_status', count(*) FILTER (WHERE customer_status NOT IN ('lead', 'active')), count(*) FILTER (WHERE customer_status NOT IN ('lead', 'active')) = 0 FROM customers UNION ALL SELECT 'row_count_between', '*', CAST(0 AS BIGINT), true")
def expectation_suite(d):
    return quality.expectations(d.customers(), [("not_null", "email"), ("unique", "customer_id"), ("in_set", "customer_status", ["lead", "active"]),
        ("row_count_between", 1, 10**12)])


@query("""SELECT 'FAIL' AS status, (SELECT count(*) FROM customers WHERE custkey % 10 = 0) AS missing, CAST(0 AS BIGINT) AS extra, (SELECT count(*)
    FROM customers WHERE custkey % 10 <> 0 AND custkey % 7 = 1) AS mismatched""")
def parity_check(d):
    c = d.customers().select("custkey", "balance")
    return quality.parity(c, c.where("custkey % 10 <> 0").withColumn("balance", F.col("balance") + (F.col("custkey") % 7 == 1).cast("int")), ["custkey"])


@query("""SELECT w.domain, coalesce(p, 0) AS passed, coalesce(t, 0) AS total, w.weight, coalesce(100.0 * p / nullif(t, 0), 0) AS score, coalesce(100.0
    * p / nullif(t, 0), 0) * w.weight / 100 AS weighted FROM (VALUES ('cdc', 15), ('identity', 15), ('historical', 15), ('customer_360', 10),
    ('privacy', 15), ('activation', 15), ('freshness', 5), ('reconciliation', 10)) w(domain, weight)
    LEFT JOIN (SELECT CASE k % 3 WHEN 0 THEN 'cdc' WHEN 1 THEN 'identity' ELSE 'privacy' END AS domain, count(*) FILTER (WHERE k > 10) AS p, count(*)
    AS t FROM ev GROUP BY ALL) g ON w.domain = g.domain""")
def scorecard(d):
    rows = d.events().select(F.when(F.col("k") % 3 == 0, "cdc").when(F.col("k") % 3 == 1, "identity").otherwise("privacy").alias("domain"),
        (F.col("k") > 10).alias("passed"))
    return quality.scorecard(rows)


@query("""SELECT tenant_id, source_table, epoch_us(max(event_timestamp)) AS last_us, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') -
    epoch_us(max(event_timestamp))) / 60000000) AS BIGINT) AS lag_minutes, CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-01') -
    epoch_us(max(event_timestamp))) / 60000000) < 1440 THEN 'fresh' ELSE 'stale' END AS status FROM ok GROUP BY ALL""")
def freshness_by_table(d):
    return quality.freshness(landed(d), ["tenant_id", "source_table"], F.col("event_timestamp"), F.lit("2024-02-01").cast("timestamp_ntz"), 1440)


@query("SELECT tenant_id, source_table, count(*) AS events FROM ok GROUP BY ALL")
def events_by_tenant_and_table(d):
    return landed(d).groupBy("tenant_id", "source_table").agg(F.count("*").alias("events"))


@query("""SELECT tenant_id, 'run_1' AS run_id, source, target, hop FROM (SELECT DISTINCT tenant_id FROM tenants) CROSS JOIN (VALUES ('raw_events',
    'staging', 0), ('staging', 'identity', 1), ('identity', 'marts', 2), ('marts', 'exports', 3), ('exports', 'destinations', 4)) h(source, target,
    hop)""")
def lineage_edges(d):
    return quality.lineage_edges(d.tenants().select("tenant_id").distinct(), "run_1")


@query("SELECT count(DISTINCT tenant_id) AS tenants, count(*) AS exported, count(DISTINCT canonical_customer_id) AS customers FROM ar")
def export_summary(d):
    return rows_of(d).agg(F.countDistinct("tenant_id").alias("tenants"), F.count("*").alias("exported"),
        F.countDistinct("canonical_customer_id").alias("customers"))


@query("""SELECT 'customers' AS name, count(*) AS n FROM customers UNION ALL SELECT 'orders', count(*) FROM ord UNION ALL SELECT 'events', count(*)
    FROM ev UNION ALL SELECT 'landed', count(*) FROM ok UNION ALL SELECT 'rejected', count(*) FROM cl WHERE reject_category IS NOT NULL
    UNION ALL SELECT 'eligible', count(*) FROM el WHERE activation_eligible UNION ALL SELECT 'suppressed', count(*) FROM el WHERE NOT activation_eligible""")
def platform_summary(d):
    c, e = classified(d), M.Marts(d).eligibility()
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    parts = [count(d.customers(), "customers"), count(d.orders(), "orders"), count(d.events(), "events")]
    split = c.agg(F.count_if(F.col("reject_category").isNull()).alias("landed"), F.count_if(F.col("reject_category").isNotNull()).alias("rejected"))
    parts.append(split.unpivot([], ["landed", "rejected"], "name", "n"))
    parts.append(e.agg(F.count_if("activation_eligible").alias("eligible"), F.count_if(~F.col("activation_eligible")).alias("suppressed")).unpivot([],
        ["eligible", "suppressed"], "name", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id, sha256(text) AS event_hash FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def distinct_documents_by_hash(d):
    return d.raw("documents").select("doc_id", F.sha2("text", 256).alias("event_hash")).groupBy("event_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "event_hash")


@query("""SELECT e.event_id, m.canonical_customer_id FROM ev e JOIN identity_map m ON e.custkey = m.custkey WHERE m.is_active AND e.ts <= TIMESTAMP '2024-01-03 00:00:00'""")
def events_known_by(d):
    """What was known of active customers by an instant."""
    return d.events().where(F.col("ts") <= F.lit("2024-01-03").cast("timestamp_ntz")).join(d.identity_map().where("is_active"),
        "custkey").select("event_id", "canonical_customer_id")


@query(f"SELECT {K}, email FROM customers WHERE tenant_id IN ('tenant_asia', 'tenant_europe')")
def tenant_scoped_customers(d):
    from .access import Principal, scoped

    return scoped(d.customers().select(*KEYS, "email"), Principal("analyst", frozenset({"tenant_asia", "tenant_europe"})))


EXTRA.append(("elm", f"SELECT * REPLACE (activation_eligible OR {_CKEY} % 89 = 4 AS activation_eligible) FROM el"))
EXTRA.append(("leak", f"SELECT {K} FROM el WHERE NOT activation_eligible AND {_CKEY} % 97 = 5"))


@query(f"""SELECT 'exports_are_eligible' AS test, (SELECT count(*) FROM leak JOIN elm USING ({K}) WHERE NOT elm.activation_eligible) + (SELECT count(*)
    FROM customers WHERE custkey % 101 = 7) AS failures
    UNION ALL SELECT 'export_counts_match', (SELECT sum(CASE WHEN n <> (SELECT count(*) FROM elm WHERE activation_eligible) THEN many ELSE 0 END) FROM
    (SELECT count(*) AS n, 5 AS many FROM ar UNION ALL SELECT (SELECT count(*) FROM ar) + (SELECT count(*) FROM leak) + (SELECT count(*) FROM
    customers WHERE custkey % 101 = 7), 1))::BIGINT
    UNION ALL SELECT 'deleted_subscription_not_current', (SELECT count(*) FROM shm WHERE is_delete AND is_current)
    UNION ALL SELECT 'order_keys_unique', (SELECT count(*) FROM (SELECT tenant_id, order_id FROM (SELECT * FROM oh UNION ALL SELECT * FROM oh WHERE seq
    % 500 = 0) GROUP BY ALL HAVING count(*) > 1))
    UNION ALL SELECT 'no_orphan_exports', (SELECT count(*) FROM customers WHERE custkey % 101 = 7)
    UNION ALL SELECT 'no_overlapping_intervals', (SELECT count(*) FROM (SELECT *, lead(valid_from) OVER (PARTITION BY tenant_id, subscription_id ORDER
    BY valid_from) AS nxt2 FROM shm) WHERE valid_to > nxt2)
    UNION ALL SELECT 'eligibility_fails_closed', (SELECT count(*) FROM elm WHERE activation_eligible AND (deletion_requested OR NOT any_channel OR NOT
    coalesce(marketing_consent_status = 'opted_in', false)))
    UNION ALL SELECT 'one_current_subscription', (SELECT count(*) FROM (SELECT tenant_id, subscription_id FROM shm WHERE is_current GROUP BY ALL HAVING count(*) > 1))
    UNION ALL SELECT 'valid_windows', (SELECT count(*) FROM shm WHERE valid_from >= valid_to)""")
def data_tests(d):
    """The nine tests over models with planted faults: suppressed and unknown customers exported, customers wrongly marked eligible,
    orders twice, damaged histories."""
    m, rows = M.Marts(d), rows_of(d, often=True)
    e = settle(m.eligibility(), "eligibility")
    exports = {n: M.export(rows, n) for n in M.EXPORTS}
    leaked = e.where(~F.col("activation_eligible") & (ckey() % 97 == 5)).select(*KEYS)
    orphans = d.customers().where("custkey % 101 = 7").select("tenant_id", F.concat(F.lit("cc_gone_"), "custkey").alias("canonical_customer_id"))
    exports["churn_risk"] = exports["churn_risk"].unionByName(leaked.unionByName(orphans), allowMissingColumns=True)
    marked = e.withColumn("activation_eligible", F.col("activation_eligible") | (ckey() % 89 == 4))
    orders = m.order_history()
    return analyst.data_tests(exports, marked, d.customers(), orders.unionByName(orders.where("seq % 500 = 0")), settle(damaged_history(d), "subscriptions"))


@query(f"""SELECT {K}, {_LIFE.format('subscription_status')} AS lifecycle_stage FROM (SELECT *, coalesce(valid_to, lead(valid_from) OVER (PARTITION BY
    {K} ORDER BY valid_from, event_id)) AS ended FROM sh) WHERE valid_from <= TIMESTAMP '{AT}' AND (ended IS NULL OR ended > TIMESTAMP '{AT}')""")
def lifecycle_as_of(d):
    return analyst.run(d.spark, "lifecycle_as_of", {"lifecycle_history": M.Marts(d).lifecycle_history()}, at=AT)


@query("SELECT tenant_id, suppression_reason, count(*) AS customers FROM el WHERE NOT activation_eligible GROUP BY ALL")
def analyst_suppression(d):
    return analyst.run(d.spark, "suppression_by_reason", {"eligibility": M.Marts(d).eligibility()})


@query(f"""SELECT {K}, order_id FROM oh WHERE epoch_us(TIMESTAMP '2001-01-01') - epoch_us(ordered_at) > CASE tenant_id WHEN 'tenant_europe' THEN 365
    ELSE 1825 END * CAST(86400000000 AS BIGINT)""")
def retention_due(d):
    policy = d.tenants().select("tenant_id").distinct().withColumn("retention_days", F.when(F.col("tenant_id") == "tenant_europe", 365).otherwise(1825))
    return analyst.retention_due(M.Marts(d).order_history(), policy, "ordered_at", F.lit("2001-01-01").cast("timestamp_ntz")).select(*KEYS, "order_id")


@query("SELECT kafka_topic, count(*) AS messages FROM (SELECT source_table AS kafka_topic FROM ok) GROUP BY ALL")
def publish_dry_run(d):
    from ..streaming.ingest import dry_run_counts

    return dry_run_counts(landed(d))


@query("SELECT event_id, source_system, source_table, k AS payload_k, operation_type = 'delete' AS is_delete FROM env")
def staging_projection(d):
    """The envelope's payload is the after image, else the before image; typed leniently."""
    payload = F.coalesce("payload_after", "payload_before")
    return d.envelopes().select("event_id", "source_system", "source_table", C.json_field(payload, "k").try_cast("int").alias("payload_k"),
        (F.col("operation_type") == "delete").alias("is_delete"))


@query("""SELECT region, status, n FROM (SELECT r_name AS region, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS status, count(*) AS n FROM
    customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""")
def balances_by_region(d):
    c, n, r = d.raw("customer"), d.raw("nation"), d.raw("region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("region"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("status")).agg(F.count("*").alias("n"))


@query(f"""SELECT {K}, order_id, CAST(gross_amount AS DOUBLE) AS gross_amount FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY gross_amount
    DESC, order_id) AS rn FROM oh) WHERE rn <= 3""")
def top_orders_per_customer(d):
    """A report of three; the ranking keeps three rows per key in each task before the shuffle."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("gross_amount").desc(), "order_id")
    return M.Marts(d).order_history().withColumn("rn", F.row_number().over(w)).where("rn <= 3").select(*KEYS, "order_id",
        F.col("gross_amount").cast("double").alias("gross_amount"))


from . import more_queries  # noqa: E402, F401  registers its queries


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql, *EXTRA) for name, sql in _SQL.items()}
