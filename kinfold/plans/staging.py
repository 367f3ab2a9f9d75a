"""Typed projections of change events, one per source table: JSON fields read leniently, blanks as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, json_field

#: Per table: the name of its record key, then its payload fields as (field, kind[, column]). ``mail`` is lower-cased, ``filled`` has
#: blanks as nulls, ``flag`` is false where it is missing; the other kinds are types.
FIELDS: dict[str, tuple[str, list[tuple]]] = {
    "customers": (
        "source_customer_id",
        [
            ("customer_id", "text"), ("email", "mail"), ("phone", "filled"), ("external_account_id", "text"), ("first_name", "text"),
                ("last_name", "text"), ("tenant_id", "text"), ("business_unit", "text"),
            ("customer_status", "text"), ("updated_at", "timestamp", "source_updated_at"),
        ],
    ),
    "subscriptions": (
        "source_subscription_id",
        [
            ("subscription_id", "text"), ("tenant_id", "text"), ("business_unit", "text"), ("customer_id", "text"), ("external_account_id", "text"),
                ("email", "mail"), ("plan_name", "text"),
            ("subscription_status", "text"), ("billing_period", "text"), ("mrr", "decimal(18,2)"), ("start_date", "timestamp"),
                ("cancel_at", "timestamp"), ("updated_at", "timestamp", "source_updated_at"),
        ],
    ),
    "orders": (
        "source_order_id",
        [
            ("order_id", "text"), ("tenant_id", "text"), ("business_unit", "text"), ("order_customer_ref", "text"), ("email", "mail"),
                ("subscription_id", "text"), ("order_status", "text"),
            ("gross_amount", "decimal(18,2)"), ("currency", "text"), ("ordered_at", "timestamp"), ("updated_at", "timestamp", "source_updated_at"),
        ],
    ),
    "engagement_events": (
        "source_engagement_event_id",
        [
            ("engagement_event_id", "text"), ("tenant_id", "text"), ("business_unit", "text"), ("device_id", "text"), ("customer_id", "text"),
                ("email", "mail"), ("event_name", "text"), ("event_count", "int"),
            ("session_minutes", "int"), ("event_timestamp", "timestamp", "activity_at"),
        ],
    ),
    "support_interactions": (
        "source_support_interaction_id",
        [
            ("support_interaction_id", "text"), ("tenant_id", "text"), ("business_unit", "text"), ("support_customer_ref", "text"), ("email", "mail"),
                ("phone", "text"), ("reason", "text"), ("priority", "text"),
            ("status", "text"), ("csat_score", "int"), ("created_at", "timestamp"), ("updated_at", "timestamp", "source_updated_at"),
        ],
    ),
    "marketing_engagement": (
        "source_marketing_touch_id",
        [
            ("marketing_touch_id", "text"), ("tenant_id", "text"), ("business_unit", "text"), ("email", "mail"), ("external_account_id", "text"),
                ("channel", "text"), ("campaign_id", "text"), ("engagement_status", "text"),
            ("marketing_consent_status", "text"), ("email_opt_in", "flag"), ("sms_opt_in", "flag"), ("push_opt_in", "flag"),
                ("unsubscribe_status", "text"), ("do_not_contact_flag", "flag"), ("lead_score", "int"),
            ("occurred_at", "timestamp"), ("updated_at", "timestamp", "source_updated_at"),
        ],
    ),
}
ENVELOPE = ("event_id", "source_system", "operation_type", "event_timestamp", "event_sequence_number", "batch_id")


def _typed(payload: Column, field: str, kind: str) -> Column:
    raw = json_field(payload, field)
    if kind == "text":
        return raw
    filled = blank_to_null(raw)
    if kind == "filled":
        return filled
    if kind == "mail":
        return F.lower(filled)
    if kind == "flag":
        return F.coalesce(filled.try_cast("boolean"), F.lit(False))
    return filled.try_cast("timestamp_ntz" if kind == "timestamp" else kind)


def staged(events: DataFrame, table: str) -> DataFrame:
    """The events of one source table: what the envelope says, the payload's fields typed, and whether it is a delete.

    The payload is the after image, else the before image. A value that its type can't hold is null, as a blank is. The envelope
    columns come under their own names; of its event time there is ``event_timestamp``.
    """
    key, fields = FIELDS[table]
    payload = F.coalesce("payload_after", "payload_before")
    here = [c for c in ENVELOPE if c in events.columns]
    return events.where(F.col("source_table") == table).select(
        *here, F.col("record_primary_key").alias(key), *[_typed(payload, f[0], f[1]).alias(f[-1] if len(f) == 3 else f[0]) for f in fields],
            (F.lower("operation_type") == "delete").alias("is_delete")
    )
