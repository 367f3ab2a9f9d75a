"""Reads for a principal: tenant scope, masking, pages, lookups - functions that return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mask_email, mask_phone, masked_for


@dataclass(frozen=True)
class Principal:
    subject: str
    tenants: frozenset[str] = field(default_factory=frozenset)
    scopes: frozenset[str] = field(default_factory=frozenset)
    everywhere: bool = False
    role: str = "ANALYST"


def scoped(df: DataFrame, who: Principal, tenant: str | None = None, scope: str | None = None) -> DataFrame:
    """Rows of the tenants that the principal may see; one tenant if named. Refused with PermissionError."""
    if scope is not None and scope not in who.scopes:
        raise PermissionError(f"scope {scope} is missing")
    if tenant is not None:
        if not who.everywhere and tenant not in who.tenants:
            raise PermissionError(f"tenant {tenant} is not allowed")
        return df.where(F.col("tenant_id") == tenant)
    return df if who.everywhere else df.where(F.col("tenant_id").isin(*sorted(who.tenants)))


def by_policy(df: DataFrame, policy: DataFrame, principal: str) -> DataFrame:
    """Row access by a policy table (principal, tenant_id)."""
    return df.join(policy.where(F.col("principal") == principal).select("tenant_id"), "tenant_id", "left_semi")


def masked(df: DataFrame, who: Principal) -> DataFrame:
    role, have = F.lit(who.role), set(df.columns)
    cols = {"email": mask_email, "phone": mask_phone}
    return df.withColumns({c: masked_for(role, F.col(c), f(F.col(c))) for c, f in cols.items() if c in have})


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the page, the total before it) in a total order; at most 1000 rows."""
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def lookup(df: DataFrame, who: Principal, customer: str) -> DataFrame:
    """A customer's rows; none where the customer belongs to another tenant."""
    return scoped(df, who).where(F.col("canonical_customer_id") == customer)


def profile(view: DataFrame, exports: dict[str, DataFrame], who: Principal, customer: str) -> DataFrame:
    """A customer with everything exported for it."""
    out = lookup(view, who, customer)
    for name, df in exports.items():
        keep = [c for c in df.columns if c not in view.columns and not c.startswith("hashed_")]
        out = out.join(lookup(df, who, customer).select("tenant_id", "canonical_customer_id", *keep), ["tenant_id", "canonical_customer_id"],
            "left") if keep else out
    return out


def timeline(events: DataFrame, mapping: DataFrame, who: Principal, customer: str) -> DataFrame:
    """The events of a customer's records, oldest first."""
    own = lookup(mapping, who, customer).select("tenant_id", "record_id")
    return events.join(own, (events.tenant_id == own.tenant_id) & (events.record_primary_key == own.record_id), "left_semi").orderBy("event_timestamp",
        "event_id")


def history_of(history: DataFrame, who: Principal, customer: str, at=None) -> tuple[DataFrame, DataFrame | None]:
    """(a customer's intervals, oldest first, and the one that holds at ``at``, if given)."""
    own = lookup(history, who, customer)
    held = None if at is None else own.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return own.orderBy("valid_from"), held


def identity_lineage(explanations: DataFrame, who: Principal, customer: str) -> DataFrame:
    """Why each record belongs to a customer."""
    return lookup(explanations, who, customer)


def customer_lineage(mapping: DataFrame, events: DataFrame, exports: dict[str, DataFrame], who: Principal, tenant: str, customer: str) -> DataFrame:
    """(kind, name, at): a customer's source records, their change events and the exports that name it."""
    own = scoped(mapping, who, tenant).where(F.col("canonical_customer_id") == customer)
    at = F.lit(None).cast("timestamp_ntz").alias("at")
    records = own.select(F.lit("source_record").alias("kind"), F.col("record_id").alias("name"), at)
    cond = (F.col("e.tenant_id") == F.col("m.tenant_id")) & (F.col("e.record_primary_key") == F.col("m.record_id"))
    seen = events.alias("e").join(own.alias("m"), cond, "left_semi").select(F.lit("cdc_event").alias("kind"), F.col("event_id").alias("name"),
        F.col("event_timestamp").alias("at"))
    out = records.unionByName(seen)
    for name, df in exports.items():
        here = scoped(df, who, tenant).where(F.col("canonical_customer_id") == customer)
        out = out.unionByName(here.select(F.lit("activation_output").alias("kind"), F.lit(name).alias("name"), at).distinct())
    return out


def filtered_page(df: DataFrame, who: Principal, order: list[str], tenant: str | None = None, offset: int = 0, limit: int = 100,
    **equal) -> tuple[DataFrame, DataFrame]:
    """A page, and its total, of the rows in scope whose columns have the given values; None asks for nothing."""
    rows = scoped(df, who, tenant)
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return page(rows, order, offset, limit)


def deletion_request(customers: DataFrame, requested_at, request_type: str = "gdpr_erasure") -> DataFrame:
    """Requests to erase, one per customer row: id, hashed email, queued."""
    from ..functions.columns import hash_email

    ident = F.concat(F.lit("del_"), F.substring(F.sha1(F.concat_ws("|", "tenant_id", "canonical_customer_id", F.lit(request_type))), 1, 16))
    return customers.select(ident.alias("deletion_request_id"), "tenant_id", "canonical_customer_id", hash_email(F.col("email")).alias("hashed_email"),
        F.lit(request_type).alias("request_type"), F.lit("queued").alias("status"), requested_at.alias("requested_at"))
