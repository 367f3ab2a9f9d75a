"""Column functions: normal forms, hashes, masks, keys, clamps.

All are JVM-side expressions; nulls pass through unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SALT = "kinfold"


def json_field(payload: Column, key: str) -> Column:
    """A top-level field as text; JSON null and a missing key are null."""
    return F.get_json_object(payload, f"$.{key}")


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def normalize_email(x: Column) -> Column:
    """Trimmed and lower-cased; a ``+tag`` is dropped from the part before the first ``@``; null without one."""
    mail = F.lower(F.trim(x))
    at = F.locate("@", mail)
    local = F.split_part(F.substring(mail, F.lit(1), at - 1), F.lit("+"), F.lit(1))
    return F.when(at > 0, F.concat(local, F.substring(mail, at, F.length(mail))))


def normalize_phone(x: Column) -> Column:
    """``+`` and the digits; ten digits get a leading 1, fewer are null."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when(F.length(digits) > 10, F.concat(F.lit("+"), digits))


def fuzzy_phone(x: Column) -> Column:
    """The digits, ten of them after a 1; fewer stay as they are, none are null."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).when(F.length(digits) > 0, digits)


def plain_text(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def pii_hash(x: Column, salt: str = DEFAULT_SALT) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}::"), F.lower(x.cast("string"))), 256)


def hash_email(x: Column, salt: str = DEFAULT_SALT) -> Column:
    return pii_hash(normalize_email(x), salt)


def hash_phone(x: Column, salt: str = DEFAULT_SALT) -> Column:
    return pii_hash(normalize_phone(x), salt)


def surrogate_key(*columns: Column) -> Column:
    """md5 of the columns as text, nulls empty, joined by ``||``. Cast times to text first."""
    return F.md5(F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def mask_email(x: Column) -> Column:
    """Of the normal form: first and last character of the local part, or the first alone if it has two or fewer."""
    mail = normalize_email(x)
    at = F.locate("@", mail)
    local, rest = F.substring(mail, F.lit(1), at - 1), F.substring(mail, at, F.length(mail))
    return F.when(F.length(local) <= 2, F.concat(F.left(local, F.lit(1)), F.lit("***"), rest)).otherwise(
        F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1)), rest)
    )


def mask_phone(x: Column) -> Column:
    phone = normalize_phone(x)
    return F.concat(F.left(phone, F.lit(3)), F.lit("***"), F.right(phone, F.lit(4)))


def mask_email_raw(x: Column) -> Column:
    """As in marts: first character, ``***@`` and the domain of the value as it stands."""
    return F.concat(F.left(F.split_part(x, F.lit("@"), F.lit(1)), F.lit(1)), F.lit("***@"), F.split_part(x, F.lit("@"), F.lit(2)))


def mask_phone_raw(x: Column) -> Column:
    return F.concat(F.left(x, F.lit(3)), F.lit("***"), F.right(x, F.lit(4)))


def masked_for(role: Column, x: Column, masked: Column, clear: tuple[str, ...] = ("ADMIN", "STEWARD", "ACTIVATOR")) -> Column:
    return F.when(role.isin(*clear), x).otherwise(masked)


def pii_class(field: Column) -> Column:
    """Class of a field by its name."""
    name = F.lower(field)
    return (
        F.when(name.isin("email", "phone"), "direct_contact")
        .when(name.isin("first_name", "last_name", "name", "address"), "personal")
        .when(name.isin("customer_id", "external_account_id", "device_id", "canonical_customer_id"), "pseudonymous")
        .otherwise("none")
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def total(when: Column) -> Column:
    """Rows for which a condition holds (0 over none, unlike a conditional sum)."""
    return F.count_if(when)


def hash_bucket(x: Column, n: int) -> Column:
    """First eight hex digits of sha256 as a number, modulo ``n``."""
    return F.conv(F.substring(F.sha2(x.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % n


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def health_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def lifecycle_stage(status: Column) -> Column:
    return (
        F.when(status == "canceled", "churned").when(status == "past_due", "at_risk").when(status == "active",
            "active_customer").when(status == "trialing", "trial_or_lead").otherwise("unknown")
    )


def iso_to_utc(x: Column) -> Column:
    """An ISO 8601 text (``Z`` or an offset; without one, UTC) as the same instant in UTC, ending in ``Z``; null where it is none."""
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(x), "[zZ]$", "+00:00"), "^([0-9-]{10}) ", "$1T"))
    has_zone = F.trim(x).rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    utc = F.when(has_zone, at).otherwise(F.to_utc_timestamp(at.cast("timestamp_ntz").cast("string"), F.lit("UTC")))
    text = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("Z"))


def json_text_object(*pairs: tuple[str, Column]) -> Column:
    """JSON text of (name, column) pairs in their order, nulls kept as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]), {"ignoreNullFields": "false"})


def ordered_json(**fields: Column) -> Column:
    """Canonical JSON of named columns: keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
