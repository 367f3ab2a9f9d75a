"""Drift scenarios, incidents and the seeded source."""

import datetime as dt
import json

from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import cdc, identity, quality
from kinfold.plans import activation
from kinfold.sources import manifest, seeded
from kinfold.streaming import ingest as I

T = dt.datetime(2024, 1, 1)
CONTRACTS = {
    "customers": {"required": ["customer_id"], "types": {"customer_id": "string", "email": "string"}, "nullable": ["email"]},
    "subscriptions": {"required": ["subscription_status"], "types": {"subscription_status": "string"},
        "enums": {"subscription_status": ["active", "canceled"]}},
    "engagement_events": {"required": ["event_count"], "types": {"event_count": "integer"}},
}
ENV = "event_id string, tenant_id string, source_system string, source_table string, operation_type string, event_timestamp timestamp_ntz, record_primary_key string, payload_before string, payload_after string, batch_id string, schema_version int"


def envelope(n, table, payload):
    return (f"e{n}", "t", "s", table, "insert", T, "k", None, json.dumps(payload), "b", 1)


def test_drift_scenarios(spark):
    sent = {
        "additive_optional_field": ("customers", {"customer_id": "c", "loyalty_tier": "gold"}, True),
        "removed_required_field": ("customers", {"email": "a@z"}, False),
        "renamed_nullable_field": ("customers", {"customer_id": "c", "account_email": "a@z"}, True),
        "invalid_enum_value": ("subscriptions", {"subscription_status": "paused_forever"}, False),
        "numeric_type_changed_to_string": ("engagement_events", {"event_count": "five"}, False),
    }
    df = spark.createDataFrame([envelope(n, t, p) for n, (t, p, _) in sent.items()], ENV)
    got = {r.event_id[1:]: r.reject_category is None for r in cdc.classify(df, tuple(CONTRACTS), CONTRACTS).collect()}
    assert got == {n: ok for n, (_, _, ok) in sent.items()}


def test_incident_breaking_contract(spark):
    less = {**CONTRACTS, "customers": {**CONTRACTS["customers"], "required": []}}
    diff = cdc.contract_diff(cdc.contract_rows(spark, CONTRACTS), cdc.contract_rows(spark, less))
    assert {r.source_table: r.status for r in cdc.contract_summary(diff).collect()} == {"customers": "breaking"}


def test_incident_repeated_delivery(spark):
    df = spark.createDataFrame([(0, "e1", "h"), (1, "e2", "h")],
        "arrival_ordinal long, event_id string, event_hash string").withColumns({"kafka_topic": F.lit(None).cast("string"),
            "kafka_partition": F.lit(None).cast("int"), "kafka_offset": F.lit(None).cast("bigint")})
    assert {r.event_id: r.duplicate_key for r in cdc.mark_duplicates(df).collect()} == {"e1": None, "e2": "event_hash"}


def test_incident_shared_device_and_tenants(spark):
    rec = "tenant_id string, record_id string, customer_id string, email string, device_id string"
    r = spark.createDataFrame([("a", "1", "c1", None, "d"), ("a", "2", "c2", None, "d"), ("a", "3", None, "p@z.com", None),
        ("b", "4", None, "p@z.com", None)], rec)
    t = identity.tokens(r)
    x = identity.resolve(t, r)
    assert identity.review_cases(identity.weak_links(t, x)).count() == 1 and x.select("canonical_customer_id").distinct().count() == 4


def test_incident_missing_disposition(spark):
    el = spark.createDataFrame([("t", f"c{i}", True, None) for i in range(10)],
        "tenant_id string, canonical_customer_id string, activation_eligible boolean, suppression_reason string")
    out = spark.createDataFrame([("d", "t", f"c{i}", "inserted") for i in range(9)],
        "destination string, tenant_id string, canonical_customer_id string, status string")
    assert activation.reconcile(out, out, el).first().variance == 1


def test_incident_stale_table(spark):
    df = spark.createDataFrame([("t", T), ("u", T + dt.timedelta(days=3))], "tenant_id string, at timestamp_ntz")
    got = quality.freshness(df, ["tenant_id"], F.col("at"), F.lit(T + dt.timedelta(days=3, minutes=5)), 1440)
    assert {r.tenant_id: r.status for r in got.collect()} == {"t": "stale", "u": "fresh"}


def test_seeded_events(spark):
    e = seeded.events(spark, people=7, days=5)
    rows = e.collect()
    assert sorted(map(str, rows)) == sorted(map(str, seeded.events(spark, people=7, days=5).repartition(3).collect())) != sorted(map(str,
        seeded.events(spark, seed=1, people=7, days=5).collect()))
    assert len(rows) == 35 == len({r.event_id for r in rows}) == len({r.arrival_ordinal for r in rows})
    from kinfold.sources.bridge import SYSTEMS

    bad = cdc.classify(e, tuple(SYSTEMS)).where("reject_category is not null").collect()
    assert [r.reject_category for r in bad] == ["UNKNOWN_OPERATION"]
    last = max(rows, key=lambda r: r.arrival_ordinal)
    assert last.event_timestamp < max(r.event_timestamp for r in rows) and last.event_id == "evt_28"
    assert [r.reason for r in manifest.unexpected(e).collect()] == ["other_operation"]
    odd = e.limit(3).withColumns({"source_table": F.lit("carts")})
    assert {r.reason for r in manifest.unexpected(odd).collect()} == {"unknown_table"} and manifest.manifest(spark).count() == 6


def test_events_are_loaded_leniently(spark, tmp_path):
    rows = [{"event_id": "1", "tenant_id": "t", "source_system": "s", "source_table": "customers", "operation_type": "insert",
        "event_timestamp": "2024-01-01T00:00:00", "record_primary_key": "k", "payload_after": "{}", "batch_id": "b", "schema_version": v} for v in (1, 9)]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    assert cdc.load_events(spark, str(tmp_path / "e.jsonl"), I.WIRE, ("customers",)).count() == 1


def test_fuzzy_phones(spark):
    df = spark.createDataFrame([("(555) 123-4567",), ("123",), ("+44 20 7946 0000 1",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(C.fuzzy_phone(F.col("p"))).collect()] == ["15551234567", "123", "4420794600001", None, None]


def test_the_newest_record_with_a_payload(spark):
    rows = [("t", "s", "k", "e1", T, '{"a":1}', None), ("t", "s", "k", "e2", T, None, '{"a":2}'), ("t", "s", "k", "e3", T, "{}", None),
        ("t", "s", "j", "e4", T, None, None)]
    df = spark.createDataFrame(rows, "tenant_id string, source_system string, record_primary_key string, event_id string, event_timestamp timestamp_ntz, payload_after string, payload_before string")
    assert [(r.record_primary_key, r.event_id, r.payload) for r in identity.latest_records(df).collect()] == [("k", "e2", '{"a":2}')]


def test_classes_of_fields_and_policies(spark):
    from kinfold.plans import access, analyst

    df = spark.createDataFrame([("Email",), ("last_name",), ("device_id",), ("mrr",)], "f string")
    assert [r[0] for r in df.select(C.pii_class(F.col("f"))).collect()] == ["direct_contact", "personal", "pseudonymous", "none"]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, n int")
    policy = spark.createDataFrame([("ann", "a"), ("bob", "b")], "principal string, tenant_id string")
    assert [r.n for r in access.by_policy(rows, policy, "ann").collect()] == [1] and access.by_policy(rows, policy, "eve").count() == 0
    checks = {r.check: r.status for r in analyst.health_checks({"rows": rows, "none": rows.limit(0)}, {"bad": rows}).collect()}
    assert checks == {"rows_not_empty": "pass", "none_not_empty": "fail", "bad_empty": "fail"}
    jobs = spark.createDataFrame([("j", ["a"], ["b"])], "job_name string, inputs array<string>, outputs array<string>")
    events = [json.loads(r.event) for r in analyst.run_events(jobs, F.lit(T)).collect()]
    assert [e["eventType"] for e in events] == ["START", "COMPLETE"] and len({e["run"]["runId"] for e in events}) == 1 and events[0]["inputs"] == ["a"]
    assert analyst.survivorship_rules(spark).count() == len(identity.PRIORITY) and identity.match_rules(spark).count() == 6
