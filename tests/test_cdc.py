import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinfold.operators import cdc, merge

T = dt.datetime(2024, 1, 1)
SCHEMA = (
    "event_id string, tenant_id string, source_system string, source_table string, operation_type string, event_timestamp timestamp_ntz, record_primary_key string, payload_before string, payload_after string, "
    "batch_id string, schema_version int, event_sequence_number long, event_hash string, kafka_topic string, kafka_partition int, kafka_offset long, arrival_ordinal long, commit_us long"
)
TABLES = ("customers", "orders")
CONTRACTS = {"customers": {"required": ["customer_id", "customer_status"], "nullable": ["email"],
    "types": {"customer_id": "string", "email": "string", "score": "number", "age": "integer", "vip": "boolean"},
        "enums": {"customer_status": ["lead", "active"]}}}


def event(n, **over):
    row = dict(
        event_id=f"e{n}", tenant_id="t", source_system="s", source_table="customers", operation_type="insert",
            event_timestamp=T + dt.timedelta(minutes=n), record_primary_key="k", payload_before=None,
        payload_after=json.dumps({"customer_id": "c", "customer_status": "lead", "score": 1.5, "age": 3, "vip": True}), batch_id="b", schema_version=1,
            event_sequence_number=n, event_hash=f"h{n}", kafka_topic="x", kafka_partition=0, kafka_offset=n, arrival_ordinal=n, commit_us=n,
    )
    return tuple((row | over)[c.split()[0]] for c in SCHEMA.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_reject_classes(spark):
    body = lambda **k: json.dumps({"customer_id": "c", "customer_status": "lead", "score": 1, "age": 3, "vip": True} | k)
    cases = {
        "SCHEMA_INVALID": [dict(source_system=None), dict(source_table="nope"), dict(payload_after=body(customer_status="odd")),
            dict(payload_after=body(customer_id=5)), dict(payload_after=body(vip=1)), dict(payload_after=body(age=1.5)),
                dict(payload_after=body(customer_id=None)), dict(payload_after="{not json")],
        "UNKNOWN_OPERATION": [dict(operation_type="upsert")], "UNSUPPORTED_SCHEMA_VERSION": [dict(schema_version=99)],
            "MISSING_SOURCE_KEY": [dict(record_primary_key=""), dict(record_primary_key="None"), dict(record_primary_key=None)],
        "INVALID_TENANT": [dict(tenant_id=None)], "INVALID_PAYLOAD": [dict(payload_after=None), dict(operation_type="delete")],
        None: [dict(), dict(operation_type="UPDATE"), dict(payload_after=body(extra=1, email=None)),
            dict(operation_type="delete", payload_before=body()), dict(source_table="orders", payload_after="{}")],
    }
    rows, want, n = [], {}, 0
    for category, overs in cases.items():
        for over in overs:
            rows.append(event(n, **over))
            want[f"e{n}"] = category
            n += 1
    got = cdc.classify(frame(spark, *rows), TABLES, CONTRACTS)
    assert {r.event_id: r.reject_category for r in got.collect()} == want
    dead = cdc.rejection_records(got, "normalization", F.lit(T))
    assert dead.count() == sum(1 for v in want.values() if v) and json.loads(dead.first().raw_event)["batch_id"] == "b"


def test_repair_makes_upserts_pass(spark):
    bad = frame(spark, event(1, operation_type="upsert", payload_after='{"customer_id":"c","customer_status":""}'))
    row = cdc.classify(cdc.repair(bad, {"customers": {"customer_status": "lead"}}), TABLES, {"customers": {"required": ["customer_status"]}}).first()
    assert row.reject_category is None and row.operation_type == "insert" and row.repair_actions == ["operation_from_upsert",
        "default_customer_status"] and row.batch_id == "b_dlq_reprocessed"


def test_duplicates_by_each_key_and_greedily(spark):
    four = frame(spark, event(1), event(2, event_id="e1"), event(3, event_hash="h1"), event(4, kafka_offset=1))
    assert [r.duplicate_key for r in cdc.mark_duplicates(four).orderBy("arrival_ordinal").collect()] == [None, "event_id", "event_hash", "kafka_offset"]
    greedy = frame(spark, event(1), event(2, event_id="e1", event_hash="H"), event(3, event_hash="H"))
    assert [r.duplicate_key for r in cdc.mark_duplicates(greedy).orderBy("arrival_ordinal").collect()] == [None, "event_id", None]


def test_late_event_is_an_anomaly_and_state_is_protected(spark):
    rows = frame(spark, event(1, event_sequence_number=20), event(2, event_sequence_number=10), event(3, event_sequence_number=30, commit_us=0),
        event(4, event_sequence_number=0, commit_us=9))
    got = {r.arrival_ordinal: r.anomaly for r in cdc.ordering_anomalies(rows, ["tenant_id", "record_primary_key"]).collect()}
    assert got == {2: "out_of_order_sequence", 3: "late_arriving_commit"}
    assert cdc.latest_state(rows, ["record_primary_key"]).first().event_sequence_number == 30


def test_contract_diff(spark):
    old = {"a": {"required": ["x"], "types": {"x": "string", "y": "number"}, "enums": {"s": ["p", "q"]}}, "gone": {"required": ["k"]}}
    new = {"a": {"required": [], "nullable": ["z"], "types": {"x": "integer", "n": "string"}, "enums": {"s": ["q", "r"]}}, "fresh": {}}
    d = cdc.contract_diff(cdc.contract_rows(spark, old), cdc.contract_rows(spark, new))
    got = {(r.source_table, r.kind, r.field, r.value, r.change): r.verdict for r in d.collect()}
    assert got == {
        ("a", "required", "x", "", "removed"): "breaking", ("a", "nullable", "z", "", "added"): "compatible",
            ("a", "type", "x", "integer", "changed"): "breaking", ("a", "type", "y", "number", "removed"): "review",
        ("a", "type", "n", "string", "added"): "compatible", ("a", "enum", "s", "p", "removed"): "breaking",
            ("a", "enum", "s", "r", "added"): "review", ("gone", "table", "", "", "removed"): "breaking", ("fresh", "table", "", "", "added"): "compatible",
    }
    assert {r.source_table: r.status for r in cdc.contract_summary(d).collect()} == {"a": "breaking", "gone": "breaking", "fresh": "compatible"}


def test_debezium(spark):
    body = {"op": "u", "ts_ms": 1, "source": {"connector": "postgresql", "db": "d", "schema": "public", "table": "orders", "lsn": 77, "txId": 5,
        "ts_ms": 1704067200000}, "before": None, "after": {"order_id": "o1", "gross_amount": "12.50", "tenant_id": "t"}}
    msgs = spark.createDataFrame([(json.dumps({"payload": body}), "x.public.orders"),
        (json.dumps(body | {"op": "d", "before": {"order_id": "o2"}, "after": None}), "x.public.orders")], "value string, topic string")
    a, b = cdc.from_debezium(msgs, {"orders": "commerce_platform"}, {"orders": "order_id"}).orderBy("record_primary_key").collect()
    assert (a.operation_type, a.record_primary_key, a.tenant_id, a.source_system, a.event_sequence_number) == ("update", "o1", "t", "commerce_platform", 77)
    assert json.loads(a.payload_after)["gross_amount"] == "12.50" and a.event_id.startswith("dbz_") and len(a.event_id) == 28 and a.batch_id == "debezium_20240101"
    assert (b.operation_type, b.payload_after, b.tenant_id) == ("delete", None, "tenant_unknown")


def test_replay_and_checkpoints(spark):
    ev = frame(spark, event(1), event(2, batch_id="c"), event(3, source_table="orders"))
    r = cdc.select_replay(ev, "r1", start=F.lit(T), end=F.lit(T + dt.timedelta(minutes=3)), tables=["customers"])
    assert sorted(x.event_id for x in r.collect()) == ["e1", "e2"] and r.where("is_replay and replay_batch_id = 'r1'").count() == 2
    marks = cdc.watermarks(ev)
    left, alerts = cdc.reset_checkpoints(marks, r)
    assert [x.source_table for x in left.collect()] == ["orders"] and alerts.count() == 1
    assert cdc.offset_checkpoints(ev).first().last_offset == 3


def test_merge(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, v int, s string")
    new = spark.createDataFrame([(1, 4, "late"), (2, 5, "same"), (3, 1, "new"), (3, 2, "newer")], "k int, v int, s string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], "v").collect())) == [(1, 5, "a"), (2, 5, "same"), (3, 2, "newer")]
    assert sorted(r.k for r in merge.insert_ignore(old, new, ["k"], ["s"]).collect()) == [3, 3]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    ev = frame(spark, *[event(i) for i in range(n)]) if n else spark.createDataFrame([], SCHEMA)
    assert cdc.mark_duplicates(ev).count() == n and cdc.ordering_anomalies(ev,
        ["tenant_id"]).count() == 0 and cdc.ingestion_summary(cdc.classify(ev, TABLES)).count() == n
