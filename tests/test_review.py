import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfold.operators import identity, merge, replay, review
from kinfold.plans import access, activation, staging
from kinfold.runtime import Versioned
from kinfold.sources import files

T = dt.datetime(2024, 1, 1)


@pytest.fixture
def queue(spark, tmp_path):
    at = lambda name, schema: Versioned(spark, f"{tmp_path}/{name}", schema)
    q = review.ReviewQueue(at("cases", review.CASE), at("map", review.MAP), at("audit", review.AUDIT))
    q.mapping.replace(spark.createDataFrame([("a", "app", "1", "x"), ("a", "app", "2", "y"), ("b", "app", "1", "y")], review.MAP))
    rows = [("m", "a", "x", "y", None, None, T), ("u", "a", "x", None, "app", "1", T + dt.timedelta(1)), ("n", "b", "x", "z", None, None, T)]
    q.create(spark.createDataFrame([(*r, "OPEN") for r in rows],
        "case_id string, tenant_id string, canonical_customer_id string, candidate_customer_id string, source_system string, source_record_id string, created_at timestamp_ntz, status string"))
    return q


def names(q):
    return {(r.tenant_id, r.record_id): r.canonical_customer_id for r in q.mapping.read().collect()}


def test_list_and_get(queue):
    rows, total = queue.list("a")
    assert [r.case_id for r in rows.collect()] == ["m", "u"] and total == 2 and queue.list(status="RESOLVED")[1] == 0
    assert [r.case_id for r in queue.list(limit=1, offset=1)[0].collect()] == ["n"]
    assert queue.get("m")["status"] == "OPEN" and queue.get("m", "b") is None and queue.get("?") is None


def test_a_merge_is_applied_once_and_within_its_tenant(queue):
    with pytest.raises(ValueError):
        queue.decide("m", "APPROVE_MERGE", "ann", "same", T)  # OPEN can't become APPROVED
    queue.decide("m", "NEEDS_REVIEW", "ann", "look", T)
    done = queue.decide("m", "APPROVE_MERGE", "ann", "same", T, "a")
    assert done["status"] == "APPROVED" and names(queue) == {("a", "1"): "x", ("a", "2"): "x", ("b", "1"): "y"}
    before = queue.cases.version()
    assert queue.decide("m", "APPROVE_MERGE", "ann", "same", T) == done and queue.cases.version() == before
    assert [(r.kind, r.from_id, r.to_id) for r in queue.audit.read().collect()] == [("merge", "y", "x")]
    end = queue.decide("m", "IGNORE_FALSE_POSITIVE", "ann", "closed", T)
    assert end["status"] == "RESOLVED" and end["resolved_at"] == T


def test_an_unmerge_touches_one_row(queue):
    queue.decide("u", "NEEDS_REVIEW", "ann", "look", T)
    queue.decide("u", "APPROVE_UNMERGE", "ann", "two people", T)
    n = names(queue)
    assert n[("a", "1")].startswith("cc_unmerge_") and n[("a", "2")] == "y" and n[("b", "1")] == "y"


def test_decisions_that_are_refused(queue):
    with pytest.raises(review.CaseNotFound):
        queue.decide("m", "NEEDS_REVIEW", "ann", "look", T, "b")
    with pytest.raises(ValueError):
        queue.decide("m", "WHATEVER", "ann", "look", T)
    queue.decide("n", "NEEDS_REVIEW", "ann", "look", T)
    with pytest.raises(ValueError):
        queue.decide("n", "APPROVE_MERGE", "ann", "no rows of z", T)
    assert queue.get("n")["status"] == "IN_REVIEW" and queue.audit.read().count() == 0


def test_creating_again_keeps_the_time(spark, queue):
    queue.create(spark.createDataFrame([("m", "a", "OPEN", T + dt.timedelta(9), 0.6)],
        "case_id string, tenant_id string, status string, created_at timestamp_ntz, match_confidence double"))
    assert queue.list()[1] == 3 and queue.get("m")["created_at"] == T and queue.get("m")["match_confidence"] == 0.6


def test_replay_writes_resets_and_ingests_again(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i}", "t", "s", "orders" if i % 2 else "carts", f"b{i % 3}", T + dt.timedelta(i)) for i in range(9)],
        "event_id string, tenant_id string, source_system string, source_table string, batch_id string, event_timestamp timestamp_ntz")
    marks = spark.createDataFrame([("t", "s", "orders", 5), ("t", "s", "carts", 6)], "tenant_id string, source_system string, source_table string, n int")
    got = []
    manifest, left, alerts = replay.run_replay(e, "r1", F.lit(T), f"{tmp_path}/out", tables=["orders"], checkpoints=marks,
        again=lambda df: got.extend(r.event_id for r in df.collect()))
    m = manifest.first()
    assert (m.selected_count, m.status, m.reset_checkpoints, m.source_tables) == (4, "success", True, "orders") and sorted(got) == ["e1", "e3", "e5", "e7"]
    assert [r.source_table for r in left.collect()] == ["carts"] and [r.alert for r in alerts.collect()] == ["checkpoint_reset"]
    dry, left, _ = replay.run_replay(e, "r2", F.lit(T), start=F.lit(T + dt.timedelta(3)), end=F.lit(T + dt.timedelta(5)), dry_run=True, checkpoints=marks)
    assert dry.first().selected_count == 2 and dry.first().status == "dry_run" and left is None
    with pytest.raises(ValueError):
        replay.run_replay(e, "r3", F.lit(T))


def test_map_history_versions(spark):
    rec = spark.createDataFrame([("t", "1", T, False), ("t", "2", T, True), ("t", "3", T, False)],
        "tenant_id string, record_id string, updated_at timestamp_ntz, is_delete boolean")
    res = lambda *ids: spark.createDataFrame([("t", str(i + 1), c) for i, c in enumerate(ids)],
        "tenant_id string, record_id string, canonical_customer_id string")
    first = identity.map_history(None, rec.where("record_id < '3'"), res("x", "y"), F.lit(T))
    assert {(r.record_id, r.version, r.is_current) for r in first.collect()} == {("1", 1, True), ("2", 1, False)}
    second = identity.map_history(first, rec, res("z", "y", "z"), F.lit(T + dt.timedelta(1))).collect()
    assert {(r.record_id, r.version, r.canonical_customer_id, r.valid_to is None, r.is_current) for r in second} == {("1", 1, "x", False, False),
        ("1", 2, "z", True, True), ("2", 1, "y", True, False), ("3", 1, "z", True, True)}


def test_a_tie_of_survivors_goes_to_the_first_record(spark):
    rows = [("t", r, "account_app", e, T, False) for r, e in (("b", "b@z"), ("a", "a@z"), ("c", "c@z"))]
    rec = spark.createDataFrame(rows, "tenant_id string, record_id string, source_system string, email string, updated_at timestamp_ntz, is_delete boolean")
    x = rec.select("tenant_id", "record_id", F.lit("cc").alias("canonical_customer_id"))
    assert identity.survivors(rec, x, ["email"]).first().email == "a@z"


def test_steward_sees_no_identifier(spark):
    c = spark.createDataFrame([("1", "a@z.com", 0.8, 0), ("2", "a@z.com", 0.8, 1), ("3", "a@z.com", 0.1, 0)],
        "case_id string, email string, score double, conflicts int")
    out = identity.assist(c)
    assert "email" not in out.columns and {r.case_id: r.recommendation for r in out.collect()} == {"1": "MERGE", "2": "NEEDS_MORE_INFORMATION",
        "3": "DO_NOT_MERGE"}


def test_a_later_export_is_updated_and_a_missing_field_fails(spark):
    dest = activation.DESTINATIONS[1]
    row = [("t", f"cc_{i}", "h", None, None if i == 3 else "high_value") for i in range(40)]
    rows = spark.createDataFrame(row, "tenant_id string, canonical_customer_id string, hashed_email string, hashed_phone string, customer_segment string")
    at = lambda day: rows.withColumn("export_timestamp", F.lit(f"2024-01-0{day}"))
    first = activation.sync_rows(at(1), None, dest)
    state = activation.sync_state(None, first)
    count = lambda df: {r.status: r["count"] for r in df.groupBy("status").count().collect()}
    assert set(count(activation.sync_rows(at(1), state, dest))) == {"skipped_unchanged",
        "failed"} and set(count(activation.sync_rows(at(2), state, dest))) == {"updated", "failed"}
    why = {r.canonical_customer_id: r.failure_reason for r in first.where("status = 'failed'").collect()}
    assert why["cc_3"] == "destination_contract_missing_fields:customer_segment"
    none = activation.sync_rows(rows, None, dest)
    assert count(none) == {"failed": 40} and "export_timestamp" in none.first().failure_reason
    assert activation.failed_rows(first, "r", F.lit(T)).where("is_retryable").count() == 0 and activation.payload_audit(first, "r", F.lit(T)).count() == 40


def test_pages_and_profiles_stay_in_scope(spark):
    who = access.Principal("ann", frozenset({"t"}))
    rows = spark.createDataFrame([("t", "x", "a", 1), ("t", "y", "b", 2), ("u", "z", "a", 3)],
        "tenant_id string, canonical_customer_id string, destination string, n int")
    page, total = access.filtered_page(rows, who, ["n"], destination="a")
    assert [r.n for r in page.collect()] == [1] and total.first().total == 1
    with pytest.raises(PermissionError):
        access.filtered_page(rows, who, ["n"], tenant="u")
    export = spark.createDataFrame([("t", "x", "seg", "hash")], "tenant_id string, canonical_customer_id string, segment string, hashed_email string")
    p = access.profile(rows, {"e": export}, who, "x").first()
    assert p.segment == "seg" and "hashed_email" not in p.asDict() and access.profile(rows, {}, who, "z").count() == 0
    events = spark.createDataFrame([("t", "r1", "e1", T), ("t", "r2", "e2", T), ("u", "r1", "e3", T)],
        "tenant_id string, record_primary_key string, event_id string, event_timestamp timestamp_ntz")
    mapping = spark.createDataFrame([("t", "r1", "x"), ("u", "r1", "x")], "tenant_id string, record_id string, canonical_customer_id string")
    assert [r.event_id for r in access.timeline(events, mapping, who, "x").collect()] == ["e1"]


def test_changes_applied_to_a_table(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    e = spark.createDataFrame([(1, "x", 1, "update"), (1, "y", 2, "update"), (2, "b", 3, "DELETE"), (4, "n", 4, "insert"), (5, "q", 5, "insert"),
        (5, "q", 6, "delete")], "k int, v string, n int, operation_type string")
    assert sorted(map(tuple, merge.apply_changes(t, e, ["k"], "n").collect())) == [(1, "y"), (3, "c"), (4, "n")]


def test_staged_values_that_types_cannot_hold(spark):
    e = spark.createDataFrame([("1", "s", "orders", "k", "INSERT", None, '{"gross_amount":"12.5","ordered_at":"2024-01-01T10:00:00","email":" "}'),
        ("2", "s", "orders", "k", "delete", '{"gross_amount":"x"}', None), ("3", "s", "carts", "k", "insert", None, "{}")],
            "event_id string, source_system string, source_table string, record_primary_key string, operation_type string, payload_before string, payload_after string")
    a, b = staging.staged(e, "orders").orderBy("event_id").collect()
    assert float(a.gross_amount) == 12.5 and a.ordered_at == dt.datetime(2024, 1, 1,
        10) and a.email is None and not a.is_delete and b.gross_amount is None and b.is_delete


def test_appended_runs_replace_themselves(spark, tmp_path):
    for n in (1, 2, 3):
        files.append_run(spark.range(n), f"{tmp_path}/log", "r1" if n < 3 else "r2")
    assert {r.run_id: r["count"] for r in spark.read.parquet(f"{tmp_path}/log").groupBy("run_id").count().collect()} == {"r1": 2, "r2": 3}
