import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfold.operators import history


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


SCHEMA = "tenant_id string, entity string, state string, at timestamp_ntz, event_id string, is_delete boolean"
KEYS = ["tenant_id", "entity"]


@pytest.fixture
def changes(spark):
    rows = [("t", "e", s, ts(d), f"x{d}", False) for d, s in [(1, "trialing"), (3, "active"), (5, "past_due"), (7, "active"), (9, "canceled")]]
    return spark.createDataFrame(rows, SCHEMA)


def states(h, day):
    return [r.state for r in history.as_of(h, KEYS, F.lit(ts(day)).cast("timestamp_ntz"), "is_delete", "event_id").collect()]


def test_state_at_instants_without_future_leak(changes):
    h = history.scd2(changes, KEYS, "at", "event_id", "is_delete")
    assert [states(h, d) for d in (2, 4, 6, 8, 10)] == [["trialing"], ["active"], ["past_due"], ["active"], ["canceled"]]
    assert states(h, 1) == ["trialing"] and history.invariants(h, KEYS, "event_id").count() == 0


def test_late_change_and_delete(spark):
    rows = [("t", "e", "a", ts(1), "1", False), ("t", "e", "c", ts(5), "2", False), ("t", "e", "b", ts(3), "3", False), ("t", "e", "gone", ts(8), "4", True)]
    h = history.scd2(spark.createDataFrame(rows, SCHEMA), KEYS, "at", "event_id", "is_delete")
    assert states(h, 4) == ["b"] and states(h, 6) == ["c"] and states(h, 9) == []
    assert h.where("is_current").count() == 0


def test_same_entity_in_two_tenants_and_ties(spark):
    rows = [("t", "e", "a", ts(1), "1", False), ("u", "e", "b", ts(2), "2", False), ("t", "e", "z", ts(1), "9", False), (None, "e", "n", ts(1), "7", False)]
    h = history.scd2(spark.createDataFrame(rows, SCHEMA), KEYS, "at", "event_id", "is_delete")
    assert sorted((r.tenant_id, r.state) for r in h.collect()) == [("t", "z"), ("u", "b")]


def test_invariants_find_problems(spark):
    rows = [("t", "e", ts(1), None, True, "1"), ("t", "e", ts(3), ts(2), True, "2")]
    h = spark.createDataFrame(rows, "tenant_id string, entity string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, event_id string")
    assert {r.problem for r in history.invariants(h, KEYS, "event_id").collect()} == {"overlap", "invalid_window", "multiple_current"}


def test_as_of_join(spark, changes):
    h = history.scd2(changes, KEYS, "at", "event_id").select(*KEYS, "state", "valid_from", "valid_to")
    facts = spark.createDataFrame([("t", "e", 1, ts(4)), ("t", "e", 2, ts(20)), ("u", "e", 3, ts(4))],
        "tenant_id string, entity string, n int, seen timestamp_ntz")
    got = {r.n: r.state for r in history.as_of_join(facts, h, KEYS, "seen").collect()}
    assert got == {1: "active", 2: "canceled", 3: None}


def test_snapshot_opens_changes_and_closes(spark):
    cur = "id int, v string, updated timestamp_ntz"
    first = history.snapshot(spark.createDataFrame([], cur + ", snap_from timestamp_ntz, snap_to timestamp_ntz"),
        spark.createDataFrame([(1, "a", ts(1)), (2, "b", ts(1))], cur), ["id"], "updated", F.lit(ts(1)))
    second = history.snapshot(first, spark.createDataFrame([(1, "a2", ts(2)), (3, "c", ts(2))], cur), ["id"], "updated", F.lit(ts(2)).cast("timestamp_ntz"))
    got = sorted((r.id, r.v, r.snap_from.day, r.snap_to and r.snap_to.day) for r in second.collect())
    assert got == [(1, "a", 1, 2), (1, "a2", 2, None), (2, "b", 1, 2), (3, "c", 2, None)]
