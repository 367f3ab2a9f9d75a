import datetime as dt
import json

from pyspark.sql import functions as F

from kinfold.plans import analyst


def test_health_checks_and_events(spark):
    some, none = spark.range(2), spark.range(0)
    got = {r.check: r.status for r in analyst.health_checks({"a": some, "b": none}, {"c": none, "d": some}).collect()}
    assert got == {"a_not_empty": "pass", "b_not_empty": "fail", "c_empty": "pass", "d_empty": "fail"}
    jobs = spark.createDataFrame([("load", ["x"], ["y"])], "job_name string, inputs array<string>, outputs array<string>")
    events = analyst.run_events(jobs, F.lit(dt.datetime(2024, 1, 1))).collect()
    assert [e.event_type for e in events] == ["START", "COMPLETE"] and len({json.loads(e.event)["run"]["runId"] for e in events}) == 1


def test_retention_and_rules(spark):
    rows = spark.createDataFrame([("t", dt.datetime(2024, 1, 1)), ("t", dt.datetime(2024, 3, 1)), ("u", dt.datetime(2020, 1, 1))],
        "tenant_id string, at timestamp_ntz")
    policy = spark.createDataFrame([("t", 30)], "tenant_id string, retention_days int")
    assert analyst.retention_due(rows, policy, "at", F.lit("2024-03-02").cast("timestamp_ntz")).count() == 1
    assert analyst.survivorship_rules(spark).agg(F.max("priority")).first()[0] == 100


def test_named_sql_binds_its_arguments(spark):
    h = spark.createDataFrame([("t", "s", "active", dt.datetime(2024, 1, 1), None)],
        "tenant_id string, subscription_id string, subscription_status string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert analyst.run(spark, "subscriptions_as_of", {"subscription_history": h}, at="2024-01-02").count() == 1
    assert analyst.run(spark, "subscriptions_as_of", {"subscription_history": h}, at="2023-01-02").count() == 0
