import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinfold.operators import quality
from kinfold.plans import access, activation, marts, registry
from kinfold.sources.bridge import Domain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")


def test_every_query_with_sql_is_registered():
    sql = registry.oracle_sql()
    assert set(sql) <= set(registry.QUERIES) and len(sql) >= 60


def test_flagship_has_one_row_per_customer(spark):
    v = registry.QUERIES["customer_360_current"](spark, SF)
    d = Domain(spark, SF)
    assert v.count() == d.customers().count() and v.where("health_score not between 0 and 100 or churn_risk_score <> 100 - health_score").count() == 0


def test_eligibility_fails_closed(spark):
    e = marts.Marts(Domain(spark, SF)).eligibility()
    assert e.where("activation_eligible and (deletion_requested or not any_channel or marketing_consent_status is null or marketing_consent_status <> 'opted_in' or suppression_reason is not null)").count() == 0
    assert e.where("not activation_eligible and suppression_reason is null").count() == 0


def rows(spark, n=60):
    return spark.range(n).select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("c"), "id").alias("canonical_customer_id"),
            F.when(F.col("id") != 3, F.lit("h")).alias("hashed_email"), F.lit(None).cast("string").alias("hashed_phone"), F.lit("seg").alias("customer_segment")
    )


def test_sync_is_idempotent_and_reconciles(spark):
    dest = ("hubspot", "customer_segment", 5, 3, ["canonical_customer_id", "customer_segment"])
    r = rows(spark)
    first = activation.sync_rows(r, None, dest)
    state = activation.sync_state(None, first)
    again = activation.sync_rows(r, state, dest)
    ok = first.where("status = 'inserted'").count()
    assert again.where("status = 'skipped_unchanged'").count() == ok and again.where("status in ('inserted', 'updated')").count() == 0
    changed = activation.sync_rows(r.withColumn("customer_segment", F.lit("other")), state, dest)
    assert changed.where("status = 'updated'").count() == ok
    assert first.where("canonical_customer_id = 'c3'").first().status == "failed"
    el = r.select("tenant_id", "canonical_customer_id", F.lit(True).alias("activation_eligible"), F.lit(None).cast("string").alias("suppression_reason"))
    exported = r.select("tenant_id", "canonical_customer_id", "hashed_email", "hashed_phone", F.lit("hubspot").alias("destination"))
    assert activation.reconcile(first, exported, el).first().variance == 0
    kinds = lambda *a: {x.finding for x in activation.findings(*a).collect()}
    assert kinds(exported, first, el) == {"missing_hashed_identifier"}
    no = el.withColumn("activation_eligible", F.col("canonical_customer_id") != "c1")
    bad = exported.where("canonical_customer_id <> 'c2'").unionByName(exported.where("canonical_customer_id = 'c5'")).unionByName(exported.where("canonical_customer_id = 'c6'").withColumn("tenant_id", F.lit("u")))
    assert kinds(bad, first.union(first.limit(1)), no) == {"missing_hashed_identifier", "privacy_suppressed_row_exported", "missing_eligible_row",
        "duplicate_customer_export", "unexpected_exported_row", "wrong_tenant_row", "duplicate_idempotency_key"}


def test_access(spark):
    df = spark.createDataFrame([("a", "c1", "bob@z.com"), ("b", "c2", "eve@z.com")], "tenant_id string, canonical_customer_id string, email string")
    who = access.Principal("p", frozenset({"a"}))
    assert [r.canonical_customer_id for r in access.scoped(df, who).collect()] == ["c1"] and access.lookup(df, who, "c2").count() == 0
    with pytest.raises(PermissionError):
        access.scoped(df, who, "b")
    with pytest.raises(PermissionError):
        access.scoped(df, who, scope="x")
    assert access.masked(df, who).first().email == "b***b@z.com" and access.masked(df, access.Principal("s", role="STEWARD")).first().email == "bob@z.com"
    got, total = access.page(df, ["email"], 1, 1)
    assert got.first().email == "eve@z.com" and total.first().total == 2
    with pytest.raises(ValueError):
        access.page(df, ["email"], 0, 5000)
    policy = spark.createDataFrame([("p", "b")], "principal string, tenant_id string")
    assert [r.tenant_id for r in access.by_policy(df, policy, "p").collect()] == ["b"]
    assert access.deletion_request(df, F.lit(dt.datetime(2024, 1, 1))).first().deletion_request_id.startswith("del_")


def test_parity_and_expectations(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert quality.parity(a, a, ["k"]).first().status == "PASS" and quality.parity(a, None, ["k"]).first().status == "NOT_RUN"
    assert tuple(quality.parity(a, spark.createDataFrame([(1, 9.0), (3, 1.0)], "k int, v double"), ["k"]).first()) == ("FAIL", 1, 1, 1)
    got = {r.check: r.failures for r in quality.expectations(spark.createDataFrame([(1, "a"), (1, None)], "k int, s string"),
        [("unique", "k"), ("not_null", "s"), ("in_set", "s", ["b"]), ("row_count_between", 5, 9)]).collect()}
    assert got == {"unique": 1, "not_null": 1, "in_set": 1, "row_count_between": 1}
