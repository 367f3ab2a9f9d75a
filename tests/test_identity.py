import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.operators import identity
from kinfold.operators.graph import connected_components

REC = "tenant_id string, record_id string, source_system string, customer_id string, email string, phone string, device_id string, is_delete boolean, updated_at timestamp_ntz"
T = dt.datetime(2024, 1, 1)


def rec(tenant, rid, system="account_app", customer=None, email=None, phone=None, device=None, deleted=False, day=1):
    return (tenant, rid, system, customer, email, phone, device, deleted, dt.datetime(2024, 1, day))


def resolved(spark, *rows):
    r = spark.createDataFrame(list(rows), REC)
    t = identity.tokens(r)
    return r, t, identity.resolve(t, r)


def test_merge_by_strong_tokens_within_a_tenant(spark):
    r, t, x = resolved(spark, rec("a", "1", email="A+x@z.com"), rec("a", "2", email="a@z.com", phone="(555) 123-4567"),
        rec("a", "3", phone="15551234567"), rec("b", "4", email="a@z.com"), rec("a", "5"))
    ids = {v.record_id: v.canonical_customer_id for v in x.collect()}
    assert ids["1"] == ids["2"] == ids["3"] and len({ids["1"], ids["4"], ids["5"]}) == 3 and all(v.startswith("cc_") and len(v) == 15 for v in ids.values())
    rules = {v.record_id: v.match_rule for v in x.collect()}
    assert rules["1"] == "email_and_phone" and rules["4"] == "email" and rules["5"] == "weak"
    g = identity.graph_artifacts(t, x)
    assert [v.merged_records for v in g["merge_events"].collect()] == ["1|2|3"] and g["nodes"].where("node_type = 'record'").count() == 5


def test_a_device_links_for_review_only(spark):
    r, t, x = resolved(spark, rec("a", "1", customer="c1", device="d"), rec("a", "2", customer="c2", device="D "),
        rec("b", "3", customer="c1", device="d"), rec("a", "4", device="d"))
    links = identity.weak_links(t, x).collect()
    assert len(links) == 2 and len({v.left_id for v in links}) == 1
    assert {c.case_type for c in identity.review_cases(identity.weak_links(t, x)).collect()} == {"low_confidence_match"}


def test_survivors_and_conflicts(spark):
    r, t, x = resolved(spark, rec("a", "1", "product_analytics", "c", "new@z.com", day=9), rec("a", "2", "account_app", "c", "old@z.com", day=1),
        rec("a", "3", "account_app", "c", " ", day=5), rec("a", "4", "account_app", "c", "gone@z.com", deleted=True, day=9))
    s = identity.survivors(r, x, ["email", "phone"]).first()
    assert s.email == "old@z.com" and s.phone is None and s.record_count == 3 and s.source_systems == "account_app|product_analytics"
    assert [c.case_type for c in identity.survivorship_conflicts(r, x).collect()] == ["conflicting_email"]


def test_decisions(spark):
    cases = spark.createDataFrame([("1", "OPEN"), ("2", "IN_REVIEW"), ("3", "APPROVED"), ("4", "RESOLVED"), ("5", "OPEN"), ("6", "OPEN")],
        "case_id string, status string")
    d = spark.createDataFrame([("1", "NEEDS_REVIEW"), ("2", "APPROVE_MERGE"), ("3", "IGNORE_FALSE_POSITIVE"), ("4", "APPROVE_MERGE"), ("5", "what")],
        "case_id string, decision string")
    got = {r.case_id: (r.status, r.error) for r in identity.decide(cases, d).collect()}
    assert got == {"1": ("IN_REVIEW", None), "2": ("APPROVED", None), "3": ("RESOLVED", None), "4": ("RESOLVED", "illegal_transition"),
        "5": ("OPEN", "unknown_decision"), "6": ("OPEN", None)}


def test_merge_and_unmerge_rows(spark):
    m = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "3", "x")], "tenant_id string, record_id string, canonical_customer_id string")
    pairs = spark.createDataFrame([("a", "x", "y")], "tenant_id string, from_id string, to_id string")
    merged = identity.merge_customers(m, pairs)
    assert sorted(map(tuple, merged.collect())) == [("a", "1", "y"), ("a", "2", "y"), ("b", "3", "x")]
    split = {r.record_id: r.canonical_customer_id for r in identity.unmerge_record(merged, "a", "2").collect()}
    assert split["1"] == "y" and split["2"].startswith("cc_") and split["3"] == "x"


def test_fuzzy_pairs_scores_and_evaluation(spark):
    cols = "record_id string, tenant_id string, source_system string, email string, phone string, name string, address string, updated_at timestamp, email_verified boolean, phone_verified boolean"
    rows = [("1", "t", "account_app", "a@z.com", "5551234567", "Ann Lee", "1 Main St", T, True, True),
        ("2", "t", "billing_platform", "A+b@z.com", "15551234567", "Ann  Lee!", "1 Main Street", T, True, True),
            ("3", "t", "support_desk", "q@z.com", None, "Bob", None, None, False, False),
                ("4", "u", "support_desk", "a@z.com", None, "Ann Lee", None, T, True, False)]
    c = spark.createDataFrame(rows, cols)
    pairs = identity.candidate_pairs(c)
    assert sorted(map(tuple, pairs.collect())) == [("1", "2"), ("1", "3"), ("2", "3")]
    got = {(r.left_id, r.right_id): (r.score, r.decision) for r in identity.score_pairs(pairs.union(spark.createDataFrame([("1", "4")],
        "a string, b string")), c, F.lit(T)).collect()}
    assert got[("1", "2")][1] == "AUTO_MATCH" and got[("1", "2")][0] > 0.9 and got[("1", "3")][1] == "NO_MATCH" and got[("1", "4")] == (None,
        "ERROR_CROSS_TENANT")
    lab = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, a boolean")
    assert tuple(identity.confusion(lab, F.col("p"), F.col("a")).first()) == (1, 1, 1, 1, 0.5, 0.5)


def test_golden_records(spark):
    obs = spark.createDataFrame([("t", "c", "email", "old@z", "account_app", False, T, "1"),
        ("t", "c", "email", "new@z", "product_analytics", True, dt.datetime(2025, 1, 1), "2"), ("t", "c", "phone", " ", "account_app", True, T, "1")],
            "tenant_id string, customer_id string, field string, value string, source_system string, verified boolean, observed_at timestamp_ntz, record_id string")
    assert [(r.field, r.value) for r in identity.golden(obs).collect()] == [("email", "old@z")]
    over = spark.createDataFrame([("t", "c", "email", "first@z", T), ("t", "c", "email", "last@z", dt.datetime(2024, 2, 1))],
        "tenant_id string, customer_id string, field string, value string, decided_at timestamp_ntz")
    r = identity.golden(obs, over).first()
    assert (r.value, r.overridden, r.previous) == ("last@z", True, "first@z")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_equal_union_find(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges or [(None, None)], "src long, dst long")).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    e = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert connected_components(e).where("component = 0").count() == 301
