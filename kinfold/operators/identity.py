"""Identity resolution: identifiers, strong links, components, survivors, weak links, review, fuzzy pairs.

Tokens weaker than ``MERGE`` never merge records; they yield review cases. Skew: components are found by joins and
pre-aggregated minima (``graph``), never by gathering a token's records.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import fuzzy_phone, normalize_email, normalize_phone, plain_text
from .graph import named_components
from .merge import latest

#: Confidence by kind of identifier; those at or above MERGE join records, those in [REVIEW, MERGE) are reviewed.
CONFIDENCE = {"subscription_id": 0.99, "external_account_id": 0.99, "customer_id": 0.95, "email": 0.86, "phone": 0.78, "device_id": 0.62}
OTHER_CONFIDENCE = 0.60
MERGE, REVIEW = 0.75, 0.55
#: Weight of an identifier in the choice of the canonical id.
WEIGHT = {"external_account_id": 100, "subscription_id": 90, "customer_id": 85, "email": 75, "phone": 65, "device_id": 45, "order_customer_ref": 40,
    "support_customer_ref": 40}
#: Source priority for survivors, and trust for fuzzy pairs and golden records.
PRIORITY = {"account_app": 100, "billing_platform": 90, "commerce_platform": 70, "support_desk": 60, "marketing_automation": 50, "product_analytics": 40}
TRUST = {"account_app": 1.0, "billing_platform": 0.95, "commerce_platform": 0.8, "support_desk": 0.7, "marketing_automation": 0.6, "product_analytics": 0.5}
OTHER_TRUST = 0.4


def lookup(values: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(otherwise))


def latest_records(events: DataFrame) -> DataFrame:
    """The newest event with a payload per (tenant, system, record), by (time, id); a delete shows its before image."""
    rows = events.withColumn("payload", F.coalesce("payload_after", "payload_before")).where("payload is not null and payload <> '{}'")
    return latest(rows, ["tenant_id", "source_system", "record_primary_key"], "event_timestamp", "event_id")


def tokens(records: DataFrame, record: str = "record_id", fields: tuple[str, ...] = ("external_account_id", "subscription_id", "customer_id", "email",
    "phone", "device_id", "order_customer_ref", "support_customer_ref")) -> DataFrame:
    """(tenant_id, record_id, kind, value, token, confidence): the identifiers of each record that are neither null nor
    blank. References that start with ``cust_`` or ``acct_ext_`` also name a customer or an account."""
    have = {c.lower() for c in records.columns}
    each = []
    for f in fields:
        if f in have:
            raw = F.col(f).cast("string")
            v = normalize_email(raw) if f == "email" else normalize_phone(raw) if f == "phone" else F.lower(F.trim(raw))
            each.append(F.struct(F.lit(f).alias("kind"), v.alias("value")))
            if f.endswith("_ref"):
                each.append(F.struct(F.lit("customer_id").alias("kind"), F.when(v.startswith("cust_"), v).alias("value")))
                each.append(F.struct(F.lit("external_account_id").alias("kind"), F.when(v.startswith("acct_ext_"), v).alias("value")))
    out = records.select("tenant_id", F.col(record).alias("record_id"), F.explode(F.array(*each)).alias("x")).select("tenant_id", "record_id",
        "x.*").where("value is not null and value <> ''")
    return out.distinct().withColumn("token", F.concat_ws(":", "kind", "value")).withColumn("confidence", lookup(CONFIDENCE, F.col("kind"), OTHER_CONFIDENCE))


def resolve(toks: DataFrame, records: DataFrame) -> DataFrame:
    """(tenant_id, record_id, canonical_customer_id, match_rule, match_confidence, fingerprint) for every record.

    Records of a tenant that chains of strong tokens connect are one customer. The id comes from the component's
    strongest strong token (then the least), else from the record itself. The rule ladder reads the kinds present.
    """
    strong = toks.where(F.col("confidence") >= MERGE)
    node, tok = F.concat_ws("|", F.lit("r"), "tenant_id", "record_id"), F.concat_ws("|", F.lit("t"), "tenant_id", "token")
    placed = records.select("tenant_id", "record_id").distinct().withColumn("node", node)
    placed = placed.join(named_components(strong.select(node.alias("src"), tok.alias("dst")), placed), "node")
    kinds = placed.join(toks, ["tenant_id", "record_id"], "left").groupBy("tenant_id", "component").agg(
        F.min(F.when(F.col("confidence") >= MERGE, F.struct((-lookup(WEIGHT, F.col("kind"), 1)).alias("w"), "token"))).alias("best"),
            F.min("record_id").alias("any_record"),
        F.collect_set("kind").alias("kinds"), F.sha2(F.array_join(F.sort_array(F.collect_set("token")), "|"), 256).alias("fingerprint"),
    )
    has = lambda *ks: F.array_contains("kinds", ks[0]) if len(ks) == 1 else has(*ks[:1]) & has(*ks[1:])
    ladder = [
        (has("external_account_id") | has("subscription_id"), "exact_account", 0.99), (has("customer_id", "email"), "customer_id_and_email", 0.95),
            (has("email", "phone"), "email_and_phone", 0.92),
        (has("email"), "email", 0.86), (has("phone"), "phone", 0.78),
    ]
    rule, conf = F.when(ladder[0][0], ladder[0][1]), F.when(ladder[0][0], F.lit(ladder[0][2]))
    for cond, name, c in ladder[1:]:
        rule, conf = rule.when(cond, name), conf.when(cond, F.lit(c))
    named = F.sha1(F.concat_ws(":", "tenant_id", F.coalesce("best.token", F.concat(F.lit("record:"), "any_record"))))
    heads = kinds.select("tenant_id", "component", F.concat(F.lit("cc_"), F.substring(named, 1, 12)).alias("canonical_customer_id"),
        rule.otherwise("weak").alias("match_rule"), conf.otherwise(F.lit(0.62)).alias("match_confidence"), "fingerprint")
    return placed.join(heads, ["tenant_id", "component"]).select("tenant_id", "record_id", "canonical_customer_id", "match_rule", "match_confidence",
        "fingerprint")


def weak_links(toks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per weak token a star from its first customer to each other one: (tenant_id, token, kind, confidence, left, right)."""
    weak = toks.where((F.col("confidence") < MERGE) & (F.col("confidence") >= REVIEW))
    met = weak.join(resolved.select("tenant_id", "record_id", "canonical_customer_id"), ["tenant_id", "record_id"]).select("tenant_id", "token",
        "kind", "confidence", "canonical_customer_id").distinct()
    anchor = met.groupBy("tenant_id", "token").agg(F.min("canonical_customer_id").alias("left_id"))
    return met.join(anchor, ["tenant_id", "token"]).where("canonical_customer_id <> left_id").select("tenant_id", "token", "kind", "confidence",
        "left_id", F.col("canonical_customer_id").alias("right_id"))


def review_cases(links: DataFrame) -> DataFrame:
    """Open review cases of weak links; a shared device is a low-confidence match, anything else an ambiguous identifier."""
    case = F.concat(F.lit("case_"), F.substring(F.sha1(F.concat_ws("|", "tenant_id", "token", "left_id", "right_id")), 1, 16))
    return links.select(case.alias("case_id"), "*", F.when(F.col("kind") == "device_id",
        "low_confidence_match").otherwise("ambiguous_shared_identifier").alias("case_type"), F.lit("OPEN").alias("status"))


def survivors(records: DataFrame, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """Per customer the surviving value of each field: not null or blank, of the source with the highest priority, then
    the newest, then of the first record. Deleted records give none. One aggregate for all fields."""
    rows = records.where(~F.coalesce("is_delete", F.lit(False))).join(resolved.select("tenant_id", "record_id", "canonical_customer_id"),
        ["tenant_id", "record_id"])
    age = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit((1 << 63) - 1))
    rank = F.struct((-lookup(PRIORITY, F.col("source_system"), 0)).alias("p"), age.alias("age"), F.col("record_id"))
    best = [F.min_by(F.when(F.trim(f) != "", F.col(f)), F.when(F.trim(f) != "", rank)).alias(f) for f in fields]
    return rows.groupBy("tenant_id", "canonical_customer_id").agg(*best, F.count("*").alias("record_count"),
        F.min("updated_at").alias("first_seen_at"), F.max("updated_at").alias("last_seen_at"),
            F.array_join(F.sort_array(F.collect_set("source_system")), "|").alias("source_systems"))


def survivorship_conflicts(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Customers of two or more records with two or more distinct emails, or phones."""
    rows = records.join(resolved.select("tenant_id", "record_id", "canonical_customer_id"), ["tenant_id", "record_id"])
    g = rows.groupBy("tenant_id", "canonical_customer_id").agg(F.countDistinct("record_id").alias("records"),
        F.countDistinct(normalize_email(F.col("email"))).alias("emails"), F.countDistinct(normalize_phone(F.col("phone"))).alias("phones"))
    kinds = F.array_compact(F.array(F.when(F.col("emails") >= 2, F.lit("conflicting_email")), F.when(F.col("phones") >= 2, F.lit("conflicting_phone"))))
    return g.where("records >= 2").select("tenant_id", "canonical_customer_id", F.explode(kinds).alias("case_type"))


def graph_artifacts(toks: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, merge events (customers of two or more records) and an explanation per record."""
    nodes = resolved.select("tenant_id", F.lit("record").alias("node_type"),
        F.col("record_id").alias("node_id")).unionByName(toks.select("tenant_id", F.lit("identifier").alias("node_type"),
            F.col("token").alias("node_id")).distinct())
    edges = toks.select("tenant_id", "record_id", "token", "confidence",
        F.when(F.col("confidence") >= MERGE, "merge").when(F.col("confidence") >= REVIEW, "review").otherwise("ignore").alias("band"))
    merges = resolved.groupBy("tenant_id", "canonical_customer_id").agg(F.count("*").alias("records"),
        F.array_join(F.sort_array(F.collect_set("record_id")), "|").alias("merged_records"), F.max(F.struct("match_confidence", "match_rule")).alias("x"))
    merges = merges.where("records >= 2").select("tenant_id", "canonical_customer_id", "records", "merged_records",
        F.col("x.match_rule").alias("strongest_rule"), F.col("x.match_confidence").alias("confidence"))
    explain = resolved.select("tenant_id", "record_id", "canonical_customer_id", F.concat(F.lit("matched by "), "match_rule").alias("explanation"))
    return {"nodes": nodes, "edges": edges, "merge_events": merges, "explanations": explain}


#: Match rule, strength, confidence, identifiers.
RULES = [
    ("exact_normalized_email", "strong", 0.86, "email"),
    ("exact_normalized_phone", "medium", 0.78, "phone"),
    ("exact_subscription_id", "strong", 0.99, "subscription_id"),
    ("exact_external_account_id", "strong", 0.99, "external_account_id"),
    ("strong_composite_customer_email", "strong", 0.95, "customer_id,email"),
    ("device_id_behavioral_supporting_match", "weak", 0.62, "device_id"),
]


def match_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_name string, rule_strength string, match_confidence double, identifiers string")


def audit(toks: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """Per record: its customer, the identifiers by which it matched (sorted, ``|`` between), the rule, its confidence, the time."""
    own = toks.groupBy("tenant_id", "record_id").agg(F.array_join(F.sort_array(F.collect_set("token")), "|").alias("matched_identifiers"))
    met = resolved.join(own, ["tenant_id", "record_id"], "left")
    return met.select("tenant_id", "record_id", "canonical_customer_id", F.coalesce("matched_identifiers", F.lit("")).alias("matched_identifiers"),
        F.col("match_rule").alias("decision_reason"), F.col("match_confidence").alias("confidence_score"), at.alias("resolved_at"))


def map_history(previous: DataFrame | None, records: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """Versions of each record's customer: (tenant_id, record_id, canonical_customer_id, version, valid_from, valid_to, is_current,
    change_reason). Without ``previous``, a first version from the record's time; else versions whose customer has changed are
    closed at ``at`` and the next opened. A deleted record's version isn't current."""
    keys = ["tenant_id", "record_id"]
    now = resolved.select(*keys, "canonical_customer_id").join(records.select(*keys, "updated_at", F.coalesce("is_delete", F.lit(False)).alias("gone")), keys)
    first = now.select(*keys, "canonical_customer_id", F.lit(1).alias("version"), F.col("updated_at").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), (~F.col("gone")).alias("is_current"), F.lit("initial_deterministic_link").alias("change_reason"))
    if previous is None:
        return first
    cols = first.columns
    open_ = previous.where("valid_to is null")
    met = open_.alias("p").join(now.alias("n"), keys, "full_outer")
    moved = F.col("p.canonical_customer_id").isNotNull() & F.col("n.canonical_customer_id").isNotNull() & (F.col("p.canonical_customer_id") != F.col("n.canonical_customer_id"))
    old = met.where(F.col("p.version").isNotNull()).select(
        *keys, "p.canonical_customer_id", "p.version", "p.valid_from", F.when(moved, at).alias("valid_to"),
            (~moved & ~F.coalesce("n.gone", ~F.col("p.is_current"))).alias("is_current"), "p.change_reason"
    )
    next_ = met.where(moved).select(*keys, "n.canonical_customer_id", (F.col("p.version") + 1).alias("version"), at.alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), (~F.col("n.gone")).alias("is_current"), F.lit("customer_changed").alias("change_reason"))
    new = first.join(open_, keys, "left_anti").join(previous, keys, "left_anti")
    return previous.where("valid_to is not null").select(*cols).unionByName(old.select(*cols)).unionByName(next_.select(*cols)).unionByName(new)


def resolution_run(toks: DataFrame, resolved: DataFrame, run_id: str, at: Column) -> DataFrame:
    """One row: the run's counts of customers, records, graph nodes and edges, and merges."""
    g = graph_artifacts(toks, resolved)
    counts = resolved.agg(F.countDistinct("tenant_id", "canonical_customer_id").alias("canonical_customers"), F.count("*").alias("source_records"))
    for name in ("nodes", "edges", "merge_events"):
        counts = counts.crossJoin(F.broadcast(g[name].agg(F.count("*").alias(f"graph_{name}"))))  # one row by one row
    return counts.select(F.lit(run_id).alias("identity_resolution_run_id"), at.alias("resolved_at"), "*", F.lit("success").alias("run_status"))


# -- stewardship -------------------------------------------------------------------------------------------------------

#: Decisions and the status they lead to, and the moves a case may make.
DECISIONS = {"APPROVE_MERGE": "APPROVED", "REJECT_MERGE": "REJECTED", "NEEDS_REVIEW": "IN_REVIEW", "APPROVE_UNMERGE": "APPROVED",
    "IGNORE_FALSE_POSITIVE": "RESOLVED"}
MOVES = {"OPEN": ["IN_REVIEW", "REJECTED", "RESOLVED"], "IN_REVIEW": ["APPROVED", "REJECTED"], "APPROVED": ["RESOLVED"], "REJECTED": ["RESOLVED"],
    "RESOLVED": []}


def decide(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases after one decision each, with ``error`` where the decision is unknown or the move isn't allowed (the
    status then stays). decisions: (case_id, decision). A case already in the decision's status is unchanged."""
    to = F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), F.col("decision"))
    moves = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    met = cases.join(decisions, "case_id", "left").withColumn("__to", to)
    same = F.col("__to") == F.col("status")
    error = F.when(F.col("decision").isNull() | same, None).when(F.col("__to").isNull(),
        "unknown_decision").when(~F.array_contains(F.element_at(moves, F.col("status")), F.col("__to")), "illegal_transition")
    return met.withColumn("error", error).withColumn("status",
        F.when(F.col("error").isNull(), F.coalesce("__to", "status")).otherwise(F.col("status"))).drop("__to")


def merge_customers(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """Map rows with the customers of ``pairs`` (tenant_id, from_id, to_id) renamed. Other tenants' rows never match, and a
    pair is refused (see ``merge_audit``) unless its tenant has rows of both."""
    there = mapping.select("tenant_id", F.col("canonical_customer_id").alias("to_id")).distinct()
    p = pairs.join(there, ["tenant_id", "to_id"], "left_semi").select("tenant_id", F.col("from_id").alias("canonical_customer_id"), "to_id").distinct()
    return mapping.join(p, ["tenant_id", "canonical_customer_id"], "left").withColumn("canonical_customer_id",
        F.coalesce("to_id", "canonical_customer_id")).drop("to_id").select(*mapping.columns)


def merge_audit(mapping: DataFrame, pairs: DataFrame, reviewer: str, reason: str, at: Column) -> DataFrame:
    """What ``merge_customers`` does with each pair: (merge_audit_id, tenant_id, from_id, to_id, reviewer, reason, occurred_at,
    outcome). Refused is what has no rows of one side in its tenant: ``refused_cross_tenant`` where another tenant has them,
    else ``refused_unknown_customer``."""
    have = mapping.select("tenant_id", "canonical_customer_id").distinct()
    away = have.groupBy("canonical_customer_id").agg(F.lit(True).alias("anywhere"))
    out = pairs.select("tenant_id", "from_id", "to_id").distinct()
    for side in ("from", "to"):
        here = have.select("tenant_id", F.col("canonical_customer_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_here"))
        there = away.select(F.col("canonical_customer_id").alias(f"{side}_id"), F.col("anywhere").alias(f"{side}_any"))
        out = out.join(here, ["tenant_id", f"{side}_id"], "left").join(there, f"{side}_id", "left")
    known = F.coalesce("from_here", F.lit(False)) & F.coalesce("to_here", F.lit(False))
    anywhere = F.coalesce("from_any", F.lit(False)) & F.coalesce("to_any", F.lit(False))
    ident = F.concat(F.lit("merge_"), F.substring(F.sha1(F.concat_ws("|", "tenant_id", "from_id", "to_id")), 1, 16))
    return out.select(ident.alias("merge_audit_id"), "tenant_id", "from_id", "to_id", F.lit(reviewer).alias("reviewer"), F.lit(reason).alias("reason"),
        at.alias("occurred_at"), F.when(known, "merged").when(anywhere, "refused_cross_tenant").otherwise("refused_unknown_customer").alias("outcome"))


def unmerge_record(mapping: DataFrame, tenant: str, record: str) -> DataFrame:
    """One record split out to a customer of its own."""
    own = (F.col("tenant_id") == tenant) & (F.col("record_id") == record)
    fresh = F.concat(F.lit("cc_"), F.substring(F.sha1(F.lit(f"{tenant}:unmerged:{record}")), 1, 12))
    return mapping.withColumn("canonical_customer_id", F.when(own, fresh).otherwise(F.col("canonical_customer_id")))


# -- fuzzy pairs -------------------------------------------------------------------------------------------------------


@F.arrow_udf(DoubleType())
def text_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff/Obershelp ratio of two texts, rounded to 4; 0 if either is empty or null. Spark has no built-in for it."""
    return pa.array([round(difflib.SequenceMatcher(None, x, y).ratio(), 4) if x and y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist())])


def blocking_keys() -> Column:
    """Tenant-scoped keys under which a record may meet others: email domain and prefix, phone end, name start."""
    mail, phone, name = normalize_email(F.col("email")), F.regexp_replace("phone", "[^0-9]", ""), plain_text(F.col("name"))
    local, domain = F.split_part(mail, F.lit("@"), F.lit(1)), F.split_part(mail, F.lit("@"), F.lit(2))

    def key(kind, v):
        return F.when(F.length(v) > 0, F.concat_ws("|", "tenant_id", F.lit(kind), v))

    return F.array_compact(F.array(key("domain", domain), key("local", F.left(local, F.lit(4))), key("phone", F.right(phone, F.lit(7))),
        key("name", F.left(name, F.lit(5)))))


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """(left_id, right_id), each pair of records that share a blocking key, once. Joined on the key, so each pair
    meets under its keys only; hot keys are split by adaptive execution."""
    keyed = candidates.select(F.col("record_id").alias("id"), F.explode(blocking_keys()).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("left_id"),
        F.col("b.id").alias("right_id")).distinct()


def recency_weight(updated: Column, now: Column) -> Column:
    days = F.floor((F.unix_micros(now) - F.unix_micros(updated)) / F.lit(86_400_000_000))
    return F.when(updated.isNull(), 0.5).otherwise(F.greatest(F.lit(0.2), 1 - F.least(days, F.lit(730)) / 912.5))


def score_pairs(pairs: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """(left_id, right_id, score, decision): weighted evidence, each part rounded to 4. AUTO_MATCH needs a verified exact
    email or phone and 0.44; REVIEW 0.32; pairs across tenants are errors and get no score."""
    cols = [c for c in candidates.columns if c != "record_id"]
    left = candidates.select(F.col("record_id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = candidates.select(F.col("record_id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in cols])
    m = pairs.join(left, "left_id").join(right, "right_id")
    le, re_ = normalize_email(F.col("l_email")), normalize_email(F.col("r_email"))
    lp, rp = fuzzy_phone(F.col("l_phone")), fuzzy_phone(F.col("r_phone"))
    same_mail, same_phone = F.coalesce(le == re_, F.lit(False)), F.coalesce(lp == rp, F.lit(False))
    domain = F.coalesce(F.split_part(le, F.lit("@"), F.lit(2)) == F.split_part(re_, F.lit("@"), F.lit(2)), F.lit(False))
    trust = (lookup(TRUST, F.col("l_source_system"), OTHER_TRUST) + lookup(TRUST, F.col("r_source_system"), OTHER_TRUST)) / 2
    verified = (F.coalesce("l_email_verified", F.lit(False)) & F.coalesce("r_email_verified",
        F.lit(False)) & same_mail) | (F.coalesce("l_phone_verified", F.lit(False)) & F.coalesce("r_phone_verified", F.lit(False)) & same_phone)
    parts = {
        "email": (0.30, F.when(same_mail, 1.0).when(domain, 0.25).otherwise(0.0)), "phone": (0.24, F.when(same_phone, 1.0).otherwise(0.0)),
            "name": (0.16, text_ratio(plain_text(F.col("l_name")), plain_text(F.col("r_name")))),
        "address": (0.10, text_ratio(plain_text(F.col("l_address")), plain_text(F.col("r_address")))), "verification": (0.08, verified.cast("double")),
            "trust": (0.07, trust),
        "recency": (0.05, (recency_weight(F.col("l_updated_at"), now) + recency_weight(F.col("r_updated_at"), now)) / 2),
    }
    score = F.lit(0.0)
    for w, v in parts.values():
        score = score + F.round(F.lit(w) * F.round(v, 4), 4)
    m = m.withColumn("score", F.when(F.col("l_tenant_id") == F.col("r_tenant_id"), F.round(score, 4))).withColumn("__ok", verified)
    decision = F.when(F.col("score").isNull(), "ERROR_CROSS_TENANT").when(F.col("__ok") & (F.col("score") >= 0.44),
        "AUTO_MATCH").when(F.col("score") >= 0.32, "REVIEW").otherwise("NO_MATCH")
    return m.select("left_id", "right_id", "score", decision.alias("decision"))


def confusion(decided: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall in one row; precision and recall are 0 over nothing."""
    tp, fp, fn, tn = (F.count_if(c) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    g = decided.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    return g.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})


def golden(observations: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(tenant_id, customer_id, field, value, source_system, record_id, overridden, previous): per field the best observation by
    (trust, verified, time, record id); then the last override of the field, with what stood before it.

    observations: (tenant_id, customer_id, field, value, source_system, verified, observed_at, record_id); overrides: (tenant_id,
    customer_id, field, value, decided_at).
    """
    keys = ["tenant_id", "customer_id", "field"]
    rank = F.struct(lookup(TRUST, F.col("source_system"), OTHER_TRUST).alias("t"), F.coalesce("verified", F.lit(False)).alias("v"), "observed_at", "record_id")
    best = observations.where("value is not null and trim(value) <> ''").groupBy(*keys).agg(F.max_by(F.struct("value", "source_system", "record_id"),
        rank).alias("x")).select(*keys, "x.*")
    if overrides is None:
        return best.withColumns({"overridden": F.lit(False), "previous": F.lit(None).cast("string")})
    by = Window.partitionBy(*keys).orderBy("decided_at", "value")
    o = overrides.withColumns({"before": F.lag("value").over(by), "last": F.lead("value").over(by).isNull()}).where("last").select(*keys,
        F.col("value").alias("o_value"), "before")
    met = best.join(o, keys, "full_outer")
    return met.select(*keys, F.coalesce("o_value", "value").alias("value"), "source_system", "record_id",
        F.col("o_value").isNotNull().alias("overridden"), F.when(F.col("o_value").isNotNull(), F.coalesce("before", "value")).alias("previous"))


#: What a steward's assistant may see of a case.
EVIDENCE = ("case_id", "case_type", "score", "conflicts", "match_rule", "kind", "confidence")


def assist(cases: DataFrame) -> DataFrame:
    """A recommendation by fixed rules for a person to confirm: merge from 0.78 without conflicts, don't below 0.25. Of the
    case only the fields of ``EVIDENCE`` are read and returned, so no identifier leaves it."""
    cases = cases.select(*[c for c in cases.columns if c in EVIDENCE])
    r = F.when((F.col("score") >= 0.78) & (F.col("conflicts") == 0), "MERGE").when(F.col("score") < 0.25, "DO_NOT_MERGE").otherwise("NEEDS_MORE_INFORMATION")
    return cases.withColumns({"recommendation": r, "requires_human_review": F.lit(True)})
