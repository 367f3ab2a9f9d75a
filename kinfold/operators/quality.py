"""Data tests, expectations, parity, scorecards and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, checks: list[tuple]) -> DataFrame:
    """(check, column, failures, passed) of all checks in one pass. Checks: ("not_null", col), ("unique", col),
    ("in_set", col, values), ("row_count_between", low, high)."""
    aggs, rows = [], []
    for i, c in enumerate(checks):
        kind, name = c[0], str(c[1])
        if kind == "not_null":
            fail = F.count_if(F.col(c[1]).isNull())
        elif kind == "unique":
            fail = F.count(c[1]) - F.countDistinct(c[1])
        elif kind == "in_set":
            fail = F.count_if(F.col(c[1]).isNotNull() & ~F.col(c[1]).isin(*c[2]))
        else:
            fail, name = (~F.count("*").between(c[1], c[2])).cast("bigint"), "*"
        aggs.append(fail.cast("bigint").alias(f"f{i}"))
        rows.append(F.struct(F.lit(kind).alias("check"), F.lit(name).alias("column"), F.col(f"f{i}").alias("failures"), (F.col(f"f{i}") == 0).alias("passed")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def relationship_failures(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent (null keys aside)."""
    return child.where(" and ".join(f"{k} is not null" for k in keys)).join(parent.select(*keys).distinct(), keys, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def parity(source: DataFrame, target: DataFrame | None, keys: list[str], digits: int = 6) -> DataFrame:
    """(status, missing, extra, mismatched): one full outer join on the keys; numbers are compared rounded. NOT_RUN without a target."""
    if target is None:
        return source.sparkSession.createDataFrame([("NOT_RUN", 0, 0, 0)], "status string, missing bigint, extra bigint, mismatched bigint")
    rest = [c for c in source.columns if c not in keys]
    norm = lambda df: F.struct(*[F.round(c, digits).alias(c) if dict(df.dtypes)[c] in ("double",
        "float") or dict(df.dtypes)[c].startswith("decimal") else F.col(c) for c in rest])
    s, t = source.select(*keys, norm(source).alias("s")), target.select(*keys, norm(target).alias("t"))
    met = s.join(t, keys, "full_outer")
    g = met.agg(F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"),
        F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull() & ~F.col("s").eqNullSafe(F.col("t"))).alias("mismatched"))
    return g.select(F.when(F.col("missing") + F.col("extra") + F.col("mismatched") == 0, "PASS").otherwise("FAIL").alias("status"), "missing", "extra",
        "mismatched")


#: Weights of the scorecard's domains.
SCORECARD = {"cdc": 15, "identity": 15, "historical": 15, "customer_360": 10, "privacy": 15, "activation": 15, "freshness": 5, "reconciliation": 10}


def scorecard(results: DataFrame, weights: dict[str, int] = SCORECARD) -> DataFrame:
    """(domain, passed, total, score, weight, weighted) per domain of ``results`` (domain, passed); a domain without checks
    scores 0. The weighted scores sum to the overall score."""
    w = results.sparkSession.createDataFrame(list(weights.items()), "domain string, weight int")
    g = results.groupBy("domain").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    m = w.join(g, "domain", "left").select("domain", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"), "weight")
    score = F.coalesce(100.0 * F.col("passed") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return m.withColumn("score", score).withColumn("weighted", F.col("score") * F.col("weight") / 100)


def freshness(events: DataFrame, keys: list[str], at: Column, now: Column, limit_minutes: int) -> DataFrame:
    """Newest time per key, its lag in whole minutes and whether it is fresh."""
    from ..functions.columns import micros

    g = events.groupBy(*keys).agg(F.max(micros(at)).alias("last_us"))
    lag = F.floor((micros(now) - F.col("last_us")) / F.lit(60_000_000)).cast("bigint")
    return g.select(*keys, "last_us", lag.alias("lag_minutes"), F.when(lag < limit_minutes, "fresh").otherwise("stale").alias("status"))


def source_freshness(tables: dict[str, tuple[DataFrame, Column]], now: Column, warn_minutes: int = 120, error_minutes: int = 360) -> DataFrame:
    """(source, lag_minutes, status) of each table with its time of loading: pass, warn, error; a table without rows is an error."""
    from ..functions.columns import minutes_between

    parts = [df.agg(F.max(at).alias("at")).select(F.lit(name).alias("source"),
        F.floor(minutes_between(F.col("at"), now)).cast("bigint").alias("lag_minutes")) for name, (df, at) in tables.items()]
    lag = F.col("lag_minutes")
    return reduce(DataFrame.unionByName, parts).withColumn("status",
        F.when(lag.isNull() | (lag > error_minutes), "error").when(lag > warn_minutes, "warn").otherwise("pass"))


def run_log(events: DataFrame, failures: DataFrame, run_id: str, at: Column) -> DataFrame:
    """A row per tenant and table of what has landed, and one for the checks that failed (of ``failures`` (check, failures))."""
    landed = events.groupBy("tenant_id", "source_table").agg(F.count("*").alias("row_count"))
    landed = landed.select("tenant_id", F.concat(F.lit("raw_cdc_"), "source_table").alias("stage_name"), "row_count", F.lit("success").alias("status"),
        F.concat_ws(" ", F.lit("landed"), F.col("row_count").cast("string"), F.lit("change events for"), "source_table").alias("details"))
    bad = failures.where("failures > 0").agg(F.count("*").alias("row_count"))
    checks = bad.select(F.lit("all").alias("tenant_id"), F.lit("quality_checks").alias("stage_name"), "row_count",
        F.when(F.col("row_count") == 0, "success").otherwise("warning").alias("status"),
            F.concat(F.lit("validation_failures="), F.col("row_count").cast("string")).alias("details"))
    return landed.unionByName(checks).select(F.lit(run_id).alias("run_id"), "*", at.alias("ended_at"))


def quality_checks(events: DataFrame, customers: DataFrame, mapping: DataFrame, exported: DataFrame, suppressed: DataFrame, tables: list[str],
    states: list[str]) -> DataFrame:
    """(check, failures), a row for each of seven checks, those that find nothing too."""
    spark = events.sparkSession
    keys = ["tenant_id", "canonical_customer_id"]
    per_table = spark.createDataFrame([(t,) for t in tables], "source_table string").join(events.where("operation_type = 'insert'").select("source_table").distinct(), "source_table", "left_anti")
    found = {
        "duplicate_canonical_email": duplicates(customers.where("email is not null"), ["tenant_id", "email"]),
        "broken_mapping": relationship_failures(mapping, customers, keys),
        "missing_source_key": events.where("record_primary_key is null or record_primary_key = ''"),
        "table_without_inserts": per_table,
        "invalid_subscription_state": events.where(F.col("source_table") == "subscriptions").where(~F.coalesce(F.get_json_object("payload_after",
            "$.subscription_status").isin(*states), F.lit(True))),
        "missing_refresh_time": customers.where("last_seen_at is null") if "last_seen_at" in customers.columns else customers.limit(0),
        "suppressed_exported": exported.join(suppressed, keys, "left_semi"),
    }
    counts = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


def lineage_edges(tenants: DataFrame, run_id: str) -> DataFrame:
    """Each tenant's five hops from raw events to destinations."""
    hops = ["raw_events", "staging", "identity", "marts", "exports", "destinations"]
    pairs = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(i).alias("hop")) for i, (a, b) in enumerate(zip(hops, hops[1:]))])
    return tenants.select("tenant_id", F.lit(run_id).alias("run_id"), F.explode(pairs).alias("x")).select("tenant_id", "run_id", "x.*")
