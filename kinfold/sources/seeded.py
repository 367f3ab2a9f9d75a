"""A deterministic source of change events for trials, of any size: every value is a hash of the seed and its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import SYSTEMS

TENANTS = 4


def events(spark: SparkSession, seed: int = 42, people: int = 12, days: int = 10, start: str = "2025-01-01") -> DataFrame:
    """Envelopes of ``people`` customers over ``days``: each day one event of one of the six tables for each of them, in a shuffled
    order of arrival, the first person's last event a day late, and one event of an operation that there isn't. The same
    arguments give the same rows."""

    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "person", "day"), F.lit(n))

    table = F.element_at(F.array(*[F.lit(t) for t in SYSTEMS]), (draw("table", len(SYSTEMS)) + 1).cast("int"))
    system = F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv])
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.col("day"), F.lit(0), F.lit(0), draw("second", 86_400).cast("decimal(18,6)"))
    late = (F.col("person") == 0) & (F.col("day") == days - 1)
    bad = (F.col("person") == people - 1) & (F.col("day") == 0)
    rows = spark.range(people * days).select((F.col("id") % people).cast("int").alias("person"), F.floor(F.col("id") / people).cast("int").alias("day"))
    rows = rows.select("*", table.alias("source_table"), at.alias("at"), draw("amount", 500).alias("amount"),
        F.when(bad, "merge").when(F.col("day") == 0, "insert").when(draw("gone", 25) == 0, "delete").otherwise("update").alias("operation_type"))
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("cust_"), "person").alias("customer_id"), F.concat(F.lit("acct_ext_"), "person").alias("external_account_id"),
                F.concat(F.lit("tenant_"), F.col("person") % TENANTS).alias("tenant_id"),
            F.concat(F.lit("person"), "person", F.lit("@example.com")).alias("email"), F.col("amount").alias("gross_amount"),
                F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        )
    )
    gone = F.col("operation_type") == "delete"
    number = (F.col("day") * people + F.col("person")).cast("bigint")
    order = F.when(late, F.lit(1 << 62)).otherwise(F.col("day").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(F.lit(seed), F.lit("arrival"), "person",
        "day"), F.lit(1 << 32)))
    return rows.select(
        F.concat(F.lit("evt_"), number).alias("event_id"), F.concat(F.lit("tenant_"), F.col("person") % TENANTS).alias("tenant_id"),
            F.element_at(system, F.col("source_table")).alias("source_system"), "source_table", "operation_type",
        (F.col("at") - F.when(late, F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(0)))).alias("event_timestamp"),
            F.concat("source_table", F.lit("_"), "person").alias("record_primary_key"),
        F.when(gone, payload).alias("payload_before"), F.when(~gone, payload).alias("payload_after"),
            F.concat(F.lit("batch_"), "day").alias("batch_id"), F.lit(1).alias("schema_version"),
        F.when(late, number - people).otherwise(number).alias("event_sequence_number"),
            F.sha2(F.concat_ws("|", F.lit(seed), "person", "day"), 256).alias("event_hash"),
        F.concat(F.lit("cdc."), "source_table").alias("kafka_topic"), (F.col("person") % 3).cast("int").alias("kafka_partition"),
            number.alias("kafka_offset"), order.alias("arrival_ordinal"),
    )
