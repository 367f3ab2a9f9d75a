"""File sources and sinks: JSON lines, CSV, Parquet, JDBC, with the failure rules of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that aren't JSON objects)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok",
        F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    return parsed.where("ok").select("e.*"), parsed.where("not ok").select("value")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, all by the given schema; a path that doesn't exist is an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **properties) -> DataFrame:
    """A database table read in ranges of a key, so that many tasks share it; needs a driver on the class path."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also where there are no rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """The rows of one run added to a log kept by ``run_id``; a run that is written again replaces itself."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def scaled(events: DataFrame, copies: int) -> DataFrame:
    """A larger source: each event ``copies`` times with suffixed ids, no hash and shifted offsets."""
    n = F.col("__copy")
    out = events.crossJoin(F.broadcast(events.sparkSession.range(copies).withColumnRenamed("id", "__copy")))
    suffix = F.concat(F.lit("_"), n)
    changes = {c: F.concat(c, suffix) for c in ("event_id", "record_primary_key") if c in events.columns}
    if "event_hash" in events.columns:
        changes["event_hash"] = F.lit(None).cast("string")
    if "kafka_offset" in events.columns:
        changes["kafka_offset"] = F.col("kafka_offset") + n * F.lit(1 << 40)
    return out.withColumns(changes).drop("__copy")
