"""Change events as a stream: checks, dead letters, insert-ignore, triggered merges, order per record.

Delivery is at least once; sinks are made idempotent by keys, so a repeated batch changes nothing. State tables are dealt by hash
into buckets, and a batch writes new versions of those it touches, since plain files have no merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import cdc, merge
from ..runtime import settle, tidy

WIRE = (
    "event_id string, tenant_id string, source_system string, source_table string, operation_type string, event_timestamp timestamp_ntz, record_primary_key string, payload_before string, payload_after string, "
    "batch_id string, schema_version int, event_sequence_number bigint, event_hash string, kafka_topic string, kafka_partition int, kafka_offset bigint"
)


def from_files(spark: SparkSession, path: str, schema: str = WIRE, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Files of a folder (or pattern) as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def from_kafka(spark: SparkSession, servers: str, topics: str, schema: str = WIRE, per_trigger: int = 1_000_000) -> DataFrame:
    """A topic's JSON values as the same columns; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets",
        "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    at = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), F.col("topic").alias("t"), F.col("partition").alias("p"),
        F.col("offset").alias("o"))
    return at.select("e.*", "t", "p", "o").drop("kafka_topic", "kafka_partition",
        "kafka_offset").withColumnsRenamed({"t": "kafka_topic", "p": "kafka_partition", "o": "kafka_offset"})


class Buckets:
    """A keyed table dealt by hash into folders, ``bucket=b``, each as versions, ``v=n``: a change rewrites only the buckets it touches.

    A version's number is that of the batch that wrote it, so a batch that is run again writes the same versions. The last
    two versions of a bucket are kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], count: int = 256):
        self.spark, self.path, self.schema, self.keys, self.count = spark, path.rstrip("/"), schema, keys, count
        jvm = spark._jvm.org.apache.hadoop.fs
        self._Path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def _names(self, path: str, prefix: str) -> list[int]:
        p = self._Path(path)
        if not self._fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _current(self, buckets: list[int] | None, before: int | None) -> DataFrame:
        """The newest version (below ``before``) of each bucket: a folder for each, whatever the number of batches."""
        paths = []
        for b in self._names(self.path, "bucket=") if buckets is None else buckets:
            versions = [v for v in self._names(f"{self.path}/bucket={b}", "v=") if before is None or v < before]
            if versions:
                paths.append(f"{self.path}/bucket={b}/v={versions[-1]}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._current(None, None)

    def matching(self, changes: DataFrame, before: int) -> DataFrame:
        """The rows, as they were before batch ``before``, of the buckets that ``changes`` touch."""
        touched = [r.b for r in changes.select(self.bucket().alias("b")).distinct().collect()]  # at most ``count`` numbers
        return self._current(sorted(touched), before)

    def change(self, changes: DataFrame, number: int, into: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write ``into(rows of the touched buckets, changes)`` as version ``number`` of those buckets."""
        rows = into(self.matching(changes, number), changes).withColumn("bucket", self.bucket())
        stage = f"{self.path}/_batch={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
        for b in self._names(stage, "bucket="):
            at, to = self._Path(f"{stage}/bucket={b}"), self._Path(f"{self.path}/bucket={b}/v={number}")
            self._fs.mkdirs(to.getParent())
            self._fs.delete(to, True)
            self._fs.rename(at, to)
            for old in self._names(f"{self.path}/bucket={b}", "v=")[:-2]:
                self._fs.delete(self._Path(f"{self.path}/bucket={b}/v={old}"), True)
        self._fs.delete(self._Path(stage), True)


STATE = ["tenant_id", "source_system", "source_table", "record_primary_key"]
NEWEST = ("event_sequence_number", "event_timestamp", "event_id")


def landed_keys(spark: SparkSession, path: str, count: int = 256) -> Buckets:
    """The ids and hashes that have landed: kind (0 an id, 1 a hash) and value."""
    return Buckets(spark, path, "kind int, value string", ["kind", "value"], count)


def ingest(stream: DataFrame, tables: tuple[str, ...], landed: str, rejected: str, latest: Buckets, known: Buckets, checkpoint: str,
    contracts: dict | None = None, after: Callable[[DataFrame], None] | None = None, newest: tuple[str, ...] = NEWEST, **trigger) -> StreamingQuery:
    """Run the stream: failed events go to ``rejected``, new ones to ``landed``, and each batch's newest event per record, by
    ``newest``, is merged into ``latest``. ``after`` gets the landed rows of each batch.

    An event is new if neither its id nor its hash has landed; within a batch the first to arrive lands, in the order of the batch's
    partitions and of the rows in them. What has landed is looked up in ``known``, of which, as of ``latest``, a batch reads and rewrites only the buckets it
    touches: small batches don't pay for the length of the stream.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        with tidy(spark):
            checked = settle(cdc.classify(df.withColumn("__place", F.monotonically_increasing_id()), tables, contracts), "stream-batch")
            dead = cdc.rejection_records(checked.drop("__place"), "stream", F.current_timestamp())
            dead.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = cdc.accepted(checked)
            keys = good.select("__place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("event_id").alias("value")),
                F.struct(F.lit(1).alias("kind"), F.col("event_hash").alias("value")))).alias("k")).select("__place", "k.*").where("value is not null")
            seen = keys.join(known.matching(keys, number), ["kind", "value"], "left_semi").select("__place").distinct()
            fresh = good.join(seen, "__place", "left_anti")
            repeated = fresh.join(_shared(keys), "__place", "left_semi")
            second = cdc.mark_duplicates(repeated, "__place").where("duplicate_key is not null").select("__place")
            fresh.join(second, "__place", "left_anti").select(*df.columns).write.mode("overwrite").parquet(f"{landed}/batch={number}")
            own = spark.read.schema(df.schema).parquet(f"{landed}/batch={number}")
            new = own.select(F.lit(0).alias("kind"), F.col("event_id").alias("value")).unionByName(own.select(F.lit(1).alias("kind"),
                F.col("event_hash").alias("value"))).where("value is not null")
            known.change(new, number, lambda old, more: old.unionByName(more).distinct())
            latest.change(own, number, lambda old, more: merge.upsert(old, more, STATE, *newest))
            if after is not None:
                after(own)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _shared(keys: DataFrame) -> DataFrame:
    """Places of events that share an id or a hash with another event."""
    twice = keys.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(twice, ["kind", "value"], "left_semi").select("__place").distinct()


def stateful_order(stream: DataFrame, keys: list[str], timeout: str = "NoTimeout") -> DataFrame:
    """Ordering anomalies of a stream, as ``cdc.ordering_anomalies`` finds them: the last regular (sequence, commit) of each record is
    kept as state. A null sequence is 0, which no sequence is compared with; null commits are compared with nothing."""
    kinds = dict(stream.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    none = -(1 << 62)  # no commit

    def step(key, frames, state):
        import pandas as pd

        last = list(state.get) if state.exists else None
        found = []
        for pdf in frames:
            pdf = pdf.sort_values("arrival_ordinal", kind="stable")
            seqs = [0 if pd.isna(x) else int(x) for x in pdf["event_sequence_number"]]
            commits = [none if pd.isna(x) else int(x) for x in pdf["commit_us"]]
            for event, s, c in zip(pdf["event_id"], seqs, commits):
                if last is not None and s != 0 and last[0] > s:
                    found.append((*key, event, "out_of_order_sequence"))
                elif last is not None and c != none and last[1] != none and last[1] > c:
                    found.append((*key, event, "late_arriving_commit"))
                else:
                    last = [s, c]
        if last is not None:
            state.update(tuple(last))
        yield pd.DataFrame(found, columns=[*keys, "event_id", "anomaly"])

    return stream.groupBy(*keys).applyInPandasWithState(step, f"{key_schema}, event_id string, anomaly string", "seq bigint, commit_us bigint",
        "append", timeout)


def publishable(events: DataFrame, tables: tuple[str, ...], contracts: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(events that may be sent, those that no consumer would accept, with the reason)."""
    checked = cdc.classify(events, tables, contracts)
    return cdc.accepted(checked), checked.where("reject_category is not null")


def dry_run_counts(events: DataFrame) -> DataFrame:
    """What a publisher would send: messages per topic."""
    return events.groupBy("kafka_topic").agg(F.count("*").alias("messages"))


def to_messages(events: DataFrame) -> DataFrame:
    """(topic, key, value) for a Kafka sink, keyed by system and record so that a record keeps its order."""
    return events.select(F.col("kafka_topic").alias("topic"), F.concat_ws(":", "source_system", "record_primary_key").alias("key"),
        F.to_json(F.struct("*")).alias("value"))
