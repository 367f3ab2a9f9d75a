"""Change events: checks and reject classes, contracts, dedupe, order, checkpoints, replay, repair."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from .graph import connected_components
from .merge import latest

OPERATIONS = ("insert", "update", "delete")
VERSIONS = (1,)
REQUIRED = ("event_id", "source_system", "source_table", "operation_type", "event_timestamp", "batch_id", "schema_version")


# -- contracts ---------------------------------------------------------------------------------------------------------


def _is_kind(value: Column, kind: str) -> Column:
    """Whether a JSON value, as ``schema_of_variant`` names it, has a contract's type."""
    return {
        "string": value == "STRING",
        "integer": value.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
        "number": value.isin("BIGINT", "INT", "DOUBLE", "FLOAT") | value.startswith("DECIMAL"),
        "boolean": value == "BOOLEAN",
        "object": value.startswith("OBJECT"),
        "array": value.startswith("ARRAY"),
    }[kind]


def payload_problem(table: Column, payload: Column, contracts: dict) -> Column:
    """The first way in which a JSON payload breaks its table's contract; null if it keeps it.

    In order: a required field missing or null, a declared field null that isn't nullable, a value of another type
    (true is no number), a value outside an enumeration. Tables without a contract pass, undeclared fields are ignored.
    """
    doc = F.try_parse_json(payload)
    problem = F.lit(None).cast("string")
    for name, c in reversed(contracts.items()):
        steps = []
        kinds, nullable = c.get("types", {}), set(c.get("nullable", []))

        def text(f):
            return F.get_json_object(payload, f"$.{f}")

        for f in c.get("required", []):
            steps.append((text(f).isNull(), f"missing:{f}"))
        for f in kinds:
            present = F.try_variant_get(doc, f"$.{f}", "variant")
            kind = F.schema_of_variant(present)
            steps += [((kind == "VOID") & F.lit(f not in nullable), f"null:{f}"), ((kind != "VOID") & ~_is_kind(kind, kinds[f]), f"type:{f}")]
        for f, allowed in c.get("enums", {}).items():
            steps.append((text(f).isNotNull() & ~text(f).isin(*allowed), f"enum:{f}"))
        found = F.coalesce(F.when(doc.isNull(), F.lit("not_json")), *[F.when(cond, F.lit(what)) for cond, what in steps], F.lit(None).cast("string"))
        problem = F.when(table == name, found).otherwise(problem)
    return problem


def contract_rows(spark, contracts: dict) -> DataFrame:
    """A contract file as rows (table, kind, field, value)."""
    rows = []
    for t, c in contracts.items():
        rows.append((t, "table", "", ""))
        rows += [(t, "required", f, "") for f in c.get("required", [])]
        rows += [(t, "nullable", f, "") for f in c.get("nullable", [])]
        rows += [(t, "type", f, k) for f, k in c.get("types", {}).items()]
        rows += [(t, "enum", f, v) for f, vs in c.get("enums", {}).items() for v in vs]
    return spark.createDataFrame(rows, "source_table string, kind string, field string, value string")


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_table, kind, field, value, change, verdict) of two sets of ``contract_rows``.

    Breaking: a table or a required field removed, a required field added, a type changed, a required typed field added or
    removed, an enumeration's value removed. Review: an optional typed field removed, a value added. Else compatible.
    """
    keys = ["source_table", "kind", "field"]
    flat_old = old.where("kind <> 'enum'").withColumnRenamed("value", "was")
    flat_new = new.where("kind <> 'enum'").withColumnRenamed("value", "now")
    met = flat_old.join(flat_new, keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    flat = met.withColumn("change", change).where("change is not null").withColumn("value", F.coalesce("now", "was")).drop("was", "now")
    enum_keys = [*keys, "value"]
    enums = old.where("kind = 'enum'").withColumn("o", F.lit(1)).join(new.where("kind = 'enum'").withColumn("n", F.lit(1)), enum_keys, "full_outer")
    enums = enums.withColumn("change", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")).where("change is not null").drop("o", "n")
    both = old.where("kind = 'table'").select("source_table").join(new.where("kind = 'table'").select("source_table"), "source_table",
        "left_semi").withColumn("kept", F.lit(True))
    needed = old.where("kind = 'required'").union(new.where("kind = 'required'")).select("source_table", "field").distinct().withColumn("needed", F.lit(True))
    rows = flat.unionByName(enums).join(both, "source_table", "left").join(needed, ["source_table", "field"], "left")
    rows = rows.where((F.col("kind") == "table") | F.col("kept"))  # a new or removed table is one finding
    kind, ch, need = F.col("kind"), F.col("change"), F.coalesce("needed", F.lit(False))
    verdict = (
        F.when((kind == "table") & (ch == "added"), "compatible").when(kind == "table", "breaking").when(kind == "required",
            "breaking").when(kind == "nullable", "compatible")
        .when((kind == "type") & (ch == "changed"), "breaking").when(kind == "type",
            F.when(need, "breaking").when(ch == "removed", "review").otherwise("compatible"))
        .when(ch == "removed", "breaking").otherwise("review")
    )
    return rows.select("source_table", "kind", "field", "value", "change", verdict.alias("verdict"))


def contract_summary(diff: DataFrame) -> DataFrame:
    """Per table: breaking, compatible_with_warnings or compatible."""
    g = diff.groupBy("source_table").agg(F.bool_or(F.col("verdict") == "breaking").alias("b"), F.bool_or(F.col("verdict") == "review").alias("r"))
    return g.select("source_table", F.when(F.col("b"), "breaking").when(F.col("r"), "compatible_with_warnings").otherwise("compatible").alias("status"))


# -- checks and rejects ------------------------------------------------------------------------------------------------


def classify(events: DataFrame, tables: tuple[str, ...], contracts: dict | None = None, payload: str | None = None) -> DataFrame:
    """``events`` with ``reject_category`` and ``reject_detail``, both null for those that pass. The first check that
    fails names the class: required fields, operation, version, key, tenant, images, table, payload contract."""
    op = F.lower("operation_type")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    before, after = F.col("payload_before").isNotNull(), F.col("payload_after").isNotNull()
    broken = payload_problem(F.col("source_table"), F.coalesce("payload_after", "payload_before"), contracts) if contracts else F.lit(None).cast("string")
    steps = [
        (F.size(missing) > 0, "SCHEMA_INVALID", F.concat(F.lit("missing "), F.array_join(missing, ","))),
        (~op.isin(*OPERATIONS), "UNKNOWN_OPERATION", op),
        (~F.col("schema_version").isin(*VERSIONS), "UNSUPPORTED_SCHEMA_VERSION", F.col("schema_version").cast("string")),
        (F.col("record_primary_key").isNull() | F.col("record_primary_key").isin("", "None"), "MISSING_SOURCE_KEY", F.lit("record_primary_key")),
        (F.coalesce("tenant_id", F.lit("")) == "", "INVALID_TENANT", F.lit("tenant_id")),
        (((op == "delete") & ~before) | ((op != "delete") & ~after), "INVALID_PAYLOAD", F.concat(op, F.lit(" without image"))),
        (~F.col("source_table").isin(*tables), "SCHEMA_INVALID", F.concat(F.lit("table "), "source_table")),
        (broken.isNotNull(), "SCHEMA_INVALID", broken),
    ]
    category = detail = None
    for cond, name, what in steps:
        category = F.when(cond, name) if category is None else category.when(cond, name)
        detail = F.when(cond, what) if detail is None else detail.when(cond, what)
    return events.withColumns({"reject_category": category, "reject_detail": detail})


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("reject_category is null").drop("reject_category", "reject_detail")


def rejection_records(classified: DataFrame, stage: str, rejected_at: Column) -> DataFrame:
    """Dead-letter rows of what failed, with the raw event as JSON; schema failures can't be retried unrepaired."""
    raw = [c for c in classified.columns if not c.startswith("reject_")]
    return classified.where("reject_category is not null").select(
        "event_id", "tenant_id", "source_system", "source_table", "batch_id", F.lit(stage).alias("failure_stage"),
            F.col("reject_category").alias("failure_category"), F.col("reject_detail").alias("error_detail"),
        F.coalesce("event_id", F.sha2(F.to_json(F.struct(*raw)), 256)).alias("event_reference"),
            F.col("reject_category").isin("UNKNOWN_OPERATION", "INVALID_PAYLOAD", "SCHEMA_INVALID").alias("retry_eligible"),
                F.to_json(F.struct(*raw)).alias("raw_event"), rejected_at.alias("rejected_at"),
    )


def _without(payload: Column, field: str) -> Column:
    return F.map_filter(payload, lambda k, v: k != field)


def repair(rejected: DataFrame, defaults: dict[str, dict[str, str]]) -> DataFrame:
    """Rejected events mended where that is safe, with ``repair_actions``: ``upsert`` becomes update (with a before image) or
    insert, blank payload fields of ``defaults[table]`` are filled, the batch is marked."""
    op = F.lower("operation_type")
    upsert = op == "upsert"
    actions = [F.when(upsert, F.lit("operation_from_upsert"))]
    payload = F.from_json("payload_after", "map<string,string>")
    for t, fields in defaults.items():
        for f, value in fields.items():
            need = (F.col("source_table") == t) & F.col("payload_after").isNotNull() & (F.coalesce(F.trim(F.get_json_object("payload_after",
                f"$.{f}")), F.lit("")) == "")
            payload = F.when(need, F.map_concat(_without(payload, f), F.create_map(F.lit(f), F.lit(value)))).otherwise(payload)
            actions.append(F.when(need, F.lit(f"default_{f}")))
    fixed = F.when(F.col("payload_after").isNotNull(), F.to_json(payload))
    return rejected.withColumns(
        {
            "repair_actions": F.array_compact(F.array(*actions)),
            "operation_type": F.when(upsert, F.when(F.col("payload_before").isNotNull(), "update").otherwise("insert")).otherwise(F.col("operation_type")),
            "payload_after": fixed,
            "batch_id": F.concat("batch_id", F.lit("_dlq_reprocessed")),
        }
    )


DEBEZIUM = "op string, ts_ms bigint, source struct<connector:string,db:string,schema:string,table:string,lsn:bigint,txId:bigint,ts_ms:bigint,name:string>, before string, after string"


def from_debezium(messages: DataFrame, systems: dict[str, str], keys: dict[str, str], value: str = "value", topic: str = "topic") -> DataFrame:
    """Wire messages (JSON text, wrapped in ``payload`` or not) as envelopes; images stay JSON text, so decimals keep
    their digits. c and r are inserts, u updates, d deletes; the table is the source's or the topic's last part."""
    m = messages.withColumn("__v", F.coalesce(F.get_json_object(value, "$.payload"), F.col(value))).withColumn("__m", F.from_json("__v", DEBEZIUM))
    image = F.coalesce("__m.after", "__m.before")
    name = F.coalesce("__m.source.table", F.element_at(F.split(topic, r"\."), -1))
    key = F.coalesce(*[F.when(name == t, F.get_json_object(image, f"$.{k}")) for t, k in keys.items()],
        *[F.get_json_object(image, f"$.{k}") for k in ("id", "customer_id", "subscription_id", "order_id")])
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("c", "insert", "r", "insert", "u", "update", "d", "delete")]), F.col("__m.op"))
    ts = F.coalesce("__m.source.ts_ms", "__m.ts_ms")
    ident = F.concat_ws("|", "__m.source.connector", "__m.source.db", "__m.source.schema", name, key, "__m.op", "__m.source.lsn", "__m.source.txId", ts)
    system = F.element_at(F.create_map(*[F.lit(x) for kv in systems.items() for x in kv]), name)
    at = F.timestamp_millis(ts)
    return m.select(
        F.concat(F.lit("dbz_"), F.substring(F.sha2(ident, 256), 1, 24)).alias("event_id"),
            F.coalesce(F.get_json_object(image, "$.tenant_id"), F.lit("tenant_unknown")).alias("tenant_id"),
        F.coalesce(system, F.lit("unknown")).alias("source_system"), name.alias("source_table"),
            F.coalesce(op, F.col("__m.op")).alias("operation_type"), at.alias("event_timestamp"), key.alias("record_primary_key"),
        F.col("__m.before").alias("payload_before"), F.col("__m.after").alias("payload_after"),
            F.concat(F.lit("debezium_"), F.date_format(at, "yyyyMMdd")).alias("batch_id"), F.lit(1).alias("schema_version"),
        F.coalesce("__m.source.lsn", F.lit(0)).cast("bigint").alias("event_sequence_number"),
            F.col("__m.source.txId").cast("string").alias("source_transaction_id"), at.alias("source_commit_timestamp"), F.col(topic).alias("kafka_topic"),
    )


# -- dedupe and order --------------------------------------------------------------------------------------------------


def _in_order(rows: DataFrame, keys: list[str], order: str, fold, schema: str) -> DataFrame:
    """A fold over the rows of each key in order, as a stream through each task: ``fold()`` gives a function of
    (key, row) that returns the row's outcome; memory holds one key's state."""
    names = rows.columns

    def run(batches):
        step = fold()
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            at = [names.index(k) for k in keys]
            outcome = [step(tuple(r[i] for i in at), dict(zip(names, r))) for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outcome, pa.string())], [*names, "outcome"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def mark_duplicates(events: DataFrame, order: str = "arrival_ordinal") -> DataFrame:
    """(event_id, arrival_ordinal, duplicate_key): the first of event_id, event_hash and kafka_offset (topic, partition,
    offset) that an *accepted* earlier event has; null for accepted events. Greedy: a duplicate's other keys block nothing.

    Events whose keys are all unique are accepted without looking further; only the rest form components over shared keys,
    and each component is folded in order of arrival.
    """
    offset = F.concat_ws("|", "kafka_topic", "kafka_partition", "kafka_offset")
    whole = F.col("kafka_topic").isNotNull() & F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull()
    rows = events.select(F.col(order).cast("bigint").alias("n"), "event_id", "event_hash", F.when(whole, offset).alias("at"))
    keys = rows.select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i,
        c in enumerate(("event_id", "event_hash", "at"))])).alias("k")).select("n", "k.i", "k.v").where("v is not null")
    shared = settle(keys.join(keys.groupBy("i", "v").agg(F.min("n").alias("first"), F.count("*").alias("c")).where("c > 1"),
        ["i", "v"]).select(F.col("n").alias("src"), F.col("first").alias("dst")), "shared-keys")
    comp = connected_components(shared).select(F.col("node").alias("n"), "component")
    rest = rows.join(comp, "n")

    def fold():
        state = {"key": None, "seen": set()}

        def step(key, row):
            if key != state["key"]:
                state.update(key=key, seen=set())
            mine = [("event_id", row["event_id"]), ("event_hash", row["event_hash"]), ("kafka_offset", row["at"])]
            for name, v in mine:
                if v is not None and (name, v) in state["seen"]:
                    return name
            state["seen"].update((name, v) for name, v in mine if v is not None)
            return None

        return step

    folded = _in_order(rest.select("component", "n", "event_id", "event_hash", "at"), ["component"], "n", fold,
        "component long, n long, event_id string, event_hash string, at string, outcome string")
    alone = rows.join(comp, "n", "left_anti").select("event_id", "n", F.lit(None).cast("string").alias("duplicate_key"))
    return folded.select("event_id", "n", F.col("outcome").alias("duplicate_key")).unionByName(alone).withColumnRenamed("n", order)


def ordering_anomalies(events: DataFrame, keys: list[str], order: str = "arrival_ordinal", seq: str = "event_sequence_number",
    commit: str = "commit_us") -> DataFrame:
    """(keys, arrival ordinal, sequence, commit, anomaly): events that, in order of arrival, fall behind the last regular one of
    their record: by a sequence number other than 0, else by commit time. Anomalies don't advance the record.

    Where a record's sequences are all above 0 and its commits never go back, the last regular sequence is the running maximum: a
    window in the JVM. Only the other records are folded row by row.
    """

    def fold():
        state = {"key": None, "last": None}

        def step(key, row):
            if key != state["key"]:
                state.update(key=key, last=None)
            s, c, last = row[seq] or 0, row[commit], state["last"]
            if last is not None:
                if s != 0 and last[0] > s:
                    return "out_of_order_sequence"
                if c is not None and last[1] is not None and last[1] > c:
                    return "late_arriving_commit"
            state["last"] = (s, c)
            return None

        return step

    rows = events.select(*keys, order, seq, commit)
    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", outcome string"
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(seq, F.lit(0)) <= 0) | F.coalesce(F.col(commit) < F.max(commit).over(before), F.lit(False))
    seen = rows.withColumns({"__most": F.max(seq).over(before), "__odd": odd})
    seen = settle(seen.withColumn("__odd", F.max("__odd").over(Window.partitionBy(*keys))), "ordered-events")
    plain = seen.where(~F.col("__odd") & (F.col("__most") > F.col(seq))).select(*rows.columns, F.lit("out_of_order_sequence").alias("anomaly"))
    folded = _in_order(seen.where("__odd").select(*rows.columns), keys, order, fold, schema)
    return plain.unionByName(folded.where("outcome is not null").withColumnRenamed("outcome", "anomaly"))


# -- state, checkpoints, replay ----------------------------------------------------------------------------------------


def latest_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """The newest event of each record by (sequence, time, id); deletes stay as the state."""
    return latest(events, keys, "event_sequence_number", "event_timestamp", "event_id")


def watermarks(events: DataFrame) -> DataFrame:
    """Per (tenant, system, table): the newest event by (time, id), as the high-water mark."""
    keys = ["tenant_id", "source_system", "source_table"]
    return events.groupBy(*keys).agg(F.max_by(F.struct("event_timestamp", "event_id"), F.struct("event_timestamp", "event_id")).alias("x"),
        F.count("*").alias("event_count")).select(
        *keys, F.col("x.event_timestamp").alias("high_watermark"), F.col("x.event_id").alias("last_event_id"), "event_count"
    )


def offset_checkpoints(events: DataFrame) -> DataFrame:
    keys = ["kafka_topic", "kafka_partition"]
    return events.groupBy(*keys).agg(F.max(F.struct("kafka_offset", "event_id")).alias("x")).select(*keys,
        F.col("x.kafka_offset").alias("last_offset"), F.col("x.event_id").alias("last_event_id"))


def select_replay(events: DataFrame, replay_id: str, start: Column | None = None, end: Column | None = None, batches: list[str] | None = None,
    tables: list[str] | None = None) -> DataFrame:
    """Events from ``start`` up to ``end`` (excluded), of the given batches and tables, marked as a replay."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("event_timestamp") >= start)
    if end is not None:
        cond = cond & (F.col("event_timestamp") < end)
    if batches:
        cond = cond & F.col("batch_id").isin(*batches)
    if tables:
        cond = cond & F.col("source_table").isin(*tables)
    return events.where(cond).withColumns({"is_replay": F.lit(True), "replay_batch_id": F.lit(replay_id)})


def reset_checkpoints(checkpoints: DataFrame, replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints left after a replay clears those of the tables it covers, and an alert row for each cleared."""
    keys = ["tenant_id", "source_system", "source_table"]
    hit = replayed.select(*keys).distinct()
    return checkpoints.join(hit, keys, "left_anti"), checkpoints.join(hit, keys, "left_semi").select(*keys, F.lit("checkpoint_reset").alias("alert"))


def ingestion_summary(classified: DataFrame) -> DataFrame:
    """Per (batch, system, table, version): read, landed, rejected and the status. One aggregate."""
    bad = F.count_if(F.col("reject_category").isNotNull())
    g = classified.groupBy("batch_id", "source_system", "source_table", "schema_version").agg(F.count("*").alias("record_count"),
        (F.count("*") - bad).alias("landed_count"), bad.alias("rejected_count"))
    return g.withColumn("status", F.when(F.col("rejected_count") == 0, "success").when(F.col("landed_count") > 0, "partial_success").otherwise("failed"))


def load_events(spark, path: str, schema: str, tables: tuple[str, ...], contracts: dict | None = None) -> DataFrame:
    """The events of a file of JSON lines that pass every check; lines and events that don't are left out without a word."""
    from ..sources.files import jsonl_lenient

    return accepted(classify(jsonl_lenient(spark, path, schema)[0], tables, contracts))


def load_contracts(path: str) -> dict:
    """A contract document (configuration-sized, read by the driver)."""
    with open(path) as f:
        return json.load(f)
