import json
import random

from pyspark.sql import functions as F

from kinfold.operators import cdc
from kinfold.sources import files
from kinfold.streaming import ingest as I


def event(n, **over):
    row = dict(
        event_id=f"e{n}", tenant_id="t", source_system="s", source_table="orders", operation_type="insert",
            event_timestamp=f"2024-01-01T00:{n:02d}:00", record_primary_key=f"k{n % 2}", payload_before=None, payload_after="{}", batch_id="b",
                schema_version=1,
        event_sequence_number=n, event_hash=f"h{n}", kafka_topic="orders", kafka_partition=0, kafka_offset=n,
    )
    return row | over


def put(path, *rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_stream_lands_rejects_and_merges_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    latest = I.Buckets(spark, f"{out}/latest", I.WIRE, I.STATE, 4)
    known = I.landed_keys(spark, f"{out}/keys", 4)
    # an id's first arrival lands, not its greatest sequence; what a rejected event has blocks nothing
    put(src / "1.json", event(1), event(2), event(2, event_sequence_number=99, event_hash="h7"), event(3, operation_type="upsert"),
        event(8, event_hash="h1"), event(8, event_hash="h8"))

    def run():
        q = I.ingest(I.from_files(spark, str(src)), ("orders",), f"{out}/landed", f"{out}/rejected", latest, known, f"{out}/cp")
        q.awaitTermination(120)

    run()
    put(src / "2.json", event(2), event(9, event_hash="h1"), event(5), event(0))
    run()
    landed = spark.read.parquet(f"{out}/landed")
    assert sorted((r.event_id, r.event_hash) for r in landed.collect()) == [("e0", "h0"), ("e1", "h1"), ("e2", "h2"), ("e5", "h5"), ("e8", "h8")]
    assert [r.failure_category for r in spark.read.parquet(f"{out}/rejected").collect()] == ["UNKNOWN_OPERATION"]
    assert {r.record_primary_key: r.event_id for r in latest.read().collect()} == {"k0": "e8", "k1": "e5"}


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    t = I.Buckets(spark, f"{tmp_path}/t", "k long, v long", ["k"], 8)
    add = lambda old, more: old.unionByName(more)
    t.change(spark.range(100).selectExpr("id as k", "0L as v"), 0, add)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    one = spark.createDataFrame([(7, 1)], "k long, v long")
    t.change(one, 1, add)
    t.change(one, 1, add)  # the batch again
    new = [p for p in (tmp_path / "t").rglob("*.parquet") if before.get(p) != p.stat().st_mtime_ns]
    assert len({p.parents[1] for p in new}) == 1 and t.read().count() == 101 and t.read().where("v = 1").count() == 1
    t.change(one, 2, add)
    assert t.read().where("k = 7").count() == 3 and t.matching(one, 1).where("k = 7").count() <= 3
    assert all(len(list(b.glob("v=*"))) <= 2 for b in (tmp_path / "t").glob("bucket=*"))


def test_stateful_order(spark, tmp_path):
    put(tmp_path / "in" / "1.json", *[event(i, event_sequence_number=s, record_primary_key="k") for i, s in enumerate((20, 10, 30))])
    stream = I.from_files(spark, str(tmp_path / "in")).withColumns({"arrival_ordinal": F.col("kafka_offset"), "commit_us": F.lit(0).cast("bigint")})
    q = I.stateful_order(stream, ["tenant_id", "record_primary_key"]).writeStream.format("memory").queryName("anomalies").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_id, r.anomaly) for r in spark.table("anomalies").collect()] == [("e1", "out_of_order_sequence")]


def test_stateful_order_equals_the_batch_form(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 0, 1, 5, 9, 20, 30]), rnd.choice([None, None, 3, 8, 12]), f"k{i % 7}") for i in range(300)]
    put(tmp_path / "in" / "1.json", *[event(i % 60, event_id=f"e{i}", event_sequence_number=s, record_primary_key=k, kafka_offset=i,
        batch_id=str(-1 if c is None else c)) for i, s, c, k in rows])
    commit = F.nullif(F.col("batch_id").cast("bigint"), F.lit(-1))
    more = {"arrival_ordinal": F.col("kafka_offset"), "commit_us": commit}
    q = I.stateful_order(I.from_files(spark, str(tmp_path / "in")).withColumns(more),
        ["tenant_id", "record_primary_key"]).writeStream.format("memory").queryName("odd").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    whole = spark.read.schema(I.WIRE).json(str(tmp_path / "in")).withColumns(more)
    batch = cdc.ordering_anomalies(whole, ["tenant_id", "record_primary_key"]).collect()
    assert sorted((r.event_id, r.anomaly) for r in spark.table("odd").collect()) == sorted((f"e{r.arrival_ordinal}",
        r.anomaly) for r in batch) and len({r.anomaly for r in batch}) == 2


def test_files(spark, tmp_path):
    put(tmp_path / "a" / "x.jsonl", {"a": 1}, {"a": 2})
    assert files.jsonl(spark, str(tmp_path / "a"), "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "a" / "y.jsonl").write_text('{"a": 3}\n\nnot json\n')
    rows, bad = files.jsonl_lenient(spark, str(tmp_path / "a"), "a int")
    assert rows.count() == 3 and [r.value for r in bad.collect()] == ["not json"]
    assert files.csv(spark, str(tmp_path / "none"), "a int").count() == 0
    files.write_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "c"))
    assert files.csv(spark, str(tmp_path / "c"), "a int, b string").count() == 0 and any(p.read_text().startswith("a,b") for p in (tmp_path / "c").glob("part*"))
    big = files.scaled(spark.createDataFrame([("e", "k", "h", 1)], "event_id string, record_primary_key string, event_hash string, kafka_offset long"), 3)
    assert big.select("event_id").distinct().count() == 3 and big.where("event_hash is null").count() == 3
    m = I.to_messages(spark.createDataFrame([("t", "s", "k")], "kafka_topic string, source_system string, record_primary_key string")).first()
    assert (m.topic, m.key) == ("t", "s:k")


def test_only_valid_events_are_published(spark, tmp_path):
    put(tmp_path / "in" / "1.json", event(1), event(2, operation_type="upsert"), event(3, tenant_id=None))
    ok, bad = I.publishable(spark.read.schema(I.WIRE).json(str(tmp_path / "in")), ("orders",))
    assert [r.event_id for r in ok.collect()] == ["e1"] and sorted(r.reject_category for r in bad.collect()) == ["INVALID_TENANT", "UNKNOWN_OPERATION"]
    files.write_jsonl(ok.select("tenant_id", "event_id"), str(tmp_path / "out"))
    assert any(p.read_text().startswith('{"event_id":"e1","tenant_id":"t"}') for p in (tmp_path / "out").glob("part*"))
