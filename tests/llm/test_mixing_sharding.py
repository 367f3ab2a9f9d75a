import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing, sharding, simhash


def filled(held, weights, cap=3.0):
    """Plain water-filling."""
    total, target, capped = sum(held.values()), {}, set()
    while True:
        rest = total - sum(cap * held[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in held if s not in capped and free and rest * weights[s] / free > cap * held[s] + 1e-9}
        if not over:
            return {s: cap * held[s] if s in capped else rest * weights[s] / free for s in held}
        capped |= over


def docs(spark, n=3000, sources=6):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randrange(0, 60), None if s == 0 else f"s{s}", "x") for i in range(n) for s in [min(int(rnd.expovariate(0.6)), sources - 1)]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mix_meets_the_targets(spark):
    d = docs(spark)
    w = mixing.ranked_weights(d)
    assert {r.source: r.weight for r in w.collect()} == {"s1": 1.0, "s2": 2.0, "s3": 3.0, "s4": 1.0, "s5": 2.0, None: 3.0}
    rows = mixing.mix(d, w).collect()
    held, took, want = {}, {}, {}
    for r in rows:
        assert r.size == len(r.text.split()) and r.taken == r.reps * r.size and 0 <= r.reps <= 3
        held[r.source] = held.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.taken
        want[r.source] = r.target
    plain = filled(held, {r.source: r.weight for r in w.collect()})
    for s in held:
        assert want[s] == pytest.approx(plain[s]) and abs(took[s] - want[s]) <= 60 and {r.source_size for r in rows if r.source == s} == {held[s]}
    again = {(r.doc_id, r.reps) for r in mixing.mix(d.repartition(7), w).collect()}
    assert again == {(r.doc_id, r.reps) for r in rows} != {(r.doc_id, r.reps) for r in mixing.mix(d, w, seed=99).collect()}
    out = mixing.expand(mixing.mix(d, w))
    assert out.count() == sum(r.reps for r in rows) and set(out.columns) == {"doc_id", "text", "source"}


def test_mix_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "x y", "a"), (2, "x y", None), (2, "x y", None), (3, "", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(df, mixing.ranked_weights(df)).collect()
    assert len(rows) == 5 and sum(r.size for r in rows) == 6 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(df.limit(0), mixing.ranked_weights(df.limit(0))).count() == 0
    none = spark.createDataFrame([("zzz", 1.0)], "source string, weight double")
    assert {r.reps for r in mixing.mix(df, none).collect()} == {0}


def test_infeasible_weights_stop_at_the_caps(spark):
    s = spark.createDataFrame([("a", 1.0, 10), ("b", 0.0, 90), ("c", None, 5)], "s string, weight double, held long")
    assert {r.s: r.target for r in mixing.water_fill(s).collect()} == {"a": 30.0, "b": 0.0, "c": 0.0}


def test_word_count_equals_split(spark):
    from kinfold.llm.common import word_count

    texts = [" a\tb\nc \x0b\x0c\r", "a\x85b\xa0c d", "", None, "\x1cx y", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


@pytest.mark.parametrize("count", [1, 5, 16])
def test_shards_are_near_equal_and_slots_gapless(spark, count):
    d = docs(spark, 4000).withColumns({"node": F.lit(1), "slot": F.lit("x"), "lang": F.lit("en")})
    rows = sharding.shards(d, count=count).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.size == len(r.text.encode()) + 1 and r.node == 1
    assert len(rows) == 4000 and sorted(by) == list(range(count))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 0.06 * sum(sizes) / count


def test_equal_texts_stay_together_unless_too_heavy(spark):
    rows = [(i, f"text {i // 4} " * 30, f"s{i % 7}") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shards(d, count=8).groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert got.where("n > 1").count() == 0
    hot = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "hot " * 30).otherwise(F.col("text")))
    sizes = [r.b for r in sharding.shards(hot, count=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_shards_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None), (None, "", "x"), (2, "é", None), (2, "é", None)], "doc_id long, text string, source string")
    rows = sharding.shards(d, count=4).collect()
    assert sorted(r.size for r in rows) == [1, 1, 3, 3] and sharding.shards(d.limit(0), count=4).count() == 0
    assert sharding.shards(d, target_bytes=4).select("shard").distinct().count() == 2 and len({r.shard for r in sharding.shards(d, count=1).collect()}) == 1


def plain_tree(points, leaves, tolerance=0.01):
    """Leaf numbers by a plain k-d tree over (dims, text hash, id hash, weight)."""
    span = [max(1, max(p[0][j] for p in points) - min(p[0][j] for p in points)) for j in range(len(points[0][0]))]
    out, leaf = {}, [0]

    def crossing(rows, key, before, aim):
        sums = {}
        for p in rows:
            sums[key(p)] = sums.get(key(p), 0) + p[3]
        for k in sorted(sums):
            if before + sums[k] >= aim or k == max(sums):
                return k, before, sums[k]
            before += sums[k]

    def cut(rows, k):
        if k <= 1 or not rows:
            out.update({id(p): leaf[0] for p in rows})
            leaf[0] += 1
            return
        wide = [(max(p[0][j] for p in rows) - min(p[0][j] for p in rows)) / span[j] for j in range(len(span))]
        j, total = wide.index(max(wide)), sum(p[3] for p in rows)
        aim = total * (k // 2) / k
        v, before, _ = crossing(rows, lambda p: p[0][j], 0, aim)
        tied = [p for p in rows if p[0][j] == v]
        t, before, weight = crossing(tied, lambda p: p[1], before, aim)
        if min(aim - before, before + weight - aim) <= tolerance * total / k:
            upto = (v, t, 1 << 64) if before + weight - aim <= aim - before else (v, t, -(1 << 64))
        else:
            i, before, weight = crossing([p for p in tied if p[1] == t], lambda p: p[2], before, aim)
            upto = (v, t, i if before + weight - aim <= aim - before else i - 1)
        cut([p for p in rows if (p[0][j], p[1], p[2]) <= upto], k // 2)
        cut([p for p in rows if (p[0][j], p[1], p[2]) > upto], k - k // 2)

    cut(points, leaves)
    return out


@pytest.mark.parametrize("count", [2, 7, 16])
def test_shards_equal_a_plain_tree(spark, count):
    rnd = random.Random(count)
    rows = [(i, f"t{rnd.randrange(900)} " * rnd.randrange(1, 9), rnd.randrange(-50, 50), rnd.randrange(10)) for i in range(1500)]
    rows += [(2000 + i, "hot " * 20, 7, 3) for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, a long, b long")
    got = sharding.shards(d, count=count, dims={"a": F.col("a"), "b": F.col("b")}).withColumns({"t": F.xxhash64("text"), "i": F.xxhash64("doc_id")}).collect()
    place = {}
    for r in got:  # equal texts have one place, the least of each dimension
        a, b = place.get(r.t, (r.a, r.b))
        place[r.t] = (min(a, r.a), min(b, r.b))
    points = [(place[r.t], r.t, r.i, r.size) for r in got]
    want = plain_tree(points, count)
    assert [r.shard for r in got] == [want[id(p)] for p in points]


def test_columns_named_like_the_operators_own_stay(spark):
    names = ["__d0", "__index_level_0__", "__node", "__t", "row", "__u", "__b", "__s", "__i", "__h", "__id", "source_size"]
    d = docs(spark, 60).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    out = sharding.shards(d, count=4)
    assert set(out.columns) == {*d.columns, "size", "shard", "slot"}
    assert all(r["__d0"] == f"__d0{r.doc_id}" and r["row"] == f"row{r.doc_id}" for r in out.collect())
    mixed = mixing.mix(d, mixing.ranked_weights(d))
    assert set(mixed.columns) == {*d.columns, "size", "source_size", "target", "reps", "taken"}
    assert all(r["__u"] == f"__u{r.doc_id}" and r["__b"] == f"__b{r.doc_id}" for r in mixed.collect())
    assert all(r["__i"] == f"__i{r.doc_id}" for r in mixing.expand(mixed).collect())
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns and all(r["__h"] == f"__h{r.doc_id}" and r["__id"] == f"__id{r.doc_id}" for r in kept.collect())
