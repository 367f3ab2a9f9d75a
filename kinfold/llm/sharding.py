"""K-d tree partitioning: weighted medians along the widest dimension, level by level.

The tree halves the bytes (or, for an odd number of leaves, splits them in proportion)
until every leaf holds the target. All nodes of a level are cut together. A cut is found by
histogram: bytes are summed by (node, bin) over the node's range, the bin that holds the
median becomes the next range, until it is one value. Ties on the dimension are cut by
text hash in the same way, so equal texts stay in one leaf, unless a group of them is so
heavy that the leaf would be off by more than ``tolerance``; such a group is cut by id.

Scale: a pass moves one row per node and bin out of each task; the driver keeps one row per
node (as many as there are leaves). Each point's node is written after every level, so a level costs one
pass of its own, whatever its depth. No shard is ever ordered as a whole: numbers inside a
shard are dealt in hash buckets, each offset by the sizes of those before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, settle
from .common import without

BINS = 2048
SLOT_BUCKETS = 1024
MADE = ("size", "shard", "slot")


def prefix_number(text: Column) -> Column:
    """A string's first six bytes as a number that keeps their order; null is -1."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long"), F.lit(-1))


def _crossing(points: DataFrame, ranges: list[tuple], at_most_passes: int = 8) -> dict:
    """node -> (value, weight before it, its weight): the value of ``k`` at which each node's
    weight first reaches its aim. points: (node, k, w); ranges: (node, lo, hi, before, aim)."""
    spark, found = points.sparkSession, {}
    for _ in range(at_most_passes * 8):
        if not ranges:
            break
        r = _small(spark, ranges, "node long, lo long, hi long, before double, aim double")
        width = F.greatest(F.lit(1).cast("decimal(38,0)"), F.ceil((F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1) / F.lit(BINS)))
        r = r.withColumn("width", width.cast("long"))
        inside = points.join(r, "node").where("k between lo and hi")
        bin_ = F.floor((F.col("k").cast("decimal(38,0)") - F.col("lo")) / F.col("width")).cast("int")
        sums = inside.groupBy("node", bin_.alias("bin")).agg(
            F.sum("w").alias("w"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.first("before").alias("before"), F.first("aim").alias("aim")
        )
        by = Window.partitionBy("node").orderBy("bin")
        sums = sums.withColumn("end", F.col("before") + F.sum("w").over(by))
        sums = sums.withColumn("over", (F.col("end") >= F.col("aim")) | (F.lead("bin").over(by).isNull()))
        first = sums.where("over").groupBy("node").agg(F.min_by(F.struct("lo", "hi", (F.col("end") - F.col("w")).alias("before"), "aim", "w"), "bin").alias("x"))
        ranges = []
        for row in first.select("node", "x.*").collect():  # one row per open node
            if row.lo == row.hi:
                found[row.node] = (row.lo, row.before, float(row.w))
            else:
                ranges.append((row.node, row.lo, row.hi, row.before, row.aim))
    return found


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, one per node; broadcast while they are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= 100_000 else df


def _dims(points: DataFrame) -> list[str]:
    return [c for c in points.columns if c.startswith("__d")]


def _step(points: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``points`` with ``__node`` one level down where ``cuts`` has a cut of it. Of the input's columns only ``row`` is there,
    so none can be taken for one of these."""
    c = _small(points.sparkSession, cuts, "__node long, __cdim int, __cv long, __ct long, __ci long")
    v = F.coalesce(*[F.when(F.col("__cdim") == j, F.col(d)) for j, d in enumerate(_dims(points))])
    t, i = F.col("__t"), F.col("__i")
    right = (v > F.col("__cv")) | ((v == F.col("__cv")) & ((t > F.col("__ct")) | ((t == F.col("__ct")) & (i > F.col("__ci")))))
    step = F.when(F.col("__cdim").isNull(), F.col("__node")).otherwise(F.col("__node") * 2 + F.coalesce(right.cast("int"), F.lit(0)))
    keep = [F.col(x) for x in points.columns if x != "__node"]
    return points.join(c, "__node", "left").select(*keep, step.alias("__node"))


def _place(points: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """``points`` with ``__node``: the leaf each falls into."""
    out = points.withColumn("__node", F.lit(1).cast("long"))
    for cuts in levels:
        out = _step(out, cuts)
    return out


def grow(points: DataFrame, leaves: int, tolerance: float = 0.01) -> tuple[list[list[tuple]], dict[int, int]]:
    """The cuts of each level and leaf node -> shard number, for ``points`` with longs
    ``__d0..`` (dimensions), ``__t`` (text hash), ``__i`` (id hash) and ``__w`` (bytes)."""
    dims = _dims(points)
    levels, open_, done = [], {1: leaves}, {}
    span, placed, owned = None, _place(points, []), None
    while True:
        done.update({n: k for n, k in open_.items() if k <= 1})
        open_ = {n: k for n, k in open_.items() if k > 1}
        if not open_:
            break
        stats = placed.groupBy(F.col("__node").alias("node")).agg(F.sum("__w").alias("w"), *[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        stats = {s.node: s for s in stats if s.node in open_}
        if span is None:
            s = stats.get(1)
            if s is None:  # no rows: everything falls into the first leaf
                return [], {1: 0}
            span = [max(1, s[f"hi{d}"] - s[f"lo{d}"]) for d in dims]
        cuts, ranges = {}, []
        for n, k in open_.items():
            s = stats.get(n)
            if s is None:
                done.update({n: 1})
                continue
            j = max(range(len(dims)), key=lambda x: ((s[f"hi{dims[x]}"] - s[f"lo{dims[x]}"]) / span[x], -x))
            cuts[n] = [j, float(s.w), s.w * (k // 2) / k]
            ranges.append((n, s[f"lo{dims[j]}"], s[f"hi{dims[j]}"], 0.0, cuts[n][2]))
        along = F.coalesce(*[F.when(F.col("dim") == j, F.col(d)) for j, d in enumerate(dims)])
        chosen = _small(points.sparkSession, [(n, c[0]) for n, c in cuts.items()], "__node long, dim int")
        work = placed.join(chosen, "__node").select(F.col("__node").alias("node"), along.alias("k"), F.col("__w").alias("w"), "__t", "__i")
        low, high = -(1 << 63), (1 << 63) - 1
        at = _crossing(work.select("node", "k", "w"), ranges)

        def ties(col: str, names: list[str], rows: list[tuple], inner: DataFrame) -> dict:
            c = _small(points.sparkSession, rows, "node long, " + ", ".join(f"{x} long" for x in names))
            return inner.join(c, ["node", *names]).select("node", F.col(col).alias("k"), "w")

        tied = ties("__t", ["k"], [(n, v[0]) for n, v in at.items()], work)
        at_t = _crossing(tied, [(n, low, high, v[1], cuts[n][2]) for n, v in at.items()])
        this, heavy = [], []
        for n, (t, before, weight) in at_t.items():
            aim = cuts[n][2]
            slack = tolerance * cuts[n][1] / open_[n]
            if min(aim - before, before + weight - aim) <= slack:
                whole = before + weight - aim <= aim - before
                this.append((n, cuts[n][0], at[n][0], t, high if whole else low))
            else:
                heavy.append(n)
        if heavy:
            again = work.withColumnRenamed("__t", "t")
            group = ties("__i", ["k", "t"], [(n, at[n][0], at_t[n][0]) for n in heavy], again)
            at_i = _crossing(group, [(n, low, high, at_t[n][1], cuts[n][2]) for n in heavy])
            for n, (i, before, weight) in at_i.items():
                whole = before + weight - cuts[n][2] <= cuts[n][2] - before
                this.append((n, cuts[n][0], at[n][0], at_t[n][0], i if whole or i == low else i - 1))
        levels.append(this)
        grown = {}
        for n, k in open_.items():
            if n in cuts:
                grown |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
        open_ = grown
        if any(k > 1 for k in open_.values()):
            placed = settle(_step(placed, this), "kd-nodes")
            discard(owned)
            owned = placed
    discard(owned)

    def order(n: int) -> str:
        return bin(n)[3:]

    numbers = {n: i for i, n in enumerate(sorted(done, key=order))}
    return levels, numbers


def shards(docs: DataFrame, count: int | None = 16, target_bytes: int | None = None, dims: dict[str, Column] | None = None, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, null none, plus 1), ``shard`` (from 0) and
    ``slot`` (gapless from 0 in its shard).

    ``count`` leaves, or as many as bytes in all over ``target_bytes``. ``dims``: metadata
    expressions that give longs; by default size, source and language, the last two by the order of
    their first bytes. Null is below every value. Equal texts (of null and empty, alike) have one
    place, the least of each dimension, and share a shard unless their group outweighs the tolerance; rows that agree in all (repeats) may share a cut's side
    only together. Tables with fewer rows than leaves leave leaves empty; an empty table gives an
    empty result. Input columns with the names made here give way to them.
    """
    body = F.col(f"`{text}`")
    rows = without(docs, *MADE)
    given = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn("size", F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1)
    if dims is None:
        named = {c.lower(): c for c in docs.columns}
        dims = {"size": F.col("size")} | {c: prefix_number(F.col(f"`{named[c]}`")) for c in ("source", "lang") if c in named}
    points = rows.select(
        F.struct(*given).alias("row"), "size", *[F.coalesce(d.cast("long"), F.lit(-(1 << 62))).alias(f"__d{i}") for i, d in enumerate(dims.values())],
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("__t"), F.xxhash64(F.col(f"`{doc_id}`")).alias("__i"), F.col("size").alias("__w"),
    )
    keys = points.columns[2:]
    # a group of equal texts is one place: the least of each dimension over its documents
    own = _dims(points)
    group = settle(points.groupBy("__t").agg(*[F.min(c).alias(c) for c in own]), "kd-groups")
    points = points.drop(*own).join(group, "__t")
    slim = settle(points.select(*keys), "kd-points")
    if target_bytes is not None:
        total = slim.agg(F.sum("__w")).first()[0] or 0
        count = max(1, math.ceil(total / target_bytes))
    levels, numbers = grow(slim, count, tolerance)
    leaf = _small(docs.sparkSession, list(numbers.items()), "__node long, shard int")

    def placed(df: DataFrame) -> DataFrame:
        df = _place(df, levels).join(leaf, "__node", "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
        return df.withColumn("__b", F.pmod("__i", F.lit(SLOT_BUCKETS)))

    # numbers inside a shard: offsets of its buckets, then the place in the bucket
    counts = placed(slim).groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    by = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(by), F.lit(0))).drop("__n")
    inner = Window.partitionBy("shard", "__b").orderBy("__i", "__t")
    out = placed(points).join(settle(counts, "kd-slots"), ["shard", "__b"])
    out = out.withColumn("slot", (F.col("__from") + F.row_number().over(inner) - 1).cast("long"))
    return out.select("row.*", "size", "shard", "slot")
