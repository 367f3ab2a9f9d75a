"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets share the total by weight; a source's target stops at ``max_epochs`` times what it
holds, and the excess is reshared by weight among the rest until none is above. Each
document is then taken whole as often as its source's target holds the source, and the
remaining fraction of the source is filled with documents in the order of a seeded hash.

DataFrame functions only. What is gathered is one row per source and the few scalars of a
water-filling round; the fraction's cut is found from sums over hash buckets, then exactly
inside the one bucket that holds it, so a hot source is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from .common import fresh, without, word_count

BUCKETS = 4096
MADE = ("size", "source_size", "target", "reps", "taken")


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """``sources`` (key, weight, held) with ``target`` (double); the targets share the sum of
    ``held`` by weight and none is above ``max_epochs * held``.

    A weight of null or below zero counts as 0. Weights that are all zero give no target (0);
    targets also stay below the total where the sources that have a weight can't hold it.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)).cast("double"), F.lit(0.0))
    held = F.coalesce(F.col("held"), F.lit(0)).cast("double")
    s = sources.withColumn("weight", weight).withColumn("held", held).withColumn("cap", held * F.lit(float(max_epochs)))
    total = s.agg(F.sum("held")).first()[0] or 0.0
    level = 0.0  # words per unit of weight
    while True:
        clamped = F.col("cap") <= F.col("weight") * F.lit(level)
        row = s.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        raised = (total - row.full) / row.open
        if raised <= level:
            break
        level = raised
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))).drop("cap")


def mix(docs: DataFrame, weights: DataFrame, max_epochs: float = 3.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source, double),
    ``reps`` (int: how often the mix takes it) and ``taken`` (``size * reps``).

    ``weights``: (source, weight), a row per source, null allowed as a source; a source
    without a row has weight 0. The words taken of each source come within about one document
    of its target. A null text is empty (size 0). Rows that agree in id and text share one
    fate. Input columns with the names made here give way to them. An empty table gives an
    empty result. The same seed and rows give the same mix, whatever the partitioning.
    """
    rows = without(docs, *MADE)
    u, b, s, whole_, cut_b, last_ = fresh(docs, "__u", "__b", "__s", "__w", "__cb", "__last")
    rows = rows.withColumn("size", word_count(F.col(f"`{text}`"))).withColumn(u, F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    rows = rows.withColumn(b, F.pmod(F.col(u), F.lit(BUCKETS)))
    slim = settle(rows.select(F.col(f"`{source}`").alias("s"), "size", F.col(u).alias("u"), F.col(b).alias("b")), "sizes")
    held = slim.groupBy("s").agg(F.sum("size").alias("held"))
    weighed = held.alias("h").join(weights.select(F.col("source").alias("ws"), "weight").alias("w"), F.col("h.s").eqNullSafe(F.col("w.ws")), "left")
    filled = settle(water_fill(settle(weighed.select("s", "weight", "held"), "held"), max_epochs).select("s", "held", "target"), "targets")
    ratio = F.when(F.col("held") > 0, F.col("target") / F.col("held")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(1e-12)).cast("int")
    plan = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("held"))

    sums = slim.groupBy("s", "b").agg(F.sum("size").alias("n"))
    by_bucket = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)))
    same = F.col("p.s").eqNullSafe(F.col("q.s"))
    cut = (
        plan.alias("p").join(sums.alias("q"), same)
        .where((F.col("q.before") <= F.col("p.rest")) & (F.col("p.rest") < F.col("q.before") + F.col("q.n")))
        .select("p.s", "q.b", "q.before", "p.rest")
    )
    # inside the bucket that holds the cut: distinct hashes in order, up to the nearest end
    inside = (
        slim.alias("q").join(cut.alias("p"), same & (F.col("q.b") == F.col("p.b")))
        .groupBy("q.s", "q.b", "q.u").agg(F.sum("q.size").alias("n"), F.first("p.before").alias("before"), F.first("p.rest").alias("rest"))
    )
    upto = Window.partitionBy("s").orderBy("u")
    inside = inside.withColumn("end", F.col("before") + F.sum("n").over(upto))
    last = inside.where(F.col("end") - F.col("n") / 2 <= F.col("rest")).groupBy("s").agg(F.max("u").alias("last"))
    cuts = cut.alias("p").join(last.alias("q"), same, "left").select("p.s", F.col("p.b").alias("cut_b"), "q.last")
    plan = (
        plan.alias("p").join(cuts.alias("q"), same, "left")
        .select(F.col("p.s").alias(s), F.col("p.held").alias("source_size"), F.col("p.target").alias("target"), F.col("p.whole").alias(whole_), F.col("q.cut_b").alias(cut_b), F.col("q.last").alias(last_))
    )
    extra = (F.col(b) < F.col(cut_b)) | ((F.col(b) == F.col(cut_b)) & (F.col(u) <= F.col(last_)))
    out = rows.join(settle(plan, "mix-plan"), F.col(f"`{source}`").eqNullSafe(F.col(s)))
    out = out.withColumn("source_size", F.col("source_size").cast("long"))
    out = out.withColumn("reps", F.col(whole_) + F.coalesce(extra.cast("int"), F.lit(0)))
    return out.withColumn("taken", F.col("size") * F.col("reps")).drop(u, b, s, whole_, cut_b, last_)


def ranked_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, weight): sources in the order of their code points, null last, weigh 1, 2, 3,
    repeating. The order runs over one row per source."""
    kinds = docs.select(F.col(f"`{source}`").alias("source")).distinct()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return kinds.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def expand(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``reps`` says; the columns made by ``mix`` go."""
    (i,) = fresh(mixed, "__i")
    rows = mixed.where(F.col("reps") > 0).withColumn(i, F.explode(F.array_repeat(F.lit(0), F.col("reps"))))
    return without(rows, *MADE, i)
