"""Interval histories: building, asking at an instant, checking, and snapshots between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scd2(changes: DataFrame, keys: list[str], at: str, event_id: str, deleted: str | None = None) -> DataFrame:
    """Half-open intervals per key: ``valid_from``, ``valid_to`` (null while open), ``is_current``.

    Changes are ordered by (``at``, ``event_id``); of changes at the same instant the last stands. A
    deleted state stays as an open interval that isn't current. Rows with a null key or time are left out. Late rows
    land where they belong, since intervals are built from all changes. One shuffle on the keys serves
    both windows.
    """
    part = Window.partitionBy(*keys)
    rows = changes.where(" and ".join(f"{k} is not null" for k in [*keys, at]))
    rows = rows.withColumn("__next", F.lead(at).over(part.orderBy(at, event_id)))
    rows = rows.where(F.col("__next").isNull() | (F.col("__next") > F.col(at)))  # the last of an instant
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    return rows.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.col("__next")).withColumn("is_current",
        F.col("__next").isNull() & ~gone).drop("__next")


def as_of(history: DataFrame, keys: list[str], at: Column, deleted: str | None = None, tie: str | None = None) -> DataFrame:
    """The row of each key that holds at an instant; the newest if several do; none where it is deleted."""
    inside = history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    rank = F.struct("valid_from", *([tie] if tie else []))
    best = inside.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in history.columns if c not in keys]), rank).alias("x")).select(*keys, "x.*")
    return best.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else best


def as_of_join(facts: DataFrame, history: DataFrame, on: list[str], at: str) -> DataFrame:
    """Each fact with the interval that held at its time, or nulls; a key's intervals don't overlap (as ``scd2`` builds them).

    Facts and starts of intervals are one stream per key, in which each fact takes the last start before it: linear in both,
    where a join would look at every interval of a fact's key. Facts with a null key or time take no part in it.
    """
    rest = [c for c in history.columns if c not in on]
    keyed = " and ".join(f"`{c}` is not null" for c in [*on, at])
    none = F.lit(None)
    f, h = F.struct(*[F.col(f"`{c}`") for c in facts.columns]), F.struct(*[F.col(f"`{c}`") for c in rest])
    fact_type, hist_type = facts.select(f.alias("x")).schema[0].dataType, history.select(h.alias("x")).schema[0].dataType
    starts = history.where(" and ".join(f"`{c}` is not null" for c in [*on, "valid_from"])).select(*on, F.col("valid_from").alias("__t"),
        F.lit(0).alias("__side"), none.cast(fact_type).alias("__f"), h.alias("__h"))
    asked = facts.where(keyed).select(*on, F.col(at).alias("__t"), F.lit(1).alias("__side"), f.alias("__f"), none.cast(hist_type).alias("__h"))
    by = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(asked).withColumn("__last", F.last("__h", ignorenulls=True).over(by)).where("__side = 1")
    holds = F.col("__last.valid_to").isNull() | (F.col("__last.valid_to") > F.col("__t"))
    met = met.select("__f.*", *[F.when(holds, F.col(f"__last.`{c}`")).alias(c) for c in rest])
    apart = facts.where(f"not ({keyed})").select(*[F.col(f"`{c}`") for c in facts.columns], *[none.cast(hist_type[c].dataType).alias(c) for c in rest])
    return met.unionByName(apart)


def invariants(history: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Violations: (keys, problem) - an empty window, an overlap with the next interval, several current rows."""
    part = Window.partitionBy(*keys)
    nxt = F.lead("valid_from").over(part.orderBy("valid_from", tie))
    rows = history.withColumn("__next", nxt).withColumn("__current", F.count_if(F.coalesce("is_current", F.lit(False))).over(part))
    problem = F.array_compact(
        F.array(
            F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("invalid_window")),
            F.when(F.col("__next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("__next"))), F.lit("overlap")),
            F.when(F.col("__current") > 1, F.lit("multiple_current")),
        )
    )
    return rows.select(*keys, F.explode(problem).alias("problem")).distinct()


def snapshot(previous: DataFrame, current: DataFrame, keys: list[str], updated_at: str, as_of: Column) -> DataFrame:
    """A row-version snapshot by comparison with the previous one, hard deletes closed.

    ``previous`` has the columns of ``current`` with ``snap_from`` and ``snap_to``. Keys that are new or have a later
    ``updated_at`` get an open version; changed or missing ones close theirs. One full outer join on the keys.
    """
    open_ = previous.where("snap_to is null").alias("p")
    cols = current.columns
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    met = open_.join(current.withColumn("__here", F.lit(True)).alias("c"), cond, "full_outer")
    here, was = F.coalesce(F.col("c.__here"), F.lit(False)), F.col("p.snap_from").isNotNull()
    changed = here & (~was | (F.col(f"c.{updated_at}") > F.col(f"p.{updated_at}")))
    closes = was & (~here | changed)
    old = met.where(was).select(*[F.col(f"p.{c}") for c in cols], F.col("p.snap_from"),
        F.when(closes, F.when(here, F.col(f"c.{updated_at}")).otherwise(as_of)).alias("snap_to"))
    new = met.where(changed).select(*[F.col(f"c.{c}") for c in cols], F.col(f"c.{updated_at}").alias("snap_from"),
        F.lit(None).cast(dict(previous.dtypes)["snap_to"]).alias("snap_to"))
    closed = previous.where("snap_to is not null").select(*cols, "snap_from", "snap_to")
    return closed.unionByName(old).unionByName(new)
