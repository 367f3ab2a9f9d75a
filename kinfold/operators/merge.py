"""Upserts and insert-ignore over immutable files: the new state is one aggregate of old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that is greatest by ``order``. A partial aggregate before the shuffle keeps one row
    per key and task, so hot keys cost no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("x")
    return rows.groupBy(*keys).agg(best).select(*keys, "x.*").select(*rows.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The state after a merge: changes replace rows that aren't newer, others are added; of several
    changes to a key the greatest counts; deletes stay as flagged rows. A change as new as the target's row wins."""
    both = target.withColumn("__side", F.lit(0)).unionByName(changes.select(*target.columns).withColumn("__side", F.lit(1)))
    return latest(both, keys, *order, "__side").drop("__side")


def insert_ignore(target: DataFrame, new: DataFrame, *unique: list[str]) -> DataFrame:
    """``new`` rows whose values of none of the ``unique`` column sets are in ``target`` already; nulls never match."""
    out = new
    for keys in unique:
        out = out.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return out


def apply_changes(target: DataFrame, events: DataFrame, keys: list[str], *order: str, operation: str = "operation_type") -> DataFrame:
    """A plain table after its change events: of each key the newest event's row, none where that is a delete; keys without events
    stay. ``events`` have the columns of ``target``, those of ``order`` and ``operation``."""
    cols = target.columns
    newest = latest(events.select(*cols, *[c for c in order if c not in cols], operation), keys, *order)
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest.where(F.lower(operation) != "delete").select(*cols))
