"""A replay: chosen events marked, written, ingested again, and noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cdc


def run_replay(
    events: DataFrame, replay_id: str, at: Column, output: str | None = None, start: Column | None = None, end: Column | None = None,
        batches: list[str] | None = None, tables: list[str] | None = None,
    checkpoints: DataFrame | None = None, again: Callable[[DataFrame], None] | None = None, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(manifest, checkpoints left, alerts).

    The events from ``start`` up to ``end`` (excluded), of the given batches and tables, are marked as a replay, written to
    ``output`` as Parquet, and what was written is given to ``again`` (an ingest, which drops what has landed before). With
    ``checkpoints`` those of the replayed tables are cleared, an alert row for each. A dry run only counts. The manifest has one row:
    what was chosen, how many, the status.
    """
    chosen = cdc.select_replay(events, replay_id, start, end, batches, tables)
    left = alerts = None
    if not dry_run:
        if output is None:
            raise ValueError("a replay that is no dry run needs an output")
        chosen.write.mode("overwrite").parquet(output)
        chosen = events.sparkSession.read.parquet(output)
        if checkpoints is not None:
            left, alerts = cdc.reset_checkpoints(checkpoints, chosen)
        if again is not None:
            again(chosen)
    none = F.lit(None).cast("timestamp_ntz")
    manifest = chosen.agg(F.count("*").alias("selected_count")).select(
        F.lit(replay_id).alias("replay_run_id"), F.lit(output).alias("output_path"), "selected_count",
            (none if start is None else start).alias("start_timestamp"), (none if end is None else end).alias("end_timestamp"),
        F.lit(",".join(sorted(batches or []))).alias("batch_ids"), F.lit(",".join(sorted(tables or []))).alias("source_tables"),
            F.lit(checkpoints is not None and not dry_run).alias("reset_checkpoints"),
        at.alias("replayed_at"), F.lit("dry_run" if dry_run else "success").alias("status"),
    )
    return manifest, left, alerts
