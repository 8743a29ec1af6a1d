"""Change events as a stream: routing, the latest state of each file, and watermarked counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import routed
from ..operators.maintain import latest, upsert

KINDS = ("create", "modify", "remove")


def routed_events(events: DataFrame) -> DataFrame:
    """Events (path, kind, ts) of the three kinds that are not ignored, with ``route``."""
    return events.where(F.col("kind").isin(*KINDS)).withColumn("route", routed(F.col("path"))).where("route <> 'ignored'")


def state_writer(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last event of each key in a stored table.

    A batch that is delivered again changes nothing: its rows win or lose by
    their order as before.
    """

    def batch(df: DataFrame, _: int) -> None:
        fresh = latest(df, [key], [order])
        old = read()
        if old is not None:
            both = old.unionByName(fresh)
            fresh = upsert(old, latest(both, [key], [order]), [key])
        write(fresh)

    return batch


def change_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window_start, kind, n) of events (ts, kind), with a watermark: an extension beyond the batch engine."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "kind", "n")
