"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

``LineRuns`` keeps every line hash once, with the documents that hold it and the
largest doc_id, in sorted runs by levels. A batch is merge-anti-joined with the
runs: what no run has becomes a run of its own; when a level has ``fan_in`` runs,
they are merged into one of the next level, which needs no aggregation, as no two
runs share a key. What the runs have already goes into runs of repeats, which hold
only lines that repeat; their counts are added at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import ROW_ID, dropped, saved, with_row_ids

SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a null doc_id: one document below all others.
NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; ``lower`` is the fast way where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """Levelled runs (h1, h2, docs, max_id), each sorted by its 128-bit hash, of keys when first seen, and runs of repeats."""

    KEY = ("h1", "h2")

    def __init__(self, fan_in: int = 4):
        self.fan_in, self.levels, self.repeats = fan_in, [[]], []

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, id); a document must lie in one batch whole."""
        batch = saved(lines.groupBy(*self.KEY).agg(F.countDistinct("id").alias("docs"), F.max("id").alias("max_id")), "batch")
        if not any(self.levels):
            self.levels[0].append(self._run(batch))
        else:
            new = self._run(self.unseen(batch))
            self.repeats.append(self._run(batch.join(new.select(*self.KEY).hint("merge"), list(self.KEY), "left_anti")))
            self.levels[0].append(new)
        dropped(batch)
        self._compact()

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch whose key is in no run yet."""
        for run in (r for level in self.levels for r in level):
            lines = lines.join(run.select(*self.KEY).hint("merge"), list(self.KEY), "left_anti")
        return lines

    def merged(self) -> DataFrame | None:
        """All runs as one, the counts of repeats added to those of the first documents; or None."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        both = reduce(DataFrame.unionByName, runs + self.repeats)
        return both.groupBy(*self.KEY).agg(F.sum("docs").alias("docs"), F.max("max_id").alias("max_id")) if self.repeats else both

    def drop(self) -> None:
        dropped(*self.repeats, *[r for level in self.levels for r in level])

    def _run(self, rows: DataFrame) -> DataFrame:
        return saved(rows.sortWithinPartitions(*self.KEY), "lines")

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fan_in:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._run(reduce(DataFrame.unionByName, level).repartitionByRange(*self.KEY)))
            dropped(*level)
            self.levels[k] = []


def without(lines: Column, places: Column) -> Column:
    """``lines`` without the elements at ``places`` (sorted, from 0), in time linear in both."""
    ends = F.concat(places, F.array(F.size(lines)))
    pieces = F.transform(
        ends,
        lambda end, i: F.slice(
            lines,
            F.when(i == 0, 1).otherwise(F.get(places, i - 1) + 2),
            end - F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1),
        ),
    )
    return F.flatten(pieces)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that stays), ``ROW_ID``.

    A line goes if its key (``line_key``) has at least ``min_chars`` code points
    and lies in at least ``min_docs`` documents, unless the document has the
    largest doc_id among them: there all its lines with the key stay. A text that
    is null or empty is one empty line. Rows with one doc_id are one document;
    those with a null doc_id are one document below all others, and each repeated
    row has its row. Lines and texts of any length are taken whole. An empty table
    gives an empty result; other columns, whatever their names, are not read.

    The runs take the documents in ``batches`` by a hash of doc_id. The rule needs
    the whole count, so verdicts come from the runs when all batches are in them.
    """
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    key = line_key(F.col("line"))
    lines = (
        rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), *ROW_ID, F.posexplode(split).alias("at", "line"))
        .select("id", *ROW_ID, "at", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", *ROW_ID, "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    )
    lines = saved(lines, "keys")
    runs = LineRuns(fan_in)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("h1", "h2", "id"))
    settled = saved(runs.merged().where(F.col("docs") >= min_docs), "settled")  # a table of its own: the join below can split hot keys
    runs.drop()
    gone = lines.select("id", *ROW_ID, "at", "h1", "h2").join(settled.hint("merge"), ["h1", "h2"]).where(F.col("id") != F.col("max_id"))
    places = saved(gone.groupBy(*ROW_ID).agg(F.sort_array(F.collect_list("at")).alias("places")), "places")
    dropped(lines, settled)
    kept = F.array_join(without(F.col("lines"), F.col("places")), "\n")
    return rows.join(places.hint("merge"), list(ROW_ID), "left").withColumn("lines", split).select(  # split behind the join: only texts are shuffled
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
        *ROW_ID,
    )
