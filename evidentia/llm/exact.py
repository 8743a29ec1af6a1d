"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition is one lane with a run of (digest, best row, count), sorted
by digest. In each round ``fan_in`` neighbouring lanes exchange their runs, cut
into slices of the digest space: a task gets the same slice of all runs, and a
multiway merge of these gives that slice of the next run. Of equal digests the
row that stays is retained with the number of rows below it. After log(lanes)
rounds one lane is left. The verdicts then go down the same tree, so that no
digest, however many copies it has, ever meets more than ``fan_in`` rows of a
round in one place.

A run holds a digest once and digests are uniform, so slices are of one size,
whatever the groups of copies are: each round takes as many as keep a slice of
all its runs at some SLICE_ROWS rows.

A digest is the whole SHA-256 of the normalised text, so runs merge on the
verified value and not on a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROW_ID, dropped, saved, with_row_ids
from .words import SPACE, texts_of

_RUN = [("lane", pa.int32()), ("digest", pa.binary()), ("order", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ROW_ID], ("n", pa.int64())]
_RUN_SCHEMA = "lane int, digest binary, order long, doc_id long, " + ", ".join(f"{c} long" for c in ROW_ID) + ", n long"

#: Rows of all runs of a round that a slice should hold.
SLICE_ROWS = 1_024


def merged_runs(table: pa.Table) -> pa.Table:
    """One sorted run of the rows of several: each digest once, with its best row and the sum of counts.

    The runs lie one after another, each sorted. numpy's stable sort finds such
    stretches and merges them, so a presorted run is not sorted again.
    """
    digest = np.array(table.column("digest").to_pylist(), "S32")
    by = np.argsort(digest, kind="stable")
    digest = digest[by]
    first = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
    table = table.take(pa.array(by))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
    keys = [table.column(c).to_numpy() for c in ("order", *ROW_ID)]
    null = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(table.column("doc_id"), 0).to_numpy()
    best = np.lexsort((keys[2], keys[1], ids, ~null, keys[0], group))[first]  # within a group: most code points, null ids, least id, file order
    counts = np.add.reduceat(table.column("n").to_numpy(), first)
    out = table.take(pa.array(best))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(counts, pa.int64()))


def digest_runs(docs: DataFrame) -> DataFrame:
    """The rows (n is null: lane, digest, order = minus the code points, doc_id, ROW_ID) and, with n, the sorted run of each lane."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        for batch in batches:
            made = [sha256(text.translate(None, SPACE)).digest() for text in texts_of(batch)]
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane] * len(made), pa.int32()), pa.array(made, pa.binary()), pc.negate(chars), batch.column("doc_id"), *[batch.column(c) for c in ROW_ID], pa.array([1] * len(made), pa.int64())],
                schema=pa.schema(_RUN),
            )

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last digest so far: more of its rows may follow
        for batch in batches:
            if not len(batch):
                continue
            yield batch.set_column(batch.schema.get_field_index("n"), "n", pa.nulls(len(batch), pa.int64()))
            table = pa.Table.from_batches([batch])
            made = merged_runs(table if held is None else pa.concat_tables([held, table]))
            held = made.slice(len(made) - 1)
            yield from made.slice(0, len(made) - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(digests, _RUN_SCHEMA).sortWithinPartitions("digest").mapInArrow(reduced, _RUN_SCHEMA)


def _round(runs: DataFrame, fan_in: int, lanes: int) -> DataFrame:
    """The runs of the next level: those of ``fan_in`` lanes merged into one, slice by slice."""
    slices = max(1, -(-runs.count() // (lanes * SLICE_ROWS)))

    def merge(table: pa.Table) -> pa.Table:
        up = pa.array(np.full(len(table), table.column("up")[0].as_py(), np.int32))
        table = table.drop_columns(["up", "slice"]).sort_by("lane")  # runs one after another
        return merged_runs(table.set_column(0, "lane", up)).select([c for c, _ in _RUN])

    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * slices / float(1 << 32)
    dealt = runs.withColumn("up", F.floor(F.col("lane") / fan_in).cast("int")).withColumn("slice", F.floor(place))
    return dealt.groupBy("up", "slice").applyInArrow(merge, _RUN_SCHEMA)


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest, chars and ``ROW_ID``.

    Texts are equal when identical without the characters 0x20 and 0x09-0x0D;
    null counts as empty. Of equal texts the row with most code points stays,
    then the smallest doc_id (null before all), then the first in file order,
    so exactly one of repeated rows. An empty table gives an empty result;
    texts of any length are taken whole, and further columns of ``docs``,
    whatever their names, are not read.
    """
    both = saved(digest_runs(docs), "digests")
    rows, run = both.where("n is null"), both.where("n is not null")
    top = run.agg(F.max("lane")).first()[0] or 0
    levels = [run]
    while top:
        top //= fan_in
        levels.append(saved(_round(levels[-1], fan_in, top + 1), "run"))

    best = ["lane", "digest", "doc_id", *ROW_ID, "n"]
    verdict = levels.pop().select(best)
    for run in reversed(levels):
        above = verdict.withColumnRenamed("lane", "up")
        lower = run.select("lane", "digest", F.floor(F.col("lane") / fan_in).cast("int").alias("up"))
        verdict = lower.join(above, ["up", "digest"]).select(best)
    verdict = saved(verdict, "verdict").select("lane", "digest", F.struct("doc_id", *ROW_ID, "n").alias("best"))
    dropped(*levels[1:])
    same = [F.col(c).eqNullSafe(F.col(f"best.{c}")) for c in ROW_ID]
    return rows.join(verdict.hint("merge"), ["lane", "digest"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.n").alias("group_size"),
        (same[0] & same[1]).alias("kept"),
        "digest",
        (-F.col("order")).alias("chars"),
        *ROW_ID,
    )
