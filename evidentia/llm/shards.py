"""Sharding by rendezvous hashing, in DataFrame operations only.

Each shard draws a number from the record's key and its own name; the shard
with the best draw, scaled by its weight, takes the record. A further shard
changes only the draws that it wins, so records move into it and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import ROW_ID, saved, with_row_ids

#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def draw(key: Column, name: int) -> Column:
    """A number in (0, 1) from the key and a shard's name."""
    digest = F.md5(F.concat(key, F.lit(f"/{name}")))
    whole = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, by its place in ``weights``, that takes the key; a shard of weight 0 takes none."""
    draws = [F.struct((-F.log(draw(key, i)) / F.lit(float(w))).alias("wait"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("at least one shard needs a weight above 0")
    return F.array_min(F.array(*draws))["shard"]


#: Rows that a bucket of a shard should hold at most; rows of one doc_id and text that are numbered together.
BUCKET_ROWS, PIECE = 1 << 16, 1_024


def digits_for(rows: int, shards: int) -> int:
    """Hexadecimal digits of a bucket's name: two, or as many as keep buckets below BUCKET_ROWS."""
    digits = 2
    while shards * 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the weights decide alone, a null doc_id as the
    empty key. ``size`` is the UTF-8 length plus 1 (a null text has none, and the
    checksum of nothing); texts of any length are read whole. ``slot`` numbers the
    rows of a shard without gaps from 0, by a hash of doc_id and checksum, doc_id,
    checksum and file order, so repeated rows have slots of their own.
    ``grown_shard`` is the shard under ``grown``, by default one more shard of
    weight 1. An empty table gives an empty result; other columns, whatever their
    names, are not read.

    Rows are numbered in buckets of a shard, whose number grows with the table.
    More than PIECE rows of one doc_id and text count as one row of that weight
    there, and are numbered in pieces by file order.
    """
    grown = tuple(weights) + (1.0,) if grown is None else grown
    text, key = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    dealt = rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        *ROW_ID,
    )
    dealt = saved(dealt.withColumn("md5", F.md5(F.concat_ws("/", key, F.col("text_crc32").cast("string")))), "shards")
    dealt = dealt.withColumn("bucket", F.substring("md5", 1, digits_for(dealt.count(), len(weights)))).drop("md5")

    same = ["shard", "bucket", "doc_id", "text_crc32"]
    many = saved(dealt.groupBy(*same).agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") > PIECE), "many")
    equal = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in same]
    tagged = dealt.alias("d").join(many.alias("m"), reduce(Column.__and__, equal), "left").select("d.*", "weight")
    tagged = saved(tagged.withColumn("piece", F.floor(F.col(ROW_ID[1]) / PIECE)), "tagged")

    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    alone = tagged.where("weight is null").select(*same, *ROW_ID, "size", "grown_shard", F.lit(1).cast("long").alias("weight"))
    one = alone.unionByName(many, allowMissingColumns=True)
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", *ROW_ID).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("place", F.coalesce(F.sum("weight").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("place"))

    # rows of hot groups: the group's slot, the pieces before, the place in the piece
    hot = tagged.where("weight is not null")
    pieces = hot.groupBy(*same, ROW_ID[0], "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*same).orderBy(ROW_ID[0], "piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("above", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    groups = one.where(F.col(ROW_ID[0]).isNull()).select(*same, F.col("slot").alias("base"))
    pieces = saved(pieces.alias("d").join(groups.alias("m"), reduce(Column.__and__, equal)).select("d.*", "base"), "pieces")
    own = Window.partitionBy(*same, ROW_ID[0], "piece").orderBy(ROW_ID[1])
    hot = hot.withColumn("place", F.row_number().over(own) - 1).alias("d").join(pieces.alias("m"), reduce(Column.__and__, [*equal, *[F.col(f"d.{c}") == F.col(f"m.{c}") for c in (ROW_ID[0], "piece")]]))
    hot = hot.select(*[f"d.{c}" for c in ("doc_id", "size", "text_crc32", "shard", "grown_shard")], (F.col("base") + F.col("above") + F.col("place")).alias("slot"))

    every = one.where(F.col(ROW_ID[0]).isNotNull()).select(*hot.columns).unionByName(hot)
    return every.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
