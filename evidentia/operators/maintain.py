"""Upserts, replacement and pruning of stored tables, as whole-table expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import import_edges, known_cochange
from .history import cochange_edges, last_change
from .tables import Repository


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the last in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("kept")).select(*keys, "kept.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` by key; columns in ``keep`` stay as they were for keys that were there."""
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("o"))
    b = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in columns]).alias("n"))
    joined = a.join(b, list(keys), "full_outer")

    def value(c: str) -> Column:
        fresh = F.col("n").isNotNull() & (F.col("o").isNull() if c in keep else F.lit(True))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*keys, *[value(c) for c in columns]).select(*old.columns)


def replace_for(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``old`` whose key is in ``new`` give way to those of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def update_known(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of rows that ``new`` (key, column) knows; others keep theirs, unknown keys are ignored."""
    fresh = new.select(key, F.col(column).alias("__new"))
    return old.join(fresh, key, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def prune(tables: dict[str, DataFrame], keep: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """Tables without the keys that are not in ``keep``; history tables simply aren't passed in."""
    kept = keep.select(key).distinct()
    return {name: df.join(kept, key, "left_semi") for name, df in tables.items()}


def prune_repository(repository: Repository, keep: DataFrame) -> Repository:
    """A repository without the files that are not in ``keep`` (path), and all that hangs on them; its history stays."""
    kept = keep.select("path").distinct()
    own = {name: df.join(kept, "path", "left_semi") for name in ("files", "bodies", "symbols", "chunks", "targets") if (df := getattr(repository, name)) is not None}
    for name, ends in (("cochange", ("path_a", "path_b")), ("imports", ("src", "dst"))):
        table = getattr(repository, name)
        if table is not None:
            for end in ends:
                table = table.join(kept.withColumnRenamed("path", end), end, "left_semi")
            own[name] = table
    return replace(repository, **own)


def reindexed(repository: Repository, changed: Repository, removed: DataFrame) -> Repository:
    """A repository in which the files of ``changed`` give way to its rows, and those of ``removed`` (path) go.

    Import edges are resolved anew, as a changed file may be what others import;
    co-change is left as it is.
    """
    gone = changed.files.select("path").unionByName(removed.select("path")).distinct()
    own = {}
    for name in ("files", "bodies", "symbols", "chunks", "targets"):
        old, new = getattr(repository, name), getattr(changed, name)
        if old is not None and new is not None:
            own[name] = old.join(gone, "path", "left_anti").unionByName(new.select(*old.columns))
    made = replace(repository, **own)
    return replace(made, imports=import_edges(made.targets, made.files)) if made.targets is not None else made


def refreshed_history(repository: Repository, commits: DataFrame) -> Repository:
    """A repository with the co-change and times of ``commits`` (commit, ts, file) in place of its own."""
    times = last_change(commits).select(F.col("file").alias("path"), F.col("ts").alias("last_commit_ts"))
    files = update_known(repository.files, times, "path", "last_commit_ts")
    return replace(repository, files=files, cochange=known_cochange(cochange_edges(commits), files))


def pruned_count(files: DataFrame, keep: DataFrame, key: str = "path") -> DataFrame:
    return files.join(keep.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("pruned"))


def with_missing_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """A table of an older schema with later columns (name to type and default) added; repeating it changes nothing."""
    return df.select("*", *[F.lit(value).cast(kind).alias(name) for name, (kind, value) in defaults.items() if name not in df.columns])


def reusable(chunks: DataFrame, cached: DataFrame, length: int | None = None) -> DataFrame:
    """``chunks`` (path, start_line, hash) with ``vector`` of the cache where the hash is the same (and the length right), and ``reused``."""
    known = cached.select("path", "start_line", F.col("hash").alias("__hash"), "vector")
    same = F.col("__hash").eqNullSafe(F.col("hash")) & F.col("vector").isNotNull()
    if length is not None:
        same = same & (F.size("vector") == length)
    rows = chunks.join(known, ["path", "start_line"], "left")
    return rows.withColumn("reused", same).withColumn("vector", F.when(F.col("reused"), F.col("vector"))).drop("__hash")


def content_hash(text: Column) -> Column:
    """The key of the vector cache."""
    return T.fnv_hex(text)
