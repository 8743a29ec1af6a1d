"""Shared shapes: top rows of a group, and the tables of a repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import SUPPORTED

#: Schemas of the stored tables.
SCHEMAS = {
    "files": "path string, language string, size_bytes bigint, is_test boolean, tier1_done boolean, last_commit_ts bigint",
    "symbols": "path string, name string, kind string, start_line int, end_line int, signature string",
    "cochange": "path_a string, path_b string, n bigint, strength double",
    "file_imports": "path string, target string",
    "chunk_vectors": "path string, start_line int, hash string, vector array<float>",
    "pull_requests": "number bigint, title string, body string, merged boolean, author string, base_sha string, head_sha string, created_at string, merged_at string",
    "pr_files": "pr_number bigint, path string, status string, additions bigint, deletions bigint, patch string",
    "pr_commits": "pr_number bigint, sha string, message string, author string, authored_at string, ordinal bigint",
    "review_comments": "pr_number bigint, path string, line bigint, body string, author string, created_at string, diff_hunk string, commit_id string, in_reply_to bigint",
    "commits": "ordinal bigint, ts bigint, files array<string>",
}


@dataclass
class Repository:
    """The tables that the tools read; missing ones are None."""

    files: DataFrame
    bodies: DataFrame | None = None  # (path, body)
    symbols: DataFrame | None = None
    cochange: DataFrame | None = None
    imports: DataFrame | None = None  # (src, dst)
    pull_requests: DataFrame | None = None
    review_comments: DataFrame | None = None
    chunks: DataFrame | None = None  # (path, chunk, symbol, start_line, text)
    targets: DataFrame | None = None  # (path, target), the raw imports


def symbols_of_path(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """The symbols of files (path), in order of their lines."""
    return symbols.join(paths.select("path").distinct(), "path").orderBy("path", "start_line", "name")


def index_stats(repository: Repository) -> DataFrame:
    """One row: files, those that were extracted, symbols, co-change edges and import edges."""
    one = repository.files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("language").isin(*SUPPORTED)).alias("extracted"))
    for name in ("symbols", "cochange", "imports"):
        table = getattr(repository, name)
        one = one.crossJoin(table.agg(F.count(F.lit(1)).alias(name))) if table is not None else one.withColumn(name, F.lit(0).cast("long"))  # one row each
    return one


def top(df: DataFrame, n: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group ``by`` in a total order, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
