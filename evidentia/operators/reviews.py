"""Review history: comments with their pull requests, ranking by a task, and the commit that follows a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import hashed_arrays, nearest_rows

HISTORY_ROWS = 10


def with_pull_requests(comments: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Comments joined to their pull request's title and fate; comments without one go, an empty hunk is null."""
    prs = pull_requests.select(F.col("number").alias("pr_number"), F.col("title").alias("pr_title"), F.col("merged").alias("pr_merged"))
    return comments.join(prs, "pr_number").withColumn("diff_hunk", F.nullif(F.col("diff_hunk"), F.lit("")))


def for_paths(history: DataFrame, paths: DataFrame) -> DataFrame:
    """Comments on given paths (query_id, path, rank), in order of the path's first rank; all comments of a path stay."""
    first = paths.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    return history.join(first, "path")


def ranked_by_task(history: DataFrame, tasks: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """(query_id, id, score, rank): comments (id, body) nearest to each task (query_id, text) by hashed vectors with all words.

    Comments without a feature in common are left out.
    """
    return nearest_texts(history, tasks, T.code_tokens, rows)


def nearest_texts(history: DataFrame, tasks: DataFrame, tokens, rows: int = HISTORY_ROWS) -> DataFrame:
    """The same with the tokens that ``tokens`` makes of a text."""
    found = nearest_rows(hashed_arrays(history, tokens(F.col("body")), "id"), hashed_arrays(tasks, tokens(F.col("text")), "query_id"), rows)
    return found.where("score > 0")


def next_commits(comments: DataFrame, commits: DataFrame) -> DataFrame:
    """Each comment (pr_number, id, created_at) with the first commit (pr_number, sha, authored_at) of its request after it, or null.

    One pass over both in order of time, from the end: no comment meets every commit.
    """
    a = comments.select("pr_number", "id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha"))
    b = commits.select("pr_number", F.lit(None).cast(dict(a.dtypes)["id"]).alias("id"), F.col("authored_at").alias("at"), F.lit(0).alias("kind"), F.col("sha").cast("string").alias("sha"))
    later = Window.partitionBy("pr_number").orderBy(F.desc("at"), F.desc("kind"), F.desc("sha")).rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b).withColumn("next_sha", F.last(F.when(F.col("kind") == 0, F.col("sha")), ignorenulls=True).over(later))
    both = both.withColumn("next_at", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(later))
    return both.where("kind = 1").select("pr_number", "id", F.col("at").alias("created_at"), "next_sha", "next_at")
