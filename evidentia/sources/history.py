"""Commits from ``git log`` and pull-request payloads from JSON."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "@@COMMIT@@"

#: Schemas of the payloads, one JSON array in a string column each.
PULL_REQUESTS = "array<struct<number:bigint,title:string,body:string,merged_at:string,created_at:string,user:struct<login:string>,base:struct<sha:string>,head:struct<sha:string>>>"
FILES = "array<struct<filename:string,status:string,additions:bigint,deletions:bigint,patch:string>>"
COMMITS = "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>>>"
COMMENTS = "array<struct<path:string,line:bigint,original_line:bigint,body:string,created_at:string,diff_hunk:string,commit_id:string,in_reply_to_id:bigint,user:struct<login:string>>>"


def git_log(root: str, skip: int = 0, most: int = 2_000, field: str = "%ct") -> str:
    """The log with the names of changed files, newest first; empty if git fails."""
    command = ["git", "-C", root, "log", f"--skip={skip}", f"--max-count={most}", "--name-only", f"--pretty=format:{MARKER}{field}"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, check=False)
    return done.stdout if done.returncode == 0 else ""


def commits_of_log(spark: SparkSession, log: str) -> DataFrame:
    """(ordinal, ts, file) of a log; commits without files vanish, a time that is no number is 0.

    A log is one ordered text of at most some thousand commits, so it is parsed here.
    """
    rows = [(ordinal, int(head) if re.fullmatch(r"[+-]?\d+", head) else 0, file) for ordinal, head, file in parsed_log(log)]
    return spark.createDataFrame(rows, "ordinal bigint, ts bigint, file string")


def subjects_of_log(spark: SparkSession, log: str) -> DataFrame:
    """(ordinal, subject, file) of a log whose field is the subject, ``%s``."""
    return spark.createDataFrame(list(parsed_log(log)), "ordinal bigint, subject string, file string")


def parsed_log(log: str) -> Iterator[tuple[int, str, str]]:
    """The number of a commit from 0, its field, and a file of it, for each file."""
    ordinal, head = -1, ""
    for line in log.split("\n"):
        if line.startswith(MARKER):
            ordinal, head = ordinal + 1, line[len(MARKER) :].strip()
        elif line.strip() and ordinal >= 0:
            yield ordinal, head, line.strip()


def _text(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def pull_requests(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Pull requests of payloads: absent texts are empty, merged means that a time of merging is there."""
    rows = payloads.select(F.explode(F.from_json(column, PULL_REQUESTS)).alias("p"))
    return rows.select(
        "p.number", _text("p.title").alias("title"), _text("p.body").alias("body"), F.col("p.merged_at").isNotNull().alias("merged"), _text("p.user.login").alias("author"),
        _text("p.base.sha").alias("base_sha"), _text("p.head.sha").alias("head_sha"), _text("p.created_at").alias("created_at"), _text("p.merged_at").alias("merged_at"),
    )


def pr_files(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Changed files of payloads (pr_number, payload); an absent patch is empty, and the last row of a path stays."""
    rows = payloads.select("pr_number", F.posexplode(F.from_json(column, FILES)).alias("at", "f"))
    rows = rows.groupBy("pr_number", F.col("f.filename").alias("filename")).agg(F.max_by("f", "at").alias("f"))
    return rows.select(
        "pr_number", F.col("f.filename").alias("path"), _text("f.status").alias("status"), F.coalesce("f.additions", F.lit(0)).alias("additions"),
        F.coalesce("f.deletions", F.lit(0)).alias("deletions"), _text("f.patch").alias("patch"),
    )


def pr_commits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Commits of payloads (pr_number, payload) with their place from 0."""
    rows = payloads.select("pr_number", F.posexplode(F.from_json(column, COMMITS)).alias("ordinal", "c"))
    return rows.select(
        "pr_number", "c.sha", _text("c.commit.message").alias("message"), _text("c.commit.author.name").alias("author"),
        _text("c.commit.author.date").alias("authored_at"), F.col("ordinal").cast("long").alias("ordinal"),
    )


def review_comments(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Comments of payloads (pr_number, payload); the original line stands in for an absent one."""
    rows = payloads.select("pr_number", F.explode(F.from_json(column, COMMENTS)).alias("c"))
    return rows.select(
        "pr_number", "c.path", F.coalesce("c.line", "c.original_line").alias("line"), _text("c.body").alias("body"), _text("c.user.login").alias("author"),
        _text("c.created_at").alias("created_at"), _text("c.diff_hunk").alias("diff_hunk"), _text("c.commit_id").alias("commit_id"), F.col("c.in_reply_to_id").alias("in_reply_to"),
    )


def ingest_stats(prs: DataFrame, files: DataFrame, commits: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: what a batch of payloads brought, with the files that carry no patch."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("pull_requests", prs), ("commits", commits), ("comments", comments))]
    out = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("patch") == "").alias("files_without_patch"))
    for one in counts:
        out = out.crossJoin(one)  # one row each
    return out
