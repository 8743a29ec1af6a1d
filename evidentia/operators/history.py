"""Co-change of files from commits.

Commits come as rows (commit, ts, file), ``commit`` being any value that orders
them, newest last. A commit of more than ``cap`` files says nothing about
co-change, so its pairs are never made; it still tells when its files changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from .tables import top

#: Most files of a commit, least commits of a pair, newest commits taken; strongest rows of a file; rows of an answer.
CAP, MIN_TOGETHER, NEWEST, PER_FILE, ANSWERS = 30, 2, 2_000, 5, 8


def last_change(commits: DataFrame) -> DataFrame:
    """(file, ts): the time of the newest commit with the file, whatever its size. The newest by order, not by time."""
    return commits.groupBy("file").agg(F.max(F.struct("commit", "ts"))["ts"].alias("ts"))


def newest(commits: DataFrame, count: int, skip: int = 0) -> DataFrame:
    """The rows of the ``count`` newest commits behind the ``skip`` newest."""
    order = commits.select("commit").distinct().orderBy(F.desc("commit"))
    taken = order.limit(skip + count)
    if skip:
        taken = taken.join(order.limit(skip), "commit", "left_anti")
    return commits.join(taken, "commit", "left_semi")


def cochange_edges(commits: DataFrame, cap: int = CAP, min_together: int = MIN_TOGETHER) -> DataFrame:
    """(path_a, path_b, n, total, strength): directed pairs, ``total`` being the commits of path_a and strength n / total."""
    rows = commits.select("commit", "file").where("commit is not null").repartition("commit").distinct()  # the one shuffle of commits
    small = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("commit"))).where(F.col("size") <= cap)
    lists = small.groupBy("commit").agg(F.sort_array(F.collect_list("file")).alias("files"))
    totals = lists.select(F.explode("files").alias("path_a")).groupBy("path_a").agg(F.count(F.lit(1)).alias("total"))
    # each pair once, in its own commit's row; the other direction comes when pairs have been counted
    later = F.transform("files", lambda x, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    pairs = lists.select(F.explode(F.flatten(later)).alias("p")).select("p.x", "p.y")
    counts = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together)
    both = F.explode(F.array(F.struct(F.col("x").alias("path_a"), F.col("y").alias("path_b")), F.struct(F.col("y").alias("path_a"), F.col("x").alias("path_b"))))
    counts = counts.select(both.alias("p"), "n").select("p.path_a", "p.path_b", "n")
    return counts.join(totals, "path_a").select("path_a", "path_b", "n", "total", (F.col("n") / F.col("total")).alias("strength"))


def strongest(edges: DataFrame, n: int = PER_FILE) -> DataFrame:
    """The ``n`` strongest rows of each path_a, ties by path_b, with their rank."""
    return top(edges, n, ["path_a"], [F.desc("strength"), F.col("path_b")])


def expand_cochange(edges: DataFrame, seeds: DataFrame, indexed: DataFrame | None = None, per_file: int = PER_FILE, answers: int | None = ANSWERS) -> DataFrame:
    """(seed_set, path, confidence, reason, rank) for seeds (seed_set, path).

    Of each seed its ``per_file`` strongest rows are taken first; then targets
    that are seeds themselves or not in ``indexed`` (path) go. A target keeps its
    greatest strength, ties by seed. ``answers`` rows of a set stay, all if None.
    """
    near = strongest(edges, per_file).drop("rank")
    found = seeds.select("seed_set", F.col("path").alias("path_a")).distinct().join(near, "path_a").withColumnRenamed("path_b", "path")
    if indexed is not None:
        found = found.join(indexed.select("path"), "path", "left_semi")
    found = found.join(seeds.select("seed_set", "path").distinct(), ["seed_set", "path"], "left_anti")
    best = found.groupBy("seed_set", "path").agg(F.min(F.struct((-F.col("strength")).alias("order"), "path_a", "n", "total")).alias("best"))
    out = best.select("seed_set", "path", (-F.col("best.order")).alias("confidence"), reason(F.col("best.path_a").cast("string"), F.col("best.n"), F.col("best.total")).alias("reason"))
    return top(out, answers or 1 << 30, ["seed_set"], [F.desc("confidence"), F.col("path")])


def reason(seed: Column, n: Column, total: Column) -> Column:
    return F.concat(F.lit("changes with "), seed, F.lit(" in "), percent(n, total).cast("string"), F.lit("% of its commits"))
