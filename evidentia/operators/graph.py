"""The import graph: resolution of targets, bounded reverse search, and what connects two files.

A name that many files import and many files have makes as many edges as their
product. So whole graphs are held as ``ImportClasses``: files that are meant by
the same names are one class, and who imports one of them imports all. What needs
the edges themselves gets them from there, each once, in blocks and without a
shuffle of edges; counts, distances and best rows are found without them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import saved
from .history import ANSWERS, expand_cochange, reason
from .tables import top

#: Hops of an expansion; confidence at one hop and beyond.
HOPS, DIRECT, INDIRECT = 2, 0.6, 0.35

#: Rows of a block when all rows of two tables meet; partitions that pairs of blocks are dealt to at least.
BLOCK, DEALT = 1_024, 192


@dataclass(frozen=True)
class ImportClasses:
    """An edge leads from each importer of a class to each of its targets, itself aside; no edge comes from two classes."""

    targets: DataFrame  # (path, cls), one row a path
    importers: DataFrame  # (cls, path), distinct


def import_classes(imports: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> ImportClasses:
    """The graph of imports (path, target) whose keys meet the needles of files (path), as stored tables.

    ``manifests`` (path, text) add to a crate's root file the name of its package.
    """
    keys = saved(imports.select("path", F.explode(P.candidate_keys(P.normalized_target(F.col("target")))).alias("key")).distinct(), "import-keys")
    needles = files.select("path", F.explode(P.module_needles(F.col("path"))).alias("key"))
    if manifests is not None:
        roots = files.select("path", F.lower(P.crate_manifest(F.col("path"))).alias("manifest")).where("manifest is not null")
        names = manifests.select(F.lower("path").alias("manifest"), P.package_name(F.col("text")).alias("key")).where("key is not null")
        needles = needles.unionByName(roots.join(names, "manifest").select("path", "key"))
    met = needles.join(keys.select("key").distinct(), "key", "left_semi").groupBy("path").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    named = F.array_join(F.transform("keys", lambda k: F.concat(F.length(k).cast("string"), F.lit(":"), k)), "")  # lengths: no two lists look alike
    targets = saved(met.select("path", F.md5(named).alias("cls"), "keys"), "import-targets")
    of_class = targets.groupBy("cls").agg(F.first("keys").alias("keys")).select("cls", F.explode("keys").alias("key"))
    importers = saved(keys.join(of_class, "key").select("cls", "path").distinct(), "importers")
    return ImportClasses(targets.select("path", "cls"), importers)


def import_edges(imports: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) without loops of the same tables."""
    return edges_of(import_classes(imports, files, manifests))


def edges_of(graph: ImportClasses) -> DataFrame:
    """(src, dst): every edge once."""
    return product(graph.importers.withColumnRenamed("path", "src"), graph.targets.withColumnRenamed("path", "dst"), "src", "dst").select("src", "dst")


def _blocks(rows: DataFrame, value: str) -> DataFrame:
    """Rows (keys, value) as lists of about BLOCK values of the same keys."""
    keys = [c for c in rows.columns if c != value]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return rows.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64(value), F.col("parts")).alias("part")).agg(F.collect_list(value).alias(value))


def product(left: DataFrame, right: DataFrame, a: str, b: str, key: str = "cls") -> DataFrame:
    """Rows (a, b, ...) of left (key, a, ...) and right (key, b, ...) for all pairs of the same key with a <> b.

    Pairs of blocks are dealt out evenly, and rows are made where they are read: no key
    with many rows is one task's work, and none of the product's rows is shuffled.
    """
    met = _blocks(left, a).withColumnRenamed("part", "part_a").join(_blocks(right, b).withColumnRenamed("part", "part_b"), key)
    tasks = max(DEALT, left.sparkSession.sparkContext.defaultParallelism * 8)
    dealt = met.repartition(tasks, key, "part_a", "part_b").drop("part_a", "part_b")
    return dealt.withColumn(a, F.explode(a)).withColumn(b, F.explode(b)).where(F.col(a) != F.col(b))


def known_cochange(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Co-change edges of which both ends are files."""
    paths = files.select("path")
    return edges.join(paths.withColumnRenamed("path", "path_a"), "path_a", "left_semi").join(paths.withColumnRenamed("path", "path_b"), "path_b", "left_semi")


def from_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind) without loops; parallel edges stay."""
    return edges.select("src", "dst", "kind").where("src <> dst")


def stats(edges: DataFrame) -> DataFrame:
    """One row: distinct ends as nodes, edges with parallel ones, and edges of either kind."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).agg(F.countDistinct("node").alias("nodes"))
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "imports").alias("import_edges"), F.count_if(F.col("kind") == "cochange").alias("cochange_edges"))
    return nodes.crossJoin(counts)  # one row each


def import_sizes(graph: ImportClasses) -> tuple[DataFrame, DataFrame]:
    """The ends of edges as (node), and one row (edges), both counted from classes."""
    asked = graph.importers.groupBy("cls").agg(F.count(F.lit(1)).alias("n_importers"))
    given = graph.targets.groupBy("cls").agg(F.count(F.lit(1)).alias("n_targets"))
    loops = graph.importers.join(graph.targets, ["cls", "path"])  # a file that would import itself
    edges = asked.join(given, "cls").agg(F.sum(F.col("n_importers") * F.col("n_targets")).alias("products")).crossJoin(loops.agg(F.count(F.lit(1)).alias("loops")))  # one row each
    own = loops.withColumn("own", F.lit(1))
    sources = graph.importers.join(given, "cls").join(own, ["cls", "path"], "left").where(F.col("n_targets") > F.coalesce("own", F.lit(0)))
    ends = graph.targets.join(asked, "cls").join(own, ["cls", "path"], "left").where(F.col("n_importers") > F.coalesce("own", F.lit(0)))
    nodes = sources.select(F.col("path").alias("node")).unionByName(ends.select(F.col("path").alias("node")))
    return nodes, edges.select((F.coalesce("products", F.lit(0)) - F.col("loops")).alias("edges"))


def whole_stats(graph: ImportClasses, cochange: DataFrame) -> DataFrame:
    """``stats`` of all imports and all of ``cochange`` (path_a, path_b), without the edges of the imports."""
    nodes, edges = import_sizes(graph)
    ends = cochange.select(F.explode(F.array("path_a", "path_b")).alias("node"))
    counted = nodes.unionByName(ends).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    together = cochange.agg(F.count(F.lit(1)).alias("cochange_edges"))
    one = counted.crossJoin(edges.withColumnRenamed("edges", "import_edges")).crossJoin(together)  # one row each
    return one.select("nodes", (F.col("import_edges") + F.col("cochange_edges")).alias("edges"), "import_edges", "cochange_edges")


def _near_classes(graph: ImportClasses, hops: int) -> DataFrame:
    """(start, cls, hops): classes whose importers reach the class ``start`` over at most ``hops`` edges, with the least number.

    Loops change nothing: a shortest way to another file has none.
    """
    start = graph.targets.select("cls").distinct()
    step = graph.importers.withColumnRenamed("cls", "near").join(graph.targets, "path").select("near", "cls").distinct()
    front = start.select(F.col("cls").alias("start"), "cls")
    found = [front.withColumn("hops", F.lit(1).cast("long"))]
    for hop in range(2, hops + 1):
        front = front.withColumnRenamed("cls", "near").join(step, "near").select("start", "cls").distinct()
        found.append(front.withColumn("hops", F.lit(hop).cast("long")))
    return reduce(DataFrame.unionByName, found).groupBy("start", "cls").agg(F.min("hops").alias("hops"))


def _reached(near: DataFrame, importers: DataFrame) -> DataFrame:
    """(start, path, hops) of classes near (start, cls, hops) and importers (cls, path)."""
    return near.join(importers.select("cls", "path"), "cls").groupBy("start", "path").agg(F.min("hops").alias("hops"))


def dependents_of_each(graph: ImportClasses, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(seed, path, hops): ``dependents`` of each of seeds (path) by itself. What reaches a class is found once for all its files."""
    reached = _reached(_near_classes(graph, hops), graph.importers).withColumnRenamed("start", "cls")
    asked = graph.targets.join(seeds.select("path"), "path", "left_semi").withColumnRenamed("path", "seed")
    return product(asked, reached, "seed", "path").select("seed", "path", "hops")


def nearest_of_each(graph: ImportClasses, seeds: DataFrame, without: DataFrame, answers: int = ANSWERS, hops: int = HOPS) -> DataFrame:
    """``expand_imports`` of each of seeds (path) by itself, without (seed_set, path) that are at most ANSWERS for a seed.

    Of each class only as many files are taken as may be needed: its ``answers``
    first, as many as may be left out, and the seed.
    """
    most = answers + ANSWERS + 1
    first = top(graph.importers, most, ["cls"], [F.col("path")], "place").drop("place")
    reached = top(_reached(_near_classes(graph, hops), first), most, ["start"], [F.col("hops"), F.col("path")], "place").drop("place")
    asked = graph.targets.join(seeds.select("path"), "path", "left_semi").select(F.col("path").alias("seed_set"), F.col("cls").alias("start"))
    found = asked.join(reached, "start").where("seed_set <> path").select("seed_set", "path", "hops")
    return _import_answers(found.join(without.select("seed_set", "path"), ["seed_set", "path"], "left_anti"), answers)


def explain_all(cochange: DataFrame, graph: ImportClasses, files: DataFrame) -> DataFrame:
    """``explain`` for every pair that ``cochange`` or an import connects, without making the imports' edges.

    The expansions give a few rows for each file; each is asked whether its pair is connected.
    """
    each = files.select(F.col("path").alias("seed_set"), "path").distinct()
    cut = expand_cochange(cochange, each, files)
    together = cut.select(F.col("seed_set").alias("source"), F.col("path").alias("target"), F.lit("historical_cochange").alias("type"), F.col("reason").alias("detail"), F.col("confidence").alias("weight"))
    found = nearest_of_each(graph, each, cut)
    detail = F.concat("path", F.lit(" imports "), "seed_set")
    ways = [found.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit("import_edge").alias("type"), detail.alias("detail"), F.col("confidence").alias("weight")) for s, t in (("seed_set", "path"), ("path", "seed_set"))]
    importing = ways[0].unionByName(ways[1])
    # the pair is connected if the source imports the target's class, or both change together
    classes = importing.join(graph.targets.withColumnRenamed("path", "target"), "target", "left")
    imported = graph.importers.select(F.col("path").alias("source"), "cls", F.lit(True).alias("imported"))
    changed = cochange.select(F.col("path_a").alias("source"), F.col("path_b").alias("target"), F.lit(True).alias("changed"))
    known = classes.join(imported, ["source", "cls"], "left").join(changed, ["source", "target"], "left").where("imported or changed")
    return together.unionByName(known.select(*together.columns))


def dependents(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(seed_set, path, hops): files that reach a seed over at most ``hops`` edges (src, dst), with their least distance; seeds are left out."""
    back = edges.select("src", "dst").distinct()
    start = seeds.select("seed_set", "path").distinct()
    front, found = start, []
    for hop in range(1, hops + 1):
        front = front.withColumnRenamed("path", "dst").join(back, "dst").select("seed_set", F.col("src").alias("path")).distinct()
        found.append(front.withColumn("hops", F.lit(hop).cast("long")))
    every = reduce(DataFrame.unionByName, found).groupBy("seed_set", "path").agg(F.min("hops").alias("hops"))
    return every.join(start, ["seed_set", "path"], "left_anti")


def expand_imports(edges: DataFrame, seeds: DataFrame, cochanged: DataFrame | None = None, hops: int = HOPS, answers: int | None = ANSWERS) -> DataFrame:
    """(seed_set, path, confidence, reason, rank): dependents without those in ``cochanged`` (seed_set, path)."""
    found = dependents(edges, seeds, hops)
    if cochanged is not None:
        found = found.join(cochanged.select("seed_set", "path"), ["seed_set", "path"], "left_anti")
    return _import_answers(found, answers)


def _import_answers(found: DataFrame, answers: int | None) -> DataFrame:
    """(seed_set, path, confidence, reason, rank) of dependents (seed_set, path, hops)."""
    found = found.withColumn("confidence", F.when(F.col("hops") <= 1, DIRECT).otherwise(INDIRECT))
    words = F.concat(F.lit("imports a changed file ("), F.col("hops").cast("string"), F.when(F.col("hops") == 1, " hop)").otherwise(" hops)"))
    found = found.withColumn("reason", words)
    return top(found, answers or 1 << 30, ["seed_set"], [F.desc("confidence"), F.col("hops"), F.col("path")]).drop("hops")


def expand(cochange: DataFrame, imports: DataFrame, seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(seed_set, section, path, confidence, reason, rank) of sets of anchors: what changes with them, and what imports them.

    Anchors that are no files are ignored. Test files show in section ``test``
    too, taken before the sections are cut to length.
    """
    known = seeds.join(files.select("path"), "path", "left_semi").select("seed_set", "path")
    together = expand_cochange(cochange, known, files, answers=None)
    cut = together.where(F.col("rank") <= ANSWERS)
    importing = expand_imports(imports, known, cut, answers=None)
    tests = together.unionByName(importing).where(P.is_test(F.col("path"))).groupBy("seed_set", "path").agg(F.max("confidence").alias("confidence"))
    tests = tests.unionByName(known.where(P.is_test(F.col("path"))).select("seed_set", "path", F.lit(1.0).alias("confidence")))
    tests = tests.groupBy("seed_set", "path").agg(F.max("confidence").alias("confidence"))
    tests = top(tests.withColumn("reason", F.lit("test")), 1 << 30, ["seed_set"], [F.col("path")])
    own = top(known.where(~P.is_test(F.col("path"))).select("seed_set", "path", F.lit(1.0).alias("confidence"), F.lit("anchor").alias("reason")), 1 << 30, ["seed_set"], [F.col("path")])
    parts = {"file": own, "test": tests, "cochange": cut, "import": importing.where(F.col("rank") <= ANSWERS)}
    return reduce(DataFrame.unionByName, [df.select("seed_set", F.lit(name).alias("section"), "path", "confidence", "reason", "rank") for name, df in parts.items()])


def explain(cochange: DataFrame, imports: DataFrame, pairs: DataFrame, files: DataFrame, complete: bool = False) -> DataFrame:
    """(source, target, type, detail, weight) of pairs (source, target).

    By default from the expansions of either end, as cut to length: so a
    co-change reason comes from the source's own list only, an import reason may
    stand for two hops, and none is given towards a file that already shows as
    co-changing. ``complete`` reports every recorded edge instead.
    """
    both = pairs.select("source", "target").distinct()
    if complete:
        together = cochange.select(F.col("path_a").alias("source"), F.col("path_b").alias("target"), F.lit("historical_cochange").alias("type"), "strength", "n", "total")
        together = both.join(together, ["source", "target"])
        out = together.select("source", "target", "type", reason(F.col("source"), F.col("n"), F.col("total")).alias("detail"), F.col("strength").alias("weight"))
        for a, b in (("target", "source"), ("source", "target")):
            hit = both.join(imports.select(F.col("src").alias(a), F.col("dst").alias(b)), ["source", "target"])
            out = out.unionByName(hit.select("source", "target", F.lit("import_edge").alias("type"), F.concat(a, F.lit(" imports "), b).alias("detail"), F.lit(DIRECT).alias("weight")))
        return out
    ends = both.select(F.col("source").alias("path")).unionByName(both.select(F.col("target").alias("path"))).distinct()
    found = expand(cochange, imports, ends.select(F.col("path").alias("seed_set"), "path"), files).where("section in ('cochange', 'import')")
    ways = both.select("source", "target", F.col("source").alias("seed_set"), F.col("target").alias("path"), F.lit(True).alias("forward"))
    ways = ways.unionByName(both.select("source", "target", F.col("target").alias("seed_set"), F.col("source").alias("path"), F.lit(False).alias("forward")))
    hits = ways.join(found, ["seed_set", "path"]).where("forward or section = 'import'")  # the expansions are read once
    together = F.col("section") == "cochange"
    return hits.select(
        "source", "target", F.when(together, "historical_cochange").otherwise("import_edge").alias("type"),
        F.when(together, F.col("reason")).otherwise(F.concat("path", F.lit(" imports "), "seed_set")).alias("detail"), F.col("confidence").alias("weight"),
    )
