"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are the distinct sets (texts with equal sets are one
class), columns the n-grams. Of each row only the columns that can decide are
multiplied: with all n-grams in one global order, rare before frequent, two sets
of similarity ``t`` share one of the first ``n - ceil(t n) + 1`` of each. The
product goes block by block over hashed columns; a column adds 1 to the overlap
of the pairs in it, and pairs whose sizes, or whose places in the order, bound
their overlap below what the similarity needs are dropped at once; the bound
takes the long columns below, which add nothing to the overlap, as shared as far
as both sets have them. Surviving pairs are counted whole.

A column of up to SMALL rows is multiplied at once. Longer ones, such as those of
a large group of near copies, are not: what is asked for is only what classes are
linked into. There every row first meets one pivot. After that only columns that
still hold several components go on, with ever more of their rows as pivots
against the rows of other components, until each such pair of the column was
counted. The rows that come earliest in the order are pivots first: they have the
fewest n-grams that few others have, so what is linked at all is soon one
component, and few pairs are left for the many pivots of later rounds. Of the
pairs that survive, those that would join two components are counted whole. No
pair that could do so is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import ROW_ID, dropped, most_frequent, saved, with_row_ids
from .words import WordCodes, texts_of, window_hashes

NGRAM = 5

#: Similarity as a fraction: 100 * intersection >= 75 * union.
PART, WHOLE = 75, 100

#: Frequent n-grams that the global order knows; n-grams that a task counts at once; least count there to be reported.
FREQUENT, AT_ONCE, REPORTED = 1 << 20, 1 << 21, 2

#: Rows up to which a column is multiplied at once; rows of a piece of a longer one; pivots of a column at first, and the factor by which they grow.
SMALL, PIECE, FEW, GROWTH = 64, 2_000, 2, 16

#: Levels of places by which early rows are ordered as pivots.
LEVELS = 32

_IDS = ", ".join(f"{c} long" for c in ROW_ID)


class Sets:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n, self.words = n, WordCodes(lower=True)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        codes, counts = self.words.codes(texts)
        grams, ends = window_hashes(codes, self.n), np.cumsum(counts)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            own = grams[end - count : end - self.n + 1] if count >= self.n else window_hashes(codes[end - count : end], count) if count else codes[:0]
            own = np.sort(own)
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own


class Order:
    """The global order of n-grams: unknown ones by hash, then the frequent ones from rare to frequent."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        self.rank = np.empty(len(by), np.int64)
        self.rank[np.lexsort((self.hashes, self.counts))] = np.arange(len(by))

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which n-grams are there."""
        if not len(self.hashes):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.searchsorted(self.hashes, grams)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == grams

    def sorted(self, grams: np.ndarray) -> np.ndarray:
        at, known = self.places(grams)
        return np.concatenate([grams[~known], grams[known][np.argsort(self.rank[at[known]])]])


def prefix_size(n: int, part: int, whole: int) -> int:
    return n - -(-part * n // whole) + 1


def frequent_grams(rows: DataFrame, n: int) -> DataFrame:
    """(gram, docs): n-grams that are frequent over all texts, FREQUENT at most; rarer ones may be missing."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, size = Sets(n), [], 0

        def out() -> pa.RecordBatch:
            grams = np.sort(np.concatenate([*held, np.empty(0, np.uint64)]))
            held.clear()
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(grams)))
            often = counts >= REPORTED
            return pa.RecordBatch.from_arrays([_signed(grams[first[often]]), pa.array(counts[often])], names=["gram", "docs"])

        for batch in batches:
            for found in sets.of(list(texts_of(batch))):
                held.append(found)
                size += len(found)
                if size >= AT_ONCE:
                    yield out()
                    size = 0
        yield out()

    found = rows.select("text").mapInArrow(counted, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    return most_frequent(saved(found, "gram-counts"), "docs", FREQUENT)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _row_sets(rows: DataFrame, order, n: int, part: int, whole: int) -> DataFrame:
    """(doc_id, n, d1, d2, prefix, ROW_ID): size, 128-bit digest and first n-grams in the order of each text's set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for grams in sets.of(list(texts_of(batch))):
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                prefixes.append(order.value.sorted(grams)[: prefix_size(len(grams), part, whole)].tobytes() if len(grams) else b"")
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(prefixes, pa.binary()), *[batch.column(c) for c in ROW_ID]],
                names=["doc_id", "n", "d1", "d2", "prefix", *ROW_ID],
            )

    return rows.mapInArrow(made, f"doc_id long, n long, d1 long, d2 long, prefix binary, {_IDS}")


def _columns(sets: DataFrame, order) -> DataFrame:
    """(gram, piece, class, n, at): the entries of the incidence that are multiplied; a frequent column is in pieces, else piece is -1."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                some = batch.slice(at, 1_000)
                grams = [np.frombuffer(x.as_py(), np.uint64) for x in some.column("prefix")]
                sizes = np.array([len(x) for x in grams])
                every = np.concatenate(grams)
                klass = np.repeat(some.column("class").to_numpy(), sizes)
                place, known = order.value.places(every)
                pieces = np.where(known, order.value.counts[place] // PIECE + 1, 1) if known.any() else np.ones(len(every), np.int64)
                starts = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(every),
                        pa.array(np.where(pieces > 1, (klass * 2654435761 >> 8) % pieces, -1).astype(np.int32)),
                        pa.array(klass),
                        pa.array(np.repeat(some.column("n").to_numpy(), sizes).astype(np.int32)),
                        pa.array((np.arange(len(every)) - np.repeat(starts, sizes)).astype(np.int32)),
                    ],
                    names=["gram", "piece", "class", "n", "at"],
                )

    return sets.select("class", "n", "prefix").mapInArrow(entries, "gram long, piece int, class long, n int, at int")


_MET = [("gram", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("p_class", pa.int64()), ("p_n", pa.int32()), ("p_at", pa.int32()), ("overlap", pa.int32())]


def _products(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, part: int, whole: int) -> pa.RecordBatch:
    """The pairs of columns (rows from ``starts``) with the number of columns that they share, if their sizes allow the similarity."""
    found = [np.empty((0, 2), np.int64)]
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        column = starts[sizes == size][:, None]
        found.append(np.stack([(column + j).ravel(), (column + i).ravel()], 1))
    at = np.concatenate(found)
    n, m = rows[at[:, 0], 3], rows[at[:, 1], 3]
    at = at[whole * np.minimum(n, m) >= part * np.maximum(n, m)]
    a, b = rows[at[:, 0], 2], rows[at[:, 1], 2]
    order = np.lexsort((b, a))
    a, b, at = a[order], b[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
    nothing = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32())
    ints = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [nothing[0], pa.array(a[first]), ints(rows[at[first, 0], 3]), nothing[1], pa.array(b[first]), ints(rows[at[first, 1], 3]), nothing[1], ints(np.diff(np.append(first, len(a))))],
        names=[c for c, _ in _MET],
    )


def _with_pivot(rows: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    columns = [rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], pivots[:, 2], pivots[:, 3], pivots[:, 4], np.ones(len(rows), np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, _MET, strict=True)], names=[c for c, _ in _MET])


def _met(columns: DataFrame, part: int, whole: int) -> DataFrame:
    """What meets in the columns: with a null gram, pairs and their overlap in short columns; else each row of a long one with its pivot.

    The rows come sorted, so a column streams by, and no more than SMALL rows of
    it are held. A piece of a frequent column counts as long whatever its size.
    """
    names = ["gram", "piece", "class", "n", "at"]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)  # the last column so far, if short
        pivot = None  # the last column's pivot, if long
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], 1)])
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            if pivot is not None:
                new[0] = bool((rows[0, :2] != pivot[0, :2]).any())
            starts = np.flatnonzero(new)
            if not new[0]:
                end = starts[0] if len(starts) else len(rows)
                yield _with_pivot(rows[:end], np.repeat(pivot, end, 0))
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(rows)))
            long = (rows[starts, 1] >= 0) | (sizes > SMALL)
            if long.any():
                own = np.repeat(long, sizes)
                yield _with_pivot(rows[starts[0] :][own], np.repeat(rows[starts[long]], sizes[long], 0))
            pivot, held = (rows[starts[-1]][None], rows[:0]) if long[-1] else (None, rows[starts[-1] :])
            short = ~long & (sizes > 1)
            short[-1] = False
            if short.any():
                yield _products(rows, starts[short], sizes[short], part, whole)
        if len(held) > 1:
            yield _products(held, np.zeros(1, np.int64), np.array([len(held)]), part, whole)

    dealt = columns.repartition("gram", "piece").sortWithinPartitions("gram", "piece", "class")
    return dealt.mapInArrow(meeting, "gram long, class long, n int, at int, p_class long, p_n int, p_at int, overlap int")


def _first_round(columns: DataFrame, part: int, whole: int) -> DataFrame:
    """What meets in all columns; the pivots of a column's pieces meet too, as a column without pieces."""
    met = saved(_met(columns, part, whole), "met")
    pivots = met.where("gram is not null and class = p_class").select("gram", "class", "n", "at")
    several = pivots.groupBy("gram").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("gram")
    again = pivots.join(several, "gram").select("gram", F.lit(0).alias("piece"), "class", "n", "at")
    return met.unionByName(_met(again, part, whole))


def _needed(a, b, part: int, whole: int):
    """Least intersection of sets of these sizes with the similarity."""
    return F.ceil(part * (a + b) / (whole + part))


def _can_link(n, at, p_n, p_at, part: int, whole: int):
    """Whether sizes and places in the order allow the similarity: at the first shared n-gram only what follows can be shared.

    For long columns: a pair whose first shared n-gram is in a short one has met there.
    """
    return F.least(n - at, p_n - p_at) >= _needed(n, p_n, part, whole)


def _class_sets(rows: DataFrame, stand: DataFrame, n: int) -> DataFrame:
    """(class, grams): the whole sorted sets of some classes, made again from the text that stands for each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([g.tobytes() for g in sets.of(list(texts_of(batch)))], pa.binary())], names=["class", "grams"])

    texts = rows.select("text", *ROW_ID).join(stand, list(ROW_ID))
    return texts.select("class", "text").mapInArrow(made, "class long, grams binary")


def _linked(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep.append(whole * both >= part * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
    both = x.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(counted, "a long, b long")


def _early(n, at, part: int, whole: int):
    """Whether a row's place in the order is so early that it can link with rows of its own size or more; each pair that can link has such a row."""
    return (whole + part) * at <= (whole - part) * n


def _band(n, part: int, whole: int):
    """Sizes in bands: sets with the similarity lie in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (float(np.log(whole / part)) * (1 + 1e-6))).cast("int")


def _mixed(tagged: DataFrame, before: int) -> DataFrame:
    """(gram, main): columns with several components and more early rows than ``before``, and the component with most rows there."""
    parts = tagged.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("early").alias("m"))
    parts = parts.groupBy("gram").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m"))
    return parts.where(f"comps > 1 and m > {before}").select("gram", "main")


def _ranked(active: DataFrame, part: int, whole: int) -> DataFrame:
    """``active`` with ``u``, a row's turn as a pivot of its column: early places first, within a level of places by hash. Null for rows that are not early.

    The levels are counted, so no task sorts the rows of a column.
    """
    level = F.when(F.col("early"), F.floor(LEVELS * (whole + part) * F.col("at") / ((whole - part) * F.col("n"))).cast("int"))
    rows = active.withColumn("level", level)
    counts = rows.where("early").groupBy("gram", "level").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("sooner", F.sum("m").over(Window.partitionBy("gram").orderBy("level")) - F.col("m"))
    u = F.col("sooner") + F.pmod(F.xxhash64("class"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("m")
    return rows.join(counts.hint("merge"), ["gram", "level"], "left").select(*active.columns, u.alias("u"))


def _cross_pairs(active: DataFrame, before: int, pivots: int, part: int, whole: int) -> DataFrame:
    """Pairs of classes of one column and several components: the early rows with ``u`` from ``before`` to ``pivots`` against all not yet met.

    Rows meet by column, band of sizes, and whether they are in the column's main
    component, so hopeless pairs are never made: nor are those of two rows of the
    main component, or of two late rows, which share too little behind their places.
    """
    names = ("class", "n", "at", "comp", "u")
    is_main = F.col("comp") == F.col("main")
    p = active.where(F.col("early") & (F.col("u") >= before) & (F.col("u") < pivots))
    p = p.withColumn("band", F.explode(F.array(*[_band(F.col("n"), part, whole) + k for k in (-1, 0, 1)])))
    p = p.select("gram", "band", *[F.col(c).alias(f"p_{c}") for c in names], F.explode(F.when(is_main, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("in_main"))
    rows = active.where(~F.col("early") | (F.col("u") >= before)).withColumn("band", _band(F.col("n"), part, whole)).withColumn("in_main", is_main)
    both = rows.join(p.hint("merge"), ["gram", "band", "in_main"]).where("comp <> p_comp").where(~F.col("early") | (F.col("u") >= pivots) | (F.col("class") > F.col("p_class")))
    both = both.where(_can_link(F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at"), part, whole))
    return both.select(F.greatest("class", "p_class").alias("a"), F.least("class", "p_class").alias("b")).distinct()


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (class, comp) after further links between classes."""
    links = saved(links, "links")
    if links.isEmpty():
        return comps
    a = comps.select(F.col("class").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("class").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges).withColumnRenamed("vertex", "comp")
    return saved(comps.join(roots.hint("merge"), "comp", "left").select("class", F.coalesce("least", "comp").alias("comp")), "comps")  # a sort-merge join can split a large component


def linked_components(docs: DataFrame, n: int = NGRAM, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, ``ROW_ID``.

    A text's set holds its distinct runs of ``n`` words (white space ends a word,
    A-Z are lower-cased); with fewer words, the whole sequence. Texts that are
    null, empty or without words have an empty set and link to nothing, so they
    keep their own doc_id. Two texts link when ``whole`` * intersection >=
    ``part`` * union; ``component_id`` is the least doc_id that links reach (null
    ids count only where there is no other). Repeated rows have equal sets and so
    one component. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    known = frequent_grams(rows, n).toArrow()  # FREQUENT rows at most
    order = spark.sparkContext.broadcast(Order(known.column("gram").to_numpy().view(np.uint64), known.column("docs").to_numpy()))

    sets = saved(_row_sets(rows, order, n, part, whole), "sets")
    classes = sets.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(*ROW_ID)).alias("one"), F.min("doc_id").alias("min_id"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")
    stand = classes.select("class", *[F.col(f"one.{c}").alias(c) for c in ROW_ID])
    columns = _columns(sets.select("n", "prefix", *ROW_ID).join(stand, list(ROW_ID)), order)
    met = saved(_first_round(columns, part, whole), "met")

    long = met.where("gram is not null")
    rest = F.greatest(*[F.ceil(part * F.col(c) / whole) - 1 for c in ("n", "p_n")])
    pairs = met.where("gram is null").groupBy(F.col("class").alias("a"), F.col("p_class").alias("b")).agg(F.sum("overlap").alias("overlap"), F.first("n").alias("n"), F.first("p_n").alias("p_n"))
    in_long = saved(long.groupBy("class").agg(F.count(F.lit(1)).alias("m")), "in-long")  # pivots of pieces count twice, which only widens the bound
    for c in ("a", "b"):
        pairs = pairs.join(in_long.select(F.col("class").alias(c), F.col("m").alias(f"long_{c}")), c, "left")
    unseen = F.least(*[F.coalesce(f"long_{c}", F.lit(0)) for c in ("a", "b")])
    pairs = saved(pairs.where(F.col("overlap") + unseen + rest >= _needed(F.col("n"), F.col("p_n"), part, whole)).select("a", "b", "overlap"), "pairs")
    some = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(long.select(F.col("class").alias("a"))).distinct()
    comps = saved(some.select(F.col("a").alias("class"), F.col("a").alias("comp")), "comps")
    whole_sets = saved(_class_sets(rows, stand.join(comps, "class", "left_semi"), n), "grams")

    starred = long.where(F.col("class") != F.col("p_class")).where(_can_link(F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at"), part, whole))
    starred = starred.groupBy(F.col("class").alias("a"), F.col("p_class").alias("b")).agg(F.sum("overlap").alias("overlap"))
    best = pairs.unionByName(starred).groupBy("a").agg(F.max(F.struct("overlap", "b"))["b"].alias("most"), F.min("b").alias("least"))
    first = saved(best.select("a", F.explode(F.array_distinct(F.array("most", "least"))).alias("b")), "first")
    comps = _merged(comps, _linked(first, whole_sets, part, whole))

    comp = lambda c: comps.select(F.col("class").alias(c), F.col("comp").alias(f"comp_{c}"))
    open_pairs = pairs.select("a", "b").join(comp("a"), "a").join(comp("b"), "b").where("comp_a <> comp_b").select("a", "b").join(first, ["a", "b"], "left_anti")
    comps = _merged(comps, _linked(open_pairs, whole_sets, part, whole))

    active, before, pivots = long.select("gram", "class", "n", "at").distinct().withColumn("early", _early(F.col("n"), F.col("at"), part, whole)), 0, FEW
    while True:
        tagged = saved(active.drop("comp", "main").join(comps, "class"), "tagged")
        mixed = saved(_mixed(tagged, before), "mixed")
        rest = saved(tagged.join(mixed.hint("merge"), "gram"), "active")
        dropped(tagged, mixed, *([active] if before else []))
        active = rest
        if active.isEmpty():
            break
        if not before:
            active = saved(_ranked(rest, part, whole), "active")
            dropped(rest)
        comps = _merged(comps, _linked(_cross_pairs(active, before, pivots, part, whole), whole_sets, part, whole))
        before, pivots = pivots, pivots * GROWTH

    least = saved(classes.join(comps, "class").groupBy("comp").agg(F.min("min_id").alias("least_id")), "least")
    of_class = saved(classes.select("class", "d1", "d2", "min_id").join(comps, "class", "left"), "of-class").join(least.hint("merge"), "comp", "left")
    of_class = saved(of_class.select("d1", "d2", F.coalesce("least_id", "min_id").alias("component_id")), "ids")
    dropped(classes, met, pairs, first, in_long, whole_sets, active, comps, least)
    return sets.drop("prefix").join(of_class.hint("merge"), ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *ROW_ID
    )
