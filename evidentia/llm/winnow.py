"""Benchmark decontamination by winnowing.

Of every ``span - gram + 1`` consecutive word ``gram``-grams the one with the
smallest hash is a fingerprint. Two texts that share ``span`` words share those
grams and so a fingerprint: the join of fingerprints misses no shared span. Each
hit is then extended: the ``span``-word windows around it are compared whole.

The benchmark's fingerprints and windows are counted first. Up to
``broadcast_windows`` they go to the executors as sorted arrays, and documents
are read once without a shuffle; beyond that both sides are joined by shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROW_ID, bounded_batches, dropped, saved, with_row_ids
from .words import Coder, alnum_words, marked_spans, texts_of, window_hashes

SPAN, GRAM = 10, 5
BROADCAST_WINDOWS = 1_000_000

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def fingerprints(codes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Places of the winnowed grams of one text; none if it has fewer than ``span`` words."""
    grams = window_hashes(codes, gram)
    width = span - gram + 1
    if len(grams) < width:
        return np.empty(0, np.int64)
    # blocks of doubled width: the place of the least gram, the rightmost of equals
    place, size = np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[:-step], place[step:]
        place = np.where(grams[right] <= grams[left], right, left)
        size += step
    return np.unique(place)


def benchmark_windows(benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """(item_id, length, hash, kind): kind 0 a window of an item, kind 1 a fingerprint of one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch), strict=True):
                codes = coder.codes(alnum_words(text))
                if not len(codes):
                    continue
                length = min(span, len(codes))
                whole = np.unique(window_hashes(codes, length))
                prints = np.unique(window_hashes(codes, gram)[fingerprints(codes, span, gram)]) if length == span else whole[:0]
                made = np.concatenate([whole, prints]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(made), pa.string()),
                        pa.array(np.full(len(made), length, np.int32)),
                        pa.array(made),
                        pa.array(np.repeat(np.array([0, 1], np.int32), [len(whole), len(prints)])),
                    ],
                    names=["item_id", "length", "hash", "kind"],
                )

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        rows, "item_id string, length int, hash long, kind int"
    )


class Lexicon:
    """Windows of one length in sorted order, with the items of each."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.items, self.first = items[order], np.append(first, len(hashes))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash its place in ``self.hashes``, or -1."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def items_at(self, places: np.ndarray) -> np.ndarray:
        places = np.unique(places)
        return np.concatenate([self.items[self.first[p] : self.first[p + 1]] for p in places]) if len(places) else self.items[:0]


def _found_locally(rows: DataFrame, windows: DataFrame, span: int, gram: int) -> DataFrame:
    table = windows.toArrow()
    kind, length, hashes = (table.column(c).to_numpy() for c in ("kind", "length", "hash"))
    hashes = hashes.astype(np.int64).view(np.uint64)
    ids = table.column("item_id").to_pylist()
    names = sorted({x for x in ids if x is not None})
    number = {x: i for i, x in enumerate(names)}
    item = np.array([number.get(x, -1) for x in ids], np.int32)  # -1: without an id
    lexicons = {int(n): Lexicon(hashes[(kind == 0) & (length == n)], item[(kind == 0) & (length == n)]) for n in np.unique(length)}
    shared = rows.sparkSession.sparkContext.broadcast((np.unique(hashes[kind == 1]), lexicons, names))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, lexicons, names = shared.value
        coder = Coder()
        for batch in batches:
            counts, spans, items = [], [], []
            for text in texts_of(batch):
                codes = coder.codes(alnum_words(text))
                n = len(codes)
                counts.append(n)
                starts, lengths, hit = [], [], []
                for length, lexicon in lexicons.items():
                    if length > n:
                        continue
                    if length == span:
                        at = fingerprints(codes, span, gram)
                        grams = window_hashes(codes, gram)[at]
                        near = np.searchsorted(prints, grams)
                        near[near == len(prints)] = 0
                        at = at[prints[near] == grams] if len(prints) else at[:0]
                        if not len(at):
                            continue
                        begin = np.unique(at[:, None] - np.arange(span - gram + 1))
                        begin = begin[(begin >= 0) & (begin <= n - span)]
                        hashes = window_hashes(codes, span)[begin]
                    else:
                        begin, hashes = np.arange(n - length + 1), window_hashes(codes, length)
                    places = lexicon.places(hashes)
                    starts.append(begin[places >= 0])
                    lengths.append(np.full(len(starts[-1]), length))
                    hit.append(lexicon.items_at(places[places >= 0]))
                if sum(map(len, starts)):
                    first, last = marked_spans(n, np.concatenate(starts), np.concatenate(lengths))
                    spans.append([{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)])
                    items.append([names[i] for i in np.unique(np.concatenate(hit)) if i >= 0])
                else:
                    spans.append([])
                    items.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in ROW_ID], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", *ROW_ID, "n_words", "spans", "items"],
            )

    return rows.mapInArrow(found, f"doc_id long, {ROW_ID[0]} long, {ROW_ID[1]} long, n_words long, spans array<struct<first:int,last:int>>, items array<string>")


def _found_by_shuffle(rows: DataFrame, windows: DataFrame, span: int, gram: int, broadcast_windows: int) -> DataFrame:
    """The same by joins on the hashes, whatever the size of the benchmark.

    Windows of items under ``span`` words have no fingerprint. Up to
    ``broadcast_windows`` of them are sent, so that only document windows among
    them are emitted; beyond that all of these lengths are.
    """
    lengths = [r[0] for r in windows.where("kind = 0").select("length").distinct().collect()]  # at most ``span`` of them
    short = windows.where(F.col("length") < span).select("hash").distinct()
    known = rows.sparkSession.sparkContext.broadcast(np.sort(short.toArrow().column("hash").to_numpy())) if short.count() <= broadcast_windows else None

    def wanted(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = window_hashes(codes, n)
        begin = np.arange(len(hashes)) if known is None else np.flatnonzero(np.isin(hashes.view(np.int64), known.value))
        return begin, hashes[begin]

    ids = f"{ROW_ID[0]} long, {ROW_ID[1]} long"

    def emitted(batch: pa.RecordBatch, made: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        row = np.repeat([m[0] for m in made], [len(m[2]) for m in made]).astype(np.int64)
        begin = np.concatenate([m[2] for m in made]).astype(np.int32)
        hashes = np.concatenate([m[3] for m in made]).view(np.int64)
        length = np.repeat([m[1] for m in made], [len(m[2]) for m in made]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ROW_ID], pa.array(length), pa.array(begin), pa.array(hashes)], names=[*ROW_ID, "length", "begin", "hash"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            made = []
            for i, text in enumerate(texts_of(batch)):
                codes = coder.codes(alnum_words(text))
                at = fingerprints(codes, span, gram)
                made.append((i, 0, at, window_hashes(codes, gram)[at]))
                made += [(i, n, *wanted(codes, n)) for n in lengths if n != span and n <= len(codes)]
            if made:
                yield emitted(batch, made)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            made = []
            for i, (text, at) in enumerate(zip(texts_of(batch), batch.column("places").to_pylist(), strict=True)):
                codes = coder.codes(alnum_words(text))
                begin = np.unique(np.array(at)[:, None] - np.arange(span - gram + 1))
                begin = begin[(begin >= 0) & (begin <= len(codes) - span)]
                made.append((i, span, begin, window_hashes(codes, span)[begin]))
            if made:
                yield emitted(batch, made)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array([len(alnum_words(t)) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in ROW_ID], counts], names=["doc_id", *ROW_ID, "n_words"])

    schema = f"{ids}, length int, begin int, hash long"
    made = saved(rows.mapInArrow(prints, schema), "prints")
    near = made.where("length = 0").join(windows.where("kind = 1").select("hash").distinct(), "hash", "left_semi")
    near = near.groupBy(*ROW_ID).agg(F.collect_set("begin").alias("places"))  # no more than the document's own words
    whole = rows.join(near, list(ROW_ID)).select("text", *ROW_ID, "places").mapInArrow(extended, schema)
    hits = saved(whole.unionByName(made.where("length > 0")).join(windows.where("kind = 0").select("length", "hash", "item_id"), ["length", "hash"]), "hits")
    dropped(made)
    spans = hits.groupBy(*ROW_ID).agg(F.sort_array(F.collect_set(F.struct(F.col("begin").alias("first"), (F.col("begin") + F.col("length")).alias("last")))).alias("spans"))
    items = hits.groupBy(*ROW_ID).agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    def merged(spans):
        """Overlapping or touching [first, last) in order become one; the running span is the last of the list."""
        empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")

        def step(done, x):
            last = F.element_at(done, -1)
            joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
            return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(spans, empty, step)

    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return (
        rows.mapInArrow(counted, f"doc_id long, {ids}, n_words long")
        .join(spans, list(ROW_ID), "left")
        .join(items, list(ROW_ID), "left")
        .select("doc_id", *ROW_ID, "n_words", F.coalesce(merged(F.col("spans")), none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans of hit words [first, last), items with a window in it, ``ROW_ID``.

    A window is ``span`` consecutive words of an item of ``benchmark``
    (item_id, text), or all words of a shorter one. Texts that are null or hold
    no word give 0 words and no hit; such items give no window. Rows of an item
    are taken together, repeated ones count once, and an item without an id
    marks words but isn't listed. Repeated documents each have their row. Texts and
    ids of any length are taken whole; an empty table of documents gives an empty
    result, an empty benchmark no hit. Other columns, whatever their names, are
    not read. Windows are compared by 64-bit hashes of their words.
    """
    bounded_batches(docs.sparkSession)
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    windows = saved(benchmark_windows(benchmark, span, gram), "windows")
    if windows.count() <= broadcast_windows:
        return _found_locally(rows, windows, span, gram)
    return _found_by_shuffle(rows, windows, span, gram, broadcast_windows)
