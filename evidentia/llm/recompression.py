"""Substring dedup by recompression.

Rounds rename a text, word codes at first: a run of one symbol becomes one
symbol, then a pair of neighbours of which the left is in one half of the
alphabet and the right in the other becomes one. New names are hashes of what
they replace, so all tasks give the same name to the same content, without a
table of names. Equal substrings get equal symbols but near their ends: with
each symbol goes the stretch of words that its making looked at, and inside an
equal stretch it is made equally.

Each window of ``window`` words is represented by one high symbol whose stretch
lies in it, the one with the least hash of that stretch (or by the window's own
hash, in runs that leave no such symbol). Equal windows have equal
representatives, so only windows whose representative is shared can repeat;
these are verified by 128-bit hashes of all their words, those that share a
representative together where what they cover is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROW_ID, dropped, saved, with_row_ids
from .words import WordCodes, combined, marked_spans, space_words, texts_of

WINDOW, ROUNDS = 35, 3

#: Bytes of texts that are renamed at once.
BYTES_AT_ONCE = 1 << 20

#: ``at`` of the row for a whole text; representatives that are a window have -2 - start.
WHOLE = -1


@dataclass
class Symbols:
    """The symbols of a text: names, words [first, last) they stand for, words [low, high) that decided on them."""

    name: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray


def recompressed(codes: np.ndarray, stop: np.ndarray, rounds: int) -> Symbols:
    """``rounds`` rounds over codes; those marked in ``stop`` (between texts) are never merged."""
    name, first = codes, np.arange(len(codes))
    low, high = first, first + 1
    for k in range(rounds):
        # runs: what ends a run is the next symbol on either side, so its stretch counts in
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | stop[1:] | stop[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(name)))
        wide_low, wide_high = low.copy(), high.copy()
        wide_low[1:] = np.minimum(low[1:], low[:-1])
        wide_high[:-1] = np.maximum(high[:-1], high[1:])
        name = np.where(count > 1, combined(name[at], count.astype(np.uint64)), name[at])
        low, high = wide_low[at], wide_high[at + count - 1]
        first, stop = first[at], stop[at]
        # pairs: a symbol of the left half merges with a right neighbour of the right half
        right = combined(name, np.full(len(name), k + 1, np.uint64)) >> np.uint64(63) == 1
        merge = np.zeros(len(name), bool)
        merge[:-1] = ~right[:-1] & right[1:] & ~stop[:-1] & ~stop[1:]
        wide_low, wide_high = low.copy(), high.copy()
        wide_high[:-1] = np.where(right[:-1], high[:-1], np.maximum(high[:-1], high[1:]))
        wide_low[1:] = np.where(right[1:], np.minimum(low[1:], low[:-1]), low[1:])
        kept = np.ones(len(name), bool)
        kept[1:] = ~merge[:-1]
        at = np.flatnonzero(kept)
        pair = merge[at]
        second = np.minimum(at + 1, len(name) - 1)
        name = np.where(pair, combined(name[at], name[second]), name[at])
        high = np.where(pair, np.maximum(high[at], high[second]), wide_high[at])
        low = np.where(pair, np.minimum(low[at], low[second]), wide_low[at])
        first, stop = first[at], stop[at]
    return Symbols(name, first, low, high)


def leftmost_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range [low, high] the place of its least value, the leftmost of equals."""
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, place, step = np.empty(len(low), np.int64), np.arange(len(values)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        mine = level == k
        a, b = place[low[mine]], place[high[mine] - step + 1]
        out[mine] = np.where(values[b] < values[a], b, a)
        if len(place) <= step:
            break
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        step *= 2
    return out


class Parser:
    """Representatives and hashes of the windows of many texts at a time."""

    def __init__(self, window: int, rounds: int):
        self.window, self.rounds, self.steps = window, rounds, window.bit_length()
        self.words = WordCodes(lower=False, seeds=(0, 1))

    def join(self, texts: list[bytes]) -> None:
        """Take these texts, one after another with a stop before the first and behind each."""
        codes, self.sizes = self.words.codes(texts)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes
        self.stop = np.zeros(codes.shape[1] + len(texts) + 1, bool)
        self.stop[0] = True
        self.stop[self.starts + self.sizes] = True
        self.both = np.zeros((2, len(self.stop)), np.uint64)
        self.both[:, ~self.stop] = codes
        self.all = self.both[0]
        count = np.maximum(self.sizes - self.window + 1, 0)
        self.windows = np.repeat(self.starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        self.runs = [self._doubled(codes) for codes in self.both]

    def _doubled(self, codes: np.ndarray) -> list[np.ndarray]:
        """Hashes of all stretches of 1, 2, 4, ... words, up to the window."""
        out = [codes]
        for k in range(self.steps - 1):
            out.append(combined(out[-1][: -(1 << k)], out[-1][1 << k :]))
        return out

    def stretches(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words [low, high) of stretches no longer than a window, from the two longest runs that cover each."""
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.uint64)
        for k, run in enumerate(self.runs[0]):
            mine = np.flatnonzero(level == k)
            if len(mine):
                out[mine] = combined(combined(run[low[mine]], run[high[mine] - (1 << k)]), size[mine].astype(np.uint64))
        return out

    def representatives(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: where its representative starts (a whole window as -2 - start), and that one's hash."""
        symbols = recompressed(self.all, self.stop, self.rounds)
        value = np.zeros(len(symbols.low), np.uint64)
        inside = np.flatnonzero(symbols.high - symbols.low <= self.window)  # others lie in no window
        value[inside] = self.stretches(symbols.low[inside], symbols.high[inside])
        low = np.searchsorted(symbols.low, self.windows)
        high = np.searchsorted(symbols.high, self.windows + self.window, "right") - 1
        some = high >= low
        place = leftmost_least(value, low[some], high[some])
        at, key = -2 - self.windows, np.empty(len(self.windows), np.uint64)
        at[some], key[some] = symbols.first[place], value[place]
        rest = self.windows[~some]
        key[~some] = self.stretches(rest, rest + self.window)
        return at, key

    def hashes(self, windows: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of all words of each window, from word codes of their own."""
        again = self.window - (1 << self.steps - 1)
        return [combined(run[-1][windows], run[-1][windows + again]).view(np.int64) for run in self.runs]

    def names(self, text: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of all words of each of these texts."""
        ends = self.starts + self.sizes
        return np.array([[xxhash.xxh3_64_intdigest(codes[self.starts[i] : ends[i]]) for i in text.tolist()] for codes in self.both], np.uint64).reshape(2, -1)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _gathered(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with some BYTES_AT_ONCE bytes, each text whole."""
    first = total = n = 0
    for i, size in enumerate(sizes):
        total, n = total + size, i + 1
        if total >= BYTES_AT_ONCE:
            yield first, n
            first, total = n, 0
    if n > first:
        yield first, n


def _fields(column: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """The fields of each list of structs as arrays, without an object for each struct; null is an empty list."""
    each, ends = column.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    fields = [each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(each.type.num_fields)]
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        yield [x[a:b] for x in fields]


_ID_SCHEMA = ", ".join(f"{c} long" for c in ROW_ID)


def shared_symbols(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """(key, key2, at, ROW_ID): each text's representatives, and with at = WHOLE the text itself if it has a window."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, rounds)
        for batch in batches:
            texts = list(texts_of(batch))
            for first, last in _gathered(map(len, texts)):
                parser.join(texts[first:last])
                at, key = parser.representatives()
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                at, key, begin = at[new], key[new], parser.windows[new]
                text = parser.text_of(begin)
                at = np.where(at >= 0, at - parser.starts[text], -2 - (-2 - at - parser.starts[text]))
                whole = np.flatnonzero(parser.sizes >= window)
                names = parser.names(whole)
                row = pa.array(np.concatenate([whole, text]) + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([names[0], key]).view(np.int64)),
                        pa.array(np.concatenate([names[1].view(np.int64), np.zeros(len(key), np.int64)]), mask=np.arange(len(whole) + len(key)) >= len(whole)),
                        pa.array(np.concatenate([np.full(len(whole), WHOLE), at]).astype(np.int32)),
                        *[batch.column(c).take(row) for c in ROW_ID],
                    ],
                    names=["key", "key2", "at", *ROW_ID],
                )

    return rows.mapInArrow(parsed, f"key long, key2 long, at int, {_ID_SCHEMA}")


def _contexts(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """(key, c1, c2, first, last, weight, ROW_ID): each representative in ``places`` with its windows [first, last] and the hash of all words of these."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, rounds)
        for batch in batches:
            texts = list(texts_of(batch))
            places = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.column("places")]
            for first, last in _gathered(map(len, texts)):
                parser.join(texts[first:last])
                at, key = parser.representatives()
                wanted = np.zeros((2, len(parser.stop)), bool)
                for start, found in zip(parser.starts, places[first:last], strict=True):
                    wanted[0, start + found[found >= 0]] = True
                    wanted[1, start - 2 - found[found < 0]] = True
                edge = np.ones(len(at) + 1, bool)
                edge[1:-1] = at[1:] != at[:-1]
                begin, end = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
                whole = at[begin] < 0
                mine = wanted[whole.astype(int), np.where(whole, -2 - at[begin], at[begin])]
                begin, end = begin[mine], end[mine]
                a, b = parser.windows[begin], parser.windows[end]
                size = (b - a).astype(np.uint64)
                # the windows of one representative overlap, so the outermost two hold all words
                names = [combined(combined(x.view(np.uint64), y.view(np.uint64)), size).view(np.int64) for x, y in zip(parser.hashes(a), parser.hashes(b), strict=True)]
                text = parser.text_of(a)
                row = pa.array(text + first)
                ints = [pa.array((x - parser.starts[text]).astype(np.int32)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[begin].view(np.int64)), *map(pa.array, names), *ints, batch.column("weight").take(row), *[batch.column(c).take(row) for c in ROW_ID]],
                    names=["key", "c1", "c2", "first", "last", "weight", *ROW_ID],
                )

    return rows.mapInArrow(hashed, f"key long, c1 long, c2 long, first int, last int, weight int, {_ID_SCHEMA}")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(h1, h2, start, weight, ROW_ID) of the windows in ``ranges``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, 0)
        for batch in batches:
            texts, ranges = list(texts_of(batch)), batch.column("ranges")
            for first, last in _gathered(map(len, texts)):
                parser.join(texts[first:last])
                some = ranges.slice(first, last - first)
                each = some.flatten()
                a, b, weight = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                text = np.repeat(np.arange(last - first), pc.list_value_length(some).to_numpy(zero_copy_only=False))
                size = b - a + 1
                start = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                text, weight = np.repeat(text, size), np.repeat(weight, size)
                row = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, parser.hashes(start + parser.starts[text])), pa.array(start.astype(np.int32)), pa.array(weight.astype(np.int32)), *[batch.column(c).take(row) for c in ROW_ID]],
                    names=["h1", "h2", "start", "weight", *ROW_ID],
                )

    return rows.mapInArrow(hashed, f"h1 long, h2 long, start int, weight int, {_ID_SCHEMA}")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed (spans [first, last) of words), kept (text), ``ROW_ID``.

    Words lie between white space. A word goes if a window of ``window`` words
    that covers it starts anywhere else too, in this text or another; all windows
    are those of the input. What stays is joined by single spaces. Null counts as
    empty, and an empty table gives an empty result. Texts under ``window`` words
    have no window; those of any length are taken whole, and repeated rows are
    repeats of each other. Other columns, whatever their names, are not read.

    What is the same throughout is verified once: texts with the same words are
    one text of weight 2 or more, and so are the windows of a representative with
    the same words around it. Windows are hashed one by one only where a
    representative has several surroundings, and in one place for each of these.
    """
    ids = list(ROW_ID)
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    symbols = saved(shared_symbols(rows, window, rounds), "symbols")

    whole = symbols.where(F.col("at") == WHOLE)
    groups = saved(whole.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ids)).alias("one")).where("n > 1"), "groups")
    copies = saved(whole.join(groups.hint("merge"), ["key", "key2"]).select(*ids, ((F.col("one")[ids[0]] == F.col(ids[0])) & (F.col("one")[ids[1]] == F.col(ids[1]))).alias("stands")), "copies")

    parts = symbols.where(F.col("at") != WHOLE).select("key", "at", *ids)
    shared = saved(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")  # a table of its own: the join below can split hot keys
    places = parts.join(shared.hint("merge"), "key").groupBy(*ids).agg(F.collect_set("at").alias("places"))  # at most a text's words
    places = places.join(copies, ids, "left").where("stands is null or stands").withColumn("weight", F.when(F.col("stands"), 2).otherwise(1))
    places = saved(places.select(*ids, "places", "weight"), "places")
    dropped(symbols, groups, shared)

    contexts = saved(_contexts(rows.join(places, ids).select("text", "places", "weight", *ids), window, rounds), "contexts")
    dropped(places)
    each = contexts.groupBy("c1", "c2").agg(F.sum("weight").alias("n"), F.first("key").alias("key"), F.min(F.struct(*ids, "first", "last")).alias("one"))
    each = saved(each, "each")
    repeated = each.where("n > 1").select("c1", "c2")
    spans = contexts.join(repeated.hint("merge"), ["c1", "c2"]).select(*ids, "first", "last")

    several = saved(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "several")
    chosen = each.join(several.hint("merge"), "key").select("one.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    chosen = chosen.groupBy(*ids).agg(F.collect_list(F.struct("first", "last", "weight")).alias("ranges"))
    windows = saved(_windows(rows.join(chosen, ids).select("text", "ranges", *ids), window), "windows")
    dropped(several)
    again = saved(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2"), "again")
    single = windows.where("weight = 1").join(again.hint("merge"), ["h1", "h2"]).select(*ids, F.col("start").alias("first"), F.col("start").alias("last"))

    starts = spans.unionByName(single).groupBy(*ids).agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    starts = starts.join(copies.select(*ids, "stands"), ids, "full_outer").select(*ids, "starts", F.col("stands").isNotNull().alias("copy"))
    starts = saved(starts, "starts")
    dropped(contexts, each, windows, again, copies)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, spans, kept = [], [], [], []
            for text, starts, copy in zip(texts_of(batch), _fields(batch.column("starts")), batch.column("copy").to_pylist(), strict=True):
                words = space_words(text)
                n = len(words)
                first, last = (np.array([0]), np.array([n])) if copy else marked_spans(n, starts[0], starts[1] - starts[0] + window)
                pieces, at = [], 0
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    pieces += words[at:a]
                    at = b
                counts.append(n)
                gone.append(int((last - first).sum()))
                spans.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                kept.append(b" ".join(pieces + words[at:]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.string()), *[batch.column(c) for c in ROW_ID]],
                names=["doc_id", "n_words", "n_removed", "removed", "kept", *ROW_ID],
            )

    found = rows.join(starts, ids, "left").select("doc_id", "text", "starts", "copy", *ids)
    return found.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string, {_ID_SCHEMA}")
