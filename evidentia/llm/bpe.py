"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The corpus' frequent words are encoded once and compiled into a minimal acyclic
automaton: words share prefixes and suffixes, and each arc carries a number, so
that the sum along a word is its place in the sorted lexicon, which gives its
ids. The automaton is one file that every worker memory-maps. Words outside it
are merged exactly, by rank.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ROW_ID, dropped, most_frequent, new_path, saved, with_row_ids
from .words import stretch_codes

#: Fixed: how the vocabulary's byte-level pre-tokenizer cuts a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of the lexicon; distinct words that a worker counts at once.
LEXICON_WORDS, WORDS_AT_ONCE = 131_072, 200_000

_SHORT = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    shown = set(visible)
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [ids[c] for c in letters]
        self.merges = {}  # (id, id) to (rank, id)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        by_key = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.keys, self.ranks, self.news = np.array(by_key, np.int64).reshape(-1, 3).T.copy()
        self.new_of_rank = np.zeros(len(by_key) + 1, np.int64)
        self.new_of_rank[self.ranks] = self.news
        self.first_ids = np.array(self.first, np.int64)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of least rank is merged first, from the left, until none is left."""
        ids = [self.first[b] for b in word]
        return self._merged_short(ids) if len(ids) <= _SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        while len(ids) > 1:
            found = min((m for m in map(get, zip(ids, ids[1:])) if m), default=None)
            if found is None:
                break
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and get((ids[i], ids[i + 1])) == found:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merged_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each short word has, and all ids: one merge in every word at a time, the leftmost of the least rank."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray | None] = [None] * len(words)
        ids = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        which = np.flatnonzero(sizes > 0)  # the words that ``ids`` holds, with ``own`` ids each
        own = sizes[which]
        word = np.repeat(np.arange(len(which)), own)
        none = len(self.keys)

        def ranks(left: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place; ``none`` at the end of a word and without a merge."""
            right = np.minimum(left + 1, len(ids) - 1)
            key = ids[left] << 32 | ids[right]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            return np.where((self.keys[at] == key) & (word[left] == word[right]) & (right > left), self.ranks[at], none)

        rank = ranks(np.arange(len(ids))) if len(ids) and none else np.full(len(ids), none)
        while len(ids):
            starts = np.cumsum(own) - own
            least = np.minimum.reduceat(rank, starts)
            going = least < none
            if going.sum() * 2 < len(which):  # put away the words that are done
                stay = np.repeat(going, own)
                for k in np.flatnonzero(~going):
                    out[which[k]] = ids[starts[k] : starts[k] + own[k]]
                ids, rank, which, own, least = ids[stay], rank[stay], which[going], own[going], least[going]
                word = np.repeat(np.arange(len(which)), own)
                if not len(ids):
                    break
            at = np.flatnonzero((rank == least[word]) & (rank < none))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            ids[at] = self.new_of_rank[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            own = own - np.bincount(word[at], minlength=len(own))
            at -= np.arange(len(at))  # places after the removal
            ids, rank, word = ids[keep], rank[keep], word[keep]
            rank[at] = ranks(at)
            before = at[at > 0] - 1
            rank[before] = ranks(before)
        made = [x if x is not None else self.first_ids[:0] for x in out]
        return np.fromiter(map(len, made), np.int64, len(made)), np.concatenate([*made, self.first_ids[:0]])

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (*m, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer of (word, ids) pairs as one block of memory.

    Words come in sorted order; when the next word leaves a branch, its states are
    looked up by their arcs, so equal right sides become one state.
    """
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    below: list[int] = []  # words that a state accepts

    def settle(node: list) -> int:
        key = (node[0], *node[1])
        if key not in known:
            known[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
            below.append(node[0] + sum(below[t] for _, t in node[1]))
        return known[key]

    path: list[list] = [[False, []]]  # of the word before: [is final, settled arcs]
    labels: list[int] = []
    before = b""
    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        while len(labels) > shared:
            state = settle(path.pop())
            path[-1][1].append((labels.pop(), state))
        for byte in word[shared:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        before = word
    while labels:
        state = settle(path.pop())
        path[-1][1].append((labels.pop(), state))
    root = settle(path[0])

    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):
        skipped = int(final[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            outputs.append(skipped)
            skipped += below[target]
    offsets = np.cumsum([0, *[len(ids) for _, ids in entries]])
    parts = [keys, targets, outputs, final, offsets, [i for _, ids in entries for i in ids]]
    return np.concatenate([np.array([root, *map(len, parts)], np.int64), *[np.asarray(p, np.int64) for p in parts]]).tobytes()


class Lexicon:
    """A compiled lexicon over a memory-mapped file."""

    def __init__(self, block: np.ndarray):
        self.root = int(block[0])
        ends = 7 + np.cumsum(block[1:7])
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = np.split(block[7:], ends[:-1] - 7)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, or -1: all words walk the automaton side by side, byte by byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, place = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        going, depth = np.flatnonzero(sizes > 0), 0
        if not len(self.keys):
            return np.full(len(words), -1)
        while len(going):
            wanted = state[going] << 8 | data[start[going] + depth]
            arc = np.searchsorted(self.keys, wanted)
            arc[arc == len(self.keys)] = 0
            there = self.keys[arc] == wanted
            state[going[~there]] = -1
            going, arc = going[there], arc[there]
            state[going] = self.targets[arc]
            place[going] += self.outputs[arc]
            depth += 1
            going = going[sizes[going] > depth]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, place, -1)


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


class Cutter:
    """Cuts many texts into words as WORD does, all at once.

    A word is a run of letters, of numbers or of other signs, with a single space
    in front if there is one, or what is left of white space. Contractions come
    before letters.
    """

    def __init__(self):
        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                a, b = m.span()
                shift = 0x800 if a >= 0xD800 else 0
                self.classes[a + shift : b + (0x800 if b > 0xD800 else 0)] = kind
        self.classes[0xD800:0xE000] = _OTHER

    def cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the number of each word of all texts among them, and how many words each text has."""
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n, kind = len(chars), self.classes[chars]
        if not n:
            return [], np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[begins] = True
        edge[n] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # white space before a word: its last sign stands alone, or goes with the word if it is a space
        runs = np.flatnonzero(start)
        ends = np.append(runs[1:], n)
        ends = ends[(kind[runs] == _SPACE) & ~edge[ends]]
        start[ends - 1] = True
        start[ends[chars[ends - 1] == 32]] = False
        # contractions
        at = np.flatnonzero((chars == 39) & start)
        at = at[~edge[at + 1]]
        one = chars[at + 1]
        two = np.where(edge[np.minimum(at + 2, n)], 0, chars[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        for length, which in ((2, short), (3, long)):
            rest = at[which] + length
            rest = rest[~edge[rest]]
            start[rest[kind[rest] == _LETTER]] = True

        first = np.flatnonzero(start)
        last = np.append(first[1:], n)
        size = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        byte = np.concatenate(([0], np.cumsum(size)))
        data = whole.encode()
        a, b = byte[first], byte[last]
        code, more = stretch_codes(data, a, b), stretch_codes(data, a, b, 1)
        _, one_of, number = np.unique(code, return_index=True, return_inverse=True)
        number = number.ravel()
        if (more != more[one_of][number]).any():  # two words of one code: tell them apart by their bytes
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(data[x:y], len(known)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            return list(known), number, np.diff(np.append(np.searchsorted(first, begins), len(first)))
        words = [data[x:y] for x, y in zip(a[one_of].tolist(), b[one_of].tolist(), strict=True)]
        return words, number, np.diff(np.append(np.searchsorted(first, begins), len(first)))


class Encoder:
    """Encodes batches of texts: each distinct word of a batch is looked up once, unseen ones are merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.cutter = vocabulary, lexicon, Cutter()
        self.special = special_pattern(vocabulary.special)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of all words: how many ids each has, and the ids one after another."""
        place = self.lexicon.places(words)
        known = place >= 0
        at = place[known]
        sizes = np.zeros(len(words), np.int64)
        sizes[known] = self.lexicon.offsets[at + 1] - self.lexicon.offsets[at]
        short = ~known & (np.fromiter(map(len, words), np.int64, len(words)) <= _SHORT)
        sizes[short], merged = self.vocabulary.merged_all([words[i] for i in np.flatnonzero(short)])
        long = np.flatnonzero(~known & ~short)
        longs = [self.vocabulary.merged(words[i]) for i in long]
        sizes[long] = [len(x) for x in longs]
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        out[_spread(start[known], sizes[known])] = self.lexicon.ids[_spread(self.lexicon.offsets[at], sizes[known])]
        out[_spread(start[short], sizes[short])] = merged
        out[_spread(start[long], sizes[long])] = [i for x in longs for i in x]
        return sizes, out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after another."""
        pieces, of_text, special = [], [], []  # special: (piece that it stands behind, id)
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    special.append((len(pieces) - 1, self.vocabulary.special[part]))
                else:
                    pieces.append(part)
                    of_text.append(i)
        words, used, counts = self.cutter.cut(pieces)
        sizes, ids = self._ids(words)
        start = np.cumsum(sizes) - sizes
        out = ids[_spread(start[used], sizes[used])]
        ends = np.concatenate(([0], np.cumsum(sizes[used])))
        last = np.cumsum(counts)
        of_piece = ends[last] - ends[last - counts]
        if special:
            behind = np.cumsum(of_piece)[[k for k, _ in special]]
            out = np.insert(out, behind, [i for _, i in special])
            np.add.at(of_piece, [k for k, _ in special], 1)
        return np.bincount(of_text, of_piece, len(texts)).astype(np.int64), out


def special_pattern(special: Iterable[str]):
    """Splits a text at the strings of special tokens, and keeps them."""
    found = sorted(special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None


def _spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of each piece, one piece after another."""
    ends = np.cumsum(sizes)
    return np.repeat(start - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def decode(ids: Iterable[int], bytes_of: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _chunks(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in pieces of some ``most`` characters, each text whole, with the place of the first."""
    piece, size, first = [], 0, 0
    for i, value in enumerate(batch.column("text")):
        piece.append(value.as_py() or "")
        size += len(piece[-1])
        if size >= most:
            yield first, piece
            piece, size, first = [], 0, i + 1
    if piece:
        yield first, piece


def frequent_words(docs: DataFrame, most: int, special: Iterable[str]) -> list[str]:
    """The most frequent words of all whole texts, ``most`` at most."""
    special = special_pattern(special)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = Cutter(), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for _, texts in _chunks(batch):
                words, used, _ = cutter.cut([p for t in texts for p in special.split(t)[::2]] if special else texts)
                for word, n in zip(words, np.bincount(used, minlength=len(words)).tolist(), strict=True):
                    if len(word) <= _SHORT:
                        counts[word] += n
                if len(counts) >= WORDS_AT_ONCE:
                    yield out()
        yield out()

    totals = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    totals = saved(totals, "words")
    found = [r[0] for r in most_frequent(totals, "n", most).select("word").toLocalIterator()]
    dropped(totals)
    return found


def ship_lexicon(spark: SparkSession, vocabulary: Vocabulary, words: Iterable[str]) -> str:
    """Compile ``words`` and send the file to every executor; returns the name under which they find it."""
    block = compile_lexicon((w, vocabulary.merged(w)) for w in {w.encode() for w in words})
    folder = new_path(spark, "lexicon")
    name = f"{folder.rpartition('/')[2]}.bin"  # files that are sent need names of their own
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for i in range(0, len(block), 1 << 20):
        stream.write(block[i : i + (1 << 20)])
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_decode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), decoded (text), ``ROW_ID``.

    Ids are those of the tokenizers library without added special tokens; the
    strings of special tokens in a text become their ids, as there. A null text
    counts as empty: no ids, and empty when decoded. Words of any length are
    merged exactly. Repeated rows each have their row, an empty table gives an
    empty result; further columns, whatever their names, aren't read. The vocabulary, of fixed size, and the lexicon, of ``lexicon_words``
    words at most, are all that is sent to the executors.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    name = ship_lexicon(spark, vocabulary, frequent_words(rows, lexicon_words, list(vocabulary.special)))
    shared = spark.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, Lexicon(np.memmap(SparkFiles.get(name), np.int64, "r")))
        for batch in batches:
            for first, texts in _chunks(batch):
                sizes, ids = encoder.encode(texts)
                ends = np.cumsum(sizes)
                plain = ids.tolist()
                decoded = [decode(plain[e - n : e], shared.value.bytes_of) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string()), *[part.column(c) for c in ROW_ID]], names=["doc_id", "ids", "decoded", *ROW_ID])

    return rows.mapInArrow(encoded, f"doc_id long, ids array<int>, decoded string, {ROW_ID[0]} long, {ROW_ID[1]} long")
