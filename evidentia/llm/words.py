"""Words of whole texts as 64-bit codes, and hashes of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Code units that end a word: space and the controls 0x09 to 0x0D.
SPACE = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z and turns every other ASCII byte that is neither a letter nor a digit into a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def space_words(text: bytes) -> list[bytes]:
    """Words between white space, unchanged."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """Words between white space with A-Z lower-cased; other letters stay."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


#: Bytes of joined texts that are coded at once; bytes up to which a word is coded together with all others.
_AT_ONCE, _SHORT = 1 << 19, 64

_WHITE = np.isin(np.arange(256), list(SPACE))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stretch_codes(data: bytes, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit code of the bytes in each [first, last): eight bytes at a time go through ``combined``, in all short stretches at once."""
    sizes = last - first
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    code = combined(np.full(len(first), seed + 1, np.uint64), sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > _SHORT)
    going = np.flatnonzero((sizes > 0) & (sizes <= _SHORT))
    done = 0
    while len(going):
        part = eights[first[going] + done] & _KEEP[np.minimum(sizes[going] - done, 8)]
        code[going] = combined(code[going], part)
        done += 8
        going = going[sizes[going] > done]
    code[long] = [xxhash.xxh3_64_intdigest(data[a:b], seed) for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)]
    return code


class WordCodes:
    """64-bit codes of the words between white space, for many texts at a time, A-Z lower-cased if ``lower``; one array of codes for each seed."""

    def __init__(self, lower: bool, seeds: tuple[int, ...] = (0,)):
        self.lower, self.seeds = lower, seeds

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join([*texts, b""])
        joined = joined.lower() if self.lower else joined
        data = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = ~_WHITE[data]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is a space
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        counts = np.diff(np.searchsorted(first, ends), prepend=0)
        return np.stack([stretch_codes(joined, first, last, s) for s in self.seeds]), counts

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' codes one after another (with several seeds, a row for each), and how many words each text has."""
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text) > _AT_ONCE:
                out.append(self._some(some))
                some, size = [], 0
            some.append(text)
            size += len(text) + 1
        out.append(self._some(some) if some else (np.empty((len(self.seeds), 0), np.uint64), np.empty(0, np.int64)))
        codes = np.concatenate([c for c, _ in out], 1)
        return codes if len(self.seeds) > 1 else codes[0], np.concatenate([n for _, n in out])


class Coder(dict):
    """Word to 64-bit code; remembers a bounded number of short words."""

    def __init__(self, limit: int = 200_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[word] = code
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair (left, right), element by element."""
    x = left * _M1 + right
    x ^= x >> _S32
    x *= _M2
    x ^= x >> _S29
    return x


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` codes: item i covers codes i to i + n - 1. Runs double, so it takes log2(n) steps."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    total, done, power, size = None, 0, codes, 1
    count = len(codes) - n + 1
    while True:
        if n & size:
            part = power[done : done + count]
            total = part if total is None else combined(total, part)
            done += size
        if done == n:
            return total if n > 1 else total.copy()
        power = combined(power[:-size], power[size:])
        size *= 2


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    for value in values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()):
        yield value.as_py() or b""


def marked_spans(n: int, starts: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, start + length) in [0, n): starts and ends of its maximal runs."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + length, -1)
    inside = np.concatenate(([0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
