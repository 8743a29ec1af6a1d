"""Tokens, hashes and hashed n-gram features of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words that queries and vectors leave out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has",
    "have", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "nor", "not", "of",
    "off", "on", "onto", "or", "our", "ours", "out", "over", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "then", "there", "these", "they", "this", "those", "to", "too", "up", "us", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
)

#: Buckets of the hashed n-gram vector.
DIM = 512

#: Longest token that the text index keeps, in bytes.
MAX_TOKEN_BYTES = 40


def code_tokens(text: Column) -> Column:
    """Lower-case tokens of code and prose: cut at what is no letter or digit, and where a capital follows a small letter or digit."""
    apart = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most MAX_TOKEN_BYTES, the unit of BM25."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def index_token_count(text: Column) -> Column:
    """How many ``index_tokens`` a text has."""
    return F.size(index_tokens(text))


def without_stopwords(tokens: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


def query_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case tokens of over two bytes that are no stopwords; repeats stay."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) > 2) & ~t.isin(*stopwords))


def query_identifiers(text: Column) -> Column:
    """Lower-case words that look like names in code, in order: those with an underscore or a capital, also behind their last dot."""
    words = F.transform(F.split(text, r"[^\p{L}\p{N}_.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    both = F.flatten(F.transform(words, lambda w: F.array(w, F.element_at(F.split(w, r"\."), -1))))
    kept = F.filter(both, lambda w: (F.octet_length(w) >= 3) & (w.contains("_") | w.rlike(r"\p{Lu}")))
    return F.array_distinct(F.transform(kept, F.lower))


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(
        F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"),
    )


def fnv_bucket(text: Column) -> Column:
    """FNV-1a modulo DIM: the low nine bits of offset (293) and prime (435) decide alone."""
    return F.aggregate(utf8_bytes(text), F.lit(293).cast("long"), lambda h, x: h.bitwiseXOR(x) * 435 % DIM).cast("int")


def fnv_hex(text: Column) -> Column:
    """64-bit FNV-1a as 16 hexadecimal digits, in two halves of 32 bits so that nothing overflows."""

    def step(h: Column, x: Column) -> Column:
        low = h["low"].bitwiseXOR(x)
        return F.struct(
            ((h["high"] * 435 + F.shiftright(low * 435, 32) + low * 256) % (1 << 32)).alias("high"),
            (low * 435 % (1 << 32)).alias("low"),
        )

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    h = F.aggregate(utf8_bytes(text), start, step)
    return F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))


def trigrams(token: Column) -> Column:
    """Runs of three characters; none for shorter tokens."""
    n = F.length(token)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(token, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def recency_boost(ts: Column, as_of: Column, weight: float, halflife_days: float) -> Column:
    """``weight``, halved for each ``halflife_days`` of age in unix seconds; 0 without a time."""
    if weight <= 0 or halflife_days <= 0:
        return F.lit(0.0)
    age = F.greatest(as_of - ts, F.lit(0)) / F.lit(86400.0)
    return F.when(ts.isNull(), 0.0).otherwise(F.lit(weight) * F.pow(F.lit(0.5), age / F.lit(halflife_days)))


def percent(part: Column, total: Column) -> Column:
    """part / total in percent, cut off as single precision does it."""
    return F.floor((part / total).cast("float") * F.lit(100).cast("float")).cast("long")


def first_quoted(text: Column) -> Column:
    """What stands in the first pair of quotes, or null."""
    found = F.regexp_extract(text, "(['\"`])(.*?)\\1", 2)
    return F.when(text.rlike("(['\"`]).*?\\1"), found)


def signature(text: Column) -> Column:
    """The first line, trimmed, 200 characters of it."""
    return F.substring(F.trim(F.element_at(F.split(text, "\n"), 1)), 1, 200)


def chunk_plan(body: Column, symbols: Column, chars: int = 4_000) -> Column:
    """Chunks (symbol, start_line, text) of a source: its head at line 0, and the lines of each symbol (name, start_line, end_line).

    Symbols that begin before line 1, end before they begin, or begin behind the
    last line give none; ends behind it are cut.
    """
    lines = F.split(body, "\n")
    usable = F.filter(symbols, lambda s: (s["start_line"] >= 1) & (s["end_line"] >= s["start_line"]) & (s["start_line"] <= F.size(lines)))
    head = F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("start_line"), F.substring(body, 1, chars).alias("text"))

    def chunk(s: Column) -> Column:
        size = F.least(s["end_line"], F.size(lines)) - s["start_line"] + 1
        text = F.substring(F.array_join(F.slice(lines, s["start_line"], size), "\n"), 1, chars)
        return F.struct(s["name"].alias("symbol"), s["start_line"].cast("int").alias("start_line"), text.alias("text"))

    return F.concat(F.array(head), F.transform(usable, chunk))
