"""A source tree as tables: files, bodies, symbols and imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

BODY_CHARS, PREVIEW_CHARS = 60_000, 400


def scan(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Files (path, language, size_bytes, is_test) below ``root``, with ``content`` on demand: the read is pruned without it."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = F.regexp_replace(F.lit(base), "^[a-z0-9]+:/*", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    rows = found.withColumn("path", F.substring(path, F.length(prefix) + 2, F.length(path)))
    rows = rows.where(~P.in_skipped_directory(F.col("path")) & (F.col("length") <= P.MAX_FILE_BYTES) & P.admitted(F.col("path")))
    columns = ["path", P.language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), P.is_test(F.col("path")).alias("is_test")]
    return rows.select(*columns, *(["content"] if with_content else []))


def bodies(files: DataFrame) -> DataFrame:
    """(path, body, preview, source) of files with ``content``: what is indexed, shown, and the whole text; those that aren't UTF-8 are left out."""
    text = F.decode("content", "UTF-8")
    whole = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return whole.select("path", F.substring(text, 1, BODY_CHARS).alias("body"), F.substring(text, 1, PREVIEW_CHARS).alias("preview"), text.alias("source"))


_BLOCK = {
    "rust": [
        ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)"),
        ("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
        ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
        ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
    ],
    "javascript": [
        ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
        ("class", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(\w+)\s*\([^;{}]*\)\s*(?::[^{;]+)?\{"),
    ],
    "typescript": [("interface", r"^[ \t]*(?:export\s+)?interface\s+(\w+)")],
}
_BLOCK["typescript"] = _BLOCK["javascript"] + _BLOCK["typescript"]


#: What braces don't count in: comments, strings and characters; templates go up to their end, whatever they hold.
#: A single quote begins a character in Rust, where it may be a lifetime too, and a string elsewhere.
_NO_CODE = {rust: re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])" + ("" if rust else "*") + r"'|`(?:\\.|[^`\\])*`", re.S) for rust in (True, False)}


def without_comments(source: str, language: str) -> str:
    """``source`` with comments, strings and templates as blanks; lines stay where they are."""
    return _NO_CODE[language == "rust"].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _block_end(lines: list[str], start: int) -> int:
    """The line on which the braces that open at or behind ``start`` close, or the one that ends in a semicolon before any opens."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in lines[i]:
            depth += (c == "{") - (c == "}")
            opened = opened or c == "{"
        if opened and depth <= 0 or not opened and lines[i].rstrip().endswith(";"):
            return i
    return len(lines) - 1


def symbols_of(source: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start_line, end_line, signature) in source order; Python by its own parser, others by declarations and braces."""
    lines, out = source.split("\n"), []
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno))
    else:
        code = without_comments(source, language).split("\n")
        for kind, pattern in _BLOCK.get(language, []):
            for i, line in enumerate(code):
                if m := re.match(pattern, line):
                    out.append((m[1], kind, i + 1, _block_end(code, i) + 1))
    out.sort(key=lambda x: (x[2], -x[3], x[0]))
    return [(*s, lines[s[2] - 1].strip()[:200]) for s in out]


def imports_of(source: str, language: str) -> list[str]:
    """Raw import targets in source order: one for each statement, the first module where it names several."""
    out = []
    for line in source.split("\n"):
        text = line.strip()
        if language == "rust" and (m := re.match(r"use\s+([^;{]+)", text)):
            out.append(re.sub(r"\s+as\s+\w+$", "", m[1].strip()).rstrip(":").strip())
        elif language == "python" and (m := re.match(r"from\s+([.\w]+)\s+import\b|import\s+([.\w]+)", text)):
            out.append(m[1] or m[2])
        elif language in ("typescript", "javascript") and re.match(r"import\b", text):
            out += re.findall(r"['\"`]([^'\"`]+)['\"`]", text)[:1]
        elif language in ("typescript", "javascript"):
            out += re.findall(r"\brequire\w*\s*\(\s*['\"`]([^'\"`]+)['\"`]", text)
    return [x for x in out if x]


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (path, name, kind, start_line, end_line, signature) and imports (path, target) of files (path, language, source)."""
    some = files.where(F.col("language").isin(*P.SUPPORTED)).select("path", "language", "source")

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *s) for p, lang, source in batch.itertuples(index=False) for s in symbols_of(source or "", lang)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line", "signature"])

    def imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, t) for p, lang, source in batch.itertuples(index=False) for t in imports_of(source or "", lang)], columns=["path", "target"])

    found = some.mapInPandas(symbols, "path string, name string, kind string, start_line int, end_line int, signature string")
    targets = some.mapInPandas(imports, "path string, target string").withColumn("target", P.normalized_target(F.col("target"))).where("target <> ''")
    return found, targets


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, chunk, symbol, start_line, text, hash) of files (path, source) by ``chunk_plan``, numbered from 0."""
    own = symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("symbols"))  # of one file
    none = F.expr("cast(array() as array<struct<start_line:int,end_line:int,name:string>>)")
    rows = files.select("path", "source").join(own, "path", "left").select("path", F.posexplode(T.chunk_plan(F.col("source"), F.coalesce("symbols", none))).alias("chunk", "c"))
    return rows.select("path", "chunk", "c.symbol", "c.start_line", "c.text", T.fnv_hex(F.concat_ws(" ", "path", "c.symbol", "c.text")).alias("hash"))
