"""The engine's tables made from the driver's star schema and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_plan
from ..session import spread

#: Time from which recency counts: 2025-01-01, unix seconds.
AS_OF = 1_735_689_600

#: Queries about symbols.
SYMBOL_QUERIES = ((1, "red_widget breaks small_gear"), (2, "utils.blue_bolt is wrong"), (3, "fix the gear"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_of(key: Column) -> Column:
    """A file name for a number; the eight forms cover each language, kind of test and class of document."""
    k = key.cast("string")
    forms = (("mod_", ".rs"), ("test_", ".py"), ("w_", ".spec.ts"), ("CHANGELOG.", ".md"), ("notes_", ".md"), ("tests/", ".go"), ("main_", ".js"), ("", ".txt"))
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(forms):
        out = F.when(key % 8 == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, path, body, size_bytes, source)."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", file_of(F.col("doc_id")))
    return docs.select(F.col("doc_id").alias("doc"), path.alias("path"), F.col("text").alias("body"), F.col("n_chars").alias("size_bytes"), "source")


def seconds(ts: Column) -> Column:
    """Unix seconds of a time without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with last_ts, the time of the order with the same number."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), seconds(F.col("o_orderdate")).alias("last_ts"))
    return documents(spark, sf_dir).join(orders, "doc", "left")


def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for queries that work on whole bodies."""
    return spread(documents(spark, sf_dir))


#: Symbols that every document gets: (name, first line, last line).
SPANS = (("first", 1, 2), ("rest", 3, 9_999), ("far", 900, 950), ("backwards", 5, 2), ("none", 0, 0))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, chunk, symbol, start_line, text): the chunks of documents with the symbols SPANS."""
    symbols = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, a, b in SPANS])
    rows = searched_documents(spark, sf_dir).select("doc", F.posexplode(chunk_plan(F.col("body"), symbols)).alias("chunk", "c"))
    return rows.select("doc", "chunk", "c.symbol", "c.start_line", "c.text")


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries: the first sentence of every document whose number is divisible by 20."""
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce(F.regexp_extract("text", r"^[^.!?\n]*", 0), F.lit("")).alias("text"))


def supplier_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each supplier imports the one whose number is its nation's plus 1."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("src"), (F.col("s_nationkey") + 1).cast("long").alias("dst")).where("src <> dst")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def commits(spark: SparkSession, sf_dir: str, file: str = "l_partkey") -> DataFrame:
    """(commit, ts, file): orders are commits, in order of date and key, and what they hold are files."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("commit"), seconds(F.col("o_orderdate")).alias("ts"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(file).alias("file")).join(orders, "l_orderkey").select("l_orderkey", "commit", "ts", "file").distinct().drop("l_orderkey")  # as the join has dealt them


def part_paths(edges: DataFrame) -> DataFrame:
    """Co-change edges of parts with the paths of their files; numbers are shorter than paths where pairs are counted."""
    return edges.withColumns({c: F.concat(F.lit("part/"), file_of(F.col(c))) for c in ("path_a", "path_b")})


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), file_of(F.col("p_partkey"))).alias("path"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, html) of all pages: ``site/p<id>/<first word of three letters in the title, or page>.html``."""
    word = F.lower(F.regexp_extract(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), "([A-Za-z]{3,})", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.coalesce(F.nullif(word, F.lit("")), F.lit("page")).alias("word"))
    return rows.select(F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit("/"), F.col("word"), F.lit(".html")).alias("path"), "html")


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target): the links of pages."""
    return pages(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, path, start_line): parts as symbols, many of one name."""
    return table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_line"))


def symbol_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOL_QUERIES, "query_id int, text string")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each conversation but every fifth: its first text is the title, an assistant's turn means merged."""
    rows = turns(spark, sf_dir).where(F.col("conv_id") % 5 != 0)
    return rows.groupBy(F.col("conv_id").alias("number")).agg(F.min_by("text", "turn").alias("title"), F.max((F.col("role") == "assistant")).alias("merged"))


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turns."""
    rows = turns(spark, sf_dir).where("role = 'user'")
    return rows.select(F.col("conv_id").alias("pr_number"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line"), F.col("text").alias("body"), F.lit("").alias("diff_hunk"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries: every vector whose number is divisible by 20."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("query_label"))
