"""The queries of the engine over the driver's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import evals, graph, history, maintain, retrieval, reviews, verify
from ..operators.tables import top
from ..session import saved, scratch_path
from ..sources import history as payloads
from ..streaming import changes
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# files


@query
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return B.documents(spark, sf_dir).select(
        "path", P.language(path).alias("language"), P.is_test(path).alias("is_test"), P.doc_class(path).alias("doc_class"),
        P.supported(path).alias("supported"), P.admitted(path).alias("admitted"),
    )


@query
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    files = B.documents(spark, sf_dir).where(P.admitted(path) & ~P.in_skipped_directory(path) & (F.col("size_bytes") <= P.MAX_FILE_BYTES))
    groups = files.groupBy(P.language(path).alias("language"), P.doc_class(path).alias("doc_class"), P.is_test(path).alias("is_test"))
    return groups.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_chunks(spark, sf_dir).select("doc", "symbol", "start_line", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


# history


@query
def commit_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_change(B.commits(spark, sf_dir))


@query
def cochange_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.cochange_edges(B.commits(spark, sf_dir)), "strength")


@query
def cochange_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.cochange_edges(B.commits(spark, sf_dir), cap=6), "strength")


@query
def cochange_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = history.cochange_edges(B.commits(spark, sf_dir, "l_suppkey"))
    return rounded(history.strongest(edges), "strength").select("path_a", "path_b", "n", "strength", "rank")


@query
def cochange_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = history.newest(B.commits(spark, sf_dir, "l_suppkey"), history.NEWEST, skip=200)
    return rounded(history.cochange_edges(older), "strength")


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.part_paths(history.cochange_edges(B.commits(spark, sf_dir)))


@query
def expand_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.part_files(spark, sf_dir)
    found = history.expand_cochange(_part_edges(spark, sf_dir), files.select(F.col("path").alias("seed_set"), "path"), files)
    return rounded(found, "confidence").withColumnRenamed("seed_set", "seed")


@query
def co_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("change_set"), F.concat(F.lit("part/"), B.file_of(F.col("p_partkey"))).alias("path"))
    return verify.tests_along(_part_edges(spark, sf_dir), changed)


# graph


@query
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_imports(spark, sf_dir).select("path", "target", P.normalized_target(F.col("target")).alias("normalized"))


@query
def module_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    needles = B.pages(spark, sf_dir).select("path", F.lit("needle").alias("kind"), F.explode(P.module_needles(path)).alias("key"))
    keys = B.page_imports(spark, sf_dir).select("path", F.lit("import").alias("kind"), F.explode(P.candidate_keys(P.normalized_target(F.col("target")))).alias("key"))
    return needles.unionByName(keys)


def _import_classes(spark: SparkSession, sf_dir: str) -> graph.ImportClasses:
    return graph.import_classes(B.page_imports(spark, sf_dir), B.pages(spark, sf_dir).select("path"))


@query
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(_import_classes(spark, sf_dir))


@query
def dependents_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents_of_each(_import_classes(spark, sf_dir), B.pages(spark, sf_dir).select("path"))


@query
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    together = graph.known_cochange(_part_edges(spark, sf_dir), B.part_files(spark, sf_dir))
    return graph.whole_stats(_import_classes(spark, sf_dir), saved(together.select("path_a", "path_b"), "together"))  # read twice


@query
def explain_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    together = saved(_part_edges(spark, sf_dir), "together")  # read several times
    files = B.part_files(spark, sf_dir).unionByName(B.pages(spark, sf_dir).select("path"))
    return rounded(graph.explain_all(together, _import_classes(spark, sf_dir), files), "weight")


# retrieval


@query
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.benchmark_queries(spark, sf_dir).select("query_id", F.posexplode(T.query_tokens(F.col("text"))).alias("pos", "token"))


@query
def embed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.hashed_vectors(B.searched_documents(spark, sf_dir), T.index_tokens(F.col("body"))), "weight")


@query
def hashed_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_search(B.searched_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir), 10, T.index_tokens).select("query_id", "doc", "score", "rank")


@query
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best chunk, with its symbol and line."""
    chunks = B.document_chunks(spark, sf_dir)
    found = retrieval.vector_search(B.searched_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir), 10, T.index_tokens, chunks=chunks)
    shown = found.join(chunks.select("doc", F.col("chunk").alias("best"), "symbol", "start_line", F.md5("text").alias("text_md5")), ["doc", "best"])
    return shown.select("query_id", "doc", "symbol", "start_line", "text_md5", "score", "rank")


@query
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.searched_documents(spark, sf_dir)
    terms = retrieval.term_stats(retrieval.postings(docs)).join(retrieval.field_stats(docs), "field")
    return rounded(terms.select("term", "df", "cf", retrieval.idf(F.col("df"), F.col("n_docs")).alias("idf")), "idf")


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(B.searched_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir), 10)


def _lists(spark: SparkSession, sf_dir: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates by BM25 of path and body, and by the best chunk's vector."""
    docs = B.searched_documents(spark, sf_dir)
    return retrieval.bm25(docs, asked, fields=("path", "body")), retrieval.vector_search(docs, asked, tokens=T.index_tokens, chunks=B.document_chunks(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = B.benchmark_queries(spark, sf_dir)
    return retrieval.fused(*_lists(spark, sf_dir, asked), B.dated_documents(spark, sf_dir), asked, B.AS_OF)


@query
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "doc", "path", "score", F.array_join("signals", "+").alias("signals"), "rank")


@query
def predict_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    found = saved(_fused(spark, sf_dir).drop("best"), "found")  # 8 rows a query, read three times
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    direct = found.join(best, "query_id").select("query_id", F.when(P.is_test(F.col("path")), "test").otherwise("file").alias("section"), "path", F.least(F.col("score") / F.col("best"), F.lit(1.0)).alias("confidence"), F.lit("matches the task").alias("reason"))
    paths = docs.select(F.col("doc").alias("file"), "path")
    commits = B.commits(spark, sf_dir).join(paths, "file").select("commit", "ts", F.col("path").alias("file"))
    seeds = direct.where("section = 'file'").select(F.col("query_id").alias("seed_set"), "path")
    more = history.expand_cochange(history.cochange_edges(commits), seeds, docs).select(F.col("seed_set").alias("query_id"), F.lit("cochange").alias("section"), "path", "confidence", "reason")
    return rounded(direct.unionByName(more), "confidence")


@query
def payload_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = B.searched_documents(spark, sf_dir), B.benchmark_queries(spark, sf_dir)
    best, read = retrieval.bm25_and_matched(docs, asked, 8, "size_bytes")
    returned = best.join(docs.select("doc", F.length(F.substring("body", 1, 400)).alias("chars")), "doc").groupBy("query_id").agg(F.floor(F.sum("chars") / 4).alias("returned_tokens"))
    return returned.join(read.select("query_id", F.floor(F.col("value") / 4).alias("read_tokens")), "query_id")


@query
def rank_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "retry webhook"), (2, "cancel refund")], "query_id int, text string")
    docs = B.documents(spark, sf_dir)
    return retrieval.ranked(docs, asked, "random", 20).join(docs.select("doc", "path"), "doc").select("query_id", "path", "rank")


@query
def symbol_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.symbol_queries(spark).select("query_id", F.posexplode(T.query_identifiers(F.col("text"))).alias("seq", "name"))
    return retrieval.symbols_exact(B.symbols(spark, sf_dir), names.withColumnRenamed("name", "asked").withColumn("name", F.col("asked"))).select("query_id", "seq", F.col("key").alias("name"), "kind", "path", "start_line", "rank")


@query
def symbol_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = B.symbol_queries(spark).select("query_id", F.posexplode(F.array_distinct(T.query_tokens(F.col("text")))).alias("seq", "token"))
    return retrieval.symbols_matching(B.symbols(spark, sf_dir), tokens).select("query_id", "token", "name", "kind", "path", "start_line", "rank")


@query
def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = B.symbol_queries(spark).select(F.col("query_id").cast("long").alias("query_id"), "text")
    found = saved(retrieval.fused(*_lists(spark, sf_dir, asked), B.dated_documents(spark, sf_dir), asked, B.AS_OF), "found")  # 8 rows a query, read several times
    previews = B.documents(spark, sf_dir).select("path", F.substring("body", 1, retrieval.PREVIEW).alias("preview"))
    rows = retrieval.packets(found, B.symbols(spark, sf_dir), asked, chunks=B.document_chunks(spark, sf_dir), previews=previews)
    return rows.select("query_id", "rank", "type", "path", "symbol", "title", F.md5(F.coalesce("snippet", F.lit(""))).alias("snippet_md5"), "score", "signal")


@query
def dense_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest_rows(B.vectors(spark, sf_dir), B.vector_queries(spark, sf_dir), 10, but_itself=True)


@query
def vector_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.vectors(spark, sf_dir).select(F.col("label").alias("grp"), "id", "vector")
    return retrieval.nearest(units, B.vector_queries(spark, sf_dir).select("query_id", "vector"))


@query
def vector_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = B.documents(spark, sf_dir).select("path", F.lit(0).alias("start_line"), F.md5("body").alias("hash"))
    labelled = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents"), "doc_id").select(
        F.concat_ws("/", "source", "lang", B.file_of(F.col("doc_id"))).alias("path"), F.lit(0).alias("start_line"),
        F.when(F.col("quality") == 1, F.md5("text")).otherwise("stale").alias("hash"), F.array(F.lit(1.0).cast("float")).alias("vector"),
    )
    return maintain.reusable(chunks, labelled, 1).select("path", "hash", "reused")


# evaluation


@query
def recall_mrr_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = B.vectors(spark, sf_dir), B.vector_queries(spark, sf_dir)
    ranked = retrieval.nearest_rows(vectors, asked, 20, but_itself=True).withColumnRenamed("id", "item")
    return evals.summary(evals.per_query_by_label(ranked, asked, vectors, (5, 10, 20)), (5, 10, 20))


@query
def recall_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each way of search finds the documents with the text of one, by its first sentence."""
    asked, docs = B.title_queries(spark, sf_dir), B.documents(spark, sf_dir)
    lexical, semantic = (saved(x, "list") for x in _lists(spark, sf_dir, asked))
    hybrid = retrieval.fused(lexical, semantic, B.dated_documents(spark, sf_dir), asked, B.AS_OF, top_k=20)
    same = docs.select("doc", F.md5(F.coalesce("body", F.lit(""))).alias("digest"))
    relevant = same.where("doc % 20 = 0").withColumnRenamed("doc", "query_id").join(same, "digest").select("query_id", F.col("doc").alias("item"))
    lists = {"bm25": lexical, "vector": semantic, "hybrid": hybrid}
    return evals.by_mode({mode: df.where("rank <= 20").select("query_id", F.col("doc").alias("item"), "rank") for mode, df in lists.items()}, relevant)


@query
def recall_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = B.commits(spark, sf_dir, "l_suppkey")
    files = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("path"))
    samples = evals.indexed_samples(evals.connection_samples(history.newest(commits, 200)), files)
    return evals.combined_recovery(history.cochange_edges(history.newest(commits, history.NEWEST, 200)), B.supplier_imports(spark, sf_dir), samples, files)


@query
def recall_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.cochange_recovery(B.commits(spark, sf_dir, "l_suppkey"), 200, history.NEWEST)


# reviews


@query
def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.with_pull_requests(B.review_comments(spark, sf_dir), B.pull_requests(spark, sf_dir)).select("pr_number", "path", "line", "body", "pr_title", "pr_merged", "diff_hunk")


@query
def review_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = reviews.with_pull_requests(B.review_comments(spark, sf_dir), B.pull_requests(spark, sf_dir))
    history_rows = comments.select((F.col("pr_number") * 1000 + F.col("line")).alias("id"), "body")
    return reviews.nearest_texts(history_rows, B.benchmark_queries(spark, sf_dir), T.index_tokens)


@query
def correction_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = B.turns(spark, sf_dir)
    comments = turns.where("role = 'user'").select(F.col("conv_id").alias("pr_number"), F.col("turn").alias("id"), F.col("turn").alias("created_at"))
    commits = turns.where("role = 'assistant'").select(F.col("conv_id").alias("pr_number"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("sha"), F.col("turn").alias("authored_at"))
    found = reviews.next_commits(comments, commits)
    return found.withColumn("next_sha", F.coalesce("next_sha", F.lit(""))).withColumn("next_at", F.coalesce("next_at", F.lit(-1)))


@query
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query
def payload_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.struct(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.lit(None).cast("long").alias("line"), F.col("turn").alias("original_line"), F.col("text").alias("body"), F.struct(F.col("role").alias("login")).alias("user"))
    made = B.turns(spark, sf_dir).select(F.col("conv_id").alias("pr_number"), F.to_json(F.array(comment)).alias("payload"))
    return payloads.review_comments(made).drop("in_reply_to")


# verification


@query
def verification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = verify.matched_profiles(B.documents(spark, sf_dir).select(F.col("source").alias("change_set"), "path"))
    checks = verify.checklist(matched)
    return matched.select("change_set", F.lit("profile").alias("kind"), F.col("profile").alias("text"), F.col("position").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        checks.select("change_set", F.lit("check").alias("kind"), F.col("check").alias("text"), F.col("profile_position").alias("a"), F.col("check_position").alias("b"))
    )


# maintenance and streams


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return maintain.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(True).alias("done"), "n_chars")
    fresh = B.table(spark, sf_dir, "labels").select((F.col("doc_id") + 7).alias("doc_id"), F.lit("new").alias("source"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("n_chars"))
    return maintain.upsert(docs, fresh, ["doc_id"], keep=["done"])


@query
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    keep = B.table(spark, sf_dir, "labels").select("doc_id")
    left = maintain.prune({"files": docs}, keep, "doc_id")["files"].groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    gone = docs.join(keep.distinct(), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("pruned"))
    return left.join(gone, "source", "full_outer").select("source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("pruned", F.lit(0)).alias("pruned"))


@query
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents that are labelled good give way to a row of their own."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    fresh = B.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("labelled").alias("source"))
    return maintain.replace_for(docs, fresh, ["doc_id"])


@query
def recency_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("ts"))
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), B.seconds(F.col("o_orderdate")).alias("ts"))
    return maintain.update_known(docs, orders, "doc_id", "ts")


@query
def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = {"reviewed": ("boolean", False), "note": ("string", ""), "quality": ("int", -1)}
    once = maintain.with_missing_columns(B.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), later)
    return maintain.with_missing_columns(once, later)


@query
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change of a file, by its type and user."""
    places = {"click": ".git/HEAD", "view": ".git/objects/a1", "purchase": "node_modules/x.js"}
    path = F.concat(F.lit("src/"), B.file_of(F.col("user_id")))
    for kind, place in places.items():
        path = F.when(F.col("event_type") == kind, F.lit(place)).otherwise(path)
    events = B.table(spark, sf_dir, "events").select("event_id", path.alias("path"), F.element_at(F.array(*[F.lit(k) for k in (*changes.KINDS, "access")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("kind"), "ts")
    return changes.routed_events(events).select("event_id", "path", "kind", "route")


@query
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests, their files and commits from the payloads that each turn makes."""
    rows = B.turns(spark, sf_dir)
    at = F.concat(F.lit("t"), F.col("turn").cast("string"))
    merged = F.when(F.col("role") == "assistant", at)
    request = F.struct(F.col("conv_id").alias("number"), F.col("text").alias("title"), merged.alias("merged_at"), F.struct(F.col("role").alias("login")).alias("user"))
    file = F.struct(F.concat(F.lit("f/"), at).alias("filename"), F.lit("added").alias("status"), F.col("turn").alias("additions"), merged.alias("patch"))
    commit = F.struct(at.alias("sha"), F.struct(F.col("text").alias("message"), F.struct(F.col("role").alias("name"), merged.alias("date")).alias("author")).alias("commit"))
    made = rows.select(F.col("conv_id").alias("pr_number"), *[F.to_json(F.array(x)).alias(n) for n, x in (("request", request), ("file", file), ("commit", commit))])
    shown = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[F.expr(x).cast("string").alias(f"c{i}") for i, x in enumerate(c)])
    return (
        shown(payloads.pull_requests(made, "request"), "request", "number", "title", "merged", "author", "merged_at")
        .unionByName(shown(payloads.pr_files(made, "file"), "file", "pr_number", "path", "additions", "deletions", "patch"))
        .unionByName(shown(payloads.pr_commits(made, "commit"), "commit", "pr_number", "sha", "message", "authored_at", "ordinal"))
    )


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, for it may be a file or a folder


@query
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by batches of a stream."""
    base, paths = scratch_path(spark, "stream"), []

    def write(df: DataFrame) -> None:
        paths.append(f"{base}/state-{len(paths)}")
        df.write.parquet(paths[-1])

    step = changes.state_writer(lambda: spark.read.parquet(paths[-1]) if paths else None, write, "user_id", "event_id")
    events = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(paths[-1])


@query
def stream_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type from a watermarked stream."""
    base, paths = scratch_path(spark, "stream"), []

    def write(df: DataFrame, _: int) -> None:
        paths.append(f"{base}/counts-{len(paths)}")
        df.write.parquet(paths[-1])

    events = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    counts = changes.change_counts(events, width="1 day").withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).select("day", "kind", "n")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(paths[-1]).groupBy("day", "kind").agg(F.sum("n").alias("n"))
