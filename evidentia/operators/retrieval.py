"""Retrieval for a whole table of queries: BM25, hashed n-gram vectors, fusion, and evidence packets.

Every operator takes queries (query_id, text); limits are row numbers within a
query. Deliberate differences to a one-query engine: exact document lengths,
query text as a bag of terms, double precision, a given time instead of the
clock, and ties in order of the path.

Vectors are compared in blocks: up to BLOCK vectors are one row with a matrix, so
are up to BLOCK queries, and a pair of blocks is one matrix product of which the
best rows of each query stay. No pair of single rows is ever a row. BM25 does the
same with sparse blocks of the asked terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import bounded_batches, saved
from .tables import top

#: BM25's k1 and b, candidates of either list, decimals of compared scores.
K1, B, CANDIDATES, DECIMALS = 1.2, 0.75, 50, 6

#: Score of a substring symbol match, rows beyond top_k, factor for tests where the query isn't about them.
SUBSTRING_SCORE, EXTRA, TEST_FACTOR = 1.5, 3, 0.8

#: Rows (query, term) up to which BM25 sends them to all documents; terms have MAX_TOKEN_BYTES at most.
ASKED_ROWS = 1 << 17

#: Asked terms up to which documents are met in blocks; products of a block added up at once; blocks of queries that a task meets, whose best scores it remembers.
VOCABULARY, AT_ONCE, REMEMBERED = 1 << 20, 1 << 21, 32

#: Vectors of a block; characters of a file that a packet shows without a chunk.
BLOCK, PREVIEW = 1_024, 400


@dataclass(frozen=True)
class Weights:
    """How signals add up."""

    bm25: float = 1.0
    vector: float = 1.2
    symbol_exact: float = 1.5
    path_match: float = 0.6
    test_bonus_for_tests_query: float = 0.5
    doc_file_penalty: float = 0.6
    changelog_penalty: float = 0.35
    recency_boost: float = 0.4
    recency_halflife_days: float = 90.0


def postings(docs: DataFrame, *fields: str, wanted: DataFrame | None = None) -> DataFrame:
    """(field, doc, term, tf, len) of the text columns ``fields`` of docs (doc, ...); with ``wanted`` (term), of those terms only."""
    out = None
    for field in fields or ("body",):
        tokens = docs.select("doc", F.lit(field).alias("field"), T.index_tokens(F.col(field)).alias("tokens"))
        rows = tokens.select("field", "doc", F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term"))
        rows = rows if wanted is None else rows.join(wanted, "term", "left_semi")  # before the shuffle
        rows = rows.groupBy("field", "doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
        out = rows if out is None else out.unionByName(rows)
    return out


def term_stats(index: DataFrame) -> DataFrame:
    """(field, term, df, cf): documents and places of each term."""
    return index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def field_stats(docs: DataFrame, *fields: str) -> DataFrame:
    """(field, n_docs, avg_len) over all documents, those without tokens included, in one pass."""
    fields = fields or ("body",)
    sizes = [F.avg(F.coalesce(T.index_token_count(F.col(f)), F.lit(0))).alias(f"len_{i}") for i, f in enumerate(fields)]
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), *sizes)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"len_{i}").alias("avg_len")) for i, f in enumerate(fields)])
    return one.select("n_docs", F.explode(each).alias("x")).select("x.field", "n_docs", "x.avg_len")


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """(query_id, doc, score, rank): the ``k`` best documents by the sum over query terms and fields; a repeated term counts each time."""
    asked = asked_terms(queries)
    blocks = lexical_blocks(docs, asked, fields)
    return _bm25_by_rows(docs, asked, k, fields) if blocks is None else blocks.best(k)


def bm25_and_matched(docs: DataFrame, queries: DataFrame, k: int, value: str, fields: tuple[str, ...] = ("body",)) -> tuple[DataFrame, DataFrame]:
    """``bm25``, and (query_id, value): the sum of a column over all documents with any term of a query."""
    asked = asked_terms(queries)
    blocks = lexical_blocks(docs, asked, fields, value)
    if blocks is not None:
        return blocks.best(k), blocks.matched()
    hits = asked.join(postings(docs, *fields, wanted=asked.select("term").distinct()).select("term", "doc"), "term").select("query_id", "doc").distinct()
    return _bm25_by_rows(docs, asked, k, fields), hits.join(docs.select("doc", F.col(value).alias("value")), "doc").groupBy("query_id").agg(F.sum("value").alias("value"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times), stored."""
    terms = queries.select("query_id", F.explode(T.index_tokens(F.col("text"))).alias("term"))
    return saved(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")


@dataclass(frozen=True)
class LexicalBlocks:
    """Blocks of documents (ids, value, rows, codes, weights) and of queries (query_ids, q_rows, q_codes, q_times, q_block)."""

    docs: DataFrame
    queries: DataFrame
    doc_type: str
    query_type: str

    def best(self, k: int) -> DataFrame:
        """(query_id, doc, score, rank) of the ``k`` best documents."""

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
            for one in _each(batches):
                ids, q_ids, scores = one["ids"].values, one["query_ids"].values, _lexical_scores(one)
                ranked = np.where(scores > 0, np.floor(scores * 10**DECIMALS + 0.5), -np.inf)
                rows, cols = _best_rows(ranked, k, held, one["q_block"].as_py())
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(cols)), ids.take(pa.array(rows)), pa.array(scores[rows, cols])], names=["query_id", "doc", "score"])

        found = self.docs.crossJoin(self.queries).mapInArrow(scored, f"query_id {self.query_type}, doc {self.doc_type}, score double")
        return top(found.withColumn("score", F.round("score", DECIMALS)), k, ["query_id"], [F.desc("score"), F.col("doc")])

    def matched(self) -> DataFrame:
        """(query_id, value): the sum of ``value`` over the documents with any term of the query; queries without any are left out."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in _each(batches):
                hit = _lexical_scores(one) > 0
                value = one["value"].values
                known = pc.is_valid(value).to_numpy(zero_copy_only=False)
                sums = pc.fill_null(value, 0).to_numpy(zero_copy_only=False).astype(np.int64) @ hit
                met = hit.any(0).nonzero()[0]
                yield pa.RecordBatch.from_arrays([one["query_ids"].values.take(pa.array(met)), pa.array(sums[met]), pa.array((known @ hit.astype(np.int64))[met])], names=["query_id", "value", "known"])

        found = self.docs.crossJoin(self.queries).mapInArrow(summed, f"query_id {self.query_type}, value long, known long")
        return found.groupBy("query_id").agg(F.when(F.sum("known") > 0, F.sum("value")).alias("value"))


def lexical_blocks(docs: DataFrame, asked: DataFrame, fields: tuple[str, ...], value: str | None = None) -> LexicalBlocks | None:
    """Documents and queries in blocks, with BM25's weights; None where ids of documents repeat or are null, or with over VOCABULARY asked terms.

    A document's asked terms are counted within its own row, so neither terms nor
    pairs of terms are ever rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    terms = [r.term for r in asked.select("term").distinct().limit(VOCABULARY + 1).collect()]
    if len(terms) > VOCABULARY:
        return None
    sent, n_terms, n = spark.sparkContext.broadcast(terms), len(terms), len(fields)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            lists = []
            for i in range(n):
                tokens = batch.column(f"tokens_{i}")
                codes = pc.index_in(pc.list_flatten(tokens), value_set=known).to_numpy(zero_copy_only=False)
                rows = pc.list_parent_indices(tokens).to_numpy()[~np.isnan(codes)]
                places, times = np.unique(rows.astype(np.int64) * n_terms + codes[~np.isnan(codes)].astype(np.int64), return_counts=True)
                ends = pa.array(np.searchsorted(places, np.arange(len(batch) + 1) * n_terms), pa.int32())
                lists += [batch.column(f"len_{i}"), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (places % max(n_terms, 1), times))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("value"), *lists], names=names)

    names = ["doc", "value", *(f"{x}_{i}" for i in range(n) for x in ("len", "codes", "times"))]
    tokens = [T.index_tokens(F.col(f)) for f in fields]
    rows = docs.select("doc", (F.lit(None) if value is None else F.col(value)).cast("long").alias("value"), *[x.alias(f"tokens_{i}") for i, x in enumerate(tokens)], *[F.coalesce(F.size(x), F.lit(0)).cast("long").alias(f"len_{i}") for i, x in enumerate(tokens)])
    kind = dict(docs.dtypes)["doc"]
    counts = saved(rows.mapInArrow(counted, f"doc {kind}, value long, " + ", ".join(f"len_{i} long, codes_{i} array<int>, times_{i} array<int>" for i in range(n))), "counts")
    sizes = counts.agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("doc").alias("ids"), *[F.avg(f"len_{i}").alias(f"len_{i}") for i in range(n)]).first()
    if sizes.docs != sizes.ids:
        return None
    rarity = np.zeros((n, n_terms))
    for i in range(n):
        for code, df in counts.select(F.explode(f"codes_{i}").alias("code")).groupBy("code").count().collect():
            rarity[i, code] = np.log(1 + (sizes.docs - df + 0.5) / (df + 0.5))
    rarities, average = spark.sparkContext.broadcast(rarity), [sizes[f"len_{i}"] or 1.0 for i in range(n)]

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            some = some.take(pc.sort_indices(some.column("doc")))
            places, adds = [], []
            for i in range(n):
                codes = pc.list_flatten(some.column(f"codes_{i}")).to_numpy()
                rows = pc.list_parent_indices(some.column(f"codes_{i}")).to_numpy().astype(np.int64)
                tf = pc.list_flatten(some.column(f"times_{i}")).to_numpy().astype(np.float64)
                size = some.column(f"len_{i}").to_numpy()[rows]
                places.append(codes.astype(np.int64) * len(some) + rows)
                adds.append(rarities.value[i][codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average[i])))
            place, back = np.unique(np.concatenate(places), return_inverse=True)
            weights = np.bincount(back, np.concatenate(adds), len(place))
            parts = [(place % len(some)).astype(np.int32), (place // len(some)).astype(np.int32), weights]
            yield pa.RecordBatch.from_arrays([*(_one_list(some.column(x)) for x in ("doc", "value")), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["ids", "value", "rows", "codes", "weights"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for some in _slices(batches):
            rows = pc.list_parent_indices(some.column("terms")).to_numpy().astype(np.int32)
            codes = pc.index_in(pc.list_flatten(some.column("terms")), value_set=known).to_numpy().astype(np.int32)
            times = pc.list_flatten(some.column("times")).to_numpy().astype(np.float64)
            order = np.argsort(codes, kind="stable")
            yield pa.RecordBatch.from_arrays([_one_list(some.column("query_id")), *(pa.array([x[order].tobytes()], pa.binary()) for x in (rows, codes, times))], names=["query_ids", "q_rows", "q_codes", "q_times"])

    query_kind = dict(asked.dtypes)["query_id"]
    made = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("x")).select("query_id", F.col("x.term").alias("terms"), F.col("x.times").alias("times"))
    made = _few(made, asked.select("query_id").distinct().count()).mapInArrow(gathered, f"query_ids array<{query_kind}>, q_rows binary, q_codes binary, q_times binary").withColumn("q_block", F.monotonically_increasing_id())
    return LexicalBlocks(counts.mapInArrow(weighted, f"ids array<{kind}>, value array<long>, rows binary, codes binary, weights binary"), made, kind, query_kind)


def _few(queries: DataFrame, count: int) -> DataFrame:
    """Queries in so few partitions that their blocks are full, and units are made again for every REMEMBERED blocks only."""
    return queries.coalesce(max(1, -(-count // (BLOCK * REMEMBERED))))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            yield batch.slice(at, BLOCK)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for row in range(len(batch)):
            yield {n: batch.column(n)[row] for n in batch.schema.names}


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.concat_arrays([values]))


def _lexical_scores(one: dict[str, pa.Scalar]) -> np.ndarray:
    """The scores (document, query) of a pair of blocks: terms of many products by a matrix product, the others product by product, AT_ONCE of them or one term's."""
    n_docs, n_queries = len(one["ids"].values), len(one["query_ids"].values)
    read = lambda name, kind: np.frombuffer(one[name].as_py(), kind)
    rows, codes, weights = read("rows", np.int32), read("codes", np.int32), read("weights", np.float64)
    q_rows, q_codes, q_times = read("q_rows", np.int32), read("q_codes", np.int32), read("q_times", np.float64)
    both = np.intersect1d(codes, q_codes)
    at, q_at = np.searchsorted(codes, both), np.searchsorted(q_codes, both)
    many, q_many = np.searchsorted(codes, both, "right") - at, np.searchsorted(q_codes, both, "right") - q_at

    def entries(chosen: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the chosen terms, and which of these terms each has."""
        c = counts[chosen]
        term = np.repeat(np.arange(len(chosen)), c)
        return np.arange(len(term)) + (starts[chosen] - (np.cumsum(c) - c))[term], term

    products = many * q_many
    dense = products * 150 > n_docs * n_queries
    out = np.zeros((n_docs, n_queries))
    heavy = np.flatnonzero(dense)
    for i in range(0, len(heavy), BLOCK):
        some = heavy[i : i + BLOCK]
        left, right = np.zeros((n_docs, len(some))), np.zeros((len(some), n_queries))
        place, term = entries(some, at, many)
        left[rows[place], term] = weights[place]
        place, term = entries(some, q_at, q_many)
        right[term, q_rows[place]] = q_times[place]
        out += left @ right
    light = np.flatnonzero(~dense)
    total = np.cumsum(products[light])
    while len(light):
        n = max(1, int(np.searchsorted(total, AT_ONCE, "right")))
        some, light, total = light[:n], light[n:], total[n:] - total[n - 1]
        place, term = entries(some, at, many)
        c = q_many[some][term]
        q_place = np.arange(c.sum()) + np.repeat(q_at[some][term] - (np.cumsum(c) - c), c)
        place = np.repeat(place, c)
        out += np.bincount(rows[place].astype(np.int64) * n_queries + q_rows[q_place], weights[place] * q_times[q_place], n_docs * n_queries).reshape(out.shape)
    return out


def _best_rows(scores: np.ndarray, k: int, held: dict[int, tuple[np.ndarray, np.ndarray | None]], block: int, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) of scores (row, query), -inf being none: of each query those among its ``k`` best of the block, ties in order of rows, that reach the ``k``-th best of what this task has seen.

    ``held`` has the best scores by block of queries; ``names`` tells rows that may
    come again, which count once (equal numbers for different rows only let more rows through).
    """
    size, n_queries = scores.shape
    best, of = scores, None if names is None else np.repeat(names[:, None], n_queries, 1)
    if size > k:
        taken = np.argpartition(scores, size - k, 0)[size - k :]
        best = np.take_along_axis(scores, taken, 0)
        of = None if names is None else names[taken]
    if block in held:
        best = np.concatenate((held[block][0], best))
        if of is not None:
            of = np.concatenate((held[block][1], of))
            order = np.lexsort((-best, of), 0)
            best, of = np.take_along_axis(best, order, 0), np.take_along_axis(of, order, 0)
            best[1:][of[1:] == of[:-1]] = -np.inf
        if len(best) > k:
            taken = np.argpartition(best, len(best) - k, 0)[len(best) - k :]
            best = np.take_along_axis(best, taken, 0)
            of = None if of is None else np.take_along_axis(of, taken, 0)
    elif len(held) >= REMEMBERED:
        held.pop(next(iter(held)))
    held[block] = (best, of)
    least = best.min(0) if len(best) >= k else np.full(n_queries, -np.inf)
    rows, cols = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((rows, -scores[rows, cols], cols))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(cols)) - np.searchsorted(cols, cols) < k
    return rows[kept], cols[kept]


def _bm25_by_rows(docs: DataFrame, asked: DataFrame, k: int, fields: tuple[str, ...]) -> DataFrame:
    """``bm25`` where ids of documents repeat or asked terms are too many to be sent."""
    few = asked.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS
    sent = F.broadcast if few else lambda df: df
    index = postings(docs, *fields, wanted=sent(asked.select("term").distinct()))
    terms = term_stats(index)  # no more of them than asked terms in each field
    rows = index.join(sent(terms), ["field", "term"]).join(field_stats(docs, *fields), "field")
    tf = F.col("tf").cast("double")
    weight = idf(F.col("df"), F.col("n_docs")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weights = rows.select("term", "doc", weight.alias("weight"))
    weights = weights.repartition("doc") if few else weights  # a document's sums are made where its weights are: (query, doc, term) is never shuffled
    scored = weights.join(sent(asked), "term").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("weight") * F.col("times")), DECIMALS).alias("score"))
    return top(scored, k, ["query_id"], [F.desc("score"), F.col("doc")])


def _feature_buckets(token: str) -> tuple[list[int], list[float]]:
    features = [token, *(token[i : i + 3] for i in range(len(token) - 2))]
    out = []
    for feature in features:
        h = 293  # the low nine bits of FNV-1a, which decide alone
        for x in feature.encode():
            h = (h ^ x) * 435 % T.DIM
        out.append(h)
    return out, [2.0] + [1.0] * (len(out) - 1)


def hashed_arrays(texts: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, vector): each token adds 2 to its bucket of T.DIM, each of its trigrams 1; the vector has length 1, or is 0 without tokens.

    A text's features are hashed and added up within its own row.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], list[float]]] = {}
        for batch in _slices(batches):
            out = np.zeros((len(batch), T.DIM))
            for row, words in enumerate(batch.column("tokens")):
                places, adds = [], []
                for word in words.as_py() or ():
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = _feature_buckets(word)
                    a, b = known[word]
                    places += a
                    adds += b
                if places:
                    out[row] = np.bincount(places, adds, T.DIM)
                    out[row] /= np.sqrt(out[row] @ out[row])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * T.DIM, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], names=[*keys, "vector"])

    bounded_batches(texts.sparkSession)
    rows = texts.select(*keys, tokens.alias("tokens"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(made, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", vector array<double>")


def hashed_vectors(texts: DataFrame, tokens: Column, key: str = "doc") -> DataFrame:
    """(key, bucket, weight): the buckets of ``hashed_arrays`` that are not 0."""
    return hashed_arrays(texts, tokens, key).select(key, F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0")


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows (names, vector) as blocks: ``ids``, a struct of lists, and ``matrix``, their vectors as doubles one after another."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            vectors = pc.list_flatten(some.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(_one_list(some.column(n)) for n in names), pa.array([vectors.tobytes()], pa.binary())], names=[*names, "matrix"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "vector").mapInArrow(packed, ", ".join(f"`{n}` array<{kinds[n]}>" for n in names) + ", matrix binary")


def nearest(units: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, grp, score, best): of units (grp, id, vector) the greatest dot product of each group with a query (query_id, vector), and the least id that has it.

    The ``k`` groups of the greatest scores for each query, ties in order of grp;
    all groups without ``k``. Of a pair of blocks only its own ``k`` best stay, and
    of them those that reach the ``k`` best groups of the blocks before in the same
    task: a group among the best of all is among those of the block that holds its best.
    """
    bounded_batches(units.sparkSession)
    kinds, asked = dict(units.dtypes), dict(queries.dtypes)["query_id"]
    queries = saved(queries.select("query_id", "vector"), "query-vectors")
    pairs = _packed(units, ["grp", "id"]).crossJoin(_packed(_few(queries, queries.count()), ["query_id"]).withColumnRenamed("matrix", "q_matrix").withColumn("q_block", F.monotonically_increasing_id()))  # blocks against blocks

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
        for one in _each(batches):
            table = pa.table({"grp": one["grp"].values, "id": one["id"].values})
            order = pc.sort_indices(table, [("grp", "ascending"), ("id", "ascending")])
            table = table.take(order)
            q_ids = one["query_id"].values
            v = np.frombuffer(one["matrix"].as_py()).reshape(len(table), -1)[order.to_numpy()]
            q = np.frombuffer(one["q_matrix"].as_py()).reshape(len(q_ids), -1)
            scores = np.floor(v @ q.T * 10**DECIMALS + 0.5)
            names = table.column("grp").combine_chunks()
            code = pc.rank(names, tiebreaker="dense").to_numpy() if len(names) else np.empty(0)
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            pooled = np.maximum.reduceat(scores, first, 0)
            if k is None or k >= len(first):
                group, query = (x.ravel() for x in np.indices(pooled.shape))
            else:
                codes = np.array([hash(x) for x in names.take(pa.array(first)).to_pylist()], np.int64)
                group, query = _best_rows(pooled, k, held, one["q_block"].as_py(), codes)
            last = np.append(first[1:], len(table))
            if len(first) == len(table):
                best = first[group]
            else:
                best = np.array([a + scores[a:b, c].argmax() for a, b, c in zip(first[group].tolist(), last[group].tolist(), query.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([q_ids]).take(pa.array(query)), names.take(pa.array(best)), pa.array(scores[best, query] / 10**DECIMALS), table.column("id").combine_chunks().take(pa.array(best))],
                names=["query_id", "grp", "score", "best"],
            )

    found = pairs.mapInArrow(scored, f"query_id {asked}, grp {kinds['grp']}, score double, best {kinds['id']}")
    pooled = found.groupBy("query_id", "grp").agg(F.min(F.struct((-F.col("score")).alias("order"), F.col("best"))).alias("x"))
    pooled = pooled.select("query_id", "grp", F.round(-F.col("x.order"), DECIMALS).alias("score"), F.col("x.best").alias("best"))
    return pooled if k is None else top(pooled, k, ["query_id"], [F.desc("score"), F.col("grp")]).drop("rank")


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, but_itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` vectors (id, vector) nearest to each query (query_id, vector), without the query's own id on demand."""
    found = nearest(vectors.select(F.col("id").alias("grp"), "id", "vector"), queries.select("query_id", "vector"), k + but_itself).select("query_id", F.col("grp").alias("id"), "score")
    found = found.where("id <> query_id") if but_itself else found
    return top(found, k, ["query_id"], [F.desc("score"), F.col("id")])


def vector_search(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokens=T.code_tokens, text: str = "body", chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, best, rank) by cosine of hashed vectors; ``tokens`` makes tokens of a text column.

    Documents are compared by their best chunk of ``chunks`` (doc, chunk, text),
    ``best`` being the least number of one that has the score, or else by ``text``
    as one chunk 0. Documents with cosine 0 are ranked too.
    """
    units = docs.select("doc", F.lit(0).alias("chunk"), F.col(text).alias("text")) if chunks is None else chunks.select("doc", "chunk", "text")
    vectors = hashed_arrays(units, tokens(F.col("text")), "doc", "chunk").select(F.col("doc").alias("grp"), F.col("chunk").alias("id"), "vector")
    found = nearest(vectors, hashed_arrays(queries, tokens(F.col("text")), "query_id"), k).withColumnRenamed("grp", "doc")
    return top(found, k, ["query_id"], [F.desc("score"), F.col("doc")])


def normalised(ranked: DataFrame) -> DataFrame:
    """Scores of a list divided by its greatest (at least 1e-6)."""
    return ranked.withColumn("score", F.col("score") / F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-6)))


def fused(lexical: DataFrame, semantic: DataFrame, docs: DataFrame, queries: DataFrame, as_of: int, weights: Weights = Weights(), top_k: int = 8, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """(query_id, doc, path, score, signals, best, rank): both lists together with path, recency, test and document adjustments.

    docs: (doc, path, last_ts). What adds (path match, recency, a test where the
    query speaks of tests) comes before what multiplies (other tests, documents).
    Lists have CANDIDATES rows a query at most, so what is joined here is small.
    """
    best = F.col("best").cast("int") if "best" in semantic.columns else F.lit(None).cast("int")
    both = normalised(lexical).select("query_id", "doc", F.col("score").alias("b"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("int").alias("best")).unionByName(
        normalised(semantic).select("query_id", "doc", F.lit(None).cast("double").alias("b"), F.col("score").alias("v"), best.alias("best"))
    )
    both = both.groupBy("query_id", "doc").agg(F.max("b").alias("b"), F.max("v").alias("v"), F.max("best").alias("best"))
    asked = queries.select("query_id", T.query_tokens(F.col("text"), stopwords).alias("tokens"), F.lower("text").contains("test").alias("about_tests"))
    rows = both.join(docs.select("doc", "path", "last_ts"), "doc").join(asked, "query_id")
    path = F.col("path")
    on_path = F.exists("tokens", lambda t: F.lower(path).contains(t))
    recent = T.recency_boost(F.col("last_ts"), F.lit(as_of), weights.recency_boost, weights.recency_halflife_days)
    kind, test = P.doc_class(path), P.is_test(path)
    score = F.coalesce("b", F.lit(0.0)) * weights.bm25 + F.coalesce("v", F.lit(0.0)) * weights.vector + F.when(on_path, weights.path_match).otherwise(0.0) + recent
    score = F.when(test & F.col("about_tests"), score + weights.test_bonus_for_tests_query).when(test, score * TEST_FACTOR).otherwise(score)
    score = score * F.when(kind == "changelog", weights.changelog_penalty).when(kind == "doc", weights.doc_file_penalty).otherwise(1.0)
    signals = F.array_compact(
        F.array(
            F.when(F.col("b").isNotNull(), "bm25"), F.when(F.col("v").isNotNull(), "vector"), F.when(on_path, "path"), F.when(recent > 1e-4, "recent"),
            F.when(kind == "changelog", "changelog_demoted"), F.when(kind == "doc", "doc_demoted"),
        )
    )
    out = rows.select("query_id", "doc", "path", F.round(score, DECIMALS).alias("score"), signals.alias("signals"), "best")
    return top(out, top_k, ["query_id"], [F.desc("score"), F.col("path")])


def search(docs: DataFrame, queries: DataFrame, as_of: int, weights: Weights = Weights(), top_k: int = 8, chunks: DataFrame | None = None, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """``fused`` over docs (doc, path, body, last_ts): BM25 of path and body, vectors of the chunks (doc, chunk, text), without stopwords."""
    semantic = vector_search(docs, queries, tokens=lambda c: T.without_stopwords(T.code_tokens(c), stopwords), chunks=chunks)
    return fused(bm25(docs, queries, fields=("path", "body")), semantic, docs, queries, as_of, weights, top_k, stopwords)


def ranked(docs: DataFrame, queries: DataFrame, mode: str, k: int, as_of: int = 0, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, rank) by ``hybrid``, ``bm25``, ``vector`` or ``random`` (the FNV hash of query and path)."""
    if mode == "hybrid":
        found = search(docs, queries, as_of, top_k=k, chunks=chunks)
    elif mode == "bm25":
        found = bm25(docs, queries, k, fields=("path", "body"))
    elif mode == "vector":
        found = vector_search(docs, queries, k, lambda c: T.without_stopwords(T.code_tokens(c)), chunks=chunks)
    elif mode == "random":
        asked = queries.select("query_id", "text")
        found = docs.select("doc", "path").crossJoin(asked).withColumn("hash", T.fnv_hex(F.concat("text", "path")))  # a stated set of queries
        found = top(found, k, ["query_id"], [F.col("hash"), F.col("path")])
    else:
        raise ValueError(f"no such mode: {mode}")
    return found.select("query_id", "doc", "rank")


def symbols_exact(symbols: DataFrame, names: DataFrame, per_name: int = 5) -> DataFrame:
    """Symbols of the given names (query_id, seq, name), without case, ``per_name`` of each name in order of name, path and line."""
    asked = names.select("query_id", "seq", F.lower("name").alias("key"))
    hits = asked.join(symbols.withColumn("key", F.lower("name")), "key")
    return top(hits, per_name, ["query_id", "seq"], [F.col("name"), F.col("path"), F.col("start_line")])


def symbols_matching(symbols: DataFrame, tokens: DataFrame, per_token: int = 3) -> DataFrame:
    """Symbols whose name holds a token (query_id, seq, token), ``per_token`` of each in order of name, path and line.

    Distinct names are matched, so the substring join sees each name once.
    """
    names = symbols.select(F.lower("name").alias("key")).distinct()
    wanted = tokens.select(F.lower("token").alias("token")).distinct()
    pairs = names.join(wanted, F.col("key").contains(F.col("token")))
    hits = tokens.select("query_id", "seq", F.lower("token").alias("token")).join(pairs, "token").join(symbols.withColumn("key", F.lower("name")), "key")
    return top(hits, per_token, ["query_id", "seq"], [F.col("name"), F.col("path"), F.col("start_line")])


def packets(
    fused_rows: DataFrame, symbols: DataFrame, queries: DataFrame, weights: Weights = Weights(), top_k: int = 8,
    chunks: DataFrame | None = None, previews: DataFrame | None = None, stopwords: Sequence[str] = T.STOPWORDS,
) -> DataFrame:
    """Evidence packets (query_id, rank, type, path, symbol, title, snippet, score, signal) of fused rows and symbol matches.

    A fused row shows the chunk (doc, chunk, symbol, start_line, text) that its
    vector matched best, if that is a symbol's; else the first symbol of its file
    that a query token names, else its preview (path, preview). Exact symbols
    score above all of them, substring ones a fixed score; of a symbol's
    spellings only the first packet stays unless fused rows carry it.
    """
    if "signature" not in symbols.columns:
        symbols = symbols.withColumn("signature", F.lit(None).cast("string"))
    tokens = queries.select("query_id", F.posexplode(F.array_distinct(T.query_tokens(F.col("text"), stopwords))).alias("seq", "token"))
    names = queries.select("query_id", F.posexplode(T.query_identifiers(F.col("text"))).alias("seq", "name"))
    by_token = symbols_matching(symbols, tokens, 5)
    own = by_token.groupBy("query_id", "path").agg(F.min(F.struct("seq", "rank", F.col("name").alias("symbol"), "signature")).alias("own"))
    shown = fused_rows.join(own, ["query_id", "path"], "left")
    if chunks is not None and "best" in fused_rows.columns:
        chunks = chunks.join(fused_rows.select("doc").distinct(), "doc", "left_semi")  # before their texts are shuffled
        spans = chunks.where("symbol is not null").select("doc", F.col("chunk").alias("best"), F.struct(F.col("symbol"), "start_line", F.col("text")).alias("span"))
        shown = shown.join(spans, ["doc", "best"], "left")
    else:
        shown = shown.withColumn("span", F.lit(None).cast("struct<symbol:string,start_line:int,text:string>"))
    shown = shown.join(previews.join(fused_rows.select("path").distinct(), "path", "left_semi"), "path", "left") if previews is not None else shown.withColumn("preview", F.lit(None).cast("string"))
    symbol = F.coalesce("span.symbol", "own.symbol")
    title = F.when(F.col("span").isNotNull(), F.concat("span.symbol", F.lit(" in "), "path", F.lit(":"), F.col("span.start_line").cast("string"))).when(symbol.isNotNull(), F.concat(symbol, F.lit(" in "), "path")).otherwise(F.col("path"))
    first = shown.select(
        "query_id", F.lit(0).alias("stage"), F.col("rank").alias("seq"), "path", symbol.alias("symbol"), title.alias("title"),
        F.when(F.col("span").isNotNull(), F.col("span.text")).when(symbol.isNotNull(), F.col("own.signature")).otherwise(F.col("preview")).alias("snippet"),
        "score", F.array_join("signals", "+").alias("signal"), F.when(P.is_test(F.col("path")), "test").when(symbol.isNotNull(), "symbol").otherwise("existing_code").alias("type"),
    )
    of_symbol = [F.col("name").alias("symbol"), F.concat("name", F.lit(" in "), "path").alias("title"), F.col("signature").alias("snippet")]
    best = first.groupBy("query_id").agg(F.max("score").alias("top"))
    exact = symbols_exact(symbols, names, 5).join(best, "query_id", "left").select(
        "query_id", F.lit(1).alias("stage"), (F.col("seq") * 10 + F.col("rank")).alias("seq"), "path", *of_symbol,
        (F.coalesce("top", F.lit(0.0)) + weights.symbol_exact).alias("score"), F.lit("symbol_exact").alias("signal"), F.lit("symbol").alias("type"),
    )
    part = by_token.where("rank <= 3").select(
        "query_id", F.lit(2).alias("stage"), (F.col("seq") * 10 + F.col("rank")).alias("seq"), "path", *of_symbol,
        F.lit(SUBSTRING_SCORE).alias("score"), F.lit("symbol").alias("signal"), F.lit("symbol").alias("type"),
    )
    later = top(exact.unionByName(part), 1, ["query_id", "symbol"], [F.col("stage"), F.col("seq")], "copy").drop("copy")
    later = later.join(first.select("query_id", "symbol").where("symbol is not null").distinct(), ["query_id", "symbol"], "left_anti")
    every = first.unionByName(later).withColumn("score", F.round("score", DECIMALS))
    out = top(every, top_k + EXTRA, ["query_id"], [F.desc("score"), F.col("stage"), F.col("seq")])
    return out.select("query_id", "rank", "type", "path", "symbol", "title", "snippet", "score", "signal")
