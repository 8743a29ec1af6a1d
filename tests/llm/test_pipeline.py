import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import queries

from ..compare import assert_same
from . import brute
from .fixtures import frame, hard_rows, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.ORACLE_SQL[name], FOLDER)


def test_jaccard_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(r[:] for r in queries.op1_jaccard(spark, FOLDER).collect()) == sorted(brute.jaccard(rows))


def test_bpe_query_matches_the_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, FOLDER).collect():
        ids = tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(rows[r.doc_id]))


def folder_of(spark, tmp_path, rows, labels, items):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    good = [(i, words(rng, 60, 5_000)) for i in range(120)]
    bad = [(1_000 + i, " ".join(w + "$$$" for w in words(rng, 60, 5_000).split())) for i in range(60)]
    near = [(2_000 + i, " ".join([*good[i][1].split()[:59], "other"])) for i in range(5)]
    copies = [(3_000 + i, good[i][1].replace(" ", "\n")) for i in range(5, 10)] + [good[3]]
    leak = words(rng, 12, 5_000)
    leaks = [(4_000, words(rng, 30, 5_000) + " " + leak + " " + words(rng, 30, 5_000))]
    rows = good + bad + near + copies + leaks
    labels = [(d, 1, 0) for d, _ in good[:100]] + [(d, 0, 0) for d, _ in bad[:50]]
    folder = folder_of(spark, tmp_path, rows, labels, [(1, leak.upper())])
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    clean = [r for r in rows if r[0] < 1_000 or r[0] >= 2_000]  # the classes separate
    keep = {}
    for d, t in clean:
        k = "".join(brute.space_words(t))
        keep[k] = min(keep.get(k, (0, 1 << 60, "")), (-len(t), d, t))
    unique = [(d, t) for _, d, t in keep.values()]
    left = {d: dict(unique)[d] for d, n, c in brute.jaccard(unique) if d == c or not n}
    left = {d: left[d] for d, _, hit, _ in brute.contamination(list(left.items()), [(1, leak)]) if not hit}
    assert set(found) == set(left)
    assert all(found[d].decoded == t for d, t in left.items())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows(spark, tmp_path, name):
    folder = folder_of(spark, tmp_path, hard_rows(), [(1, 1, None), (2, 0, 0), (None, 1, 1), (3, 1, 0), (4, 0, 0)], [(1, None), (None, "negative id")])
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    assert stage(spark, docs.limit(0), folder).count() == 0
