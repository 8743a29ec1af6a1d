import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, quality, shards, winnow, words

from . import brute
from .fixtures import as_parquet, frame, hard_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return as_parquet(spark, tmp_path_factory.mktemp("docs"))


def test_word_codes():
    texts = [b"", b"  ", b"A a\x00 b\xc3\xa9", b"x" * 700_000 + b" y", b"y \x0b x"]
    for lower in (False, True):
        codes, counts = words.WordCodes(lower).codes(texts)
        expected = [w.lower() if lower else w for t in texts for w in t.split()]
        assert counts.tolist() == [len(t.split()) for t in texts]
        seen = {}
        assert all(seen.setdefault(w, c) == c for w, c in zip(expected, codes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("limit", [winnow.BROADCAST_WINDOWS, 10, 0])
def test_decontamination(spark, docs, limit):
    rows = hard_rows()
    long = brute.alnum_words(rows[-7][1] or rows[13][1])
    items = [(1, " ".join(brute.alnum_words(rows[8][1])[5:40])), (2, "Two words"), (3, None), (4, "..."), (5, " ".join(brute.alnum_words(rows[20][1])[:10])), (None, "negative id"), (2, "loop loop loop"), (10, " ".join(long[3:15])), (6, "x " * 12), ("\0null", "w1 w2"), ("i" * 10_000, " ".join(long[30:45]))]
    items = [(None if i is None else str(i), x) for i, x in items]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = winnow.decontaminate(docs, benchmark, broadcast_windows=limit)
    mine = [(r.doc_id, r.n_words, sum(s["last"] - s["first"] for s in r["spans"]), tuple(r["items"])) for r in found.collect()]
    assert ordered(mine) == ordered(brute.contamination(rows, items))
    assert winnow.decontaminate(docs, benchmark.limit(0), broadcast_windows=limit).where("size(spans) > 0").count() == 0
    assert winnow.decontaminate(frame(spark, []), benchmark, broadcast_windows=limit).count() == 0


def test_every_shared_span_has_a_fingerprint():
    rng, coder = random.Random(1), words.Coder()
    for _ in range(200):
        shared = [f"{rng.randrange(4)}".encode() for _ in range(10)]
        pair = []
        for _ in range(2):
            codes = coder.codes([b"x%d" % rng.randrange(9) for _ in range(rng.randrange(20))] + shared + [b"y"] * rng.randrange(9))
            at = winnow.fingerprints(codes, 10, 5)
            pair.append(set(words.window_hashes(codes, 5)[at].tolist()))
        assert pair[0] & pair[1]


def test_bpe_on_hard_rows(spark, docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    encode = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    found = bpe.encode_decode(docs, VOCABULARY, lexicon_words=50).collect()
    assert ordered((r.doc_id, r["ids"], r.decoded) for r in found) == ordered((d, encode(t), t or "") for d, t in hard_rows())
    assert bpe.encode_decode(frame(spark, []), VOCABULARY).count() == 0


def test_bpe_against_the_library():
    vocabulary, tokenizer = bpe.Vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    known = [b"the", b" the", b" there", b"ing", b"\n", b" \xc3\xa9t\xc3\xa9"]
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon((w, vocabulary.merged(w)) for w in known), np.int64))
    assert lexicon.places(sorted(known) + [b"th", b"", b"thex"]).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1]
    encoder, rng = bpe.Encoder(vocabulary, lexicon), random.Random(2)
    texts = ["".join(rng.choice(" '’sltrvedmabXé1½\n\t!?.-漢 ") for _ in range(rng.randrange(40))) for _ in range(3_000)]
    texts += ["a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|>", "a" * 4_000, "it's 'sabc ''s\n's 'll'l", "\U0001f600‍ x", "aaaa aaaaaaa"]
    sizes, ids = encoder.encode(texts)
    mine = np.split(ids, np.cumsum(sizes)[:-1])
    for text, own in zip(texts, mine, strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(own.tolist(), vocabulary.bytes_of) == text
    assert bpe.Lexicon(np.frombuffer(bpe.compile_lexicon([]), np.int64)).places([b"a"]).tolist() == [-1]


def test_suffixes_are_shared():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    many = [p + s for p in (b"read", b"work", b"play") for s in (b"ing", b"ed", b"er")]
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon((w, vocabulary.merged(w)) for w in many), np.int64))
    assert len(lexicon.final) < sum(map(len, many)) / 2 and lexicon.places(sorted(many)).tolist() == list(range(9))


def test_quality_reads_long_words_whole():
    head, features = "漢字を読む、", quality.Features()
    first, second = (features.of((head * 20 + tail * 20).encode()).tolist() for tail in ("abc 123! ".replace(" ", ""), "仮名。"))
    assert min(len(first), len(second)) > 10 and len(set(first) & set(second)) > 5
    assert len(set(first) - set(second)) > 5 and len(set(second) - set(first)) > 5
    assert all(len(p) <= quality.LONG for p in quality._PIECE.findall(("é漢x😀" * 50).encode()))
    assert b"".join(quality._PIECE.findall(("é漢x😀" * 50).encode())).decode() == "é漢x😀" * 50


def test_quality_learns_and_is_held_out(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = " ".join(f"word{rng.randrange(300)}" + ("" if good else rng.choice(["$$$", "###"])) for _ in range(40))
        rows.append((i, text))
        labels.append((i, int(good) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not good)))
    rows += [(None, "x"), (1_000, None), (1_001, ""), (5, rows[5][1])]
    labels += [(7, 1 - labels[7][1]), (None, 1), (9, None)]
    docs = as_parquet(spark, tmp_path, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.score(docs, quality.train(docs, table)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert {r.doc_id for r in found if r.held_out} == {i for i in range(1_002) if i in dict(rows) and zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.predicted == int(r.doc_id % 4 > 0) for r in found if r.held_out and r.doc_id < 400]
    assert sum(right) / len(right) > 0.97
    none = quality.score(docs, quality.train(docs, table.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.score(frame(spark, []), quality.train(docs, table)).count() == 0


def test_hinge_loss_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10) + 50 * (i % 2)).astype(np.int32) for i in range(60)]
    good = np.arange(60) % 2 == 0
    ratios = quality.log_count_ratios(rows, good, 128)
    weights, bias = quality.dual_coordinate_descent(rows, good, ratios)
    margins = np.array([(weights * ratios)[x].sum() / len(x) ** 0.5 + bias for x in rows])
    assert ((margins > 0) == good).all()
    packed = [quality.packed(x, 128) for x in (np.array([1, 2], np.int32), np.arange(100, dtype=np.int32))]
    assert [quality.unpacked(p, 128).tolist() for p in packed] == [[1, 2], list(range(100))] and max(map(len, packed)) <= 16


def test_features_against_plain_sets():
    """Distinct words, pairs of words, shapes, pairs and triples of shapes; a bucket for each."""
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choice(["one", "Two", "x1", "!!!!", "one", "É"]) for _ in range(rng.randrange(12)))
        words_, shapes = text.split(), [quality.shape(w.encode()) for w in text.split()]
        shapes = [b"again" if k and w == words_[k - 1] else s for k, (w, s) in enumerate(zip(words_, shapes, strict=True))]
        plain = {("w", *words_[i : i + n]) for n in (1, 2) for i in range(len(words_) - n + 1)} | {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
        assert abs(len(quality.Features().of(text.encode())) - len(plain)) <= 1  # two may share a bucket


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objective of the hinge-loss model agree, so no other weights are better."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    good = np.array([x.min() % 2 == 0 for x in rows])
    ratios = quality.log_count_ratios(rows, good, 30)
    counts = [[1 + sum(i in set(x.tolist()) for x, y in zip(rows, good, strict=True) if y == side) for i in range(30)] for side in (True, False)]
    assert np.allclose(ratios, [np.log(a / sum(counts[0])) - np.log(b / sum(counts[1])) for a, b in zip(*counts, strict=True)])
    weights, bias = quality.dual_coordinate_descent(rows, good, ratios, rounds=5_000, tolerance=1e-9)
    x = np.zeros((60, 31))
    for i, row in enumerate(rows):
        x[i, row], x[i, 30] = ratios[row] / len(row) ** 0.5, 1
    y, w = np.where(good, 1.0, -1.0), np.append(weights, bias)
    cost = np.where(good, 60 / (2 * good.sum()), 60 / (2 * (~good).sum()))
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = objective(w)
    assert all(best <= objective(w + step) + 1e-6 for step in rng.normal(0, 0.05, (500, 31)))


def test_shards(spark, docs):
    found = shards.shard(docs).collect()
    sizes = {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in hard_rows()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in found} == sizes and len(found) == len(hard_rows())
    for s in {r["shard"] for r in found}:
        assert sorted(r.slot for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert all(r.grown_shard in (r["shard"], 16) and 0 <= r["shard"] < 16 for r in found)
    assert len({(r.doc_id, r["shard"]) for r in found}) == len({r.doc_id for r in found})
    assert shards.shard(frame(spark, [])).count() == 0


def test_slots_of_repeated_rows(spark, tmp_path):
    """A hundred thousand rows of one id and text are numbered in pieces."""
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(3_000).select("id", F.concat(F.lit("t"), "id")).toDF("doc_id", "text"))
    rows.repartition(5).write.parquet(f"{tmp_path}/documents")
    found = shards.shard(spark.read.parquet(f"{tmp_path}/documents"))
    wrong = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("l")).where("n <> d or m <> n - 1 or l <> 0")
    assert wrong.count() == 0 and found.count() == 103_000
    same = found.where("doc_id = 7 and size = 5").agg(F.count("*"), F.max("slot") - F.min("slot")).first()
    assert same[0] == 100_000 and same[1] == 99_999
    assert shards.digits_for(1 << 28, 16) == 2 and shards.digits_for((1 << 28) + 1, 16) == 3


def test_weights_of_shards(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    counts = {r["s"]: r["n"] for r in keys.groupBy(shards.rendezvous(F.col("k"), (1.0, 3.0, 0.0)).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    with pytest.raises(ValueError):
        shards.rendezvous(F.col("k"), (0.0,))
