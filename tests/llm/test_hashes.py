"""Periodic words and word sequences, which polynomial hashes modulo 2**64 take for equal."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, jaccard, recompression, words

from . import brute
from .fixtures import as_parquet

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


PAIRS = [("".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))) for n in (1_024, 2_048, 4_096)]


def ordered(rows):
    return sorted(rows, key=repr)


def test_word_codes_differ():
    for pair in PAIRS:
        codes, _ = words.WordCodes(False).codes([x.encode() for x in pair])
        assert codes[0] != codes[1]
        both, _ = words.WordCodes(False, seeds=(0, 1)).codes([pair[0].encode()])
        assert both.shape == (2, 1) and both[0] != both[1]


def test_short_words_have_codes_of_their_own():
    every = sorted({bytes(x) for n in range(1, 4) for x in np.ndindex(*[12] * n)} | {b"x" * n for n in range(1, 200)})
    data = b"".join(every)
    last = np.cumsum([len(x) for x in every])
    assert len(set(words.stretch_codes(data, last - [len(x) for x in every], last).tolist())) == len(every)


def test_jaccard(spark, tmp_path):
    rows = [(10 * k + i, f"one two three four {word} six") for k, pair in enumerate(PAIRS) for i, word in enumerate(pair)]
    found = jaccard.linked_components(as_parquet(spark, tmp_path, rows))
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == ordered(brute.jaccard(rows))


def test_bpe(spark, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = [(k, f"{a} {b} {a}") for k, (a, b) in enumerate(PAIRS)]
    found = bpe.encode_decode(as_parquet(spark, tmp_path, rows), VOCABULARY).collect()
    assert ordered((r.doc_id, r["ids"], r.decoded) for r in found) == ordered((d, tokenizer.encode(t, add_special_tokens=False).ids, t) for d, t in rows)


@pytest.mark.parametrize("length", [40, 1_024, 2_048])
def test_repeats(spark, tmp_path, length):
    rows = [(1, " ".join(thue_morse(length, "a", "b"))), (2, " ".join(thue_morse(length, "b", "a"))), (3, " ".join(PAIRS[0] * 20)), (4, " ".join(PAIRS[0][::-1] * 20))]
    found = recompression.remove_repeats(as_parquet(spark, tmp_path, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert ordered(r[:] for r in found.collect()) == ordered(brute.repeats(rows))
