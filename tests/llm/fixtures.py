"""Small document tables with the hard cases in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, `key` string, lane string, spans string, class string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(7)
    base, passage = words(rng, 120, 10_000), words(rng, 60, 10_000)
    texts = [None, "", "   ", "one", "Two words", "a b c d", "a b c d e", "A b C d e", base, base, base.replace(" ", "\n\t"), base.upper(), base + "  ", words(rng, 200, 9_000)]
    for i in range(6):
        near = base.split()
        near[10 + 15 * i] = f"changed{i}"
        texts.append(" ".join(near))
    for i in range(5):
        texts.append(words(rng, 20 * i, 9_000) + " " + passage + " " + words(rng, 30, 9_000))
    texts += ["x " * 300, "y z " * 100, " ".join(["loop"] * 34), " ".join(["loop"] * 35), words(rng, 6_000, 9_000) + " " + passage, "long" * 9_000, "é ü 漢字   word\x0b\x0cend", "\x1c\x1d words\x85there"]
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    rows += [(9, base), (9, base), (None, "no id here at all"), (None, base), (2, "same id other text"), (-5, "negative id")]
    return rows


def frame(spark, rows=None):
    rows = hard_rows() if rows is None else rows
    full = [(d, t, "en", None, None, 99, "k", "lane", "s", "c") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def as_parquet(spark, tmp_path, rows=None):
    path = f"{tmp_path}/documents"
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)
