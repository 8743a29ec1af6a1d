import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import components, exact, jaccard, lines, recompression, storage

from . import brute
from .fixtures import as_parquet, frame, hard_rows, words


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return as_parquet(spark, tmp_path_factory.mktemp("docs"))


def test_exact(spark, docs):
    found = exact.exact_dedup(docs, fan_in=2)
    expected, groups = brute.exact(hard_rows())
    assert ordered((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == ordered(expected)
    assert found.where("kept").count() == groups


def test_exact_in_many_lanes_and_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "SLICE_ROWS", 8)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["hot", "h o t", " hot", *[f"text {i}" for i in range(150)]]) if rng.random() < 0.8 else f"own {i}") for i in range(900)]
    frame(spark, rows).repartition(40).write.parquet(f"{tmp_path}/documents")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = exact.exact_dedup(spark.read.parquet(f"{tmp_path}/documents"), fan_in=3)
        assert max(r.lane for r in exact.digest_runs(spark.read.parquet(f"{tmp_path}/documents")).select("lane").distinct().collect()) >= 20
        expected, groups = brute.exact(rows)
        assert ordered((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == ordered(expected)
        assert found.where("kept").count() == groups
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_in_many_batches(spark, tmp_path):
    rng = random.Random(15)
    pool = [f"line number {i} with enough characters" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    for batches, fan_in in ((1, 2), (7, 2), (9, 3)):
        found = lines.drop_repeated_lines(as_parquet(spark, tmp_path / f"{batches}", rows), batches=batches, fan_in=fan_in).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("s"))
        assert ordered(r[:] for r in found.collect()) == ordered(brute.lines(rows))


def test_jaccard(spark, docs):
    found = jaccard.linked_components(docs)
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == ordered(brute.jaccard(hard_rows()))


def test_jaccard_long_columns(spark, tmp_path):
    """A group of near copies that is longer than a column multiplied at once, in several components."""
    rng = random.Random(3)
    rows = []
    for g in range(2):
        base = words(rng, 80, 9_000).split()
        for i in range(110):
            near = list(base)
            for at in rng.sample(range(80), 1 + i % 3):
                near[at] = f"n{g}x{i}x{at}"
            rows.append((1_000 * g + i, " ".join(near)))
    rng.shuffle(rows)
    found = jaccard.linked_components(as_parquet(spark, tmp_path, rows))
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == ordered(brute.jaccard(rows))


def test_jaccard_overlap_in_short_and_long_columns(spark, tmp_path):
    """Form letters: two of them are linked by the passage of all (a long column for each n-gram) and by n-grams of their own."""
    rng = random.Random(11)
    passage, both = words(rng, 82, 90_000), words(rng, 10, 90_000)
    rows = [(i, f"{passage} {words(rng, 22, 90_000)}") for i in range(70)] + [(100 + i, f"{passage} {both} {words(rng, 12, 90_000)}") for i in range(2)]
    expected = brute.jaccard(rows)
    assert (101, 100, 100) in expected
    found = jaccard.linked_components(as_parquet(spark, tmp_path, rows))
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == ordered(expected)


def test_jaccard_large_groups_that_are_near_but_not_linked(spark, tmp_path):
    """Two groups of near copies, each linked to its base, share a passage but no link; letters around it link with none."""
    rng = random.Random(13)
    passage, rows = words(rng, 150, 90_000), []
    for g in range(2):
        base = f"{passage} {words(rng, 60, 90_000)}".split()
        for i in range(3_000):
            near = list(base)
            if i:
                near[rng.randrange(205)] = f"c{g}x{i}"
            rows.append((10_000 * g + i, " ".join(near)))
    rows += [(50_000 + i, f"{passage} {words(rng, 60, 90_000)}") for i in range(500)]
    rng.shuffle(rows)
    found = jaccard.linked_components(as_parquet(spark, tmp_path, rows))
    assert ordered((r.doc_id, r.component_id) for r in found.collect()) == ordered((d, d if d >= 50_000 else d // 10_000 * 10_000) for d, _ in rows)


def test_jaccard_few_pairs_in_a_group_that_is_linked_in_part(spark, tmp_path, monkeypatch):
    """Copies of one text with 1 to 6 words changed: some link with many, some with none; most of what is linked is found by few pivots."""
    rng = random.Random(17)
    base, rows, made, whole = words(rng, 150, 90_000).split(), [], [], jaccard._cross_pairs
    for i in range(900):
        near = list(base)
        for at in rng.sample(range(150), 1 + i % 6):
            near[at] = f"n{i}x{at}"
        rows.append((i, " ".join(near)))
    rng.shuffle(rows)

    def counted(active, *more):
        found = whole(active, *more)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_cross_pairs", counted)
    found = jaccard.linked_components(as_parquet(spark, tmp_path, rows))
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == ordered(brute.jaccard(rows))
    assert made and sum(made) < 20 * len(rows), made


def test_jaccard_pivots_come_by_place(spark):
    """Rows that come early in the order are pivots first; rows that are not early have no turn."""
    rows = [(7, c, 140, c % 30, c % 30 <= 20) for c in range(3_000)]
    ranked = jaccard._ranked(spark.createDataFrame(rows, "gram long, class long, n int, at int, early boolean"), 75, 100).collect()
    assert len(ranked) == 3_000 and all((r.u is not None) == r.early for r in ranked)
    for r in ranked:
        assert r.u is None or r["at"] * 100 <= r.u < (r["at"] + 1) * 100


def test_jaccard_every_pair_meets(spark):
    """Over all rounds, each pair of early rows of different components meets, and no pair within one."""
    rng = random.Random(23)
    rows = [(g, c, 140, rng.randrange(21), True, 0 if c % 3 else c) for g in (1, 2) for c in range(90)]
    active = spark.createDataFrame(rows, "gram long, class long, n int, at int, early boolean, comp long")
    mixed = jaccard._mixed(active, 0)
    assert ordered(r[:] for r in mixed.collect()) == [(1, 0), (2, 0)]
    ranked, met, before, pivots = jaccard._ranked(active.join(mixed, "gram"), 75, 100).localCheckpoint(), [], 0, 2
    while before < 90:
        met += [r[:] for r in jaccard._cross_pairs(ranked, before, pivots, 75, 100).collect()]
        before, pivots = pivots, pivots * 4
    comp = {r[1]: r[5] for r in rows}
    assert set(met) == {(a, b) for a in range(90) for b in range(a) if comp[a] != comp[b]}


def test_jaccard_late_rows_never_link():
    """Rows of which both come late in the order lack the places that a link needs."""
    for n in range(1, 60):
        for m in range(max(1, n * 3 // 4), n * 4 // 3 + 1):
            for at in range(jaccard.prefix_size(n, 75, 100)):
                for p_at in range(jaccard.prefix_size(m, 75, 100)):
                    if min(n - at, m - p_at) >= -(-75 * (n + m) // 175):
                        assert jaccard._early(n, at, 75, 100) or jaccard._early(m, p_at, 75, 100)


def test_pieces_of_a_column_meet(spark, monkeypatch):
    columns = spark.createDataFrame([(5, p, c, 10, 0) for c in range(200) for p in [c % 3]] + [(6, -1, 1, 10, 0), (7, -1, 1, 10, 0), (7, -1, 2, 10, 1)], "gram long, piece int, class long, n int, at int")
    rows = jaccard._first_round(columns, 75, 100).collect()
    pairs = {(r["class"], r.p_class) for r in rows if r.gram == 5 and r["class"] != r.p_class}
    edges = spark.createDataFrame(list(pairs), "a long, b long")
    assert {r.least for r in components.components(edges).collect()} == {0}
    assert [(r["class"], r.p_class, r.overlap) for r in rows if r.gram is None] == [(2, 1, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (5, 5), (100, 101)]
    found = {r.vertex: r.least for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 103: 100}


def test_recompression(spark, docs):
    found = recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert ordered(r[:] for r in found.collect()) == ordered(brute.repeats(hard_rows()))


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_equal_windows_have_equal_representatives(rounds):
    rng = random.Random(rounds)
    texts = [" ".join(rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(30, 200))).encode() for _ in range(300)]
    texts += [b" ".join([b"z"] * rng.randrange(3) + t.split()[rng.randrange(5) :]) for t in texts]
    parser, seen = recompression.Parser(35, rounds), {}
    parser.join(texts)
    at, key = parser.representatives()
    for window, place, value in zip(parser.windows.tolist(), at.tolist(), key.tolist(), strict=True):
        content = parser.all[window : window + 35].tobytes()
        assert seen.setdefault(content, (value, place - window if place >= 0 else None)) == (value, place - window if place >= 0 else None)


def test_first_text_of_a_chunk_is_parsed_as_any_other():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde"[: rng.choice([2, 3, 5])]) for _ in range(rng.randrange(35, 120))).encode() for _ in range(200)]
    parser = recompression.Parser(35, recompression.ROUNDS)

    def parsed(some):
        parser.join(some)
        at, key = parser.representatives()
        text = parser.text_of(parser.windows)
        start = parser.starts[text]
        place = np.where(at >= 0, at - start, at + start)
        return [list(zip(place[text == i].tolist(), key[text == i].tolist(), strict=True)) for i in range(len(some))]

    assert parsed(texts) == [parsed([t])[0] for t in texts]


def test_starts_of_windows_are_no_objects():
    """A batch holds up to a million starts of windows; reading them takes some bytes each, not a dictionary."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    small = pa.array([None, [], [{"first": 3, "last": 5}, {"first": 9, "last": 9}], None, [{"first": 1, "last": 2}], []], kind)
    for part in (small, small.slice(2), small.slice(3, 2), small.slice(0, 0)):
        assert [[x.tolist() for x in found] for found in recompression._fields(part)] == [[[x[k] for x in found or ()] for k in ("first", "last")] for found in part.to_pylist()]
    n = 200_000
    large = pa.ListArray.from_arrays(np.arange(0, n + 1, 1_000, dtype=np.int32), pa.StructArray.from_arrays([pa.array(np.arange(n, dtype=np.int32))] * 2, names=["first", "last"]))
    tracemalloc.start()
    try:
        assert sum(len(first) for first, _ in recompression._fields(large)) == n
        assert tracemalloc.get_traced_memory()[1] < 48 * n
    finally:
        tracemalloc.stop()


def test_lines(spark, tmp_path):
    rng = random.Random(5)
    pool = [f"line number {i} with enough characters" for i in range(6)] + ["short", "", "   ", "LINE NUMBER 0 WITH ENOUGH CHARACTERS  ", "É longer line that has an accent"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    rows += [(None, "\n".join(pool)), (None, None), (50, ""), (7, "\n".join(pool)), (7, "\n".join(pool)), (51, "\n" * 5), (52, "x" * 50_000 + "\n" + pool[0])]
    found = lines.drop_repeated_lines(as_parquet(spark, tmp_path, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("s"))
    assert ordered(r[:] for r in found.collect()) == ordered(brute.lines(rows))


def test_line_runs_find_what_is_new(spark):
    keyed = lambda *ids: spark.createDataFrame([(i, i, 1) for i in ids], "h1 long, h2 long, id long")
    runs = lines.LineRuns(fan_in=2)
    for batch in ((1, 2), (2, 3), (4,)):
        runs.add(keyed(*batch))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r.h1 for r in runs.unseen(keyed(1, 3, 5)).collect()} == {5}
    assert {r.h1: r.docs for r in runs.merged().collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


@pytest.mark.parametrize("operator", [exact.exact_dedup, jaccard.linked_components, recompression.remove_repeats, lines.drop_repeated_lines])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_rows_keep_their_identity(spark, docs):
    twice = [storage.with_row_ids(docs).select(*storage.ROW_ID, "doc_id") for _ in range(2)]
    assert twice[0].exceptAll(twice[1]).count() == 0 and twice[0].select(*storage.ROW_ID).distinct().count() == len(hard_rows())
