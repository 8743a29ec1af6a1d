import pytest
from pyspark.sql import functions as F

from evidentia.operators import evals, graph, history, maintain, retrieval, reviews, verify
from evidentia.streaming import changes


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def seeds(spark, *paths):
    return spark.createDataFrame([(1, p) for p in paths], "seed_set int, path string")


def test_dependents(spark):
    chain = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "c")])
    hits = lambda hops: {(r.path, r.hops) for r in graph.dependents(chain, seeds(spark, "c"), hops).collect()}
    assert hits(1) == {("b", 1)} and hits(2) == {("b", 1), ("a", 2)} and hits(5) == {("b", 1), ("a", 2)}


def test_import_edges_with_manifest(spark):
    files = spark.createDataFrame([("crates/retrieval/src/lib.rs",), ("src/main.rs",)], "path string")
    imports = spark.createDataFrame([("src/main.rs", "my_retrieval::Engine")], "path string, target string")
    manifests = spark.createDataFrame([("crates/retrieval/Cargo.toml", '[package]\nname = "my-retrieval"')], "path string, text string")
    assert [r[:] for r in graph.import_edges(imports, files, manifests).collect()] == [("src/main.rs", "crates/retrieval/src/lib.rs")]
    assert graph.import_edges(imports, files).count() == 0
    plain = spark.createDataFrame([("src/main.rs", "retrieval::Engine")], "path string, target string")
    assert graph.import_edges(plain, files).count() == 1


def commits(spark, *groups):
    return spark.createDataFrame([(i, 100 * i, f) for i, files in enumerate(groups) for f in files], "commit int, ts long, file string")


def test_cochange(spark):
    rows = commits(spark, "ab", "abc", "a", [*"ab", *map(str, range(40))])
    found = {(r.path_a, r.path_b): (r.n, r.total) for r in history.cochange_edges(rows).collect()}
    assert found == {("a", "b"): (2, 3), ("b", "a"): (2, 2)}
    assert {r.file: r.ts for r in history.last_change(rows).collect()}["a"] == 300
    assert {r.commit for r in history.newest(rows, 1, skip=1).collect()} == {2}
    assert all(0 < r.strength <= 1 for r in history.cochange_edges(rows).collect())


def test_expand_and_explain(spark):
    together = history.cochange_edges(commits(spark, "ab", "ab", "ac", "ac", "ac"))
    files = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    rows = graph.expand(together, edges(spark, [("d", "a"), ("c", "a")]), seeds(spark, "a", "zz"), files).collect()
    assert [(r.path, round(r.confidence, 2)) for r in rows if r.section == "cochange"] == [("c", 0.6), ("b", 0.4)]
    assert [r.path for r in rows if r.section == "import"] == ["d"]
    pair = lambda a, b, **k: {(r.type, r.detail) for r in graph.explain(together, edges(spark, [("d", "a"), ("c", "a")]), spark.createDataFrame([(a, b)], "source string, target string"), files, **k).collect()}
    assert pair("a", "c") == {("historical_cochange", "changes with a in 60% of its commits")}
    assert ("import_edge", "c imports a") in pair("a", "c", complete=True)
    assert pair("a", "d") == {("import_edge", "d imports a")} and pair("b", "d") == set()


def test_bm25_prefers_the_rare_term(spark):
    docs = spark.createDataFrame([("x", "common rare"), ("y", "common common"), ("z", "other")], "doc string, body string")
    asked = spark.createDataFrame([(1, "Common RARE")], "query_id int, text string")
    rows = retrieval.bm25(docs, asked).collect()
    assert [r.doc for r in sorted(rows, key=lambda r: r["rank"])] == ["x", "y"]


def test_vectors_have_length_one(spark):
    from evidentia.functions.text import code_tokens

    docs = spark.createDataFrame([("x", "parse Json fast"), ("y", "ab"), ("z", "")], "doc string, body string")
    sums = {r.doc: r.s for r in retrieval.hashed_vectors(docs, code_tokens(F.col("body"))).groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()}
    assert sums == {"x": pytest.approx(1), "y": pytest.approx(1)}


def test_fusion_order_of_adjustments(spark):
    docs = spark.createDataFrame([("a", "src/retry.rs", None), ("b", "CHANGELOG.md", None), ("c", "tests/x.rs", None)], "doc string, path string, last_ts long")
    asked = spark.createDataFrame([(1, "retry things")], "query_id int, text string")
    lists = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0)], "query_id int, doc string, score double")
    rows = {r.doc: r for r in retrieval.fused(lists, lists.limit(0), docs, asked, 0).collect()}
    assert rows["a"].score == pytest.approx(1.6) and rows["b"].score == pytest.approx(0.35) and rows["c"].score == pytest.approx(0.8)
    assert rows["a"].signals == ["bm25", "path"] and rows["b"].signals == ["bm25", "changelog_demoted"]


def test_packets_keep_one_of_each_symbol(spark):
    asked = spark.createDataFrame([(1, "fix merge_dicts please")], "query_id int, text string")
    symbols = spark.createDataFrame([("merge_dicts", "function", "a.py", 1), ("merge_dicts", "function", "b.py", 3), ("merge_dicts_deep", "function", "c.py", 5)], "name string, kind string, path string, start_line int")
    fused = spark.createDataFrame([(1, "z.py", "z.py", 1.0, ["bm25"], 1)], "query_id int, doc string, path string, score double, signals array<string>, rank int")
    rows = sorted(retrieval.packets(fused, symbols, asked).collect(), key=lambda r: r["rank"])
    assert [(r.path, r.symbol, r.score) for r in rows][0] == ("a.py", "merge_dicts", 2.5)
    assert sum(r.symbol == "merge_dicts" for r in rows) == 1


def test_reviews(spark):
    prs = spark.createDataFrame([(7, "t", True)], "number long, title string, merged boolean")
    comments = spark.createDataFrame([(7, "a.rs", "x", ""), (8, "b.rs", "y", "@@")], "pr_number long, path string, body string, diff_hunk string")
    rows = reviews.with_pull_requests(comments, prs).collect()
    assert len(rows) == 1 and rows[0].diff_hunk is None and rows[0].pr_title == "t"
    made = spark.createDataFrame([(7, "aaa", "09:00"), (7, "bbb", "11:00"), (7, "ccc", "12:00")], "pr_number long, sha string, authored_at string")
    asked = spark.createDataFrame([(7, 1, "10:00"), (7, 2, "12:00"), (9, 3, "10:00")], "pr_number long, id int, created_at string")
    assert {r.id: r.next_sha for r in reviews.next_commits(asked, made).collect()} == {1: "bbb", 2: None, 3: None}


def test_verification(spark):
    profiles = (verify.Profile("backend", ("**/*.rs",), ("unit tests", "error handling")), verify.Profile("frontend", ("**/*.tsx",), ("a11y", "unit tests")), verify.Profile("database", ("**/migrations/**",), ("m",)))
    changed = spark.createDataFrame([(1, "src/billing/cancel.rs"), (1, "web/app/Page.tsx"), (2, "README.md")], "change_set int, path string")
    matched = verify.matched_profiles(changed, profiles)
    assert [(r.change_set, r.profile) for r in matched.orderBy("position").collect()] == [(1, "backend"), (1, "frontend")]
    checks = verify.checklist(matched, profiles).orderBy("profile_position", "check_position").collect()
    assert [r.check for r in checks] == ["unit tests", "error handling", "a11y"]
    files = spark.createDataFrame([("Cargo.toml",), ("setup.cfg",), ("sub/package.json",)], "path string")
    assert [r.command for r in verify.test_commands(files).orderBy("position").collect()] == ["cargo test", "pytest"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcd")] + [(2, x, i + 1) for i, x in enumerate("xya")], "query_id int, item string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z"), (2, "a"), (3, "q")], "query_id int, item string")
    rows = {r.query_id: r for r in evals.per_query(ranked, relevant, (2, 4)).collect()}
    assert rows[1].recall_2 == pytest.approx(1 / 3) and rows[1].recall_4 == pytest.approx(2 / 3)
    assert rows[2].rr == pytest.approx(1 / 3) and rows[3].rr == 0


def test_maintenance(spark):
    old = spark.createDataFrame([("kept", 1, True), ("gone", 2, True)], "path string, size int, done boolean")
    new = spark.createDataFrame([("kept", 9, False), ("fresh", 3, False)], "path string, size int, done boolean")
    assert {r.path: (r.size, r.done) for r in maintain.upsert(old, new, ["path"], keep=["done"]).collect()} == {"kept": (9, True), "gone": (2, True), "fresh": (3, False)}
    keep = spark.createDataFrame([("kept",)], "path string")
    pruned = maintain.prune({"files": old}, keep)["files"]
    assert [r.path for r in pruned.collect()] == ["kept"] and maintain.prune({"files": pruned}, keep)["files"].count() == 1
    assert maintain.pruned_count(old, keep).first()[0] == 1
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, v int, w string")
    assert {r.path: r.w for r in maintain.latest(rows, ["path"], ["v"]).collect()} == {"a": "y", "b": "z"}
    assert {(r.path, r.w) for r in maintain.replace_for(rows, spark.createDataFrame([("a", 5, "n")], rows.schema), ["path"]).collect()} == {("a", "n"), ("b", "z")}
    assert maintain.with_missing_columns(maintain.with_missing_columns(keep, {"n": ("int", 0)}), {"n": ("int", 0)}).columns == ["path", "n"]
    known = spark.createDataFrame([("a", 1), ("b", None)], "path string, ts long")
    assert {r.path: r.ts for r in maintain.update_known(known, spark.createDataFrame([("b", 5), ("c", 6)], "path string, ts long"), "path", "ts").collect()} == {"a": 1, "b": 5}


def test_vector_cache(spark):
    chunks = spark.createDataFrame([("a", 1, "h1"), ("a", 40, "h2"), ("b", 1, "h3")], "path string, start_line int, hash string")
    cached = spark.createDataFrame([("a", 1, "h1", [1.0, 2.0]), ("a", 40, "old", [1.0, 2.0]), ("b", 1, "h3", [1.0])], "path string, start_line int, hash string, vector array<float>")
    assert {(r.path, r.start_line): r.reused for r in maintain.reusable(chunks, cached, 2).collect()} == {("a", 1): True, ("a", 40): False, ("b", 1): False}


def test_stream_state(spark):
    held = []
    step = changes.state_writer(lambda: held[-1] if held else None, lambda df: held.append(spark.createDataFrame(df.collect(), df.schema)), "path", "ts")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, ts long, kind string")
    for batch in (frame(("a", 1, "create"), ("b", 1, "create")), frame(("a", 3, "remove"), ("a", 2, "modify")), frame(("a", 3, "remove"), ("a", 2, "modify"))):
        step(batch, 0)
    assert {r.path: r.kind for r in held[-1].collect()} == {"a": "remove", "b": "create"}
    events = frame(("src/a.rs", 1, "modify"), ("target/x", 1, "modify"), (".git/HEAD", 1, "modify"), ("src/b.rs", 1, "access"))
    assert {(r.path, r.route) for r in changes.routed_events(events).collect()} == {("src/a.rs", "file"), (".git/HEAD", "head")}


def test_bm25_of_many_queries(spark, monkeypatch):
    """Queries that are too many to be sent are joined by term, with the same scores."""
    docs = spark.createDataFrame([(1, "a/red.py", "red gear, red bolt"), (2, "b.py", "blue bolt"), (3, "c.py", ""), (4, "d.py", None)], "doc long, path string, body string")
    asked = spark.createDataFrame([(1, "red bolt bolt"), (2, "c py"), (3, ""), (4, None)], "query_id long, text string")
    sent = sorted(map(tuple, retrieval.bm25(docs, asked, 3, ("path", "body")).collect()))
    monkeypatch.setattr(retrieval, "ASKED_ROWS", 0)
    joined = sorted(map(tuple, retrieval.bm25(docs, asked, 3, ("path", "body")).collect()))
    assert sent == joined and {(q, d) for q, d, *_ in sent} == {(1, 1), (1, 2), (2, 2), (2, 3), (2, 4)}


def test_import_classes_give_the_whole_graph(spark, monkeypatch):
    """Without the edges: the same counts, distances and reasons as with them. With them: each once, behind no shuffle."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    names = ["alpha", "beta", "gamma", "hot"]
    files = [f"s/p{i}/{names[i % 4] if i % 3 else 'hot'}.py" for i in range(24)]
    links = [(p, t) for i, p in enumerate(files) for t in ([names[i % 2]] if i % 5 else ["hot", "p3/hot", "nowhere"])]
    imports, known = spark.createDataFrame(links, "path string, target string"), spark.createDataFrame([(p,) for p in files], "path string")
    keys = lambda p: (p.split("/")[-1][:-3], "/".join(p[:-3].split("/")[-2:]))
    wanted = {(s, p) for s, t in links for p in files if t in keys(p) and s != p}
    classes = graph.import_classes(imports, known)
    made = graph.edges_of(classes)
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Aggregate" not in plan[: plan.index("RepartitionByExpression")] and "Join" not in plan[: plan.index("RepartitionByExpression")]
    drawn = edges(spark, sorted(wanted))
    each = known.select(F.col("path").alias("seed_set"), "path")
    for hops in (1, 2, 3):
        expected = {tuple(r) for r in graph.dependents(drawn, each, hops).collect()}
        assert {tuple(r) for r in graph.dependents_of_each(classes, known, hops).collect()} == expected
    together = history.cochange_edges(commits(spark, files[:3], files[1:4], files[:2], files[4:6], files[4:6]))
    kinds = drawn.withColumn("kind", F.lit("imports")).unionByName(together.select(F.col("path_a").alias("src"), F.col("path_b").alias("dst"), F.lit("cochange").alias("kind")))
    assert graph.whole_stats(classes, together).first().asDict() == graph.stats(graph.from_edges(kinds)).first().asDict()
    pairs = together.select(F.col("path_a").alias("source"), F.col("path_b").alias("target")).unionByName(drawn.select(F.col("src").alias("source"), F.col("dst").alias("target")))
    by_edges = sorted(map(tuple, graph.explain(together, drawn, pairs, known).collect()))
    assert sorted(map(tuple, graph.explain_all(together, classes, known).collect())) == by_edges and len(by_edges) > 50


def test_no_imports(spark):
    none = graph.import_classes(spark.createDataFrame([], "path string, target string"), spark.createDataFrame([("a/b/long.py",)], "path string"))
    assert graph.edges_of(none).count() == 0
    assert graph.whole_stats(none, edges(spark, []).toDF("path_a", "path_b")).first()[:] == (0, 0, 0, 0)


def test_cochange_makes_each_pair_once(spark):
    """Commits are shuffled once and never joined with themselves, with the counts of all pairs."""
    from collections import Counter
    from itertools import permutations

    groups = [{(i * j) % 11 for j in range(i % 7)} for i in range(60)] + [set(range(11))]
    rows = spark.createDataFrame([(i, 0, f"f{x}") for i, files in enumerate(groups) for x in files] * 2 + [(3, 0, None)], "commit int, ts long, file string")
    small = [{f"f{x}" for x in g} for i, g in enumerate(groups) if len(g) + (i == 3) <= 5]
    pairs, totals = Counter(p for g in small for p in permutations(g, 2)), Counter(x for g in small for x in g)
    found = history.cochange_edges(rows, cap=5)
    assert {(r.path_a, r.path_b): (r.n, r.total) for r in found.collect()} == {p: (n, totals[p[0]]) for p, n in pairs.items() if n >= 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_bm25_in_blocks(spark, monkeypatch):
    """Blocks of any size and by rows: the same scores; only blocks' best rows, of those that reach what was seen, are rows at all."""
    words = ["red", "blue", "gear", "bolt", "nut", "steel"]
    docs = spark.createDataFrame([(i, f"a/{words[i % 6]}.py", " ".join(words[(i * j) % 6] for j in range(i % 9)) if i % 10 else None) for i in range(300)], "doc long, path string, body string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(words[: i % 5]) + " py red" * (i % 2)) for i in range(40)], "query_id long, text string")
    size = {i: (i % 3) * 7 for i in range(300)}
    sized = docs.withColumn("size", (F.col("doc") % 3) * 7)
    terms = retrieval.asked_terms(asked)
    rows = sorted(map(tuple, retrieval._bm25_by_rows(docs, terms, 7, ("path", "body")).collect()))
    hits = {}
    for q, d, *_ in retrieval._bm25_by_rows(docs, terms, 300, ("path", "body")).collect():
        hits[q] = hits.get(q, 0) + size[d]
    for block, at_once in ((1_024, 1 << 21), (16, 5)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "AT_ONCE", at_once)
        blocks = retrieval.lexical_blocks(sized, terms, ("path", "body"), "size")
        assert sorted(map(tuple, blocks.best(7).collect())) == rows
        assert dict(map(tuple, blocks.matched().collect())) == hits
    assert retrieval.lexical_blocks(docs.unionByName(docs.limit(1)), terms, ("body",)) is None  # repeated ids are summed up by rows
    monkeypatch.setattr(retrieval, "VOCABULARY", 1)
    assert retrieval.lexical_blocks(docs, terms, ("body",)) is None


def test_best_rows_of_what_a_task_has_seen():
    """Blocks after the first give only rows that may be among the best of all; a name that comes again counts once."""
    import numpy as np

    rng, k, held, kept = np.random.default_rng(7), 3, {}, []
    blocks = [(np.floor(rng.random((50, 4)) * 30), rng.integers(0, 60, 50)) for _ in range(20)]
    blocks = [(scores[np.unique(names, return_index=True)[1]], np.unique(names)) for scores, names in blocks]
    for scores, names in blocks:
        rows, cols = retrieval._best_rows(scores, k, held, 0, names)
        kept += [(c, names[r], scores[r, c]) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)]
    for q in range(4):
        best = lambda found: sorted({n: max(s for m, s in found if m == n) for n, _ in found}.items(), key=lambda x: -x[1])[:k]
        everything = [(n, s[i, q]) for s, names in blocks for i, n in enumerate(names)]
        assert [s for _, s in best([(n, s) for c, n, s in kept if c == q])] == [s for _, s in best(everything)]
    assert len(kept) < 20 * 4 * k


def test_vectors_are_made_in_small_batches(spark):
    """A worker gets few bytes at once, however many rows a file has."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    retrieval.hashed_arrays(spark.createDataFrame([(1, ["red"])], "doc long, body array<string>"), F.col("body"), "doc")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20


def test_units_are_made_once_for_queries_in_many_partitions(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    units = spark.range(40).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")).mapInArrow(counted, "id long, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, vector array<double>").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = retrieval.nearest_rows(units, asked, 2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.query_id, r.id) for r in rows) == [(q, i) for q in range(5) for i in (38, 39)] and made.value == 40
