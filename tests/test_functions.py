import pytest
from pyspark.sql import functions as F

from evidentia.functions import paths as P
from evidentia.functions import text as T
from evidentia.functions.globs import glob_regex


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_languages_and_classes(spark):
    assert values(spark, P.language, "a.rs", "b.py", "c.tsx", "d.mjs", "e.go", "f.md", "rs", "X.RS") == ["rust", "python", "typescript", "javascript", "go", "other", "rust", "other"]
    assert values(spark, P.doc_class, "CHANGES.md", "docs/CHANGELOG.rst", "HISTORY", "README.md", "notes.txt", "src/main.rs") == ["changelog"] * 3 + ["doc"] * 2 + ["code"]
    assert values(spark, P.supported, "a.rs", "a.go") == [True, False]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("tests/a.rs", True), ("src/test/b.go", True), ("a/__tests__/x.js", True), ("x_test.go", True), ("src/test_a.py", True), ("a.spec.ts", True), ("a.test.tsx", True), ("a.spec.tsx", False), ("a.test.jsx", False), ("latest.py", False), ("contest/a.py", False)],
)
def test_is_test(spark, path, expected):
    assert values(spark, P.is_test, path) == [expected]


def test_import_targets(spark):
    assert values(spark, P.normalized_target, "a.b.c", "./utils/retry.ts", "../../lib/http", "crate::store::Store") == ["a/b/c", "utils/retry", "lib/http", "store/store"]
    needles = values(spark, P.module_needles, "src/utils/retry.py", "retry.rs", "http/mod.rs", "api/index.ts", "a/io.rs", "crates/retrieval/src/lib.rs")
    assert "utils/retry" in needles[0] and needles[1] == ["retry"] and needles[2] == ["http"] and needles[3] == ["api"] and needles[4] == []
    assert "retrieval" in needles[5] and "src" not in needles[5]
    assert {"utils/retry", "retry/backoff", "retry"} <= set(values(spark, P.candidate_keys, "utils/retry/backoff")[0])


def test_manifests(spark):
    assert values(spark, P.crate_manifest, "crates/retrieval/src/lib.rs", "src/lib.rs") == ["crates/retrieval/Cargo.toml", None]
    assert values(spark, P.package_name, '[package]\nname = "My-Crate"\n', '[workspace]\nname = "x"\n', '[dependencies]\nname = "no"\n[package]\nversion = "1"\nname = "yes"') == ["my_crate", None, "yes"]


def test_slugs_and_routes(spark):
    slugs = values(spark, P.repository_slug, "https://github.com/o/n.git", "git@github.com:o/n.git", "http://proxy/git/o/n")
    assert [(s.owner, s.name) for s in slugs] == [("o", "n")] * 3
    assert values(spark, P.routed, "target/debug/x", ".evidentia/a.db", ".git/objects/a", "src/main.rs", ".git/logs/HEAD", "src/HEAD.rs") == ["ignored", "ignored", "ignored", "file", "head", "file"]
    assert values(spark, P.in_skipped_directory, "a/node_modules/b.js", "target", "src/vendor/x.rs", "src/a.rs") == [True, False, True, False]


def test_tokens(spark):
    assert values(spark, T.code_tokens, "HTTPServer parseJson v2Engine café_x") == [["httpserver", "parse", "json", "v2", "engine", "café", "x"]]
    assert values(spark, T.query_tokens, "Add the Retry to it, retry ab") == [["add", "retry", "retry"]]
    assert values(spark, T.query_identifiers, "merge_dicts doubles model_name utils.do_it Foo plain") == [["merge_dicts", "model_name", "utils.do_it", "do_it", "foo"]]
    assert values(spark, T.query_identifiers, "all lower words") == [[]]
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) and {"the", "is", "a"} <= set(T.STOPWORDS) and not {"retry", "cancel"} & set(T.STOPWORDS)


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def test_fnv(spark):
    texts = ["", "a", "merge", "naïve 漢字", "x" * 300]
    assert values(spark, T.fnv_hex, *texts) == [f"{fnv(t):016x}" for t in texts]
    assert values(spark, T.fnv_bucket, *texts) == [fnv(t) % 512 for t in texts]


def test_scalars(spark):
    one = spark.range(1)
    boost = lambda ts: one.select(T.recency_boost(F.lit(ts).cast("long"), F.lit(90 * 86400), 0.4, 90.0)).first()[0]
    assert boost(90 * 86400) == pytest.approx(0.4) and boost(0) == pytest.approx(0.2) and boost(None) == 0
    assert one.select(T.percent(F.lit(29), F.lit(100)), T.percent(F.lit(53), F.lit(100))).first()[:] == (29, 52)
    assert values(spark, T.first_quoted, "import x from 'a/b'", 'no "end') == ["a/b", None]
    assert values(spark, T.signature, "  fn a() {\n}") == ["fn a() {"]


def test_chunks(spark):
    def plan(body, spans):
        symbols = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, a, b in spans]) if spans else F.expr("cast(array() as array<struct<name:string,start_line:int,end_line:int>>)")
        return spark.range(1).select(T.chunk_plan(F.lit(body), symbols)).first()[0]

    body = "\n".join(f"line {i}" for i in range(1, 11))
    assert len(plan(body, [])) == 1
    assert [c.start_line for c in plan(body, [("a", 1, 2), ("b", 4, 9_999)])] == [0, 1, 4]
    assert [c.text for c in plan(body, [("a", 1, 2)])][1] == "line 1\nline 2"
    assert len(plan(body, [("z", 0, 0), ("y", 9, 3), ("x", 900, 950)])) == 1
    assert len(plan("x" * 9_000, [("a", 1, 1)])[1].text) == 4_000


def test_globs():
    import re

    match = lambda glob, path: bool(re.match(glob_regex(glob), path))
    assert match("**/*.rs", "main.rs") and match("**/*.rs", "a/b/main.rs") and not match("**/*.rs", "a.rsx")
    assert match("src/*.py", "src/a/b.py") and match("**/migrations/**", "db/migrations/1.sql") and match("*.{ts,tsx}", "a.tsx")
    assert match("[!a]b.c", "xb.c") and not match("[!a]b.c", "ab.c") and match("a?c", "abc")
