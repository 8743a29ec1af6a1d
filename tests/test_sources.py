import io
import json
import subprocess

from evidentia import tools
from evidentia.operators import maintain, tables
from evidentia.sources import config, github, history, inventory


def make_tree(root):
    files = {
        "src/main.py": "from utils import retry\n\nclass Runner:\n    def go(self):\n        return retry()\n",
        "src/utils/retry.py": "def retry():\n    pass\n",
        "src/lib.rs": "use crate::store::Store;\n\nfn one() {\n  1\n}\n\nstruct Two { a: u8 }\n",
        "web/app.ts": "import { x } from './api/x';\nexport interface Shape {\n  a: number;\n}\nclass A {\n  run(b: number) {\n    return b;\n  }\n}\n",
        "node_modules/a.js": "x", "notes.txt": "x", "README.md": "# hi", "src/test_main.py": "def test_x():\n    pass\n",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "big.py").write_bytes(b"x" * 1_500_001)


def test_inventory(spark, tmp_path):
    make_tree(tmp_path)
    files = inventory.scan(spark, f"file://{tmp_path}", with_content=True)
    assert {r.path for r in files.select("path").collect()} == {"src/main.py", "src/utils/retry.py", "src/lib.rs", "web/app.ts", "README.md", "src/test_main.py", "bad.py"}
    bodies = inventory.bodies(files)
    assert "bad.py" not in {r.path for r in bodies.collect()}
    symbols, imports = inventory.extracted(files.select("path", "language").join(bodies, "path"))
    found = {(r.path, r.name, r.kind, r.start_line, r.end_line) for r in symbols.collect()}
    assert {("src/main.py", "Runner", "class", 3, 5), ("src/main.py", "go", "function", 4, 5), ("src/lib.rs", "one", "function", 3, 5), ("src/lib.rs", "Two", "struct", 7, 7), ("web/app.ts", "Shape", "interface", 2, 4), ("web/app.ts", "run", "method", 6, 8)} <= found
    assert {("src/main.py", "utils"), ("src/lib.rs", "store/store"), ("web/app.ts", "api/x")} <= {(r.path, r.target) for r in imports.collect()}
    assert {r.start_line for r in inventory.chunks(bodies, symbols).where("path = 'src/main.py'").collect()} == {0, 3, 4}


def test_sources_are_read_whole(spark, tmp_path):
    """Symbols, imports and chunks behind the characters that are indexed."""
    (tmp_path / "long.py").write_text("x = 1\n" * 12_000 + "import late\n\ndef last():\n    return late\n")
    files = inventory.scan(spark, f"file://{tmp_path}", with_content=True)
    bodies = inventory.bodies(files)
    assert len(bodies.first().body) == inventory.BODY_CHARS
    symbols, imports = inventory.extracted(files.select("path", "language").join(bodies, "path"))
    assert [(r.name, r.start_line, r.end_line) for r in symbols.collect()] == [("last", 12_003, 12_004)]
    assert [r.target for r in imports.collect()] == ["late"]
    assert [r.text for r in inventory.chunks(bodies, symbols).where("symbol = 'last'").collect()] == ["def last():\n    return late"]


def test_braces_in_comments_and_templates_do_not_count():
    source = "/* function no() { */\nfunction one() {\n  const a = `x ${b} {\n function two() {`; // }\n  return 'a { b' + \"}\";\n}\nclass C { /* } */\n  run(x) {\n    return x;\n  }\n}\n"
    found = [(s[0], s[1], s[2], s[3]) for s in inventory.symbols_of(source, "javascript")]
    assert found == [("one", "function", 2, 6), ("C", "class", 7, 11), ("run", "method", 8, 10)]
    rust = "fn one<'a>(x: &'a str) {\n  let c = '{';\n}\nfn two<'b>() {}\n"
    assert [(s[0], s[2], s[3]) for s in inventory.symbols_of(rust, "rust")] == [("one", 1, 3), ("two", 4, 4)]


def test_git_log(spark, tmp_path):
    log = f"{history.MARKER}300\na.rs\nb.rs\n\n{history.MARKER}200\n\n{history.MARKER}oops\na.rs\n"
    rows = history.commits_of_log(spark, log).collect()
    assert {(r.ordinal, r.ts, r.file) for r in rows} == {(0, 300, "a.rs"), (0, 300, "b.rs"), (2, 0, "a.rs")}
    assert history.git_log(str(tmp_path / "none")) == ""


def test_payloads(spark):
    frame = lambda payload: spark.createDataFrame([(7, json.dumps(payload))], "pr_number long, payload string")
    prs = history.pull_requests(frame([{"number": 1, "title": "t", "merged_at": "2024"}, {"number": 2}])).collect()
    assert [(r.number, r.merged, r.body, r.merged_at) for r in prs] == [(1, True, "", "2024"), (2, False, "", "")]
    files = history.pr_files(frame([{"filename": "a.rs", "status": "added", "additions": 3}])).first()
    assert (files.path, files.additions, files.deletions, files.patch) == ("a.rs", 3, 0, "")
    commits = history.pr_commits(frame([{"sha": "x", "commit": {"message": "m", "author": {"date": "d"}}}, {"sha": "y"}])).collect()
    assert [(r.sha, r.ordinal, r.authored_at) for r in commits] == [("x", 0, "d"), ("y", 1, "")]
    comments = history.review_comments(frame([{"path": "a", "original_line": 4, "body": "b", "user": {"login": "u"}}, {"path": "a", "line": 2, "original_line": 4}])).collect()
    assert [(r.line, r.author, r.in_reply_to) for r in comments] == [(4, "u", None), (2, "", None)]
    stats = history.ingest_stats(history.pull_requests(frame([])), history.pr_files(frame([{"filename": "a"}])), history.pr_commits(frame([])), history.review_comments(frame([]))).first()
    assert stats.files == 1 and stats.files_without_patch == 1 and stats.commits == 0


def test_config(tmp_path):
    folder = tmp_path / "config" / "verification"
    folder.mkdir(parents=True)
    (tmp_path / "config/scoring.toml").write_text("bm25 = 2.0\nunknown = 1\n")
    (tmp_path / "config/stopwords.txt").write_text("# own\nPlease # polite\n\n")
    (folder / "b.yaml").write_text('name: b\ndetect:\n  - "**/*.x"\nchecks:\n  - "one"\n')
    (folder / "a.yml").write_text("nothing: here\n")
    assert config.weights(str(tmp_path)).bm25 == 2.0 and config.weights(str(tmp_path)).vector == 1.2
    assert "please" in config.stopwords(str(tmp_path)) and "the" in config.stopwords(str(tmp_path))
    (folder / "c.yaml").write_text("name: 'c'  # own\ndetect: [\"**/*.y\", '**/{a,b}.z']\nchecks:\n  - two # words\n  - 'three # words'\n")
    found = config.profiles(str(tmp_path))
    assert [p.name for p in found] == ["b", "c"] and found[1].detect == ("**/*.y", "**/{a,b}.z") and found[1].checks == ("two", "three # words")
    (tmp_path / "config/scoring.toml").write_text("broken = = 1")
    assert config.weights(str(tmp_path)).bm25 == 1.0


def test_protocol():
    def call(name, arguments):
        if name == "boom":
            raise RuntimeError("no")
        return {"name": name, **arguments}

    ask = lambda **m: tools.respond({"id": 1, **m}, call)
    assert ask(method="ping")["result"] == {} and tools.respond({"method": "ping"}, call) is None
    assert len(ask(method="tools/list")["result"]["tools"]) == 9
    assert ask(method="nope")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "boom"})["result"]["isError"]
    out = io.StringIO()
    tools.serve(call, io.StringIO('garbage\n{"id": 2, "method": "tools/call", "params": {"name": "x", "arguments": {"a": 1}}}\n'), out)
    answer = json.loads(out.getvalue())
    assert json.loads(answer["result"]["content"][0]["text"]) == {"name": "x", "a": 1}


def test_tools_over_a_repository(spark, tmp_path):
    make_tree(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(2):
        for name in ("src/main.py", "src/test_main.py"):
            path = tmp_path / name
            path.write_text(path.read_text() + f"# {i}\n")
        git("add", "src/main.py", "src/test_main.py")
        git("commit", "-qm", f"change {i}")
    found = tools.Tools(tools.index(spark, str(tmp_path)), as_of=2_000_000_000)
    plan = found.call("get_verification_plan", {"changed_files": ["src/main.py"]})
    assert plan["matched_profiles"] == ["backend"] and plan["historically_co_failing_tests"] == ["src/test_main.py"]
    near = found.call("expand_connections", {"paths": ["src/main.py"]})
    assert [r["path"] for r in near["cochange_expansions"]] == ["src/test_main.py"] and near["likely_tests"] == ["src/test_main.py"]
    why = found.call("explain_connection", {"source": "src/main.py", "target": "src/test_main.py"})
    assert why["connected"] and why["reasons"][0]["type"] == "historical_cochange"
    evidence = found.call("search_context", {"query": "Runner go retry"})["evidence"]
    assert evidence and evidence[0]["id"] == "ev_000" and any(e["path"] == "src/main.py" for e in evidence)
    packet = next(e for e in evidence if e["path"] == "src/main.py")
    assert packet["symbol"] in ("Runner", "go") and packet["title"].startswith(f"{packet['symbol']} in src/main.py") and packet["snippet"]
    assert found.call("get_review_history", {"path": "src/main.py"}) == {"comments": []}
    for name, arguments in (("nope", {}), ("search_context", {}), ("get_review_history", {})):
        try:
            found.call(name, arguments)
            raise AssertionError(name)
        except ValueError:
            pass


class Pages:
    """Answers in place of the network."""

    def __init__(self, requests, parts):
        self.requests, self.parts = requests, parts

    def closed_pull_requests(self, most):
        yield json.dumps(self.requests[:most])

    def of_pull_request(self, number, what):
        rows = self.parts.get((number, what), [])
        yield json.dumps(rows[:1])
        yield json.dumps(rows[1:])


def test_reviews_from_ingest_to_tool(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "tree")
    comment = lambda text: {"path": "src/main.py", "line": 3, "body": text, "user": {"login": "u"}, "created_at": "2024-01-02"}
    first = Pages([{"number": 5, "title": "Retry", "merged_at": "2024"}, {"number": 6}], {(5, "comments"): [comment("retry twice"), comment("name it well")], (5, "commits"): [{"sha": "a"}, {"sha": "b"}], (6, "comments"): [comment("other")]})
    folder = f"{tmp_path}/reviews"
    github.stored(github.ingest(spark, first, 10), folder)
    assert [(r.sha, r.ordinal) for r in github.loaded(spark, folder)["pr_commits"].orderBy("ordinal").collect()] == [("a", 0), ("b", 1)]
    github.stored(github.ingest(spark, Pages([{"number": 5, "title": "Retry it", "merged_at": "2024"}], {(5, "comments"): [comment("retry thrice")], (5, "files"): [{"filename": "x", "patch": "1"}, {"filename": "x", "patch": "2"}]}), 10), folder)
    stored = github.loaded(spark, folder)
    assert {(r.number, r.title) for r in stored["pull_requests"].collect()} == {(5, "Retry it"), (6, "")}
    assert [(r.path, r.patch) for r in stored["pr_files"].collect()] == [("x", "2")]
    found = tools.Tools(tools.index(spark, str(tmp_path / "tree"), folder), as_of=0)
    assert sorted(r["body"] for r in found.call("get_review_history", {"path": "src/main.py"})["comments"]) == ["other", "retry thrice"]
    assert found.call("get_review_history", {"path": "", "task": "retry"})["comments"][0]["body"] == "retry thrice"
    monkeypatch.setattr("sys.argv", ["evidentia"])
    out = io.StringIO()
    monkeypatch.setattr(tools, "serve", lambda call: out.write(json.dumps(call("get_review_history", {"path": "src/main.py"}))))
    tools.main(["--repo", str(tmp_path / "tree"), "--reviews", folder])
    assert len(json.loads(out.getvalue())["comments"]) == 2


def test_reindex_prune_and_refresh(spark, tmp_path):
    make_tree(tmp_path / "one")
    (tmp_path / "one/src/user.py").write_text("import utils.retry\n")
    whole = tools.index(spark, str(tmp_path / "one"))
    (tmp_path / "two/src").mkdir(parents=True)
    (tmp_path / "two/src/main.py").write_text("import nothing\n\ndef fresh():\n    pass\n")
    (tmp_path / "two/src/user.py").write_text("pass\n")
    gone = spark.createDataFrame([("src/lib.rs",)], "path string")
    now = maintain.reindexed(whole, tools.index(spark, str(tmp_path / "two")), gone)
    assert {r.name for r in now.symbols.where("path like 'src/%'").collect()} == {"fresh", "retry", "test_x"}
    assert whole.imports.where("src = 'src/user.py'").count() == 1 and now.imports.where("src = 'src/user.py'").count() == 0
    assert now.files.where("path = 'src/lib.rs'").count() == 0
    kept = maintain.prune_repository(whole, spark.createDataFrame([("src/main.py",)], "path string"))
    assert {r.path for r in kept.symbols.collect()} == {r.path for r in kept.chunks.collect()} == {"src/main.py"} and kept.imports.count() == 0
    assert tables.index_stats(kept).first().asDict() == {"files": 1, "extracted": 1, "symbols": 2, "cochange": 0, "imports": 0}
    assert [r.name for r in tables.symbols_of_path(whole.symbols, kept.files).collect()] == ["Runner", "go"]
    commits = spark.createDataFrame([(c, 100 + c, f) for c in (1, 2) for f in ("src/main.py", "web/app.ts")], "commit int, ts long, file string")
    late = maintain.refreshed_history(whole, commits)
    assert {(r.path_a, r.n) for r in late.cochange.collect()} == {("src/main.py", 2), ("web/app.ts", 2)}
    assert tools.newest_change(late) == 102


def test_subjects_of_a_log(spark):
    log = f"{history.MARKER}Fix the thing: part 2\na.rs\n\n{history.MARKER}7\nb.rs\n"
    assert [(r.ordinal, r.subject, r.file) for r in history.subjects_of_log(spark, log).collect()] == [(0, "Fix the thing: part 2", "a.rs"), (1, "7", "b.rs")]
