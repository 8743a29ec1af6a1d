"""The engine's tools by name, a JSON-RPC line protocol around them, and a command line.

Each tool answers one question from a ``Repository`` of tables; its answer is a
bounded number of rows, so it is collected and returned as plain values.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable, Sequence
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.paths import repository_slug
from .functions.text import STOPWORDS
from .operators import graph, history, retrieval, reviews, verify
from .operators.tables import Repository

#: Rows that the tools ask for: search and impact, reuse.
SEARCH_ROWS, REUSE_ROWS = 8, 5

#: Names of the tools and of their one or two arguments, and aliases of earlier names.
ARGUMENTS: dict[str, dict[str, str]] = {
    "search_context": {"query": "string"},
    "find_existing_implementation": {"concept": "string"},
    "predict_impact": {"task": "string"},
    "expand_connections": {"paths": "array"},
    "explain_connection": {"source": "string", "target": "string"},
    "get_verification_plan": {"changed_files": "array"},
    "get_review_history": {"path": "string", "task": "string"},
    "get_task_context": {"task": "string"},
    "find_connected_files": {"files": "array"},
}
OPTIONAL = {"get_review_history"}


class Tools:
    """The tools over one repository. ``as_of`` is the time that recency counts from, in unix seconds."""

    def __init__(self, repository: Repository, as_of: int, weights: retrieval.Weights | None = None, profiles: tuple[verify.Profile, ...] = verify.PROFILES, stopwords: Sequence[str] = STOPWORDS):
        self.tables, self.as_of, self.weights, self.profiles, self.stopwords = repository, as_of, weights or retrieval.Weights(), profiles, stopwords
        self.spark = repository.files.sparkSession

    def call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """The answer of a tool; unknown names and missing arguments raise ValueError."""
        if name not in ARGUMENTS:
            raise ValueError(f"unknown tool: {name}")
        given = [arguments.get(a) for a in ARGUMENTS[name]]
        if name in OPTIONAL:
            if not any(given):
                raise ValueError(f"{name} needs one of: {', '.join(ARGUMENTS[name])}")
        elif missing := [a for a, v in zip(ARGUMENTS[name], given, strict=True) if not v]:
            raise ValueError(f"{name} needs: {', '.join(missing)}")
        handler = {"get_task_context": "search_context", "find_connected_files": "expand_connections"}.get(name, name)
        return getattr(self, f"_{handler}")(*given)

    # tables of one question

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "query_id long, text string")

    def _docs(self) -> DataFrame:
        files = self.tables.files.select(F.col("path").alias("doc"), "path", F.col("last_commit_ts").alias("last_ts"))
        return files.join(self.tables.bodies, "path", "left").select("doc", "path", "last_ts", F.coalesce("body", F.lit("")).alias("body"))

    def _chunks(self) -> DataFrame | None:
        """The chunks that vectors are made of: a file's path and a symbol's name go in front of its text."""
        if self.tables.chunks is None:
            return None
        return self.tables.chunks.select(F.col("path").alias("doc"), "chunk", "symbol", "start_line", "text")

    def _packets(self, text: str, rows: int) -> DataFrame:
        asked, chunks, docs = self._query(text), self._chunks(), self._docs()
        embedded = None if chunks is None else chunks.select("doc", "chunk", F.concat_ws(" ", "doc", "symbol", "text").alias("text"))
        found = retrieval.search(docs, asked, self.as_of, self.weights, rows, embedded, self.stopwords)
        previews = docs.select("path", F.substring("body", 1, retrieval.PREVIEW).alias("preview"))
        return retrieval.packets(found, self.tables.symbols, asked, self.weights, rows, chunks, previews, self.stopwords)

    @staticmethod
    def _rows(df: DataFrame, *order: Any) -> list[dict[str, Any]]:
        return [r.asDict() for r in df.orderBy(*order).collect()]

    # tools

    def _search_context(self, query: str) -> dict[str, Any]:
        packets = self._packets(query, SEARCH_ROWS)
        past = []
        if self.tables.review_comments is not None:
            found = reviews.for_paths(self._history(), packets.select("query_id", "path", "rank"))
            past = self._rows(found.select("rank", "path", "pr_number", "pr_title", "pr_merged", "line", "body"), "rank", "pr_number", "line")
        evidence = [{"id": f"ev_{i:03d}", **r} for i, r in enumerate(self._rows(packets.drop("query_id"), "rank"))]
        return {"task": query, "evidence": evidence, "past_reviews": past}

    def _find_existing_implementation(self, concept: str) -> dict[str, Any]:
        found = self._rows(self._packets(concept, REUSE_ROWS).drop("query_id"), "rank")
        return {"concept": concept, "existing_candidates": found, "recommendation": "reuse one of these" if found else "nothing found"}

    def _predict_impact(self, task: str) -> dict[str, Any]:
        packets = self._packets(task, SEARCH_ROWS)
        best = packets.agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("best"))
        direct = packets.crossJoin(best).select(F.when(F.col("type") == "test", "test").otherwise("file").alias("section"), "path", F.round(F.least(F.col("score") / F.col("best"), F.lit(1.0)), 6).alias("confidence"), "rank")
        out = self._sections(packets.where("type <> 'test'").select("path").distinct())
        rows = self._rows(direct, "rank")
        out["likely_files"] = [r for r in rows if r["section"] == "file"]
        out["likely_tests"] = sorted({r["path"] for r in rows if r["section"] == "test"} | set(out["likely_tests"]))
        return out

    def _sections(self, paths: DataFrame) -> dict[str, Any]:
        seeds = paths.select(F.lit(1).alias("seed_set"), "path")
        rows = self._rows(graph.expand(self.tables.cochange, self.tables.imports, seeds, self.tables.files), "section", "rank")
        part = lambda name: [{"path": r["path"], "confidence": round(r["confidence"], 6), "reason": r["reason"]} for r in rows if r["section"] == name]
        return {"likely_files": part("file"), "likely_tests": [r["path"] for r in part("test")], "cochange_expansions": part("cochange"), "import_expansions": part("import")}

    def _expand_connections(self, paths: list[str]) -> dict[str, Any]:
        return self._sections(self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def _explain_connection(self, source: str, target: str) -> dict[str, Any]:
        pair = self.spark.createDataFrame([(source, target)], "source string, target string")
        found = graph.explain(self.tables.cochange, self.tables.imports, pair, self.tables.files)
        reasons = self._rows(found.select("type", "detail", "weight"), "type", "detail")
        return {"source": source, "target": target, "connected": bool(reasons), "reasons": reasons}

    def _get_verification_plan(self, changed_files: list[str]) -> dict[str, Any]:
        changes = self.spark.createDataFrame([(1, p) for p in changed_files], "change_set int, path string")
        matched = verify.matched_profiles(changes, self.profiles)
        return {
            "matched_profiles": [r["profile"] for r in self._rows(matched, "position")],
            "checklist": [r["check"] for r in self._rows(verify.checklist(matched, self.profiles), "profile_position", "check_position")],
            "test_commands": [r["command"] for r in self._rows(verify.test_commands(self.tables.files), "position")],
            "historically_co_failing_tests": [r["path"] for r in self._rows(verify.tests_along(self.tables.cochange, changes), "path")],
        }

    def _history(self) -> DataFrame:
        return reviews.with_pull_requests(self.tables.review_comments, self.tables.pull_requests)

    def _get_review_history(self, path: str | None, task: str | None) -> dict[str, Any]:
        if self.tables.review_comments is None:
            return {"comments": []}
        found = self._history()
        if path:
            found = found.where(F.col("path") == path)
        shown = ["pr_number", "pr_title", "pr_merged", "path", "line", "body", "author", "created_at"]
        if task:
            numbered = found.withColumn("id", F.xxhash64("pr_number", "path", "line", "created_at", "body"))
            best = reviews.ranked_by_task(numbered, self._query(task))
            rows = self._rows(numbered.join(best, "id").select(*shown, "rank"), "rank", "pr_number")
        else:
            rows = self._rows(found.select(*shown).orderBy("created_at", "pr_number").limit(reviews.HISTORY_ROWS), "created_at", "pr_number")
        return {"comments": rows[: reviews.HISTORY_ROWS]}


def schemas() -> list[dict[str, Any]]:
    """The catalogue of tools with the JSON schemas of their arguments."""
    kind = lambda k: {"type": "array", "items": {"type": "string"}} if k == "array" else {"type": k}
    return [
        {"name": name, "inputSchema": {"type": "object", "properties": {a: kind(k) for a, k in args.items()}, "required": [] if name in OPTIONAL else list(args)}}
        for name, args in ARGUMENTS.items()
    ]


def respond(message: dict[str, Any], call: Callable[[str, dict[str, Any]], Any]) -> dict[str, Any] | None:
    """The answer to a JSON-RPC message; notifications get none, a tool that raises gives an error result."""
    method, asked, params = message.get("method", ""), message.get("id"), message.get("params") or {}
    if asked is None:
        return None
    if method == "initialize":
        result: Any = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "evidentia", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": schemas()}
    elif method == "tools/call":
        try:
            text, failed = json.dumps(call(params.get("name", ""), params.get("arguments") or {}), default=str), False
        except Exception as e:  # the caller hears of it; the loop goes on
            text, failed = f"{type(e).__name__}: {e}", True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        return {"jsonrpc": "2.0", "id": asked, "error": {"code": -32601, "message": f"method not found: {method}"}}
    return {"jsonrpc": "2.0", "id": asked, "result": result}


def serve(call: Callable[[str, dict[str, Any]], Any], lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer messages, one a line, until the input ends; lines that are no JSON object are skipped."""
    for line in lines:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if isinstance(message, dict) and (answer := respond(message, call)) is not None:
            print(json.dumps(answer), file=out, flush=True)


def index(spark, root: str, reviews_folder: str | None = None) -> Repository:
    """The tables of a source tree and its git history, all supported files extracted, and those of ``ingest-github`` in a folder."""
    from .sources import github, inventory
    from .sources import history as log

    files = inventory.scan(spark, root, with_content=True)
    bodies = inventory.bodies(files)
    symbols, imports = inventory.extracted(files.select("path", "language").join(bodies, "path"))
    commits = log.commits_of_log(spark, log.git_log(root)).select((-F.col("ordinal")).alias("commit"), "ts", "file")
    known = files.select("path", "language", "size_bytes", "is_test").join(history.last_change(commits).select(F.col("file").alias("path"), F.col("ts").alias("last_commit_ts")), "path", "left")
    manifests = bodies.where(F.col("path").endswith("Cargo.toml")).select("path", F.col("source").alias("text"))
    past = github.loaded(spark, reviews_folder) if reviews_folder else {}
    return Repository(
        files=known, bodies=bodies.select("path", "body"), symbols=symbols, cochange=graph.known_cochange(history.cochange_edges(commits), known),
        imports=graph.import_edges(imports, known, manifests), pull_requests=past.get("pull_requests"), review_comments=past.get("review_comments"),
        chunks=inventory.chunks(bodies, symbols).drop("hash"), targets=imports,
    )


def newest_change(repository: Repository) -> int:
    """The time of the newest commit, or 0."""
    return repository.files.agg(F.max("last_commit_ts")).first()[0] or 0


def ingest_github(spark, root: str, folder: str, most: int) -> dict[str, int]:
    """Fetch the reviews of a repository's remote into tables below ``folder``; returns how many rows came."""
    from .sources import config, github

    remote = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, text=True, timeout=60, check=True).stdout.strip()
    slug = spark.range(1).select(repository_slug(F.lit(remote)).alias("slug")).first().slug
    if not slug.owner:
        raise ValueError(f"no owner and name in {remote}")
    tables = github.ingest(spark, github.Client(config.token() or "", slug.owner, slug.name), most)
    github.stored(tables, folder)
    return {name: df.count() for name, df in github.loaded(spark, folder).items()}


def main(arguments: list[str] | None = None) -> None:
    from .session import session
    from .sources import config

    parser = argparse.ArgumentParser(prog="evidentia", description="Answer questions about a repository over JSON-RPC lines, or fetch its reviews.")
    parser.add_argument("command", nargs="?", choices=("serve", "ingest-github"), default="serve")
    parser.add_argument("--repo", default=".")
    parser.add_argument("--reviews", help="folder of the review tables")
    parser.add_argument("--most", type=int, default=100, help="pull requests to fetch")
    parser.add_argument("--as-of", type=int, help="unix seconds that recency counts from; by default the time of the newest commit")
    given = parser.parse_args(arguments)
    spark = session()
    if given.command == "ingest-github":
        if not given.reviews:
            parser.error("ingest-github needs --reviews")
        print(json.dumps(ingest_github(spark, given.repo, given.reviews, given.most)))
        return
    tables = index(spark, given.repo, given.reviews)
    as_of = newest_change(tables) if given.as_of is None else given.as_of
    serve(Tools(tables, as_of, config.weights(given.repo), config.profiles(given.repo), config.stopwords(given.repo)).call)


if __name__ == "__main__":
    main()
