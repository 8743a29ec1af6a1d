"""A client for pull-request payloads, which runs on the driver and fetches all pages, and the tables made of them."""

from __future__ import annotations

import json
import ssl
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintain import upsert
from ..operators.tables import SCHEMAS
from ..session import saved
from . import history

PAGE = 100


class Client:
    """Reads a repository's closed pull requests and what belongs to them. Status codes other than 2xx raise with the start of the answer."""

    def __init__(self, token: str, owner: str, name: str, api: str = "https://api.github.com", ca_file: str | None = None, timeout: float = 30):
        if not token:
            raise ValueError("a token is needed")
        self.base, self.token, self.timeout = f"{api}/repos/{owner}/{name}", token, timeout
        self.context = ssl.create_default_context(cafile=ca_file)

    def get(self, path: str) -> str:
        request = urllib.request.Request(f"{self.base}/{path}", headers={"Authorization": f"Bearer {self.token}", "Accept": "application/vnd.github+json", "User-Agent": "evidentia"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout, context=self.context) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e.code} for {path}: {e.read().decode('utf-8', 'replace')[:200]}") from e

    def pages(self, path: str, most: int | None = None) -> Iterator[str]:
        """Payloads page by page, each a JSON array, until one is short or ``most`` rows have come."""
        number, left = 1, most
        while left is None or left > 0:
            size = PAGE if left is None else min(PAGE, left)
            text = self.get(f"{path}{'&' if '?' in path else '?'}per_page={size}&page={number}")
            yield text
            if len(json.loads(text)) < size:
                return
            number, left = number + 1, None if left is None else left - size

    def closed_pull_requests(self, most: int) -> Iterator[str]:
        return self.pages("pulls?state=closed&sort=updated&direction=desc", most)

    def of_pull_request(self, number: int, what: str) -> Iterator[str]:
        """``files``, ``commits`` or ``comments`` of a pull request."""
        return self.pages(f"pulls/{number}/{what}")


def ingest(spark: SparkSession, client: Client, most: int) -> dict[str, DataFrame]:
    """The tables of the newest closed pull requests: payloads are fetched here, page by page, and parsed by the cluster."""
    pages = [(text,) for text in client.closed_pull_requests(most)]
    requests = history.pull_requests(spark.createDataFrame(pages, "payload string")).dropDuplicates(["number"])
    numbers = [r.number for r in requests.select("number").orderBy("number").collect()]  # ``most`` at most
    parsers = {"files": history.pr_files, "commits": history.pr_commits, "comments": history.review_comments}
    tables = {"pull_requests": requests}
    for what, parse in parsers.items():
        rows = [(n, whole_array(client.of_pull_request(n, what))) for n in numbers]
        tables[{"files": "pr_files", "commits": "pr_commits", "comments": "review_comments"}[what]] = parse(spark.createDataFrame(rows, "pr_number bigint, payload string"))
    return tables


def whole_array(pages: Iterator[str]) -> str:
    """Pages of JSON arrays as one array, so that places count through."""
    return json.dumps([row for page in pages for row in json.loads(page)])


def stored(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables below ``folder``: requests by number, and what belongs to a request replaces all that was stored of it."""
    numbers = tables["pull_requests"].select(F.col("number").alias("pr_number"))
    for name, fresh in tables.items():
        spark, path = fresh.sparkSession, f"{folder.rstrip('/')}/{name}"
        try:
            old = spark.read.schema(SCHEMAS[name]).parquet(path)
            old.limit(0).count()
        except AnalysisException:
            old = None
        fresh = fresh.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
        if old is not None:
            fresh = upsert(old, fresh, ["number"]) if name == "pull_requests" else old.join(numbers, "pr_number", "left_anti").unionByName(fresh)
        saved(fresh, name).write.mode("overwrite").parquet(path)  # the old table is read to its end before it goes


def loaded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``stored``."""
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}") for name in ("pull_requests", "pr_files", "pr_commits", "review_comments")}
