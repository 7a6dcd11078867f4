"""A Spark data source that fetches URLs in parallel with retries, and hands over what came back."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http import client
from urllib import error, request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Answers after which asking again is no use.
FINAL = {403, 404, 410, 429}


@dataclass(frozen=True)
class Policy:
    """How often, how long and how patiently to ask."""

    tries: int = 3
    connect_s: float = 15
    read_s: float = 15
    backoff: bool = True


SLOW, FAST = Policy(), Policy(tries=1, connect_s=5, read_s=8, backoff=False)


HEADERS = {
    "User-Agent": "brevier",
    "Accept": "text/html,application/xhtml+xml,application/rss+xml,application/xml;q=0.9,*/*;q=0.8",
}


def opener(policy: Policy) -> request.OpenerDirector:
    """Opens URLs: connect_s to connect, then read_s for each read."""

    def patient(kind):
        class Connection(kind):
            def connect(self):
                super().connect()
                self.sock.settimeout(policy.read_s)

        return Connection

    class Plain(request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(patient(client.HTTPConnection), req)

    class Secure(request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(patient(client.HTTPSConnection), req)

    return request.build_opener(Plain, Secure)


def url_fetch(url: str, policy: Policy) -> tuple[int, str]:
    """Status and body of one request."""
    try:
        with opener(policy).open(request.Request(url, headers=HEADERS), timeout=policy.connect_s) as found:
            return found.status, found.read().decode("utf-8", "replace")
    except error.HTTPError as e:
        return e.code, ""


def fetch(
    url: str,
    policy: Policy = SLOW,
    ask: Callable[[str, Policy], tuple[int, str]] = url_fetch,
    sleep: Callable[[float], None] = time.sleep,
) -> str | None:
    """Body of a URL, or None. Waits 1, 2, 4... seconds and up to one more between tries; some failures end it at once."""
    for k in range(policy.tries):
        try:
            status, body = ask(url, policy)
        except OSError as e:
            if "SSL" in type(e).__name__ or "CERTIFICATE" in str(e).upper():
                return None
            status, body = 0, ""
        if status == 200:
            return body
        if status in FINAL:
            return None
        if policy.backoff and k + 1 < policy.tries:
            sleep(2**k + random.random())
    return None


def fetched(urls: DataFrame, policy: Policy = SLOW, ask: Callable[[str, Policy], tuple[int, str]] = url_fetch) -> DataFrame:
    """(url, ok, body) for each row (url) of a frame of any size, asked for by the tasks that hold the rows."""

    def run(batches):
        for batch in batches:
            listed = batch.column(0).to_pylist()
            bodies = [fetch(u, policy, ask) for u in listed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b is not None for b in bodies]), pa.array(bodies, pa.string())], ["url", "ok", "body"]
            )

    return urls.select("url").mapInArrow(run, "url string, ok boolean, body string")


@dataclass
class Urls(InputPartition):
    urls: list[str]


class FetchReader(DataSourceReader):
    def __init__(self, urls: list[str], policy: Policy, per_task: int, ask):
        self.urls, self.policy, self.per_task, self.ask = urls, policy, per_task, ask

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[k : k + self.per_task]) for k in range(0, len(self.urls), self.per_task)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            body = fetch(url, self.policy, self.ask)
            yield url, body is not None, body


class FetchSource(DataSource):
    """spark.read.format("fetch").option("urls", "...\\n...").option("policy", "slow" or "fast").load(), for short lists."""

    ask = staticmethod(url_fetch)

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, ok boolean, body string"

    def reader(self, schema) -> FetchReader:
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        policy = FAST if self.options.get("policy") == "fast" else SLOW
        return FetchReader(urls, policy, int(self.options.get("perTask", 20)), self.ask)
