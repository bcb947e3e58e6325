"""Look-ups in outside services behind one small protocol, always on the driver, with a cache that is a table's worth of JSON.

`Client.fetch` returns results, [] for a true empty answer or None for a failure; the offline client answers from a
dictionary.  Executors never call a service: distinct queries are looked up once and joined back as a table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class BudgetExhausted(Exception):
    """The service asks for a pause beyond the limit: stop, don't wait."""


class Client(Protocol):
    def fetch(self, query: str, cc: str | None) -> list[dict] | None: ...


class Offline:
    def __init__(self, answers: dict[tuple[str, str | None], list[dict]]):
        self.answers = answers

    def fetch(self, query, cc):
        return self.answers.get((query, cc), [])


class Throttled:
    """A client around `send(query, cc) -> (status, retry_after, results)`: pace, retries with growing pauses, budget stop."""

    def __init__(self, send: Callable, pause: float = 0.15, retries: int = 5, base: float = 1.5, stop_after: float = 120, sleep=time.sleep, clock=time.monotonic):
        self.send, self.pause, self.retries, self.base, self.stop_after, self.sleep, self.clock = send, pause, retries, base, stop_after, sleep, clock
        self.last = -1e9

    def fetch(self, query, cc):
        for attempt in range(self.retries):
            wait = self.last + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                status, after, results = self.send(query, cc)
            except OSError:
                status, after, results = 0, None, None
            if status == 200:
                return results or []
            if status == 429 and after is not None and after > self.stop_after:
                raise BudgetExhausted(f"{after} s")
            if 400 <= status < 500 and status != 429:
                return None
            self.sleep(after if status == 429 and after else self.base**attempt)
        return None


class Cache:
    """JSON answers by query and country; keep_empty says whether a true empty answer is kept or asked again."""

    def __init__(self, path: str | None = None, keep_empty: bool = True):
        self.path, self.keep_empty = path, keep_empty
        raw = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        self.data = {k: v for k, v in raw.items() if v or keep_empty}

    @staticmethod
    def key(query: str, cc: str | None) -> str:
        return f"{query}|||{cc}"

    def get(self, query, cc):
        return self.data.get(self.key(query, cc))

    def put(self, query, cc, results):
        if results is not None and (results or self.keep_empty):
            self.data[self.key(query, cc)] = results

    def save(self):
        if self.path:
            Path(self.path).write_text(json.dumps(self.data, ensure_ascii=False))


def search(client: Client, cache: Cache, steps: Iterable[tuple[str, str | None]]) -> list[dict] | None:
    """The first non-empty answer along the steps; None if a failure leaves the question open."""
    failed = False
    for query, cc in steps:
        found = cache.get(query, cc)
        if found is None:
            found = client.fetch(query, cc)
            failed |= found is None
            cache.put(query, cc, found)
        if found:
            return found
    return None if failed else []


def fetch_all(ids: Iterable[str], fetch: Callable[[str], list[dict] | None], threads: int = 6) -> dict[str, list[dict] | None]:
    """One fetch for each distinct id over a small pool; for example institutions or employments by id."""
    ids = list(dict.fromkeys(ids))
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(ids, pool.map(fetch, ids), strict=True))


def host_confirmed(results: list[dict], host_id: str) -> tuple[dict | None, str]:
    """(author, host) for the first author affiliated with the host, else (first author, nohost), else (None, none)."""
    for r in results:
        if host_id in (r.get("affiliations") or []):
            return r, "host"
    return (results[0], "nohost") if results else (None, "none")


RESULT = "array<struct<id:string,display_name:string,alternatives:array<string>,relevance:double,ror:string>>"


def as_table(spark: SparkSession, cache: Cache) -> DataFrame:
    """query, cc, results of a cache, for joins."""
    rows = []
    for key, results in cache.data.items():
        query, _, cc = key.partition("|||")
        own = [(r.get("id"), r.get("display_name"), (r.get("display_name_alternatives") or []) + (r.get("display_name_acronyms") or []), r.get("relevance_score"), r.get("ror")) for r in results]
        rows.append((query, None if cc == "None" else cc, own))
    return spark.createDataFrame(rows, f"query string, cc string, results {RESULT}")
