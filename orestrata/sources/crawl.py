"""Crawling a catalog page by page and fetching study files, both resumable.

A transport is what talks to a service; here it is any object with the named
methods, so tests use folders. State is a table of what is there already:
whoever runs again does only what is missing.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orestrata.functions.text import storage_bucket
from orestrata.sources.paged import fetch

#: Statuses of passing trouble, attempts, first wait in seconds.
PASSING = frozenset({429, 500, 502, 503, 504})
ATTEMPTS = 5
SEARCH_SCHEMA = "uid long, accession string, entrytype string, title string, summary string"


class Pacer:
    """At most so many requests a second, and none after a deadline."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 1.0 / per_second, clock, sleep, 0.0

    def wait(self, deadline: float | None = None) -> None:
        now = self.clock()
        start = max(now, self.next)
        if deadline is not None and start >= deadline:
            raise TimeoutError("no request fits before the deadline")
        if start > now:
            self.sleep(start - now)
        self.next = start + self.gap


def page_rows(page: dict) -> list[dict]:
    """The records of a page in the order of its uids; uids without a record are skipped."""
    return [page[str(u)] for u in page.get("uids", []) if str(u) in page]


def crawl(
        transport, term: str, seen: Iterable[str] = (), start: int = 0, limit: int | None = None, page_size: int = 500, refresh: bool = False,
        save: Callable[[int], None] = lambda at: None) -> Iterable[dict]:
    """New records of a keyword search, page by page from ``start``, newest first.

    Accessions seen before are skipped. With ``refresh`` the crawl begins at the
    top and stops at the first page that holds nothing new. ``save`` is given the
    offset after each page, to resume from; an empty page ends the crawl.
    """
    known, at = set(seen), 0 if refresh else start
    total = transport.count(term)
    total = total if limit is None else min(total, limit)
    while at < total:
        size = min(page_size, total - at)
        records = fetch(transport, term, at, size)
        if not records:
            return
        new = 0
        for r in records:
            key = r.get("accession")
            if key and key in known:
                continue
            if key:
                known.add(key)
            new += 1
            yield r
        at += len(records)
        if refresh and not new:
            return
        if not refresh:
            save(at)


class Checkpoint:
    """The offset a crawl of a term has reached, in a small file that is only ever replaced whole; another term starts at 0."""

    def __init__(self, path: str, term: str) -> None:
        self.path, self.term = path, term

    def load(self) -> int:
        try:
            with open(self.path, encoding="utf-8") as f:
                state = json.load(f)
        except (OSError, ValueError):
            return 0
        return int(state.get("at", 0)) if state.get("term") == self.term else 0

    def save(self, at: int) -> None:
        with open(f"{self.path}.part", "w", encoding="utf-8") as f:
            json.dump({"term": self.term, "at": at}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.part", self.path)


def crawl_into(spark: SparkSession, transport, term: str, path: str, checkpoint: Checkpoint, **more) -> int:
    """New records of a crawl, appended to a table of JSON lines; how many. What the table holds is skipped."""
    from orestrata.sources.files import append_jsonl, read_seen

    reached = start = checkpoint.load()
    held, n = [], 0

    def note(at: int) -> None:
        nonlocal reached
        reached = at

    def flush() -> None:
        # The offset is that of whole pages; rows of an unfinished one are seen when it is read again.
        if held:
            append_jsonl(spark.createDataFrame(held, SEARCH_SCHEMA), path)
            held.clear()
        checkpoint.save(reached)

    for r in crawl(transport, term, read_seen(spark, path, SEARCH_SCHEMA, "accession"), start=start, save=note, **more):
        held.append((r.get("uid"), r.get("accession"), r.get("entrytype"), r.get("title"), r.get("summary")))
        n += 1
        if len(held) >= 10_000:
            flush()
    flush()
    return n


def remote_path(key):
    """Where a study's file lies under its root: bucket, study, folder, file."""
    return F.concat(storage_bucket(key), F.lit("/"), key, F.lit("/soft/"), key, F.lit("_family.soft.gz"))


def fetch_files(keys: DataFrame, get: Callable[[str], tuple[int, bytes]], key: str = "gse", attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, status, detail, content): every key's file by ``get(path) -> (status, content)``, on the executors.

    404 is ``pending``; statuses of passing trouble and connection errors are
    tried again with doubling waits and are then a ``fail``, as is all else.
    """
    rows = keys.select(F.col(key).alias("key"), remote_path(F.col(key)).alias("path"))

    def one(path: str) -> tuple[str, str | None, bytes | None]:
        detail = None
        for n in range(attempts):
            try:
                status, content = get(path)
            except OSError as e:
                status, detail = None, f"{type(e).__name__}"
            else:
                if status == 200:
                    return "ok", None, content
                if status == 404:
                    return "pending", "404", None
                detail = str(status)
                if status not in PASSING:
                    return "fail", detail, None
            if n + 1 < attempts:
                wait(2.0 ** n)
        return "fail", detail, None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                status, detail, content = one(path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.string()), pa.array([status]), pa.array([detail], pa.string()), pa.array([content], pa.binary())], names=["key", "status", "detail", "content"])

    return rows.mapInArrow(run, "key string, status string, detail string, content binary")


def brief_text(status: int, body: str) -> tuple[str, str]:
    """(status, text or detail) of a metadata-only answer; a success whose body isn't a study text is a failure."""
    if status == 200 and body.lstrip().startswith("^"):
        return "ok", body
    return ("pending", "404") if status == 404 else ("fail", "not a study text" if status == 200 else str(status))


def outcomes(fetched: DataFrame) -> DataFrame:
    """(status, n, n_invalid) of fetched files with ``problems``, an array of broken rules."""
    return fetched.groupBy("status").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "ok") & (F.size("problems") > 0)).alias("n_invalid"))


def todo(catalog: DataFrame, done: DataFrame, key: str = "gse") -> DataFrame:
    """Catalog keys, once each, without a finished file."""
    return catalog.where(F.col(key).isNotNull()).select(key).distinct().join(done.select(key), key, "left_anti")
