"""A paged remote catalog as a Spark data source.

The transport is a class with ``count(term)`` and ``page(term, start, size)``;
a page that comes back too large raises ``PageTooLarge`` and is halved until
single records, and a single one that still is too large is skipped. Offline a
folder of JSON stands in.
"""

from __future__ import annotations

import importlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageTooLarge(Exception):
    """The answer exceeds what the service may send at once."""


class FolderTransport:
    """Records of ``catalog.json`` in a folder whose title holds the term; pages above ``most`` records, or with one marked oversized, are too large."""

    def __init__(self, options: dict[str, str]) -> None:
        with open(os.path.join(options["folder"], "catalog.json"), encoding="utf-8") as f:
            self.records = json.load(f)
        self.most = int(options.get("most", 1 << 30))

    def _found(self, term: str) -> list[dict]:
        return [r for r in self.records if term.lower() in r.get("title", "").lower()]

    def count(self, term: str) -> int:
        return len(self._found(term))

    def page(self, term: str, start: int, size: int) -> list[dict]:
        part = self._found(term)[start:start + size]
        if len(part) > self.most or any(r.get("oversized") for r in part):
            raise PageTooLarge
        return part


def fetch(transport, term: str, start: int, size: int) -> list[dict]:
    """A page, halved where it is too large."""
    try:
        return transport.page(term, start, size)
    except PageTooLarge:
        if size <= 1:
            return []
        half = size // 2
        return fetch(transport, term, start, half) + fetch(transport, term, start + half, size - half)


class _Page(InputPartition):
    def __init__(self, start: int, size: int) -> None:
        self.start, self.size = start, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _transport(self):
        module, _, name = self.options.get("transport", "orestrata.sources.paged:FolderTransport").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self):
        size = int(self.options.get("page_size", 500))
        n = self._transport().count(self.options["term"])
        return [_Page(s, min(size, n - s)) for s in range(0, n, size)] or [_Page(0, 0)]

    def read(self, partition):
        if not partition.size:
            return
        for r in fetch(self._transport(), self.options["term"], partition.start, partition.size):
            yield (r.get("uid"), r.get("accession"), r.get("entrytype"), r.get("title"), r.get("summary"))


class PagedCatalog(DataSource):
    """``spark.dataSource.register(PagedCatalog)``, then ``spark.read.format("paged_catalog")``; one partition per page."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "uid long, accession string, entrytype string, title string, summary string"

    def reader(self, schema):
        return _Reader(dict(self.options))
