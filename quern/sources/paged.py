"""A paged collection as a Python data source, batch and streaming.

Options: ``fetcher`` names a function ``module:function(collection, token) -> (rows, next token or None)``; rows are (id, body). ``collections`` is a
comma-separated list. A batch read has one partition for each collection. A stream's offset holds number and token of the next page of every collection, so that a restart
goes on from the last committed page. Failed fetches are tried again ``tries`` times with doubling pauses. After :class:`StaleToken` a collection is walked again from its
start up to the page that was wanted, and the pages before it are not given again. Of rows that stand on two neighbouring pages the first counts; what is kept is the ids of one page.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "collection string, page int, id string, body string"


#: The offset of a collection that has been read to its end.
COMPLETE = "\0"


class StaleToken(Exception):
    """The server no longer knows the token."""


class Transient(Exception):
    """A failure that may pass: refused connections, 429 and 5xx answers."""


def fetcher(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def patient(fetch: Callable, collection: str, token: str | None, tries: int, pause: float) -> tuple[list, str | None]:
    for attempt in range(tries):
        try:
            return fetch(collection, token)
        except Transient:
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise ValueError("tries must be positive")


class Collection(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Collection]:
        return [Collection(c.strip()) for c in self.options["collections"].split(",") if c.strip()]

    def read(self, partition: Collection) -> Iterator[tuple]:
        fetch, token, page, done, restarts = fetcher(self.options["fetcher"]), None, 0, 0, 0
        before: set[str] = set()
        while True:
            try:
                rows, token = patient(fetch, partition.name, token, int(self.options.get("tries", 5)), float(self.options.get("pause", 1)))
            except StaleToken:
                restarts += 1
                if restarts > 3:
                    raise
                token, page = None, 0
                continue
            if page == done:
                own: set[str] = set()
                for key, body in rows:
                    if key not in before and key not in own:
                        yield partition.name, page, key, body
                    own.add(key)
                before, done = own, page + 1
            page += 1
            if token is None:
                return


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.names = [c.strip() for c in options["collections"].split(",") if c.strip()]

    def initialOffset(self) -> dict:
        return {c: "" for c in self.names}

    def _page(self, collection: str, at: str) -> tuple[list, str]:
        """The page at an offset and the offset behind it. A token that the server forgot is found again by walking from the start."""
        if at == COMPLETE:
            return [], at
        fetch, tries, pause = fetcher(self.options["fetcher"]), int(self.options.get("tries", 5)), float(self.options.get("pause", 1))
        number, _, token = at.partition("\t")
        page = int(number or 0)
        try:
            rows, token = patient(fetch, collection, token or None, tries, pause)
        except StaleToken:
            token = None
            for step in range(page + 1):
                rows, token = patient(fetch, collection, token, tries, pause)
                if token is None and step < page:  # the collection has become shorter
                    return [], COMPLETE
        return [(collection, page, k, b) for k, b in rows], COMPLETE if token is None else f"{page + 1}\t{token}"

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for c in self.names:
            got, end[c] = self._page(c, start.get(c, ""))
            rows += got
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for c in self.names:
            if start.get(c) != end.get(c):
                rows += self._page(c, start.get(c, ""))[0]
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)
