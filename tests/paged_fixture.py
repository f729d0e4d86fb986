"""A paged collection for the tests: pages of two, one overlap, one failure that passes, one stale token."""

from quern.sources.paged import StaleToken, Transient

calls: dict[str, int] = {}


def fetch(collection, token):
    calls[collection] = calls.get(collection, 0) + 1
    if collection == "flaky" and calls[collection] == 2:
        raise Transient("503")
    if collection == "stale" and calls[collection] == 2:
        raise StaleToken
    at = int(token or 0)
    rows = [(f"{collection}-{i}", f"body {i}") for i in range(max(0, at - 1), min(at + 2, 5))]
    return rows, None if at + 2 >= 5 else str(at + 2)
