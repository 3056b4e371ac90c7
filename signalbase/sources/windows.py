"""Search captures by time windows that split where an answer is full.

The network client is passed in. First windows are spread over tasks; each task halves
its own full windows, so no window waits for the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame

FULL, LEAST, DEPTH = 250, timedelta(hours=2), 6
RETRIED = frozenset({429, 500, 502, 503, 504})
Search = Callable[[str, datetime, datetime], list[dict]]


class Busy(Exception):
    """A client's answer that is worth another try, with its status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retried(call: Callable[[], list[dict]], tries: int = 4, wait: Callable[[float], None] = time.sleep, first: float = 1.0) -> list[dict]:
    """``call`` again after busy answers, waiting twice as long each time."""
    for i in range(tries):
        try:
            return call()
        except Busy as fault:
            if fault.status not in RETRIED or i == tries - 1:
                raise
            wait(first * 2**i)
    raise ValueError("tries must be positive")


def leaves(search: Search, query: str, first: datetime, last: datetime, known: frozenset = frozenset()) -> Iterator[tuple[datetime, datetime, list[dict]]]:
    """(start, end, items) of windows in order; a full one of more than ``LEAST`` is
    halved, up to ``DEPTH`` times. Windows in ``known`` (query, start, end) are skipped."""
    todo = [(first, last, 0)]
    while todo:
        start, end, depth = todo.pop()
        if (query, start, end) in known:
            continue
        items = search(query, start, end)
        if len(items) >= FULL and end - start > LEAST and depth < DEPTH:
            middle = start + (end - start) / 2
            todo += [(middle, end, depth + 1), (start, middle, depth + 1)]
        else:
            yield start, end, items


def capture(windows: DataFrame, client: Callable[[], Search]) -> DataFrame:
    """windows: query, first, last -> (query, first, last, n_items, truncated, error)
    and the items' urls; a failed window is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = client()
        for frame in frames:
            for query, first, last in zip(frame["query"], frame["first"], frame["last"]):
                rows = []
                try:
                    for start, end, items in leaves(lambda q, a, b: retried(lambda: search(q, a, b)), query, first, last):
                        rows.append((query, start, end, len(items), len(items) >= FULL, None, [i.get("url") for i in items]))
                except Exception as fault:  # the network is outside the engine
                    rows.append((query, first, last, 0, False, str(fault), []))
                yield pd.DataFrame(rows, columns=["query", "first", "last", "n_items", "truncated", "error", "urls"])

    return windows.select("query", "first", "last").mapInPandas(run, "query string, first timestamp, last timestamp, n_items int, truncated boolean, error string, urls array<string>")
