"""A Python data source for paged interfaces: one input partition per time window, fetched where the task runs.

The way to a page is the option ``fetch``, "module:function"; the function gets (symbol, from_ms, to_ms, options) and
returns rows (ts_ms, o, h, l, c, v). ``tidemill.sources.paged:from_folder`` reads pages stored as JSON files, which is
also how the source is tested without a network.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts_ms bigint, o double, h double, l double, c double, v double"


class Window(InputPartition):
    def __init__(self, symbol: str, lo: int, hi: int) -> None:
        self.symbol, self.lo, self.hi = symbol, lo, hi


class PagedBars(DataSource):
    """Options: symbols (comma-separated), from_ms, to_ms, bar_ms, page (bars of one window), fetch, and the fetcher's own."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Window]:
        o = self.options
        lo, hi, step = int(o["from_ms"]), int(o["to_ms"]), int(o.get("bar_ms", 60_000)) * int(o.get("page", 1000))
        return [Window(s.strip(), a, min(a + step, hi)) for s in o["symbols"].split(",") if s.strip() for a in range(lo, hi, step)]

    def read(self, partition: Window) -> Iterator[tuple]:
        module, _, function = self.options.get("fetch", "tidemill.sources.paged:from_folder").partition(":")
        fetch = getattr(importlib.import_module(module), function)
        last: dict[int, tuple] = {}
        for row in fetch(partition.symbol, partition.lo, partition.hi, self.options):
            if partition.lo <= int(row[0]) < partition.hi:
                last[int(row[0])] = tuple(float(x) for x in row[1:6])  # the later page wins
        for ts in sorted(last):
            yield (partition.symbol, ts, *last[ts])


def from_folder(symbol: str, lo: int, hi: int, options: dict[str, str]) -> Iterator[list]:
    """Rows of the files SYMBOL*.json of the folder ``folder``, in the order of their names."""
    folder = options["folder"]
    for name in sorted(os.listdir(folder)):
        if name.startswith(symbol) and name.endswith(".json"):
            with open(os.path.join(folder, name)) as f:
                yield from json.load(f)
