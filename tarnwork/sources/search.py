"""A data source over a paged search that gives at most so many results: its partitions are intervals of a number.

    spark.dataSource.register(IntervalSearchSource)
    spark.read.format("interval_search").options(client="module:function", lo=1, hi=100000, ...).load()

A client is a function (lo, hi, page, **options) -> (total, rows of the page); rows are (name, url, value, size in KB).
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwork.config import DEFAULTS
from tarnwork.sources.files import results_by_interval

PAGE, MOST = 100, 1000


class Interval(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class IntervalSearchSource(DataSource):
    """Options: client, lo, hi, most (results a search gives), largest_kb; others go to the client."""

    @classmethod
    def name(cls) -> str:
        return "interval_search"

    def schema(self) -> str:
        return "name string, url string, value long, size_kb long"

    def reader(self, schema):
        return IntervalSearchReader(dict(self.options))


class IntervalSearchReader(DataSourceReader):
    def __init__(self, options: dict):
        module, function = options.pop("client").split(":")
        self.client = getattr(importlib.import_module(module), function)
        self.lo, self.hi = int(options.pop("lo")), int(options.pop("hi"))
        self.most, self.largest = int(options.pop("most", MOST)), int(options.pop("largest_kb", DEFAULTS.largest_repository_kb))
        self.options = options

    def partitions(self):
        return [Interval(lo, hi) for lo, hi in results_by_interval(self.lo, self.hi, lambda lo, hi: self.client(lo, hi, 1, **self.options)[0], self.most)]

    def read(self, partition):
        """All pages of an interval, as far as the search gives them; too large entries and such without a name or URL are left out."""
        page, seen = 1, 0
        while seen < self.most:
            total, rows = self.client(partition.lo, partition.hi, page, **self.options)
            for name, url, value, size in rows:
                if name and url and (size or 0) <= self.largest:
                    yield name, url, value, size
            seen += len(rows)
            page += 1
            if not rows or seen >= total:
                return


_TABLES: dict[tuple[str, ...], list[tuple]] = {}


def parquet_client(lo: int, hi: int, page: int, *, path: str, fields: str) -> tuple[int, list[tuple]]:
    """A search over a local Parquet file, for tests and offline use; ``fields``: the columns of name, url, value and size."""
    key = (path, fields)
    if key not in _TABLES:
        import pyarrow.parquet as pq

        columns = fields.split(",")
        got = pq.read_table(path, columns=sorted(set(columns)))
        _TABLES[key] = sorted(zip(*[got.column(c).to_pylist() for c in columns]), key=lambda r: (r[2], str(r[0])))
    rows = [(str(n), str(u), v, s) for n, u, v, s in _TABLES[key] if v is not None and lo <= v <= hi]
    return len(rows), rows[(page - 1) * PAGE : page * PAGE]
