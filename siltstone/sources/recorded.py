"""A search service as a data source, replayed from recorded responses.

``spark.read.format("recorded_search").option("path", folder).load()``; one
partition per response file, year ranges are pushed into the reader.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class RecordedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "title string, year int, doi string, score double, mode string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.mode, self.lo, self.hi = options["path"], options.get("mode", "rest"), None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if f.attribute == ("year",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = f.value + isinstance(f, GreaterThan)
            elif f.attribute == ("year",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.hi = f.value - isinstance(f, LessThan)
            elif f.attribute == ("year",) and isinstance(f, EqualTo):
                self.lo = self.hi = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            try:
                body = json.load(f)
            except ValueError:
                return
        for item in body.get("results", body) if isinstance(body, dict) else body:
            if not isinstance(item, dict) or not item.get("title"):
                continue
            year = item.get("year")
            if self.lo is not None and (year is None or year < self.lo) or self.hi is not None and (year is None or year > self.hi):
                continue
            yield item["title"], year, item.get("doi") or None, float(item.get("score") or 0.5), self.mode
