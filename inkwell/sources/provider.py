"""A provider as a Spark data source (X3, S1, S2): captured rows with predicate pushdown.

``spark.dataSource.register(PaperFeed)``, then
``spark.read.format("paper_feed").option("path", folder).load()``. Each file of
the folder is one partition, read through the file system that the path names;
filters on year, date and citations are applied while reading, as a provider's
search would, and the option ``fields`` names the fields to return. A limit is
the DataFrame's own, which counts over all files.
"""

from __future__ import annotations

import json
from io import TextIOWrapper
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThanOrEqual

FIELDS = {"paper_id": "string", "title": "string", "abstract": "string", "published": "string", "year": "int", "citation_count": "int"}


def _fields(options) -> list[str]:
    return [c.strip() for c in options.get("fields", ",".join(FIELDS)).split(",")]


def _store(path: str):
    """The file system and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.fields = _fields(options)
        self.kept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute in (("year",), ("published",), ("citation_count",)):
                self.kept.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, folder = _store(self.path)
        return [_File(f.path) for f in sorted(fs.get_file_info(FileSelector(folder)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition: _File) -> Iterator[tuple]:
        tests = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
        with TextIOWrapper(_store(self.path)[0].open_input_stream(partition.path), encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                if all(r.get(c) is not None and tests[op](r[c], v) for c, op, v in self.kept):
                    yield tuple(r.get(c) for c in self.fields)


class PaperFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_feed"

    def schema(self) -> str:
        return ", ".join(f"{c} {FIELDS[c]}" for c in _fields(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
