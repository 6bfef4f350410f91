"""Sources that users plug in: a class with splits and a fetch becomes a format of Spark, for batches and for streams.

A source says who it is (id, type, channels), how its items are split, and how a split is fetched. The driver only sees
splits; tasks fetch them as Arrow batches. Filters that Spark pushes are handed to the source, which may take them over.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Context:
    """What a fetch goes by: the options of the read, how many items at most, the filters that the source took over."""

    options: dict[str, str]
    limit: int | None = None
    filters: tuple[tuple[str, str, Any], ...] = ()


@dataclass
class Split(InputPartition):
    """A part of a source that one task fetches: what names it, its rows, and how many of them are wanted."""

    name: Any
    rows: int
    wanted: int | None = None


class Source:
    """Base class of plug-ins. Class attributes name the source; schema is DDL of what fetch yields."""

    id = ""
    type = ""
    channels: tuple[str, ...] = ()
    schema = ""

    def splits(self, ctx: Context) -> list[Split]:
        """All splits in a fixed order; new ones only ever come behind old ones, so that a stream can go by their number."""
        raise NotImplementedError

    def takes(self, filters: Iterable[tuple[str, str, Any]]) -> list[bool]:
        """Which of the filters (column, operator, value) the source applies itself; the others stay with Spark."""
        return [False for _ in filters]

    def fetch(self, split: Split, ctx: Context) -> Iterator[pa.RecordBatch]:
        """The items of a split, on an executor."""
        raise NotImplementedError


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNotNull: "is not null"}


def _plain(f: Filter) -> tuple[str, str, Any] | None:
    """(column, operator, value) of a filter on a plain column."""
    kind = _OPERATORS.get(type(f))
    return (f.attribute[0], kind, None if kind == "is not null" else f.value) if kind and len(f.attribute) == 1 else None


def _cut(splits: list[Split], limit: int | None) -> list[Split]:
    """The splits of the first `limit` items."""
    if limit is None:
        return splits
    out = []
    for s in splits:
        if limit <= 0:
            break
        out.append(replace(s, wanted=min(s.rows, limit)))
        limit -= s.rows
    return out


def _fetched(source: Source, split: Split, ctx: Context) -> Iterator[pa.RecordBatch]:
    left = split.wanted
    for batch in source.fetch(split, ctx):
        if left is not None:
            batch = batch.slice(0, left)
            left -= batch.num_rows
        if batch.num_rows:
            yield batch
        if left == 0:
            return


class _Reader(DataSourceReader):
    def __init__(self, source: Source, ctx: Context):
        self.source, self.ctx = source, ctx

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        if self.ctx.limit is not None:  # the limit counts items as the source has them, before any filter
            return filters
        plain = [_plain(f) for f in filters]
        took = iter(self.source.takes([p for p in plain if p]))
        taken = [bool(p) and next(took) for p in plain]
        self.ctx = replace(self.ctx, filters=tuple(p for p, t in zip(plain, taken, strict=True) if t))
        return [f for f, t in zip(filters, taken, strict=True) if not t]

    def partitions(self) -> list[Split]:
        return _cut(self.source.splits(self.ctx), self.ctx.limit)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _fetched(self.source, partition, self.ctx)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of splits: what lies between two offsets is the same whenever it is read."""

    def __init__(self, source: Source, ctx: Context):
        self.source, self.ctx = source, ctx

    def initialOffset(self) -> dict:  # noqa: N802
        return {"splits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"splits": len(self.source.splits(self.ctx))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.source.splits(self.ctx)[start["splits"] : end["splits"]]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _fetched(self.source, partition, self.ctx)


def format_of(source: type[Source]) -> type[DataSource]:
    """Spark's class for a plug-in, under the name of its id. Options are the source's own; limit bounds a batch read."""

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return source.id

        def schema(self) -> str:
            return source.schema

        def _context(self) -> Context:
            limit = self.options.get("limit")
            return Context(dict(self.options), None if limit is None else int(limit))

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(source(), self._context())

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(source(), replace(self._context(), limit=None))

    return Format


def register(spark: SparkSession, source: type[Source]) -> str:
    """Makes the plug-in a format of the session; returns the format's name."""
    spark.dataSource.register(format_of(source))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return source.id


# a plug-in over Parquet files ---------------------------------------------------------------------------------------


@dataclass
class ParquetItems(Source):
    """Items in Parquet files of documents: a split is a row group, and filters are applied to its statistics, then to its rows.

    Option path: a file or folder that all executors reach, by a local path or a URI that Arrow knows. Files count in
    the order of their names. A row group whose statistics rule out a filter is not fetched at all.
    """

    id = "feedloom_items"
    type = "rss"
    channels = ("tech",)
    schema = "ord bigint, source string, lang string, body string, source_id string, source_type string, channels array<string>"
    names: dict[str, str] = field(default_factory=lambda: {"ord": "doc_id", "source": "source", "lang": "lang", "body": "text"})

    @staticmethod
    def _files(path: str) -> tuple[Any, list[str]]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        return store, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet"))

    def takes(self, filters: Iterable[tuple[str, str, Any]]) -> list[bool]:
        return [column in self.names for column, _, _ in filters]

    def splits(self, ctx: Context) -> list[Split]:
        import pyarrow.parquet as pq

        store, files = self._files(ctx.options["path"])
        out = []
        for path in files:
            with store.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            columns = [meta.schema.column(i).name for i in range(meta.num_columns)]
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = {c: group.column(columns.index(n)).statistics for c, n in self.names.items() if n in columns}
                if all(self._possible(stats.get(c), op, value) for c, op, value in ctx.filters):
                    out.append(Split((path, g), group.num_rows))
        return out

    @staticmethod
    def _possible(stats: Any, op: str, value: Any) -> bool:
        if stats is None or not stats.has_min_max or op == "is not null":
            return True
        if op == "in":
            return any(stats.min <= v <= stats.max for v in value if v is not None)
        return {"=": lambda: stats.min <= value <= stats.max, ">": lambda: stats.max > value, ">=": lambda: stats.max >= value, "<": lambda: stats.min < value, "<=": lambda: stats.min <= value}[op]()

    def fetch(self, split: Split, ctx: Context) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = self._files(split.name[0])
        tests = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
        with store.open_input_file(split.name[0]) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=2000, row_groups=[split.name[1]], columns=list(self.names.values())):
                for column, op, value in ctx.filters:
                    x = batch.column(batch.schema.get_field_index(self.names[column]))
                    keep = pc.is_valid(x) if op == "is not null" else pc.is_in(x, pa.array([v for v in value if v is not None], x.type)) if op == "in" else tests[op](x, pa.scalar(value, x.type))
                    batch = batch.filter(keep)
                n = batch.num_rows
                own = [batch.column(batch.schema.get_field_index(c)) for c in self.names.values()]
                yield pa.RecordBatch.from_arrays([*own, pa.array([self.id] * n, pa.string()), pa.array([self.type] * n, pa.string()), pa.array([list(self.channels)] * n, pa.list_(pa.string()))], [*self.names, "source_id", "source_type", "channels"])


def describe(source: type[Source]) -> str:
    """A source's registry entry as JSON."""
    return json.dumps({"id": source.id, "type": source.type, "channels": list(source.channels)})
