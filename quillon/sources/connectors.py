"""Data sources of one's own, read by spark.read.format and spark.readStream.format after register().

    quillon_links     links of pages: a row for each, from Parquet files of pages (R05)
    quillon_jobs      render jobs from files that hold a JSON array each (R03)
    quillon_messages  a stream of messages, from a folder of Parquet files of events that only grows (K06)

Each takes option("path"), a folder or a file that driver and executors can open: a plain path, or a URI of a file system
that Arrow knows (file, hdfs, s3, gs). Tasks are row groups or files. Filters are taken over where the reader can use them
before it does any work: links leave out row groups by their statistics and pages before they are scraped, jobs are dropped
before their defaults are filled in. A filter that a reader can't use stays with Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from ..functions.shipping import ship

LINK = re.compile('<a href="([^"]*)">([^<]*)</a>')
#: Fields of a job: name, type, default of those that are absent, null or zero.
JOB = (("html", "string", None), ("out", "string", None), ("width", "int", 1000), ("height", "int", 800), ("dpr", "double", 1.0), ("selector", "string", None))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark offer filters to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LinkSource, JobSource, MessageSource):
        spark.dataSource.register(source)


def _files(path: str, suffixes: tuple[str, ...]) -> tuple[pafs.FileSystem, list[str]]:
    """The file system of path and the files there, by name; what begins with _ or . is none."""
    system, inner = pafs.FileSystem.from_uri(path) if re.match(r"\w+://|file:", path) else (pafs.LocalFileSystem(), path)
    if system.get_file_info(inner).type == pafs.FileType.File:
        return system, [inner]
    found = system.get_file_info(pafs.FileSelector(inner))
    return system, sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_." and f.base_name.endswith(suffixes))


@dataclass
class Group(InputPartition):
    """A row group of a Parquet file."""

    path: str
    group: int

    def table(self, path: str, columns: list[str]) -> pa.Table:
        system = _files(path, (".parquet",))[0]
        with system.open_input_file(self.path) as source:
            return pq.ParquetFile(source).read_row_group(self.group, columns)


@dataclass
class Part(InputPartition):
    path: str


_COMPARED = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _may_hold(op: str, value, low, high) -> bool:
    """Whether a value between low and high can meet the condition."""
    if low is None or high is None:
        return True
    return {"==": lambda: low <= value <= high, "in": lambda: any(v is not None and low <= v <= high for v in value), ">": lambda: high > value, ">=": lambda: high >= value, "<": lambda: low < value, "<=": lambda: low <= value}[op]()


def _holds(column: pa.ChunkedArray, op: str, value) -> pa.ChunkedArray:
    if op == "in":
        return pc.is_in(column, pa.array([v for v in value if v is not None], column.type))
    return {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[op](column, pa.scalar(value, column.type))


class LinkReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.conditions = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _COMPARED and f.attribute == ("page_id",):
                self.conditions.append((_COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Group]:
        system, paths = _files(self.path, (".parquet",))
        found = []
        for path in paths:
            with system.open_input_file(path) as source:
                meta = pq.ParquetFile(source).metadata
                at = [meta.schema.column(i).path for i in range(meta.num_columns)].index("page_id")
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    low, high = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
                    if all(_may_hold(op, value, low, high) for op, value in self.conditions):
                        found.append(Group(path, g))
        return found

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        pages = partition.table(self.path, ["page_id", "html"])
        for op, value in self.conditions:
            pages = pages.filter(_holds(pages["page_id"], op, value))
        for batch in pages.to_batches(max_chunksize=256):
            rows = [(page, pos, *link) for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if html for pos, link in enumerate(LINK.findall(html))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["page_id", "pos", "href", "label"])


class LinkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_links"

    def schema(self) -> str:
        return "page_id bigint, pos bigint, href string, label string"

    def reader(self, schema) -> LinkReader:
        return LinkReader(self.options["path"])


class JobReader(DataSourceReader):
    """Jobs whose fields do not fit are an error, as is a file that holds no array."""

    _TESTS = {StringContains: lambda text, v: v in text, StringStartsWith: str.startswith, StringEndsWith: str.endswith, EqualTo: lambda text, v: text == v}

    def __init__(self, path: str):
        self.path, self.conditions = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in self._TESTS and f.attribute in (("out",), ("html",)):
                self.conditions.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(p) for p in _files(self.path, (".json",))[1]]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:
            return
        with _files(self.path, (".json",))[0].open_input_stream(partition.path) as source:
            jobs = json.loads(source.read())
        for job in jobs:
            if all(job.get(name) is not None and self._TESTS[kind](job[name], value) for name, kind, value in self.conditions):
                yield tuple(job.get(name) or default for name, _, default in JOB)


class JobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_jobs"

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind, _ in JOB)

    def reader(self, schema) -> JobReader:
        return JobReader(self.options["path"])


@dataclass
class MessageReader(DataSourceStreamReader):
    """An offset is the number of files that have been read, in the order of their names; new files must come later in that
    order. Every run, and every batch of a run, goes on from the offset of the one before."""

    path: str
    done: int = field(default=0)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path, (".parquet",))[1])}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        system, paths = _files(self.path, (".parquet",))
        found = []
        for path in paths[start["files"] : end["files"]]:
            with system.open_input_file(path) as source:
                found += [Group(path, g) for g in range(pq.ParquetFile(source).num_row_groups)]
        return found

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows = partition.table(self.path, ["event_id", "event_type", "user_id", "value"])
        for batch in rows.to_batches(max_chunksize=1 << 14):
            kinds = batch.column(1).dictionary_encode()
            # Spark's to_json leaves out fields that are null.
            texts = [f'"tipo":{json.dumps(k, ensure_ascii=False)}' for k in kinds.dictionary.to_pylist()]
            kind = pa.array([*texts, None], pa.string()).take(pc.fill_null(kinds.indices, len(texts)))
            user = pc.binary_join_element_wise('"id":', batch.column(2).cast(pa.string()), "")
            ok = pc.binary_join_element_wise('"ok":', pc.if_else(pc.greater(batch.column(3), 100.0), "true", "false"), "")
            fields = [pc.fill_null(pc.binary_join_element_wise(f, ",", ""), "") for f in (kind, user, ok)]
            body = pc.utf8_rtrim(pc.binary_join_element_wise(*fields, ""), ",")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pc.binary_join_element_wise("{", body, "}", "")], ["event_id", "message"])

    def commit(self, end: dict) -> None:
        self.done = end["files"]


class MessageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_messages"

    def schema(self) -> str:
        return "event_id bigint, message string"

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options["path"])
