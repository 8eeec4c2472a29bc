"""Landed raw documents as a Spark data source: `spark.read.format("landed_documents").load(folder)`.

A folder holds JSON lines below `game_id=…/source_id=…`. Files are listed on the driver (names and
sizes only) and read by the tasks through pyarrow's file systems, so the folder may lie in any store
that these reach. Filters on game_id and source_id are pushed down and leave out whole files; other
filters stay with Spark. As a stream, files arrive in the order (time written, path).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loreloom.sources.files import RAW_SCHEMA

NAME = "landed_documents"
SPLIT_BYTES = 32 << 20  # of the files that one task reads
FOLDERS = ("game_id", "source_id")


@dataclass(frozen=True)
class LandedFile:
    path: str
    size: int
    written: int  # nanoseconds
    folders: tuple[tuple[str, str], ...]  # what the folder names say


class Files(InputPartition):
    def __init__(self, files: list[LandedFile]) -> None:
        super().__init__(tuple(files))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _folders(path: str) -> tuple[tuple[str, str], ...]:
    named = (part.partition("=") for part in path.split("/")[:-1] if "=" in part)
    return tuple((name, unquote(value)) for name, _, value in named if name in FOLDERS)


def landed_files(path: str) -> list[LandedFile]:
    """The files of a folder in the order they were written."""
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    files = [
        LandedFile(f.path, f.size, f.mtime_ns or 0, _folders(f.path[len(root):]))
        for f in found
        if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))
    ]
    return sorted(files, key=lambda f: (f.written, f.path))


def splits(files: list[LandedFile]) -> list[Files]:
    """Files in groups of about SPLIT_BYTES."""
    out: list[list[LandedFile]] = []
    held = SPLIT_BYTES
    for file in files:
        if held >= SPLIT_BYTES:
            out.append([])
            held = 0
        out[-1].append(file)
        held += file.size
    return [Files(group) for group in out]


def _read(path: str, schema: StructType, group: Files) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(path)
    shape = to_arrow_schema(schema)
    inside = pa.schema([f for f in shape if f.name not in FOLDERS])
    as_text = pa.schema([pa.field(f.name, pa.string()) for f in inside])
    for file in group.value:
        with store.open_input_stream(file.path) as stream:
            rows = pj.read_json(stream, parse_options=pj.ParseOptions(
                explicit_schema=as_text, unexpected_field_behavior="ignore"))
        named = dict(file.folders)
        columns = []
        for field in shape:
            if field.name in FOLDERS:
                columns.append(pa.array([named.get(field.name)] * rows.num_rows, pa.string()))
            elif pa.types.is_timestamp(field.type):
                columns.append(pc.cast(rows.column(field.name), pa.timestamp("us", "UTC")).cast(field.type))
            else:
                columns.append(rows.column(field.name).cast(field.type))
        yield from pa.table(columns, schema=shape).to_batches()


class LandedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.wanted: dict[str, list[set]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo | In) and len(one.attribute) == 1 and one.attribute[0] in FOLDERS:
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.wanted.setdefault(one.attribute[0], []).append(values)
            else:
                yield one

    def _kept(self, file: LandedFile) -> bool:
        named = dict(file.folders)
        return all(named.get(name) in values for name, sets in self.wanted.items() for values in sets)

    def partitions(self) -> list[Files]:
        return splits([f for f in landed_files(self.path) if self._kept(f)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition)


class LandedStreamReader(DataSourceStreamReader):
    """Offsets are the place of the last file taken: time written and path."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"written": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = landed_files(self.path)
        return {"written": files[-1].written, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["written"], start["path"]), (end["written"], end["path"])
        return splits([f for f in landed_files(self.path) if after < (f.written, f.path) <= upto])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition)


class LandedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LandedStreamReader:
        return LandedStreamReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedDocuments)


def land_documents(documents: DataFrame, path: str) -> None:
    """Raw documents as the JSON lines that the source reads."""
    documents.write.mode("append").partitionBy(*FOLDERS).json(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).load(path)


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).load(path)
