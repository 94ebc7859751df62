"""A folder of workbooks as a PySpark data source: spark.read.format("workbooks").load(folder).

One partition a workbook, listed once through Spark's own file systems; executors open and parse them. The schema is that of the first workbook's header
pair (or, with header "smart", of its best header row); each workbook's columns are matched by name, and what the first one lacks is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assaygrid.sources import tables

#: Rows of an Arrow batch.
BATCH = 10_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, at = open_store(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx") and not f.base_name.startswith(("~", ".")))


def headed(data: bytes, header: str) -> tuple[list[str], list[list[object]], tables.Roles | None]:
    """Names, rows and roles of a workbook; ValueError where a pair of role and name rows is wanted and not there."""
    grid = tables.xlsx_grid(data)
    if header == "smart":
        if not grid:
            return [], [], None
        at = tables.infer_header(grid)
        return tables.names_unified(grid[at]), grid[at + 1 :], None
    at = tables.find_header_pair(grid[:40])
    if at is None:
        raise ValueError("no pair of role and name rows in the workbook")
    names = tables.names_unified(grid[at + 1])
    return names, grid[at + 2 :], tables.roles_from(names, grid[at])


def _text(cell: object) -> str | None:
    if cell is None:
        return None
    out = format(cell, ".15g") if isinstance(cell, float) else str(cell)
    return out.strip() or None


class Workbook(InputPartition):
    def __init__(self, path: str | None):
        super().__init__(path)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.header = options["path"], options.get("header", "roles")
        self.bad = options.get("mode", "fail")
        self.columns = schema.names

    def partitions(self) -> list[InputPartition]:
        return [Workbook(f) for f in _files(self.path)] or [Workbook(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        store, _ = open_store(self.path)
        try:
            with store.open_input_stream(partition.value) as raw:
                names, rows, _ = headed(raw.read(), self.header)
        except Exception as e:
            if self.bad == "skip":
                return
            raise ValueError(f"{partition.value}: {e}") from e
        at = {n: i for i, n in enumerate(names)}
        file = partition.value.rsplit("/", 1)[-1]
        # blank rows go; a row keeps its number among those under the header
        kept = [(i, r) for i, r in enumerate(rows) if any(_text(c) is not None for c in r)]
        for k in range(0, len(kept), BATCH):
            part = kept[k : k + BATCH]
            columns = []
            for c in self.columns:
                if c == "file":
                    columns.append(pa.array([file] * len(part), pa.string()))
                elif c == "row_id":
                    columns.append(pa.array([i for i, _ in part], pa.int64()))
                else:
                    columns.append(pa.array([_text(r[at[c]]) if c in at else None for _, r in part], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, self.columns)


class WorkbookSource(DataSource):
    """Options: path (a workbook or a folder of them); header ("roles" or "smart"); mode ("fail", or "skip" for workbooks that cannot be read)."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> StructType:
        options = dict(self.options)
        store, _ = open_store(options["path"])
        for file in _files(options["path"]):
            with store.open_input_stream(file) as raw:
                try:
                    names, _, _ = headed(raw.read(), options.get("header", "roles"))
                except Exception:
                    if options.get("mode", "fail") == "skip":
                        continue
                    raise
            return StructType([StructField("file", StringType()), StructField("row_id", LongType()), *[StructField(n, StringType()) for n in names if n not in ("file", "row_id")]])
        return StructType([StructField("file", StringType()), StructField("row_id", LongType())])

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)


def read_workbooks(spark: SparkSession, path: str, header: str = "roles", mode: str = "fail") -> DataFrame:
    """SC3, SC4 for many: file, row_id and the cells of all workbooks under a path as trimmed strings, blanks as nulls."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbooks").option("header", header).option("mode", mode).load(path)


def declared_roles(path: str) -> tables.Roles:
    """The roles that the first workbook under a path declares."""
    store, _ = open_store(path)
    with store.open_input_stream(_files(path)[0]) as raw:
        return headed(raw.read(), "roles")[2]


def headers(spark: SparkSession, path: str) -> DataFrame:
    """RD2-RD7 of every workbook under a path: file, pair (row of roles, from 0), names, roles (filled forward), inputs, outputs, metadata, entity and
    time; smart (the row that looks most like a header) and smart_names. Workbooks without a pair have nulls there."""
    schema = "file string, pair int, names array<string>, roles array<string>, inputs array<string>, outputs array<string>, metadata array<string>, entity string, time string, smart int, smart_names array<string>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grid = tables.xlsx_grid(content)
                at, smart = tables.find_header_pair(grid[:40]), tables.infer_header(grid)
                row = {"file": path.rsplit("/", 1)[-1], "smart": smart, "smart_names": tables.names_unified(grid[smart]) if grid else []}
                if at is not None:
                    names = tables.names_unified(grid[at + 1])
                    r = tables.roles_from(names, grid[at])
                    row |= {"pair": at, "names": names, "roles": tables.fill_roles(grid[at]), "inputs": r.inputs, "outputs": r.outputs, "metadata": r.metadata, "entity": r.entity, "time": r.time}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, schema)


_LIST = pa.list_(pa.string())
ARROW = pa.schema([("file", pa.string()), ("pair", pa.int32()), ("names", _LIST), ("roles", _LIST), ("inputs", _LIST), ("outputs", _LIST), ("metadata", _LIST), ("entity", pa.string()), ("time", pa.string()), ("smart", pa.int32()), ("smart_names", _LIST)])
