"""Files as a stream of numbered rows: a data source whose offset is (file name, rows read of it).

Files are taken in the order of their names, each row once, also across restarts; a file that grows goes on where it was left. New
files must sort behind those that were read. The driver lists names and counts the rows of the last file; the files are read by
tasks, one file each, in Arrow batches. Every row comes with ``_file`` (its path below the folder), ``_row`` (its number in the
file, from 0) and ``_chunk``: the rows that are left after ``skip_rows`` in runs of ``chunk_rows``.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..core import nan_to_null
from ..errors import DataError

NAME = "rillwatch_row_files"
_OWN = [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType()), T.StructField("_chunk", T.LongType())]
_BLOCK = 1 << 20  # bytes of a text file that are read at a time
FORMATS = {".csv": "csv", ".parquet": "parquet", ".jsonl": "jsonl", ".json": "jsonl"}


class _Part(InputPartition):
    def __init__(self, name: str, first: int, last: int | None):
        self.name, self.first, self.last = name, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = to_arrow_schema(T.StructType([f for f in schema.fields if f.name not in {o.name for o in _OWN}]))
        self.path, self.pattern, self.format = options["path"], options["pattern"], options["fileformat"]
        self.skip, self.chunk = int(options["skiprows"]), int(options["chunkrows"])

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        remote = "://" in self.path or self.path.startswith("file:")
        store, root = pyarrow.fs.FileSystem.from_uri(self.path) if remote else (pyarrow.fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    # --- on the driver ---

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str, list[str]]:
        store, root = self._store()
        found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [f.path[len(root):].lstrip("/") for f in found if f.type == pyarrow.fs.FileType.File]
        plain = lambda n: not any(p.startswith(("_", ".")) for p in n.split("/"))
        return store, root, sorted(n for n in names if plain(n) and fnmatch.fnmatch(n.rsplit("/", 1)[-1], self.pattern))

    def _rows(self, store: pyarrow.fs.FileSystem, path: str) -> int:
        if self.format == "parquet":
            return pyarrow.parquet.ParquetFile(path, filesystem=store).metadata.num_rows
        return sum(b.num_rows for b in self._batches(store, path))

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        store, root, names = self._files()
        return {"file": names[-1], "row": self._rows(store, f"{root}/{names[-1]}")} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        _, _, names = self._files()
        return [_Part(n, start["row"] if n == start["file"] else 0, end["row"] if n == end["file"] else None)
                for n in names if start["file"] <= n <= end["file"]]

    def commit(self, end: dict) -> None:
        pass

    # --- in tasks ---

    def _batches(self, store: pyarrow.fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        if self.format == "parquet":
            yield from pyarrow.parquet.ParquetFile(path, filesystem=store).iter_batches(columns=self.columns.names)
        elif self.format == "csv":
            if not store.get_file_info(path).size:
                return
            with store.open_input_stream(path) as stream:
                convert = pyarrow.csv.ConvertOptions(column_types=self.columns, include_columns=self.columns.names, strings_can_be_null=True,
                                                     quoted_strings_can_be_null=False, null_values=[""])
                yield from pyarrow.csv.open_csv(stream, read_options=pyarrow.csv.ReadOptions(block_size=_BLOCK), convert_options=convert,
                                                parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True))
        else:
            yield from self._objects(store, path)

    def _objects(self, store: pyarrow.fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        """Lines that are JSON objects; blank ones and others don't count."""
        held, rest = [], b""
        with store.open_input_stream(path) as stream:
            while True:
                block = stream.read(_BLOCK)
                *lines, rest = (rest + block).split(b"\n") if block else (rest, b"")
                for line in lines:
                    try:
                        value = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(value, dict):
                        held.append({n: value.get(n) for n in self.columns.names})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=self.columns)
                    held = []
                if not block:
                    return

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        at, first = 0, max(partition.first, self.skip)
        for batch in self._batches(store, f"{root}/{partition.name}"):
            stop = at + batch.num_rows if partition.last is None else min(at + batch.num_rows, partition.last)
            if stop > max(at, first):
                begin = max(at, first)
                rows = range(begin, stop)
                part = batch.slice(begin - at, stop - begin)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n).cast(self.columns.field(n).type) for n in self.columns.names], pa.array([partition.name] * len(rows)),
                     pa.array(rows, pa.int64()), pa.array([(r - self.skip) // self.chunk for r in rows], pa.int64())],
                    names=[*self.columns.names, *[f.name for f in _OWN]])
            at += batch.num_rows
            if partition.last is not None and at >= partition.last:
                return



class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def stream_rows(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.csv", skip_rows: int = 0,
                chunk_rows: int = 1000) -> DataFrame:
    """The rows of a folder's files in the order of file names, without the first ``skip_rows`` rows of each file.

    CSV files have a header line, by whose names columns are taken; an empty field is null. JSON lines that are no objects don't count
    as rows. The format follows the pattern's extension.
    """
    endings = [e for e in FORMATS if pattern.endswith(e)]
    if not endings:
        raise DataError(f"unsupported file format: {pattern}")
    if skip_rows < 0 or chunk_rows < 1:
        raise DataError("rows to skip can't be negative, and a chunk has one row at least")
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = {f.name for f in given.fields} & {f.name for f in _OWN}
    if clash:
        raise DataError(f"columns {sorted(clash)} are made by the source")
    spark.dataSource.register(RowFiles)
    rows = spark.readStream.format(NAME).schema(T.StructType([*given.fields, *_OWN])).options(
        path=path, pattern=pattern, fileFormat=FORMATS[endings[0]], skipRows=skip_rows, chunkRows=chunk_rows).load()
    return nan_to_null(rows)
