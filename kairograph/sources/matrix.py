"""Matrix files (.npy, .npz) as a Spark data source that reads them by ranges of rows.

A file's header gives its shape and type, so each task seeks to its own rows: one large matrix is read
by many tasks, and none holds more than a block of it. Members of .npz archives are read the same way
where they are stored as they are; compressed ones are read through by one task each, block by block.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task reads, and rows of a batch at most.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 4096
_TYPES = {"float": "<f4", "double": "<f8", "long": "<i8", "int": "<i4"}


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pfs.FileSystem.from_uri(path)
    return pfs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    fs, inside = file_system(path)
    info = fs.get_file_info(inside)
    if info.type == pfs.FileType.File:
        return [inside]
    if info.type == pfs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pfs.FileSelector(inside, recursive=True))
    return sorted(f.path for f in found if f.type == pfs.FileType.File and f.path.endswith((".npy", ".npz")))


class Layout:
    """Where a matrix lies in a file: offset of its first value, shape, type, and the order of its values."""

    def __init__(self, start: int, rows: int, width: int, kind: str, by_column: bool):
        self.start, self.rows, self.width, self.kind, self.by_column = start, rows, width, kind, by_column


def npy_layout(file, at: int, name: str) -> Layout:
    """Layout of the .npy content that begins at ``at``; raises unless it is a matrix of numbers."""
    file.seek(at)
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(file)
    if len(shape) != 2:
        raise ValueError(f"{name} has {len(shape)} dimensions, not 2")
    if kind.kind not in "fiub":
        raise ValueError(f"{name} holds {kind}, not numbers")
    return Layout(file.tell(), shape[0], shape[1], kind.str, by_column)


class RowRange(InputPartition):
    """Rows [low, high) of one matrix; ``member`` is set for a compressed archive member, read from its begin."""

    def __init__(self, path: str, low: int, high: int, layout: Layout, member: str | None = None):
        super().__init__(None)
        self.path, self.low, self.high, self.layout, self.member = path, low, high, layout, member


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options.get("path")
        if not self.path:
            raise ValueError("a path is needed")

    def partitions(self) -> list[RowRange]:
        fs, _ = file_system(self.path)
        size, out = int(self.options.get("rangebytes", RANGE_BYTES)), []
        for path in _files(self.path):
            with fs.open_input_file(path) as file:
                at, member = 0, None
                if path.endswith(".npz"):
                    at, member = self._member(file, path)
                if member is None:
                    m = npy_layout(file, at, path)
                    step = max(1, size // max(1, m.width * np.dtype(m.kind).itemsize))
                    out += [RowRange(path, lo, min(lo + step, m.rows), m) for lo in range(0, m.rows, step)]
                else:
                    with zipfile.ZipFile(file).open(member) as inside:
                        m = npy_layout(io.BytesIO(inside.read(1 << 16)), 0, f"{path}[{member}]")
                    out.append(RowRange(path, 0, m.rows, m, member))
        return out

    def _member(self, file, path: str) -> tuple[int, str | None]:
        """Offset of the wanted array in the archive, and its name where it is compressed."""
        archive = zipfile.ZipFile(file)
        key = self.options.get("key")
        names = archive.namelist()
        name = f"{key}.npy" if key else names[0]
        if name not in names:
            raise KeyError(f"{path} has no array {key}, but {', '.join(n.removesuffix('.npy') for n in names)}")
        info = archive.getinfo(name)
        if info.compress_type != zipfile.ZIP_STORED:
            return 0, name
        file.seek(info.header_offset + 26)  # the local header's own lengths of name and extra field
        fields = file.read(4)
        return info.header_offset + 30 + int.from_bytes(fields[:2], "little") + int.from_bytes(fields[2:], "little"), None

    def read(self, part: RowRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file, or only empty ones
            return
        kind = _TYPES[self.options.get("type", "float")]
        fs, _ = file_system(self.path)
        m, low = part.layout, part.low
        step = max(1, min(BATCH_ROWS, (4 << 20) // max(1, m.width * 8)))
        with fs.open_input_file(part.path) as file:
            source = file if part.member is None else zipfile.ZipFile(file).open(part.member)
            if part.member is not None:
                source.read(m.start)
            while low < part.high:
                high = min(low + step, part.high)
                block = _rows(source, m, low, high, part.member is not None)
                values = pa.array(np.ascontiguousarray(block, kind).ravel())
                offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * m.width)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(block)), pa.array(np.arange(low, high)), pa.ListArray.from_arrays(offsets, values)], names=["file", "row", "v"])
                low = high


def _rows(source, m: Layout, low: int, high: int, through: bool) -> np.ndarray:
    size = np.dtype(m.kind).itemsize
    if through:
        if m.by_column:
            raise ValueError("a compressed matrix stored by columns cannot be read by rows")
        return np.frombuffer(source.read((high - low) * m.width * size), m.kind).reshape(-1, m.width)
    if not m.by_column:
        source.seek(m.start + low * m.width * size)
        return np.frombuffer(source.read((high - low) * m.width * size), m.kind).reshape(-1, m.width)
    out = np.empty((high - low, m.width), m.kind)
    for c in range(m.width):
        source.seek(m.start + (c * m.rows + low) * size)
        out[:, c] = np.frombuffer(source.read((high - low) * size), m.kind)
    return out


class MatrixSource(DataSource):
    """Format ``matrix``: (file, row, v). Options: ``key`` (array of an archive, else the first), ``type``
    (float, double, long or int, of the values read), ``rangebytes`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return f"file string, row long, v array<{self.options.get('type', 'float')}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(dict(self.options))


def read_matrix(spark: SparkSession, path: str, key: str | None = None, *, kind: str = "float", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, row, v) of a ``.npy`` or ``.npz`` file or of all below a folder, two-dimensional."""
    spark.dataSource.register(MatrixSource)
    source = spark.read.format("matrix").option("type", kind).option("rangebytes", range_bytes)
    return (source.option("key", key) if key else source).load(path)


def write_matrix(rows: DataFrame, path: str, vec_col: str = "v", kind: str = "float") -> None:
    """The vectors of ``rows``, all of one length, as ``.npy`` files below ``path``, one for each partition
    that has rows and in its order. A file gets its name when it is whole, so a task that runs twice
    leaves one copy."""
    dtype = _TYPES[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, inside = file_system(path)
        fs.create_dir(inside, recursive=True)
        number, part, count, width = TaskContext.get().partitionId(), f"{inside}/.{uuid.uuid4().hex}", 0, None
        body = None
        for pdf in batches:
            if not len(pdf):
                continue
            if width is None:
                width, body = len(pdf["v"].iloc[0]), fs.open_output_stream(part)
            odd = {len(v) for v in pdf["v"]} - {width}
            if odd:
                raise ValueError(f"vectors of {width} and {odd.pop()} components")
            block = np.stack([np.asarray(v, dtype) for v in pdf["v"]])
            body.write(block.tobytes())
            count += len(block)
        if body is not None:
            body.close()
            _finish(fs, part, f"{inside}/part-{number:06d}.npy", count, width, dtype)
        yield pd.DataFrame({"rows": [count]})

    rows.select(F.col(vec_col).alias("v")).mapInPandas(run, "rows long").agg(F.sum("rows")).collect()


def _finish(fs, part: str, final: str, rows: int, width: int, dtype: str) -> None:
    """Header and body as one file, copied block by block."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": dtype, "fortran_order": False, "shape": (rows, width)})
    with fs.open_output_stream(part + "w") as out, fs.open_input_stream(part) as body:
        out.write(head.getvalue())
        while block := body.read(4 << 20):
            out.write(block)
    fs.delete_file(part)
    fs.move(part + "w", final)
