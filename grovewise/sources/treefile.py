"""Tree sequences from their binary files: a store of named arrays, which tasks read in ranges of rows.

The file begins with a header and one descriptor an array; every task reads these and then only its rows' bytes of the columns that its
table needs. Paths are local or of any file system that Arrow opens by URI, and must be readable by the executors.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from grovewise.model import EDGES, INDIVIDUALS, MIGRATIONS, MUTATIONS, NODES, SITES, TreeTables

# Fixed values of the file format: first bytes, header and descriptor layouts (64 bytes each), element types by code.
MAGIC = b"\x89KAS\r\n\x1a\n"
HEADER, ITEM, BLOCK = "<8sHHIQ40x", "<B7xQQQQ24x", 64
TYPES = ["i1", "u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<u8", "<f4", "<f8"]
FORMAT = b"tskit.trees"
SAMPLE_FLAG = 1

#: Per table its DDL, the array that has one element a row, and (kind, array) of each column. Kinds: row is the row's number, id a number whose
#: -1 is NULL, real a number whose NaN is NULL, text and list are slices between offsets; a ? marks arrays that a file may lack.
TABLES = {
    "nodes": (NODES, "nodes/time", [("row", ""), ("sample", "nodes/flags"), ("real", "nodes/time"), ("id", "nodes/population"), ("id", "nodes/individual")]),
    "edges": (EDGES, "edges/left", [("real", "edges/left"), ("real", "edges/right"), ("id", "edges/parent"), ("id", "edges/child")]),
    "sites": (SITES, "sites/position", [("row", ""), ("real", "sites/position"), ("text", "sites/ancestral_state")]),
    "mutations": (MUTATIONS, "mutations/site", [("row", ""), ("id", "mutations/site"), ("id", "mutations/node"), ("text", "mutations/derived_state"), ("id", "mutations/parent"), ("real?", "mutations/time")]),
    "individuals": (INDIVIDUALS, "individuals/flags", [("row", ""), ("id", "individuals/flags"), ("list", "individuals/location"), ("list?", "individuals/parents")]),
    "migrations": (MIGRATIONS, "migrations/time", [("real", "migrations/left"), ("real", "migrations/right"), ("id", "migrations/node"), ("id", "migrations/source"), ("id", "migrations/dest"), ("real", "migrations/time")]),
}
BATCH = 1 << 16


class Store:
    """The arrays of one file by name; reading one reads the bytes of the wanted elements only."""

    def __init__(self, path: str):
        where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.path, self.file = path, where.open_input_file(inside)
        head = self.file.read_at(BLOCK, 0)
        if len(head) < BLOCK or head[:8] != MAGIC:
            raise ValueError(f"{path} is not a store of arrays")
        _, major, _, n, size = struct.unpack(HEADER, head)
        if major != 1:
            raise ValueError(f"{path} has version {major} of the store's format, this reads 1")
        if size != self.file.size():
            raise ValueError(f"{path} has {self.file.size()} bytes where its header says {size}")
        self.items = {}
        for kind, key, key_size, start, length in struct.iter_unpack(ITEM, self.file.read_at(n * BLOCK, BLOCK)):
            self.items[self.file.read_at(key_size, key).decode()] = (np.dtype(TYPES[kind]), start, length)
        if (name := self.read("format/name", needed=False)) is None or name.tobytes() != FORMAT:
            raise ValueError(f"{path} holds no tree sequence")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def __len__(self) -> int:
        return len(self.items)

    def length(self, key: str) -> int:
        return self.items[key][2] if key in self.items else 0

    def read(self, key: str, first: int = 0, last: int | None = None, needed: bool = True) -> np.ndarray | None:
        """Elements first to last - 1 of an array; None where it is missing and not needed."""
        if key not in self.items:
            if needed:
                raise ValueError(f"{self.path} has no array {key}")
            return None
        kind, start, length = self.items[key]
        last = length if last is None else last
        if last > length:
            raise ValueError(f"{self.path}: {key} has {length} elements, {last} are needed")
        return np.frombuffer(self.file.read_at((last - first) * kind.itemsize, start + first * kind.itemsize), kind)


def _column(store: Store, kind: str, key: str, first: int, last: int, to: pa.DataType) -> pa.Array:
    n, needed = last - first, not kind.endswith("?")
    kind = kind.rstrip("?")
    if kind == "row":
        return pa.array(np.arange(first, last), to)
    if kind in ("text", "list"):
        at = store.read(f"{key}_offset", first, last + 1, needed)
        if at is None:
            return pa.nulls(n, to)
        at = at.astype(np.int64)
        values = store.read(key, int(at[0]), int(at[-1]))
        at -= at[0]
        if kind == "list":
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)).cast(to)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())]).cast(pa.large_string()).cast(to)
    x = store.read(key, first, last, needed)
    if x is None:
        return pa.nulls(n, to)
    if kind == "sample":
        return pa.array((x & SAMPLE_FLAG) == SAMPLE_FLAG, to)
    return pa.array(x, mask=np.isnan(x) if kind == "real" else x == -1).cast(to)


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TreeFileReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, step: int):
        self.path, self.table, self.schema, self.step = path, table, schema, step

    def partitions(self) -> Sequence[InputPartition]:
        with Store(self.path) as s:
            n = s.length(TABLES[self.table][1])
        return [Rows(i, min(i + self.step, n)) for i in range(0, n, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns, schema = TABLES[self.table][2], to_arrow_schema(self.schema)
        with Store(self.path) as s:
            for first in range(partition.first, partition.last, BATCH):
                last = min(first + BATCH, partition.last)
                yield pa.RecordBatch.from_arrays([_column(s, kind, key, first, last, field.type) for (kind, key), field in zip(columns, schema)], schema=schema)


class TreeFile(DataSource):
    """Format 'treefile' with options path, table (one of TABLES) and rows (at most so many a task)."""

    @classmethod
    def name(cls) -> str:
        return "treefile"

    def schema(self) -> str:
        return TABLES[self.options["table"]][0]

    def reader(self, schema: StructType) -> TreeFileReader:
        return TreeFileReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", 1_000_000)))


def facts(path: str) -> dict[str, float | int | str | None]:
    """What a file says of itself: genome length, identity, unit of time, and the rows of each table, populations among them."""
    with Store(path) as s:
        text = lambda k: None if (x := s.read(k, needed=False)) is None else x.tobytes().decode()
        out = {"sequence_length": float(s.read("sequence_length")[0]), "uuid": text("uuid"), "time_units": text("time_units")}
        out |= {f"num_{t}": s.length(key) for t, (_, key, _) in TABLES.items()}
        return out | {"num_populations": max(s.length("populations/metadata_offset") - 1, 0)}


def tables_from_file(spark: SparkSession, path: str, rows: int = 1_000_000) -> TreeTables:
    """All tables of a file, read lazily in tasks of at most `rows` rows; tables that it lacks are empty, other formats an error."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(TreeFile)
    read = lambda t: spark.read.format("treefile").option("table", t).option("rows", rows).load(path)
    return TreeTables(*(read(t) for t in ("nodes", "edges", "sites", "mutations")), facts(path)["sequence_length"], read("individuals"), read("migrations"))
