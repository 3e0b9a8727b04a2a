"""Binary R tables (serialised data frames) as a data source, a file for up to ROWS_A_FILE rows of a partition.

``spark.dataSource.register(RTables)``, then format "rtable" reads and writes.
Files are in the XDR form of R's serialisation, versions 2 and 3, plain or
compressed by gzip, bzip2 or xz; written ones are version 2 and gzip. A column is
logical, integer, double, string or a factor, which reads as its labels. NA is
null (NaN is not); integers of 64 bits are written as doubles, as R has no others.
Columns are found by name; one that a file lacks is null. Files are opened with
Arrow's file systems; a file must fit a task.

Options: ``factors``, names of columns (comma-separated) to write as factors.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format: types of items, flags, marks of missing values.
SYMBOL, PAIRS, CHARS, LOGICAL, INTEGER, DOUBLE, STRINGS, LIST = 1, 2, 9, 10, 13, 14, 16, 19
NOTHING, GLOBAL, REFERENCE, ALTERNATE = 254, 253, 255, 238
EMPTY_ENVIRONMENT, BASE_ENVIRONMENT = 242, 241
OBJECT, ATTRIBUTES, TAG = 0x100, 0x200, 0x400
UTF8, ASCII = 0x8000, 0x40000
NA_INTEGER, NA_DOUBLE = -(2**31), 0x7FF00000000007A2
#: Rows of a file that is written: what a task holds at once.
ROWS_A_FILE = 100_000
_MAGIC = {b"\x1f\x8b": gzip.decompress, b"BZ": bz2.decompress, b"\xfd7": lzma.decompress}


@dataclass
class Item:
    """A value with its attributes; ``kind`` is the item's type."""

    kind: int
    value: object
    attributes: dict


class Decoder:
    def __init__(self, data: bytes):
        for magic, unpack in _MAGIC.items():
            if data.startswith(magic):
                data = unpack(data)
        if data[:2] != b"X\n":
            raise ValueError("not an R table in XDR form")
        self.data, self.at, self.references = data, 2, []
        version = self.integer()
        self.at += 8
        if version == 3:
            n = self.integer()  # the native encoding's name
            self.at += n
        elif version != 2:
            raise ValueError(f"version {version} of R's serialisation")

    def integer(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def array(self, kind: str, n: int) -> np.ndarray:
        width = int(kind[-1])
        self.at += width * n
        return np.frombuffer(self.data, dtype=kind, count=n, offset=self.at - width * n)

    def length(self) -> int:
        n = self.integer()
        return n if n >= 0 else (self.integer() << 32) | (self.integer() & 0xFFFFFFFF)

    def item(self) -> Item:
        flags = self.integer()
        kind = flags & 0xFF
        value: object = None
        if kind == SYMBOL:
            value = self.item().value
            self.references.append(value)
            return Item(kind, value, {})
        if kind == REFERENCE:
            return Item(SYMBOL, self.references[(flags >> 8 or self.integer()) - 1], {})
        if kind == CHARS:
            n = self.integer()
            self.at += max(n, 0)
            return Item(kind, None if n < 0 else self.data[self.at - n : self.at].decode("utf-8", "replace"), {})
        if kind == PAIRS:
            return self.pairs(flags)
        if kind == ALTERNATE:
            return self.alternate()
        if kind in (LOGICAL, INTEGER):
            value = self.array(">i4", self.length())
        elif kind == DOUBLE:
            value = self.array(">f8", self.length())
        elif kind == STRINGS:
            value = [self.item().value for _ in range(self.length())]
        elif kind == LIST:
            value = [self.item() for _ in range(self.length())]
        elif kind not in (NOTHING, GLOBAL, EMPTY_ENVIRONMENT, BASE_ENVIRONMENT):
            raise ValueError(f"an R table holds no item of type {kind}")
        return Item(kind, value, self.item().value if flags & ATTRIBUTES else {})

    def pairs(self, flags: int) -> Item:
        """A linked list of tagged items, as a table (without tags by place)."""
        out: dict = {}
        while flags & 0xFF == PAIRS:
            if flags & ATTRIBUTES:
                self.item()
            tag = self.item().value if flags & TAG else len(out)
            out[tag] = self.item()
            flags = self.integer()
        return Item(PAIRS, out, {})

    def alternate(self) -> Item:
        """Compact forms: sequences, wrapped vectors and strings made of numbers."""
        name = next(iter(self.item().value.values())).value
        state, attributes = self.item(), self.item()
        own = attributes.value if attributes.kind == PAIRS else {}
        if name in ("compact_intseq", "compact_realseq"):
            n, start, by = state.value
            values = start + by * np.arange(int(n))
            return Item(INTEGER, values.astype(">i4"), own) if name == "compact_intseq" else Item(DOUBLE, values, own)
        inner = next(iter(state.value.values())) if state.kind == PAIRS else state.value[0]
        if name == "deferred_string":
            return Item(STRINGS, [None if x is None else f"{x:.15g}" for x in plain(inner)], own)
        return Item(inner.kind, inner.value, own or inner.attributes)


def plain(item: Item) -> list:
    """A column's values; NA is None."""
    if item.kind == STRINGS:
        return item.value
    values = np.ascontiguousarray(item.value)
    if item.kind == DOUBLE:
        # the low word tells NA, which may be signalling or quiet, from NaN
        missing = np.isnan(values) & (values.view(">u8") & np.uint64(0xFFFFFFFF) == np.uint64(NA_DOUBLE & 0xFFFFFFFF))
    else:
        missing = values == NA_INTEGER
    levels = item.attributes.get("levels")
    own = [levels.value[i - 1] if i > 0 else None for i in values.tolist()] if levels else values.tolist()
    if item.kind == LOGICAL:
        own = [bool(x) for x in own]
    return [None if m else x for x, m in zip(own, missing.tolist(), strict=True)]


def table_of(data: bytes) -> dict[str, list]:
    """Columns of a serialised data frame by name."""
    frame = Decoder(data).item()
    if frame.kind != LIST or "names" not in frame.attributes:
        raise ValueError("the file holds no data frame")
    return dict(zip(frame.attributes["names"].value, map(plain, frame.value), strict=True))


class Encoder:
    def __init__(self):
        self.out = io.BytesIO()
        self.out.write(b"X\n" + struct.pack(">iii", 2, 0x00040300, 0x00020300))

    def integers(self, *values: int) -> None:
        self.out.write(struct.pack(f">{len(values)}i", *values))

    def chars(self, text: str | None) -> None:
        if text is None:
            return self.integers(CHARS, -1)
        data = text.encode()
        self.integers(CHARS | (ASCII if text.isascii() else UTF8), len(data))
        self.out.write(data)

    def strings(self, values: list[str | None], flags: int = 0) -> None:
        self.integers(STRINGS | flags, len(values))
        for v in values:
            self.chars(v)

    def attribute(self, name: str) -> None:
        self.integers(PAIRS | TAG, SYMBOL)
        self.chars(name)

    def column(self, values: list, kind: T.DataType, factor: bool) -> None:
        if factor:
            levels = sorted({v for v in values if v is not None})
            place = {v: i for i, v in enumerate(levels, 1)}
            self.integers(INTEGER | OBJECT | ATTRIBUTES, len(values), *(place.get(v, NA_INTEGER) for v in values))
            self.attribute("levels")
            self.strings(levels)
            self.attribute("class")
            self.strings(["factor"])
            self.integers(NOTHING)
        elif isinstance(kind, T.StringType):
            self.strings(values)
        elif isinstance(kind, (T.BooleanType, T.IntegerType, T.ShortType, T.ByteType)):
            self.integers(LOGICAL if isinstance(kind, T.BooleanType) else INTEGER, len(values), *(NA_INTEGER if v is None else int(v) for v in values))
        else:
            missing = np.array([v is None for v in values], dtype=bool)
            numbers = np.array([0.0 if v is None else float(v) for v in values], dtype=">f8")
            numbers.view(">u8")[missing] = NA_DOUBLE
            self.integers(DOUBLE, len(values))
            self.out.write(numbers.tobytes())

    def table(self, columns: dict[str, tuple[list, T.DataType, bool]], rows: int) -> bytes:
        self.integers(LIST | OBJECT | ATTRIBUTES, len(columns))
        for values, kind, factor in columns.values():
            self.column(values, kind, factor)
        self.attribute("names")
        self.strings(list(columns))
        self.attribute("class")
        self.strings(["data.frame"])
        self.attribute("row.names")
        self.integers(INTEGER, 2, NA_INTEGER, -rows, NOTHING)
        return gzip.compress(self.out.getvalue(), 6, mtime=0)


def _files(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, root


class RTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rtable"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(schema, self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(schema, self.options["path"], {c for c in self.options.get("factors", "").split(",") if c})


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _files(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [InputPartition(root)]
        found = store.get_file_info(fs.FileSelector(root))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = _files(self.path)
        with store.open_input_file(partition.value) as f:
            columns = table_of(f.read())
        kinds = to_arrow_schema(self.schema)
        n = len(next(iter(columns.values()), []))
        made = [pa.array(columns[k.name]).cast(k.type) if k.name in columns else pa.nulls(n, k.type) for k in kinds]
        yield from pa.Table.from_arrays(made, schema=kinds).to_batches(10_000)


class Writer(DataSourceWriter):
    """Files of ROWS_A_FILE rows, one at least a task, under new names each time: what a lost task has left is never listed as done, but removed."""

    def __init__(self, schema: T.StructType, path: str, factors: set[str]):
        self.schema, self.path, self.factors = schema, path, factors

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _files(self.path)
        store.create_dir(root, recursive=True)
        rows, names = iter(rows), []
        while (held := [tuple(r) for r in islice(rows, ROWS_A_FILE)]) or not names:
            columns = {f.name: ([r[i] for r in held], f.dataType, f.name in self.factors) for i, f in enumerate(self.schema.fields)}
            names.append(f"{root}/_{uuid.uuid4().hex}.rds")
            with store.open_output_stream(names[-1]) as f:
                f.write(Encoder().table(columns, len(held)))
        return Written(names)

    def commit(self, messages: list) -> None:
        store, root = _files(self.path)
        for k, name in enumerate(name for m in messages if m for name in m.names):
            store.move(name, f"{root}/part-{k:05d}-{uuid.uuid4().hex}.rds")

    def abort(self, messages: list) -> None:
        store, _ = _files(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(name)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
