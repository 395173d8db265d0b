"""Record blocks: text lines of options, a line that announces n records of a format, then the records.

spark.read.format("recordblock") splits a file by record ranges, so a large
block is read by many tasks; files may be split into parts with suffixes.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_BEGIN = re.compile(rb"^#!Begin data block: n = (\d+), size = (\d+), endian = (\w), format = (\S+)\s*$")
#: Letters of a format and their types (fixed values).
TYPES = {"b": ("i1", T.ByteType()), "B": ("u1", T.ShortType()), "c": ("S1", T.StringType()), "h": ("i2", T.ShortType()), "H": ("u2", T.IntegerType()), "i": ("i4", T.IntegerType()), "I": ("u4", T.LongType()), "l": ("i8", T.LongType()), "L": ("u8", T.DecimalType(20, 0)), "q": ("i8", T.LongType()), "Q": ("u8", T.DecimalType(20, 0)), "f": ("f4", T.FloatType()), "d": ("f8", T.DoubleType())}


def letters(fmt: str) -> list[str]:
    """'4i8d' as a list of letters; x is padding."""
    return [c for n, c in re.findall(r"(\d*)([a-zA-Z])", fmt) for _ in range(int(n or 1))]


def record_dtype(fmt: str, endian: str = "L") -> np.dtype:
    order = "<" if endian.upper() == "L" else ">"
    return np.dtype([(f"f{k}", "V1" if c == "x" else order + TYPES[c][0]) for k, c in enumerate(letters(fmt))])


class Parts:
    """A file, or the parts of one in the order of their suffixes, as one stream."""

    def __init__(self, path: str):
        names = [path] if os.path.exists(path) else sorted(p for p in glob.glob(glob.escape(path) + "*") if re.fullmatch(r"\.?(\d+|[a-z]+)", p[len(path) :]))
        if not names:
            raise FileNotFoundError(path)
        self.parts = [(p, os.path.getsize(p)) for p in names]
        self.size, self.at = sum(n for _, n in self.parts), 0

    def read(self, n: int) -> bytes:
        out, start = [], 0
        for p, size in self.parts:
            a = max(self.at - start, 0)
            if n > 0 and a < size:
                with open(p, "rb") as f:
                    f.seek(a)
                    got = f.read(min(n, size - a))
                out.append(got)
                n -= len(got)
                self.at += len(got)
            start += size
        return b"".join(out)

    def skip(self, n: int) -> None:
        self.at = min(self.size, self.at + n)

    def line(self) -> bytes:
        out = b""
        while True:
            got = self.read(256)
            if not got:
                return out
            end = got.find(b"\n")
            if end >= 0:
                self.at -= len(got) - end - 1
                return out + got[: end + 1]
            out += got


def headers(path: str) -> list[dict]:
    """Every block of a file: n, size, endian, format, where its records begin, and the options before it."""
    from .config import parse

    stream, out, lines = Parts(path), [], []
    while stream.at < stream.size:
        line = stream.line()
        m = _BEGIN.match(line)
        if m is None:
            lines.append(line.decode("utf-8", "replace"))
            continue
        block = {"n": int(m[1]), "size": int(m[2]), "endian": m[3].decode(), "format": m[4].decode(), "at": stream.at, "options": parse("".join(lines))}
        if record_dtype(block["format"]).itemsize != block["size"]:
            raise ValueError(f"{path}: records of {block['size']} bytes are not of format {block['format']}")
        out.append(block)
        stream.skip(block["n"] * block["size"])
        lines = []
    return out


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        super().__init__((first, n))
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", 0))
        self.head = headers(self.path)[self.block]
        self.first = int(options.get("first", 0))
        self.last = min(int(options.get("last", self.head["n"] - 1)), self.head["n"] - 1)
        self.step = int(options.get("recordsPerTask", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(self.step, self.last + 1 - a)) for a in range(self.first, self.last + 1, self.step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        dtype = record_dtype(self.head["format"], self.head["endian"])
        stream, left, at = Parts(self.path), part.n, part.first
        names = [n for n in dtype.names if dtype[n].kind != "V"]
        while left > 0:
            n = min(left, 50_000)
            stream.at = self.head["at"] + at * dtype.itemsize
            rows = np.frombuffer(stream.read(n * dtype.itemsize), dtype)
            cols = [np.char.decode(rows[c], "latin-1").tolist() if rows[c].dtype.kind == "S" else rows[c].tolist() for c in names]
            yield from zip(range(at, at + n), *cols, strict=True)
            left, at = left - n, at + n


class RecordBlocks(DataSource):
    """Options: path, block (0 is the first), first and last (record range), names (comma-separated), recordsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "recordblock"

    def schema(self) -> T.StructType:
        kinds = [TYPES[c][1] for c in letters(headers(self.options["path"])[int(self.options.get("block", 0))]["format"]) if c != "x"]
        names = [n for n in self.options.get("names", "").split(",") if n] or [f"c{k}" for k in range(len(kinds))]
        return T.StructType([T.StructField("pos", T.LongType()), *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class _Written(WriterCommitMessage):
    def __init__(self, part: int, name: str, n: int):
        self.part, self.name, self.n = part, name, n


class _Writer(DataSourceWriter):
    """Each task writes its records to a file of its own; the commit names them as parts and puts the header before them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.format = options["path"], options["recordFormat"]
        self.lines = options.get("header", "")
        self.old = sorted(p for p in glob.glob(glob.escape(self.path) + "*") if p == self.path or re.fullmatch(r"\.\d+", p[len(self.path) :]))
        if self.old and not overwrite:
            raise FileExistsError(self.path)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        packer = struct.Struct("<" + "".join(letters(self.format)).replace("l", "q").replace("L", "Q"))
        name, n = f"{self.path}.writing-{context.taskAttemptId()}", 0
        with open(name, "wb") as f:
            for row in rows:
                f.write(packer.pack(*row))
                n += 1
        return _Written(context.partitionId(), name, n)

    def commit(self, messages: list) -> None:
        for p in self.old:
            os.remove(p)
        size = record_dtype(self.format).itemsize
        n = sum(m.n for m in messages if m)
        with open(f"{self.path}.000000", "w") as f:
            f.write(f"{self.lines}#!Begin data block: n = {n}, size = {size}, endian = L, format = {self.format}\n")
        for m in messages:
            if m:
                os.rename(m.name, f"{self.path}.{m.part + 1:06d}")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.name):
                os.remove(m.name)


def read_blocks(spark: SparkSession, path: str, names: str = "", **options: object) -> DataFrame:
    """A block as a DataFrame, with pos, the record's number."""
    spark.dataSource.register(RecordBlocks)
    reader = spark.read.format("recordblock").option("path", path).option("names", names)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def write_parts(df: DataFrame, path: str, fmt: str, options: dict | None = None, order_by: str | None = "pos") -> None:
    """One block of any size: a part for each task, in a folder that all tasks reach; read it by the same path."""
    df.sparkSession.dataSource.register(RecordBlocks)
    if order_by in df.columns:
        df = df.orderBy(order_by).drop(order_by)
    writer = df.write.format("recordblock").mode("overwrite").option("path", path).option("recordFormat", fmt)
    writer.option("header", "".join(f"{k} = {v}\n" for k, v in (options or {}).items())).save()


def write_blocks(path: str, blocks: list[tuple[DataFrame, str, dict]], order_by: str | None = "pos") -> None:
    """Export DataFrames as consecutive blocks: (rows, format, options).  A native copy is Parquet; this is for small results."""
    with open(path, "wb") as f:
        for df, fmt, options in blocks:
            if order_by in df.columns:
                df = df.orderBy(order_by).drop(order_by)
            packer = struct.Struct("<" + "".join(letters(fmt)).replace("l", "q").replace("L", "Q"))
            n = df.count()
            for k, v in options.items():
                f.write(f"{k} = {v}\n".encode())
            f.write(f"#!Begin data block: n = {n}, size = {packer.size}, endian = L, format = {fmt}\n".encode())
            for row in df.toLocalIterator():
                f.write(packer.pack(*row))
