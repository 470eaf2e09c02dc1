"""R's serialised objects (RDS files): data frames, sparse matrices and what they are made of.

Reads and writes the binary XDR form, gzipped or not, of versions 2 and 3.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.shipping import ships

ships(__name__)

NA_INT = -(2**31)
#: Rows up to which a table is written as one R object, which R holds in memory.
MOST_ROWS = 20_000_000


@dataclass
class RObject:
    """A value (list, numpy array or None) with R's type number and its attributes."""

    kind: int
    value: object = None
    attributes: dict = field(default_factory=dict)

    @property
    def classes(self) -> list[str]:
        found = self.attributes.get("class")
        return list(found.value) if found is not None else []


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.refs = raw, 0, []

    def int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.raw, self.at - 4)[0]

    def length(self) -> int:
        n = self.int()
        return n if n >= 0 else (self.int() << 32) + self.int()

    def numbers(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out.astype(kind.replace(">", "="))

    def item(self) -> RObject:
        flags = self.int()
        kind, has_attributes, has_tag = flags & 255, flags & 512, flags & 1024
        if kind in (254, 253, 242, 241, 251, 252):  # NULL, environments that every session has, missing and unbound
            return RObject(kind)
        if kind == 255:
            return self.refs[(flags >> 8 or self.int()) - 1]
        if kind == 1:
            out = RObject(1, self.item().value)
            self.refs.append(out)
            return out
        if kind == 9:
            n = self.int()
            if n < 0:
                return RObject(9, None)
            self.at += n
            return RObject(9, self.raw[self.at - n : self.at].decode("utf-8", "replace"))
        if kind == 4:
            out = RObject(4)
            self.refs.append(out)
            self.int()
            out.value = [self.item() for _ in range(4)]
            return out
        if kind in (2, 3, 5, 6, 17, 239, 240):
            return self.pairs(kind, has_attributes or kind in (239, 240), has_tag)
        if kind == 238:
            return self.compact(self.item(), self.item(), self.item())
        out = RObject(kind)
        if kind in (10, 13):
            out.value = self.numbers(">i4", self.length())
        elif kind == 14:
            out.value = self.numbers(">f8", self.length())
        elif kind == 15:
            out.value = self.numbers(">c16", self.length())
        elif kind == 24:
            out.value = self.numbers("u1", self.length())
        elif kind == 16:
            out.value = [self.item().value for _ in range(self.length())]
        elif kind in (19, 20):
            out.value = [self.item() for _ in range(self.length())]
        elif kind in (7, 8):
            n = self.int()
            out.value, self.at = self.raw[self.at : self.at + n].decode(), self.at + n
        elif kind == 22:  # an external pointer
            self.refs.append(out)
            out.value = [self.item(), self.item()]
        elif kind != 25:
            raise ValueError(f"an R object of type {kind} can't be read")
        if has_attributes:
            out.attributes = self.attributes()
        return out

    def pairs(self, kind: int, has_attributes: int, has_tag: int) -> RObject:
        """A pairlist, as (tag, value) pairs; without recursion along the list."""
        out = RObject(kind, [])
        while True:
            if has_attributes:
                out.attributes |= self.attributes()
            tag = self.item().value if has_tag else None
            out.value.append((tag, self.item()))
            flags = self.int()
            if flags & 255 not in (2, 6, 239, 240):
                self.at -= 4
                last = self.item()
                if last.kind != 254:
                    out.value.append((None, last))
                return out
            has_attributes, has_tag = flags & 512, flags & 1024

    def attributes(self) -> dict:
        found = self.item()
        return {tag: x for tag, x in found.value or []}

    def compact(self, info: RObject, state: RObject, attributes: RObject) -> RObject:
        """Sequences and wrapped vectors that R stores in short."""
        name = info.value[0][1].value
        if name in ("compact_intseq", "compact_realseq"):
            n, first, step = state.value[:3]
            whole = first + step * np.arange(int(n))
            out = RObject(13, whole.astype("i4")) if name == "compact_intseq" else RObject(14, whole)
        elif name.startswith("wrap_"):
            inner = state.value[0]
            out = inner[1] if isinstance(inner, tuple) else inner
        elif name == "deferred_string":
            numbers = state.value[0][1].value
            out = RObject(16, [None if x == NA_INT or x != x else str(int(x)) if float(x).is_integer() else repr(float(x)) for x in numbers])
        else:
            raise ValueError(f"an R object of class {name} can't be read")
        out.attributes |= {tag: x for tag, x in attributes.value or []}
        return out


def parse(raw: bytes) -> RObject:
    """The object in the bytes of an RDS file."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if raw[:2] != b"X\n":
        raise ValueError("not an RDS file in binary form")
    reader = _Reader(raw)
    reader.at = 2
    version = reader.int()
    reader.int(), reader.int()
    if version == 3:
        n = reader.int()  # the native encoding's name
        reader.at += n
    return reader.item()


def read_rds(spark: SparkSession, path: str) -> RObject:
    """The object of one file, from any file system that Spark reads; it is held on the driver, as R would hold it."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(path) if not rows else ValueError(f"{path} names several files")
    return parse(bytes(rows[0]["content"]))


def contents(found: RObject, prefix: str = "", depth: int = 3) -> list[tuple[str, str, int]]:
    """(path, class, length) of an object and what it holds, down to ``depth``."""
    names = found.attributes.get("names")
    size = len(found.value) if hasattr(found.value, "__len__") else 0
    out = [(prefix or "/", "/".join(found.classes) or f"type {found.kind}", size)]
    if depth:
        inner = {k: v for k, v in found.attributes.items() if found.kind == 25 and k != "class"}
        if found.kind == 19:
            inner |= {(names.value[i] if names else str(i)): x for i, x in enumerate(found.value)}
        for name, x in inner.items():
            out += contents(x, f"{prefix}/{name}", depth - 1)
    return out


def find(found: RObject, path: str) -> RObject:
    """What lies at a path of slots and names, such as ``assays/RNA/counts``."""
    for name in path.strip("/").split("/"):
        if name in found.attributes and name != "names":
            found = found.attributes[name]
        else:
            found = found.value[found.attributes["names"].value.index(name)]
    return found


def _column(x: RObject) -> tuple[list, T.DataType]:
    if x.kind == 16:
        return x.value, T.StringType()
    if x.kind == 10:
        return [None if v == NA_INT else bool(v) for v in x.value.tolist()], T.BooleanType()
    if x.kind == 13 and "levels" in x.attributes:
        levels = x.attributes["levels"].value
        return [None if v == NA_INT else levels[v - 1] for v in x.value.tolist()], T.StringType()
    if x.kind == 13:
        return [None if v == NA_INT else v for v in x.value.tolist()], T.IntegerType()
    if x.kind == 14:
        return [None if v != v else v for v in x.value.tolist()], T.DoubleType()
    raise ValueError(f"a column of R's type {x.kind} can't be a column here")


def frame(spark: SparkSession, found: RObject, row_names: str | None = "row_name") -> DataFrame:
    """A data frame as a table; NA and NaN are null, factors their levels; row names that are text become a column."""
    columns = {n: _column(x) for n, x in zip(found.attributes["names"].value, found.value, strict=True)}
    rows = found.attributes.get("row.names")
    if row_names and rows is not None and rows.kind == 16:
        columns = {row_names: (rows.value, T.StringType())} | columns
    schema = T.StructType([T.StructField(n, t) for n, (_, t) in columns.items()])
    return spark.createDataFrame(list(zip(*[v for v, _ in columns.values()], strict=True)), schema)


def matrix(spark: SparkSession, found: RObject) -> DataFrame:
    """(gene_id, cell_id, count) of a column-compressed sparse matrix (genes x cells)."""
    of = found.attributes
    genes, cells = (x.value for x in of["Dimnames"].value)
    sizes = np.diff(of["p"].value)
    at = np.repeat(np.arange(len(sizes)), sizes)
    rows = [(genes[g] if genes else str(g), cells[c] if cells else str(c), float(v)) for g, c, v in zip(of["i"].value.tolist(), at.tolist(), of["x"].value.tolist(), strict=True)]
    return spark.createDataFrame(rows, "gene_id string, cell_id string, count double")


def read_matrices(spark: SparkSession, pattern: str, slot: str = "") -> DataFrame:
    """(file, gene_id, cell_id, count) of the sparse matrices in all files that match, each parsed by one task."""
    import pandas as pd

    def work(frames):
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                whole = parse(bytes(raw))
                of = (find(whole, slot) if slot else whole).attributes
                genes, cells = (np.array(x.value, object) for x in of["Dimnames"].value)
                sizes = np.diff(of["p"].value)
                yield pd.DataFrame({"file": path, "gene_id": genes[of["i"].value], "cell_id": np.repeat(cells, sizes), "count": of["x"].value})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(work, "file string, gene_id string, cell_id string, count double")


class _Writer:
    def __init__(self):
        self.out = bytearray(b"X\n" + struct.pack(">iii", 2, 0x00040000, 0x00020300))

    def flags(self, kind: int, attributes: dict, tag: bool = False) -> None:
        self.out += struct.pack(">i", kind | (256 if "class" in attributes else 0) | (512 if attributes else 0) | (1024 if tag else 0))

    def text(self, value: str | None) -> None:
        raw = b"" if value is None else value.encode()
        self.out += struct.pack(">ii", 9 | (0 if value is None else 8 << 12), -1 if value is None else len(raw)) + raw

    def symbol(self, name: str) -> None:
        self.out += struct.pack(">i", 1)
        self.text(name)

    def item(self, x: RObject) -> None:
        if x.kind == 254:
            self.out += struct.pack(">i", 254)
            return
        self.flags(x.kind, x.attributes)
        if x.kind != 25:
            self.out += struct.pack(">i", len(x.value))
        if x.kind in (10, 13):
            self.out += np.asarray(x.value, ">i4").tobytes()
        elif x.kind == 14:
            self.out += np.asarray(x.value, ">f8").tobytes()
        elif x.kind == 16:
            for v in x.value:
                self.text(v)
        elif x.kind == 19:
            for v in x.value:
                self.item(v)
        if x.attributes:
            for name, v in x.attributes.items():
                self.out += struct.pack(">i", 2 | 1024)
                self.symbol(name)
                self.item(v)
            self.out += struct.pack(">i", 254)


def dump(x: RObject) -> bytes:
    """The bytes of an RDS file (version 2, gzipped)."""
    writer = _Writer()
    writer.item(x)
    return gzip.compress(bytes(writer.out), mtime=0)


def _save(spark: SparkSession, raw: bytes, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(raw)
    finally:
        stream.close()


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: an R object is held in memory; write Parquet instead")
    return rows


def write_frame(df: DataFrame, path: str, most: int = MOST_ROWS) -> None:
    """A table as a data frame in one file; an error beyond ``most`` rows."""
    rows = _rows(df, most)
    columns = []
    for k, f in enumerate(df.schema):
        values = [r[k] for r in rows]
        if isinstance(f.dataType, T.BooleanType):
            columns.append(RObject(10, [NA_INT if v is None else int(v) for v in values]))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            columns.append(RObject(13, [NA_INT if v is None else v for v in values]))
        elif isinstance(f.dataType, T.NumericType):
            columns.append(RObject(14, [float("nan") if v is None else float(v) for v in values]))
        else:
            columns.append(RObject(16, [None if v is None else str(v) for v in values]))
    names = {"names": RObject(16, list(df.columns)), "row.names": RObject(13, [NA_INT, -len(rows)]), "class": RObject(16, ["data.frame"])}
    _save(df.sparkSession, dump(RObject(19, columns, names)), path)


def write_matrix(counts: DataFrame, path: str, gene: str = "gene_id", cell: str = "cell_id", value: str = "count", most: int = MOST_ROWS) -> None:
    """A count table as a column-compressed sparse matrix in one file; an error beyond ``most`` entries."""
    rows = _rows(counts.select(F.col(gene).cast("string"), F.col(cell).cast("string"), F.col(value).cast("double")), most)
    genes, cells = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    g, c = {x: i for i, x in enumerate(genes)}, {x: i for i, x in enumerate(cells)}
    entries = sorted((c[r[1]], g[r[0]], r[2]) for r in rows)
    upto = np.searchsorted([e[0] for e in entries], np.arange(len(cells) + 1))
    slots = {"i": RObject(13, [e[1] for e in entries]), "p": RObject(13, upto), "Dim": RObject(13, [len(genes), len(cells)]), "Dimnames": RObject(19, [RObject(16, genes), RObject(16, cells)]), "x": RObject(14, [e[2] for e in entries]), "factors": RObject(19, [])}
    package = RObject(16, ["dgCMatrix"], {"package": RObject(16, ["Matrix"])})
    _save(counts.sparkSession, dump(RObject(25, None, slots | {"class": package})), path)


def convert(spark: SparkSession, path: str, folder: str, slots: dict[str, str] | None = None) -> list[tuple[str, str, int]]:
    """The matrices (name -> path of slots; the object itself by default) of a file as Parquet tables in ``folder``, and the listing of its contents."""
    whole = read_rds(spark, path)
    for name, slot in (slots or {"counts": ""}).items():
        matrix(spark, find(whole, slot) if slot else whole).write.mode("overwrite").parquet(f"{folder}/{name}")
    return contents(whole)
