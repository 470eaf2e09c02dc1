"""HDF5 files: 10x matrices and annotated matrices, without another package.

Covers what such files use: groups of either format (as long as their links are
stored in the header or in a symbol table), contiguous, compact and chunked
datasets with the deflate, shuffle and checksum filters, integers, floats,
booleans and strings. A file is parsed by one task from its bytes, so files
stay below 2 GB; many files are parsed side by side.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.shipping import ships

ships(__name__)

_NOWHERE = 0xFFFFFFFFFFFFFFFF


class File:
    """The objects of an HDF5 file in ``raw``."""

    def __init__(self, raw: bytes):
        self.raw = raw
        base = 0
        while raw[base : base + 8] != b"\x89HDF\r\n\x1a\n":  # a user block may come first
            base = base * 2 or 512
            if base >= len(raw):
                raise ValueError("not an HDF5 file")
        self.base, version = base, raw[base + 8]
        if version > 3:
            raise ValueError(f"an HDF5 file of superblock version {version} can't be read")
        offsets, lengths = (raw[base + 13], raw[base + 14]) if version < 2 else (raw[base + 9], raw[base + 10])
        if (offsets, lengths) != (8, 8):
            raise ValueError("an HDF5 file with addresses of other than 8 bytes can't be read")
        if version < 2:
            self.root = self.number(base + 24 + 4 * (version == 1) + 32 + 8)
        else:
            self.root = self.number(base + 12 + 24)
        self.heaps: dict[int, dict[int, bytes]] = {}

    def number(self, at: int, size: int = 8) -> int:
        return int.from_bytes(self.raw[at : at + size], "little")

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, data) of the messages of an object header."""
        at += self.base
        if self.raw[at : at + 4] == b"OHDR":
            flags = self.raw[at + 5]
            pos = at + 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            blocks, head = [(pos + width, self.number(pos, width))], 4 + 2 * bool(flags & 4)
            while blocks:
                pos, size = blocks.pop(0)
                end = pos + size
                while pos + head <= end:
                    kind, n = self.raw[pos], self.number(pos + 1, 2)
                    data = self.raw[pos + head : pos + head + n]
                    if kind == 16:
                        blocks.append((self.base + int.from_bytes(data[:8], "little") + 4, int.from_bytes(data[8:16], "little") - 8))
                    elif kind:
                        yield kind, data
                    pos += head + n
            return
        left = self.number(at + 2, 2)
        blocks = [(at + 16, self.number(at + 8, 4))]
        while blocks and left:
            pos, size = blocks.pop(0)
            end = pos + size
            while pos + 8 <= end and left:
                kind, n = self.number(pos, 2), self.number(pos + 2, 2)
                data = self.raw[pos + 8 : pos + 8 + n]
                left -= 1
                if kind == 16:
                    blocks.append((self.base + int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")))
                elif kind:
                    yield kind, data
                pos += 8 + n

    def links(self, at: int) -> dict[str, int]:
        """Names and addresses of a group's members; empty for a dataset."""
        out: dict[str, int] = {}
        for kind, data in self.messages(at):
            if kind == 17:
                tree, heap = (self.base + int.from_bytes(data[k : k + 8], "little") for k in (0, 8))
                out |= self._symbols(tree, self.base + self.number(heap + 24))
            elif kind == 6:
                flags, pos = data[1], 2
                link = data[pos] if flags & 8 else 0
                pos += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(data[pos : pos + width], "little")
                pos += width
                if link == 0:
                    out[data[pos : pos + n].decode()] = int.from_bytes(data[pos + n : pos + n + 8], "little")
            elif kind == 2 and int.from_bytes(data[2 + 8 * (data[1] & 1) :][:8], "little") != _NOWHERE:
                raise ValueError("a group with its links in a fractal heap can't be read")
        return out

    def _symbols(self, at: int, names: int) -> dict[str, int]:
        out: dict[str, int] = {}
        if self.raw[at : at + 4] == b"SNOD":
            for k in range(self.number(at + 6, 2)):
                entry = at + 8 + 40 * k
                start = names + self.number(entry)
                out[self.raw[start : self.raw.index(b"\0", start)].decode()] = self.number(entry + 8)
            return out
        for k in range(self.number(at + 6, 2)):
            out |= self._symbols(self.base + self.number(at + 24 + 8 + 16 * k), names)
        return out

    def find(self, path: str) -> int | None:
        at = self.root
        for name in filter(None, path.split("/")):
            at = self.links(at).get(name)
            if at is None:
                return None
        return at

    def attributes(self, path: str) -> dict[str, object]:
        out = {}
        for kind, data in self.messages(self.find(path)):
            if kind == 12:
                version = data[0]
                sizes = struct.unpack_from("<HHH", data, 2)
                pos, pad = 8 + (version == 3), (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
                name = data[pos : pos + sizes[0]].split(b"\0")[0].decode()
                pos += pad(sizes[0])
                of = self._type(data[pos : pos + sizes[1]])
                pos += pad(sizes[1])
                shape = self._shape(data[pos : pos + sizes[2]])
                pos += pad(sizes[2])
                values = self._values(data[pos:], of, shape)
                out[name] = values if shape else values.ravel()[0]
        return out

    @staticmethod
    def _type(data: bytes) -> tuple[str, object, int]:
        """(kind, numpy's type, bytes of an element)."""
        kind, bits, size = data[0] & 15, data[1], int.from_bytes(data[4:8], "little")
        order = ">" if bits & 1 else "<"
        if kind == 0:
            return "number", np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), size
        if kind == 1:
            return "number", np.dtype(f"{order}f{size}"), size
        if kind == 3:
            return "text", np.dtype(f"S{size}"), size
        if kind == 8:
            return "bool" if size == 1 and b"TRUE\0" in data else "number", File._type(data[8:])[1], size
        if kind == 9 and bits & 15 == 1:
            return "strings", None, size
        raise ValueError(f"an HDF5 datatype of class {kind} can't be read")

    @staticmethod
    def _shape(data: bytes) -> tuple[int, ...]:
        at = 8 if data[0] == 1 else 4
        return struct.unpack_from(f"<{data[1]}Q", data, at)

    def _values(self, raw: bytes, of: tuple[str, object, int], shape: tuple[int, ...]) -> np.ndarray:
        kind, dtype, size = of
        n = int(np.prod(shape)) if shape else 1
        if kind == "strings":
            out = np.empty(n, object)
            for k in range(n):
                length, heap, index = struct.unpack_from("<IQI", raw, size * k)
                out[k] = self._heap(heap)[index][:length].decode() if length else ""
            return out.reshape(shape)
        values = np.frombuffer(raw, dtype, n).reshape(shape)
        if kind == "text":
            return np.array([v.decode() for v in values.ravel()], object).reshape(shape)
        return values.astype(bool) if kind == "bool" else values.astype(values.dtype.newbyteorder("="))

    def _heap(self, at: int) -> dict[int, bytes]:
        """The objects of a global heap collection."""
        if at not in self.heaps:
            start, held = at + self.base, {}
            pos, end = start + 16, start + self.number(start + 8)
            while pos + 16 <= end:
                index, size = self.number(pos, 2), self.number(pos + 8)
                if not index:
                    break
                held[index] = self.raw[pos + 16 : pos + 16 + size]
                pos += 16 + -(-size // 8) * 8
            self.heaps[at] = held
        return self.heaps[at]

    def read(self, path: str) -> np.ndarray:
        """The whole dataset at a path."""
        at = self.find(path)
        if at is None:
            raise KeyError(path)
        of, shape, layout, filters = None, (), b"", []
        for kind, data in self.messages(at):
            if kind == 1:
                shape = self._shape(data)
            elif kind == 3:
                of = self._type(data)
            elif kind == 8:
                layout = data
            elif kind == 11:
                filters = self._filters(data)
        if of is None or not layout:
            raise KeyError(f"{path} is no dataset")
        if layout[0] != 3:
            raise ValueError(f"a dataset of layout version {layout[0]} can't be read")
        n = int(np.prod(shape)) if shape else 1
        if layout[1] == 0:
            return self._values(layout[4:], of, shape)
        if layout[1] == 1:
            start = int.from_bytes(layout[2:10], "little")
            return self._values(self.raw[self.base + start : self.base + start + n * of[2]] if start != _NOWHERE else bytes(n * of[2]), of, shape)
        rank = layout[2] - 1
        tree, dims = int.from_bytes(layout[3:11], "little"), struct.unpack_from(f"<{rank}I", layout, 11)
        whole = np.zeros((*shape, of[2]), np.uint8)
        if tree != _NOWHERE and n:
            for offset, size, mask, where in self._chunks(self.base + tree, rank):
                raw = self.raw[self.base + where : self.base + where + size]
                for k, (number, values) in reversed(list(enumerate(filters))):
                    if mask >> k & 1:
                        continue
                    raw = zlib.decompress(raw) if number == 1 else np.frombuffer(raw, np.uint8).reshape(values[0], -1).T.tobytes() if number == 2 else raw[:-4]
                part = np.frombuffer(raw, np.uint8, int(np.prod(dims)) * of[2]).reshape(*dims, of[2])
                place = tuple(slice(o, min(o + d, s)) for o, d, s in zip(offset, dims, shape, strict=True))
                whole[place] = part[tuple(slice(0, p.stop - p.start) for p in place)]
        return self._values(whole.tobytes(), of, shape)

    @staticmethod
    def _filters(data: bytes) -> list[tuple[int, tuple[int, ...]]]:
        out, pos = [], 8 if data[0] == 1 else 2
        for _ in range(data[1]):
            number = int.from_bytes(data[pos : pos + 2], "little")
            named = data[0] == 1 or number >= 256
            name = int.from_bytes(data[pos + 2 : pos + 4], "little") if named else 0
            pos += 4 if named else 2
            count = int.from_bytes(data[pos + 2 : pos + 4], "little")
            pos += 4 + (-(-name // 8) * 8 if data[0] == 1 else name)
            out.append((number, struct.unpack_from(f"<{count}I", data, pos)))
            pos += 4 * (count + (count & 1 if data[0] == 1 else 0))
            if number not in (1, 2, 3):
                raise ValueError(f"HDF5 filter {number} can't be undone")
        return out

    def _chunks(self, at: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        level, used, key = self.raw[at + 5], self.number(at + 6, 2), 8 + 8 * (rank + 1)
        for k in range(used):
            pos = at + 24 + k * (key + 8)
            child = self.number(pos + key)
            if level:
                yield from self._chunks(self.base + child, rank)
            else:
                yield struct.unpack_from(f"<{rank}Q", self.raw, pos + 8), self.number(pos, 4), self.number(pos + 4, 4), child


def sparse(file: File, path: str, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of a dataset, or of a group data, indices, indptr, by its encoding."""
    at = file.find(path)
    if at is not None and not file.links(at):
        dense = file.read(path)
        rows, columns = np.nonzero(dense)
        return rows, columns, dense[rows, columns]
    minor, sizes, values = file.read(f"{path}/indices"), np.diff(file.read(f"{path}/indptr")), file.read(f"{path}/data")
    major = np.repeat(np.arange(len(sizes)), sizes)
    of = file.attributes(path)
    by_column = "csc" in str(of.get("encoding-type", of.get("h5sparse_format", "csr")))
    return (minor, major, values) if by_column else (major, minor, values)


def column(file: File, path: str) -> list:
    """A column of a table: a dataset, or a group of categories and codes (a negative one is null)."""
    if file.links(file.find(path)):
        names = file.read(f"{path}/categories").tolist()
        return [names[c] if c >= 0 else None for c in file.read(f"{path}/codes").tolist()]
    values = file.read(path)
    parent = path.rsplit("/", 1)[0]
    old = f"{parent}/__categories/{path.rsplit('/', 1)[1]}"  # how such columns were stored before
    if file.find(old) is not None:
        names = file.read(old).tolist()
        return [names[c] if c >= 0 else None for c in values.tolist()]
    return [None if isinstance(v, float) and v != v else v for v in values.tolist()]


def index_of(file: File, path: str) -> list:
    name = file.attributes(path).get("_index", "_index")
    return column(file, f"{path}/{name if file.find(f'{path}/{name}') is not None else 'index'}")


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def read_10x(spark: SparkSession, pattern: str, feature_type: str | None = "Gene Expression") -> DataFrame:
    """(file, cell_id, gene_id, gene_name, count) of the 10x matrices that match, of either layout; ``feature_type`` picks a modality."""
    import pandas as pd

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                file = File(bytes(raw))
                top = "matrix" if file.find("matrix") is not None else next(iter(file.links(file.root)))
                new = file.find(f"{top}/features") is not None
                ids, names = (np.array(file.read(f"{top}/{x}"), object) for x in (("features/id", "features/name") if new else ("genes", "gene_names")))
                cells, genes, values = file.read(f"{top}/barcodes"), file.read(f"{top}/indices"), file.read(f"{top}/data")
                at = np.repeat(np.arange(len(cells)), np.diff(file.read(f"{top}/indptr")))
                if new and feature_type is not None and file.find(f"{top}/features/feature_type") is not None:
                    keep = np.array(file.read(f"{top}/features/feature_type") == feature_type)[genes]
                    at, genes, values = at[keep], genes[keep], values[keep]
                yield pd.DataFrame({"file": path, "cell_id": np.array(cells, object)[at], "gene_id": ids[genes], "gene_name": names[genes], "count": values.astype(float)})

    return _files(spark, pattern).mapInPandas(work, "file string, cell_id string, gene_id string, gene_name string, count double")


_KINDS = {bool: "boolean", int: "long", float: "double", str: "string"}


def read_annotated(spark: SparkSession, pattern: str, layer: str | None = None) -> dict[str, DataFrame]:
    """counts (file, cell_id, gene_id, count), cells and genes (file, key, columns) and embeddings (file, name, cell_id, vec) of annotated matrices.

    ``layer`` is taken where a file has it, else its main matrix. Columns that
    some files lack are null there.
    """
    import pandas as pd

    files = _files(spark, pattern)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                file, out = File(bytes(raw)), []
                for axis in ("obs", "var"):
                    key = file.attributes(axis).get("_index", "_index")
                    for name in file.links(file.find(axis)):
                        if name not in (key, "index", "__categories"):
                            kinds = {type(v) for v in column(file, f"{axis}/{name}") if v is not None}
                            out.append((axis, name, _KINDS.get(next(iter(kinds)), "string") if len(kinds) == 1 else "string" if kinds else "void"))
                yield pd.DataFrame(out, columns=["axis", "name", "kind"])

    found: dict[str, dict[str, str]] = {"obs": {}, "var": {}}
    for r in files.mapInPandas(named, "axis string, name string, kind string").distinct().orderBy("axis", "name", "kind").collect():
        known = found[r["axis"]].get(r["name"], "void")
        kind = r["kind"] if known == "void" else known if r["kind"] in ("void", known) else "double" if {known, r["kind"]} == {"long", "double"} else "string"
        found[r["axis"]][r["name"]] = kind

    def axis_table(axis: str, key: str) -> DataFrame:
        kinds = {n: "string" if k == "void" else k for n, k in found[axis].items() if n != key}

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for path, raw in zip(f["path"], f["content"], strict=True):
                    file = File(bytes(raw))
                    there = file.links(file.find(axis))
                    keys = [str(x) for x in index_of(file, axis)]
                    cols = {n: [None if v is None else str(v) if k == "string" else float(v) if k == "double" else v for v in column(file, f"{axis}/{n}")] if n in there else [None] * len(keys) for n, k in kinds.items()}
                    yield pd.DataFrame({"file": path, key: keys} | {n: pd.Series(v, dtype=object) for n, v in cols.items()})

        fields = "".join(f", `{n}` {k}" for n, k in kinds.items())
        return files.mapInPandas(work, f"file string, `{key}` string{fields}")

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                file = File(bytes(raw))
                where = f"layers/{layer}" if layer and file.find(f"layers/{layer}") is not None else "X"
                rows, cols, values = sparse(file, where)
                cells, genes = (np.array([str(x) for x in index_of(file, axis)], object) for axis in ("obs", "var"))
                yield pd.DataFrame({"file": path, "cell_id": cells[rows], "gene_id": genes[cols], "count": values.astype(float)})

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                file = File(bytes(raw))
                for name in file.links(file.find("obsm")) if file.find("obsm") is not None else ():
                    if not file.links(file.find(f"obsm/{name}")):
                        values = file.read(f"obsm/{name}").astype(float)
                        yield pd.DataFrame({"file": path, "name": name, "cell_id": [str(x) for x in index_of(file, "obs")], "vec": list(values)})

    return {
        "counts": files.mapInPandas(counts, "file string, cell_id string, gene_id string, count double"),
        "cells": axis_table("obs", "cell_id"),
        "genes": axis_table("var", "gene_id"),
        "embeddings": files.mapInPandas(vectors, "file string, name string, cell_id string, vec array<double>"),
    }


def listing(raw: bytes) -> str:
    """The tree of a file's groups and datasets, as JSON."""
    file = File(raw)

    def tree(at: int) -> object:
        inner = file.links(at)
        return {n: tree(x) for n, x in inner.items()} if inner else None

    return json.dumps(tree(file.root))
