"""RDS and HDF5 files, read from bytes that the tests put together."""

import struct
import zlib

import numpy as np
import pytest

from loomframe.sources import hdf5, rds


def test_frame_round_trip(spark, tmp_path):
    rows = [(1, 2.5, "a", True, 10**12), (None, None, None, None, None), (3, -1.0, "é", False, 4)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, l long")
    path = f"file://{tmp_path}/x.rds"
    rds.write_frame(df, path)
    back = rds.frame(spark, rds.read_rds(spark, path))
    assert back.columns == df.columns
    assert [tuple(r) for r in back.collect()] == [(a, b, c, d, None if e is None else float(e)) for a, b, c, d, e in rows]
    rds.write_frame(df.limit(0), path)
    assert rds.frame(spark, rds.read_rds(spark, path)).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        rds.write_frame(df, path, most=1)


def test_matrix_round_trip(spark, tmp_path):
    rows = [("g1", "c2", 3.0), ("g2", "c1", 1.0), ("g3", "c3", 2.0), ("g1", "c3", 5.0)]
    path = f"file://{tmp_path}/m.rds"
    rds.write_matrix(spark.createDataFrame(rows, "gene_id string, cell_id string, count double"), path)
    whole = rds.read_rds(spark, path)
    assert whole.classes == ["dgCMatrix"]
    assert sorted(map(tuple, rds.matrix(spark, whole).collect())) == sorted(rows)
    assert sorted((r.gene_id, r.cell_id, r["count"]) for r in rds.read_matrices(spark, f"file://{tmp_path}/*.rds").collect()) == sorted(rows)
    listing = rds.convert(spark, path, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/counts").count() == 4 and ("/Dim", "type 13", 2) in listing


def test_forms_that_r_writes():
    """Factors, compact sequences, references to symbols, version 3, as in R's serialisation."""
    i = lambda *x: struct.pack(f">{len(x)}i", *x)
    char = lambda s: i(0x00040009, len(s)) + s.encode()
    symbol = lambda s: i(1) + char(s)
    compact = i(238) + i(2) + symbol("compact_intseq") + i(2) + symbol("base") + i(2) + i(13, 1, 13) + i(254) + i(14, 3) + struct.pack(">3d", 4, 2, 1) + i(254)
    factor = i(13 | 512 | 256, 3, 2, 1, -(2**31)) + i(1026) + symbol("levels") + i(16, 2) + char("x") + char("y") + i(1026) + symbol("class") + i(16, 1) + char("factor") + i(254)
    names = i(1026) + symbol("names") + i(16, 2) + char("a") + char("f") + i(1026) + i(255 | 4 << 8) + i(16, 1) + char("data.frame") + i(254)
    whole = rds.parse(b"X\n" + i(3, 0, 0, 5) + b"UTF-8" + i(19 | 512 | 256, 2) + compact + factor + names)
    assert whole.value[0].value.tolist() == [2, 3, 4, 5][:4] and whole.classes == ["data.frame"]
    assert rds._column(whole.value[1])[0] == ["y", "x", None]


class Hdf5Writer:
    """Just enough of the format: symbol-table groups, contiguous and chunked datasets, strings, attributes."""

    def __init__(self):
        self.raw = bytearray(96)

    def put(self, data: bytes) -> int:
        self.raw += bytes(-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += data
        return at

    def heap(self, texts: list[str]) -> bytes:
        """References to a global heap collection that holds the texts."""
        body = b""
        for k, t in enumerate(texts):
            raw = t.encode()
            body += struct.pack("<HHIQ", k + 1, 1, 0, len(raw)) + raw + bytes(-len(raw) % 8)
        body += bytes(16)
        at = self.put(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", 16 + len(body)) + body)
        return b"".join(struct.pack("<IQI", len(t.encode()), at, k + 1) for k, t in enumerate(texts))

    @staticmethod
    def space(shape):
        return bytes([1, len(shape), 0, 0, 0, 0, 0, 0]) + struct.pack(f"<{len(shape)}Q", *shape)

    def typed(self, values):
        """(datatype message, raw data)."""
        if isinstance(values, np.ndarray) and values.dtype.kind in "iu":
            return bytes([0x10, 8 if values.dtype.kind == "i" else 0, 0, 0]) + struct.pack("<IHH", values.itemsize, 0, 8 * values.itemsize), values.tobytes()
        if isinstance(values, np.ndarray) and values.dtype.kind == "f":
            return bytes([0x11, 0x20, 0x3F, 0]) + struct.pack("<IHHBBBBI", values.itemsize, 0, 8 * values.itemsize, 52, 11, 0, 52, 1023), values.tobytes()
        if isinstance(values, np.ndarray) and values.dtype.kind == "S":
            return bytes([0x13, 0, 0, 0]) + struct.pack("<I", values.itemsize), values.tobytes()
        return bytes([0x19, 1, 0, 0]) + struct.pack("<I", 16) + bytes([0x13, 0, 0, 0]) + struct.pack("<I", 1), self.heap(list(values))

    def header(self, messages):
        body = b""
        for kind, data in messages:
            data += bytes(-len(data) % 8)
            body += struct.pack("<HHBBBB", kind, len(data), 0, 0, 0, 0) + data
        return self.put(struct.pack("<BBHII", 1, 0, len(messages), 1, len(body)) + bytes(4) + body)

    def attributes(self, named):
        out = []
        for name, text in named.items():
            kind, raw = self.typed([text])
            pad = lambda b: b + bytes(-len(b) % 8)
            title = name.encode() + b"\0"
            out.append((12, struct.pack("<BBHHH", 1, 0, len(title), len(kind), 8) + pad(title) + pad(kind) + self.space(()) + raw))
        return out

    def dataset(self, values, chunk=None):
        kind, raw = self.typed(values)
        shape = np.shape(values) if not isinstance(values, list) else (len(values),)
        if chunk is None:
            layout = struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw))
            return self.header([(1, self.space(shape)), (3, kind), (8, layout)])
        size, entries = values.itemsize, []
        for at in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
            part = np.zeros(chunk, values.dtype)
            piece = values[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunk))]
            part[tuple(slice(0, n) for n in piece.shape)] = piece
            packed = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, size).T.tobytes())
            entries.append((struct.pack(f"<II{len(shape) + 1}Q", len(packed), 0, *[a * c for a, c in zip(at, chunk)], 0), self.put(packed)))
        node = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(entries), 2**64 - 1, 2**64 - 1) + b"".join(k + struct.pack("<Q", a) for k, a in entries) + entries[-1][0]
        layout = struct.pack("<BBBQ", 3, 2, len(shape) + 1, self.put(node)) + struct.pack(f"<{len(shape) + 1}I", *chunk, size)
        filters = bytes([1, 2]) + bytes(6) + struct.pack("<HHHHII", 2, 0, 0, 1, size, 0) + struct.pack("<HHHHII", 1, 0, 0, 1, 6, 0)
        return self.header([(1, self.space(shape)), (3, kind), (11, filters), (8, layout)])

    def group(self, members, attributes=None):
        names, offsets = bytearray(8), {}
        for name in sorted(members):
            offsets[name] = len(names)
            names += name.encode() + b"\0"
            names += bytes(-len(names) % 8)
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), 2**64 - 1, self.put(bytes(names))))
        ordered = sorted(members)
        halves = [ordered[: len(ordered) // 2], ordered[len(ordered) // 2 :]]
        nodes = []
        for half in filter(None, halves):
            body = b"".join(struct.pack("<QQII", offsets[n], members[n], 0, 0) + bytes(16) for n in half)
            nodes.append(self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(half)) + body))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), 2**64 - 1, 2**64 - 1) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + bytes(8))
        return self.header([(17, struct.pack("<QQ", tree, heap)), *self.attributes(attributes or {})])

    def save(self, path, members):
        root = self.group(members)
        head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIQQQQ", 4, 16, 0, 0, 2**64 - 1, len(self.raw), 2**64 - 1) + struct.pack("<QQII", 0, root, 0, 0) + bytes(16)
        self.raw[: len(head)] = head
        path.write_bytes(bytes(self.raw))


def test_10x(spark, tmp_path):
    w = Hdf5Writer()
    features = w.group({"id": w.dataset(np.array([b"g0", b"g1", b"g2"])), "name": w.dataset(["A", "B", "Cé"]), "feature_type": w.dataset(["Gene Expression", "Antibody Capture", "Gene Expression"])})
    data = {"data": w.dataset(np.array([5, 1, 2, 7], np.int32), (3,)), "indices": w.dataset(np.array([0, 1, 2, 2]), (2,)), "indptr": w.dataset(np.array([0, 2, 2, 4])), "barcodes": w.dataset(np.array([b"AA-1", b"CC-1", b"GG-1"])), "features": features, "shape": w.dataset(np.array([3, 3]))}
    w.save(tmp_path / "s1.h5", {"matrix": w.group(data)})
    got = sorted((r.cell_id, r.gene_id, r.gene_name, r["count"]) for r in hdf5.read_10x(spark, f"file://{tmp_path}/*.h5").collect())
    assert got == [("AA-1", "g0", "A", 5.0), ("GG-1", "g2", "Cé", 2.0), ("GG-1", "g2", "Cé", 7.0)]
    assert hdf5.read_10x(spark, f"file://{tmp_path}/*.h5", None).count() == 4
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.File(b"something else" * 100)


def test_annotated(spark, tmp_path):
    w = Hdf5Writer()
    counts = np.array([[1, 0, 2], [0, 3, 0]], float)
    x = w.group({"data": w.dataset(np.array([1.0, 2.0, 3.0])), "indices": w.dataset(np.array([0, 2, 1])), "indptr": w.dataset(np.array([0, 2, 3]))}, {"encoding-type": "csr_matrix"})
    by_column = w.group({"data": w.dataset(np.array([1.0, 3.0, 2.0])), "indices": w.dataset(np.array([0, 1, 0])), "indptr": w.dataset(np.array([0, 1, 2, 3]))}, {"encoding-type": "csc_matrix"})
    label = w.group({"categories": w.dataset(["B", "T"]), "codes": w.dataset(np.array([1, -1], np.int8))})
    obs = w.group({"barcode": w.dataset(["c1", "c2"]), "label": label, "score": w.dataset(np.array([0.5, np.nan])), "n": w.dataset(np.array([4, 5]))}, {"_index": "barcode"})
    var = w.group({"_index": w.dataset(["g1", "g2", "g3"])}, {"_index": "_index"})
    vec = np.arange(6, dtype=float).reshape(2, 3)
    w.save(tmp_path / "a.h5ad", {"X": x, "layers": w.group({"counts": by_column, "dense": w.dataset(counts, (1, 2))}), "obs": obs, "var": var, "obsm": w.group({"X_pca": w.dataset(vec, (2, 2))})})
    path = f"file://{tmp_path}/*.h5ad"
    want = sorted((f"c{i + 1}", f"g{j + 1}", counts[i, j]) for i, j in zip(*np.nonzero(counts)))
    for layer in (None, "counts", "dense", "absent"):
        found = hdf5.read_annotated(spark, path, layer)
        assert sorted((r.cell_id, r.gene_id, r["count"]) for r in found["counts"].collect()) == want
    assert [tuple(r)[1:] for r in found["cells"].orderBy("cell_id").select("file", "cell_id", "label", "n", "score").collect()] == [("c1", "T", 4, 0.5), ("c2", None, 5, None)]
    assert [r.gene_id for r in found["genes"].orderBy("gene_id").collect()] == ["g1", "g2", "g3"]
    assert [(r.name, r.cell_id, list(r.vec)) for r in found["embeddings"].orderBy("cell_id").collect()] == [("X_pca", "c1", [0.0, 1.0, 2.0]), ("X_pca", "c2", [3.0, 4.0, 5.0])]
    assert '"X_pca": null' in hdf5.listing((tmp_path / "a.h5ad").read_bytes())
