"""Product codes of vectors: integer codebooks by parts, fitted by tree aggregation.

A vector's components become integers ``floor(scale * x)``; the vector is cut
into equal consecutive parts, and each part is coded as the index of the nearest
entry of its position's codebook. Codebooks start as the parts of the vectors
with the smallest ids; each round assigns every part of every vector and moves
an entry to the floor of the mean of its parts.

Vectors are packed once into blocks that hold a NumPy array by column (one row
for each component). ``RDD.treeAggregate`` runs over the blocks: distances of a
part to all entries accumulate component by component, ``np.add.at`` adds sums
and counts into one int64 tensor, and the tensors merge through a tree, so that
the driver gets a few tensors of ``parts * entries * (width + 1)`` numbers,
however many vectors there are. All arithmetic is on integers and exact.

Defined results: rows go whose vector is null, empty, or holds null, NaN or
infinite components, and those of another length than the vector with the
smallest id (null last, then the shorter one). A length that isn't a multiple
of ``parts`` is filled up with zeros, which change no distance. Components are
held within ``MOST`` on either side, so that every sum fits a long. With fewer
vectors than entries, codebooks are shorter. Repeated rows and ids are coded
row by row; among equal ids, vectors are ordered by their components. An empty
table gives no rows and codebooks without entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import broadcast_if_small, discard, in_batches, materialise, ships, table

ships(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest integer component, on either side.
MOST = 1 << 27
#: Vectors of a block.
BLOCK = 2_000


def whole_rows(df: DataFrame, scale: int = SCALE, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, label, v): the rows whose vector is usable, with integer components."""
    vec = F.col(vec_col).cast("array<double>")
    usable = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vec, lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), scale * x))).cast("int"))
    return df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"))


def blocks_of(rows: DataFrame, parts: int) -> DataFrame:
    """(ids, labels, n, block): up to ``BLOCK`` vectors of ``rows``, and their components as int32, component after component."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                n, v = batch.num_rows, batch.column(2)
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)
                flat = np.pad(flat, ((0, 0), (0, -flat.shape[1] % parts)))
                ends = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int32()), pa.array([np.ascontiguousarray(flat.T).tobytes()], pa.binary())], ["ids", "labels", "n", "block"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("n", T.IntegerType()), T.StructField("block", T.BinaryType())])
    return in_batches(rows, work, schema)


def nearest(block: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part: the index of the nearest entry of each vector (the lower of equals), and its squared distance."""
    parts, entries, width = books.shape
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            step = block[p * width + d][None, :] - books[p, :, d][:, None]
            far += step * step
        code = far.argmin(0)
        yield code, np.take_along_axis(far, code[None, :], 0)[0]


def _columns(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, n).astype(np.int64)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all blocks."""
    parts, entries, width = books.shape

    def add(total: np.ndarray, row: tuple) -> np.ndarray:
        block = _columns(row[1], row[0])
        for p, (code, _) in enumerate(nearest(block, books)):
            for d in range(width):
                np.add.at(total[p, :, d], code, block[p * width + d])
            np.add.at(total[p, :, width], code, 1)
        return total

    total = blocks.select("n", "block").rdd.treeAggregate(np.zeros((parts, entries, width + 1), np.int64), add, np.add, 3)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(blocks, codebooks) of ``whole_rows``; codebooks are an array (part, entry, position)."""
    first = rows.agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.size("v").alias("dims")))["dims"].alias("dims")).first()["dims"] or 0
    rows = rows.filter(F.size("v") == first)
    blocks = materialise(blocks_of(rows, parts), "vector-blocks")
    # as many rows as a codebook has entries
    seeds = [r["v"] for r in rows.select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    dims = first + -first % parts
    books = np.zeros((len(seeds), dims), np.int64)
    books[:, :first] = np.array(seeds, np.int64).reshape(len(seeds), first)
    books = books.reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(seeds) else 0):
        books = moved(blocks, books)
    return blocks, books


def codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): one byte or, with more than 256 entries, two (the higher first) for each part, and the squared distance."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema if isinstance(f.dataType, T.ArrayType)}
    wide = np.dtype(">u2" if books.shape[1] > 256 else "u1")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column(2)[k].as_py()
                found = list(nearest(_columns(batch.column(3)[k].as_py(), n), books))
                packed = np.stack([c for c, _ in found], 1).astype(wide)
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    schema = T.StructType([T.StructField("id", kinds["ids"]), T.StructField("label", kinds["labels"]), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return in_batches(blocks, work, schema)


def decoded(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vec``: the entries that ``code`` names, as components before scaling (and zeros that filled the last part)."""
    wide = np.dtype(">u2" if books.shape[1] > 256 else "u1")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(books))
        for batch in batches:
            vecs = [(books[at, np.frombuffer(c, wide)].ravel() / scale).tolist() for c in batch.column(batch.schema.get_field_index("code")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vecs, pa.list_(pa.float64()))], [*batch.schema.names, "vec"])

    return in_batches(coded, work, T.StructType([*coded.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_rows(table(spark, sf_dir, "embeddings"))
    blocks, books = fit(rows)
    found = materialise(codes(blocks, books), "vector-codes")
    discard(blocks)
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = "SELECT {keep}, min(far * 64 + e) AS m FROM (SELECT x.*, e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS far FROM p x JOIN b{k} b ON x.part = b.part) GROUP BY ALL"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, t.part, v[t.part * (len(v) // 16) + 1:(t.part + 1) * (len(v) // 16)] AS v FROM k, range(16) t(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64))",
    ]
    for k in range(2):
        parts.append(f"a{k} AS MATERIALIZED ({near.format(keep='vec_id, part, v', k=k)})")
        parts.append(f"s{k} AS MATERIALIZED (SELECT part, e, list(x ORDER BY i) AS v FROM (SELECT part, m % 64 AS e, i, floor_div AS x FROM (SELECT part, m % 64 AS m, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM a{k}, range(1, 65) t(i) WHERE i <= len(v) GROUP BY 1, 2, 3)) GROUP BY 1, 2)")
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(s.v, b.v) AS v FROM b{k} b LEFT JOIN s{k} s USING (part, e))")
    parts.append(f"f AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM ({near.format(keep='vec_id, label, part', k=2)}) GROUP BY 1, 2)")
    whole = "(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b2)"
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {whole} AS codebooks_sha256 FROM f"


OP11_SQL = _sql()
