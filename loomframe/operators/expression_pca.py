"""Principal components of a scaled expression matrix, from its entries alone.

The matrix of cells by genes is A = S + 1 zero', where S is sparse: an absent
entry of a scaled and clipped matrix is its gene's ``zero``. Centring takes every
column's mean, so that B = S - 1 mean(S)': neither the zeros nor the centred
matrix are ever made, and clipping is in S already.

A pass multiplies the products B'B with a block of vectors. Each task keeps the
sums of its own cells, cell by cell sparse; the tasks' sums (genes times vectors)
are added up in a tree. Work and shuffles of a pass are linear in the entries, and
the driver holds arrays of genes times vectors, whatever the number of cells.

Subspace iteration starts from a random block and keeps all of its blocks, each
made orthogonal to those before (a block Krylov space), so that a few passes reach
what plain iteration takes hundreds for. It ends when the residuals of all wanted
components are below ``tolerance`` of the largest variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shared import cut
from loomframe.functions.shipping import ships
from loomframe.functions.sums import strips, summed

ships(__name__)

#: Bytes of the blocks that the driver keeps; beyond, they are compressed to the best block and a half.
MOST_BYTES = 512 << 20
#: Entries that a task multiplies at once.
AT_ONCE = 200_000


@dataclass
class Components:
    """``scores`` (cell_id, pc array), ``loadings`` (pc, gene_id, loading), ``variances`` (pc, variance, ratio, sd, residual)."""

    scores: DataFrame
    loadings: DataFrame
    variances: DataFrame
    passes: int


def _products(rows: Iterator, vectors) -> Iterator:
    """For each piece of Arrow batches (idx, val): the cells' sparse rows times ``vectors``, with the entries."""
    import numpy as np

    for batch in rows:
        idx, val = batch.column(batch.schema.get_field_index("idx")), batch.column(batch.schema.get_field_index("val"))
        ends = idx.offsets.to_numpy()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, "right")) - 1)
            g, x = (c.values.to_numpy(zero_copy_only=False)[ends[a] : ends[b]] for c in (idx, val))
            own = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            y = np.stack([np.bincount(own, x * v[g], b - a) for v in vectors.T], 1)
            yield batch, a, b, g, x, own, y
            a = b


def sparse_rows(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(cell_id, idx, val): a row for each cell that has an entry (cell_id, gene_id, s); a cell has a gene at most once."""
    own = entries.join(index, "gene_id").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("g", "s"))).alias("e"))
    return own.select("cell_id", F.transform("e", lambda e: e["g"]).alias("idx"), F.transform("e", lambda e: e["s"]).alias("val"))


def _multiply(rows: DataFrame, tasks: int, genes: int) -> Callable:
    """vectors -> S'S vectors, in one pass over ``rows``."""
    context = rows.sparkSession.sparkContext

    def times(vectors):
        import numpy as np

        shared, width = context.broadcast(vectors), vectors.shape[1]

        def part(batches: Iterator) -> Iterator:
            total = np.zeros((genes, width))
            for _, _, _, g, x, own, y in _products(batches, shared.value):
                for j in range(width):
                    total[:, j] += np.bincount(g, x * y[own, j], genes)
            yield strips(total)

        out = summed(rows.select("idx", "val").mapInArrow(part, "strip int, v binary"), tasks, (genes, width))
        shared.unpersist()
        return out

    return times


def _leading(times: Callable, genes: int, k: int, seed: int, tolerance: float, passes: int):
    """(values, vectors, residuals, passes) of the ``k`` largest eigenvalues of the symmetric operator ``times``."""
    import numpy as np

    width = min(genes, k + 10)
    fresh = np.linalg.qr(np.random.default_rng(seed).normal(size=(genes, width)))[0]
    basis, image, most = np.zeros((genes, 0)), np.zeros((genes, 0)), max(3 * width, MOST_BYTES // (16 * genes))

    def best(n: int):
        """The ``n`` best pairs within the basis, and the vectors' images."""
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-values)[:n]
        return values[order], basis @ turn[:, order], image @ turn[:, order]

    for done in range(1, passes + 1):
        moved = times(fresh)
        basis, image = np.hstack((basis, fresh)), np.hstack((image, moved))
        scale = max(float(np.linalg.norm(moved, 2)), 1e-300)
        for _ in range(2):  # twice, as once leaves rounding errors
            moved = moved - basis @ (basis.T @ moved)
        left, sizes, _ = np.linalg.svd(moved, full_matrices=False)
        fresh = left[:, sizes > 1e-13 * scale]
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0][:, : genes - basis.shape[1]]
        ends = not fresh.shape[1] or done == passes  # the basis holds all there is, or the passes are used up
        full = basis.shape[1] + fresh.shape[1] > most
        if ends or full or done % 3 == 1:  # a look costs more, the larger the basis
            values, vectors, images = best(width + width // 2)
            residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
            if ends or residuals.max() <= tolerance * max(float(values[0]), 0.0):
                break
            if full:
                basis, image = vectors, images
    return values[:k], vectors[:, :k], residuals, done


def components(scaled: DataFrame, cells: DataFrame, k: int = 50, seed: int = 42, tolerance: float = 1e-10, passes: int = 60) -> Components:
    """The first ``k`` components of a matrix of ``cells`` (cell_id) by the genes of ``scaled`` (cell_id, gene_id, z, zero).

    ``scaled`` has an entry at most once; absent entries are their gene's
    ``zero``, so a cell may have none. Loadings have their largest entry positive.
    ``ratio`` is of the variance of all genes. There are never more components
    than genes, or than cells but one. ``residual`` is the norm of what a
    component misses of an eigenvector, relative to the largest variance.

    Genes are an axis of the study: their list and a few blocks of vectors of
    their length are on the driver.
    """
    import numpy as np

    spark = scaled.sparkSession
    entries = cut(scaled.select("cell_id", "gene_id", (F.col("z") - F.col("zero")).cast("double").alias("s")))
    per = sorted(entries.groupBy("gene_id").agg(F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("q")).collect(), key=lambda r: r["gene_id"])
    cells = cells.select("cell_id").distinct()
    n, genes = cells.count(), len(per)
    kind = scaled.schema["gene_id"].dataType.simpleString()
    index = spark.createDataFrame([(r["gene_id"], i) for i, r in enumerate(per)], f"gene_id {kind}, g int")
    rows = cut(sparse_rows(entries.filter("s <> 0"), index))
    mean = np.array([r["a"] for r in per]) / max(n, 1)
    total = float((np.array([r["q"] for r in per]) - n * mean * mean).sum()) / max(1, n - 1)
    k = max(0, min(k, genes, n - 1))
    if k:
        plain = _multiply(rows, rows.rdd.getNumPartitions(), genes)
        centred = lambda v: (plain(v) - n * np.outer(mean, mean @ v)) / (n - 1)
        values, axes, residuals, done = _leading(centred, genes, k, seed, tolerance, passes)
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    else:
        values, axes, residuals, done = np.zeros(0), np.zeros((genes, 0)), np.zeros(0), 0
    scale = max(float(values[0]), 1e-300) if k else 1.0
    table = [(j + 1, float(v), float(v / total) if total > 0 else 0.0, float(max(0.0, v) ** 0.5), float(e / scale)) for j, (v, e) in enumerate(zip(values, residuals, strict=True))]
    variances = spark.createDataFrame(table, "pc int, variance double, ratio double, sd double, residual double")
    loaded = spark.createDataFrame([(r["gene_id"], axes[i].tolist()) for i, r in enumerate(per)], f"gene_id {kind}, v array<double>")
    loadings = loaded.select("gene_id", F.posexplode("v").alias("j", "loading")).select((F.col("j") + 1).alias("pc"), "gene_id", "loading")
    return Components(_scores(rows, cells, axes, mean @ axes), loadings, variances, done)


def _scores(rows: DataFrame, cells: DataFrame, axes, shift) -> DataFrame:
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(axes)
    width = axes.shape[1]

    def part(batches: Iterator) -> Iterator:
        for batch, a, b, _, _, _, y in _products(batches, shared.value):
            flat = pa.array((y - shift).ravel(), pa.float64())
            ends = pa.array(range(0, (b - a) * width + 1, width), pa.int32()) if width else pa.array([0] * (b - a + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, flat)], ["cell_id", "pc"])

    kind = rows.schema["cell_id"].dataType.simpleString()
    if not width:
        return cells.select("cell_id", F.expr("cast(array() as array<double>)").alias("pc"))
    found = rows.mapInArrow(part, f"cell_id {kind}, pc array<double>")
    none = F.array(*[F.lit(float(-x)) for x in shift])
    return cells.join(found, "cell_id", "left").select("cell_id", F.coalesce("pc", none).alias("pc"))
