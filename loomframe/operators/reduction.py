"""Principal components, and variable genes by a smoothed variance."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.shipping import ships

ships(__name__)


def gram(df: DataFrame, dims: int, vec: str = "vec"):
    """(n, sums, products): moments of vectors of ``dims`` numbers, summed up in each partition first."""
    import numpy as np
    import pandas as pd

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for f in frames:
            if len(f):
                x = np.stack(f[vec].to_numpy())
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "m": [np.concatenate((s, q.ravel())).tolist()]})

    rows = df.select(vec).mapInPandas(part, "n long, m array<double>")
    flat = rows.select("n", F.posexplode("m")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).collect()
    m = np.zeros(dims + dims * dims)
    for r in flat:
        m[r["pos"]] = r["v"]
    return (flat[0]["n"] if flat else 0), m[:dims], m[dims:].reshape(dims, dims)


def principal_components(df: DataFrame, k: int = 50, vec: str = "vec", key: str = "vec_id"):
    """(scores, loadings, variances) as tables.

    Scores (key, pc array) are of centred vectors; loadings (pc, dim, loading)
    have their largest entry positive; variances (pc, variance, ratio, sd). The
    matrix of products has ``dims`` squared numbers, whatever the rows.
    """
    import numpy as np

    spark = df.sparkSession
    dims = df.select(F.size(vec).alias("d")).first()["d"]
    n, s, q = gram(df, dims, vec)
    mean = s / n
    values, axes = np.linalg.eigh((q - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[:k]
    axes, total, values = axes[:, order], values.sum(), values[order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    shift = mean @ axes
    dot = lambda j: F.aggregate(F.zip_with(vec, F.lit([float(x) for x in axes[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - float(shift[j])
    scores = df.select(key, F.array(*[dot(j) for j in range(len(order))]).alias("pc"))
    loadings = spark.createDataFrame([(j + 1, i, float(axes[i, j])) for j in range(len(order)) for i in range(dims)], "pc int, dim int, loading double")
    variances = spark.createDataFrame([(j + 1, float(values[j]), float(values[j] / total), float(max(0.0, values[j]) ** 0.5)) for j in range(len(order))], "pc int, variance double, ratio double, sd double")
    return scores, loadings, variances


#: Genes of a block of the smoothed curve: windows see whole blocks by their moments and the blocks at their ends gene by gene.
CURVE_BLOCK = 512
#: Nodes of which a node of the next level holds the moments.
CURVE_FAN = 8
#: A weight of the curve's fit, by powers of the distance as a share of the window's largest.
_TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))


def _shifted(m, by):
    """Moments sum(x^j) about one centre, as sum((x + by)^j): ``m`` (..., powers) and ``by`` (...)."""
    import math

    import numpy as np

    powers = m.shape[-1]
    steps = np.stack([np.asarray(by, m.dtype) ** j for j in range(powers)], -1)
    return np.stack([sum(math.comb(k, j) * m[..., j] * steps[..., k - j] for j in range(k + 1)) for k in range(powers)], -1)


def _merged(f) -> tuple:
    """(centre, moments of x, moments with y) of all nodes of ``f`` (lo, hi, mx, my) as one, about their middle."""
    import numpy as np

    centre = (f["lo"].min() + f["hi"].max()) / 2
    by = ((f["lo"] + f["hi"]) / 2 - centre).to_numpy()
    return centre, *(_shifted(np.stack(f[c].to_numpy()).astype(np.longdouble), by).sum(0) for c in ("mx", "my"))


def _fit_block(own: int, n: int, k: int, x, y, at, sides):
    """Fitted values at the genes of block ``own``; ``x``, ``y``, ``at``: values and places of the blocks at hand; ``sides``: moments of all whole blocks left and right."""
    import numpy as np

    mine = np.flatnonzero(at // CURVE_BLOCK == own)
    place, here = at[mine], x[mine]
    low = np.minimum(np.maximum(0, place - k // 2), n - k)
    far = np.maximum(1e-9, np.maximum(here - x[np.searchsorted(at, low)], x[np.searchsorted(at, low + k - 1)] - here))
    inside = (at >= low[:, None]) & (at < low[:, None] + k)
    u = (x - here[:, None]) / far[:, None]
    near = np.minimum(np.abs(u), 1)
    w = 1 - near * near * near
    w = np.where(inside, w * w * w + 1e-9, 0.0)
    a, b = [], []
    for p in range(5):
        a.append(w.sum(1))
        if p < 3:
            b.append(w @ y)
        w *= u
    for sign, (centre, mx, my) in sides:  # the whole blocks of a side, as one, about their middle
        mx, my = (_shifted(np.broadcast_to(m / far[:, None].astype(np.longdouble) ** np.arange(len(m)), (len(here), len(m))), (centre - here) / far) for m in (mx, my))
        for p in range(5):
            a[p] = a[p] + sum(c * sign**q * mx[:, p + q] for q, c in _TRICUBE) + 1e-9 * mx[:, p]
        for p in range(3):
            b[p] = b[p] + sum(c * sign**q * my[:, p + q] for q, c in _TRICUBE) + 1e-9 * my[:, p]
    normal = np.stack([np.stack([a[p + q] for q in range(3)], -1) for p in range(3)], -2).astype(float)
    right = np.stack(b, -1).astype(float)
    return mine, (np.linalg.pinv(normal, rcond=1e-14, hermitian=True) @ right[:, :, None])[:, 0, 0]


def local_curve(points: DataFrame, span: float = 0.3, key: str = "gene_id") -> DataFrame:
    """(key, fitted): a local quadratic fit of ``y`` on ``x`` at each of ``points`` (key, x, y), over the ``span`` of them that are next in order.

    Points are in the order of x, then key; weights are tricube. The order is cut
    in blocks. A task fits a block's points: it has the blocks at its windows' ends
    as they are, and of the whole ones between them only the moments, from which
    the weighted sums follow exactly, as a weight is a polynomial on either side of
    a point. Moments are merged level by level, so a block needs few rows of them,
    and work is in proportion to the points but for a logarithm.
    """
    import numpy as np
    import pandas as pd

    from loomframe.functions.shared import cut

    kind = points.schema[key].dataType.simpleString()
    # places from 0: of a range partition, and of the rows before it
    laid = cut(points.select(key, "x", "y").repartitionByRange("x", key).sortWithinPartitions("x", key).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    n = sum(c for _, c in counts)
    if n == 0:
        return points.limit(0).select(key, F.lit(0.0).alias("fitted"))
    k, ahead, before = max(min(n, 4), int(span * n)), [], 0
    for p, c in counts:
        ahead += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += c
    placed = laid.select(key, "x", "y", (F.element_at(F.create_map(*ahead), part) + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("at")).withColumn("block", F.floor(F.col("at") / CURVE_BLOCK))
    blocks = (n - 1) // CURVE_BLOCK + 1

    def moments(f: pd.DataFrame) -> pd.DataFrame:
        x = f["x"].to_numpy().astype(np.longdouble)
        centre = float(f["x"].min() + f["x"].max()) / 2
        m = [((x - centre) ** j).sum() for j in range(14)], [((x - centre) ** j * f["y"].to_numpy()).sum() for j in range(12)]
        return pd.DataFrame({"i": [f["block"].iloc[0]], "lo": [f["x"].min()], "hi": [f["x"].max()], "mx": [[float(v) for v in m[0]]], "my": [[float(v) for v in m[1]]]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        centre, *m = _merged(f)
        return pd.DataFrame({"i": [f["i"].iloc[0] // CURVE_FAN], "lo": [f["lo"].min()], "hi": [f["hi"].max()], "mx": [[float(v) for v in m[0]]], "my": [[float(v) for v in m[1]]]})

    shape, level, width = "i long, lo double, hi double, mx array<double>, my array<double>", 0, blocks
    level_up = cut(placed.groupBy("block").applyInPandas(moments, shape))
    nodes = level_up.withColumn("level", F.lit(0))
    while width > CURVE_FAN:
        level, width = level + 1, -(-width // CURVE_FAN)
        level_up = cut(level_up.groupBy(F.floor(F.col("i") / CURVE_FAN)).applyInPandas(merged, shape))
        nodes = nodes.unionByName(level_up.withColumn("level", F.lit(level)))

    def fit(key_: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        sides = [(sign, _merged(of)) for sign, of in ((-1, sums[sums["side"] < 0]), (1, sums[sums["side"] > 0])) if len(of)]
        mine, fitted = _fit_block(int(key_[0]), n, k, *(rows[c].to_numpy() for c in ("x", "y", "at")), sides)
        return pd.DataFrame({key: rows[key].to_numpy()[mine], "fitted": fitted})

    @F.udf("struct<raw: array<long>, nodes: array<struct<side: int, level: int, i: long>>>")
    def needed(own):
        """The blocks that the fit of block ``own`` needs as they are, and the nodes of which it needs the moments."""
        first, final = (min(max(0, i - k // 2), n - k) for i in (own * CURVE_BLOCK, min(n, (own + 1) * CURVE_BLOCK) - 1))
        a, b, c, d = first // CURVE_BLOCK, final // CURVE_BLOCK, (first + k - 1) // CURVE_BLOCK, (final + k - 1) // CURVE_BLOCK
        raw, out = {own, *range(a, b + 1), *range(c, d + 1)}, []
        for side, low, end in ((-1, b + 1, min(own, c)), (1, max(own, b) + 1, c)):
            while low < end:
                at = 0
                while at < level and low % CURVE_FAN ** (at + 1) == 0 and low + CURVE_FAN ** (at + 1) <= end:
                    at += 1
                out.append((side, at, low // CURVE_FAN**at))
                low += CURVE_FAN**at
        return sorted(raw), out

    need = cut(points.sparkSession.range(blocks).select(F.col("id").alias("own")).withColumn("w", needed("own")))
    raw = placed.join(need.select("own", F.explode("w.raw").alias("block")), "block").select("own", key, "x", "y", "at")
    sums = need.select(F.col("own").alias("to"), F.explode("w.nodes").alias("s")).select("to", "s.*").join(nodes, ["level", "i"]).select("to", "side", "lo", "hi", "mx", "my")
    return raw.groupBy("own").cogroup(sums.groupBy("to")).applyInPandas(fit, f"{key} {kind}, fitted double")


def smoothed_variance(counts: DataFrame, span: float = 0.3, value: str = "count") -> DataFrame:
    """(gene_id, mean, var, score): the variance of counts that are standardised by a curve of variance on mean and clipped.

    The curve is a local quadratic fit of log10 variance on log10 mean over the
    genes, equal means in the order of their keys. Scores are over all cells,
    zeros included.
    """
    from loomframe.functions.shared import cut
    from loomframe.operators.matrix import cell_count, gene_moments

    counts = cut(counts.select("cell_id", "gene_id", value))  # read for the moments, the cells and the scores
    m = cut(gene_moments(counts, value).filter("var > 0 AND mean > 0"))
    curve = local_curve(m.select("gene_id", F.log10("mean").alias("x"), F.log10("var").alias("y")), span)
    fitted = m.join(curve, "gene_id").select("gene_id", "mean", "var", F.pow(F.lit(10.0), F.col("fitted")).alias("expected"))
    n = cell_count(counts)
    sd = F.sqrt("expected")
    z = F.least((F.col(value) - F.col("mean")) / sd, F.sqrt("n"))
    per = counts.join(fitted, "gene_id").crossJoin(F.broadcast(n)).groupBy("gene_id").agg(F.first("mean").alias("mean"), F.first("var").alias("var"), F.first("expected").alias("expected"), F.first("n").alias("n"), F.sum(z * z).alias("q"), F.count("*").alias("nnz"))
    zero = F.col("mean") * F.col("mean") / F.col("expected")
    return per.select("gene_id", "mean", "var", ((F.col("q") + (F.col("n") - F.col("nnz")) * zero) / (F.col("n") - 1)).alias("score"))


def top_genes(scores: DataFrame, n: int, by: str = "score") -> DataFrame:
    top = scores.orderBy(F.round(by, 6).desc(), "gene_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.round(by, 6).desc(), "gene_id")).cast("long"))
