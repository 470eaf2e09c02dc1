"""A two-dimensional layout of a neighbour graph: fuzzy weights, then attraction and repulsion in rounds.

All rounds are joins and aggregates: attraction along the edges, repulsion among
the nodes that a round's digest puts in one bucket, as a random sample of the
others. Nothing is held on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shared import cut, unit
from loomframe.functions.shipping import ships

ships(__name__)

#: Nodes of a bucket, among which nodes repel each other in a round.
BUCKET = 128


def fuzzy_weights(knn: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: memberships exp(-(d - rho) / sigma) of neighbours (src, dst, dist), joined as a + b - a b.

    rho is the distance of the nearest one, and sigma such that the memberships
    of a node's k neighbours add up to log2(k).
    """
    import numpy as np
    import pandas as pd

    def smooth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for src, near in zip(f["src"], f["near"], strict=True):
                d = np.array([x["dist"] for x in near])
                rho = d[d > 0].min(initial=np.inf)
                gap = np.maximum(d - (rho if np.isfinite(rho) else 0.0), 0)
                lo, hi, want = 0.0, np.inf, np.log2(max(2, len(d)))
                sigma = 1.0
                for _ in range(64):
                    total = np.exp(-gap / sigma).sum()
                    if abs(total - want) < 1e-5:
                        break
                    lo, hi = (lo, sigma) if total > want else (sigma, hi)
                    sigma = (lo + hi) / 2 if np.isfinite(hi) else sigma * 2
                out += [(src, x["dst"], float(np.exp(-g / sigma))) for x, g in zip(near, gap, strict=True)]
            yield pd.DataFrame(out, columns=["src", "dst", "w"])

    kind = knn.schema["src"].dataType.simpleString()
    grouped = knn.groupBy("src").agg(F.collect_list(F.struct("dst", "dist")).alias("near"))  # k of each
    one = grouped.mapInPandas(smooth, f"src {kind}, dst {kind}, w double")
    ends = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.max("w").alias("m"))
    return ends.select("a", "b", F.when(F.col("n") == 2, F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).otherwise(F.col("s")).alias("weight"))


def layout(edges: DataFrame, start: DataFrame, rounds: int = 40, rate: float = 1.0, repulsion: float = 1.0, samples: float = 5.0, a: float = 1.577, b: float = 0.895) -> DataFrame:
    """(node, x, y) after ``rounds`` of moves from ``start`` (node, x, y), e.g. two principal components.

    ``edges``: a, b, weight. ``a`` and ``b`` are the curve 1 / (1 + a d^2b) of a
    least distance of 0.1. Steps shrink linearly. Equal input gives equal output.
    """
    import numpy as np
    import pandas as pd

    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = cut(both)
    degree = cut(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")))
    spread = start.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)).alias("m")).first()["m"] or 1.0
    now = cut(start.select("node", *[(F.col(c) * (10.0 / spread) + (unit("node", F.lit(c)) - 0.5) * 1e-3).alias(c) for c in ("x", "y")]))
    buckets = max(1, -(-now.count() // BUCKET))

    def repelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rows in f["rows"]:
                rows = sorted(rows, key=lambda r: r["node"])
                p = np.array([(r["x"], r["y"]) for r in rows])
                weight = np.array([r["degree"] for r in rows]) * samples / max(1, len(rows) - 1)
                gap = p[:, None] - p[None]
                d2 = (gap**2).sum(2)
                push = 2 * repulsion * b / ((0.001 + d2) * (1 + a * d2**b))
                move = (np.clip(push[:, :, None] * gap, -4, 4).sum(1)) * weight[:, None]
                yield pd.DataFrame({"node": [r["node"] for r in rows], "dx": move[:, 0], "dy": move[:, 1]})

    kind = start.schema["node"].dataType.simpleString()
    for k in range(rounds):
        step = rate * (1 - k / rounds)
        ends = both.join(now.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), "a").join(now.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        d2 = dx * dx + dy * dy
        pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0) * F.col("weight")
        held = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        drawn = ends.groupBy(F.col("a").alias("node")).agg(F.sum(held(pull * dx)).alias("dx"), F.sum(held(pull * dy)).alias("dy"))
        grouped = now.join(degree, "node").groupBy(F.floor(unit("node", F.lit(k)) * buckets).alias("bucket")).agg(F.collect_list(F.struct("node", "x", "y", "degree")).alias("rows"))
        pushed = grouped.select("rows").mapInPandas(repelled, f"node {kind}, dx double, dy double")
        moves = drawn.unionByName(pushed).groupBy("node").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        # a node's move is that of its edges together: at most a few units
        moved = now.join(moves, "node", "left").join(degree, "node", "left")
        shift = lambda c: F.coalesce(F.col(f"d{c}") / F.greatest(F.col("degree"), F.lit(1.0)), F.lit(0.0)) * step  # noqa: E731, B023
        now = moved.select("node", *[(F.col(c) + shift(c)).alias(c) for c in ("x", "y")])
        now = cut(now)
    return now
