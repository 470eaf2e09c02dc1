"""Vectors of cells: neighbours, distances, silhouettes and agreement of labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.shared import cut, uncut
from loomframe.functions.shipping import ships

ships(__name__)

#: Queries of a block whose distances are held at once; neighbours up to which a task holds a block's best.
SLICE, MOST_HELD = 512, 256
#: Vectors of a block of which all pairs are given, and rows of a tile of their distances.
MOST_PAIRED, TILE = 2048, 32
#: Tasks that a block's best neighbours come from, at most; each has its share of the vectors in memory.
SHARES = 8
#: Squares of distances that a task of ``neighbour_counts`` holds at once, and its queries at most.
MOST_SQUARES, ASKED = 8_000_000, 1024


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def first_dims(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, F.slice(vec, 1, n))


def blocks(df: DataFrame, key: str, vec: str, block: int, *more: str) -> DataFrame:
    """(b, xs) with xs an array of (k, v, further columns): the rows in blocks of about ``block``, written once."""
    n = max(1, -(-df.count() // block))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("b"), F.struct(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), *more).alias("x"))
    return cut(rows.repartition(n, "b").groupBy("b").agg(F.collect_list("x").alias("xs")))


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(b, qs, vs): each block of ``left`` with each of ``right``, as ``blocks`` has written them.

    Tasks read the blocks where they are written, so pairs of blocks aren't shuffled.
    A block of ``left`` meets those of ``right`` in ``SHARES`` tasks at most, however many
    there are, so what tasks tell of a vector doesn't grow with the vectors.
    """
    right = right.coalesce(SHARES)
    return left.select("b", F.col("xs").alias("qs")).crossJoin(right.select(F.col("xs").alias("vs")).hint("shuffle_replicate_nl"))


def columns(xs: pa.ListScalar) -> tuple:
    """Keys and vectors of a block, as arrays."""
    import numpy as np

    return np.array(xs.values.field("k").to_pylist()), xs.values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(xs.values), -1)


def nearest(df: DataFrame, k: int, queries: DataFrame | None = None, vec: str = "vec", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """(src, dst, dist, rank): the exact ``k`` nearest other vectors of each query, ties by key.

    Queries are cut in blocks, and each block runs over each block of the
    vectors; a task keeps a query's k best of the blocks it sees, which are then
    merged. Its work is matrix products, its memory ``SLICE`` x ``block``. Whatever
    might be as near as the k-th, by that product, is measured again by
    differences; so of equally distant ones, however many, the least keys win.
    """
    import numpy as np

    kind = df.schema[key].dataType.simpleString()
    right = blocks(df, key, vec, block)
    left = right if queries is None else blocks(queries, key, vec, block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def told() -> pa.RecordBatch:
            names = ["src", "dst", "dist"]
            return pa.RecordBatch.from_arrays([pa.array(held["src"][held["row"]], held["type"]), pa.array(held["dst"], held["type"]), pa.array(held["dist"])], names)

        for batch in batches:
            for b, qs, vs in zip(*batch.columns, strict=True):
                (src, a), (dst, v) = columns(qs), columns(vs)
                if held is not None and (b.as_py() != at or k > MOST_HELD):
                    yield told()
                    held = None
                at = b.as_py()
                found = [held] if held is not None else []
                other = (v * v).sum(1)
                for low in range(0, len(src), SLICE):
                    q = a[low : low + SLICE]
                    own = (q * q).sum(1)
                    rough = q @ v.T
                    rough *= -2
                    rough += own[:, None]
                    rough += other
                    rough[src[low : low + SLICE, None] == dst[None, :]] = np.inf
                    m = min(k, len(dst))
                    # of squares: rounding of the product, and of distances to nine places
                    reach = np.maximum(np.partition(rough, m - 1, axis=1)[:, m - 1], 0)
                    reach = reach + 1e-12 * (own + other.max()) + 4e-9 * np.sqrt(reach) + 1e-17
                    rows, cols = np.nonzero((rough <= reach[:, None]) & np.isfinite(rough))
                    dist = np.concatenate([np.zeros(0), *[np.sqrt(((q[rows[i : i + 100_000]] - v[cols[i : i + 100_000]]) ** 2).sum(1)) for i in range(0, len(rows), 100_000)]])
                    found.append({"row": rows + low, "dst": dst[cols], "dist": dist})
                row, to, dist = (np.concatenate([f[c] for f in found]) for c in ("row", "dst", "dist"))
                order = np.lexsort((to, np.round(dist, 9), row))
                place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                keep = order[place < k]
                held = {"type": qs.values.field("k").type, "src": src, "row": row[keep], "dst": to[keep], "dist": dist[keep]}
        if held is not None:
            yield told()

    found = block_pairs(left, right).mapInArrow(best, f"src {kind}, dst {kind}, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 9), "dst"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _squares(src, a, dst, v):  # noqa: ANN001, ANN202
    """The squared distances of each of ``a`` and each of ``v`` by one product; infinite for equal keys and where a vector isn't finite."""
    import numpy as np

    own, other = (a * a).sum(1), (v * v).sum(1)
    rough = np.column_stack([a, np.ones(len(a)), own]) @ np.column_stack([-2 * v, other, np.ones(len(v))]).T
    rough[~np.isfinite(own)] = np.inf
    rough[:, ~np.isfinite(other)] = np.inf
    rows, cols = np.flatnonzero(np.isin(src, dst)), np.flatnonzero(np.isin(dst, src))
    i, j = np.nonzero(src[rows][:, None] == dst[cols])
    rough[rows[i], cols[j]] = np.inf
    return rough, own, other[np.isfinite(other)].max(initial=0.0)


def neighbour_counts(df: DataFrame, ks: list[int], queries: DataFrame, vec: str = "vec", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """(src, k, n, negatives): how many of the exact ``k`` nearest other vectors of each query have a negative key, and how many those k are, for each of ``ks``.

    As of ``nearest``, by distances to nine places and then keys, but neighbours
    aren't told, so what is written doesn't grow with ``ks``, which may be shares
    of all vectors. A task has a block of queries, and all vectors pass by it
    twice, block by block: it finds the squares that the k-th ones have, by
    products; then counts what is surely nearer, and measures again by differences
    what may be as near. The larger the ``ks``, the fewer the queries of a task,
    so its memory stays some ``MOST_SQUARES``; equal distances are counted, not held.
    """
    import numpy as np

    ks = sorted(set(ks))
    most, kind = ks[-1], df.schema[key].dataType.simpleString()
    right = blocks(df, key, vec, block)
    left = blocks(queries, key, vec, max(1, min(ASKED, MOST_SQUARES // (2 * most + block))))

    def passed(asked: DataFrame) -> DataFrame:
        """(b, qs, vs): all blocks of vectors beside each one of queries, which has a task of its own."""
        n = (asked.agg(F.max("b")).first()[0] or 0) + 1
        own = asked.select("b", F.col("xs").alias("qs")).repartitionById(n, F.col("b").cast("int"))
        return right.select(F.col("xs").alias("vs")).coalesce(1).crossJoin(own.hint("shuffle_replicate_nl")).select("b", "qs", "vs")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}

        def least(parts: list, places: list[int]) -> np.ndarray:
            whole = np.concatenate(parts, axis=1)
            whole.partition([k - 1 for k in places if k <= whole.shape[1]], axis=1)
            return whole

        for batch in batches:
            for b, qs, vs in zip(*batch.columns, strict=True):
                if b.as_py() not in held:
                    held[b.as_py()] = (qs, *columns(qs), [])
                qs, src, a, parts = held[b.as_py()]
                parts.append(_squares(src, a, *columns(vs))[0])
                if sum(p.shape[1] for p in parts) >= 2 * most:
                    parts[:] = [least(parts, [most])[:, :most].copy()]
        for b, (qs, _, _, parts) in held.items():
            whole = least(parts, ks)
            far = np.column_stack([whole[:, k - 1] if k <= whole.shape[1] else np.full(len(whole), np.inf) for k in ks])
            ends = pa.array(np.arange(len(far) + 1, dtype=np.int32) * len(ks))
            fields = [qs.values.field("k"), qs.values.field("v"), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))]
            xs = pa.ListArray.from_arrays(pa.array([0, len(far)], pa.int32()), pa.StructArray.from_arrays(fields, ["k", "v", "far"]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), xs], ["b", "xs"])

    def merged(parts: list) -> tuple:
        """(place, dist, n, negatives) by place and distance, equal ones added up."""
        at, dist, n, low = (np.concatenate([p[c] for p in parts]) for c in range(4))
        order = np.lexsort((dist, at))
        at, dist, n, low = at[order], dist[order], n[order], low[order]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (dist[1:] != dist[:-1])))[: len(at)]
        return (at[first], dist[first], np.add.reduceat(n, first), np.add.reduceat(low, first)) if len(at) else (at, dist, n, low)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for b, qs, vs in zip(*batch.columns, strict=True):
                if b.as_py() not in held:
                    src, a = columns(qs)
                    far = qs.values.field("far").flatten().to_numpy().reshape(len(src), -1)
                    held[b.as_py()] = (qs, src, a, far, np.zeros((2, far.size), np.int64), [])
                qs, src, a, far, sure, near = held[b.as_py()]
                dst, v = columns(vs)
                rough, own, size = _squares(src, a, dst, v)
                # of squares: rounding of the products, and of distances to nine places
                off = 1e-12 * (own[:, None] + size) + 4e-9 * np.sqrt(np.maximum(far, 0)) + 1e-17
                lower, upper = far - np.where(np.isfinite(far), off, 0), far + off
                at = np.flatnonzero((rough <= upper.max(1)[:, None]) & np.isfinite(rough))
                square, negative = rough.ravel()[at], dst[at % len(dst)] < 0
                row = at // len(dst)
                for i in range(len(ks)):
                    less = square < lower[row, i]
                    sure[0, i :: len(ks)] += np.bincount(row[less], minlength=len(src))
                    sure[1, i :: len(ks)] += np.bincount(row[less & negative], minlength=len(src))
                    some = np.flatnonzero(~less & (square <= upper[row, i]))
                    for low in range(0, len(some), 100_000):
                        part = some[low : low + 100_000]
                        dist = np.sqrt(((a[row[part]] - v[at[part] % len(dst)]) ** 2).sum(1))
                        near.append(merged([(row[part] * len(ks) + i, np.round(dist, 9), np.ones(len(part), np.int64), negative[part].astype(np.int64))]))
                if sum(len(p[0]) for p in near) > 1_000_000:
                    near[:] = [merged(near)]
        for qs, src, _, far, sure, near in held.values():
            k = np.tile(ks, len(src))
            if near:
                place, _, n, low = merged(near)
                before = np.cumsum(n) - n
                before -= before[np.searchsorted(place, place)]
                taken = np.clip(k[place] - sure[0, place] - before, 0, n)
                np.add.at(sure[0], place, taken)
                np.add.at(sure[1], place, np.minimum(taken, low))  # of equally far ones, negative keys are the least
            some = sure[0] > 0
            kinds = qs.values.field("k").type
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(src, len(ks))[some], kinds), pa.array(k[some], pa.int64()), pa.array(sure[0][some]), pa.array(sure[1][some])], ["src", "k", "n", "negatives"])

    far = cut(passed(left).mapInArrow(reach, f"b long, xs array<struct<k:{kind},v:array<double>,far:array<double>>>"))
    out = cut(passed(far).mapInArrow(counted, f"src {kind}, k long, n long, negatives long"))
    uncut(left, right, far)
    return out


def nearest_probed(df: DataFrame, k: int, queries: DataFrame | None = None, cells: int | None = None, probes: int = 8, sample: int = 20_000, vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(src, dst, dist, rank): nearly the ``k`` nearest other vectors of each query, by an inverted index of cells.

    The cells' centres (the root of the number of vectors, unless given) are
    fitted on the ``sample`` vectors with the least hashes of their keys; every
    vector is in the index, under its nearest centre, and a query looks into its
    ``probes`` nearest cells. Tests measure the recall against ``nearest``.
    """
    import numpy as np

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, n = df.sparkSession, df.count()
    cells = cells or max(1, round(n**0.5))
    some = df.orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    centres = np.array(KMeans(k=max(2, min(cells, sample)), seed=1, maxIter=10).fit(some).clusterCenters()) if n else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)  # ``cells`` x dimensions

    def assigned(frame: DataFrame, each: int, names: tuple[str, str]) -> DataFrame:
        def work(frames):
            import numpy as np
            import pandas as pd

            c = shared.value
            for f in frames:
                if len(f):
                    x = np.stack(f[names[1]].to_numpy()).astype(float)
                    d = (c * c).sum(1) - 2 * x @ c.T
                    m = min(each, len(c))
                    near = np.argpartition(d, m - 1, axis=1)[:, :m]
                    yield pd.DataFrame({names[0]: np.repeat(f[names[0]].to_numpy(), m), names[1]: [list(v) for v in x for _ in range(m)], "cell": near.ravel()})

        return frame.mapInPandas(work, f"{names[0]} {df.schema[key].dataType.simpleString()}, {names[1]} array<double>, cell int")

    asked = (df if queries is None else queries).select(F.col(key).alias("src"), F.col(vec).cast("array<double>").alias("q"))
    index = assigned(df.select(F.col(key).alias("dst"), F.col(vec).cast("array<double>").alias("v")), 1, ("dst", "v"))
    found = assigned(asked, probes, ("src", "q")).join(index, "cell").filter("src <> dst").select("src", "dst", distance("q", "v").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 9), "dst"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def shared_neighbours(knn: DataFrame) -> DataFrame:
    """(a, b, weight): Jaccard similarity of the neighbour lists (a vector belongs to its own) of vectors that share one."""
    knn = cut(knn.select("src", "dst"))  # it is read several times, and may be quadratic work
    lists = knn.select("src", "dst").unionByName(knn.select("src", F.col("src").alias("dst")).distinct())
    size = lists.groupBy("src").agg(F.count("*").alias("n"))
    l, r = lists.select(F.col("src").alias("a"), "dst"), lists.select(F.col("src").alias("b"), "dst")
    both = l.join(r, "dst").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    out = both.join(size.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("weight"))


def all_distances(df: DataFrame, vec: str = "vec", key: str = "vec_id", block: int | None = None) -> DataFrame:
    """(a, b, dist) for a < b, the sums of squares in the order of components; null where a vector or component is, or lengths differ.

    The result is quadratic. Each pair of blocks is measured once, in tiles, so memory is bounded.
    """
    import numpy as np

    kind = df.schema[key].dataType.simpleString()
    whole = blocks(df.filter(F.col(key).isNotNull()), key, vec, block or MOST_PAIRED)
    right = whole.select(F.col("b").alias("c"), F.col("xs").alias("vs")).hint("shuffle_replicate_nl")
    pairs = whole.select("b", F.col("xs").alias("qs")).join(right, F.col("b") <= F.col("c"))

    def padded(xs: pa.ListScalar) -> tuple:
        """Keys, vectors with zeros to the greatest length, and lengths, -1 where something is null."""
        v = xs.values.field("v")
        flat, size = v.flatten(), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        out = np.zeros((len(size), size.max(initial=0)))
        out[row, np.arange(len(row)) - start[row]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        size[v.is_null().to_numpy(zero_copy_only=False)] = -1
        size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        return np.array(xs.values.field("k").to_pylist()), out, size

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, qs, c, vs in zip(*batch.columns, strict=True):
                (src, x, m), (dst, y, n) = padded(qs), padded(vs)
                across, kinds = np.ascontiguousarray(y.T), qs.values.field("k").type
                for low in range(0, len(src), TILE):
                    ids, q = src[low : low + TILE, None], x[low : low + TILE]
                    total = np.zeros((len(q), len(dst)))
                    for i in range(min(q.shape[1], len(across))):
                        step = q[:, i, None] - across[i]
                        step *= step
                        total += step
                    less = ids < dst
                    pick = less if b.as_py() == c.as_py() else less | (dst < ids)
                    null = ((m[low : low + TILE, None] != n) | (n < 0))[pick]
                    first, last = np.where(less, ids, dst)[pick], np.where(less, dst, ids)[pick]
                    yield pa.RecordBatch.from_arrays([pa.array(first, kinds), pa.array(last, kinds), pa.array(np.sqrt(total[pick]), mask=null)], ["a", "b", "dist"])

    return pairs.mapInArrow(measured, f"a {kind}, b {kind}, dist double")


def label_means(df: DataFrame, label: str = "label", vec: str = "vec", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """(key, lb, m): the mean distance of each vector to the other ones of each label, in blocks as in ``nearest``.

    Distances are of matrix products; those too short for that are taken from the differences.
    """
    import numpy as np

    whole = df.filter(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    left = blocks(whole, key, vec, block)
    right = blocks(whole.filter(F.col(label).isNotNull()).withColumn("lb", F.col(label)), key, vec, block, "lb")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, vs in zip(batch.column(1), batch.column(2), strict=True):
                (src, a), (dst, b), lb = columns(qs), columns(vs), np.array(vs.values.field("lb").to_pylist())
                order = np.argsort(lb, kind="stable")
                dst, b, lb = dst[order], b[order], lb[order]
                first = np.flatnonzero(np.append(True, lb[1:] != lb[:-1]))
                size = (b * b).sum(1)
                for low in range(0, len(src), SLICE):
                    ids, q = src[low : low + SLICE], a[low : low + SLICE]
                    scale = (q * q).sum(1)[:, None] + size
                    d = scale - 2 * q @ b.T
                    short = d < 1e-6 * scale
                    for i in np.flatnonzero(short.any(1)):
                        d[i, short[i]] = ((q[i] - b[short[i]]) ** 2).sum(1)
                    other = ids[:, None] != dst[None, :]
                    d = np.where(other, np.sqrt(d), 0.0)
                    s, n = np.add.reduceat(d, first, axis=1).ravel(), np.add.reduceat(other.astype(np.int64), first, axis=1).ravel()
                    some = n > 0
                    out = (np.repeat(ids, len(first)), np.tile(lb[first], len(ids)), s, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x[some], t) for x, t in zip(out, (qs.values.field("k").type, vs.values.field("lb").type, pa.float64(), pa.int64()), strict=True)], ["src", "lb", "s", "n"])

    kinds = f"src {df.schema[key].dataType.simpleString()}, lb {df.schema[label].dataType.simpleString()}, s double, n long"
    found = block_pairs(left, right).mapInArrow(sums, kinds)
    return found.groupBy(F.col("src").alias(key), "lb").agg((F.sum("s") / F.sum("n")).alias("m"))


def silhouette(df: DataFrame, label: str = "label", vec: str = "vec", key: str = "vec_id") -> DataFrame:
    """(key, label, a, b, width), Euclidean; 0 in a cluster of one, null where there is one cluster."""
    own = label_means(df, label, vec, key).join(df.select(key, label), key)
    per = own.groupBy(key).agg(F.max(F.when(F.col("lb") == F.col(label), F.col("m"))).alias("a"), F.min(F.when(F.col("lb") != F.col(label), F.col("m"))).alias("b"))
    width = F.when(F.col("b").isNull(), F.lit(None).cast("double")).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return df.select(key, label).join(per, key).withColumn("width", width)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari, nmi) of two labelings; NMI by the arithmetic mean of the entropies."""
    n_ab = df.select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    part = lambda t, k: t.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"c_{k}"), F.sum(F.col("n") * F.log("n")).alias(f"h_{k}"))
    joint = n_ab.agg(F.sum(two(F.col("n"))).alias("c"), F.sum(F.col("n") * F.log("n")).alias("h"), F.sum("n").alias("t"))
    t = joint.crossJoin(part(n_ab, "a")).crossJoin(part(n_ab, "b"))  # one row each
    total = F.col("t")
    expected = F.col("c_a") * F.col("c_b") / two(total)
    top = (F.col("c_a") + F.col("c_b")) / 2
    ha, hb = F.log(total) - F.col("h_a") / total, F.log(total) - F.col("h_b") / total
    mutual = ha + hb - (F.log(total) - F.col("h") / total)
    return t.select(F.when(top == expected, 1.0).otherwise((F.col("c") - expected) / (top - expected)).alias("ari"), F.when(ha + hb == 0, 1.0).otherwise(2 * mutual / (ha + hb)).alias("nmi"))


def simpson(knn: DataFrame, labels: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """(src, lisi): the inverse Simpson index of the labels among a vector's neighbours."""
    named = knn.join(labels.select(F.col(key).alias("dst"), label), "dst")
    p = named.groupBy("src", label).agg(F.count("*").alias("n"))
    return p.groupBy("src").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("lisi"))


def correlations(a: DataFrame, b: DataFrame, key: str = "vec_id") -> DataFrame:
    """(dim, pearson, spearman) of two sets of vectors, dimension by dimension."""
    from loomframe.operators.tables import average_rank

    x = a.select(key, F.posexplode("vec").alias("dim", "x"))
    y = b.select(key, F.posexplode("vec").alias("dim", "y"))
    both = x.join(y, [key, "dim"])
    ranked = both.withColumns({"rx": average_rank(["x"], ["dim"]), "ry": average_rank(["y"], ["dim"])})
    return ranked.groupBy("dim").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def fuzzy_overlap(soft: DataFrame) -> DataFrame:
    """(a, b, overlap, ochiai): the sum over cells of the lesser probability, and that over the root of both totals."""
    l, r = soft.select("cell_id", F.col("label").alias("a"), F.col("prob").alias("p")), soft.select("cell_id", F.col("label").alias("b"), F.col("prob").alias("q"))
    both = l.join(r, "cell_id").filter("a <= b").groupBy("a", "b").agg(F.sum(F.least("p", "q")).alias("overlap"))
    both = both.unionByName(both.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    total = soft.groupBy("label").agg(F.sum("prob").alias("t"))
    t = total.select(F.col("label").alias("a"), F.col("t").alias("ta")).crossJoin(F.broadcast(total.select(F.col("label").alias("b"), F.col("t").alias("tb"))))  # labels, not cells
    out = t.join(both, ["a", "b"], "left").na.fill(0.0, ["overlap"])
    return out.select("a", "b", "overlap", (F.col("overlap") / F.nullif(F.sqrt(F.col("ta") * F.col("tb")), F.lit(0.0))).alias("ochiai"))
