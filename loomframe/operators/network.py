"""Networks of interactions between groups of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shipping import ships

ships(__name__)


def interaction_probability(average: DataFrame, pairs: DataFrame, group: str, kh: float = 0.5, value: str = "trimean") -> DataFrame:
    """(source, target, ligand, receptor, pathway, prob): LR / (kh + LR) of the groups' averages, where positive."""
    l = average.select(F.col(group).alias("source"), F.col("gene_id").alias("ligand"), F.col(value).alias("l"))
    r = average.select(F.col(group).alias("target"), F.col("gene_id").alias("receptor"), F.col(value).alias("r"))
    lr = F.col("l") * F.col("r")
    out = pairs.join(l, "ligand").join(r, "receptor").withColumn("prob", lr / (kh + lr))
    return out.filter("prob > 0").select("source", "target", "ligand", "receptor", "pathway", "prob")


def aggregate(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, source, target, n, strength)."""
    return edges.groupBy(*by, "source", "target").agg(F.count("*").alias("n"), F.sum("prob").alias("strength"))


def strengths(edges: DataFrame) -> DataFrame:
    """(node, out_degree, out_strength, in_degree, in_strength)."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("out_degree"), F.sum("prob").alias("out_strength"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("in_degree"), F.sum("prob").alias("in_strength"))
    return out.join(into, "node", "full").na.fill(0)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source, target, strength_a, strength_b, difference) on the union of both networks' edges; a missing side is 0."""
    one = aggregate(a).select("source", "target", F.col("strength").alias("strength_a"))
    two = aggregate(b).select("source", "target", F.col("strength").alias("strength_b"))
    both = one.join(two, ["source", "target"], "full").na.fill(0.0)
    return both.withColumn("difference", F.col("strength_b") - F.col("strength_a"))


def edge_jaccard(edges: DataFrame, by: str = "pathway") -> DataFrame:
    """(a, b, jaccard) of the edge sets of two pathways that share an edge, a < b."""
    e = edges.select(by, "source", "target").distinct()
    size = e.groupBy(by).agg(F.count("*").alias("n"))
    both = e.withColumnRenamed(by, "a").join(e.withColumnRenamed(by, "b"), ["source", "target"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    out = both.join(size.select(F.col(by).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(by).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("jaccard"))


def over_expressed_genes(long: DataFrame, cells: DataFrame, group: str, value: str = "x", p: float = 0.05) -> DataFrame:
    """(group, gene_id) of genes that are higher in a group than in all other cells, by the rank-sum test at ``p``."""
    from loomframe.functions.distribution import two_sided_p
    from loomframe.operators.matrix import rank_sum

    tested = rank_sum(long, cells, group, value)
    return tested.filter("z > 0").withColumn("p", two_sided_p("z")).filter(F.col("p") < p).select(group, "gene_id")


def over_expressed_pairs(pairs: DataFrame, markers: DataFrame) -> DataFrame:
    """The pairs of which the ligand or the receptor is over-expressed in some group (``markers``: gene_id)."""
    genes = markers.select("gene_id").distinct()
    either = pairs.select("ligand", "receptor", F.explode(F.array("ligand", "receptor")).alias("gene_id")).join(genes, "gene_id", "left_semi")
    return pairs.join(either.select("ligand", "receptor").distinct(), ["ligand", "receptor"], "left_semi")


#: Bins that a round's draws are counted in; what shares a bin with a group's end is sorted.
DRAW_BITS, BIN_BITS = 48, 12


def permuted_places(cells: DataFrame, groups: list[tuple], rounds: int, key: str = "cell_id") -> DataFrame:
    """(key, gs): the places in ``groups`` (name, size) of each cell's groups in ``rounds`` rounds, a byte (or four, if there are more than 256 groups) for each.

    In a round, cells are in the order of a digest of cell and round (that of
    ``unit``), and the first go to the first group, and so on. The order is never
    made: a group ends at an exact order statistic of the round's digests, all of
    which are found together, and a cell's digest tells its group. Cells aren't
    repeated for each round: a cell's digests are one value.
    (Two digests of 48 bits that are equal just there would go to one group.)
    """
    from collections.abc import Iterator
    from itertools import accumulate

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    from loomframe.functions.shared import cut, uncut

    spark, kind = cells.sparkSession, cells.schema[key].dataType.simpleString()
    size, shift = DRAW_BITS // 8, DRAW_BITS - BIN_BITS
    ends = [n - 1 for n in accumulate(n for _, n in groups)][:-1]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        names = [b"%d" % k for k in range(1, rounds + 1)]
        for batch in batches:
            starts = [b"" if x is None else x.encode() + b":" for x in batch.column(1).to_pylist()]
            drawn = [b"".join([md5(s + k).digest()[:size] for k in names]) for s in starts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], ["k", "us"])

    def numbers(column: pa.Array) -> np.ndarray:
        wide = np.zeros((len(column) * rounds, 8), np.uint8)
        wide[:, 8 - size :] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)
        return wide.view(">u8").astype(np.int64).reshape(len(column), rounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(rounds << BIN_BITS, np.int64)
        for batch in batches:
            n += np.bincount(((np.arange(rounds) << BIN_BITS) + (numbers(batch.column(0)) >> shift)).ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((some >> BIN_BITS).astype(np.int32)), pa.array((some & ((1 << BIN_BITS) - 1)).astype(np.int32)), pa.array(n[some])], ["round", "bin", "n"])

    # the order of rows is of no use to what follows
    draws = cut(cells.select(F.col(key).alias("k"), F.col(key).cast("string").alias("t")).mapInArrow(draw, f"k {kind}, us binary"))
    limits = np.zeros((rounds, len(ends)), np.int64)
    if ends:
        per = Window.partitionBy("round")
        bins = draws.select("us").mapInArrow(count, "round int, bin int, n long").groupBy("round", "bin").agg(F.sum("n").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(per.orderBy("bin")))
        met = bins.withColumn("rank", F.explode(F.array(*map(F.lit, ends)))).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        met = cut(met.select("round", "bin", F.col("rank").cast("long").alias("rank"), (F.col("rank") - F.col("upto") + F.col("n")).alias("left")))
        wanted = np.zeros(rounds << BIN_BITS, bool)
        wanted[[(r["round"] << BIN_BITS) + r["bin"] for r in met.select("round", "bin").collect()]] = True  # one for each end and round

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = numbers(batch.column(0))
                row, at = np.nonzero(wanted[(np.arange(rounds) << BIN_BITS) + (u >> shift)])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((u[row, at] >> shift).astype(np.int32)), pa.array(u[row, at])], ["round", "bin", "u"])

        near = draws.select("us").mapInArrow(inside, "round int, bin int, u long").groupBy("round", "bin", "u").agg(F.count("*").alias("m"))
        near = near.withColumn("upto", F.sum("m").over(Window.partitionBy("round", "bin").orderBy("u")))
        found = near.join(met, ["round", "bin"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("m")))
        at = {n: k for k, n in enumerate(ends)}
        for r in found.select("round", "rank", "u").collect():  # one for each end and round
            limits[r["round"], at[r["rank"]]] = r["u"]
        uncut(met)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = numbers(batch.column(1))
            gs = np.zeros(u.shape, np.uint8 if len(groups) <= 256 else np.int32)
            for k in range(len(ends)):
                gs += u > limits[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.tobytes() for g in gs], pa.binary())], [key, "gs"])

    out = cut(draws.mapInArrow(place, f"`{key}` {kind}, gs binary"))
    uncut(draws)
    return out


def _groups(cells: DataFrame, group: str) -> list[tuple]:
    """(name, number of cells) of the groups, in order."""
    return sorted((r[group], r["n"]) for r in cells.groupBy(group).agg(F.count("*").alias("n")).collect())  # a row for each group


def permuted_groups(cells: DataFrame, group: str, rounds: int, key: str = "cell_id") -> DataFrame:
    """(round, key, group): in each of ``rounds`` rounds, the cells' groups exchanged among all cells, so that every group keeps its size; by ``permuted_places``."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    groups, kinds = _groups(cells, group), {c: cells.schema[c].dataType for c in (key, group)}
    if not groups:
        return cells.select(F.lit(1).alias("round"), key, group).limit(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                gs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8 if len(groups) <= 256 else np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(1, rounds + 1, dtype=np.int32), len(part))), part.column(0).take(pa.array(np.repeat(np.arange(len(part)), rounds))), pa.array(gs.astype(np.int32) + 1)], ["round", key, "g"])

    flat = permuted_places(cells, groups, rounds, key).mapInArrow(each, f"round int, `{key}` {kinds[key].simpleString()}, g int")
    return flat.select("round", key, F.element_at(F.array(*[F.lit(g).cast(kinds[group]) for g, _ in groups]), F.col("g")).alias(group))


#: Different pairs of gene and value that a task counts before it tells; tasks that count.
MOST_COUNTED, COUNTING = 20_000, 16


def permuted_trimeans(long: DataFrame, cells: DataFrame, group: str, rounds: int, value: str = "x") -> DataFrame:
    """(round, group, gene_id, trimean): as ``matrix.trimean`` in the groups of each round of ``permuted_groups``.

    Entries aren't repeated for each round. A cell's groups in all rounds are one
    value, and tasks count the cells of each gene and value by round and group;
    the triMeans are of these counts. There are ``COUNTING`` tasks at most, and a
    gene's value is told once by each, so what is shuffled grows with the entries
    or with the different values, where these are fewer.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    from loomframe.functions.shared import cut
    from loomframe.operators.orderstats import between, places

    sizes = _groups(cells, group)
    kind, width = cells.schema[group].dataType, max(1, len(sizes))
    names = F.array(*[F.lit(g).cast(kind) for g, _ in sizes] or [F.lit(None).cast(kind)])
    drawn = permuted_places(cells, sizes, rounds)
    # sorted by cell on both sides: a row of ``drawn`` is some hundred bytes, more than its file tells
    entries = long.filter(F.col(value) > 0).select("cell_id", "gene_id", F.col(value).cast("double").alias("x")).join(drawn.hint("merge"), "cell_id").select("gene_id", "x", "gs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, places_ = width * rounds, {}
        shift, held = np.arange(rounds) * width, np.zeros((256, every), np.int32)

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(places_)
            for low in range(0, len(keys), 500):
                part = held[low : min(low + 500, len(keys))]
                row, at = np.nonzero(part)
                ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int32), part[row, at])]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys[low : low + 500]], gene), pa.array([k[1] for k in keys[low : low + 500]], pa.float64()), *lists], ["gene_id", "x", "at", "n"])

        gene = None
        for whole in batches:
            for start in range(0, len(whole), 10_000):
                batch = whole.slice(start, 10_000)
                gene, coded = batch.column(0).type, batch.column(0).dictionary_encode()
                names_ = coded.dictionary.to_pylist() + [None]
                at = coded.indices.fill_null(len(names_) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                values, which = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
                pair, row = np.unique(at * len(values) + which, return_inverse=True)
                values, keys = values.tolist(), np.divmod(pair, len(values))
                own = np.array([places_.setdefault((names_[g], values[v]), len(places_)) for g, v in zip(*map(np.ndarray.tolist, keys), strict=True)])
                while len(places_) > len(held):
                    held = np.concatenate([held, np.zeros_like(held)])
                gs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8 if width <= 256 else np.int32).reshape(len(batch), rounds)
                np.add.at(held.reshape(-1), (own[row][:, None] * every + shift + gs).ravel(), np.int32(1))
                if len(places_) > MOST_COUNTED:
                    yield from told()
                    places_.clear()
                    held[:] = 0
        yield from told()

    part = entries.coalesce(COUNTING).mapInArrow(count, f"gene_id {long.schema['gene_id'].dataType.simpleString()}, x double, at array<int>, n array<int>")
    # all that is told of a gene's value meets before it is taken apart
    flat = part.repartition("gene_id", "x").select("gene_id", "x", F.inline(F.arrays_zip("at", F.col("n").cast("array<long>").alias("n")))).groupBy("gene_id", "x", "at").agg(F.sum("n").alias("n"))
    counted = cut(flat.select("gene_id", "at", "x", "n"))
    keys = ["gene_id", "at"]
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("x")))
    whole = upto.withColumn("nnz", F.sum("n").over(Window.partitionBy(*keys)))
    size = F.element_at(F.array(*[F.lit(n).cast("long") for _, n in sizes] or [F.lit(0).cast("long")]), (F.col("at") % width + 1).cast("int"))
    whole = whole.withColumn("size", size).withColumn("zeros", F.col("size") - F.col("nnz"))

    def at(rank):  # the value at a rank from 0 of all cells, zeros first; of the one row that holds it
        place = rank - F.col("zeros")
        return F.coalesce(F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")), F.col("x"))), F.lit(0.0))

    ranks = {q: places(F.col("size"), q) for q in (0.25, 0.5, 0.75)}
    per = whole.groupBy(*keys).agg(F.first("size").alias("size"), *[at(r).alias(f"v{k}{side}") for k, q in enumerate(ranks) for side, r in enumerate(ranks[q][:2])])
    q1, q2, q3 = (between(F.col(f"v{k}0"), F.col(f"v{k}1"), places(F.col("size"), q)[2]) for k, q in enumerate(ranks))
    return per.select(((F.col("at") / width).cast("int") + 1).alias("round"), F.element_at(names, (F.col("at") % width + 1).cast("int")).alias(group), "gene_id", ((q1 + 2 * q2 + q3) / 4).alias("trimean"))


def significance(long: DataFrame, cells: DataFrame, pairs: DataFrame, group: str, rounds: int = 100, kh: float = 0.5, value: str = "x") -> DataFrame:
    """The interactions of ``interaction_probability`` on triMeans, with ``p``: the share of permutations of the cells' groups that reach as much.

    All rounds are made in one pass over the entries of the pairs' genes.
    """
    from loomframe.functions.shared import cut
    from loomframe.operators.matrix import trimean

    genes = pairs.select(F.explode(F.array("ligand", "receptor")).alias("gene_id")).distinct()
    long = cut(long.join(genes, "gene_id").select("cell_id", "gene_id", value))
    cells = cut(cells.select("cell_id", group))
    seen = interaction_probability(trimean(long, cells.select("cell_id", group), group, value), pairs, group, kh)
    means = permuted_trimeans(long, cells.select("cell_id", group), group, rounds, value)
    l = means.select("round", F.col(group).alias("source"), F.col("gene_id").alias("ligand"), F.col("trimean").alias("l"))
    r = means.select("round", F.col(group).alias("target"), F.col("gene_id").alias("receptor"), F.col("trimean").alias("r"))
    lr = F.col("l") * F.col("r")
    edge = ["source", "target", "ligand", "receptor", "pathway"]
    null = pairs.join(l, "ligand").join(r, ["round", "receptor"]).withColumn("_p", lr / (kh + lr))
    reached = seen.join(null.select("round", *edge, "_p"), edge).filter(F.round("_p", 12) >= F.round("prob", 12)).groupBy(*edge).agg((F.count("*") / rounds).alias("p"))
    return seen.join(reached, edge, "left").na.fill(0.0, ["p"])


def centralities(edges: DataFrame, by: str = "pathway") -> DataFrame:
    """(by, node, hub, authority, eigen, pagerank, betweenness) of each network of groups (source, target, prob).

    Hubs and authorities add up to 1, as do page ranks (damping 0.85); eigenvector
    centrality is of the symmetrised weights, its largest 1; betweenness counts
    shortest paths by 1 / prob. A network has as many nodes as there are groups
    of cells and goes to one task.
    """
    import pandas as pd

    def measure(f: pd.DataFrame) -> pd.DataFrame:
        import heapq

        import numpy as np

        names = sorted(set(f["source"]) | set(f["target"]))
        at, n = {x: i for i, x in enumerate(names)}, len(names)
        w = np.zeros((n, n))
        for s, t, p in zip(f["source"], f["target"], f["prob"], strict=True):
            w[at[s], at[t]] += p

        def settled(m: np.ndarray) -> np.ndarray:
            v = np.full(n, 1 / n)
            for _ in range(500):
                new = m @ v
                new = new / (new.sum() or 1.0)
                if np.abs(new - v).max() < 1e-12:
                    break
                v = new
            return new

        authority = settled(w.T @ w)
        hub = w @ authority
        both = w + w.T
        eigen = settled(both + np.eye(n) * both.max(initial=0))  # shifted, so that bipartite networks settle
        out = w.sum(1, keepdims=True)
        walk = np.where(out > 0, w / np.where(out > 0, out, 1), 1 / n)
        rank = settled(0.85 * walk.T + 0.15 / n)
        between = np.zeros(n)
        for s in range(n):
            dist, paths, order, before = {s: 0.0}, np.zeros(n), [], [[] for _ in range(n)]
            paths[s], heap, done = 1.0, [(0.0, s)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for t in np.flatnonzero((w[v] > 0) & (np.arange(n) != v)):
                    far = d + 1 / w[v, t]
                    if t not in dist or far < dist[t] - 1e-12:
                        dist[t], paths[t], before[t] = far, paths[v], [v]
                        heapq.heappush(heap, (far, int(t)))
                    elif abs(far - dist[t]) <= 1e-12 and t not in done:
                        paths[t] += paths[v]
                        before[t].append(v)
            share = np.zeros(n)
            for v in reversed(order):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
                if v != s:
                    between[v] += share[v]
        return pd.DataFrame({by: f[by].iloc[0], "node": names, "hub": hub / (hub.sum() or 1.0), "authority": authority, "eigen": eigen / (eigen.max() or 1.0), "pagerank": rank, "betweenness": between})

    kind, node = edges.schema[by].dataType.simpleString(), edges.schema["source"].dataType.simpleString()
    sums = edges.groupBy(by, "source", "target").agg(F.sum("prob").alias("prob"))
    return sums.groupBy(by).applyInPandas(measure, f"{by} {kind}, node {node}, hub double, authority double, eigen double, pagerank double, betweenness double")


def _factors(m, k: int, seed: int, rounds: int = 500):
    """Non-negative factors of a matrix by multiplicative updates; rows of the second add up to 1."""
    import numpy as np

    r = np.random.default_rng(seed)
    w, h = r.random((m.shape[0], k)) + 0.1, r.random((k, m.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ m) / (w.T @ w @ h + 1e-12)
        w *= (m @ h.T) / (w @ h @ h.T + 1e-12)
    size = h.sum(1)
    order = np.argsort(-(w.sum(0) * size), kind="stable")
    return (w * size)[:, order], (h / np.where(size > 0, size, 1)[:, None])[order]


def patterns(edges: DataFrame, k: int, side: str = "source", by: str = "pathway", seed: int = 1) -> DataFrame:
    """(axis, name, pattern, weight): the groups' and pathways' weights in ``k`` non-negative patterns of the strengths.

    The matrix has a row for each group and a column for each pathway, scaled by
    its largest, and goes to one task.
    """
    import pandas as pd

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot_table(index="side", columns="by", values="prob", aggfunc="sum", fill_value=0.0).sort_index().sort_index(axis=1)
        w, h = _factors((m / m.max()).fillna(0.0).to_numpy(), k, seed)
        rows = [(side, str(n), j + 1, float(w[i, j])) for i, n in enumerate(m.index) for j in range(k)]
        return pd.DataFrame(rows + [(by, str(n), j + 1, float(h[j, i])) for i, n in enumerate(m.columns) for j in range(k)], columns=["axis", "name", "pattern", "weight"])

    sums = edges.groupBy(F.col(side).cast("string").alias("side"), F.col(by).cast("string").alias("by")).agg(F.sum("prob").alias("prob"))
    return sums.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda f: fit(f[["side", "by", "prob"]]), "axis string, name string, pattern int, weight double")


def pattern_numbers(edges: DataFrame, most: int = 8, side: str = "source", by: str = "pathway", runs: int = 10) -> DataFrame:
    """(k, cophenetic): how stable the groups' strongest patterns are over ``runs`` starts; the number to choose is the one before it falls."""
    import pandas as pd

    def rate(f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        m = f.pivot_table(index="side", columns="by", values="prob", aggfunc="sum", fill_value=0.0).sort_index().sort_index(axis=1)
        m, out = (m / m.max()).fillna(0.0).to_numpy(), []
        for k in range(2, min(most, *m.shape) + 1):
            agree = np.zeros((len(m), len(m)))
            for s in range(runs):
                top = _factors(m, k, s, 200)[0].argmax(1)
                agree += top[:, None] == top
            d = 1 - agree / runs
            joined, groups, gap = np.zeros_like(d), {i: [i] for i in range(len(d))}, d.copy()
            np.fill_diagonal(gap, np.inf)
            while len(groups) > 1:
                keys = list(groups)
                sub = gap[np.ix_(keys, keys)]
                x, y = np.unravel_index(np.argmin(sub), sub.shape)
                i, j = sorted((keys[x], keys[y]))
                for u in groups[i]:
                    joined[u, groups[j]] = joined[groups[j], u] = gap[i, j]
                a, b = len(groups[i]), len(groups[j])
                gap[i] = gap[:, i] = (gap[i] * a + gap[j] * b) / (a + b)
                gap[i, i] = np.inf
                groups[i] = groups[i] + groups.pop(j)
            upper = np.triu_indices(len(d), 1)
            x, y = d[upper], joined[upper]
            out.append((k, 1.0 if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1])))
        return pd.DataFrame(out, columns=["k", "cophenetic"])

    sums = edges.groupBy(F.col(side).cast("string").alias("side"), F.col(by).cast("string").alias("by")).agg(F.sum("prob").alias("prob"))
    return sums.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda f: rate(f[["side", "by", "prob"]]), "k int, cophenetic double")
