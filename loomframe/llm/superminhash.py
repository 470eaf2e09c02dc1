"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and grouping.

Every shingle of a set draws its own random permutation of the signature's
components, by a Fisher-Yates shuffle that is seeded with the shingle's hash. A
component's value is the least of rank plus a fraction over the shingles, where
rank is the component's place in the shingle's permutation. As one shingle's ranks
are all different, components spread over the set more evenly than independent
draws would: estimates vary less, the more so for small sets. The shuffles of all
shingles advance rank by rank, and a set stops as soon as every component has a
value below the next rank: after some m log m draws in all, however large it is.

Signatures are cut into bands. Sets that agree in a whole band meet in the band's
bucket; with a similarity s they miss each other with a chance of
(1 - s ** rows) ** bands, 5e-9 at 0.8. Buckets are not joined with themselves:

* each set is compared with the least set of one of its buckets;
* then with the least sets of its other buckets, where these are in another group;
* in buckets that still hold several groups, the sets outside the largest one are
  compared with the set that is central in it;
* what is outside then is compared with the sets of the bucket's other groups.

Sizes and odd sketches (whose distance never exceeds the symmetric difference)
drop what can't be linked, and what is left is confirmed on the full sets of
shingles. Groups are grown by unions of linked ends, as distributed star rounds.

Skew: equal texts are one set; buckets are aggregated to their least and largest
set before they are shuffled; the pairs of a set that many are compared with are
split by Spark in the joins, and a bucket with many sets is dealt out to several
tasks.

64-bit hashes stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.anchored import _BASES, _Hashes, _mix, text_keys, with_copies
from loomframe.llm.common import broadcast_if_small, discard, in_batches, materialise, ships, table, worker_cache
from loomframe.llm.components import connected
from loomframe.llm.jaccard import SKETCH, _node, _ragged, contents, odd_sketch, shingles, verified

ships(__name__)

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 48, 5
#: Shingles whose permutations are held at once.
AT_ONCE = 8192
#: Sets of one bucket that one task gets to compare others with.
HUB = 2000

_FRACTION, _PICK = np.uint64(40), np.uint64(24)


def signatures(hashes: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """(sets, m): the SuperMinHash of each set; ``hashes`` are the distinct elements of sets of ``sizes`` (none 0), one after another.

    A value is rank << 40 | fraction.
    """
    best = np.full((len(sizes), m), np.int64(m) << 40, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for s in np.flatnonzero(sizes > AT_ONCE):
        for k in range(starts[s], starts[s + 1], AT_ONCE):
            part = hashes[k : min(k + AT_ONCE, starts[s + 1])]
            _improve(best, np.full(len(part), s), part)
    held: list[int] = []
    total = 0
    for s in [*np.argsort(sizes, kind="stable"), None]:  # sets of like sizes stop at like ranks
        if s is not None and sizes[s] > AT_ONCE:
            continue
        if held and (s is None or total + sizes[s] > AT_ONCE):
            rows = best[held]
            _improve(rows, np.repeat(np.arange(len(held)), sizes[held]), np.concatenate([hashes[starts[x] : starts[x + 1]] for x in held]))
            best[held] = rows
            held, total = [], 0
        if s is not None:
            held.append(s)
            total += sizes[s]
    return best


def _improve(best: np.ndarray, own: np.ndarray, hashes: np.ndarray) -> None:
    """Lower the signatures ``best`` by elements ``hashes``, which are of the sets ``own``."""
    m, flat = best.shape[1], best.ravel() if best.flags["C_CONTIGUOUS"] else None
    order = np.tile(np.arange(m, dtype=np.int16), (len(hashes), 1))
    at = np.arange(len(hashes))
    for rank in range(m):
        x = _mix(hashes[at] + np.uint64((rank + 1) * int(_BASES[0]) & 2**64 - 1))
        pick = rank + ((x & np.uint64((1 << 24) - 1)) * np.uint64(m - rank) >> _PICK).astype(np.int64)
        which = order[at, pick]
        order[at, pick] = order[at, rank]
        np.minimum.at(flat, own[at] * m + which, (x >> _PICK).view(np.int64) | np.int64(rank) << 40)
        if rank < 8 or rank % 4 == 0:
            rows = np.unique(own[at])
            going = np.zeros(len(best), bool)
            going[rows] = best[rows].max(1) >= np.int64(rank + 1) << 40
            at = at[going[own[at]]]
            if not len(at):
                return


def buckets(best: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands): a hash of each band of signatures."""
    mixed = _mix(best.view(np.uint64) + np.arange(1, best.shape[1] + 1, dtype=np.uint64) * _BASES[1])
    return _mix(mixed.reshape(len(best), bands, -1).sum(2) + np.arange(1, bands + 1, dtype=np.uint64) * _BASES[0]).view(np.int64)


def described(rows: DataFrame, size: int, bands: int, height: int) -> DataFrame:
    """(doc_id, ord, n, node, sketch, lists) of ``rows`` (doc_id, ord, lone, text); sketch and lists of lone rows only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_cache("shingle-words", _Hashes)
        none = np.zeros(0, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sets = [shingles(memo, t.as_py() or "", size) for t in batch.column(3)]
                lone = [i for i, (s, x) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True)) if x and len(s)]
                sketches, lists = [none] * len(sets), [none] * len(sets)
                if lone:
                    own = [sets[i] for i in lone]
                    found = buckets(signatures(np.concatenate(own), np.array([len(s) for s in own]), bands * height), bands)
                    for i, s, b in zip(lone, own, found, strict=True):
                        sketches[i], lists[i] = odd_sketch(s), b
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_node, sets), pa.int64()), _ragged(sketches), _ragged(lists)], ["doc_id", "ord", "n", "node", "sketch", "lists"])
            pa.default_memory_pool().release_unused()

    return in_batches(rows.select("doc_id", "ord", "lone", "text"), work, "doc_id long, ord long, n long, node long, sketch array<long>, lists array<long>")


def may_link(n: Column, other_n: Column, sketch: Column, other_sketch: Column, percent: int) -> Column:
    """False only of sets that can't be linked."""
    far = sum((F.bit_count(F.get(sketch, F.lit(k)).bitwiseXOR(F.get(other_sketch, F.lit(k)))) for k in range(1, SKETCH)), F.bit_count(F.get(sketch, F.lit(0)).bitwiseXOR(F.get(other_sketch, F.lit(0)))))
    return (n * 100 >= other_n * percent) & (other_n * 100 >= n * percent) & (far * (100 + percent) <= (n + other_n) * (100 - percent))


def linked(pairs: DataFrame, places: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, written; ``places`` (node, n, sketch), ``items`` (node, items).

    ``pairs`` and what is left of them are written tables, so that Spark splits
    the pairs of a node that many are compared with in the joins.
    """
    side = lambda end, x: places.select(F.col("node").alias(end), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"))
    near = pairs.join(side("a", "l"), "a").join(side("b", "r"), "b").filter(may_link(F.col("l_n"), F.col("r_n"), F.col("l_s"), F.col("r_s"), percent))
    near = materialise(near.select("a", "b"), "near")
    out = materialise(verified(near, items, percent), "links")
    discard(near)
    return out


def open_lists(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((list, node, component), (list, component, m)) of the buckets that hold several groups."""
    each = members.select("list", "node").distinct().join(broadcast_if_small(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = materialise(each.groupBy("list", "component").agg(F.count("*").alias("m")), "list-groups")
    still = materialise(sizes.groupBy("list").count().filter("count > 1").select("list"), "open-lists")
    small = broadcast_if_small(still)
    return materialise(each.join(small, "list"), "open"), materialise(sizes.join(small, "list"), "open-groups")


def central_pairs(each: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): the sets outside a bucket's largest group, with the set that is central in that group.

    A group's central set is the one whose buckets hold the most of the group,
    wherever they are: what few words tell from all others.
    """
    tops = sizes.groupBy("list").agg(F.max(F.struct("m", "component"))["component"].alias("top"))
    near = each.join(sizes, ["list", "component"]).groupBy("component", "node").agg(F.sum("m").alias("near"))
    central = near.groupBy("component").agg(F.max(F.struct("near", "node"))["node"].alias("a")).withColumnRenamed("component", "top")
    outside = each.join(tops, "list").filter("component <> top").select("top", F.col("node").alias("b")).distinct()
    return materialise(outside.join(broadcast_if_small(materialise(central, "central")), "top").select("a", "b").distinct(), "pairs")


def open_pairs(each: DataFrame, sizes: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different groups that share a bucket, without those within the bucket's largest group."""
    still = sizes.groupBy("list").agg(F.max(F.struct("m", "component"))["component"].alias("top"), F.ceil(F.sum("m") / HUB).cast("int").alias("deals"))
    rest = materialise(each.join(broadcast_if_small(materialise(still, "open-lists")), "list").join(places.select("node", "n", "sketch"), "node"), "open")
    left = rest.filter("component <> top").select("list", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"l_{c}") for c in ("node", "n", "component", "sketch")])
    right = rest.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals").cast("long")).cast("int"))
    once = (F.col("component") != F.col("l_component")) & ((F.col("component") == F.col("top")) | (F.col("l_node") < F.col("node")))
    near = may_link(F.col("n"), F.col("l_n"), F.col("sketch"), F.col("l_sketch"), percent)
    met = left.join(right, (left["list"] == right["list"]) & (left["deal"] == right["deal"]) & once & near)
    out = materialise(met.select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct(), "pairs")
    discard(rest)
    return out


def near_duplicates(df: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, height: int = ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``df``.

    Documents are linked at a Jaccard similarity of ``percent`` of their sets of
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle).
    ``component_id`` is the smallest id reachable by links; ``kept`` says whether
    it is the document's own.

    A null text is an empty one; texts without words have empty sets, are linked
    with nothing and kept. Rows with equal sets are linked, whatever their ids;
    rows that repeat an id are decided alike if their texts are equal. A null id
    is never a component's id, unless nothing else is in it. Very long texts are
    taken whole. An empty table gives no rows.
    """
    keyed = with_copies(text_keys(df, text_col, id_col)).withColumn("lone", F.col("first").isNull() | (F.col("ord") == F.col("first")))
    sets = materialise(described(keyed, size, bands, height), "sets")
    entries = sets.filter(F.size("lists") > 0).select("node", F.explode("lists").alias("list"))
    lists = entries.groupBy("list").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("list", "a")
    lists = materialise(lists, "lists")
    members = materialise(entries.join(broadcast_if_small(lists), "list"), "members")
    discard(lists)
    met = members.select("node").distinct()
    nodes = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    shown = sets.filter(F.size("lists") > 0).join(broadcast_if_small(met), "node", "left_semi")
    places = materialise(shown.groupBy("node").agg(F.min("ord").alias("ord"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "places")
    items = materialise(contents(keyed.select("ord", "text"), places.select("node", "ord"), size), "items")
    # the least set of one bucket
    first = materialise(members.filter("node <> a").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = linked(first, places, items, percent)
    # the least sets of the other buckets, unless it is clear already that they are in one group
    above = broadcast_if_small(links.select(F.col("b").alias("node"), F.col("a").alias("above")))
    others = members.filter("node <> a").select("a", F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        others = others.join(above.withColumnsRenamed({"node": end, "above": f"{end}_above"}), end, "left")
    others = materialise(others.filter(F.coalesce("a_above", "a") != F.coalesce("b_above", "b")).select("a", "b"), "pairs")
    links = links.unionByName(linked(others, places, items, percent))
    parts = materialise(connected(links), "parts")
    # buckets that hold several groups: the sets outside the largest one with its central set
    each, sizes = open_lists(members, parts)
    central = central_pairs(each, sizes)
    more = linked(central, places, items, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        discard(each, sizes, parts)
        parts = materialise(connected(links), "parts")
        each, sizes = open_lists(members, parts)
    # then with all of the other groups' sets
    late = open_pairs(each, sizes, places, percent)
    last = linked(late, places, items, percent)
    if not last.isEmpty():
        parts = materialise(connected(links.unionByName(last)), "parts")
    discard(members, items, first, others, central, late, each, sizes)
    # nodes that stand for several rows or are linked
    grouped = nodes.join(broadcast_if_small(parts), "node", "left").filter("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    grouped = materialise(grouped.select("node", "component", "least"), "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = materialise(grouped.join(broadcast_if_small(least), "component").select("node", "component_id", F.lit(True).alias("found")), "answers")
    discard(grouped, places, parts)
    out = sets.select("doc_id", "n", "node").join(broadcast_if_small(answers), "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, size=2)


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
