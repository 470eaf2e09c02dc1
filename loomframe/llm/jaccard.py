"""Exact Jaccard join on word shingles, by set relations, down to components.

A set's shingles are ordered by hash and cut into position blocks: as many, for
its size class, as a link's symmetric difference can have elements, plus one, plus
some spare ones. Linked sets agree in more blocks than are spare. Each index list
holds the sets with one content of one block, so whole blocks that differ are
skipped. Empty blocks give no list, but for the few sets that have more empty
blocks than there are spare ones: only two of those can agree in nothing else.

A list isn't joined with itself. Its least set answers first; sets that are
verified to be linked to it take over its component, and need no answer of their
own within that component. Only where a list still holds several components are
the sets outside the largest of them compared with the others: by size, by odd
sketches (whose Hamming distance never exceeds the symmetric difference), then on
the shingles. So no link between different components is lost, and no list's
pairs are enumerated.

Sets stand for equal texts, once each: repeated and equal documents are one set.
64-bit hashes stand for shingles and sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.anchored import _BASES, _Hashes, _mix, text_keys, with_copies
from loomframe.llm.common import BROADCAST_BYTES, SPACES, broadcast_if_small, discard, fits, in_batches, materialise, partitions, ships, slices, table, worker_cache
from loomframe.llm.components import connected

ships(__name__)

SHINGLE = 3
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 90
SKETCH = 16
#: Partitions of index entries for each shuffle partition: a text has hundreds of entries.
SPREAD = 4


def most_different(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
    return (a + b) * (100 - percent) // (100 + percent)


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """(number, least size, largest size) of the class of ``n``; linked sets are in one class or neighbouring ones."""
    k, low = 0, 1
    while True:
        high = low * 100 // percent
        if n <= high:
            return k, low, high
        k, low = k + 1, high + 1


def blocks(k: int, low: int, high: int, percent: int) -> tuple[int, int]:
    """Position blocks of class ``k`` (sizes ``low`` to ``high``), for pairs in it or with the next class; and the spare ones."""
    least = most_different(high, high * 100 // percent, percent) + 1
    if least == 1:  # linked sets are equal
        return 1, 0
    spare = math.ceil(2 * least * math.exp(-0.9 * low / least)) + (least > 2)
    return least + spare, spare


def shingles(memo: dict, text: str, size: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    words = text.encode().translate(_LOWER).split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < size:
        return _mix(np.array([sum(int(x) * (2 * k + 3) for k, x in enumerate(h)) + len(h) & (2**64 - 1)], np.uint64))
    n, total = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = total * _BASES[0] + h[k : k + n]
    return np.unique(_mix(total))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lists_of(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """The index lists of a set: for its class, and as the larger set for the class below."""
    k, low, high = size_class(len(s), percent)
    mixed, out = _mix(s * _BASES[1]), []
    below = size_class(low - 1, percent) if k else None
    for number, least, most in filter(None, ((k, low, high), below)):
        m, spare = blocks(number, least, most, percent)
        at = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sums, held = np.zeros(m, np.uint64), np.bincount(at, minlength=m) > 0
        np.add.at(sums, at, mixed)
        named = _mix(sums + np.arange(1, m + 1, dtype=np.uint64) * _BASES[0] + np.uint64((number + 1) * 0xD6E8FEB86659FD93 & 2**64 - 1)).view(np.int64)
        out.append(named if m - held.sum() > spare else named[held])
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((_mix(s + _BASES[0]) >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _node(s: np.ndarray) -> int | None:
    """A hash of a set; none of an empty one."""
    return int((_mix(np.sum(_mix(s ^ _BASES[1]), keepdims=True) + np.uint64(len(s))))[0].view(np.int64)) if len(s) else None


def describe(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, node, sketch) of ``rows`` (doc_id, key, text); node is a hash of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_cache("shingle-words", _Hashes)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sets = [shingles(memo, t.as_py() or "", size) for t in batch.column(2)]
                sketches = [odd_sketch(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_node, sets), pa.int64()), _ragged(sketches)], ["doc_id", "key", "n", "node", "sketch"])
            pa.default_memory_pool().release_unused()

    return in_batches(rows.select("doc_id", "key", "text"), work, "doc_id long, key long, n long, node long, sketch array<long>")


def entries_of(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """(list, node): a row for each index list of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_cache("shingle-words", _Hashes)
        for batch in batches:
            lists, nodes, held = [], [], 0
            for t in batch.column(0):
                s = shingles(memo, t.as_py() or "", size)
                if len(s):
                    own = np.concatenate(lists_of(s, percent))
                    lists.append(own)
                    nodes.append(np.full(len(own), _node(s), np.int64))
                    held += len(own)
                if held >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.concatenate(nodes))], ["list", "node"])
                    lists, nodes, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.concatenate(nodes))], ["list", "node"])
            pa.default_memory_pool().release_unused()

    return in_batches(rows.select("text"), work, "list long, node long")


def contents(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, items) of the sets ``nodes`` (ord, node), from ``rows`` (ord, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_cache("shingle-words", _Hashes)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sets = [shingles(memo, t or "", size).view(np.int64) for t in batch.column(1).to_pylist()]
                nodes = [_node(x.view(np.uint64)) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _ragged(sets)], ["node", "items"])

    ids = nodes.select("ord").distinct()
    got = in_batches(rows.join(broadcast_if_small(ids), "ord", "left_semi").select("ord", "text"), work, "node long, items array<long>")
    return got.join(broadcast_if_small(nodes.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked.

    Contents move once where the pairs are few, and those of nodes in no pair don't.
    """

    def side(name: str, held: str) -> DataFrame:
        ids = pairs.select(F.col(name).alias("node")).distinct()
        some = items.join(F.broadcast(ids), "node", "left_semi") if fits(ids, BROADCAST_BYTES // 8) else items
        return some.select(F.col("node").alias(name), F.col("items").alias(held))

    both = side("b", "y").join(broadcast_if_small(pairs), "b").join(side("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def parted(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components; a node without one is its own."""
    known = broadcast_if_small(parts)
    end = lambda name: known.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    both = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _close(percent: int) -> Column:
    """What linked sets (n, sketch) and (l_n, l_sketch) fulfil: sizes, and a Hamming distance that their difference bounds."""
    far = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("l_sketch", F.lit(k)))) for k in range(1, SKETCH)), F.bit_count(F.get("sketch", F.lit(0)).bitwiseXOR(F.get("l_sketch", F.lit(0)))))
    return (F.col("n") * 100 >= F.col("l_n") * percent) & (F.col("l_n") * 100 >= F.col("n") * percent) & (far * (100 + percent) <= (F.col("n") + F.col("l_n")) * (100 - percent))


def alike(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be linked by their sizes and sketches; all linked ones are among them."""
    left = places.select(F.col("node").alias("a"), F.col("n").alias("l_n"), F.col("sketch").alias("l_sketch"))
    right = places.select(F.col("node").alias("b"), "n", "sketch")
    return broadcast_if_small(pairs).join(left, "a").join(right, "b").filter(_close(percent)).select("a", "b")


def jaccard_components(df: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``n_shingles``, ``component_id``, ``component`` (null for empty sets).

    A null text is an empty one; an empty set is a component of its own. A null
    id is never a component's id, unless nothing else is in it. One row for each
    row of ``df``; rows with equal texts are linked, whatever their ids.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    order = F.coalesce("doc_id", F.lit(2**63 - 1).cast("long"))
    sets = materialise(describe(rows, size), "sets").withColumn("ord", order)
    keyed = with_copies(text_keys(df, text_col, id_col))
    lone = keyed.filter(F.col("first").isNull() | (F.col("ord") == F.col("first")))
    # one exchange deals the entries for both: which lists hold two sets, and who is in them
    entries = entries_of(lone, percent, size).filter("list IS NOT NULL").repartition(SPREAD * partitions(df.sparkSession), "list")
    # lists with the same sets in them, as near copies have by the dozen, are one: their sums of hashes agree
    mark = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 32)).alias(f"mark{seed}")
    lists = entries.groupBy("list").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("held"), mark(1), mark(2)).filter("a < z")
    lists = lists.groupBy("a", "z", "held", "mark1", "mark2").agg(F.min("list").alias("list")).select("list", "a")
    members = materialise(entries.join(lists, "list").distinct(), "members")
    pairs = materialise(members.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    places = materialise(sets.filter("n > 0").groupBy("node").agg(F.min("ord").alias("ord"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(members.select("node").distinct(), "node", "left_semi"), "places")
    items = materialise(contents(rows.withColumn("ord", order), places.select("node", "ord"), size), "items")
    # each set against one of its lists' first sets; then, where the ends are still apart, against the others
    first = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialise(verified(first, items, percent), "links")
    parts = materialise(connected(links), "parts")
    apart = materialise(alike(parted(pairs.join(first, ["a", "b"], "left_anti"), parts), places, percent), "pairs")
    more = materialise(verified(apart, items, percent), "links")
    discard(first, apart)
    if not more.isEmpty():
        links = links.unionByName(more)
        discard(parts)
        parts = materialise(connected(links), "parts")
    # lists that hold several components: their sets outside the largest one against all others
    placed = members.select("list", "node").join(places.select("node", "n"), "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("list", "component").agg(F.count("*").alias("m")).groupBy("list").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("parts"))
    open_lists = sizes.filter("parts > 1").select("list", F.col("top.component").alias("top"))
    rest = materialise(placed.join(open_lists, "list").join(places.select("node", "sketch"), "node"), "open")
    left = rest.filter("component <> top").select("list", *[F.col(c).alias(f"l_{c}") for c in ("node", "n", "component", "sketch")])
    right = rest.select("list", "node", "n", "component", "sketch", "top")
    near = (left["list"] == right["list"]) & (F.col("component") != F.col("l_component")) & ((F.col("component") == F.col("top")) | (F.col("l_node") < F.col("node"))) & _close(percent)
    more = left.join(right, near).select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    late = materialise(verified(materialise(more, "pairs"), items, percent), "links")
    discard(items, rest, members)
    if not late.isEmpty():
        parts = connected(links.unionByName(late))
    labelled = sets.select("doc_id", "key", "n", "node").join(broadcast_if_small(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialise(labelled, "labelled")
    least = labelled.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = labelled.join(least, "component", "left")
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def one_of_each(df: DataFrame, percent: int = 80, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with one document of each component: its smallest id (null last), then text hash.

    Empty texts stay, and repeated rows of a document stay once.
    """
    found = materialise(jaccard_components(df, percent, size, text_col, id_col).filter(F.col("component").isNotNull()), "components")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1).cast("long")).alias("ord"), "key")
    best = found.groupBy(F.col("component").alias("c")).agg(F.min(place).alias("best"))
    lost = found.join(best, F.col("component") == F.col("c")).filter(place != F.col("best")).select(place["ord"].alias("_lf_ord"), place["key"].alias("_lf_key")).distinct()
    keyed = df.withColumns({"_lf_ord": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1).cast("long")), "_lf_key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    kept = keyed.join(broadcast_if_small(materialise(lost, "lost")), ["_lf_ord", "_lf_key"], "left_anti")
    if not found.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        empty = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, "") == ""
        kept = kept.filter(empty).unionByName(kept.filter(~empty).dropDuplicates(["_lf_ord", "_lf_key"]))
    return kept.select(*df.columns)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
