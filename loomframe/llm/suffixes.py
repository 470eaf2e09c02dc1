"""Suffix-array deduplication of bytes by a common-prefix interval tree.

Repeated 200-byte strings are brought together by anchored segments (see
``anchored``): all segments of one anchor are aligned at it. A shard sorts its
segments by what follows the anchor (an enhanced suffix array: suffixes and
their common prefixes) and scans it with a stack. Each interval of the tree
holds all segments that share some number of bytes to the right; its members
are kept ordered by what precedes the anchor, so that where sets of members
meet, their left extensions are compared: each maximal repeat (extended until
the members differ on both sides) of 200 bytes or more is reported for all its
occurrences. Small sets are merged into large ones.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.anchored import Units, remove_repeats
from loomframe.llm.common import ships, table

ships(__name__)

UNITS = Units(words=False, window=200, gram=48)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) >> 3)


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(member, a, r): a repeat that reaches ``a`` bytes before and ``r`` after the member's anchor.

    ``left`` is reversed. Only repeats of ``least`` bytes or more; those that
    lie inside another one of the same member may be missing.
    """
    m = len(left)
    suffixes = sorted(range(m), key=right.__getitem__)
    by_left = sorted(range(m), key=left.__getitem__)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    found: list[tuple[int, int, int]] = []

    def meet(large: list[int], small: list[int], r: int) -> list[int]:
        """Joins two sets of left ranks that share ``r`` bytes to the right."""
        if len(large) < len(small):
            large, small = small, large
        places = [bisect_left(large, x) for x in small]
        for x, k in zip(small, places, strict=True):
            for y in large[max(0, k - 1) : k + 1]:
                i, j = by_left[x], by_left[y]
                a = common(left[i], left[j])
                if a + r >= least:
                    found.append((i, a, r))
                    found.append((j, a, r))
        return sorted(large + small)

    stack: list[tuple[int, list[int]]] = []
    for k, i in enumerate(suffixes):
        node = [rank[i]]
        r = common(right[i], right[suffixes[k + 1]]) if k + 1 < m else 0
        while stack and stack[-1][0] > r:
            deep, members = stack.pop()
            node = meet(members, node, deep)
        if stack and stack[-1][0] == r:
            stack[-1] = (r, meet(stack[-1][1], node, r))
        else:
            stack.append((r, node))
    return found


def report(shard: dict, window: int = UNITS.window) -> list[tuple[int, int, int, int]]:
    """Runs (segment, first window, windows, 0) that repeat, in a shard's columns."""
    out = []
    for _, rows in groupby(range(len(shard["key"])), key=shard["key"].__getitem__):
        rows = list(rows)
        runs: dict[int, list[tuple[int, int]]] = {k: [(0, shard["wins"][k])] for k in rows if shard["n"][k] > 1}
        once = [k for k in rows if shard["n"][k] == 1]
        if once and len(rows) > 1:
            left = [shard["body"][k][: shard["aoff"][k]][::-1] for k in rows]
            right = [shard["body"][k][shard["aoff"][k] :] for k in rows]
            for i, a, r in maximal_repeats(left, right, window):
                k = rows[i]
                if shard["n"][k] == 1:
                    at = shard["aoff"][k]
                    runs.setdefault(k, []).append((at - a, at - (window - r) + 1))
        for k, spans in runs.items():
            at = end = -1
            for a, b in sorted(spans):
                if a > end:
                    if end >= 0:
                        out.append((k, at, end - at, 0))
                    at = a
                end = max(end, b)
            out.append((k, at, end - at, 0))
    return out


def remove_repeated_bytes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", units: Units = UNITS) -> DataFrame:
    """``doc_id``, ``n``, ``n_removed``, ``n_spans`` and ``kept`` (bytes): what no repeated string covers."""
    return remove_repeats(df, units, lambda shard: report(shard, units.window), False, text_col, id_col)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
