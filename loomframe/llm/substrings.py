"""Substring deduplication of words with an FM-index for each shard.

Repeated 13-word strings are brought together by anchored segments (see
``anchored``). A shard joins its segments, ordered by document, into one text of
word numbers, and builds a compressed FM-index of it: the Burrows-Wheeler
transform in a wavelet matrix of packed bits with block counts. As no match
longer than a window is asked for, suffixes are sorted by their first 13 words
only. The segments' windows are then searched backward, all together, and each
gives its matching statistic (the words matched) and suffix interval; windows
matched in full report the smallest document of their interval. A document
loses the words of the windows that a smaller document holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.anchored import Units, remove_repeats
from loomframe.llm.common import ships, table

ships(__name__)

UNITS = Units(words=True, window=13, gram=5)


class WaveletMatrix:
    """Rank over a sequence of small numbers, one packed bit vector for each bit."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> np.uint32(bit)) & np.uint32(1)
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            words = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((bit, words, before, len(seq) - int(before[-1])))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))
        self.begin = self._down(np.arange(symbols, dtype=np.int64), np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self.levels:
            at = i >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before place ``i``."""
        return self._down(c, i) - self.begin[c]


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    return np.unique(key, return_inverse=True)[1]


class FMIndex:
    """Of a text of numbers, where 0 separates; finds patterns of up to ``depth`` numbers."""

    def __init__(self, text: np.ndarray, depth: int):
        n, rank, span = len(text), text.astype(np.int64), 1
        shifted = lambda r, k: np.concatenate((r[k:], np.zeros(min(k, n), np.int64)))[:n]
        while 2 * span <= depth:
            rank = _ranked(rank, shifted(rank, span))
            span *= 2
        if span < depth:
            rank = _ranked(rank, shifted(rank, depth - span))
        self.suffixes = np.argsort(rank, kind="stable")
        symbols = int(text.max(initial=0)) + 1
        self.tree = WaveletMatrix(text[self.suffixes - 1].astype(np.uint32), symbols)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int64)

    def match(self, text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern ``text[s : s + depth]``: the words matched from its end, and the suffix interval.

        A pattern whose interval has shrunk to one suffix isn't followed further.
        """
        c = text[starts + depth - 1].astype(np.int64)
        lo, hi = self.below[c].copy(), self.below[c + 1].copy()
        size = (hi > lo).astype(np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for k in range(depth - 2, -1, -1):
            if not len(live):
                break
            c = text[starts[live] + k].astype(np.int64)
            a = self.below[c] + self.tree.rank(c, lo[live])
            b = self.below[c] + self.tree.rank(c, hi[live])
            go = b > a
            live, a, b = live[go], a[go], b[go]
            lo[live], hi[live] = a, b
            size[live] += 1
            live = live[b - a > 1]
        return size, lo, hi


def report(shard: dict, window: int = UNITS.window) -> list[tuple[int, int, int, int]]:
    """Runs (segment, first window, windows, least document) that repeat, in a shard's columns."""
    docs = np.array(shard["doc"], np.int64)
    order = np.argsort(docs, kind="stable")
    bodies = [np.frombuffer(shard["body"][k], np.uint64) for k in order]
    sizes = np.array([len(b) for b in bodies], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    numbers = np.unique(np.concatenate(bodies), return_inverse=True)[1] + 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    index = FMIndex(text, window)
    wins = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), wins)
    off = np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)
    size, lo, hi = index.match(text, begins[owner] + off, window)
    own = docs[order][owner]
    least = own.copy()
    full = (size == window) & (hi - lo > 1)
    # segments are in the order of their documents, and equal suffixes in the order of their places
    least[full] = docs[order][np.searchsorted(begins, index.suffixes[lo[full]], "right") - 1]
    several = np.array(shard["n"], np.int64)[order][owner] > 1
    keep = np.flatnonzero(several | (least < own))
    if not len(keep):
        return []
    same = (owner[keep][1:] == owner[keep][:-1]) & (off[keep][1:] == off[keep][:-1] + 1) & (least[keep][1:] == least[keep][:-1])
    first = np.flatnonzero(np.append(True, ~same))
    long = np.diff(np.append(first, len(keep)))
    at = keep[first]
    return list(zip(order[owner[at]].tolist(), off[at].tolist(), long.tolist(), least[at].tolist(), strict=True))


def remove_repeated_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", units: Units = UNITS) -> DataFrame:
    """``doc_id``, ``n``, ``n_removed``, ``n_spans`` and ``kept`` (UTF-8): the words that no smaller document's windows cover."""
    return remove_repeats(df, units, lambda shard: report(shard, units.window), True, text_col, id_col)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM v GROUP BY s),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i FROM v JOIN f USING (s) WHERE first < doc_id), range(13) t(k)),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM o ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
