"""Anchored segments: how repeated strings of a corpus are brought together.

A window is ``window`` consecutive units (words or bytes) of one document. Its
anchor is its ``gram``-unit substring with the least hash, the leftmost of
equals. Equal windows have equal anchors at the same place, so they meet under
the anchor's hash, whatever surrounds them. A segment is what the neighbouring
windows with one anchor cover.

``candidates`` finds the segments whose anchor stands in more than one place,
``distinct_segments`` and ``contents`` fetch each different one once, ``indexed``
hands them, shard by shard, to an index that reports which of a segment's
windows are repeated, and ``repeated_spans`` gives the places of all
occurrences. Hashes only decide what is compared; segments are equal when two
independent 64-bit hashes are.

Skew: exact copies are set aside first; anchors and segments are aggregated
before they are shuffled; joins back to occurrences are plain equi-joins, which
Spark splits when a key is hot; an anchor with more than ``HOT`` different
segments is cut to single windows, dealt by their own hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import broadcast_if_small, discard, in_batches, let, materialise, partitions, ships, worker_cache

ships(__name__)

#: Different segments above which an anchor is cut to single windows.
HOT = 20_000
#: Units that are looked at in one piece; longer documents are cut, with overlap.
PIECE = 1 << 20
_POS = np.uint64((1 << 21) - 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Units:
    words: bool
    window: int
    gram: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out.append(tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE + 4096, b, np.uint64)))) for b in (base, inverse)))
    return out


class Cutter:
    """Symbols and segments of texts; one for each Python worker."""

    def __init__(self, units: Units):
        self.units, self.memo, self.powers = units, _Hashes(), _powers()
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * _BASES[0])

    def symbols(self, text: str) -> np.ndarray:
        raw = (text or "").encode()
        if self.units.words:
            words = raw.split()
            return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        return self.bytes[np.frombuffer(raw, np.uint8)]

    def segments(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents that begin at ``starts``: place, windows, place of the anchor, hashes of anchor and segment."""
        n, w, k = len(sym), self.units.window, self.units.gram
        if n < w:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(sym * p[:n]))) for p, _ in self.powers]
        grams = _mix((sums[0][k:] - sums[0][:-k]) * self.powers[0][1][: n - k + 1])
        least, span, wide = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), 1, w - k + 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: span - wide], least[wide - span :])
        at = (least & _POS).astype(np.int64)
        ends = np.append(starts[1:], n)
        broken = np.zeros(n + 1, np.int32)
        np.add.at(broken, np.maximum(starts, ends - w + 1), 1)
        np.add.at(broken, ends, -1)
        valid = np.cumsum(broken)[: len(at)] == 0
        new = np.append(True, (at[1:] != at[:-1]) | ~valid[:-1])
        first = np.flatnonzero(valid & new)
        last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
        count = last - first + 1
        stop = first + count + w - 1
        whole = _mix((sums[1][stop] - sums[1][first]) * self.powers[1][1][first] + count.astype(np.uint64) * _BASES[0])
        return first, count, at[first] - first, grams[at[first]], whole


def _cutter(units: Units) -> Cutter:
    return worker_cache(f"cutter-{units}", lambda: Cutter(units))


def pack(start: Column, count: Column, anchor: Column) -> Column:
    return F.call_function("shiftleft", start.cast("long"), F.lit(24)) + count * 4096 + anchor


def text_keys(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text, tk, t2, ord): two hashes of the text and the id, null last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"), F.hash(text).alias("t2"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1).cast("long")).alias("ord"))


def with_copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``copies`` (rows of this text) and ``first`` (their least ``ord``); both null where there is one row."""
    groups = materialise(keyed.groupBy("tk", "t2").agg(F.count("*").alias("copies"), F.min("ord").alias("first")).filter("copies > 1"), "copies")
    return keyed.join(broadcast_if_small(groups), ["tk", "t2"], "left")


def extract(rows: DataFrame, units: Units) -> DataFrame:
    """Segments (anchor, seg, doc, t2, at) of ``rows`` (doc, t2, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(units)

        def cut(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            sizes = np.array([len(s) for _, _, _, s in held], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            first, count, anchor, grams, whole = cutter.segments(np.concatenate([s for _, _, _, s in held]), starts)
            which = np.searchsorted(starts, first, "right") - 1
            docs, t2s, offsets = (np.array([h[k] for h in held], t) for k, t in ((0, np.int64), (1, np.int32), (2, np.int64)))
            place = ((first - starts[which] + offsets[which]) << 24) + count * 4096 + anchor
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(docs[which]), pa.array(t2s[which]), pa.array(place)], ["anchor", "seg", "doc", "t2", "at"])

        held, total = [], 0
        for batch in batches:
            for doc, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                sym = cutter.symbols(text.as_py())
                step = PIECE // 2
                for k in range(0, max(1, len(sym) - units.window + 1), step):
                    part = sym[k : k + step + units.window - 1]
                    if len(part) < units.window:
                        continue
                    held.append((doc, t2, k, part))
                    total += len(part)
                    if total >= PIECE // 2:
                        yield cut(held)
                        held, total = [], 0
        if held:
            yield cut(held)

    return in_batches(rows.select("doc", "t2", "text"), work, "anchor long, seg long, doc long, t2 int, at long")


def candidates(segments: Callable[[], DataFrame], other_document: bool) -> DataFrame:
    """Segments whose anchor stands in two documents (or, if not ``other_document``, in two places)."""
    twice = segments().groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")) if other_document else segments().groupBy("anchor").agg(F.count("*").alias("n"))
    # written before it is joined, so that Spark can split the segments of a hot anchor
    twice = materialise(twice.filter("a < b" if other_document else "n > 1").select("anchor"), "anchors")
    found = materialise(segments().join(broadcast_if_small(twice), "anchor", "left_semi"), "candidates")
    discard(twice)
    return found


def distinct_segments(found: DataFrame) -> DataFrame:
    """(anchor, seg, n, place, hot): each different segment, its number of occurrences and its first."""
    each = materialise(found.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc", "t2", "at")).alias("place")), "segments")
    hot = materialise(each.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    return each.join(broadcast_if_small(hot), "anchor", "left")


def contents(each: DataFrame, rows: DataFrame, units: Units) -> DataFrame:
    """(key, anchor, seg, off, aoff, wins, n, doc, body) of each different segment, from the texts of ``rows``."""
    wanted = each.groupBy(F.col("place.doc").alias("doc"), F.col("place.t2").alias("t2")).agg(F.collect_list(F.struct("anchor", "seg", F.col("place.at").alias("at"), "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want"))
    wanted = materialise(wanted, "wanted")
    texts = rows.select("doc", "t2", "text").join(broadcast_if_small(wanted.select("doc", "t2")), ["doc", "t2"], "left_semi")
    w = units.window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(units)
        for batch in batches:
            out: list[tuple] = []
            for doc, text, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                body = cutter.symbols(text) if units.words else text.encode()
                fields = want.values
                for anchor, seg, at, n, hot in zip(*(fields.field(k).to_pylist() for k in range(5)), strict=True):
                    start, wins, aoff = at >> 24, (at >> 12) & 4095, at & 4095
                    if not hot:
                        part = body[start : start + wins + w - 1]
                        out.append((anchor, anchor, seg, 0, aoff, wins, n, doc, part.tobytes() if units.words else part))
                        continue
                    for off in range(wins):
                        part = body[start + off : start + off + w]
                        raw = part.tobytes() if units.words else part
                        out.append((_key(raw), anchor, seg, off, 0, 1, n, doc, raw))
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return in_batches(texts.join(wanted, ["doc", "t2"]).select("doc", "text", "want"), work, _CONTENT)


_CONTENT = "key long, anchor long, seg long, off int, aoff int, wins int, n long, doc long, body binary"


def _key(raw: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _CONTENT.split(", ")])


def indexed(content: DataFrame, index: Callable[[dict], list[tuple[int, int, int, int]]], most: int = 16_000_000) -> DataFrame:
    """(anchor, seg, off, len, least) from ``index``, which gets a shard of whole keys, in order, as columns.

    ``index`` returns (row of the shard, first window, windows, value). A shard
    has about ``most`` bytes of segments.
    """
    names = [c.split()[0] for c in _CONTENT.split(", ")]

    def told(shard: list[list]) -> pa.RecordBatch:
        columns = dict(zip(names, zip(*shard, strict=True), strict=True))
        runs = index(columns)
        rows = [(columns["anchor"][r], columns["seg"][r], columns["off"][r] + off, size, value) for r, off, size, value in runs]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["anchor", "seg", "off", "len", "least"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
                if total >= most and row[0] != shard[-1][0]:
                    yield told(shard)
                    shard, total = [], 0
                shard.append(row)
                total += len(row[-1]) + 100
        if shard:
            yield told(shard)

    spread = content.repartition(partitions(content.sparkSession), "key").sortWithinPartitions("key")
    return materialise(in_batches(spread, work, "anchor long, seg long, off int, len int, least long"), "repeats")


def repeated_spans(found: DataFrame, runs: DataFrame, window: int, other_document: bool) -> DataFrame:
    """(doc, t2, spans): the maximal spans [start, stop) of each document that repeated windows cover."""
    hits = found.join(runs, ["anchor", "seg"])
    hits = hits.filter(F.col("least") < F.col("doc")) if other_document else hits
    start = F.shiftright("at", 24) + F.col("off")
    spans = hits.groupBy("doc", "t2").agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("len") + (window - 1)).alias("stop")))).alias("s"))
    return materialise(spans.select("doc", "t2", merged(F.col("s")).alias("spans")), "spans")


def merged(spans: Column) -> Column:
    """Sorted spans (start, stop), joined where they touch or overlap, in linear work.

    A span begins a new one where it starts beyond the furthest end of all
    before it, which is found block by block.
    """

    def joined(reached: Column) -> Column:
        marked = F.zip_with(spans, reached, lambda s, at: F.struct(s["start"].alias("start"), F.greatest(s["stop"], at).alias("stop"), (s["start"] > at).alias("new")))
        begins = lambda m: F.filter(m, lambda x: x["new"])
        # the end of a joined span is what has been reached before the next one begins
        ends = lambda m: F.transform(F.filter(m, lambda x, i: F.coalesce(F.get(m, i + 1)["new"], F.lit(True))), lambda x: x["stop"])
        return let(marked, lambda m: F.zip_with(begins(m), ends(m), lambda b, e: F.struct(b["start"].alias("start"), e.alias("stop"))))

    return let(running_max(F.transform(spans, lambda s: s["stop"])), joined)


def running_max(values: Column, block: int = 128) -> Column:
    """For each of an array of longs, the largest of all before it, or -1."""
    low, none = F.lit(-1).cast("long"), F.expr("cast(array() as array<bigint>)")

    def through(numbers: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(F.greatest(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(numbers, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda i: F.slice(v, i, F.lit(block)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, through(F.transform(b, lambda x: F.array_max(x)), low), through)))

    return F.when(F.size(values) == 0, none).otherwise(let(values, whole))


def cut_out(rows: DataFrame, spans: DataFrame, units: Units) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept) of ``rows`` (doc_id, doc, t2, text, all).

    Where ``all`` holds, every unit goes if the text has a window at all.
    Bytes are kept as they are, words are joined by one blank.
    """
    w = units.window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, everything, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.as_py().encode()
                body = raw.split() if units.words else raw
                n = len(body)
                runs = [(0, n)] if everything and n >= w else list(zip(cuts.values.field(0).to_pylist(), cuts.values.field(1).to_pylist(), strict=True)) if not everything and cuts.is_valid else []
                if runs:
                    parts, at = [], 0
                    for a, b in runs:
                        parts.append(body[at:a])
                        at = b
                    parts.append(body[at:])
                    kept = b" ".join(x for p in parts for x in p) if units.words else b"".join(parts)
                else:
                    kept = b" ".join(body) if units.words else body
                out.append((doc_id, n, sum(b - a for a, b in runs), len(runs), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "n", "n_removed", "n_spans", "kept"])

    joined = rows.join(broadcast_if_small(spans), ["doc", "t2"], "left")
    return in_batches(joined.select("doc_id", "text", "all", "spans"), work, "doc_id long, n long, n_removed long, n_spans long, kept binary")


def remove_repeats(df: DataFrame, units: Units, index: Callable[[dict], list], other_document: bool, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The whole job; see ``cut_out`` for the result.

    With ``other_document``, only windows that also start in a document with a
    smaller id count. A null text is an empty one, a null id the largest. Rows
    with one id and one text are one document; rows with one id and different
    texts are two documents neither of which is the smaller.
    """
    keyed = with_copies(text_keys(df, text_col, id_col)).withColumn("doc", F.col("ord") if other_document else F.col("tk"))
    lone = keyed.filter(F.col("first").isNull() | (F.col("ord") == F.col("first")))
    found = candidates(lambda: extract(lone, units), other_document)
    runs = indexed(contents(distinct_segments(found), lone, units), index)
    spans = repeated_spans(found, runs, units.window, other_document)
    discard(found, runs)
    gone = F.col("ord") > F.col("first") if other_document else F.col("copies") > 1
    return cut_out(keyed.withColumn("all", F.coalesce(gone, F.lit(False))), spans, units)
