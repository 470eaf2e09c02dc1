"""A quality classifier by co-training of two views, calibrated and combined.

The text view sees the text alone: how classes of characters follow each other,
and how varied words and lines are. The metadata view sees source, language and
length alone. Each is a logistic regression. Over rounds, each hands the
unlabelled documents it is most sure of, with its own labels, to the other.
A logistic regression on a held-out part of the labelled rows calibrates and
combines the views; it scores every document.

Fitting uses at most ``max_labelled`` labelled documents, those with the
smallest hashes of their ids, and all unlabelled ones: each round scores all of
them, and the fit sums slopes and curves of those lent. Everything covers all
of each text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import fits, in_batches, materialise, release_memory, ships, slices, summed, table

ships(__name__)

#: Labels up to which their ids are broadcast; beyond, features are shuffled.
BROADCAST_ROWS = 200_000

#: Lent documents in a task of a Newton step: each task sends one matrix of sums, whatever its rows.
LENT_ROWS = 20_000

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", "!", "?", ".", ",", ";:", "'\"", "-_", "|", "#", "*", "$%&", "<>", "()[]{}", "@", "/\\", "=+~^`"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _i
_CLASS[192:] = len(_GROUPS) + 1
C = len(_GROUPS) + 2
N_TEXT, N_META = C * C + 6, 64 + 16 + 3


def text_features(text: str) -> np.ndarray:
    out = np.zeros(N_TEXT, np.float32)
    raw = text.encode()
    codes = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(codes) > 1:
        out[: C * C] = np.sqrt(np.bincount(codes[:-1] * C + codes[1:], minlength=C * C) / (len(codes) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    out[C * C :] = (np.log1p(len(words)) / 8, min(4.0, len(set(words)) / n ** 0.75), len(set(words)) / n, min(3.0, sum(map(len, words)) / n / 8), len(set(lines)) / max(1, len(lines)), 1)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32((source or "").encode()) % 64] = 1
    out[64 + zlib.crc32((lang or "").encode()) % 16] = 1
    size = np.log1p(max(0, n_chars or 0)) / 10
    out[80:] = (size, size * size, 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, more: Callable | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps.

    ``more`` gives slope and curve, at given weights, of rows that aren't here.
    """
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(25):
        slope, curve = moments(x, y, weight, w)
        if more is not None:
            a, b = more(w)
            slope, curve = slope + a, curve + b
        slope, curve = slope + ridge * w, curve + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x


@dataclass(frozen=True)
class Classifier:
    """Weights of the views and of their combination; of fixed size."""

    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.clip(text @ self.text, -30, 30), np.clip(meta @ self.meta, -30, 30)

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.mix[0] * a + self.mix[1] * b + self.mix[2])))


def _stack(rows: object, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, rows)), np.float32).reshape(-1, n).astype(np.float64)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return _stack(column.to_pylist(), n)


class Pool:
    """Unlabelled documents (h, t, m: hash of the id and features), all of them, as a table.

    What a round lends is told by the weights and cuts of that round, so a scan
    knows what earlier rounds lent. A row's key is how sure a view is of it (to
    six places), then the hash. Lent rows are written with their features.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.n = rows, rows.count()
        self.past: list[tuple] = []  # of each round: weights of the views, {(view, label): least key}
        self.lent: list[DataFrame | None] = [None, None]
        self.tasks = [0, 0]  # that read what is lent

    def _scan(self, work: Callable, schema: str) -> DataFrame:
        """``work`` over the views' features, the hashes and the batch, for each batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_memory()
            for whole in batches:
                for batch in slices(whole):
                    views = [_matrix(batch.column(1), N_TEXT), _matrix(batch.column(2), N_META)]
                    yield from work(views, batch.column(0).to_numpy(), batch)
                pa.default_memory_pool().release_unused()

        return in_batches(self.rows.select("h", "t", "m"), run, schema)

    def lend(self, weights: list[np.ndarray], most: dict[tuple[int, int], int], sure: float) -> None:
        """Each view lends its ``most`` surest rows of either label, by (view, label), to the other; rows are lent to a view once."""
        past, least = list(self.past), int(round(float(np.log(sure / (1 - sure))) * 1e6))

        def candidates(views: list[np.ndarray], h: np.ndarray, _: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            free = _free(views, h, past)
            for k in range(2):
                for label in range(2):
                    key = _keys(views[k], weights[k], h, label)
                    key = key[free[k] & (key >= least << _HASH_BITS)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), 2 * k + label, np.int32)), pa.array(key)], ["which", "key"])

        keys = materialise(self._scan(candidates, "which int, key long"), "quality-keys")
        cuts, n = _cuts(keys, {2 * k + label: m for (k, label), m in most.items()})
        cuts = {(c // 2, c % 2): cut for c, cut in cuts.items()}
        self.past.append((weights[0].copy(), weights[1].copy(), cuts))
        for k in range(2):
            def picked(views: list[np.ndarray], h: np.ndarray, batch: pa.RecordBatch, k: int = k) -> Iterator[pa.RecordBatch]:
                free = _free(views, h, past)[k]
                for label in range(2):
                    if (k, label) in cuts:
                        rows = pa.array(free & (_keys(views[k], weights[k], h, label) >= cuts[k, label]))
                        x = batch.column(2 - k).filter(rows)  # of the view that they are lent to
                        yield pa.RecordBatch.from_arrays([x, pa.array(np.full(len(x), float(label)))], ["x", "y"])

            if n[2 * k] + n[2 * k + 1]:
                new = self._scan(picked, "x binary, y double").repartition(-(-(n[2 * k] + n[2 * k + 1]) // LENT_ROWS))
                new = materialise(new, "quality-lent")
                self.tasks[1 - k] += -(-(n[2 * k] + n[2 * k + 1]) // LENT_ROWS)
                self.lent[1 - k] = new if self.lent[1 - k] is None else self.lent[1 - k].unionByName(new)

    def moments(self, k: int, w: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curve of the rows lent to view ``k``, summed up in Spark; the driver gets one matrix."""
        n = len(w)
        if self.lent[k] is None:
            return np.zeros(n), np.zeros((n, n))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 1, n))
            for whole in batches:
                for batch in slices(whole):
                    a, b = moments(_matrix(batch.column(0), n), batch.column(1).to_numpy(), weight, w)
                    total[0] += a
                    total[1:] += b
            strips = range(0, n + 1, _STRIP)
            yield pa.RecordBatch.from_arrays([pa.array(list(strips), pa.int32()), pa.array([total[s : s + _STRIP].tobytes() for s in strips], pa.binary())], ["strip", "v"])

        total = np.frombuffer(summed(in_batches(self.lent[k], part, "strip int, v binary"), "f8", self.tasks[k])).reshape(n + 1, n)
        return total[0], total[1:]


_HASH_BITS, _STRIP, _DIGIT = 35, 40, 15


def _keys(x: np.ndarray, w: np.ndarray, h: np.ndarray, label: int) -> np.ndarray:
    """How sure the view is of ``label``, in millionths of the logit, then bits of the hash; negative where it is sure of the other."""
    z = np.round(np.clip(x @ w, -30, 30) * 1e6).astype(np.int64)
    return ((z if label else -z) << _HASH_BITS) + ((h >> 29) & ((1 << _HASH_BITS) - 1))


def _free(views: list[np.ndarray], h: np.ndarray, past: list[tuple]) -> list[np.ndarray]:
    """For each view, which rows it hasn't lent in ``past`` rounds."""
    free = [np.ones(len(h), bool), np.ones(len(h), bool)]
    for *weights, cuts in past:
        for (k, label), cut in cuts.items():
            free[k] &= _keys(views[k], weights[k], h, label) < cut
    return free


def _cuts(keys: DataFrame, most: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each ``which``, the ``most``-th largest key (the least one where there are fewer) and the rows from it on; by counts of digits."""
    heads, above = dict.fromkeys(most, 0), dict.fromkeys(most, 0)
    taken = dict.fromkeys(most, 0)
    for shift in range(60 - _DIGIT, -1, -_DIGIT):
        here = F.lit(False)
        for c, head in heads.items():
            here |= (F.col("which") == c) & (F.shiftright("key", shift + _DIGIT) == head)
        counts = keys.filter(here).groupBy("which", F.shiftright("key", shift).alias("digits")).agg(F.count("*").alias("n")).collect()
        found: dict[int, list] = {}
        for r in counts:
            found.setdefault(r["which"], []).append((r["digits"], r["n"]))
        heads = {}
        for c, digits in found.items():
            for d, n in sorted(digits, reverse=True):
                heads[c], taken[c] = d, above[c] + n
                if taken[c] >= most[c]:
                    break
                above[c] += n
            else:
                above[c] -= n
    return heads, taken


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool, rounds: int = 4, share: float = 0.05, sure: float = 0.95) -> Classifier:
    """Fits on two thirds of the labelled rows and calibrates on the rest.

    In each round a view labels at most ``share`` of the pool for the other,
    its surest documents of either class, none with less than ``sure``.
    """
    held = np.arange(len(y)) % 3 == 2
    views = [(text, 0.5), (meta, 5.0)]
    weights = [np.zeros(N_TEXT), np.zeros(N_META)]
    for again in range(rounds + 1):
        for k, (x, ridge) in enumerate(views):
            more = None if pool.lent[k] is None else lambda w, k=k: pool.moments(k, w, 0.3)
            weights[k] = fit_logistic(x[~held], y[~held], np.ones((~held).sum()), ridge, more, weights[k])
        if again == rounds or not pool.n:
            break
        most = max(1, int(share * pool.n))
        pool.lend(weights, {(k, label): max(1, int(most * (y.mean() if label else 1 - y.mean()))) for k in range(2) for label in range(2)}, sure)
    a, b = np.clip(text[held] @ weights[0], -30, 30), np.clip(meta[held] @ weights[1], -30, 30)
    target = np.where(y[held] > 0, 1 - 1 / (2 + y[held].sum()), 1 / (2 + (1 - y[held]).sum()))  # Platt's targets
    mix = fit_logistic(np.stack([a, b, np.ones(len(a))], 1), target, np.ones(len(a)), 0.1) if held.any() else np.array([1.0, 0.0, 0.0])
    return Classifier(weights[0], weights[1], mix)


def _features(df: DataFrame, keep: str, kind: str) -> DataFrame:
    """(``keep``, text features, metadata features)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for whole in batches:
            for batch in slices(whole):
                t = [text_features(v.as_py() or "").tobytes() for v in batch.column(1)]
                m = [meta_features(*v).tobytes() for v in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], [keep, "t", "m"])
            pa.default_memory_pool().release_unused()

    return in_batches(df.select(keep, *_inputs()), work, f"{keep} {kind}, t binary, m binary")


def _inputs() -> list:
    return [F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, label_col: str = "quality") -> Classifier:
    """Rows of ``labels`` without an id or a label don't count; one label for each id. All other documents are the pool.

    Where rows of ``docs`` share a labelled id, one of them counts, that with
    the least hash of its text, so that ``max_labelled`` rows come to the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y"))
    wanted = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.join(F.broadcast(wanted), "doc_id")  # wanted has max_labelled rows at most
    least = own.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_lf_least"))
    own = own.join(F.broadcast(least), "doc_id").filter(F.xxhash64("text") == F.col("_lf_least")).dropDuplicates(["doc_id"])
    got = _features(own, "y", "int").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (zlib.crc32(bytes(r[1]) + bytes(r[2])), bytes(r[1])))
    y = np.array([min(1, max(0, r[0])) for r in got], float)
    if not len(y) or y.min() == y.max():
        always = float(y.mean()) if len(y) else 1.0
        return Classifier(np.zeros(N_TEXT), np.zeros(N_META), np.array([0.0, 0.0, 6.0 if always >= 0.5 else -6.0]))
    return co_train(_stack([r[1] for r in got], N_TEXT), _stack([r[2] for r in got], N_META), y, unlabelled(docs, known))


def unlabelled(docs: DataFrame, known: DataFrame) -> Pool:
    """All of ``docs`` without a row in ``known``."""
    ids = known.select("doc_id")
    if fits(ids, BROADCAST_ROWS):
        rows = _features(docs.join(F.broadcast(ids), "doc_id", "left_anti").withColumn("_lf_h", F.xxhash64("doc_id")), "_lf_h", "long")
    else:  # features are shuffled, not texts
        rows = _features(docs, "doc_id", docs.schema["doc_id"].dataType.simpleString()).join(ids, "doc_id", "left_anti").withColumn("_lf_h", F.xxhash64("doc_id"))
    return Pool(materialise(rows.select(F.col("_lf_h").alias("h"), "t", "m"), "quality-pool"))


def score(df: DataFrame, model: Classifier, threshold: float = 0.5, rejected: bool = True) -> DataFrame:
    """``df`` with ``p_text``, ``p_meta``, ``p_good`` (rounded to 6 places) and ``kept``.

    ``df`` needs text, source, lang and n_chars, any of them null; a null text
    is an empty one. Columns of these four new names are replaced. With
    ``rejected`` false, only rows that are kept come out. A row whose unrounded
    probability is the threshold is kept; repeated rows come out alike, as often
    as they came; an empty table gives an empty result; texts of any length are
    scored whole.
    """
    names = ["p_text", "p_meta", "p_good", "kept"]
    base = [c for c in df.columns if c not in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        logistic = lambda z: np.round(1 / (1 + np.exp(-z)), 6)
        for whole in batches:
            for batch in slices(whole):
                text, *meta = (batch.column(len(base) + k) for k in range(4))
                a, b = model.views(np.array([text_features(t.as_py() or "") for t in text], np.float64), np.array([meta_features(*v) for v in zip(*(c.to_pylist() for c in meta), strict=True)], np.float64))
                p = model.combined(a, b)
                kept = pa.array(p >= threshold)
                out = pa.RecordBatch.from_arrays([*batch.columns[: len(base)], pa.array(logistic(a)), pa.array(logistic(b)), pa.array(np.round(p, 6)), kept], [*base, *names])
                yield out if rejected else out.filter(kept)
            pa.default_memory_pool().release_unused()

    inputs = [c.alias(f"_lf_{k}") for k, c in enumerate(_inputs())]
    schema = T.StructType([*(df.schema[c] for c in base), *(T.StructField(n, T.DoubleType()) for n in names[:3]), T.StructField("kept", T.BooleanType())])
    return in_batches(df.select(*base, *inputs), work, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", "p_text", "p_meta", "p_good", "kept")
