"""Secrets: three patterns, and strings that look random to character Markov models.

Two first-order Markov models over the characters of tokens, one of random
strings and one of ordinary identifiers, are compared by log-likelihood ratio.
Labelled samples train them. Random: strings drawn from a fixed seed over the
usual alphabets, and every secret that the patterns find in the corpus.
Ordinary: the names that Python's standard library defines, decimal numbers, and
the tokens of the corpus, without the patterns' secrets and without the doubtful ones, which
are long and mix letters and digits. Both are counts of character pairs, so what
is gathered is bounded by the alphabet, while every document is counted.

Every token, short or long, of whatever characters, is scored. It is a secret of
kind ``markov`` when its ratio outweighs the odds against secrets (by the share
of the patterns' secrets among the corpus's tokens) and exceeds what all but
``max_false`` of the ordinary names that were held out of the training reach. So
the evidence alone decides how short a secret may be. A token that overlaps a
pattern's secret adds nothing.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import in_batches, release_memory, ships, slices, table

ships(__name__)

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class 0 is any other character: the border of a token.
K = len(ALPHABET) + 1
DRAWN = 4000
NUMBERS = 2000
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _either(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_ASSIGN = re.compile(f"({_either('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LUT = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _LUT[ord(_c)] = _i + 1


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[re.Match]]:
    """The patterns' spans (start, kind, stop) in order, and all long tokens.

    Secrets of kinds access and hex are 20 or 24 characters at least, so they
    lie inside long tokens.
    """
    found, long = [], list(_LONG.finditer(text))
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for t in long:
        at, token = t.start(), t[0]
        if "AKIA" in token:
            found += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(token) if len(m[0]) >= 20]
        if len(token) >= 24:
            found += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(token) if len(m[0]) >= 24]
    return sorted(found), long


def _mixed(token: str) -> bool:
    return bool(re.search("[0-9]", token) and re.search("[A-Za-z]", token))


def _codes(text: str) -> np.ndarray:
    return _LUT[np.frombuffer(text.encode(), np.uint8)]


def _pairs(text: str) -> np.ndarray:
    """Counts of the pairs of characters in ``text``; tokens are parted by any other character."""
    codes = _codes(text)
    return np.bincount(codes[:-1] * K + codes[1:], minlength=K * K) if len(codes) > 1 else np.zeros(K * K, np.int64)


def token_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and after the last byte of each token."""
    edge = np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass(frozen=True)
class Counts:
    """Of the corpus: pairs of characters in the patterns' secrets and in ordinary tokens, numbers of secrets and tokens."""

    secret: np.ndarray
    ordinary: np.ndarray
    secrets: int
    tokens: int


def gather(df: DataFrame, text_col: str = "text") -> Counts:
    """Counts over all documents; numbers only reach the driver, some ``K * K`` of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        secret, rest, secrets, tokens = np.zeros(K * K, np.int64), np.zeros(K * K, np.int64), 0, 0
        for whole in batches:
            for batch in slices(whole):
                texts = [t for t in batch.column(0).to_pylist() if t]
                values, doubtful = [], []
                for t in texts:
                    base, long = base_spans(t)
                    values += [t[a:b] for a, _, b in base]
                    doubtful += [m[0] for m in long if _mixed(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base)]
                everything = "\n".join(texts)
                own = _pairs("\n".join(values))
                secret += own
                rest += np.maximum(_pairs(everything) - own - _pairs("\n".join(doubtful)), 0)
                secrets += len(values)
                tokens += len(token_bounds(_codes(everything))[0])
        at = np.flatnonzero(secret + rest)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(secret[at], secrets)), pa.array(np.append(rest[at], tokens))], ["pair", "secret", "rest"])

    out, totals = np.zeros((2, K * K), np.int64), (0, 0)
    for pair, secret, rest in in_batches(df.select(F.col(text_col).cast("string")), work, "pair int, secret long, rest long").groupBy("pair").agg(F.sum("secret"), F.sum("rest")).collect():
        if pair < 0:
            totals = (secret, rest)
        else:
            out[:, pair] = secret, rest
    return Counts(out[0], out[1], *totals)


def drawn(n: int = DRAWN, seed: int = 11) -> list[str]:
    """The random sample: ``n`` strings of 8 to 48 characters over the alphabets that keys are written in."""
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:64])
    return ["".join(r.choices(r.choice(alphabets), k=r.randint(8, 48))) for _ in range(n)]


def identifiers() -> list[str]:
    """The ordinary sample: names that Python's standard library defines, those with digits included, and ``NUMBERS`` decimal numbers of 2 to 19 digits, from a fixed seed."""
    import builtins
    import encodings.aliases
    import errno
    import html.entities
    import importlib
    import keyword

    names = {*keyword.kwlist, *dir(builtins), *encodings.aliases.aliases, *encodings.aliases.aliases.values(), *errno.errorcode.values(), *html.entities.name2codepoint, *(x.rstrip(";") for x in html.entities.html5)}
    for module in ("ast", "asyncio", "base64", "codecs", "collections", "datetime", "decimal", "email.message", "functools", "hashlib", "http.client", "inspect", "itertools", "json", "logging", "math", "os", "pickle", "random", "re", "shutil", "socket", "sqlite3", "ssl", "stat", "statistics", "string", "struct", "subprocess", "tarfile", "threading", "time", "tokenize", "typing", "unittest", "urllib.parse", "uuid", "xml.etree.ElementTree", "zipfile"):
        try:
            names |= set(dir(importlib.import_module(module)))
        except ImportError:  # left out of some builds
            continue
    r = random.Random(13)
    return sorted(names) + ["".join(r.choices("0123456789", k=r.randint(2, 19))) for _ in range(NUMBERS)]


@dataclass(frozen=True)
class Detector:
    """``scores``: log-likelihood ratio of each pair of characters, random against ordinary; ``least``: the ratio of a secret."""

    scores: np.ndarray
    least: float

    def ratios(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and ratio of each token."""
        codes = _codes(text)
        start, stop = token_bounds(codes)
        upto = np.concatenate(([0.0], np.cumsum(self.scores[codes[:-1], codes[1:]]))) if len(codes) else np.zeros(1)
        return start, stop, upto[stop - 1] - upto[start] if len(start) else np.zeros(0)


def train(counts: Counts, random_sample: Iterable[str] | None = None, ordinary_sample: Iterable[str] | None = None, max_false: float = 0.001) -> Detector:
    """The detector; every fourth ordinary name is held out to set its threshold.

    The corpus and the names weigh the same in the ordinary model, and the
    patterns' secrets no more than the drawn strings in the random one.
    """
    given = lambda n: (n.reshape(K, K) + 0.5) / (n.reshape(K, K).sum(1, keepdims=True) + 0.5 * K)
    of = lambda tokens: _pairs("\n".join(tokens))
    drawn_pairs = of(drawn() if random_sample is None else random_sample)
    names = list(identifiers() if ordinary_sample is None else ordinary_sample)
    held = names[3::4]
    known = of([x for k, x in enumerate(names) if k % 4 != 3])
    chance = given(drawn_pairs + counts.secret * min(1.0, drawn_pairs.sum() / max(1, counts.secret.sum())))
    scores = np.log(chance) - np.log(given(known + counts.ordinary * (known.sum() / max(1, counts.ordinary.sum()))))
    scores[0], scores[:, 0] = 0, 0
    odds = np.log((counts.tokens + 1) / (counts.secrets + 1))
    reached = np.sort([Detector(scores, 0.0).ratios(x)[2].max(initial=0) for x in held])[::-1]
    return Detector(scores, float(max(odds, reached[int(max_false * len(reached))] if len(reached) else 0)))


def find_secrets(df: DataFrame, detector: Detector, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``base`` and ``added``: spans (start, kind, stop), kinds as places in ``KINDS``.

    One row for each row of ``df``, repeated rows too; a null text is an empty
    one; an empty table gives an empty result; texts of any length are scanned
    whole, in time that grows with them. Spans of different patterns may
    overlap and are all given, by start, then kind; added ones overlap none.
    Only the two named columns of ``df`` matter.
    """
    kind = df.schema[id_col].dataType.simpleString()
    scores, least = detector.scores, detector.least

    def spans(text: str) -> tuple[list, list]:
        base = base_spans(text)[0]
        start, stop, ratio = Detector(scores, least).ratios(text)
        hit = np.flatnonzero(ratio >= least)
        if not len(hit):
            return base, []
        start, stop = start[hit], stop[hit]
        if not text.isascii():  # code points, not bytes
            begins = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            start, stop = begins[start] - 1, begins[stop - 1]
        if base:  # the furthest end of the base spans that begin before a token's end
            ends = np.maximum.accumulate([b for _, _, b in base])
            before = np.searchsorted([a for a, _, _ in base], stop)
            free = (before == 0) | (ends[before - 1] <= start)
            start, stop = start[free], stop[free]
        return base, [(a, 3, b) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]

    def listed(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = np.array([x for r in rows for x in r], np.int32).reshape(-1, 3)
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "kind", "stop"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for whole in batches:
            for batch in slices(whole):
                found = [spans(t.as_py() or "") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), listed([b for b, _ in found]), listed([a for _, a in found])], ["doc_id", "base", "added"])

    return in_batches(df.select(F.col(id_col), F.col(text_col).cast("string")), work, f"doc_id {kind}, base {_SPANS}, added {_SPANS}")


def told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(gather(docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "added"))).alias("spans"))
