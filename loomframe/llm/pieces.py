"""Encoding and decoding with a SentencePiece merge-type (BPE) model.

Encoding is exact and doesn't run the merge queue over the text. A sequence of
tokens is the model's encoding if, and only if, each two neighbours merge back
to just themselves: a merge over a boundary would have been made in the pair
already. So the encoder takes the longest Aho-Corasick match at each position,
accepts it if it is compatible with the token before (told by the two trees of
merges along the boundary, with a memo), else tries the next shorter prefix, and steps back when none is
left. A bitfield of failed positions keeps that linear.

Nothing merges over two characters that stand together in no piece. White space
only begins pieces (checked when the model is read), so a text is encoded word
by word, and a word part by part, cut at such places; bounded memos hold words,
parts and pairs. Characters that no piece holds become byte pieces.

The model must have no text normalisation, a dummy prefix, kept white space
and byte fallback, as ``piece_bpe_32k.model`` has; tests hold the results
against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import Memo, in_batches, ships, slices, table, worker_cache

ships(__name__)

SPACE = "▁"
#: Bytes after which a worker's memo of words (a half), parts or pairs (a quarter each) starts anew.
MEMO_BYTES = 96_000_000
#: The same for ``op2_pieces``, whose executors hold nothing else: rare words are most of the work, and fewer are encoded again.
QUERY_MEMO_BYTES = 400_000_000


@dataclass(frozen=True)
class PieceTable:
    """A model's pieces; its size is bounded by the vocabulary."""

    pieces: list[str]
    scores: list[float]
    bytes_at: int
    unk: int
    eos: int
    special: tuple[int, ...]

    def digest(self) -> str:
        """Names the whole table, for workers' caches."""
        return hashlib.sha256(repr((self.pieces, self.scores, self.bytes_at, self.unk, self.eos, self.special)).encode()).hexdigest()


def read_model(path: str) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    first = next(i for i in range(n) if model.is_byte(i))
    assert all(model.is_byte(first + b) and pieces[first + b] == f"<0x{b:02X}>" for b in range(256)), "the model needs byte fallback"
    special = tuple(i for i in range(n) if model.is_control(i) or model.is_unknown(i))
    plain = [p for i, p in enumerate(pieces) if not model.is_byte(i) and i not in special]
    assert not any(SPACE in p.lstrip(SPACE) for p in plain), "white space must only begin pieces"
    assert not any(model.is_unused(i) for i in range(n)), "unused pieces aren't supported"
    return PieceTable(pieces, [model.get_score(i) for i in range(n)], first, model.unk_id(), model.eos_id(), special)


class Encoder:
    """Text to ids; ids of ``2 ** 32 + code point`` stand for characters without a piece."""

    def __init__(self, model: PieceTable, memo_bytes: int | None = None):
        import ahocorasick

        memo_bytes = memo_bytes or MEMO_BYTES
        self.model, lone = model, 2**32
        plain = [i for i in range(len(model.pieces)) if i not in model.special and not model.bytes_at <= i < model.bytes_at + 256]
        self.ids = {model.pieces[i]: i for i in plain}
        self.score = {model.pieces[i]: model.scores[i] for i in plain}
        for c in {c for p in self.ids for c in p} - self.ids.keys():
            self.ids[c] = lone + ord(c)
        self.text = {i: p for p, i in self.ids.items()}
        self.find = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.find.add_word(p, (len(p) - 1, i))
        self.find.make_automaton()
        self.together = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.size = {i: len(p) for p, i in self.ids.items()}
        self.tree = {}
        place = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: place[x] for p, x in self.score.items()}  # equal scores, equal ranks
        # a dict's slot and its key take about 100 bytes, each id of a tuple about 8
        listed = lambda key, value: 200 + 2 * len(key) + 8 * len(value)
        self.shorter = Memo(self._shorter, 1 << 62, lambda key, value: 0)  # at most one entry for each piece
        self.compatible = Memo(self._compatible, memo_bytes // 4, lambda key, value: 120)
        self.words = Memo(self._word, memo_bytes // 2, listed)
        self.parts = Memo(self._part, memo_bytes // 4, listed)

    def _shorter(self, token: int) -> int | None:
        p = self.text[token]
        return next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None)

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, pair: int) -> bool:
        """Of two tokens as ``(first + 1) << 34 | second``; without a first one, whether the second is made by merges at all."""
        first, second = pair >> 34, pair & (1 << 34) - 1
        b = self.text[second]
        if not first:
            return self.merged(b) == [b]
        a = self.text[first - 1]
        stays = self._apart(a, b)
        return self.merged(a + b) == [a, b] if stays is None else stays

    def _node(self, piece: str) -> tuple[int, str, str] | None:
        """The rank of a piece and what its last merge joins; -1 for a character, None if it isn't made by merges of ever later ranks."""
        if piece not in self.tree:
            node = None
            if len(piece) == 1:
                node = (-1, piece, piece)
            elif (last := self._last(piece)) is not None:
                parts = [self._node(p) for p in last]
                if None not in parts and all(p[0] < self.rank[piece] for p in parts):
                    node = (self.rank[piece], *last)
            self.tree[piece] = node
        return self.tree[piece]

    def _last(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joins to ``piece``, if merges make it."""
        parts, score = list(piece), self.score
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if piece in score else None

    def _apart(self, a: str, b: str) -> bool | None:
        """Whether no merge crosses the boundary of two pieces; None if their trees don't tell.

        From the end back, the later of the two symbols at the boundary is taken
        apart; they would have been joined if that has a better rank than what
        took them in. Of equal ranks the left one is first.
        """
        tree, rank = self.tree, self.rank
        x, y = (tree[a] if a in tree else self._node(a)), (tree[b] if b in tree else self._node(b))
        if x is None or y is None:
            return None
        limit = len(rank)
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                return False
            if x[0] > y[0]:
                limit, a = x[0], x[2]
                x = tree[a]
            elif y[0] >= 0:
                limit, b = y[0] + 1, y[1]
                y = tree[b]
            else:
                return True

    def run(self, text: str) -> list[int]:
        """Encodes characters that all have pieces."""
        n, tokens, at, last = len(text), [], 0, 0
        longest: list = [None] * n
        for end, (back, match) in self.find.iter(text):
            longest[end - back] = match  # later ends are longer matches
        failed, size, compatible, shorter = bytearray(n + 1), self.size, self.compatible, self.shorter
        token = longest[0]
        while at < n:
            end = at + size[token]
            if not failed[end] and compatible[last << 34 | token]:
                tokens.append(token)
                last, at = token + 1, end
                if at < n:
                    token = longest[at]
                continue
            less = shorter[token]
            while less is None:
                failed[at] = 1
                token = tokens.pop()
                last = tokens[-1] + 1 if tokens else 0
                at -= size[token]
                less = shorter[token]
            token = less
        return tokens

    def _part(self, part: str) -> tuple[int, ...]:
        whole = self.ids.get(part)
        if whole is None:
            if len(part) == 1:
                return tuple(self._bytes(part))
        elif whole < 2**32 and self.compatible[whole]:
            return (whole,)  # the longest match of all
        out: list[int] = []
        for t in self.run(part):
            out += [t] if t < 2**32 else self._bytes(chr(t - 2**32))
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        word, together = SPACE + word, self.together
        whole = self.ids.get(word)
        if whole is not None and whole < 2**32 and self.compatible[whole]:
            return (whole,)
        cuts = [k for k, pair in enumerate(map(add, word, word[1:]), 1) if pair not in together]
        if not cuts:
            return self._part(word)
        out, at = [], 0
        for k in (*cuts, len(word)):
            part, at = word[at:k], k
            out += self.parts[part] if len(part) <= 64 else self._part(part)
        return tuple(out)

    def _bytes(self, c: str) -> list[int]:
        return [self.model.bytes_at + b for b in c.encode()]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array([self.model.eos], np.int32)
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]+|{SPACE}+$", SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        small = [self.words[w] if len(w) <= 64 else self._word(w) for w in words] if len(max(words, key=len)) > 64 else map(self.words.__getitem__, words)
        return np.fromiter(chain(chain.from_iterable(small), (self.model.eos,)), np.int32)


class Decoder:
    """Ids to text, as the library's decode(ids)."""

    def __init__(self, model: PieceTable):
        self.model = model
        low, high = model.bytes_at, model.bytes_at + 256
        self.out = [b"" if i in model.special else bytes([i - low]) if low <= i < high else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        self.out[model.unk] = " ⁇ ".encode()
        self.hidden = set(model.special) - {model.unk}

    def decode(self, ids: list[int]) -> str:
        low, high = self.model.bytes_at, self.model.bytes_at + 256
        first = next((i for i in ids if i not in self.hidden), None)
        skip = first is not None and not low <= first < high and first != self.model.unk and self.model.pieces[first].startswith(SPACE)
        raw = b"".join(map(self.out.__getitem__, ids))
        try:
            return raw.decode()[skip:]
        except UnicodeDecodeError:
            return self._broken(ids)[skip:]

    def _broken(self, ids: list[int]) -> str:
        """Each byte that begins no character becomes U+FFFD."""
        low, high, out, run = self.model.bytes_at, self.model.bytes_at + 256, [], b""
        for i in [*ids, -1]:
            if low <= i < high:
                run += self.out[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                out.append(self.out[i].decode())
        return "".join(out)


def _per_text(df: DataFrame, source: str, kind: str, keep: list[str], new: dict[str, T.DataType], model: PieceTable, name: str, make: Callable, run: Callable) -> DataFrame:
    """``keep`` and the arrays that ``run(make(model), column)`` gives for column ``source``, slice by slice."""
    # broadcasts are pickled by reference: plain values only
    shared, name = df.sparkSession.sparkContext.broadcast(astuple(model)), f"{name}-{model.digest()}"
    taken = df.select(*keep, F.col(source).cast(kind).alias("_lf_in"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = worker_cache(name, lambda: make(PieceTable(*shared.value)))
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *run(tool, batch.column(len(keep)))], [*keep, *new])

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, t) for c, t in new.items())])
    return in_batches(taken, work, schema, keep=True)  # an encoder takes long to build and to warm


def _ids(encoder: Encoder, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    ids = [encoder.encode(t.as_py() or "") for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
    return ids, pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.zeros(0, np.int32))


def encode(df: DataFrame, model: PieceTable, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and ``ids_col``, an array of ints with an end id.

    A null text is encoded as an empty one: the end id alone. Rows keep their
    number; repeated rows give repeated results; an empty table gives an empty
    result; texts of any length are encoded whole. An existing ``ids_col`` is
    replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != ids_col]
    return _per_text(df, text_col, "string", keep, {ids_col: T.ArrayType(T.IntegerType())}, model, "encoder", Encoder, lambda tool, texts: [_ids(tool, texts)[1]])


def decode(df: DataFrame, model: PieceTable, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and ``text_col``; null or empty ids give an empty text."""
    keep = [c for c in (df.columns if keep is None else keep) if c != text_col]
    run = lambda tool, lists: [pa.array([tool.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists], pa.string())]
    return _per_text(df, ids_col, "array<int>", keep, {text_col: T.StringType()}, model, "decoder", Decoder, run)


def round_trip(df: DataFrame, model: PieceTable, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: list[str] | None = None, memo_bytes: int | None = None) -> DataFrame:
    """As ``encode`` and then ``decode`` of its ids, in one pass of one Python worker, whose memos hold ``memo_bytes``."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (ids_col, decoded_col)]

    def run(tool: tuple[Encoder, Decoder], texts: pa.Array) -> list[pa.Array]:
        ids, listed = _ids(tool[0], texts)
        return [listed, pa.array([tool[1].decode(x.tolist()) for x in ids], pa.string())]

    return _per_text(df, text_col, "string", keep, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()}, model, f"both-{memo_bytes}", lambda m: (Encoder(m, memo_bytes), Decoder(m)), run)


def encoded_digests(docs: DataFrame, model: PieceTable, memo_bytes: int | None = None) -> DataFrame:
    both = round_trip(docs.select("doc_id", "text"), model, keep=["doc_id"], memo_bytes=memo_bytes)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Every document encoded and decoded with ``piece_bpe_32k.model``."""
    import public_tokenizers

    return encoded_digests(table(spark, sf_dir, "documents"), read_model(model_path or public_tokenizers.path("piece_bpe_32k.model")), QUERY_MEMO_BYTES)
