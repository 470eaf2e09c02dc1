import random

import pytest

from loomframe.llm import common, pieces

tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")
ENCODER = pieces.Encoder(pieces.read_model(tokenizers.path("piece_bpe_32k.model")))


def test_trees_tell_what_merges_tell():
    r, tokens = random.Random(7), [p for i, p in ENCODER.text.items() if i < 2**32]
    short = [p for p in tokens if len(p) <= 3]
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(3000)] + [(r.choice(short), r.choice(short)) for _ in range(6000)] + [(p, p) for p in tokens[::10]]
    pairs += [(p[:k], p[k:]) for p in tokens[::5] for k in range(1, len(p)) if p[:k] in ENCODER.ids and p[k:] in ENCODER.ids]
    told = [(ENCODER._apart(a, b), ENCODER.merged(a + b) == [a, b]) for a, b in pairs]
    assert all(x == y for x, y in told if x is not None)
    assert sum(x is None for x, _ in told) < len(told) / 20 and {x for x, _ in told} >= {True, False}


def test_memo_keeps_what_is_asked_for():
    """A key that is asked for again and again is made once, however many others pass; what is held stays bounded."""
    made = []
    memo = common.Memo(lambda k: made.append(k) or k, 100, lambda k, v: 10)
    for k in range(200):
        assert memo["often"] == "often" and memo[k] == k
        assert len(memo) + len(memo.older) <= 10
    assert made.count("often") == 1
