import hashlib
import math
import random

import numpy as np

from loomframe.llm import vectorcodes


def brute(rows, parts, entries, rounds):
    """Rows (id, label, whole components) in order of id; plain Python integers."""
    width = len(rows[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((far(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            found = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, i in zip(cut, found, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(r[0], r[1], bytes(i for _, i in f), sum(d for d, _ in f)) for r, f in zip(rows, last, strict=True)], hashlib.sha256(text.encode()).hexdigest()


def coded(df, **kw):
    rows = vectorcodes.whole_rows(df)
    blocks, books = vectorcodes.fit(rows, **kw)
    return blocks, books, sorted(((r.id, r.label, bytes(r.code), r.error) for r in vectorcodes.codes(blocks, books).collect()), key=str)


def test_against_integers_by_hand(spark):
    r = random.Random(3)
    rows = [(i, r.choice((None, 1, 2)), [r.choice((-1, 1)) * r.random() * (3 if i % 7 else 0.001) for _ in range(12)]) for i in range(160)]
    rows += [(900 + i, 5, list(rows[3][2])) for i in range(40)]  # equal vectors
    r.shuffle(rows)
    bad = [(-1, 1, None), (-2, 1, []), (-3, 1, [None] * 12), (-4, 1, [math.nan] + [0.0] * 11), (-5, 1, [math.inf] + [0.0] * 11), (950, 1, [0.5] * 3)]
    df = spark.createDataFrame([(*x, b"", 1) for x in rows + bad], "vec_id long, label int, embedding array<float>, block binary, n int").repartition(5)
    whole = sorted((i, la, [math.floor(256 * float(np.float32(x))) for x in v]) for i, la, v in ((a, -1 if b is None else b, c) for a, b, c in rows))
    want, sha = brute(whole, 4, 8, 2)
    _, books, got = coded(df, parts=4, entries=8, rounds=2)
    assert got == sorted(((i, None if la == -1 else la, c, e) for i, la, c, e in want), key=str)
    assert vectorcodes.digest(books) == sha


def test_edges(spark):
    kind = "vec_id long, label string, embedding array<double>"
    _, books, got = coded(spark.createDataFrame([], kind))
    assert got == [] and books.size == 0
    # a length that parts don't divide, huge components, a null id, repeated ids and rows
    rows = [(7, "a", [1e300, -1e300, 0.1, 0.2, 0.3]), (7, "a", [1e300, -1e300, 0.1, 0.2, 0.3]), (7, None, [0.0, 1.0, -0.001, 2.0, 3.0]), (None, "a", [5.0, 5.0, 5.0, 5.0, 5.0])]
    blocks, books, got = coded(spark.createDataFrame(rows, kind), parts=4, entries=8, rounds=1)
    assert books.shape == (4, 4, 2) and len(got) == 4 and all(e == 0 for *_, e in got)
    back = vectorcodes.decoded(vectorcodes.codes(blocks, books), books).collect()
    assert sorted(tuple(b.vec) for b in back if b.id is None) == [(5.0, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0)]
    assert [b.vec[:3] for b in back if b.label is None] == [[0.0, 1.0, -1 / 256]]


def test_blocks_of_any_size_agree(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(r.normal(size=(300, 32)))], "vec_id long, label int, embedding array<double>")
    _, books, got = coded(df.repartition(1))
    monkeypatch.setattr(vectorcodes, "BLOCK", 7)
    _, others, again = coded(df.repartition(9))
    assert got == again and np.array_equal(books, others)
