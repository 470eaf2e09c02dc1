import random

import numpy as np
import pytest

from loomframe.llm import anchored, substrings, suffixes


def brute_words(rows, w):
    words = [(t or "").encode().split() for _, t in rows]
    order = [2**63 - 1 if d is None else d for d, _ in rows]
    first = {}
    for d, x in zip(order, words):
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), o, x in zip(rows, order, words):
        gone = {j for i in range(len(x) - w + 1) if first[tuple(x[i : i + w])] < o for j in range(i, i + w)}
        out.append((str(d), len(x), len(gone), b" ".join(v for j, v in enumerate(x) if j not in gone)))
    return sorted(out)


def brute_bytes(rows, w):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for x in raw:
        for i in range(len(x) - w + 1):
            seen[x[i : i + w]] = seen.get(x[i : i + w], 0) + 1
    out = []
    for (d, _), x in zip(rows, raw):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - w + 1):
            if seen[x[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((str(d), len(x), int(gone.sum()), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out)


def corpus(seed, word, size):
    r = random.Random(seed)
    base = [[word(r) for _ in range(r.randint(1, size))] for _ in range(12)]
    rows = []
    for i in range(50):
        x = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            x += b[a : a + r.randint(1, size)] + [word(r) for _ in range(r.randint(0, 5))]
        rows.append((r.choice((i, i, i, 7)), " ".join(x)))
    rows += [rows[3], rows[3], (200, rows[5][1]), (201, rows[5][1]), (None, rows[6][1]), (None, None), (300, ""), (301, "é " * 3), (302, "x"), (303, "same " * 90), (304, "same " * 70)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchored, "HOT", hot)
    rows = corpus(1, lambda r: r.choice("abcdefghijé") * r.randint(1, 2), 60)
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, anchor string")
    got = sorted((str(x.doc_id), x.n, x.n_removed, bytes(x.kept)) for x in substrings.remove_repeated_words(df).collect())
    assert got == brute_words(rows, 13)
    assert sum(x[2] for x in got) > 500


@pytest.mark.parametrize("hot", [20_000, 1])
def test_bytes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchored, "HOT", hot)
    rows = corpus(2, lambda r: "".join(r.choices("abé", k=r.randint(1, 9))), 90)
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, anchor string")
    got = sorted((str(x.doc_id), x.n, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.remove_repeated_bytes(df).collect())
    assert got == brute_bytes(rows, 200)
    assert sum(x[2] for x in got) > 2000


def test_long_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(anchored, "PIECE", 512)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(1500))) for i in range(3)]
    rows += [(5, rows[0][1][100:1900] + " tail"), (6, "x " + rows[1][1][:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n, x.n_removed, bytes(x.kept)) for x in substrings.remove_repeated_words(df).collect())
    assert got == brute_words(rows, 13)
    got = sorted((str(x.doc_id), x.n, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.remove_repeated_bytes(df).collect())
    assert got == brute_bytes(rows, 200)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeated_words(df).count() == 0
    assert suffixes.remove_repeated_bytes(df).count() == 0


def test_maximal_repeats_against_pairs():
    r = random.Random(3)
    for _ in range(300):
        m = r.randint(2, 9)
        left = [bytes(r.choices(b"ab", k=r.randint(0, 6))) for _ in range(m)]
        right = [b"Q" + bytes(r.choices(b"ab", k=r.randint(0, 6))) for _ in range(m)]
        cover = [set() for _ in range(m)]
        for i, a, q in suffixes.maximal_repeats(left, right, 5):
            cover[i] |= set(range(5 - q, a + 1))
        for i in range(m):
            want = set()
            for j in range(m):
                if i != j:
                    want |= set(range(5 - suffixes.common(right[i], right[j]), suffixes.common(left[i], left[j]) + 1))
            assert {x for x in cover[i]} == want


def test_index_counts_like_a_scan():
    r = np.random.default_rng(5)
    text = r.integers(0, 5, 400)
    text[-1] = 0
    index = substrings.FMIndex(text, 4)
    starts = np.array([s for s in range(390) if (text[s : s + 4] > 0).all()])
    size, lo, hi = index.match(text, starts, 4)
    for s, k, a, b in zip(starts, size, lo, hi):
        same = [t for t in range(len(text) - 3) if (text[t : t + 4] == text[s : s + 4]).all()]
        if k == 4 and b - a > 1:
            assert sorted(index.suffixes[a:b].tolist()) == same
        else:
            assert len(same) == 1
