import random

import numpy as np
import pytest

from loomframe.llm import superminhash as sm


def sets_of(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent, size):
    sets, best = [sets_of(t, size) for _, t in rows], list(range(len(rows)))

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                best[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else d
        out.append((str(d), len(sets[i]), str(c), d == c))
    return sorted(out)


def plain(hashes, m):
    """SuperMinHash with one whole shuffle for each element."""
    best = [m << 40] * m
    for e in hashes.tolist():
        order = list(range(m))
        for rank in range(m):
            x = int(sm._mix(np.array([e + (rank + 1) * int(sm._BASES[0]) & 2**64 - 1], np.uint64))[0])
            pick = rank + ((x & (1 << 24) - 1) * (m - rank) >> 24)
            order[rank], order[pick] = order[pick], order[rank]
            best[order[rank]] = min(best[order[rank]], rank << 40 | x >> 24)
    return best


def test_signatures_are_those_without_stopping(monkeypatch):
    r = np.random.default_rng(0)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 3, 100, 64)]
    want = [plain(s, 24) for s in sets]
    for at_once in (8192, 50, 7):
        monkeypatch.setattr(sm, "AT_ONCE", at_once)
        assert sm.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 24).tolist() == want


def test_estimates_vary_less_than_independent_draws():
    r, n, m = np.random.default_rng(1), 50, 240
    for share in (0.5, 0.8):
        both = int(2 * n * share / (1 + share))
        true, found = both / (2 * n - both), []
        for _ in range(120):
            x = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            s = sm.signatures(np.concatenate((x[:n], x[n - both :])), np.array([n, n]), m)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - true) < 0.01
        assert np.var(found) < 0.75 * true * (1 - true) / m


def test_linked_sets_share_a_bucket():
    r = np.random.default_rng(2)
    for n in [*range(1, 40), 100, 400]:
        both = -(-8 * n // 9)  # the least overlap at 0.8
        x = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        if 100 * both >= 80 * len(x):
            b = sm.buckets(sm.signatures(np.concatenate((x[:n], x[n - both :])), np.array([n, n]), sm.BANDS * sm.ROWS), sm.BANDS)
            assert (b[0] == b[1]).any()


@pytest.mark.parametrize(("hub", "size"), [(sm.HUB, 2), (3, 2), (sm.HUB, 5)])
def test_against_brute_force(spark, monkeypatch, hub, size):
    """Also where sets with more than three pairs, and buckets, are dealt to several tasks."""
    monkeypatch.setattr(sm, "HUB", hub)
    r = random.Random(hub + size)
    rows = []
    for _ in range(16):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice((1, 2, 6, 12, 30, 80, 300)))]
        for _ in range(r.randint(1, 12)):
            x = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12)) * max(1, len(x) // 100)):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randint(0, 1)] = [f"w{r.randrange(4000)}"] * r.randint(0, 1) or x[at : at + 1]
            if r.random() < 0.3:
                base = x
            rows.append((r.randrange(10_000), (" " if r.random() < 0.5 else "\n").join(x)))
    shell = [f"t{i}" for i in range(60)]  # alike, but mostly not linked
    rows += [(20_000 + k, " ".join(shell + [f"own{k // 2}x{j}" for j in range(12 + k % 2)])) for k in range(30)]
    rows += [(9, None), (8, ""), (7, " \t"), (6, "One"), (5, "oNE"), (4, "one two"), (3, "one two"), (2, "É x y z"), (1, "é x y z"), rows[0], (None, rows[0][1]), (None, "only this text here"), (rows[3][0], "same id other text")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "l") for x in rows], "doc_id long, text string, node int, list string")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in sm.near_duplicates(df, size=size).collect())
    assert got == brute(rows, 80, size)


def test_empty_table_and_long_texts(spark):
    kind = "doc_id long, text string"
    assert sm.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    long = [f"w{i}" for i in range(60_000)]
    df = spark.createDataFrame([(3, " ".join(long)), (2, " ".join(long[3000:])), (1, " ".join(long[:40_000]))], kind)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in sm.near_duplicates(df, size=2).collect()}
    assert got == {3: (59_999, 2, False), 2: (56_999, 2, True), 1: (39_999, 1, True)}
