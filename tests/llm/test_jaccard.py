import random

import numpy as np

from loomframe.llm import components, jaccard


def sets_of(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=90):
    sets, best = [sets_of(t) for _, t in rows], list(range(len(rows)))

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
        out.append((str(d), len(sets[i]), str(min(ids) if ids else None) if sets[i] else str(d)))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for _ in range(14):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice((2, 6, 12, 30, 80, 200, 400)))]
        for _ in range(r.randint(1, 12)):
            x = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12)) * max(1, len(x) // 200)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = [f"w{r.randrange(4000)}"] * r.randint(0, 1) or x[at : at + 1]
            if r.random() < 0.3:
                base = x
            rows.append((r.randrange(10_000), (" " if r.random() < 0.5 else "\n").join(x)))
    rows += [(9, None), (8, ""), (7, " \t"), (6, "One"), (5, "oNE"), (4, "one two"), (3, "one two"), (2, "É x y z"), (1, "é x y z"), rows[0], (None, rows[0][1]), (None, "only this text here"), (rows[3][0], "same id other text")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.jaccard_components(df).collect())
    assert got == brute(rows)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_share_a_list():
    r = np.random.default_rng(1)
    for percent, n in ((p, n) for p in (80, 90) for n in [*range(1, 60), 100, 333, 2000]):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for drop, add in ((0, 0), (1, 0), (0, 1), (n // 20, n // 20), (n // 10, 0), (0, n // 9), (n // 30, n // 20), (n // 5, 0), (n // 9, n // 9), (1, n // 5)):
            b = np.unique(np.concatenate((a[drop:], r.integers(0, 2**63, add).astype(np.uint64))))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                assert set(np.concatenate(jaccard.lists_of(a, percent)).tolist()) & set(np.concatenate(jaccard.lists_of(b, percent)).tolist())
                far = int(np.bitwise_count((jaccard.odd_sketch(a) ^ jaccard.odd_sketch(b)).view(np.uint64)).sum())
                assert far <= len(a) + len(b) - 2 * shared <= jaccard.most_different(len(a), len(b), percent)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, 5), (41, 40)]
    best = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in best.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(n)) for n in (3, 40, 90)]
    rows = [(9, base[1]), (4, base[1] + " end"), (4, base[1] + " end"), (6, base[2]), (None, base[2]), (7, base[0]), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, key string")
    got = sorted((str(x.doc_id), x.text) for x in jaccard.one_of_each(df).collect())
    assert [g[0] for g in got] == ["2", "3", "3", "4", "6", "7"]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_pairs_in_one_component_are_not_compared_and_equal_lists_are_one(spark, monkeypatch):
    """A crowd of near copies of one text: each is compared with one first set, not with that of every list it shares."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join([*words[: 7 * i], f"x{i}", *words[7 * i + 1 :]])) for i in range(40)]
    seen = []
    whole = jaccard.verified

    def counted(pairs, items, percent):
        seen.append(pairs.count())
        return whole(pairs, items, percent)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}
    assert sum(seen) < 2 * len(rows)


def test_linked_pairs_are_alike(spark):
    r = random.Random(6)
    sets = [np.array(sorted({r.randrange(2**62) for _ in range(n)}), np.uint64) for n in (1, 9, 50, 200)]
    sets += [np.unique(np.append(x[: len(x) - len(x) // 20], np.uint64(5))) for x in sets]
    places = spark.createDataFrame([(i, len(x), jaccard.odd_sketch(x).tolist()) for i, x in enumerate(sets)], "node long, n long, sketch array<long>")
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a < b]
    got = {tuple(x) for x in jaccard.alike(spark.createDataFrame(pairs, "a long, b long"), places, 80).collect()}
    for a, b in pairs:
        shared = len(np.intersect1d(sets[a], sets[b]))
        linked = 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared)
        assert not linked or (a, b) in got
    assert 0 < len(got) < len(pairs)
