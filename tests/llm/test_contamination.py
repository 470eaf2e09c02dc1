import random

from loomframe.llm import contamination


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def of_item(text):
    n = min(5, len((text or "").split()))
    return n, shingles(text, n) if n else set()


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice((3, 5, 9, 20, 60, 200))))) for i in range(25)] + [(90, None), (91, ""), (7, "a b c d e"), (92, "z z z z z z z z"), (93, "Z z"), (94, "tail")]
    docs = [(0, None, 1), (1, "", 1), (2, "A B\tc d\ne tail", 1), (3, "z z z z z", 1)]
    for i in range(10, 60):
        w = [word() for _ in range(r.choice((5, 50, 3000)))]
        for _ in range(3):
            at, part = r.randrange(len(w)), r.choice(items)[1] or ""
            part = part.split()
            for _ in range(r.choice((0, 0, 1, 3))):
                if part:
                    part[r.randrange(len(part))] = word()
            w[at:at] = part
        docs.append((i, " ".join(w), 1))
    docs += [docs[-1], (None, items[3][1] + " x", 2)]
    want = set()
    best = {}
    for d, t, _ in docs:
        for i, u in items:
            n, s = of_item(u)
            if s and (k := len(s & shingles(t, n))) >= 0.8 * len(s):
                best[d, i] = max(best.get((d, i), (0,)), (round(k / len(s), 6), len(s), k))
    want = {(d, i, n, k, c) for (d, i), (c, n, k) in best.items()}
    got = contamination.find_items(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(want) > 30
    assert {tuple(x) for x in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination.find_items(docs.limit(0), items).count() == 0
    assert contamination.find_items(docs, items.limit(0)).count() == 0
    assert contamination.find_items(docs, items).collect()[0].containment == 1.0


def test_long_texts_and_what_stays(spark):
    """A short item inside 200,000 words, one of many items with the same sketch; copies, nulls and clashing columns."""
    r = random.Random(5)
    long = [f"w{r.randrange(5000)}" for _ in range(200_000)]
    item = [f"q{k}" for k in range(40)]
    long[123_456:123_456] = item[:34] + ["other"] + item[35:]  # 31 of 36 shingles
    docs = [(1, " ".join(long), 0, 1), (2, "clean text of some words here", 0, 1), (2, "clean text of some words here", 0, 1), (3, None, 0, 1), (4, "", 0, 1), (None, "also clean words", 0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, hash int, item_id int")
    items = spark.createDataFrame([(1, " ".join(item), 5), (2, " ".join(item), 6)], "item_id long, text string, part int")
    found = contamination.find_items(df, items).collect()
    assert sorted((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in found) == [(1, 1, 36, 31), (1, 2, 36, 31)]
    kept = contamination.without_items(df, items)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter("doc_id > 1 OR doc_id IS NULL").collect()))


def test_index_has_partitions(spark):
    items = spark.createDataFrame([(n, " ".join(f"{n}x{k}" for k in range(n))) for n in (1, 4, 5, 6, 9, 30, 31, 300)], "item_id long, text string")
    tests = contamination.test_items(items)
    rows = contamination.sketches(tests, 0.8).groupBy("part", "item_key", "need", "hits").count().join(tests.selectExpr("item_key", "size(hashes) AS n"), "item_key").collect()
    assert len({x.part for x in rows}) == 5
    for x in rows:
        assert 2**x.part <= x.n < 2 ** (x["part"] + 1)
        # of the sketch's hashes, no more than the item's lacking shingles can be missing
        assert x.hits == x["count"] - (x.n - x.need) >= 1
