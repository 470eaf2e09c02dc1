"""TriMeans of permuted groups: as of entries repeated for each round, without repeating them."""

import random

from loomframe.operators import matrix, network


def _tables(spark, whole):
    r = random.Random(2)
    cells = [(c, "abc"[c % 3]) for c in range(50)]
    long = [(c, g, float(r.randint(1, 4)) if whole else r.random()) for c, _ in cells for g in range(5) if r.random() < 0.7]
    return spark.createDataFrame(long, "cell_id long, gene_id long, x double"), spark.createDataFrame(cells, "cell_id long, g string")


def _rows(df):
    return sorted((r["round"], r["g"], r["gene_id"], r["trimean"]) for r in df.collect())


def test_equal_to_trimeans_of_repeated_entries(spark, monkeypatch):
    for whole, most in ((True, 20_000), (False, 3)):
        monkeypatch.setattr(network, "MOST_COUNTED", most)
        long, cells = _tables(spark, whole)
        want = matrix.trimean(long, network.permuted_groups(cells, "g", 7), "g", by=["round"])
        assert _rows(network.permuted_trimeans(long, cells, "g", 7)) == _rows(want)


def test_entries_are_not_repeated_for_each_round(spark, monkeypatch):
    long, cells = _tables(spark, True)
    pairs = spark.createDataFrame([(0, 1, "p")], "ligand long, receptor long, pathway string")
    asked, plain = [], matrix.trimean
    monkeypatch.setattr(matrix, "trimean", lambda *a, **k: asked.append(k.get("by")) or plain(*a, **k))
    assert network.significance(long, cells, pairs, "g", 5).count() >= 0
    assert asked == [None]


def test_no_row_for_each_cell_and_round_and_no_broadcast_of_groups(spark, monkeypatch):
    """Groups of many cells take little in their file and much in a broadcast, so entries meet them sorted by cell."""
    from loomframe.functions import shared
    from loomframe.operators import orderstats

    plans, cut = [], shared.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    def refused(*_):
        raise AssertionError("digests became rows")

    monkeypatch.setattr(shared, "cut", seen)
    monkeypatch.setattr(orderstats, "kth", refused)
    long, cells = _tables(spark, True)
    assert network.permuted_trimeans(long, cells, "g", 7).count() > 0
    joined = [p for p in plans if "Join" in p and "gene_id" in p]
    assert joined and all("SortMergeJoin" in p and "Broadcast" not in p for p in joined)
