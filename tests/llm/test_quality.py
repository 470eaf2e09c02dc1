import random

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        words = [word() for _ in range(r.randint(30, 120))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if r.random() < 0.5 else " ".join(words[:2] * 40)
        rows.append((i, text, r.choice(("en", "de")), f"src{r.randrange(4) + (0 if good else 2)}", len(text), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(500, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (7, None), (labels[1][0], labels[1][1])], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.score(docs, quality.fit(docs, known)).collect()}
    right = [out[i] == bool(y) for i, y in labels if i % 2 == 0]
    assert sum(right) >= 0.95 * len(right)


def test_same_result_for_other_orders(spark):
    rows, labels = corpus(200, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = (quality.fit(spark.createDataFrame(x, SCHEMA), known) for x in (rows, rows[::-1]))
    assert np.allclose(a.text, b.text) and np.allclose(a.mix, b.mix)


def test_odd_rows(spark):
    rows, labels = corpus(60, 3)
    odd = [(None, None, None, None, None, None), (1, "", "", "", 0, None), (2, "x " * 100_000, "en", "src1", -5, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert quality.score(docs, model).count() == len(rows) + 5
    assert quality.score(docs.limit(0), model).count() == 0
    empty = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.kept for r in quality.score(docs, empty).collect()} == {True}
    assert quality.score(docs, model, rejected=False).filter("NOT kept").count() == 0


def test_pool_is_all_unlabelled_documents(spark, monkeypatch):
    rows, labels = corpus(300, 4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.unionByName(spark.range(1000, 6000).selectExpr("id AS doc_id", "'SPAM SPAM!!' AS text", "'en' AS lang", "'src1' AS source", "11L AS n_chars", "'' AS kept"))
    known = spark.createDataFrame(labels[:100], "doc_id long, quality int").groupBy("doc_id").agg(F.max("quality").alias("y"))
    pool = quality.unlabelled(docs, known)
    assert pool.n == 5200
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    other = quality.unlabelled(docs, known)
    rows = [tuple(r) for r in pool.rows.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in other.rows.collect())
    # what is lent, and its slope and curve, against the same on the driver
    h, x = np.array([r[0] for r in rows]), [quality._stack([r[k + 1] for r in rows], n) for k, n in enumerate((quality.N_TEXT, quality.N_META))]
    rng, lent = np.random.default_rng(1), [{}, {}]
    for again in range(2):
        w = [rng.normal(size=quality.N_TEXT) * 5, rng.normal(size=quality.N_META) * 5]
        pool.lend(w, {(k, label): 40 + 20 * label for k in range(2) for label in range(2)}, 0.6)
        for k in range(2):
            new = {}
            for label in range(2):
                z = np.round(np.clip(x[k] @ w[k], -30, 30) * 1e6).astype(int) * (1 if label else -1)
                order = [i for i in np.lexsort((-((h >> 29) & (2**35 - 1)), -z)) if i not in lent[1 - k] and z[i] >= round(np.log(0.6 / 0.4) * 1e6)]
                new |= dict.fromkeys(order[: 40 + 20 * label], label)
            lent[1 - k] |= new
    for k in range(2):
        i, y = list(lent[k]), np.array(list(lent[k].values()), float)
        assert pool.lent[k].count() == len(i) > 0
        a, b = pool.moments(k, w[k], 0.3)
        c, d = quality.moments(x[k][i], y, 0.3, w[k])
        assert np.allclose(a, c) and np.allclose(b, d)


class LocalPool:
    """The pool, in arrays on the driver: all rows are ranked at once, and what is lent stands in lists."""

    def __init__(self, h, text, meta):
        self.h, self.x, self.n = h, (text, meta), len(h)
        self.lent, self.rows = [None, None], [{}, {}]

    def lend(self, weights, most, sure):
        for k in range(2):
            new = {}
            for label in range(2):
                z = np.round(np.clip(self.x[k] @ weights[k], -30, 30) * 1e6).astype(int) * (1 if label else -1)
                order = [i for i in np.lexsort((-((self.h >> 29) & (2**35 - 1)), -z)) if i not in self.rows[1 - k] and z[i] >= round(np.log(sure / (1 - sure)) * 1e6)]
                new |= dict.fromkeys(order[: most[k, label]], label)
            self.rows[1 - k] |= new
            if self.rows[1 - k]:
                self.lent[1 - k] = True

    def moments(self, k, w, weight):
        i, y = list(self.rows[k]), np.array(list(self.rows[k].values()), float)
        return quality.moments(self.x[k][i], y, weight, w)


def test_against_brute_force(spark):
    """The whole classifier, fitted and applied without Spark, gives the same decisions."""
    rows, labels = corpus(400, 7)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels[:150], "doc_id long, quality int")
    text = {r[0]: quality.text_features(r[1]).astype(float) for r in rows}
    meta = {r[0]: quality.meta_features(r[3], r[2], r[4]).astype(float) for r in rows}
    y = dict(labels[:150])
    import zlib

    raw = lambda x, i: x[i].astype(np.float32).tobytes()
    order = sorted(y, key=lambda i: (zlib.crc32(raw(text, i) + raw(meta, i)), raw(text, i)))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rest = [r[0] for r in rows if r[0] not in y]
    pool = LocalPool(np.array([hashes[i] for i in rest]), np.array([text[i] for i in rest]), np.array([meta[i] for i in rest]))
    local = quality.co_train(np.array([text[i] for i in order]), np.array([meta[i] for i in order]), np.array([y[i] for i in order], float), pool)
    model = quality.fit(docs, known)
    assert np.allclose(model.text, local.text, atol=1e-3) and np.allclose(model.meta, local.meta, atol=1e-3) and np.allclose(model.mix, local.mix, atol=1e-3)
    a, b = local.views(np.array([text[r[0]] for r in rows]), np.array([meta[r[0]] for r in rows]))
    p = dict(zip((r[0] for r in rows), local.combined(a, b), strict=True))
    for r in quality.score(docs, model).collect():
        assert abs(r.p_good - p[r.doc_id]) < 1e-3
        assert r.kept == (p[r.doc_id] >= 0.5) or abs(p[r.doc_id] - 0.5) < 1e-3
