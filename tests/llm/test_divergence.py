import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomframe.llm import divergence

KIND = "text string, lang string, source string, term string, n long, item string"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((la or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, groups = Counter(), defaultdict(Counter)
        for la, s, terms in docs:
            if la == lang:
                seen.update(set(terms))
                groups[s].update(terms)
        kept = [t for t, n in seen.items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        shares, whole = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        for s, own in shares.items():
            pairs = [("pair", o, sum(far(own[t], q[t]) for t in kept)) for o, q in shares.items() if o != s]
            terms = [("term", t, far(own[t], whole[t])) for t in kept if groups[s][t] > 0 and own[t] > whole[t]]
            for part, most in ((pairs, None), (terms, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part[:most])]
    return sorted(out)


def told(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("split", [divergence.SPLIT, 2])
def test_against_brute_force(spark, monkeypatch, split):
    """Also where every term is dealt out in blocks of sources."""
    monkeypatch.setattr(divergence, "SPLIT", split)
    r = random.Random(split)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "straße", "Ünï", "日本", "x y", "UPPER", "upper"]
    rows = []
    for _ in range(300):
        source = f"s{r.choice((0, 0, 0, 1, 2, 3, 4, 5))}"
        text = r.choice((" ", "-", "\t9\n", "\x00")).join(r.choice(words[: 8 + 3 * int(source[1])]) for _ in range(r.randint(0, 40)))
        rows.append((text, r.choice(("en", "en", "fr")), source))
    rows += [(None, "en", "s1"), ("", None, None), ("one two", None, "x"), ("...", "de", "é"), ("word", "de", "z"), ("word", "de", "Z"), ("only", "it", "one")] + [rows[0]] * 30
    df = spark.createDataFrame([(*x, "t", 1, "i") for x in rows], KIND)
    got = told(df, least=4, top=3)
    assert got == brute(rows, 4, 3)
    assert {g[2] for g in got} == {"pair", "term"}


def test_empty_table_and_no_kept_terms(spark):
    df = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y"), ("c", "en", "w")], "text string, lang string, source string")
    assert told(df.limit(0)) == []
    got = told(df)
    assert [g[4] for g in got] == [0] * 6 and [g[3] for g in got if g[1] == "x"] == ["w", "y"]


def test_long_text_and_exact_shares(spark):
    """Counts beyond 9e9, where the numerator passes a long; and a text of a million words."""
    n, kept = 10**13 + 7, 12
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n + 1), F.lit(kept)).alias("p"), divergence.far(F.lit(10**9 + 1).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 1 + 2 * kept) and row.f == (10**9 - 2) ** 2 // (10**9 + 4)
    text = " ".join(["ab", "cd", "ab"] * 350_000)
    rows = [(text, "en", "x"), ("cd ab cd", "en", "y"), ("zz", "en", "y")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert told(df, least=2) == brute(rows, 2, 10)
