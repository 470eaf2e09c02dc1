import random
import re

from loomframe.llm import rules


def facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_against_brute_force(spark):
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a a", "x " * 3000 + "é y", "one two three\n\none two three\r\none two three\n | # $ %", "ab\x0bcd\x0cef " * 7, "word " * 60]
    texts += [" ".join(f"w{(i * k) % 97}" for i in range(400)) for k in range(1, 30)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.score_rules(df.select("doc_id", "text")).collect())
    assert got == sorted((str(d), *facts(t)) for d, t, _ in rows)
    assert rules.score_rules(df.limit(0)).count() == 0


def test_windows_that_differ_in_long_texts(spark):
    # windows whose 64-bit hashes agree in their upper 43 bits
    windows = [" ".join(f"{c}{i}" for c in "abc") for i in (7769153, 8259772, 5619816, 8114174, 3252446, 5108195)]
    text = " ".join(x for w in windows for x in ("x " * 180_000, w)) + " x x x"
    out = rules.score_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.n_words == 6 * 180_003 + 3 and out.n_repeat_words == 6 * 180_000 + 3


def test_estimates_find_the_better_rule():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.8
        sure = (1 if good else -1) if r.random() < 0.97 else 0
        votes = (sure, sure if r.random() < 0.9 else -sure, (1 if good else -1) * (1 if r.random() < 0.6 else -1))
        counts[votes] = counts.get(votes, 0) + 1
    model = rules.fit(sorted(counts.items()), 3)
    assert abs(model.prior - 0.8) < 0.08
    assert model.accuracy(0) > model.accuracy(2)
    assert model.p_good((1, 1, 1)) > 0.9 and model.p_good((-1, -1, -1)) < 0.1
    assert rules.fit([], 3).p_good((1, 0, -1)) == 0.5


def test_telling_votes_outweigh_usual_ones():
    model = rules.fit([((1, 1, 1), 900), ((1, -1, -1), 60), ((0, -1, -1), 20), ((1, 0, -1), 20), ((0, 1, 1), 10)], 3)
    assert model.p_good((1, 1, 1)) > 0.9 and model.p_good((0, 1, 1)) > 0.5
    assert model.p_good((1, -1, -1)) < 0.5


#: The rules once more, on (words, characters, symbols, repeated lines, repeated words, lines, symbol runs, capitals, punctuation, different words).
VOTES = {
    "length": (lambda f: f.n_words < 8, lambda f: f.n_words >= 100),
    "word_length": (lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 12 * f.n_words, lambda f: 3 * f.n_words <= f.word_chars <= 8 * f.n_words),
    "symbols": (lambda f: f.n_symbols > 0.03 * f.word_chars, lambda f: f.n_symbols <= 0.005 * f.word_chars),
    "symbol_words": (lambda f: f.n_symbol_runs > 0.05 * f.n_words, lambda f: f.n_symbol_runs <= 0.01 * f.n_words),
    "duplicate_lines": (lambda f: f.n_dup_lines > 0.3 * f.n_lines, lambda f: f.n_dup_lines == 0 and f.n_lines > 1),
    "repetition": (lambda f: f.n_repeat_words > 0.2 * f.n_words, lambda f: f.n_repeat_words <= 0.05 * f.n_words),
    "upper_case": (lambda f: f.n_upper > 0.3 * f.word_chars, lambda f: f.n_upper <= 0.1 * f.word_chars),
    "punctuation": (lambda f: f.n_punctuation > 0.18 * f.word_chars, lambda f: f.n_punctuation > 0 and f.n_punctuation <= 0.08 * f.word_chars),
    "variety": (lambda f: f.n_words >= 20 and f.n_distinct < 0.15 * f.n_words, lambda f: f.n_words >= 20 and f.n_distinct >= 0.3 * f.n_words),
}


def test_verdicts_against_brute_force(spark):
    """Votes, posterior and verdict of every document, from the rules and the model by hand."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 9)))
    rows = []
    for i in range(150):
        words = [word() for _ in range(r.choice((3, 30, 150)))]
        text = {0: " ".join(words).upper().replace(" ", "!! "), 1: "\n".join([" ".join(words[:3])] * 20), 2: "| # " + " # ".join(words)}.get(i % 6, ". ".join(words) + ".\nMore.")
        rows.append((i, text))
    rows += [(200, None), (201, ""), rows[4]]
    out = rules.score_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    votes = {}
    for x in out:
        votes[id(x)] = tuple(int(good(x)) - int(bad(x)) for bad, good in VOTES.values())
        assert votes[id(x)] == tuple(x[f"vote_{n}"] for n in VOTES), x
    counts = {}
    for v in votes.values():
        counts[v] = counts.get(v, 0) + 1
    model = rules.fit(sorted(counts.items()), len(VOTES))
    for x in out:
        assert abs(x.p_good - model.p_good(votes[id(x)])) < 1e-9 and x.verdict == (x.p_good >= 0.5)
    assert 10 < sum(x.verdict for x in out) < len(out) - 10


def test_id_that_is_named_like_a_fact(spark):
    out = rules.score_rules(spark.createDataFrame([(7, "a b c")], "n_words long, text string"), id_col="n_words").first()
    assert out.id == 7 and out.n_words == 3
